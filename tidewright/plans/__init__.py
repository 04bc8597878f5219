"""Named queries over the driver's tables, each with the SQL that DuckDB answers alike."""

from tidewright.plans import control, retrieval, usage

PLANS = {**retrieval.PLANS, **usage.PLANS, **control.PLANS}
