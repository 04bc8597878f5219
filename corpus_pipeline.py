"""A training corpus from documents: quality, near duplicates, decontamination, mixture, tokens.

Each stage works on all rows that the one before kept and, but for the last, keeps their columns, whatever they
are called. Before a stage reads, executors collect the garbage of those before. Edge cases, of all stages: rows
with a null id, text or source are rows like others; repeated rows and ids are decided together (see each stage);
an empty table gives an empty one at every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, mixture, ngram_join, quality, token_store
from tidewright.llm.queries import tokenizer_path
from tidewright.llm.shared import collect_garbage, cut, drop, scratch

#: Near duplicates: words of a shingle, and the similarity in percent from which documents link.
SHINGLE, SIMILAR = 5, 80


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _lean(stage: Stage) -> Stage:
    """stage, begun with executors that hold no garbage."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_garbage(spark)
        return stage(spark, docs, sf_dir)

    return run


def _columns(kept: DataFrame, docs: DataFrame) -> DataFrame:
    return kept.select(*docs.columns)


@_lean
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects. Rows of one id go if any of them is rejected; without labels of both kinds all stay; texts without words are neutral."""
    return _columns(quality.keep_selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), docs)


@_lean
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id. Repeated rows become one; rows of one id stay together; texts without words are in no class and stay, as do rows without an id."""
    return _columns(ngram_join.keep_one(docs, SHINGLE, SIMILAR, 100), docs)


@_lean
def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null and wordless texts have none and stay; rows of one id are decided by their texts; items without an id count."""
    return _columns(decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


@_lean
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: the one at the boundary is whole if at least half of it fits. A null source is a source; rows of one id, and all rows without one, are taken as often as the most taken of them; documents of size 0 come with each complete epoch."""
    return _columns(mixture.expand(docs, mixture.label_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))), docs)


@_lean
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of the documents, read back: doc_id, start, n_tokens, ids_crc32. A null or empty text has the end id alone; rows without an id come last."""
    return token_store.round_trip(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("mixture", mix_sources),
    ("tokens", tokenize),
]

#: The classifier, the classes and the tokenizer are beyond SQL; tests/llm holds each stage against a version over plain lists.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch() as tables:
            docs = cut(stage(spark, before, sf_dir), name.replace(" ", "-"))
            tables[:] = [t for t in tables if t is not docs]
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
