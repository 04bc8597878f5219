"""The operators' queries over whole tables, by the names that __spark_entry__ registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, html_extract, license_scan, lm_score, lm_score_trigram, mixture, ngram_join, quality, secret_scan, token_store, top_k
from tidewright.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_join.link(_table(spark, sf_dir, "documents"), n=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 5, 2, 1, keys scaled by quality labels."""
    quality_weights = mixture.label_weights(_table(spark, sf_dir, "labels"))
    return mixture.mix(_table(spark, sf_dir, "documents"), quality_weights).select("doc_id", "size", "source_size", "target", "taken")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    return top_k.search(_table(spark, sf_dir, "embeddings"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as packed token ids, read back."""
    return token_store.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of every document by the rest of the corpus."""
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op6_lm_score_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over trigrams."""
    return lm_score_trigram.score(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the windows of benchmark items."""
    return decontaminate.digest(decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document."""
    return license_scan.digest(license_scan.scan(_table(spark, sf_dir, "documents")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept when all are resampled towards labelled good text."""
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).where("selected")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with linked multipart credentials."""
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_html_extract": op2_html_extract,
    "op3_mixture": op3_mixture,
    "op4_top_k": op4_top_k,
    "op5_token_store": op5_token_store,
    "op6_lm_score": op6_lm_score,
    "op6_lm_score_trigram": op6_lm_score_trigram,
    "op7_decontaminate": op7_decontaminate,
    "op8_license_scan": op8_license_scan,
    "op9_quality": op9_quality,
    "op10_secret_scan": op10_secret_scan,
}


def oracles() -> dict[str, str]:
    return dict(ORACLES)
