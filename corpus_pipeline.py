"""The corpus pipeline: toxicity, near-dedup, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as Parquet and
read again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelsift.llm import minhash, mixing, packing, personal_data, toxicity
from modelsift.llm.common import prepare, table
from modelsift.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels of the documents at hand."""
    prepare(spark)
    model = toxicity.fitted(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = F.arrow_udf(toxicity.scorer(model), "double")
    return docs.filter(score(F.coalesce("text", F.lit(""))) < toxicity.REJECT_AT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Near copies share percent of their shingles of width words. Of rows with one id and one text one stays, too;
    rows of one id with different texts are told apart by no id, so they all stay or go. Texts go from the reader to the
    result; the ids that go are written first, so that their size decides how they are joined.
    """
    prepare(spark)
    verdicts = written(minhash.near_duplicates(docs.select("doc_id", "text"), width, percent).select("doc_id", "kept"), "dedup-verdicts")
    gone = written(verdicts.filter("not kept").select("doc_id").distinct(), "dedup-gone")
    stay = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = verdicts.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = written(again, "dedup-repeated")
    if again.isEmpty():
        return stay
    single = stay.join(again, "doc_id", "left_anti").select(docs.columns)
    return single.unionByName(stay.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the new text."""
    prepare(spark)
    weights = personal_data.fitted(docs.select("doc_id", "text"))
    cleaned = personal_data.redacted(docs, weights)
    changed = F.length("text").cast("long")
    return cleaned.withColumn("n_chars", F.coalesce(changed, F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mixture takes it."""
    prepare(spark)
    return mixing.mixed_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bin, offset and the bin's length."""
    prepare(spark)
    return packing.best_fit(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", partial(drop_near_duplicates, width=5, percent=80)),
    ("personal_data", redact_personal_data),
    ("mixture", mix_sources),
    ("packing", pack),
]

# The classifier and the random field are learned, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
