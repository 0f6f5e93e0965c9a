"""A cleaning pipeline over ``documents``: each stage is one operator, written as Parquet and read again by the next.

All stages but the last return the columns of their input, whatever their names, and rows in any order. Texts are taken
whole, however long; columns besides doc_id and text are neither read nor changed, and null there is no matter. An empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspark.llm import decontaminate, minhash, packing, secrets, toxicity, util
from mediaspark.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    Null, empty and wordless texts stay, documents without an id too; repeated rows stay or go together. Without labels
    of both kinds nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_civil(docs, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (id and text) of each class of near duplicates: the one of the smallest id.

    Of an id with several texts only those go that have a near copy of a smaller id, or of the same id and a smaller
    row key. Rows alike in id and text are one document, of which one row stays, whatever its other columns hold.
    Documents without an id stay, every row of them; null texts and those without words are no copies of other ids.
    """
    judged = util.save(minhash.classed(docs), "classed")
    gone = judged.filter("NOT kept").select("_k1", "_k2").distinct()
    rows = util.row_key(docs.select(F.struct("*").alias("_row"), "doc_id", "text"))
    left = rows.join(util.small(util.save(gone, "gone")), ["_k1", "_k2"], "left_anti")
    again = judged.filter("doc_id IS NOT NULL").groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_k1", "_k2")
    repeated = util.save(again, "repeated")
    if repeated.isEmpty():
        return left.select("_row.*")
    once = left.join(util.small(repeated), ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    return left.join(util.small(repeated), ["_k1", "_k2"], "left_anti").unionByName(once).select("_row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate.

    Null, empty and wordless texts stay, documents without an id are judged like others; repeated rows stay or go together.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.keep_clean(docs, benchmark)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of a secret replaced by its kind.

    Spans that overlap are replaced as one; null texts stay null, empty ones empty; repeated rows are masked alike.
    """
    return secrets.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences of 1024 tokens.

    A null or empty text is its end id alone; repeated rows and rows without an id are packed each for itself.
    """
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: Trained models, signatures and token ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = util.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
