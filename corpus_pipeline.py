"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.llm import decontamination, mixing, near_dedup, quality_rules, sharding
from quotelens.llm.store import materialize, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _keyed(docs: DataFrame) -> DataFrame:
    """_whole (a row of docs), text and _row: equal for rows of equal doc_id and text only. In its order rows without a doc_id come last."""
    hashed = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), hashed.alias("text"))
    return docs.select(_whole(docs), "text", row.alias("_row"))


def _whole(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go."""
    judged = quality_rules.quality_rules(docs.select(_whole(docs), "text"), key="_whole")
    return judged.where("kept").select("_whole.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, and one of rows with equal doc_id and text."""
    rows = _keyed(docs)
    kept = materialize(near_dedup.near_duplicates(rows, key="_row").where("kept").select("_row"), "kept")
    return rows.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select("_whole.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain an item of the benchmark go."""
    rows = _keyed(docs)
    found = decontamination.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_row")
    return rows.join(materialize(found.select("_row"), "contaminated"), "_row", "left_anti").select("_whole.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them, none, one or two times, each at its place in training; one of a source may be cut."""
    uses = mixing.passes(mixing.mix(docs, mixing.words_in(F.col("text"))))
    return uses.select("row.*").withColumn("n_chars", F.length("text").cast("long"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents themselves, with shard and slot."""
    return sharding.shard_rows(docs, sharding.HashTree.uniform(3, 4, 2), whole=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: Suffix arrays, connected components and windows of templates aren't SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again for the next one."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
