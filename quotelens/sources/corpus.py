"""The canon: passages, their words, and the names of their groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.functions.profiles import ARABIC, Profile, split_vocative

#: A canon as one JSON document: groups of passages, and the groups' names.
CANON = "meta struct<chaptersNames: struct<chaptersNamesAr: map<string,int>>>, suras array<struct<index: string, name: string, ayas: array<struct<index: string, text: string>>>>"
# Other spellings of group names.
VARIANTS = {"البقر": 2, "الحجرت": 49, "يسين": 36, "الرحمان": 55, "الانشراح": 94, "بني اسرايل": 17, "سبا": 34, "حم السجدة": 41, "المومن": 40, "غافر": 40, "المؤمن": 40}


def passages_of(rows: DataFrame, profile: Profile, wording: Column | None = None) -> DataFrame:
    """rows: group_id, ord, group_name, text. Adds ref, t1, t1_words, skeleton and display_words (null if they don't pair with t1_words)."""
    t1 = profile.form(F.col("text") if wording is None else wording)
    shown = F.filter(F.split("text", " "), lambda w: (F.length(profile.form(w)) > 0) if profile.drift == "" else profile.has_content(w))
    out = rows.withColumn("t1", t1).withColumn("t1_words", profile.words(F.col("t1"))).withColumn("skeleton", profile.skeleton(F.col("t1"))).withColumn("_shown", shown)
    out = out.withColumn("display_words", F.when(F.size("_shown") == F.size("t1_words"), F.col("_shown"))).drop("_shown")
    return out.withColumn("ref", F.concat_ws(":", "group_name", F.col("ord").cast("string")))


def read_canon(spark: SparkSession, path: str, profile: Profile = ARABIC) -> DataFrame:
    """Passages of a JSON canon. A file of another form, or without passages, raises an error."""
    canon = spark.read.schema(CANON).option("multiLine", True).option("mode", "FAILFAST").json(path)
    groups = canon.select(F.explode("suras").alias("g")).select(F.col("g.index").try_cast("int").alias("group_id"), F.col("g.name").alias("group_name"), F.explode("g.ayas").alias("p"))
    rows = groups.select("group_id", "group_name", F.col("p.index").try_cast("int").alias("ord"), F.col("p.text").alias("text")).where("group_id > 0 and ord > 0 and text is not null")
    if rows.isEmpty():
        raise ValueError(f"no passages in {path}")
    return passages_of(rows, profile, split_vocative(F.col("text")) if profile is ARABIC else None)


def benchmark_passages(benchmark: DataFrame, profile: Profile, per_group: int = 10) -> DataFrame:
    """Passages of a table of item_id and text, in groups of neighbours."""
    group = F.floor(F.col("item_id") / per_group).cast("int")
    rows = benchmark.select("item_id", group.alias("group_id"), (F.col("item_id") % per_group + 1).cast("int").alias("ord"), F.concat(F.lit("g"), group.cast("string")).alias("group_name"), "text")
    return passages_of(rows, profile)


def passage_words(passages: DataFrame) -> DataFrame:
    """The inverted index: a row for each word of each passage, with its place."""
    return passages.select("group_id", "ord", F.posexplode("t1_words").alias("place", "word"))


def ref_names(spark: SparkSession, names: DataFrame, profile: Profile, variants: dict[str, int] | None = None) -> DataFrame:
    """name_key and group_id; names: name, group_id. Keys are names in comparison form and their skeletons; of equal keys the last group wins."""
    extra = spark.createDataFrame(list((variants or {}).items()) or [], "name string, group_id int")
    keyed = names.select("name", "group_id", F.lit(0).alias("rank")).unionByName(extra.withColumn("rank", F.lit(2)))
    form = profile.form(F.col("name"))
    both = keyed.select(form.alias("name_key"), "group_id", "rank").unionByName(keyed.select(profile.skeleton(form).alias("name_key"), "group_id", (F.col("rank") - 1).alias("rank")))
    return both.where("name_key <> ''").groupBy("name_key").agg(F.max_by("group_id", F.struct("rank", "group_id")).alias("group_id"))


def prune_canon(spark: SparkSession, source: str, target: str) -> None:
    """Write the columns of a canon that are used, in the same form as read_canon reads."""
    spark.read.schema(CANON).option("multiLine", True).option("mode", "FAILFAST").json(source).write.mode("overwrite").json(target)
