"""The canon as written tables that every way of matching reads, and that outlive the job that made them.

    passages   all columns of the canon, by group_id and ord
    forms      comparison form -> passage
    counts     key -> how many passages have it, and in how many parts they are
    postings   key and part -> passage

A key is a word, two neighbouring words, a word or two without the letters that spelling may drop (skeletons), or a run of
GRAM letters of a passage's skeleton written without spaces: the last holds whatever words are merged or split. Each table
is bucketed by what it is joined by, so a join shuffles only the candidates. A key of many passages is cut into parts of
about PART passages that are buckets of their own, so none is hot.

An index lies in the shared folder under a hash of the canon; whoever asks for the same canon later opens it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotelens.functions.profiles import Profile
from quotelens.store import delete, move, shared_dir

PASSAGE = ["group_id", "ord"]
#: What a key is made of.
WORD, PAIR, SKELETON, SKELETON_PAIR, LETTERS = "wpstg"
GRAM, PART = 6, 4096
#: Bytes of a table in memory up to which it is broadcast, and bytes of a bucket.
BROADCAST, BUCKET = 8 << 20, 64 << 20
BUCKETED = {"passages": PASSAGE, "forms": ["t1"], "counts": ["key"], "postings": ["key", "part"]}
VERSION = "1"


def key(kind: str, text: Column) -> Column:
    return F.concat(F.lit(kind), text)


def neighbours(words: Column) -> Column:
    """Each two words that follow one another, as one text."""
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def letters(words: Column, profile: Profile) -> Column:
    """The words' skeletons without spaces between."""
    return profile.skeleton(F.array_join(words, ""))


def grams(flat: Column) -> Column:
    """Each run of GRAM characters of a text; none of a shorter one."""
    chars = F.filter(F.split(flat, ""), lambda c: c != "")
    return F.when(F.length(flat) >= GRAM, F.transform(F.sequence(F.lit(1), F.greatest(F.length(flat) - GRAM + 1, F.lit(1))), lambda i: F.array_join(F.slice(chars, i, GRAM), ""))).otherwise(F.array().cast("array<string>"))


def keys_of(words: Column, profile: Profile) -> Column:
    """All keys of a passage, each once."""
    bones = F.transform(words, lambda w: profile.skeleton(w))
    named = lambda kind, values: F.transform(values, lambda v: key(kind, v))
    every = [named(WORD, words), named(PAIR, neighbours(words)), named(LETTERS, grams(letters(words, profile)))]
    every += [named(SKELETON, bones), named(SKELETON_PAIR, neighbours(bones))] if profile.drift else []
    return F.array_distinct(F.flatten(F.array(*every)))


def soft_kind(kind: str, profile: Profile) -> str:
    """The kind of key under which words, or pairs, of any spelling are: without such letters they are their own skeletons."""
    return {WORD: SKELETON, PAIR: SKELETON_PAIR}[kind] if profile.drift else kind


@dataclass(frozen=True, eq=False)
class CanonIndex:
    """The tables, and of each about its size in memory."""

    passages: DataFrame
    forms: DataFrame
    counts: DataFrame
    postings: DataFrame
    sizes: dict[str, int]
    path: str

    def side(self, table: str, *columns: str, limit: int | None = None) -> DataFrame:
        """A table to be joined, broadcast if all of it is small."""
        df = getattr(self, table)
        df = df.select(*columns) if columns else df
        return F.broadcast(df) if self.sizes[table] <= (BROADCAST if limit is None else limit) else df


def _derived(passages: DataFrame, profile: Profile) -> dict[str, DataFrame]:
    posted = passages.select(F.explode(keys_of(F.col("t1_words"), profile)).alias("key"), *PASSAGE)
    counts = posted.groupBy("key").agg(F.count("*").alias("often")).withColumn("parts", F.ceil(F.col("often") / PART).cast("int"))
    postings = posted.join(counts, "key").select("key", F.pmod(F.xxhash64(*PASSAGE), F.col("parts")).cast("int").alias("part"), *PASSAGE)
    return {"passages": passages, "forms": passages.select("t1", *PASSAGE), "counts": counts, "postings": postings}


def _sizes(passages: DataFrame) -> dict[str, int]:
    """About how much memory each table takes, from the canon's letters, words and passages."""
    n, words, size = passages.agg(F.count("*"), F.coalesce(F.sum(F.size("t1_words")), F.lit(0)), F.coalesce(F.sum(F.octet_length("t1") + F.octet_length("text")), F.lit(0))).first()
    keys = 4 * words + size // 2
    return {"passages": 3 * size + 40 * words + 200 * n, "forms": size + 64 * n, "counts": 48 * keys, "postings": 64 * keys}


_KEPT: WeakKeyDictionary[DataFrame, dict[str, CanonIndex]] = WeakKeyDictionary()


def index_of(canon: DataFrame | CanonIndex, profile: Profile) -> CanonIndex:
    """canon itself if it is an index, else the written index of these passages."""
    if isinstance(canon, CanonIndex):
        return canon
    known = _KEPT.setdefault(canon, {})
    if profile.name not in known:
        known[profile.name] = kept_index(canon, profile)
    return known[profile.name]


def kept_index(passages: DataFrame, profile: Profile, folder: str | None = None) -> CanonIndex:
    """The written index of a canon: opened if there is one in folder (the shared one unless given), else made and put there.

    It is written beside its place and moved there whole, so a job that fails, or another one that makes the same index, does no harm.
    """
    spark = passages.sparkSession
    columns = sorted(passages.columns)
    hashed = F.xxhash64(*[F.col(c).cast("string") if dict(passages.dtypes)[c].startswith("map") else F.col(c) for c in columns]).cast("decimal(20,0)")
    n, total, spread = passages.agg(F.count("*"), F.sum(hashed), F.sum(hashed * hashed % 1_000_003)).first()
    name = f"{hash_text(json.dumps([VERSION, profile.name, profile.drift, columns, n, str(total), str(spread)])):x}"
    path = f"{folder.rstrip('/') if folder else shared_dir(spark) + '/quotelens/canons'}/{name}"
    if (found := open_index(spark, path)) is None:
        draft = f"{path}-{uuid.uuid4().hex}"
        _write(passages, profile, draft)
        if not move(spark, draft, path):
            delete(spark, draft)
        found = open_index(spark, path)
    return found


def hash_text(text: str) -> int:
    return int(hashlib.sha256(text.encode()).hexdigest()[:24], 16)


def _write(passages: DataFrame, profile: Profile, path: str) -> None:
    spark = passages.sparkSession
    sizes, tables = _sizes(passages), _derived(passages, profile)
    facts = {}
    for name, df in tables.items():
        buckets = max(1, -(-sizes[name] // BUCKET))
        by = BUCKETED[name]
        table = f"quotelens_{uuid.uuid4().hex}"
        # one file for each bucket, in order
        df.repartition(buckets, *by).write.format("parquet").bucketBy(buckets, by[0], *by[1:]).sortBy(by[0], *by[1:]).option("path", f"{path}/{name}").saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")
        facts[name] = {"columns": [[f.name, f.dataType.simpleString()] for f in df.schema.fields], "buckets": buckets, "size": sizes[name]}
    spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.text(f"{path}/facts")


def open_index(spark: SparkSession, path: str) -> CanonIndex | None:
    """The index at path, or None if there is none."""
    try:
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    tables = {}
    for name, fact in facts.items():
        table = f"quotelens_{hash_text(path):x}_{name}"
        by = ", ".join(BUCKETED[name])
        columns = ", ".join(f"`{c}` {t}" for c, t in fact["columns"])
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {fact['buckets']} BUCKETS LOCATION '{path}/{name}'")
        tables[name] = spark.table(table)
    return CanonIndex(**tables, sizes={name: fact["size"] for name, fact in facts.items()}, path=path)


def option(keys: Column, take: Column | None = None) -> Column:
    """One way to search a candidate's passages: those that have any of keys; or, with take, of the so many rarest of them."""
    return F.struct((F.lit(2**31 - 1) if take is None else take).cast("int").alias("take"), keys.cast("array<string>").alias("keys"))


def probed(asked: DataFrame, index: CanonIndex) -> DataFrame:
    """cand_id, group_id and ord: what the cheapest option of each candidate finds. asked: cand_id and options (an array; null ones don't count).

    Every option has to find all passages that matter. Its cost is the number of passages that its keys have; keys of the
    candidate's own that the canon doesn't have cost nothing. A candidate without options has no rows.
    """
    options = F.posexplode(F.filter("options", lambda o: o.isNotNull())).alias("option", "o")
    keys = asked.select("cand_id", options).select("cand_id", "option", "o.take", F.explode(F.array_distinct("o.keys")).alias("key"))
    counted = keys.join(index.side("counts"), "key", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    rare = Window.partitionBy("cand_id", "option").orderBy("often", "key")
    chosen = counted.withColumn("_k", F.row_number().over(rare)).where("_k <= take")
    costs = chosen.groupBy("cand_id", "option").agg(F.sum("often").alias("cost"), F.collect_list(F.when(F.col("often") > 0, F.struct("key", "parts"))).alias("found"))
    best = costs.groupBy("cand_id").agg(F.min_by("found", F.struct("cost", "option")).alias("found"))
    probes = best.select("cand_id", F.explode("found").alias("f")).select("cand_id", "f.key", F.explode(F.sequence(F.lit(0), F.col("f.parts") - 1)).alias("part"))
    return probes.join(index.side("postings"), ["key", "part"]).select("cand_id", *PASSAGE).distinct()
