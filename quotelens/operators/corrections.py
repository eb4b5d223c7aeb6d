"""Corrections that users keep: a table with a row for each (url_key, composite_key, kind), for 30 days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.operators.findings import latest

KEY = ["url_key", "composite_key", "kind"]
KEPT = "interval 30 days"


def live(corrections: DataFrame, now: Column) -> DataFrame:
    """Rows that haven't expired; an old row without a kind is a ref-edit."""
    return corrections.withColumn("kind", F.coalesce("kind", F.lit("ref-edit"))).where(F.col("at") + F.expr(KEPT) >= now)


def upserted(corrections: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """corrections with the latest change of each key put in, and expired rows gone."""
    new = latest(changes.select(corrections.columns), KEY, [F.col("at").desc()])
    return live(corrections, now).join(new.select(KEY), KEY, "left_anti").unionByName(new)


def removed(corrections: DataFrame, keys: DataFrame) -> DataFrame:
    return corrections.join(keys.select(KEY), KEY, "left_anti")


def reapplied(findings: DataFrame, corrections: DataFrame, now: Column) -> DataFrame:
    """Findings with the corrections kept for them: a finding's own, or that of the finding it replaced.

    findings: url_key, id, prior_id. Adds correction (the kind; a change of text goes before one of reference) and payload.
    """
    rank = F.when(F.col("kind") == "text-replace", 0).when(F.col("kind") == "ref-edit", 1).when(F.col("kind") == "reference-attribution", 2).otherwise(3)
    kept = live(corrections, now).select(F.col("url_key").alias("_u"), F.col("composite_key").alias("_k"), F.struct(rank.alias("rank"), F.col("kind"), F.col("payload")).alias("c"))
    keyed = findings.withColumn("_key", F.explode(F.array_distinct(F.array_compact(F.array("id", "prior_id")))))
    found = keyed.join(kept, (F.col("url_key") == F.col("_u")) & (F.col("_key") == F.col("_k"))).groupBy("url_key", "id").agg(F.min("c").alias("c"))
    return findings.join(found, ["url_key", "id"], "left").withColumn("correction", F.col("c.kind")).withColumn("payload", F.col("c.payload")).drop("c")


def is_shaky(text: Column, refs: Column) -> Column:
    """Whether a quotation's authentic text can't be put in its place: it is in parts but of one passage, or matches several."""
    return (F.contains(text, F.lit("*")) & (F.size(refs) == 1)) | (F.size(refs) > 1)


def is_automatic(verdict: Column, shaky: Column, has_near: Column, allowed: tuple[str, ...]) -> Column:
    return verdict.isin(*allowed) & ~shaky & ((verdict != "red") | has_near)


def reverted(found: DataFrame, originals: DataFrame, undone: DataFrame, keys: list[str]) -> DataFrame:
    """found with the findings of undone (keys, id) replaced by the originals that they came from; the rest stays."""
    those = found.join(undone.select(*keys, "id"), [*keys, "id"], "left_semi")
    back = originals.join(those.select(*keys, F.coalesce("prior_id", "id").alias("id")), [*keys, "id"], "left_semi")
    return found.join(undone.select(*keys, "id"), [*keys, "id"], "left_anti").unionByName(back.select(found.columns))
