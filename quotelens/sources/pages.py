"""Text of web pages as a scan of text nodes, and as one text with boundaries."""

from __future__ import annotations

import html as charrefs
import re
from collections.abc import Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions.profiles import SPACES

#: Elements whose content is no text of the page.
HIDDEN = "script|style|noscript|template|textarea|title|svg|iframe"


class Reading(NamedTuple):
    """How a page is read. hidden: elements whose content is no text; references: those that are decoded, with what they stand for
    (None: all of HTML, as browsers do, some of them without their semicolon); spaces: what a blank node is made of (None: all white space)."""

    hidden: str = HIDDEN
    references: Mapping[str, str] | None = None
    spaces: str | None = None


BROWSER = Reading()


def nodes_of(html: Column, reading: Reading = BROWSER) -> Column:
    """The text nodes of a page in order with their places, without blank ones. Tags go before references are decoded."""
    hidden, references, spaces = reading
    known = re.compile("|".join(map(re.escape, references))) if references else None

    @F.pandas_udf("array<struct<text:string,start:int>>")
    def decoded(nodes: pd.Series) -> pd.Series:
        def placed(parts) -> list[dict]:
            at, out = 0, []
            for part in parts:
                text = part
                if "&" in part and references is None:
                    text = charrefs.unescape(part)
                elif known:
                    text = known.sub(lambda m: references[m[0]], part)
                if text.strip(spaces):
                    out.append({"text": text, "start": at})
                    at += len(text) + 1
            return out

        return nodes.map(placed)

    blank = SPACES if spaces is None else f"[{re.escape(spaces)}]+"
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), rf"(?is)<!--.*?-->|<({hidden})\b.*?</\1\s*>", "<>")
    return decoded(F.filter(F.split(shown, r"<[^>]*>"), lambda n: F.regexp_replace(n, blank, "") != ""))


def text_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, node (its number), text and start: where the node begins in the page's joined text."""
    return pages.select(key, F.posexplode(nodes_of(F.col(html))).alias("node", "n")).select(key, "node", F.col("n.text").alias("text"), F.col("n.start").alias("start"))


def joined_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and text: the nodes with a boundary between each two."""
    return pages.select(key, F.array_join(F.transform(nodes_of(F.col(html)), lambda n: n["text"]), "\0").alias("text"))


def spans_in_nodes(spans: DataFrame, nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """Spans (key, start, end) of joined texts as places in their nodes: node, from and to, a row for each node that a span touches.

    nodes: as text_nodes gives them. Both are compared by the blocks of 1,000 characters that they touch.
    """
    block = lambda start, end: F.explode(F.sequence(F.floor(start / 1000), F.floor((end - 1) / 1000))).alias("_b")
    ends = nodes.withColumn("_to", F.col("start") + F.length("text")).select(key, "node", F.col("start").alias("_from"), "_to", block(F.col("start"), F.col("_to")))
    both = spans.select("*", block(F.col("start"), F.col("end"))).join(ends, [key, "_b"]).where("start < _to and _from < end")
    both = both.where(F.col("_b") == F.floor(F.greatest("start", "_from") / 1000))
    return both.select(*spans.columns, "node", (F.greatest("start", "_from") - F.col("_from")).alias("from"), (F.least("end", "_to") - F.col("_from")).alias("to"))
