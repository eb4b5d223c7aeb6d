"""Pages as trees: text nodes with the elements that they lie in, and the words around a node.

A page is read once, in a worker; what follows are joins of nodes with the elements above them.
"""

from __future__ import annotations

import html as charrefs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from quotelens.functions.labels import scrub_volatile
from quotelens.functions.profiles import squeeze

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<[!?/a-zA-Z][^>]*(?:>|\Z)", re.S)
EDITABLE = re.compile(r"""\bcontenteditable(?:\s*=\s*(?:"(?:true)?"|'(?:true)?'|true(?=[\s/>]|$))|(?=[\s/>]|$)(?!\s*=))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements without elements in them: all up to their end is their text.
RAW = frozenset("script style textarea title".split())
#: Elements whose text is no text of the page, nor that of any element within.
HIDDEN = RAW | frozenset("noscript template iframe svg select button".split())
#: Elements above a node that are looked at, characters that make other text, and characters of a context.
HOPS, OTHER, AROUND = 8, 3, 200
#: Characters of nodes and elements around them that a worker holds at once, beyond those of a single page.
HELD = 500_000

NODE = StructType().add("node", IntegerType()).add("text", StringType()).add("start", IntegerType()).add("path", ArrayType(IntegerType())).add("tags", ArrayType(StringType())).add("shown", BooleanType())
_ARROW = {"node": pa.int32(), "text": pa.string(), "start": pa.int32(), "path": pa.list_(pa.int32()), "tags": pa.list_(pa.string()), "shown": pa.bool_()}


def tree_of(page: str) -> list[dict]:
    """The text nodes of a page in order: text, start (in the nodes' joined text), path (the numbers of the elements around it, nearest first), tags (their names) and shown.

    Text that isn't shown, and blank text, has no place in the joined text. An end tag closes the nearest open element of its
    name and all within; one without a beginning is nothing.
    """
    nodes: list[dict] = []
    stack: list[tuple[int, str, bool]] = []
    count = at = place = 0

    def text(upto: int) -> None:
        nonlocal place
        found = charrefs.unescape(page[at:upto])
        if found.strip():
            shown = not any(h for _, _, h in stack)
            nodes.append({"text": found, "start": place if shown else None, "path": [n for n, _, _ in stack[::-1]], "tags": [t for _, t, _ in stack[::-1]], "shown": shown})
            place += (len(found) + 1) * shown

    position = 0
    while m := TAG.search(page, position):
        text(m.start())
        at = position = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = max((k for k, (_, t, _) in enumerate(stack) if t == tag), default=None)
            if depth is not None:
                del stack[depth:]
            continue
        if tag in VOID or m[3].endswith("/") and tag not in RAW:
            continue
        count += 1
        stack.append((count, tag, tag in HIDDEN or bool(EDITABLE.search(m[3]))))
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, position)
            text(end.start() if end else len(page))
            at = position = end.end() if end else len(page)
            stack.pop()
    text(len(page))
    return nodes


def nodes_in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of pages (key, html), a row each, in parts of about HELD characters: memory doesn't grow with the pages of a batch."""
    for batch in batches:
        keys, pages = batch.columns
        rows: list[int] = []
        nodes: list[dict] = []
        held = 0

        def part() -> pa.RecordBatch:
            columns = [pa.array([n[name] for n in nodes], kind) for name, kind in _ARROW.items()]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int32())), *columns], [batch.schema.names[0], *_ARROW])  # noqa: B023

        for row in range(batch.num_rows):
            for number, n in enumerate(tree_of(pages[row].as_py() or "")):
                rows.append(row)
                nodes.append({"node": number, **n})
                held += len(n["text"]) + 10 * len(n["path"])
                if held >= HELD:
                    yield part()
                    rows, nodes, held = [], [], 0
        if nodes:
            yield part()


def tree_nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, node (its number among all), text, start, path, tags and shown, as tree_of gives them; a page that is null has none."""
    return pages.select(key, html).mapInArrow(nodes_in_parts, StructType([pages.schema[key], *NODE]))


def contexts(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """key, node and context for nodes as tree_nodes gives them (those that aren't shown neither have a context nor are in one).

    A node's context is the text of the nearest element around it, at most HOPS up, that has OTHER characters more than the node,
    in another node, or of the page's body: spaces squeezed, the node's own text replaced by a dot, without what changes between visits; of a
    long one the beginning and the end.
    """
    shown = nodes.where("shown")
    above = shown.select(key, "node", F.length(squeeze(F.col("text"))).alias("_own"), F.posexplode(F.arrays_zip(F.slice("path", 1, HOPS).alias("element"), F.slice("tags", 1, HOPS).alias("tag"))).alias("up", "_e")).select(key, "node", "_own", "up", "_e.*")
    # what each element holds, of all nodes within it, however deep
    within = shown.select(key, "node", F.length(squeeze(F.col("text"))).alias("_size"), F.explode("path").alias("element"))
    sums = within.groupBy(key, "element").agg(F.sum("_size").alias("_all"), F.count_if(F.col("_size") >= OTHER).alias("_nodes"))
    met = above.join(sums, [key, "element"]).where((F.col("_all") - F.col("_own") >= OTHER) & (F.col("_nodes") - F.when(F.col("_own") >= OTHER, 1).otherwise(0) > 0) | F.col("tag").isin("body", "html"))
    chosen = met.groupBy(key, "node").agg(F.min_by("element", "up").alias("element"))
    wanted = chosen.select(key, "element").distinct()
    texts = shown.select(key, "node", "text", F.explode("path").alias("element")).join(wanted, [key, "element"]).groupBy(key, "element").agg(F.array_sort(F.collect_list(F.struct("node", "text"))).alias("_texts"))
    around = chosen.join(texts, [key, "element"])
    raw = F.array_join(F.transform("_texts", lambda t: F.when(t["node"] == F.col("node"), F.lit(" · ")).otherwise(t["text"])), "")
    whole = scrub_volatile(squeeze(raw))
    half = AROUND // 2
    cut = F.when(F.length(whole) <= AROUND, whole).otherwise(F.concat(F.substring(whole, 1, half), F.lit(" … "), F.substring(whole, -half, half)))
    return around.select(key, "node", cut.alias("context"))

