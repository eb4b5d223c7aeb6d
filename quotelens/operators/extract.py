"""Quotation candidates: marks in a text, and the rules by which marks next to each other make a candidate.

One pass over a text finds its marks: phrases that introduce a quotation, quoted spans, references, breaks, and the runs of
words that stand after a phrase or before a reference. No pattern is tried again from each place of a run of letters: references are
found by their numbers, and what stands before them is read backwards once. The rest is relational: windows over a text's marks
in order, and joins of neighbouring blocks of characters. Spans are half-open, in characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelens.functions.profiles import LETTER_RANGES
from quotelens.store import materialize

# The phrases that introduce a quotation, in their order.
LEAD_INS = (
    "قال الله تعالى", "قال تعالى", "وقال تعالى", "قال سبحانه وتعالى", "قال سبحانه",
    "قوله تعالى", "وقوله تعالى", "قوله سبحانه", "قوله عز وجل", "وقوله عز وجل",
    "قال عز وجل", "وقال عز وجل", "قال جل وعلا", "قال جل جلاله", "يقول الله تعالى",
    "يقول تعالى", "ويقول تعالى", "يقول عز وجل", "ويقول عز وجل",
    "يقول سبحانه وتعالى", "ويقول سبحانه وتعالى",
    "يقول تبارك وتعالى", "ويقول تبارك وتعالى",
    "يقول الله عز وجل", "يقول جل وعلا",
    "وقوله الكريم", "قوله الكريم", "وقوله جل وعلا", "قوله جل وعلا",
    "وقوله جل جلاله", "قوله جل جلاله", "وقوله سبحانه",
    "قال ربكم", "في كتاب الله", "في قوله تعالى",
    "فقوله تعالى", "فقوله سبحانه", "فقوله عز وجل", "فقوله جل وعلا", "فقوله الكريم",
    "بقوله تعالى", "بقوله سبحانه", "بقوله عز وجل", "بقوله جل وعلا", "بقوله الكريم", "بقول الله تعالى",
    "كقوله تعالى", "كقوله سبحانه", "كقوله عز وجل", "كقوله جل وعلا", "كقول الله تعالى",
    "لقوله تعالى", "لقوله سبحانه", "لقوله عز وجل",
    "قول الله تعالى", "وقول الله تعالى", "فقول الله تعالى",
    "قول الله سبحانه", "قول الله عز وجل", "قول الله جل جلاله",
    "قال تبارك وتعالى", "وقال تبارك وتعالى",
    "قوله تبارك وتعالى", "وقوله تبارك وتعالى", "فقوله تبارك وتعالى",
    "بقوله تبارك وتعالى", "كقوله تبارك وتعالى",
    "قال عز من قائل", "وقال عز من قائل", "يقول عز من قائل",
    "قوله عز من قائل", "وقوله عز من قائل",
    "فقال تعالى", "ثم قال تعالى", "فقال سبحانه", "ثم قال سبحانه",
    "فقال عز وجل", "ثم قال عز وجل", "فقال جل وعلا", "ثم قال جل وعلا",
    "فقال سبحانه وتعالى", "ثم قال سبحانه وتعالى",
    "في محكم كتابه", "في محكم تنزيله", "في محكم التنزيل", "في محكم الذكر",
    "قال الحق تبارك وتعالى", "قال الحق سبحانه وتعالى", "قال الحق سبحانه",
    "بقول الله سبحانه", "بقول الله عز وجل",
    "كقول الله سبحانه", "لقول الله تعالى",
)
SECONDARY = ("وقوله", "فقوله", "قوله")
# The letters of the script, the marks on letters, signs that stand alone, digits, and the marks around quotations and references.
LETTER = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in LETTER_RANGES) + "]"
VOWEL, SIGN = "[\u064B-\u065F\u0670]", "[\u06D6-\u06ED]"
TATWEEL = "\u0640"
DIGIT = "[0-9٠-٩۰-۹]"
OPEN, CLOSE = "{«[", "}»]"
WEAK_OPEN, WEAK_CLOSE = "(<\"“‘'`", ")>\"”’'`"
REF_OPEN, REF_CLOSE = "({«﴿[", ")}»﴾]"
# Fixed values, in characters: after a lead-in within which its quotation begins; after a quotation within which its reference begins, and one for both of a range; before and
# after the words of a range; after a quotation within which a secondary lead-in counts; before a reference within which its quotation lies, and a short one.
LEAD_GAP, REF_GAP, RANGE_REF_GAP = 80, 80, 250
RANGE_GAP, SECONDARY_GAP = 150, 150
BACK, NEAR, SHORT_BACK = 1200, 1000, 80
LEAST, SHORT, SHORT_MOST, LONG = 4, 8, 65, 900

_any = lambda chars: "[" + re.escape(chars) + "]"
#: Words of the script; possessive, so that a span without an end is given up at once.
_RUN = rf"{LETTER}{VOWEL}*+(?:[\s\0]*+(?:{LETTER}{VOWEL}*+|{SIGN}++))*+"
_INNER = rf"{_RUN}(?:[\s\0]*+[*.…،,]++[\s\0]*+{_RUN})*+"
_phrases = lambda words: rf"(?<!{LETTER})(?:{'|'.join(words)})\s*+[:：]?\s*+"
PATTERNS = {
    "lead": _phrases(LEAD_INS),
    "second": _phrases(SECONDARY),
    "strong": rf"{_any(OPEN)}[\s\0]*+({_INNER})[\s\0]*+{_any(CLOSE)}",
    "weak": rf"{_any(WEAK_OPEN)}[\s\0]*+({_INNER})[\s\0]*+{_any(WEAK_CLOSE)}",
    "range": r"(?<!\s)\s++إلى\s++قوله\s*+[:：]?\s*+",
    "break": r"\0{2,}|[\r\n]{2,}",
}
_NUMBERS = rf"[:：]\s*+{DIGIT}++(?:\s*+[-–]\s*+{DIGIT}++)?+(?:\s*+[،,]\s*+{DIGIT}++)*+(?P<rest>\s*+[.,]?+\s*+){_any(REF_CLOSE)}"
_BARE = str.maketrans(dict.fromkeys("\0{}«»()", " "))
_BARER = str.maketrans(dict.fromkeys("\0{}«»().,،;", " "))


def _is_letter(c: str) -> bool:
    return any(a <= ord(c) <= b for a, b in LETTER_RANGES)


def _words_before(text: str, end: int, least: int, also: str) -> int:
    """Where the words of the script that end before a place begin; also: what may stand in them besides letters and space."""
    at = first = end
    while at > least and ((letter := _is_letter(text[at - 1])) or text[at - 1].isspace() or text[at - 1] in also):
        at -= 1
        if letter:
            first = at
    return first


def marks_of(body: str) -> Iterator[tuple[str, int, int, int, int, int]]:
    """kind, start and end, start and end of what it holds, and where it belongs of every mark of a text."""
    vowels = "".join(map(chr, [*range(0x64B, 0x660), 0x670, *range(0x6D6, 0x6EE)]))
    taken, leads, refs = set(), {}, []
    for kind, pattern in _COMPILED.items():
        for m in pattern.finditer(body):
            group = 1 if pattern.groups else 0
            yield kind, m.start(), m.end(), m.start(group), m.end(group), m.start()
            if kind in ("strong", "weak"):
                taken.add(m.start())
            elif kind in ("lead", "second"):
                leads.setdefault(m.start(), (kind, m.end()))
    bare, barer = body.translate(_BARE), body.translate(_BARER)
    for m in _REF.finditer(body):
        name_end = m.start()
        name = _words_before(body, name_end, 0, vowels[:-24] + TATWEEL)
        if name == name_end:
            continue
        start = name
        while start and body[start - 1].isspace():
            start -= 1
        start = start - 1 if start and body[start - 1] in REF_OPEN else name
        taken.add(start)
        refs.append(start)
        yield "ref", start, m.end(), name, m.start("rest"), start
        for kind, text, least in (("run", barer, start - BACK), ("short", bare, start - SHORT_BACK)):
            first = _words_before(text, start, max(0, least), vowels)
            yield kind, first, start, first, first + len(text[first:start].rstrip()), start
    for m in _OPENED.finditer(body):
        if m.start() not in taken:
            yield "lax", m.start(), m.end(), m.start(1), m.end(1), m.start()
    refs.append(len(body))
    for start, (kind, end) in leads.items():
        if m := _WORDS.match(bare, end, refs[bisect_left(refs, end)]):
            # words after a secondary lead-in are only known to be no other lead-in's
            yield "led", m.start(), m.end(), m.start(1), m.end(1) if kind == "lead" else m.start(1), start


_COMPILED = {kind: re.compile(p) for kind, p in PATTERNS.items()}
_REF, _OPENED, _WORDS = re.compile(_NUMBERS), re.compile(rf"{_any(OPEN + WEAK_OPEN)}[\s\0]*+({_INNER})"), re.compile(rf"\s*+({_RUN})")


def marks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, start, end, inner_start, inner_end, inner and at of every mark of every text."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, kind, start, end, a, b, " ".join(body[a:b].replace("\0", " ").split()), at) for k, body in zip(frame[key], frame[text], strict=True) for kind, start, end, a, b, at in marks_of(body or "")]
            yield pd.DataFrame(rows, columns=[key, "kind", "start", "end", "inner_start", "inner_end", "inner", "at"])

    kind = dict(texts.dtypes)[key]
    return texts.select(key, text).mapInPandas(find, f"`{key}` {kind}, kind string, start int, end int, inner_start int, inner_end int, inner string, at int")


def candidates(texts: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """key, start, end, text, ref, strategy and high of the quotations that the texts seem to hold, none within another.

    In order of precedence: a quoted span after a lead-in (if it has no end, the words up to where they end); after a
    secondary lead-in that follows a quotation; both spans of "from A to B"; before a reference the quoted span, else the words after the
    last lead-in, else the words just before it; a strongly quoted span alone. Null and empty texts have none.
    """
    # written, since every rule reads them: the texts are read once
    found = materialize(marks(texts, key, text), "marks")
    is_span = F.col("kind").isin("strong", "weak") & (F.length("inner") >= LEAST)
    order = Window.partitionBy(key).orderBy("start", F.col("end").desc(), "kind")
    ahead, back = order.rowsBetween(1, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.struct("kind", "start", "end", "inner_start", "inner_end", "inner")
    next_of = lambda kind: F.first(F.when(kind, mark), ignorenulls=True).over(ahead)
    last_of = lambda kind: F.last(F.when(kind, mark), ignorenulls=True).over(back)
    kind_is = lambda kind: F.col("kind") == kind
    seen = found.where("kind not in ('run', 'short', 'led')").select(
        "*", next_of(is_span).alias("span"), next_of(kind_is("lax")).alias("lax"), next_of(kind_is("ref")).alias("next"), next_of(kind_is("strong")).alias("opens"),
        last_of(is_span).alias("span_before"), F.coalesce(F.max(F.when(kind_is("break"), F.col("end"))).over(back), F.lit(0)).alias("broken"),
    )
    gap = lambda mark: F.col(f"{mark}.start") - F.col("end")
    seen = materialize(seen, "seen")
    # a span's own reference: the first after it, with no other quotation opened between
    owned = gap("next").between(-1, REF_GAP) & (F.col("opens").isNull() | (F.col("opens.start") > F.col("next.start")))
    refs_of = lambda df: df.select(key, F.col("start").alias("s_start"), F.when(owned, F.col("next")).alias("own"), F.col("next").alias("any"))
    spans = seen.where(is_span | kind_is("lax"))
    wanted = ["inner_start", "inner_end", "inner", "end"]
    shape = lambda df, s, ref, rank, strategy, high: df.select(key, *[F.col(f"{s}.{c}").alias(c) for c in wanted], ref["inner"].alias("ref"), ref["start"].alias("ref_at"), ref["end"].alias("ref_end"), F.lit(rank).alias("rank"), F.lit(strategy).alias("strategy"), F.lit(high).alias("high"))
    # the span that a lead-in introduces; if none is near, the words in a span without an end
    chosen = F.when(gap("span").between(0, LEAD_GAP), F.col("span")).when(gap("lax").between(0, LEAD_GAP) & (F.length("lax.inner") >= LEAST), F.col("lax"))
    led = seen.where(kind_is("lead")).withColumn("s", chosen).where("s is not null").select(key, "s")
    led = shape(led.join(refs_of(spans).withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & (F.col("s.start") == F.col("s_start"))), "s", F.col("own"), 1, "leadInBraced", True).distinct()
    after = seen.where(kind_is("second") & gap("span").between(0, LEAD_GAP)).select(key, F.col("start").alias("l_start"), F.col("span").alias("s"))
    after = after.join(refs_of(spans).withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & (F.col("s.start") == F.col("s_start"))).where("own is not null or s.inner like '% %'")
    # chains of secondary lead-ins, each near the end of a quotation before it
    reaches = lambda end, ref_end: F.coalesce(ref_end, end).alias("reach")
    ends = led.select(key, F.lit(0).alias("second"), F.lit(None).cast("int").alias("l_start"), reaches(F.col("end"), F.col("ref_end")))
    both = ends.unionByName(after.select(key, F.lit(1).alias("second"), "l_start", reaches(F.col("s.end"), F.col("own.end"))))
    chain = Window.partitionBy(key).orderBy(F.coalesce("l_start", "reach"), "reach")
    before = F.max("reach").over(chain.rowsBetween(Window.unboundedPreceding, -1))
    gaps = both.withColumn("_broken", ((F.col("second") == 0) | before.isNull() | ~(F.col("l_start") - before).between(0, SECONDARY_GAP)).cast("int"))
    linked = gaps.withColumn("_chain", F.sum("_broken").over(chain)).withColumn("_anchored", F.min("second").over(Window.partitionBy(key, "_chain"))).where("second = 1 and _anchored = 0")
    second = shape(after.join(linked.select(key, "l_start").distinct(), [key, "l_start"]), "s", F.col("own"), 2, "secondaryLeadInBraced", True)
    # from A to B: both have the reference after B, unless A has one of its own
    near_a = F.col("span_before.kind").isNotNull() & (F.col("span_before.kind") == "strong") & ((F.col("start") - F.col("span_before.start")) <= RANGE_GAP)
    pairs = seen.where(kind_is("range") & near_a & (F.col("span.kind") == "strong") & gap("span").between(0, RANGE_GAP)).select(key, F.col("start").alias("t_start"), F.col("span_before").alias("a"), F.col("span").alias("b"))
    of_b = refs_of(spans).select(F.col(key).alias("_k"), "s_start", F.col("any"))
    pairs = pairs.join(of_b, (F.col(key) == F.col("_k")) & (F.col("b.start") == F.col("s_start"))).drop("_k", "s_start").withColumn("r", F.when(F.col("any.start") - F.col("b.end") <= RANGE_REF_GAP, F.col("any"))).drop("any")
    own_a = refs_of(spans).select(F.col(key).alias("_k"), "s_start", F.col("any.start").alias("a_ref"))
    pairs = pairs.join(own_a, (F.col(key) == F.col("_k")) & (F.col("a.start") == F.col("s_start"))).where("a_ref is null or a_ref >= t_start")
    ranged = shape(pairs.withColumn("s", F.explode(F.array("a", "b"))), "s", F.col("r"), 3, "rangeConstruct", True)
    # before a reference that no lead-in claimed
    claimed = led.unionByName(second).where("ref_at is not null").select(key, F.col("ref_at").alias("start")).distinct()
    refs = seen.where(kind_is("ref")).select(key, "start", "end", "inner", "broken", "span_before").withColumn("meta", F.col("inner").rlike(r"الآيات\s*\d|(?:[،,][^،,]*){2}"))
    free = refs.where("not meta").join(claimed, [key, "start"], "left_anti")
    this = F.struct("inner", "start", "end")
    backward = lambda df, s, high: shape(df.withColumn("r", this), s, F.col("r"), 4, "explicitRefBackward", high)
    is_near = (F.col("span_before.start") >= F.greatest(F.col("start") - NEAR, F.col("broken"))) & (F.col("span_before.end") <= F.col("start") + 1)
    quoted = free.withColumn("quoted", F.coalesce(is_near, F.lit(False)))
    by_span = backward(quoted.where("quoted"), "span_before", True)
    lead_runs = found.where("kind = 'led'").select(key, F.struct("kind", F.col("at").alias("start"), "end", "inner_start", "inner_end", "inner").alias("led"))
    plain = _last_before(quoted.where("not quoted").select(key, "start", "end", "inner", "broken"), lead_runs, key, "led").withColumn("led", F.when((F.col("led.start") >= F.greatest(F.col("start") - NEAR, F.col("broken"))) & F.length("led.inner").between(SHORT, LONG), F.col("led")))
    by_lead = backward(plain.where("led is not null"), "led", True)
    runs = lambda kind: found.where(F.col("kind") == kind).select(key, F.col("at").alias("start"), F.struct("kind", "end", "inner_start", "inner_end", "inner").alias("run"))
    by_run = plain.where("led is null").join(runs("run"), [key, "start"]).where(F.col("run.inner_start") >= F.col("broken")).where(F.length("run.inner").between(SHORT, LONG))
    by_run = backward(by_run, "run", False)
    short = refs.join(runs("short"), [key, "start"]).where(F.length("run.inner").between(SHORT, SHORT_MOST))
    short = shape(short.withColumn("r", this), "run", F.col("r"), 5, "shortFragmentRef", False)
    none = F.lit(None).cast("struct<inner:string,start:int,end:int>")
    alone = seen.where(kind_is("strong") & F.length("inner").between(SHORT, LONG)).withColumn("s", mark).withColumn("r", none)
    everything = led
    for more in (second, ranged, by_span, by_lead, by_run, short, shape(alone, "s", F.col("r"), 6, "bracedOnly", False)):
        everything = everything.unionByName(more)
    everything = everything.select(key, F.col("inner_start").alias("start"), F.col("inner_end").alias("end"), F.col("inner").alias("text"), "ref", "strategy", "high", "rank")
    # of one span the first rule counts
    everything = everything.groupBy(key, "start", "end").agg(F.min(F.struct("rank", "ref", "strategy", "high", "text")).alias("c")).select(key, "start", "end", "c.*")
    everything = materialize(everything, "spans")
    return without_contained(_without_overlapped(everything, [key]), [key]).drop("rank").select(key, "start", "end", "text", "ref", "strategy", "high")


def _last_before(rows: DataFrame, others: DataFrame, key: str, name: str) -> DataFrame:
    """rows (with start), and the last of others (a struct with start) that begins before each."""
    both = rows.withColumn("_at", F.col("start")).withColumn(name, F.lit(None).cast(others.schema[name].dataType)).unionByName(others.withColumn("_at", F.col(f"{name}.start")), allowMissingColumns=True)
    back = Window.partitionBy(key).orderBy("_at", F.col("start").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("_last", F.last(name, ignorenulls=True).over(back)).where("start is not null").drop("_at", name).withColumnRenamed("_last", name)


def _blocks(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(F.floor(start / 1000), F.floor((end - 1) / 1000)))


def _without_overlapped(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (start, end, rank) that overlap no span of a lower rank, compared by the blocks of characters that they touch."""
    names = [f"_{k}" for k in keys]
    higher = spans.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("rank").alias("_rank"), F.col("start").alias("_start"), F.col("end").alias("_end"), _blocks(F.col("start"), F.col("end")).alias("_b"))
    touched = spans.withColumn("_block", _blocks(F.col("start"), F.col("end")))
    same = F.col("_block") == F.col("_b")
    for k, n in zip(keys, names, strict=True):
        same &= F.col(k) == F.col(n)
    hit = touched.join(higher, same & (F.col("_rank") < F.col("rank")) & (F.col("start") < F.col("_end")) & (F.col("end") > F.col("_start")), "left_semi")
    return spans.join(hit.select(*keys, "start", "end").distinct(), [*keys, "start", "end"], "left_anti")


def without_contained(spans: DataFrame, keys: list[str], part: int = 4096) -> DataFrame:
    """Spans (start, end) that lie in no other of their keys, of equal ones the first.

    The spans of a key are taken in parts by where they begin; what reaches furthest in the parts before is carried over, so
    no task holds all spans of a key.
    """
    names = [f"_{k}" for k in keys]
    placed = spans.withColumn("_part", F.floor(F.col("start") / part))
    reach = placed.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_part").alias("_p")).agg(F.max("end").alias("_end"))
    earlier = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = reach.select(*names, "_p", F.max("_end").over(earlier).alias("_carried"))
    same = F.col("_part").eqNullSafe(F.col("_p"))
    for k, n in zip(keys, names, strict=True):
        same &= F.col(k).eqNullSafe(F.col(n))
    before = Window.partitionBy(*keys, "_part").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    far = placed.join(carried, same, "left").withColumn("_far", F.greatest(F.max("end").over(before), "_carried"))
    return far.where("_far is null or end > _far").select(spans.columns)


def overlapping(spans: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """a and b: pairs of spans of equal keys that overlap, joined by the blocks of 1,000 characters that they touch."""
    blocks = spans.select(*keys, id_, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / 1000), F.floor((F.col("end") - 1) / 1000))).alias("_block"))
    a = blocks.select(*keys, "_block", F.col(id_).alias("a"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    b = blocks.select(*keys, "_block", F.col(id_).alias("b"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    both = a.join(b, [*keys, "_block"]).where("a < b and s1 < e2 and s2 < e1")
    return both.where(F.col("_block") == F.floor(F.greatest("s1", "s2") / 1000)).select(*keys, "a", "b")
