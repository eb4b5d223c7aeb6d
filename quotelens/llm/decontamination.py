"""Benchmark decontamination by canonical templates.

Texts are cut into words of letters and into numbers; all else only separates. A number, in digits or as a word, becomes the
placeholder ``#n``, a unit after a number ``#u``, and a name, that is any capitalised word (not in capitals throughout), ``#p``;
other words are lower-cased. The first word of a sentence counts as a name too, since it can be one. Windows of the
canonical words are joined by hash, so a question with other numbers and names has the windows of the original. Within a window a placeholder carries the place of its value's first use there, so
two uses of one value match only two uses of one value. Matched windows of a document and an item are then gathered by
their distance along both texts, and an alignment in which a value stands for two values (of either side) is dropped.
A document is contaminated by an item if consistent alignments cover at least ``cover`` of the item's windows.

A window with few literal words is weak: it fits many texts. It counts if its values are the item's too, or if its
alignment has enough literal words, or values that are the same: ``literal`` in all, or ``few`` where all the item's windows are aligned.
A window without any literal word is joined by its values.

Templates alone, without values, find the documents to look at; values are compared in those. Spark broadcasts the keys of
these documents if their written table is small, else it shuffles.

Only DataFrame functions are used. The item windows are broadcast if there are few enough of them, else they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.llm.store import materialize

#: Units that follow a number (fixed list).
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds ounce ounces oz ton tons "
    "ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "mph kmh cent cents dollar dollars euro euros usd eur gbp percent degree degrees celsius fahrenheit watt watts volt volts joule joules newton newtons hz"
).split()


#: Numbers as words (fixed list).
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred hundreds thousand thousands million millions billion dozen"
).split()


@dataclass(frozen=True)
class Templates:
    """window: canonical words; literal: of a window that must not be placeholders, or it is weak; few: literal words of an item that is aligned as a whole; broadcast: windows of all items up to which they are broadcast."""

    window: int = 8
    literal: int = 5
    few: int = 3
    cover: float = 0.5
    broadcast: int = 200_000


def _template(pair: Column) -> Column:
    """What stands for a word (fields word, lower and before, the lower-cased word before it)."""
    word, lower, before = pair["word"], pair["lower"], pair["before"]
    # words that begin with an ASCII letter lie between these; only others can begin with a digit
    is_number = lambda w: ((w < "A") | (w > "{")) & w.rlike(r"^\p{Nd}") | w.isin(NUMBERS)
    return (
        F.when(is_number(lower), F.lit("#n"))
        .when(lower.isin(UNITS) & is_number(before), F.lit("#u"))
        .when((word != lower) & word.rlike(r"^\p{Lu}\p{Ll}"), F.lit("#p"))
        .otherwise(lower)
    )


def _paired(docs: DataFrame, text: str) -> DataFrame:
    """Adds _pairs: the words of a text as :func:`_template` takes them."""
    raw = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\p{L}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*|\p{Nd}+(?:[.,]\p{Nd}+)*"), F.lit(0))
    # arrays that a lambda needs are zipped with its own, since a column that it captures may be computed anew for each element
    before = F.concat(F.array(F.lit("")), F.slice("_lower", 1, F.greatest(F.size("_lower") - 1, F.lit(0))))
    rows = docs.withColumn("_raw", raw).withColumn("_lower", F.transform("_raw", lambda w: F.lower(w)))
    return rows.withColumn("_pairs", F.when(F.size("_raw") > 0, F.arrays_zip(F.col("_raw").alias("word"), F.col("_lower").alias("lower"), before.alias("before")))).drop("_raw", "_lower")


def canonical_words(docs: DataFrame, text: str) -> DataFrame:
    """Adds words: array of (t, v), t the canonical word and v the value that a placeholder replaces."""
    kinds = F.transform("_pairs", lambda x: F.struct(_template(x).alias("t"), x["lower"].alias("v")))
    words = F.transform(kinds, lambda x: F.struct(x["t"].alias("t"), F.when(x["t"].startswith("#"), x["v"]).alias("v")))
    return _paired(docs, text).withColumn("words", F.coalesce(words, F.array().cast("array<struct<t:string,v:string>>"))).drop("_pairs")


def templates_of(docs: DataFrame, keys: list[str], text: str, sizes: list[int]) -> DataFrame:
    """keys, n and template of every window of each size: the hash of its canonical words, whatever their values. It finds the documents to look at."""
    coded = _paired(docs, text).select(*keys, F.transform("_pairs", lambda x: F.xxhash64(_template(x))).alias("_codes"))
    each = []
    for n in sizes:
        shifted = [F.slice("_codes", k + 1, F.greatest(F.size("_codes") - n + 1, F.lit(0))).alias(f"c{k}") for k in range(n)]
        each.append(F.transform(F.arrays_zip(*shifted), lambda x: F.struct(F.lit(n).alias("n"), F.xxhash64(*[x[f"c{k}"] for k in range(n)]).alias("template"))))  # noqa: B023
    # the outer form: the other lets Spark test the array's size first, for which it would compute all of it again
    return coded.select(*keys, F.explode_outer(F.concat(*each)).alias("w")).where("w is not null").select(*keys, "w.n", "w.template")


def windows(docs: DataFrame, keys: list[str], sizes: list[int]) -> DataFrame:
    """keys, and n, place, hash and slots of every window of each size; slots: the values of its placeholders, null if none.

    In the hash a placeholder carries the distance to the last use of its value within the window; a window of placeholders
    only has the hash of its values. A window is a row of its own from here on, so that rows don't carry the text's words.
    """
    count = F.size("words")
    most = max(sizes)
    values = F.transform("words", lambda x: x["v"])
    back = [F.concat(F.array_repeat(F.lit(None).cast("string"), k), F.slice("_values", 1, F.greatest(count - k, F.lit(0)))).alias(f"v{k}") for k in range(1, most)]

    def distance(x: Column) -> Column:
        found = F.lit(most)
        for k in range(most - 1, 0, -1):
            found = F.when(x["v"] == x[f"v{k}"], k).otherwise(found)
        return F.when(x["v"].isNull(), most).otherwise(found)

    coded = docs.withColumn("_values", values).withColumn("_plain", F.transform("words", lambda x: F.xxhash64(x["t"])))
    some = F.exists("_values", lambda v: v.isNotNull())
    apart = F.transform(F.arrays_zip(F.col("_values").alias("v"), *back), distance) if most > 1 else F.transform("_values", lambda v: F.lit(most))
    coded = coded.withColumn("_apart", F.when(some, apart))
    kind = "array<struct<hash:bigint,slots:array<string>>>"
    found = None
    for n in sizes:
        shifted = lambda c, k: F.slice(c, k + 1, F.greatest(count - n + 1, F.lit(0))).alias(f"{c}{k}")  # noqa: E731, B023
        each = lambda x, c: [x[f"{c}{k}"] for k in range(n)]  # noqa: E731, B023
        plain = F.transform(F.arrays_zip(*[shifted("_plain", k) for k in range(n)]), lambda x: F.struct(F.xxhash64(*each(x, "_plain")).alias("hash"), F.lit(None).cast("array<string>").alias("slots")))  # noqa: B023
        code = lambda x, k: F.when(x[f"_apart{k}"] <= k, F.xxhash64(x[f"_plain{k}"], x[f"_apart{k}"])).otherwise(x[f"_plain{k}"])
        slots = lambda x: F.when(F.coalesce(*each(x, "_values")).isNotNull(), F.array_compact(F.array(*each(x, "_values"))))
        zipped = F.arrays_zip(*[shifted(c, k) for k in range(n) for c in ("_plain", "_apart", "_values")])
        with_values = F.transform(zipped, lambda x: F.struct(F.xxhash64(*[code(x, k) for k in range(n)]).alias("hash"), slots(x).alias("slots")))  # noqa: B023
        hashes = F.when(count < n, F.array().cast(kind)).when(F.col("_apart").isNull(), plain.cast(kind)).otherwise(with_values.cast(kind))
        # the outer form: the other lets Spark test the array's size first, for which it would compute all of it again
        rows = coded.select(*keys, hashes.alias("_windows")).select(*keys, F.posexplode_outer("_windows").alias("place", "_w"))
        rows = rows.select(*keys, F.lit(n).alias("n"), "place", F.col("_w.hash").alias("hash"), F.col("_w.slots").alias("slots"))
        rows = rows.withColumn("hash", F.when(F.size("slots") == n, F.xxhash64(F.lit("values"), "slots")).otherwise(F.col("hash"))).where(F.col("hash").isNotNull())
        found = rows if found is None else found.unionByName(rows)
    return found


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", templates: Templates = Templates()) -> DataFrame:
    """key, item, n_windows (of the item, that were found), item_windows and first_word for each document and item that it contains.

    Other columns of both tables are not read. An item of fewer words than a window is one window; one without text is never
    found. The share is taken of all windows of an item, of those with a literal word, and of those that aren't weak, and
    one that reaches cover is enough. Null and empty documents contain nothing. Rows are judged text by text; of rows of equal
    keys, null ones too, the one that has most of an item counts.
    """
    n = templates.window
    texts = items.select(F.col(item).alias("_item"), F.col(item_text).alias("_text"))
    of_items = materialize(canonical_words(texts, "_text").select("_item", "words"), "items").where(F.size("words") > 0)
    sizes = sorted(r[0] for r in of_items.select(F.least(F.size("words"), F.lit(n))).distinct().collect())  # n values at most
    if not sizes:
        sizes = [n]
    of_size = lambda s: of_items.where(F.size("words") == s if s < n else F.size("words") >= n)
    wanted = reduce(DataFrame.unionByName, [windows(of_size(s), ["_item"], [s]) for s in sizes])
    literals = F.col("n") - F.coalesce(F.array_size("slots"), F.lit(0))
    wanted = wanted.select("_item", "n", "hash", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"), (literals > 0).alias("worded"), (literals >= F.least(F.col("n"), F.lit(templates.literal))).alias("strong"))
    wanted = materialize(wanted, "item-windows")
    places = F.filter(F.transform("words", lambda x, i: F.when(x["v"].isNull(), i)), lambda i: i.isNotNull())
    counts = wanted.groupBy(F.col("_item").alias("_i")).agg(F.count("*").alias("item_windows"), F.count_if("worded").alias("item_worded"), F.count_if("strong").alias("item_strong"))
    facts = counts.join(of_items.groupBy(F.col("_item").alias("_j")).agg(F.array_distinct(F.flatten(F.collect_set(places))).alias("literals")), F.col("_i").eqNullSafe(F.col("_j"))).drop("_j")
    few = wanted.limit(templates.broadcast + 1).count() <= templates.broadcast
    side = lambda df: F.broadcast(df) if few else df
    # most documents have no window like an item's; those that do are few, and only of them values are compared
    known = materialize(templates_of(texts, [], "_text", sizes).distinct(), "item-templates")
    # windows of different texts are never put together, whatever their keys
    asked = docs.where(F.col(text).isNotNull()).select(F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("text")).alias("_doc"), F.col(text).alias("_text"))
    touched = materialize(templates_of(asked, ["_doc"], "_text", sizes).join(side(known), ["n", "template"], "left_semi").select(F.col("_doc").alias("_d")).distinct(), "touched")
    asked = asked.join(touched, F.col("_doc").eqNullSafe(F.col("_d")), "left_semi")
    held = windows(canonical_words(asked, "_text").select("_doc", "words"), ["_doc"], sizes)
    matched = held.join(side(wanted), ["n", "hash"]).withColumn("shift", F.col("place") - F.col("item_place"))
    alignment = ["_doc", "_item", "n", "shift"]
    none = F.array().cast("array<string>")
    slots, item_slots = F.coalesce("slots", none), F.coalesce("item_slots", none)
    matched = matched.select(*alignment, "item_place", "worded", "strong", (~F.col("strong") & (slots == item_slots)).alias("same"), F.arrays_zip(slots.alias("slots"), item_slots.alias("item_slots")).alias("pairs"))
    held_by = lambda c: F.collect_set(F.when(F.col(c), F.col("item_place"))).alias(f"{c}_places")
    values = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    found = matched.groupBy(*alignment).agg(F.collect_set("item_place").alias("places"), held_by("worded"), held_by("strong"), held_by("same"), values(F.col("pairs")).alias("pairs"), values(F.when(F.col("strong"), F.col("pairs"))).alias("strong_pairs"))
    one_to_one = lambda c, side: F.size(F.array_distinct(F.transform(c, lambda p: p[side]))) == F.size(c)
    consistent = lambda c: one_to_one(c, "slots") & one_to_one(c, "item_slots")
    found = found.join(side(facts), F.col("_item").eqNullSafe(F.col("_i"))).drop("_i")
    aligned = F.size(F.array_intersect("literals", F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("n") - 1)))))
    aligned = aligned + F.size(F.filter("pairs", lambda p: p["slots"] == p["item_slots"]))  # a value that stands for itself
    whole = (F.size("worded_places") == F.col("item_worded")) & (aligned >= templates.few)
    enough = consistent("pairs") & ((aligned >= templates.literal) | whole)
    nowhere = F.array().cast("array<int>")
    found = found.withColumn("counted", F.when(enough, F.col("places")).otherwise(F.array_union(F.when(consistent("strong_pairs"), F.col("strong_places")).otherwise(nowhere), "same_places"))).where(F.size("counted") > 0)
    number = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    facts_of = [F.first(c).alias(c) for c in ("item_windows", "item_worded", "item_strong")]
    found = found.groupBy("_doc", "_item").agg(number("counted").alias("n_windows"), number(F.array_intersect("counted", "worded_places")).alias("n_worded"), number(F.array_intersect("counted", "strong_places")).alias("n_strong"), F.min(F.col("shift") + F.array_min("counted")).cast("long").alias("first_word"), *facts_of)
    reached = [(F.col(f"n_{c}") > 0) & (F.col(f"n_{c}") >= F.lit(templates.cover) * F.col(f"item_{c}")) for c in ("windows", "worded", "strong")]
    found = found.where(reduce(Column.__or__, reached)).groupBy(F.col("_doc.key").alias("_key"), "_item").agg(F.max(F.struct("n_windows", "item_windows", (-F.col("first_word")).alias("before"))).alias("m"))
    return found.select(F.col("_key").alias(key), F.col("_item").alias(item), "m.n_windows", "m.item_windows", (-F.col("m.before")).alias("first_word"))
