"""Tool-call linking: calls and results of chats joined by identifier, ordered, validated and written as canonical JSON.

calls: conv, call_id, turn, name, arguments (JSON text). results: conv, call_id, turn, content. schemas: name, field, kind
(a type as schema_of_variant names it, such as STRING or BIGINT), required. A call refers to another one of its chat by
``${call_id}`` in its arguments, and comes after it. Only DataFrame functions are used; the joins are hash joins that
shuffle both sides by identifier, so one large chat is spread by its identifiers. Schemas are broadcast if they are few;
else they are joined by name, and the calls of one tool are dealt out by a part of their identifier's hash as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.llm.store import materialize

#: Rows of schemas up to which they are broadcast; parts that the calls of one tool are dealt to if they aren't.
FEW, PARTS = 50_000, 64
REFERENCE = r"\$\{([^}]+)\}"
KEY = ["conv", "call_id"]


def canonical(json_text: Column) -> Column:
    """JSON text without spaces, keys in order, numbers in one form; null if it isn't JSON or an object repeats a key."""
    return F.to_json(F.try_parse_json(json_text))


def one_each(messages: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The earliest message of each identifier, with repeats (how many more there are); and all other messages, those without identifier too.

    Equal messages are counted, so that many of one identifier meet in no task.
    """
    columns = [c for c in messages.columns if c not in KEY]
    kinds = materialize(messages.groupBy(*messages.columns).agg(F.count("*").alias("n")), name)
    whole = F.struct(F.col("turn"), *[F.col(c) for c in columns if c != "turn"])
    first = kinds.where(F.col("call_id").isNotNull()).groupBy(*KEY).agg(F.min(whole).alias("m"), (F.sum("n") - 1).alias("repeats"))
    first = materialize(first.select(*KEY, *[F.col(f"m.{c}").alias(c) for c in columns], "repeats"), f"first-{name}")
    others = kinds.join(_at(first.where("repeats > 0"), whole.alias("m")), F.expr(_MEETS)).withColumn("n", F.col("n") - F.when(whole.eqNullSafe(F.col("m")), 1).otherwise(0))
    rest = others.select(kinds.columns).unionByName(kinds.where(F.col("call_id").isNull())).where("n > 0")
    return first, rest.select("*", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1)))).alias("_k")).drop("_k", "n")


def _at(keys: DataFrame, *columns: str | Column) -> DataFrame:
    """keys under other names, for a join by :data:`_MEETS`."""
    return keys.select(F.col("conv").alias("_c"), F.col("call_id").alias("_t"), *columns)


_MEETS = "conv <=> _c and call_id = _t"


def ordered(calls: DataFrame) -> DataFrame:
    """conv, call_id, after_turn and step: an order in which every call comes after those it refers to.

    A call stands at its own turn (step 0) or, if it refers to one that stands there or later, one step after that. Most
    calls refer to earlier turns only, and are placed at once, however long their chains; rounds of joins are needed only
    for calls that refer to a later turn, and for those that refer to such calls. Calls in a circle of references, or
    behind one, have no place. References to unknown identifiers and to the call itself don't count.
    """
    refers = calls.select(*KEY, "turn", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), F.lit(1)))).alias("target")).where("target != call_id")
    known = calls.select(F.col("conv").alias("_c"), F.col("call_id").alias("_t"), F.col("turn").alias("target_turn"))
    edges = materialize(refers.join(known.hint("shuffle_hash"), F.expr("conv <=> _c and target = _t")).drop("_c", "_t"), "references")
    # calls that refer to a later turn, and all that refer to those
    late = reached = materialize(edges.where("target_turn >= turn").select(*KEY).distinct(), "late")
    while not late.isEmpty():
        behind = edges.join(_at(late).hint("shuffle_hash"), F.expr("conv <=> _c and target = _t"), "left_semi").select(*KEY).distinct()
        late = materialize(behind.join(_at(reached), F.expr(_MEETS), "left_anti"), "late")
        reached = reached.unionByName(late)
    whole = calls.select(*KEY, "turn")
    placed = whole.join(_at(reached).hint("shuffle_hash"), F.expr(_MEETS), "left_anti").select(*KEY, F.struct(F.col("turn").alias("after_turn"), F.lit(0).alias("step")).alias("place"))
    waiting = materialize(whole.join(_at(reached).hint("shuffle_hash"), F.expr(_MEETS), "left_semi"), "waiting")
    open_edges = edges.join(_at(waiting), F.expr(_MEETS), "left_semi")
    while not waiting.isEmpty():
        # a call is ready when all its references are placed
        met = open_edges.join(_at(placed, "place").hint("shuffle_hash"), F.expr("conv <=> _c and target = _t"), "left").groupBy(*KEY).agg(F.max(F.struct(F.col("place.after_turn"), (F.col("place.step") + 1).alias("step"))).alias("after"), F.bool_and(F.col("_t").isNotNull()).alias("all"))
        ready = waiting.join(_at(met.where("all"), "after").hint("shuffle_hash"), F.expr(_MEETS))
        ready = materialize(ready.select(*KEY, F.greatest(F.struct(F.col("turn").alias("after_turn"), F.lit(0).alias("step")), F.col("after")).alias("place")), "ready")
        if ready.isEmpty():
            break
        placed = placed.unionByName(ready)
        waiting = materialize(waiting.join(_at(ready), F.expr(_MEETS), "left_anti"), "waiting")
    return placed.select(*KEY, "place.after_turn", "place.step")


def violations(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv, call_id and errors, sorted, of calls whose arguments break their tool's schema."""
    few = schemas.limit(FEW + 1).count() <= FEW
    part = F.lit(0) if few else F.pmod(F.xxhash64(*KEY), F.lit(PARTS)).cast("int")
    parsed = calls.select(*KEY, "name", part.alias("part"), F.try_variant_get(F.try_parse_json("arguments"), "$", "map<string,variant>").alias("given"))
    dealt = (lambda df: F.broadcast(df.withColumn("part", F.lit(0)))) if few else (lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).hint("shuffle_hash"))
    by_name = ["name", "part"]
    tools = dealt(schemas.select("name").distinct().withColumn("known", F.lit(True)))
    whole = parsed.join(tools, by_name, "left").select(*KEY, F.when(F.col("given").isNull(), F.lit("arguments: not an object")).when(F.col("known").isNull(), F.lit("name: no such tool")).alias("error"))
    of_tool = parsed.where("given is not null").join(tools, by_name)
    fields = of_tool.select(*KEY, *by_name, F.explode("given").alias("field", "value")).withColumn("is", F.schema_of_variant("value")).drop("value")
    wrong = fields.join(dealt(schemas.select("name", "field", "kind")), [*by_name, "field"], "left").where("kind is null or is != kind")
    wrong = wrong.select(*KEY, F.concat("field", F.when(F.col("kind").isNull(), F.lit(": not in the schema")).otherwise(F.concat(F.lit(": "), "is", F.lit(" for "), "kind"))).alias("error"))
    needed = of_tool.select(*KEY, *by_name, F.map_keys("given").alias("has")).join(dealt(schemas.where("required").select("name", "field")), by_name)
    lacking = needed.where(~F.array_contains("has", F.col("field"))).select(*KEY, F.concat("field", F.lit(": missing")).alias("error"))
    found = whole.where("error is not null").unionByName(wrong).unionByName(lacking)
    return found.groupBy(*KEY).agg(F.array_sort(F.collect_set("error")).alias("errors"))


def _text_as_json(text: Column) -> Column:
    """A JSON string."""
    return F.parse_json(F.regexp_extract(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1))


def linked_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row for each message but linked results: conv, call_id, after_turn, step, turn, name, status, errors and json.

    status: linked, no_result, no_call, early (the result comes before its call) or circular, one row for each identifier. Of messages with equal
    identifiers the first counts; the others have rows of their own, with status repeated_call or repeated_result, and so
    have messages without an identifier: call_without_id, result_without_id. Repeats and broken schemas are listed in
    errors. json holds arguments, call_id, name and result (those that there are) in canonical form; arguments that aren't JSON are text.
    Ordering by after_turn, step and call_id within a chat is a topological order of the linked calls.
    A null conv is a chat like others. Empty tables give an empty one. Other columns are not read.
    """
    calls, more_calls = one_each(calls.select(*KEY, "turn", "name", "arguments"), "calls")
    answers, more_answers = one_each(results.select(*KEY, "turn", "content"), "results")
    answers = answers.select(F.col("conv").alias("rc"), F.col("call_id").alias("rt"), F.col("turn").alias("result_turn"), "content", F.col("repeats").alias("result_repeats"))
    both = calls.withColumn("called", F.lit(True)).join(answers.hint("shuffle_hash"), F.col("conv").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("rt")), "full")
    both = both.withColumn("conv", F.when(F.col("called"), F.col("conv")).otherwise(F.col("rc"))).withColumn("call_id", F.coalesce("call_id", "rt"))
    order, broken = ordered(calls), violations(calls, schemas)
    both = both.join(_at(order, "after_turn", "step").hint("shuffle_hash"), F.expr(_MEETS), "left").drop("_c", "_t").join(_at(broken, F.col("errors").alias("broken")).hint("shuffle_hash"), F.expr(_MEETS), "left")
    status = F.when(F.col("called").isNull(), "no_call").when(F.col("step").isNull(), "circular").when(F.col("rt").isNull(), "no_result").when(F.col("result_turn") <= F.col("turn"), "early").otherwise("linked")
    more = F.filter(F.array(F.when(F.col("repeats") > 0, F.lit("call_id: repeated call")), F.when(F.col("result_repeats") > 0, F.lit("call_id: repeated result"))), lambda e: e.isNotNull())
    arguments = lambda called: F.when(called, F.coalesce(F.try_parse_json("arguments"), _text_as_json(F.col("arguments"))))
    json = lambda given, *columns: F.to_json(F.struct(*([given.alias("arguments")] if given is not None else []), *columns))
    none = F.array().cast("array<string>")
    linked = both.select(
        "conv",
        "call_id",
        F.when(F.col("called"), F.col("after_turn")).alias("after_turn"),
        F.when(F.col("called"), F.col("step")).alias("step"),
        F.coalesce("turn", "result_turn").alias("turn"),
        "name",
        status.alias("status"),
        F.concat(F.coalesce("broken", none), more).alias("errors"),
        json(arguments(F.col("called")), F.col("call_id"), F.col("name"), F.col("content").alias("result")).alias("json"),
    )

    def alone(messages: DataFrame, kind: str, name: Column, text: Column) -> DataFrame:
        status = F.when(F.col("call_id").isNull(), f"{kind}_without_id").otherwise(f"repeated_{kind}")
        return messages.select("conv", "call_id", F.lit(None).cast(kinds["after_turn"]).alias("after_turn"), F.lit(None).cast("int").alias("step"), "turn", name.cast("string").alias("name"), status.alias("status"), none.alias("errors"), text.alias("json"))

    kinds = dict(linked.dtypes)
    said = alone(more_calls, "call", F.col("name"), json(arguments(F.lit(True)), F.col("call_id"), F.col("name")))
    return linked.unionByName(said).unionByName(alone(more_answers, "result", F.lit(None), json(None, F.col("call_id"), F.col("content").alias("result"))))


def plain_messages(messages: DataFrame) -> DataFrame:
    """conv, turn, role, content of messages that are neither calls nor results, as rows like those of linked_calls."""
    empty = lambda kind: F.lit(None).cast(kind)
    json = F.to_json(F.struct("content", "role"))
    return messages.select("conv", empty("string").alias("call_id"), empty(dict(messages.dtypes)["turn"]).alias("after_turn"), empty("int").alias("step"), "turn", F.col("role").alias("name"), F.lit("message").alias("status"), F.array().cast("array<string>").alias("errors"), json.alias("json"))


def from_conversations(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results, and what is neither (conv, turn, role, content), of a table of conv_id, turn, role, text.

    The table holds no tool calls, so its turns are read as such, with the faults that calls have. A user's turn is a call, named by
    chat and turn, of the tool ``reply`` with its text, its turn, and a reference to the user's turn before. Of every twelve (by chat plus turn)
    some differ: 1 gives the turn as text and no reference, 2 leaves out the text, 3 has a field too many, 4, 5, 9 and 11 refer to the
    user's turn that follows (which may refer back, or on), 6 is of an unknown tool, 7 has arguments that aren't
    JSON, and 8 comes twice. An assistant's turn is the result for the turn before it; of every nine, 0 names no call, 1 comes twice and 2 has
    the turn before its call's. Other roles, and messages without a turn, are neither.
    """
    spoken = messages.select(F.col("conv_id").alias("conv"), "turn", "role", F.col("text").alias("content"))
    name = lambda away: F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), F.lit("")), (F.col("turn") + away).cast("string"))
    reference = lambda away: F.concat(F.lit("${"), name(away), F.lit("}"))
    said = lambda role: spoken.where(f"role = '{role}' and turn is not null")
    k = F.coalesce(F.pmod(F.col("conv") + F.col("turn"), F.lit(12)), F.lit(0))
    after = F.when(k.isin(4, 5, 9, 11), reference(2)).when((F.col("turn") >= 2) & (k != 1), reference(-2))
    fields = {"text": F.when(k != 2, F.col("content")), "after": after, "note": F.when(k == 3, F.lit("more"))}
    as_text = F.to_json(F.struct(F.col("turn").cast("string").alias("turn"), *[c.alias(n) for n, c in fields.items()]))
    arguments = F.when(k == 7, F.lit('{"text": ')).when(k == 1, as_text).otherwise(F.to_json(F.struct("turn", *[c.alias(n) for n, c in fields.items()])))
    times = lambda often: F.explode(F.array_repeat(F.lit(0), F.when(often, 2).otherwise(1)))
    calls = said("user").select("conv", name(0).alias("call_id"), "turn", F.when(k == 6, "lookup").otherwise("reply").alias("name"), arguments.alias("arguments"), times(k == 8)).drop("col")
    r = F.coalesce(F.pmod(F.col("conv") + F.col("turn"), F.lit(9)), F.lit(3))
    answered = F.when(r == 0, F.concat(name(-1), F.lit("?"))).otherwise(name(-1))
    results = said("assistant").select("conv", answered.alias("call_id"), (F.col("turn") - F.when(r == 2, 2).otherwise(0)).alias("turn"), "content", times(r == 1)).drop("col")
    return calls, results, spoken.where("role is null or turn is null or role not in ('user', 'assistant')")
