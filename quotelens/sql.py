"""The library in SQL: functions and table functions for a session, so that a query needs no Python.

    register(spark)
    SELECT p.page_id, n.node, latin_form(n.text) FROM pages p, LATERAL page_nodes(p.html) n WHERE n.shown
    SELECT q.* FROM texts t, LATERAL quotation_marks(t.text) q

Functions are SQL expressions that Spark puts into the query's plan; the table functions run in workers, one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quotelens.operators.extract import marks_of
from quotelens.sources.elements import NODE, tree_of

#: name(arguments) -> type: expression. letters: those that spelling may drop, add or change.
FUNCTIONS = {
    "latin_form(t STRING) RETURNS STRING": r"trim(regexp_replace(lower(t), '[^\\p{L}\\p{N}]+', ' '))",
    "words_of(form STRING) RETURNS ARRAY<STRING>": "filter(split(form, ' '), w -> w <> '')",
    "skeleton(form STRING, letters STRING) RETURNS STRING": "translate(form, letters, '')",
    "same_spelling(a STRING, b STRING, letters STRING) RETURNS BOOLEAN": "a = b OR (translate(a, letters, '') = translate(b, letters, '') AND abs(length(a) - length(b)) <= 2 AND levenshtein(a, b) <= greatest(1, abs(length(a) - length(b))))",
    "holds_run(form STRING, run STRING) RETURNS BOOLEAN": "contains(concat(' ', form, ' '), concat(' ', run, ' '))",
    "reference_text(name STRING, first INT, last INT) RETURNS STRING": "concat('(', name, ':', first, CASE WHEN last > first THEN concat('-', last) ELSE '' END, ')')",
}

_MARK = StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()).add("inner", StringType())


def _one_text(given: AnalyzeArgument, schema: StructType) -> AnalyzeResult:
    if given.isTable or not isinstance(given.dataType, StringType):
        raise ValueError(f"a text is asked for, not {given.dataType.simpleString() if given.dataType else 'a table'}")
    return AnalyzeResult(schema)


@udtf
class PageNodes:
    """The text nodes of a page; a null page has none."""

    @staticmethod
    def analyze(html: AnalyzeArgument) -> AnalyzeResult:
        return _one_text(html, NODE)

    def eval(self, html: str | None) -> Iterator[tuple]:
        for i, n in enumerate(tree_of(html or "")):
            yield i, n["text"], n["start"], n["path"], n["tags"], n["shown"]


@udtf
class QuotationMarks:
    """What stands out in a text as a part of quotations: lead-ins, quoted spans, references, and where words end before them."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return _one_text(text, _MARK)

    def eval(self, text: str | None) -> Iterator[tuple]:
        for kind, start, end, inner, inner_end, _ in marks_of(text or ""):
            yield kind, start, end, text[inner:inner_end]


def register(spark: SparkSession) -> None:
    """Make the functions known to a session, under the names of FUNCTIONS, and page_nodes and quotation_marks."""
    for head, body in FUNCTIONS.items():
        name, rest = head.split("(", 1)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({rest} RETURN {body}")
    spark.udtf.register("page_nodes", PageNodes)
    spark.udtf.register("quotation_marks", QuotationMarks)
