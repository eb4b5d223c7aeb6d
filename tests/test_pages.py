"""Text nodes of pages, against SQL, and the memory that trees of them take."""

import tracemalloc

import duckdb
import pyarrow as pa

import __spark_entry__
from quotelens.plans.queries import html_nodes
from quotelens.sources import elements

ODD = [
    (1, "<h1>cut &amp</h1><p>a &copy 2 &lt b &quot</p>"),
    (2, "<p>&eacute; &#x41;&#66; &#39;&middot;&nbsp;x</p><i>&nbsp;</i>"),
    (3, "<p>&amp;lt; &amp;amp; &&amp;; &AMP; &Lt;</p>"),
    (4, None),
    (5, ""),
    (6, "<p> </p><br><script>x</script>"),
    (7, "a<noscript>b</noscript><svg>c</svg><title>d</title><style>e</style><textarea>f</textarea>"),
    (8, "<p>\u00a0</p><p>\u3000\ufeff</p><p>\x0b</p><p>\x1c</p><p>\t\n\f\r</p>"),
    (9, "<SCRIPT a>x</script >y<!-- <p>z --><p title='a > b'>\U0001f600</p>"),
    (9, "twice"),
    (None, "<p>no number</p>"),
]


def test_html_nodes_is_its_sql_on_odd_pages(spark, tmp_path):
    spark.createDataFrame(ODD, "page_id bigint, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    told = db.execute(f"SELECT page_id, n_nodes, n_chars FROM ({__spark_entry__.oracle_sql()['html_nodes']})").fetchall()
    got = [tuple(r) for r in html_nodes(spark, str(tmp_path)).select("page_id", "n_nodes", "n_chars").collect()]
    assert sorted(got, key=str) == sorted(told, key=str)


def test_trees_of_many_pages_are_held_in_parts():
    page = "<div>" * 6 + "<p>one</p><b>two</b>" * 20 + "</div>" * 6
    batch = pa.RecordBatch.from_pydict({"k": list(range(4000)), "html": [page, None] * 2000})
    n, most = 0, 0
    tracemalloc.start()
    for part in elements.nodes_in_parts(iter([batch])):
        n, most = n + part.num_rows, max(most, part.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the nodes of all pages take 60 MB and more
    assert n == 2000 * 40 and most < 8000 and peak < 12e6


def test_tree_nodes_keep_their_keys(spark):
    rows = spark.createDataFrame([((1, "a"), "<p>x</p>y"), (None, "<i>z</i>"), ((2, "b"), None), ((3, None), "")], "key struct<a:int,b:string>, page string")
    got = [(r.key and tuple(r.key), r.node, r.text, r.start, r.path, r.tags, r.shown) for r in elements.tree_nodes(rows, "key", "page").collect()]
    assert sorted(got, key=str) == sorted([((1, "a"), 0, "x", 0, [1], ["p"], True), ((1, "a"), 1, "y", 2, [], [], True), (None, 0, "z", 0, [1], ["i"], True)], key=str)
    fixed = rows.selectExpr("struct(1 AS n) AS key", "page")  # nothing in it can be null
    assert elements.tree_nodes(fixed, "key", "page").count() == 3
