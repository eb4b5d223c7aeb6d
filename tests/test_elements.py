"""Trees of pages, contexts of nodes, and references found in spite of invisible marks."""

from pyspark.sql import functions as F

from quotelens.operators import ref_marks
from quotelens.sources import elements


def shown(page):
    return [n["text"] for n in elements.tree_of(page) if n["shown"]]


def test_nodes_of_a_tree():
    assert shown('<p title="a > b">x<img alt=\'>\'>y</p>') == ["x", "y"]
    assert shown("<div>a<svg><g><text>no</text></g></svg>b<noscript><p>no</p></noscript>c</div>") == ["a", "b", "c"]
    assert shown("<script>if (a < b) '</p>'</script>a<!-- <p>no --><style>p{}</style>b<textarea><p>no</textarea>") == ["a", "b"]
    assert shown("<div contenteditable>no <b>no</b></div><div contenteditable='false'>a</div><div contenteditable=true>no</div><p data-contenteditable>b</p>"[:117]) == ["a"]
    assert shown("a < b &lt;c&gt; <b>d</i></b>e") == ["a < b <c> ", "d", "e"]
    assert shown("") == [] and shown("<p") == [] and shown("<div>" * 3000 + "x") == ["x"]
    nodes = elements.tree_of("<body><div><p>a</p>bb</div> <i>c</i></body>")
    assert [(n["text"], n["start"], n["path"], n["tags"]) for n in nodes] == [("a", 0, [3, 2, 1], ["p", "div", "body"]), ("bb", 2, [2, 1], ["div", "body"]), ("c", 5, [4, 1], ["i", "body"])]


def test_contexts(spark):
    page = "<body><div id=a><p><q><b>quote</b></q></p><span>author</span></div><div><i>x</i><u>quote</u></div><div>" + "<p>" * 9 + "deep" + "</p>" * 9 + "other text</div></body>"
    rows = spark.createDataFrame([(1, page), (None, "<p>one</p><p>two three</p>"), (3, None), (4, "<div>" + "<p>" + "word " * 60 + "</p><b>quote</b></div>")], "page_id int, html string")
    nodes = elements.tree_nodes(rows)
    got = {(r.page_id, r.node): r.context for r in elements.contexts(nodes).collect()}
    assert got[1, 0] == "· author" and got[1, 1] == "quote ·"
    # one letter is no other text, so the whole body is the context
    assert got[1, 2] == "· quote" and got[1, 3].startswith("quoteauthorx")
    assert (1, 4) not in got and got[1, 5] == "deep ·"  # nothing within eight steps; the element itself
    assert not any(k[0] in (None, 3) for k in got)
    assert got[4, 1] == ("word " * 60)[:100] + " … " + ("word " * 60 + "·")[-100:]


def test_ref_marks(spark):
    rlm, zw = chr(0x200F), chr(0x200B)
    pages = {1: "{quoted} (A:1) and (A:1)", 2: f"{{quoted}} {rlm}({zw}A{rlm}:1){rlm} x", 3: "{quoted} " + "y" * 400 + "(A:1)", 4: "(A:1) {quoted}", 5: "{quoted} " + "y" * 399 + "(A:1)"}
    found = spark.createDataFrame([(k, 8, "(A:1)") for k in pages] + [(1, 8, None), (2, 8, f"(A{zw}:1)"), (1, 8, "")], "page_id int, end int, ref string")
    texts = spark.createDataFrame(list(pages.items()), "page_id int, text string")
    got = [(r.page_id, r.ref, tuple(r.mark) if r.mark else None) for r in ref_marks.ref_marks(found, texts).collect()]
    spans = {(k, ref): m for k, ref, m in got}
    assert spans[1, "(A:1)"] == (9, 14) and spans[3, "(A:1)"] is None and spans[4, "(A:1)"] is None and spans[1, None] is None and spans[1, ""] is None
    assert spans[5, "(A:1)"] == (408, 413)
    a, b = spans[2, "(A:1)"]
    assert pages[2][a:b] == f"({zw}A{rlm}:1)" and spans[2, f"(A{zw}:1)"] == (a, b)
