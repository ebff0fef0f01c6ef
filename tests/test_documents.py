"""The block reader, names, links and edits on small texts with known readings."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import edits, inlines
from quire.functions.blocks import Refused
from quire.functions.naming import NameReader, document, leaf_key, rendered_slugs, slug
from quire.operators import documents


def kinds(text):
    return [(b.type, b.start, b.end) for b in document(text).root.children]


def code(text, **kw):
    try:
        document(text, **kw)
    except Refused as refused:
        return refused.code


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []),
        ("a\nb\n\n\nc", [("paragraph", 0, 1), ("paragraph", 4, 4)]),
        ("# h\ntext\n***\n", [("heading", 0, 0), ("paragraph", 1, 1), ("thematic_break", 2, 2)]),
        ("- a\n- b\n* c\n\n  d\n", [("list", 0, 1), ("list", 2, 4)]),
        ("1. a\n2) b\n", [("list", 0, 0), ("list", 1, 1)]),
        ("p\n2. no\n", [("paragraph", 0, 1)]),
        ("> a\nlazy\n\n> b\n", [("block_quote", 0, 1), ("block_quote", 3, 3)]),
        ("```\n\n# x\n", [("code_block", 0, 2)]),
        ("---\nk: v\n---\ntext\n", [("paragraph", 3, 3)]),
        ("| a | b |\n|--|:-:|\n| 1 |\n", [("table", 0, 2)]),
        ("a\n|---|---|\n", [("paragraph", 0, 1)]),
        ("-\n\n  no item text\n".replace("  no", "no"), [("list", 0, 0), ("paragraph", 2, 2)]),
    ],
)
def test_blocks(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("```\n<<<<<<< x\n```\n", "conflict-marker"),
        ("<<<<<< x\n", None),
        ("=======\n", "conflict-marker"),
        ("a\n===\n", "setext-heading"),
        ("a\n\n---\n", None),
        ("    code\n", "indented-code"),
        ("a\n    lazy\n", None),
        ("[a]: /url 'title'\n", "link-reference-definition"),
        ("[a]: /url trailing\n", None),
        ("text\n[a]: /url\n", None),
        ("<div>\n", "raw-html"),
        ("text\n<b>\n", None),
        ("<!-- comment -->\n", "raw-html"),
        ("x\n| a |\n|---|\n", "table-not-blank-above"),
        ("# x\n| a |\n|---|\n", "table-not-blank-above"),
        ("| a |\n|---|\nbelow\n", "table-not-blank-below"),
        ("| a |\n|---|\n- b | c\n", "table-not-blank-below"),
        ("a\n:-:\n", "ambiguous-table"),
        ("a \\| b\n|---|\n", "ambiguous-table"),
        ("<!-- #a -->\nx\n\n> <!-- #a -->\n> y\n", "duplicate-name"),
        ("<!-- #a:begin -->\nx\n", "unpaired-region"),
        ("<!-- #a -->\n", "dangling-marker"),
        ("<!-- #a:begin -->\n<!-- #a:end -->\n", "dangling-marker"),
        ("# Setup\n\n<!-- #setup -->\nother\n", "name-shadows-slug"),
        ("<!-- #setup -->\n# Setup\n", None),
        ("[x](#gone)\n", "dangling-link"),
        ("`[x](#gone)`\n", None),
        ("# *A* [B](c) {#d}\n\n[x](#a-b) [y](#d) [z](#top)\n", None),
        ("# A\n\n# A\n\n[x](#a-1)\n", None),
        ("# A\n\n[x](#a-1)\n", "dangling-link"),
    ],
)
def test_refusals(text, want):
    assert code(text) == want


def test_annotations_may_link_anywhere():
    assert code("[x](#gone)\n", check_links=False) is None


def test_contents():
    doc = document("- a\n  b  \n\n  ~~~ info\n  x\n    y\n  ~~~\n\n| p | q |\n|---|---|\n| \\| |\n| 1 | 2 | 3 |\n")
    assert [(n.path, n.content) for n in doc.nodes if n.type in ("paragraph", "code_block")] == [((0, 0, 0), "a\nb"), ((0, 0, 1), "x\n  y\n")]
    table = next(n for n in doc.nodes if n.type == "table")
    assert table.rows == [["p", "q"], ["|", ""], ["1", "2"]] and leaf_key(table) == ("table", "p | q\n\\| | \n1 | 2")


def test_regions_and_resolution():
    doc = document("<!-- #r:begin -->\none\n\n<!-- #m -->\ntwo\n<!-- #r:end -->\n\n# Head\n\n# Twice\n\n# Twice\n")
    assert [n.path for n in doc.names["r"][1]] == [(1,), (2,), (3,)] and doc.resolve("m")[1][0].content == "two"
    assert doc.resolve("head")[1][0].path == (5,) and doc.resolve("twice") == "#REF!(twice)"


def test_slugs():
    assert slug("Über 2² C#x‿") == "über-2-cx‿" and slug("a*b") is None and slug("!!!") is None
    assert rendered_slugs("<b>A</b> [b](c) _d_") == {"a-b-_d_", "a-b-d"}


def test_links():
    found = inlines.scan("![i](x) [a [b](c) d](e) <http://q> <a id='k'> `[n](m)` [t](<u v> 'w')")
    assert [(x.image, x.destination, x.title) for x in found.links] == [(True, "x", None), (False, "c", None), (False, "u v", "'w'")]
    assert found.ids == ["k"] and len(found.tags) == 1
    assert inlines.transclusion('[t](a.md#n "transclude")') == ("a.md", "n") and inlines.transclusion("[t](a.md#n)") is None


@given(st.text(alphabet="ab#>-*`~|:=<![]() \t\n\r1.", max_size=60))
@settings(max_examples=400, deadline=None)
def test_blocks_cover_the_text(text):
    """Blocks lie in order, begin and end on non-blank lines, and leave only blank lines out."""
    try:
        doc = document(text)
    except Refused:
        return
    inside = set(range(doc.frontmatter[1] + 1)) if doc.frontmatter else set()
    for b in doc.root.children:
        assert b.start > max(inside, default=-1)
        assert doc.lines[b.start][0].strip(" \t") and doc.lines[b.end][0].strip(" \t")
        inside |= set(range(b.start, b.end + 1))
    assert not [n for n, (line, _) in enumerate(doc.lines) if n not in inside and line.strip(" \t")]


def refused(f, *a, **k):
    try:
        f(*a, **k)
    except Refused as r:
        return r.code


def test_edits():
    text = "# T\r\n\r\none\r\n\r\ntwo"
    assert edits.replace_block(text, [1], "new\nlines\n") == "# T\r\n\r\nnew\r\nlines\r\n\r\ntwo"
    assert edits.replace_block(text, [2], "two\n") == text
    assert edits.insert_block(text, "x") == "# T\r\n\r\none\r\n\r\ntwo\r\n\r\nx"
    assert edits.insert_block(text, "x", before=[0]) == "x\r\n\r\n# T\r\n\r\none\r\n\r\ntwo"
    assert edits.insert_block("", "x") == "x\n"
    assert edits.delete_block(text, [2]) == "# T\r\n\r\none" and edits.delete_block(text, [0]) == "one\r\n\r\ntwo"


def test_refused_edits():
    marked = "<!-- #m -->\none\n\ntwo\n\n- a\n"
    assert refused(edits.insert_block, marked, "x", before=[0], after=[0]) == "bad-position"
    assert refused(edits.delete_block, marked, [9]) == refused(edits.delete_block, marked, []) == "no-such-block"
    assert refused(edits.delete_block, marked, [3, 0]) == "nested-node"
    assert refused(edits.delete_block, marked, [1]) == refused(edits.insert_block, marked, "x", after=[0]) == "rebinds-name"
    assert refused(edits.insert_block, marked, "- b", after=[3]) == refused(edits.replace_block, marked, [2], "") == "not-one-block"
    assert refused(edits.delete_block, "- a\n\nx\n\n- b\n", [1]) == "changes-another-block"
    assert refused(edits.replace_block, marked, [2], "two\n===") == "setext-heading"
    assert edits.insert_block("<!-- #r:begin -->\na\n<!-- #r:end -->\n", "b", after=[1]) == "<!-- #r:begin -->\na\n\nb\n\n<!-- #r:end -->\n"


def test_columns(spark):
    from quire.operators import documents

    rows = [(1, "# Head\n\n<!-- #m -->\n- a\n\n<!-- #r:begin -->\nx\n<!-- #r:end -->\n"), (2, "<div>"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("doc", documents.parse("text")).cache()
    assert {r.id: (r.accept, r.refusal) for r in df.select("id", "doc.*").collect()} == {1: (True, None), 2: (False, "raw-html"), 3: (None, None), 4: (True, None)}
    flat = documents.leaves(df.select("id", "doc")).where("id = 1").orderBy("ord").collect()
    assert [(r.ord, r.node, r.ktype) for r in flat] == [(0, [0], "h1"), (1, [1], None), (2, [2, 0, 0], "p"), (3, [3], None), (4, [4], "p"), (5, [5], None)]
    names = spark.createDataFrame([("m",), ("r",), ("head",), ("none",)], "name string")
    got = {r.name: r.t for r in df.where("id = 1").crossJoin(names).select("name", documents.resolve(df.doc, names.name).alias("t")).collect()}
    assert got == {"m": '{"node":[2],"type":"list"}', "r": '{"region":[{"node":[4],"type":"paragraph"}]}', "head": '{"node":[0],"type":"heading"}', "none": "#REF!(none)"}
    documents.register(spark)
    assert spark.sql("select document_slug('A B') s, parse_document('x').accept a").first() == ("a-b", True)
    node = documents.F.array(documents.F.lit(0))
    assert [tuple(r.e) if r.e.text or r.e.refusal else None for r in df.orderBy("id").select(documents.delete_block(df.text, node).alias("e")).collect()][1:] == [(None, "raw-html"), None, (None, "no-such-block")]


def test_command(spark, tmp_path, capsys):
    from quire.__main__ import main

    (tmp_path / "a.md").write_text("# A\n")
    (tmp_path / "b.md").write_text("<div>\n")
    assert main(["check", str(tmp_path)]) == 1
    assert capsys.readouterr().out.splitlines()[-2:] == ["b.md: is outside the profile [raw-html]", "2 file(s) checked, 1 refused"]


LINES = [
    "", "", "# a", "# b", "## a-b", "# a {#c}", "# *m*", "text", "> # a", "> <!-- #q -->", "> x", "- # i", "- <!-- #n -->", "  y", "<!-- #a -->", "<!-- #b -->", "<!-- #r:begin -->", "<!-- #r:end -->", "<!-- #a:begin -->", "<!-- #a:end -->",
    "[x](#a)", "[x](#a-1)", "[x](#c)", "[x](#r)", "[x](#none)", "~~~", "---", "k: v", "| a | b |", "|---|---|", "***", "<div>", "<<<<<<< x", "<a id=\"none\">z</a>",
]


def as_whole(text):
    doc = document(text)
    ref = lambda n: {"node": list(n.path), "type": n.type}
    names = {k: (region, [ref(n) for n in bound]) for k, (region, bound) in doc.names.items()}
    return {k: (False, [ref(hits[0])]) for k, hits in doc.slugs.items() if len(hits) == 1} | names


@given(st.lists(st.sampled_from(LINES), max_size=14), st.sampled_from(["\n", "\n\n", "\r\n", "\r"]), st.lists(st.integers(0, 120), max_size=4), st.booleans())
@settings(max_examples=400, deadline=None)
def test_pieces_read_as_the_whole(lines, end, cuts, padded):
    text = end.join(lines) + (f"{end}{end}p" * 300 if padded else "")
    at = sorted({0, *(c for c in cuts if c < len(text)), len(text)})
    reader = NameReader()
    for a, b in zip(at, at[1:]):
        reader.feed(text[a:b])
    refused = code(text)
    assert reader.finish() == refused
    if refused is None:
        assert {k: (region, targets) for k, region, targets in reader.resolved()} == as_whole(text)


def test_a_long_document_leaves_memory_as_it_is_read():
    """20,000 headings of 50 slugs: their blocks took 10 MB and more at once."""
    import tracemalloc

    reader, piece = NameReader(), "".join(f"# head {k}\n\n" for k in range(50))
    reader.feed(piece)
    tracemalloc.start()
    for _ in range(400):
        reader.feed(piece)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 2_000_000 and reader.finish() is None and reader.slugs["head-7"][0] == 401


def test_names_of_documents_in_pieces(spark):
    rows = [("d", 2, "# B"), ("d", 1, "<!-- #m -->"), ("d", 3, None), ("e", 1, "# B"), ("e", 2, "# B"), ("f", 1, "a"), ("f", 2, "<div>"), ("f", 0, "# x"), (None, 1, "# N"), ("g", 1, None)]
    pieces = spark.createDataFrame(rows, "`d d` string, n int, piece string")
    got = {(r[0], r.name): (r.is_region, [list(t.node) for t in r.targets]) for r in documents.names_of(pieces, "d d", ["n"], "piece").collect()}
    assert got == {("d", "m"): (False, [[1]]), ("d", "b"): (False, [[1]]), (None, "n"): (False, [[0]])}
    assert documents.names_of(pieces.limit(0), "d d", ["n"], "piece").count() == 0
