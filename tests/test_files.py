"""Trees of small files: collection, decoding, verdicts, reports, cases and sinks."""

import pytest

from quire.operators import checker
from quire.sources import files, sinks


@pytest.fixture
def root(tmp_path):
    data = {
        "good.md": b"# A\n", "sub/B.MD": b"<div>\n", "sub/raw.md": b"\xff\n", "x.txt": b"<div>", ".git/no.md": b"<div>", "sub/node_modules/no.md": b"<div>",
        "good.md.notes/r.md": b"[x](#gone)\n", "lost.md.notes/r.md": b"[x](#gone)\n", "c/one/input": b"a|b", "c/one/t/f": b"\x00", "c/two/input": b"", "c/none/f": b"", "sub/a b+c%.md": b"",
    }
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def test_check(spark, root):
    found = checker.verdicts(files.decoded(files.collect(spark, root, ["x.txt"])))
    assert {r.path: (r.refused, r.code) for r in found.collect()} == {
        "good.md": (False, None), "sub/B.MD": (True, "raw-html"), "sub/raw.md": (True, None), "x.txt": (True, "raw-html"),
        "good.md.notes/r.md": (False, None), "lost.md.notes/r.md": (True, "dangling-link"), "sub/a b+c%.md": (False, None),
    }
    assert tuple(checker.summary(found).first()) == (7, 4, 0, 1)
    lost = spark.createDataFrame([("a.md", "fine\n", False), ("b.md", None, True)], "path string, text string, unread boolean")
    assert [tuple(r) for r in checker.verdicts(lost).orderBy("path").collect()] == [("a.md", False, None, False), ("b.md", False, None, True)]
    assert tuple(checker.summary(checker.verdicts(lost)).first()) == (1, 0, 1, 2)
    assert {r.line for r in checker.report(found).where("path like 'sub%'").collect()} == {"sub/raw.md: is not UTF-8", "sub/B.MD: is outside the profile [raw-html]"}
    assert checker.report(found, True).where("path = 'sub/B.MD'").first().line == "::error file=sub/B.MD,title=quire [raw-html]::is outside the profile"
    assert tuple(checker.summary(found.limit(0)).first()) == (0, 0, 0, 2)


def test_every_file_once(spark, root):
    paths = [r.path for r in files.tree(spark, root, skipped=()).select("path").collect()]
    assert len(paths) == len(set(paths)) and {"sub/a b+c%.md", "c/two/input", "good.md"} <= set(paths)


def test_tolerant(spark, root):
    assert {r.path: (r.text, r.clean) for r in files.tolerant(files.collect(spark, root)).collect()}["sub/raw.md"] == ("�\n", False)


def test_cases(spark, root):
    got = {r.case_id: {k: bytes(v) for k, v in r.files.items()} for r in files.cases(spark, root, "input").collect()}
    assert got == {"c/one": {"input": b"a|b", "t/f": b"\x00"}, "c/two": {"input": b""}}


def test_sinks(spark, root, tmp_path):
    lines = [r.line for r in sinks.manifest(files.tree(spark, root + "/c")).collect()]
    assert [x.split("  ")[1] for x in lines] == ["none/f", "one/input", "one/t/f", "two/input"] and len(lines[0]) == 64 + 2 + 6
    rows = spark.createDataFrame([("p", "a|b", None)], "packet string, x string, y string")
    assert rows.select(sinks.markdown_row("x", "y").alias("row")).first().row == "| a\\|b |  |"
    out = str(tmp_path / "out" / "sealed")
    sinks.write_once(rows, out)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_once(rows, out)
    sinks.append(rows, out)
    assert spark.read.json(out).count() == 2
    sinks.packets(rows, out + "-packets")
    assert spark.read.json(out + "-packets").first().packet == "p"
