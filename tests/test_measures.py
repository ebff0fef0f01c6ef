"""Evaluation, merging and ingest on small cases with known answers."""

import gzip
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from quire.functions import inlines, lineage, merging, rates
from quire.functions.naming import slug
from quire.functions.scalars import resolve_path
from quire.operators import evaluation, sampling
from quire.operators.correspond import pair_leaves
from quire.sources import records

TEXT = "# One\n\nalpha beta gamma delta epsilon zeta eta theta.\n\n<!-- #reg -->\nthe region text is here and long enough\n\n## Two\n\nlast words of this text are these ones"


def test_parts_names_and_sections():
    v = lineage.Version("---\na: 1\n---\n\n" + TEXT + "\n\n```\n\nx\n```\n# Three")
    assert [p.type for p in v.parts] == ["frontmatter", "heading", "paragraph", "html", "heading", "paragraph", "code", "heading"]
    assert [v.text[p.start : p.start + len(p.content)] == p.content for p in v.parts] == [True] * 8 and v.balanced
    assert v.names["reg"] == ("region", 3, 3) and v.names["one"] == ("slug", 1, 6) and v.names["two"] == ("slug", 4, 6) and "none" not in v.names
    assert v.sections == [(1, 3), (4, 6), (7, 7)] and lineage.Version("plain").sections == []
    assert not lineage.Version("a\n\n```\nopen").balanced


def test_oracle_follows_lines():
    base = lineage.Version("a1\na2\na3\n\nb1\nb2\n\nc1")
    moved = lineage.Version("b1\nb2\n\na1\nnew\na3\n\nzzz")
    oracle = lineage.Oracle(base, moved)
    assert oracle.verdict(1, 1) in (("SURVIVED", 0), ("UNKNOWN", None)) and oracle.verdict(2, 2) == ("DELETED", None)
    one, two = lineage.Version("x\n\nk1\nk2\nk3\nk4"), lineage.Version("k1\nk2\nk3\nk4\n\nx")
    assert lineage.Oracle(lineage.Version("k1\nk2\nk3\nk4"), one, (one, one)).verdict(0, 0) == ("SURVIVED", 1)
    torn = lineage.Version("k1\nk2\n\nk3\nk4")
    assert lineage.Oracle(two, torn).split(0, 0, lambda p: p) and not lineage.Oracle(two, one).split(0, 0, lambda p: p)


def test_twins_need_neighbours():
    assert lineage.Units(["a", "k", "b"], ["a", "k", "b", "k"], [0, 1, 2]).told_apart(1, 1)
    assert not lineage.Units(["a", "k", "b"], ["a", "k", "b", "k"], [0, 1, 2]).told_apart(1, 3)
    assert not lineage.Units(["k"], ["k", "k"], [None]).told_apart(0, 0)
    assert lineage.Units(["k"], ["x"], [None]).told_apart(0, None) and not lineage.Units(["k"], ["k"], [None]).told_apart(0, None)


def test_names_stand_for_one_thing():
    v = lineage.Version("# A\n\nx\n\n## B\n\ny\n\n### C\n\nz\n\n## D\n\n# E\n\n## B\n\n<!-- #c -->\n\nlast")
    assert {n: x for n, x in v.names.items()} == {"a": ("slug", 0, 6), "c": ("region", 10, 10), "d": ("slug", 6, 6), "e": ("slug", 7, 10)}


def test_short_quotes_are_recorded():
    got = [r for r in lineage.evaluate("short\n\n" + "long enough to be quoted here", "short\n\nlong enough to be quoted here") if r["mech"] == "Q"]
    assert [(r["skip"], r["oracle"], r["decided"]) for r in got] == [("short_quote", None, False), (None, "SURVIVED", True)]


def test_records_and_grades():
    got = {(r["mech"], r["name"] or r["first"]): r for r in lineage.evaluate(TEXT, TEXT.replace("## Two", "## One"))}
    assert got["Q", 1]["hard_cls"] == got["Q", 1]["naive_cls"] == "correct"
    few = lineage.Version("same same same same same\n\nx")
    assert lineage.quote_hits(few, 0, few, True) == ("low-entropy", None) and lineage.quote_hits(few, 0, few, False) == ("exact", 0)
    assert got["R", "one"]["hard_cls"] == "LOUD" and got["R", "reg"]["hard_cls"] == "correct"
    gone = {r["first"]: r for r in lineage.evaluate(TEXT, TEXT.replace("\n\nlast words of this text are these ones", "")) if not r["skip"]}
    assert gone[4]["oracle"] == "DELETED" and gone[4]["hard_cls"] == "correct"
    assert [lineage.grade(*x) for x in (("SURVIVED", False, False), ("SURVIVED", True, True), ("SURVIVED", True, False), ("DELETED", True, False), ("DELETED", False, False))] == ["LOUD", "correct", "WRONG", "WRONG", "correct"]
    assert lineage.evaluate("", "x") == [] and [r["skip"] for r in lineage.evaluate("a", "a", ("a", "a"))] == ["short_quote"]


@pytest.mark.parametrize("base,ours,theirs,want", [
    ("a\nb\nc\nd\n", "a\nB\nc\nd\n", "a\nb\nc\nD\n", ("clean", "a\nB\nc\nD\n")), ("a\nb\n", "a\nx\n", "a\nx\n", ("clean", "a\nx\n")), ("a\nb\nc\n", "a\nc\n", "a\nb\nc\nd\n", ("clean", "a\nc\nd\n")),
    ("a\nb\n", "a\nx\n", "a\ny\n", ("conflict", "a\n<<<<<<< ours\nx\n=======\ny\n>>>>>>> theirs\n")), ("a\nb\n", "A\nb\n", "a\nB\n", ("conflict", "<<<<<<< ours\nA\nb\n=======\na\nB\n>>>>>>> theirs\n")), ("", "", "x", ("clean", "x")), ("a", "a", "", ("clean", "")),
])
def test_merge(base, ours, theirs, want):
    assert merging.merge(base, ours, theirs) == want


def test_bounds(spark):
    cases = [(0, 300), (5, 5), (3, 50), (1, 47), (0, 1), (1, 1), (250, 1000), (20, 20_000), (0, 0)]
    rows = spark.createDataFrame([(k, n) for k, n in cases], "k long, n long")
    got = {(r.k, r.n): r for r in rows.select("k", "n", evaluation.upper_bound(F.col("k"), F.col("n")).alias("u"), rates.lower_end(F.col("k"), F.col("n")).alias("lo"), rates.upper_end(F.col("k"), F.col("n")).alias("hi")).collect()}
    below = lambda k, n, p: sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    assert abs(got[0, 300].u - (1 - 0.05 ** (1 / 300))) < 1e-9 and got[5, 5].u == got[0, 0].hi == got[1, 1].hi == 1.0 and got[0, 1].lo == got[0, 0].lo == 0.0
    assert round(100 * got[1, 47].u, 1) == 9.7
    for (k, n), r in got.items():
        if 0 < k < n:
            assert abs(below(k, n, r.u) - 0.05) < 1e-8 and abs(below(k, n, r.hi) - 0.025) < 1e-8 and abs(1 - below(k - 1, n, r.lo) - 0.025) < 1e-8
    r = evaluation.stratified_rate(spark.createDataFrame([(100, 10, 1), (300, 30, 0)], "size long, sampled long, hits long")).first()
    assert abs(r.hits - 10) < 1e-9 and abs(r.low * 400 - 100 * (1 - 0.975 ** 0.1)) < 1e-6 and abs(r.high * 400 - 100 * 0.4450161 - 300 * (1 - 0.025 ** (1 / 30))) < 1e-4


def test_days_are_utc_and_only_later_ones_late(spark):
    rows = [("2024-01-01T00:00:00Z", "2024-01-03T00:00:00Z", False), ("2024-01-17T00:00:00Z", "2024-01-03T23:00:00Z", False), ("2024-01-18T00:00:00Z", "2024-01-03T23:00:00Z", True), ("2024-01-17T23:00:00-05:00", "2024-01-03T10:00:00Z", True), ("2024-01-18T01:00:00+05:00", "2024-01-03T10:00:00Z", False)]
    frame = spark.createDataFrame(rows, "day string, declared string, want boolean")
    assert frame.where(evaluation.is_late(F.col("day"), F.col("declared")) != F.col("want")).count() == 0


def test_packet_hash(spark):
    fields = {"packet": "p1", "b": [1, {"z": None, "a": "é"}], "a": 2.5}
    files = [("p", "packet.json", json.dumps(fields)), ("p", "b.md", "text b"), ("p", "a.md", "ä"), ("p", "QUESTIONS.md", "no"), ("q", "x", "y")]
    got = {r.g: r.hash for r in evaluation.packet_hash(spark.createDataFrame(files, "g string, f string, c string"), "g", "f", "c").collect()}
    rest = json.dumps({k: v for k, v in fields.items() if k != "packet"}, sort_keys=True, ensure_ascii=False)
    assert got == {"p": hashlib.sha256((rest + "\0a.md\0ä\0b.md\0text b").encode()).hexdigest(), "q": None}


def test_a_missing_reproduction_stops_the_job(spark):
    packets, found = spark.range(3), spark.range(2)
    with pytest.raises(Exception, match="no reproduction of 2"):
        evaluation.with_reproductions(packets, found, "id").collect()


def test_json_predicates(spark):
    rows = spark.createDataFrame([('{"a":["x",{"b":"y"}]}',), ('{"a":["x",{"b":1}]}',), ('{"a":true}',)], "j string")
    assert [r[0] for r in rows.select(evaluation.only_strings(F.col("j"))).collect()] == [True, False, False]
    numbers = spark.createDataFrame([("1",), ("-0",), ("1.0",), ("true",), ("1e3",), ("01",)], "j string")
    assert [r[0] for r in numbers.select(evaluation.is_integer(F.col("j"))).collect()] == [True, True, False, False, False, False]


def test_change_lists_and_bundles(spark, tmp_path):
    raw = b"c1\0M\0a.md\0R090\0old\0new\0c2\0A\0b\xff.md\0"
    assert list(records.parse_changes(raw)) == [("c1", "M", ["a.md"]), ("c1", "R090", ["old", "new"]), ("c2", "A", ["b\udcff.md"])]
    assert records.changes(spark.createDataFrame([(raw,), (None,)], "content binary")).count() == 3
    digest = spark.sql("select sha2(cast('x' as binary), 256)").first()[0]
    rows = records.opened(spark.createDataFrame([("a", b"x"), ("b", b"y")], "arm string, content binary"), spark.createDataFrame([("a", digest), ("b", digest), ("c", digest)], "arm string, sha256 string"))
    assert {r.arm: r.reason for r in rows.collect()} == {"a": None, "b": "digest differs", "c": "no bundle"}
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write('{"a":1}\n{"a":2}\n')
    assert records.json_lines(spark, str(tmp_path / "x.jsonl.gz"), "a int").count() == 2
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "o.json").write_text(json.dumps({"a": 3}, indent=1))
    assert records.json_objects(spark, str(tmp_path / "d"), "a int").first() == (3, "o.json")
    records.write_canonical(spark.createDataFrame([(2, "é"), (1, None)], "b int, a string"), str(tmp_path / "out"), ["b"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":null,"b":1}', '{"a":"é","b":2}']


def test_placeholders(spark):
    files = spark.createDataFrame([("c", "a", "x"), ("c", "b", "see {{blob:a}} {{blob:b}} {{blob:z}}"), ("d", "b", "{{blob:a}}")], "case_id string, path string, text string")
    done, bad = evaluation.substitute(files, F.lit("ID"))
    assert {(r.case_id, r.path): r.text for r in done.collect()} == {("c", "a"): "x", ("c", "b"): "see ID {{blob:b}} {{blob:z}}", ("d", "b"): "{{blob:a}}"}
    assert {tuple(r) for r in bad.collect()} == {("c", "b", "b"), ("c", "b", "z"), ("d", "b", "a")}


def test_packets(spark):
    files = spark.createDataFrame([("p", "b", "2"), ("p", "a", "1"), ("p", "skip", "9"), ("q", "a", "1")], "packet string, path string, content string")
    one = evaluation.content_hash(files, "packet", "path", "content", ["skip"])
    two = evaluation.content_hash(files.where("packet = 'p'"), "packet", "path", "content", ["skip"])
    assert [r.packet for r in evaluation.same_content(one, two, "packet").collect()] == ["q"]
    assert [tuple(r) for r in evaluation.disallowed(files, ["[ab]"]).collect()] == [("p", "skip")]
    r = spark.range(1).select(evaluation.refuses(F.array(F.lit("EXACT"), F.lit("REFUSED(x)"))).alias("a"), evaluation.refuses(F.array(F.lit("x"))).alias("b")).first()
    assert tuple(r) == (True, False)


def test_partition_problems(spark):
    rows = spark.createDataFrame([("d", "a\n\nb\nc", [("p", 1, 1), ("p", 1, 3)])], "k string, t string, b array<struct<type string, start int, end int>>")
    assert tuple(evaluation.partition_problems(rows, "k", "t", "b").first()) == ("d", 1, 1)


def test_deal_spreads_equal_batches(spark):
    rows = spark.createDataFrame([(k // 3,) for k in range(100)], "k int").repartition(5)
    got = sorted(tuple(r) for r in sampling.deal(rows, "k", 17, parts=4).collect())
    sizes = [sum(b == x for _, b in got) for x in range(1, 7)]
    assert sizes == [17, 17, 17, 17, 16, 16] and [b for _, b in got] == sorted(b for _, b in got)
    assert sampling.deal(rows.limit(0), "k", 17).count() == 0


def test_paths_slugs_and_brackets(spark):
    forms = {"a//b": "d/a//b", "./a": "d/a", "../a": "a", "../../a": None, "/a": None, "x:y/z": None, "./x:y": "d/x:y", "a/..": "d", "": "d/"}
    rows = spark.createDataFrame([(k,) for k in forms], "p string")
    assert {r.p: r.out for r in rows.select("p", resolve_path(F.lit("d"), F.col("p")).alias("out")).collect()} == forms
    assert slug("aࡰb c") == "ab-c" and slug("Ünï 中") == "ünï-中"
    assert len(inlines.scan("[" * 20_000 + "](" * 20_000).links) == 0
    assert inlines.scan("<a@-b.c> `x`").tags == [] and [x.destination for x in inlines.links("[a](b(c)d) [e](f(g)")] == ["b(c)d"]


def test_hundreds_of_edited_leaves():
    base, cur = ([("p", f"leaf {k} " + " ".join(f"{w}{k * 7 % 83}" for w in "abcdefgh") + tail) for k in range(200)] for tail in (" old", " new"))
    assert len(pair_leaves(base, cur)) == 200


def test_sets_and_rebuilding(spark):
    a, b = spark.range(3), spark.range(5)
    assert evaluation.is_subset(a, b) and not evaluation.is_subset(b, a) and evaluation.is_subset(a, a.union(a))
    rows = spark.createDataFrame([("i1", TEXT, TEXT), ("i2", TEXT, None), ("i3", TEXT, "gone")], "id string, before string, after string")
    whole = evaluation.evaluate(rows, ["id"])
    again = evaluation.rebuild(rows, "id", "i1", ["id"])
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.where("id = 'i1'").collect())) and whole.where("id = 'i2'").count() == 0


def test_first_answers_on_a_stream(spark, tmp_path):
    from quire.streaming import windows

    (tmp_path / "in").mkdir()
    for k, lines in enumerate((["a 1", "b 2", "a 3"], ["b 4", "c 5"])):
        rows = [json.dumps({"ts": f"2024-01-01T00:00:{int(x[2:]):02d}Z", "k": x[0], "v": int(x[2:])}) for x in lines]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(rows))
    answers = spark.readStream.schema("ts timestamp, k string, v int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    stream = windows.first_answers(answers, "ts", "k", "1 hour").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    stream.awaitTermination(120)
    got = {r.k: r.v for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"] in (2, 4) and got["a"] in (1, 3)


def test_every_alteration_is_noticed(spark):
    expected = spark.createDataFrame([("c", True, "x"), ("d", False, None)], "case string, accept boolean, code string")
    rows = evaluation.alterations(expected, "case").collect()
    assert len(rows) == 10
    for r in rows:
        own = {"accept": '{"v":true}', "code": '{"v":"x"}'} if r["case"] == "c" else {"accept": '{"v":false}', "code": "{}"}
        assert r.answer != own and sum(r.answer.get(f) != own.get(f) for f in {*r.answer, *own}) == 1
    got = spark.createDataFrame([("c", False, "x")], "case string, accept boolean, code string")
    assert {(r["case"], r.field) for r in evaluation.differences(expected, got, "case").collect()} == {("c", "accept"), ("d", "accept"), ("d", "code")}


def test_raw_pieces_end_where_they_should():
    tags = lambda s: inlines._Reader(s).read().tags
    assert tags("a <!--x--> <?y?> <!A> <![CDATA[z]]> <!--> <!---> <!é> <!--") == [(2, 10), (11, 16), (17, 21), (22, 35), (36, 41), (42, 48)]
    assert tags("<!--" * 30_000) == [] and tags("<?" * 30_000) == [] and tags("<![CDATA[" * 10_000) == []  # in linear time
