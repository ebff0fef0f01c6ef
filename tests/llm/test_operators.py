"""Operators of quire.llm against brute force: small awkward fixtures and the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import chat, chunks, crc32c, eliasfano, lines, lm, minhash, quality, records, registry, sharding, shared, templates, urls, words, wordshuffle
from quire.llm.components import connected_components

DIR = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, source string, n_lines int, kept string"
ODD = ["", None, " ", "a", "one two three four", "one two three four", "x  y\n\tz \x1cq", "\n\n", "naïve Ünïcode \U0001f600 text", "'s 'S don't   x" * 3, "w " * 30_000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, None if k % 3 == 0 else f"s{k}", k, "clash") for k, t in enumerate(ODD)] + [(4, ODD[4], "s4", 4, "clash"), (None, "no id at all here", "s", 0, "c")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def test_slices_are_read_right():
    a = pa.array([f"W{k} b\x0b{k}" for k in range(50)]).slice(20, 10)
    flat, ends = words.split(a, True)
    assert flat.to_pylist() == [w for t in a.to_pylist() for w in WORD.findall(low(t))] and ends.tolist() == list(range(3, 33, 3)) or len(flat) == 30
    code, ends, distinct = chunks.cut_chunks(a)
    assert ["".join(distinct[c] for c in code[x:y]) for x, y in zip([0, *ends[:-1]], ends)] == a.to_pylist()


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 8), (7, None), (4, 1), (2, 1)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(1000, 1040)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    want = {k: 1 for k in (1, 2, 3, 4)} | {8: 8, 9: 8} | {k: 100 for k in range(100, 160)} | {k: 1000 for k in range(1000, 1041)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_urls(spark):
    page = lambda href: f'<html><LINK href="{href}" rel="canonical"></html>'
    refresh = "<meta http-equiv='refresh' content='0; url=http://b.org/t'>"
    rows = [
        (1, "HTTP://A.X.NET/p?q#f", "", "c"), (2, "http://b.org/s", page("http://a.x.net/p?q"), "c"), (3, "http://c.org/r", page("//b.org/s"), "c"), (4, "http://d.org/fr/ok", page("http://c.org/r"), "c"),
        (5, "http://d.org/free", None, "c"), (6, None, page("http://a.x.net/p?q"), "c"), (7, "nonsense", "", "c"), (8, "http://example.net/en/x", page("http://other.net/"), "c"), (9, "http://e.org/u", refresh, "c"),
        (10, "http://b.org/t", page("/s"), "c"), (11, "http://net", "", "c"), (1, "HTTP://A.X.NET/p?q#f", "", "c"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    got = defaultdict(set)
    for r in urls.judge_urls(pages).collect():
        got[r.page_id].add((r.host, r.path, r.rule, r.verdict))
    assert {k: next(iter(v))[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "block", 11: "allow"}
    assert got[1] == {("a.x.net", "/p", "net/", "block")} and got[8] == {("example.net", "/en/x", "example.net/en/", "allow")} and got[11] == {("net", "", None, "allow")}
    moved = spark.createDataFrame([("http://d.org/free", "https://z.net/")], "src string, dst string")
    assert {r.page_id: r.verdict for r in urls.judge_urls(pages, redirects=moved).collect()}[5] == "block"
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_urls_links_of_all_kinds(spark):
    link = '<link rel="canonical" href="{}"><p>x</p><link href=\'{}\' rel=canonical><meta http-equiv="refresh" content="5; URL={}">'
    rows = [
        (1, "http://a.org/d/e?q", link.format("../x?a=1&amp;b=2", "./y/../z/.", "HTTP://b.org/..//k")), (2, "http://q.net/p", '<link rel=canonical href="http://A.org/x?a=1&b=2">'),
        (3, "http://a.org/d/z/", ""), (4, "http://b.org//k", ""), (5, "http://b.org/k", ""), (6, "http://a.org/x?a=1&b=2", None), (7, None, ""), (8, None, ""), (9, "http://a.org/d/z", ""),
    ]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "allow"}


def brute_urls(pages, redirects, rules):
    """{page_id: (host, path, rule, verdict)} by a search from every url over all edges."""
    def parts(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        return (low(m[1]), m[2]) if m else ("", "")

    node = lambda u: low(re.match(r"(?s).*?://([^/?#]*)", u)[1]) + "/" + re.match(r"(?s).*?://[^/?#]*/?([^#]*)", u)[1] if u and "://" in u else None
    def rule(h, p):
        fit = [(len(rh + rp), len(rh), rh + rp, v) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        return max(fit)[2:] if fit else (None, None)

    near = defaultdict(set)
    for a, b in redirects:
        if node(a) and node(b):
            near[node(a)].add(node(b)), near[node(b)].add(node(a))
    out = {}
    for i, u in pages:
        seen, todo = {node(u)}, [node(u)]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x), todo.append(x)
        own = rule(*parts(u))
        out[i] = (*parts(u), own[0], own[1] or ("block" if any(x and rule(*parts("://" + x))[1] == "block" for x in seen) else "allow"))
    return out


def test_urls_by_brute_force(spark):
    rng = np.random.default_rng(8)
    pages = [(r.page_id, r.url) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    known = [u for _, u in pages] + ["http://else.net/x", "http://shop.org/fr/a"]
    edges = [(known[a], known[b]) for a, b in rng.integers(0, len(known), (90, 2))]
    frame = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(frame, redirects=spark.createDataFrame(edges, "src string, dst string")).collect()}
    want = brute_urls(pages, edges, urls.RULES)
    alone = brute_urls(pages, [], urls.RULES)
    assert got == want and sum(want[i] != alone[i] for i in want) > 5


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_sharding(spark, docs, odd, empty, shards):
    for frame in (docs, odd):
        rows = [(r.doc_id, r.text or "") for r in frame.collect()]
        got = sharding.shard_documents(frame, shards).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows)
        by, load = defaultdict(list), Counter()
        for r in got:
            by[r.shard].append(r.slot)
            load[r.shard] += r["size"]
        assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(shards))
        biggest, mean = max(len(t.encode()) + 1 for _, t in rows), sum(load.values()) / shards
        assert all(abs(load[s] - mean) <= biggest for s in range(shards))
    assert sharding.shard_documents(empty, shards).count() == 0


def test_sharding_subdivides_overfull_ranges(spark):
    rows = [(k, "") for k in range(3000)] + [(k, "long text " * 500) for k in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    d = sharding.digests(frame, "doc_id", "text").withColumn("k", sharding.order_key()).cache()
    cuts = sharding.subdivided(d, [], 200)
    sizes = [r[1] for r in d.groupBy(sharding.range_of(d["k"], cuts)).count().collect()]
    assert max(sizes) <= 200 and sum(sizes) == 3003
    got = sharding.shard_documents(frame, 4, range_rows=200).collect()
    whole = sharding.shard_documents(frame, 4).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, whole), key=str) and len(got) == 3003


def test_sharding_splits_a_hot_row(spark):
    hot = spark.createDataFrame([(5, "same")] * 900 + [(k, f"t{k}") for k in range(100)], "doc_id long, text string")
    load = Counter(r.shard for r in sharding.shard_documents(hot, 8).collect())
    assert len(load) == 8 and max(load.values()) < 200


def brute_leaks(docs, items):
    """{(doc_id, item_id, n_windows, n_matched)} by comparing every text with every item."""
    import regex

    def words_of(text):
        text = regex.sub(r"(?<=\p{Nd})[.,](?=\p{Nd})", "_", text or "")
        raw = regex.findall(r"[\p{L}\p{M}\p{Nd}_%$€£]+", text)
        kind = []
        for k, w in enumerate(raw):
            if regex.match(r"[$€£]?\p{Nd}", w):
                kind.append("<n>")
            elif k and kind[-1] == "<n>" and w.lower() in templates.UNITS:
                kind.append("<u>")
            else:
                kind.append("<p>" if regex.match(r"\p{Lu}.*\p{Ll}", w) else w.lower())
        return [w.lower() for w in raw], kind, tuple(raw)

    by_words = {}
    for i, t in items:
        w, kind, raw = words_of(t)
        if w and (raw not in by_words or i < by_words[raw][0]):
            by_words[raw] = (i, w, kind)
    cut = lambda x, k, n: tuple(x[k : k + n])
    out = set()
    for d, t in docs:
        dw, dk, _ = words_of(t)
        for i, w, kind in by_words.values():
            n = min(5, len(w))
            total, places = len(w) - n + 1, defaultdict(list)
            for k in range(len(dw) - n + 1):
                places[cut(dw, k, n)].append(k)
                if not set(cut(dk, k, n)) <= set(templates.SLOTS):
                    places[cut(dk, k, n)].append(k)
            shifts = defaultdict(dict)
            for j in range(total):
                for key in {cut(w, j, n)} | ({cut(kind, j, n)} if not set(cut(kind, j, n)) <= set(templates.SLOTS) else set()):
                    for k in places.get(key, []):
                        shifts[k - j][j] = shifts[k - j].get(j, False) or cut(w, j, n) == cut(dw, k, n)
            if 100 * len({j for s in shifts.values() for j in s}) < 80 * total:
                continue
            matched = set()
            for s, js in shifts.items():
                stands = defaultdict(set)
                for at in range(max(min(js) - 4, 0, -s), min(max(js) + 8, len(w) - 1, len(dw) - s - 1) + 1):
                    if kind[at] in templates.SLOTS and kind[at] == dk[at + s]:
                        stands[kind[at], w[at]].add(dw[at + s])
                bad = any(len(v) > 1 for v in stands.values())
                matched |= {j for j, same in js.items() if same or not bad}
            if 100 * len(matched) >= 80 * total:
                out.add((d, i, total, len(matched)))
    return out


def test_short_and_slot_dense_items(spark):
    items = [(9, "12 plus 7 equals"), (10, "Tom 5"), (1, "2 + 2 equals"), (2, "What is 12 times 7"), (3, "Tom Ann Bob 12 13"), (4, "a 1 b 1 c 1 d 1 e 1 f 1 g 1 h the end of it comes now at last and here")]
    docs = [
        (1, "so 2 + 2 equals four"), (2, "3 + 3 equals six"), (3, "What is 13 times 8"), (4, "Eve Ida Max 14 15"), (5, "see Tom, Ann, Bob: 12 13"), (6, "nothing"),
        (7, "a 2 b 2 c 2 d 2 e 2 f 2 g 2 h the end of it comes now at last and here"), (8, "a 2 b 3 c 2 d 2 e 2 f 2 g 2 h the end of it comes now at last and here"),
        (9, "15 plus 9 equals"), (10, "so 2 + 3 equals nothing"), (11, "15 Plus 9 equals"), (12, "15 kg plus 9 equals"), (13, "Ida 6"), (14, "tom 5"),
    ]
    got = {tuple(r)[:4] for r in templates.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute_leaks(docs, items) and {x[:2] for x in got} == {(1, 1), (2, 1), (3, 2), (5, 3), (7, 4), (9, 9), (14, 10)}


def test_template_decontamination(spark, docs):
    b = spark.createDataFrame([
        (1, "Alice Brown has 12 apples and gives 5 of them to the poor neighbour near Alice Street"), (2, "two short"), (3, None),
        (4, "the train leaves with 30 km to go and then 30 more people wait at the door for it"), (5, "The Train leaves, with 30 km to go and then 30 more people wait at the door for it"),
    ], "item_id long, text string")
    d = spark.createDataFrame([
        (1, "so then: Clara Green has 7 apples and gives 3 of them to the poor neighbour near Clara Street ok", "x"), (2, "Clara Green has 7 apples and gives 3 of them to the poor neighbour near Berta Street", "x"),
        (3, "THE TRAIN LEAVES WITH 30 KM TO GO AND THEN 30 MORE PEOPLE WAIT AT THE DOOR FOR IT", "x"), (4, "the train leaves with 44 km to go and then 44 more people wait at the door for it", "x"),
        (5, "the train leaves with 44 km to go and then 45 more people wait at the door for it", "x"), (6, "", "x"), (7, None, "x"), (8, "nothing of this kind stands here at all today", "x"), (1, "two short", "x"), (None, "the train leaves with 30 km to go and then 30 more people wait at the door for it", "x"),
    ], "doc_id long, text string, item_id string")
    got = {(r.doc_id, r.item_id): r.n_changed for r in templates.leaks(d, b).collect()}
    assert set(got) == {(1, 1), (3, 4), (4, 4), (None, 4), (3, 5), (4, 5), (None, 5), (1, 2)}  # items 4 and 5 differ by a capital
    assert got[1, 1] == 5 and got[4, 4] == 2 and got[None, 4] == 0
    kept = [r.doc_id for r in templates.decontaminate(d, b).collect()]
    assert sorted(kept) == [2, 5, 6, 7, 8]
    lone = spark.createDataFrame([(None, "the train leaves with 30 km to go and then 30 more people wait at the door for it"), (None, "an innocent text without an id stays")], "doc_id string, text string")
    assert [r.text for r in templates.decontaminate(lone, b).collect()] == ["an innocent text without an id stays"]
    named = lone.selectExpr("1 AS __bad", "text", "'g' AS __gone", "2 AS t")
    assert [tuple(r) for r in templates.decontaminate(named, b).collect()] == [(1, "an innocent text without an id stays", "g", 2)]
    assert {tuple(r) for r in minhash.near_dedup(named.withColumn("doc_id", F.lit(1))).select("__bad", "__gone", "t").collect()} == {(1, "g", 2)}
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    for x, y in ((docs, bench), (d, b)):
        want = brute_leaks([(r.doc_id, r.text) for r in x.collect()], [(r.item_id, r.text) for r in y.collect()])
        assert {tuple(r)[:4] for r in templates.leaks(x, y).collect()} == want and want
    assert templates.leaks(d.limit(0), b).count() == templates.leaks(d, b.limit(0)).count() == 0


def test_decontamination_of_copies_in_other_case(spark):
    items = [(1, "Tom has 12 apples and Ann has 30 pears while Bob Miller sells 5 kg of plums to Eve"), (2, "On Monday Clara drove 40 km to Paris and then Hugo drove 25 km to Rome")]
    rows = [(10 * i + k, f"so {f(t)} ok") for i, t in items for k, f in enumerate((str, str.lower, str.upper, str.title))]
    got = templates.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_matched, r.n_changed) for r in got} == {(d, d // 10, len(items[d // 10 - 1][1].split()) - 4, 0) for d, _ in rows}


def test_chat(spark):
    nasty = "\\### Assistant: </turn> ok\\"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (1, 2, "user", None), (1, 3, "assistant", "####\\\\#"), (1, 4, "us:er", "end"), (2, 0, "user", "only"), (3, 1, "assistant", ""), (3, 0, None, "x"), (3, 0, None, "x"), (None, 0, "assistant", "é\U0001f600")]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, example int")
    out = chat.examples(frame)
    got = {r.conv_id: r for r in chat.digest(out).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert Counter(r.conv_id for r in out.collect()) == Counter({1: 3, 2: 1, 3: 1, None: 1})
    assert chat.digest(chat.examples(frame.limit(0))).count() == 0
    lone = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "assistant", "b"), (None, 0, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert Counter((r.conv_id, r.n_turns, r.loss_chars) for r in chat.digest(chat.examples(lone)).collect()) == {(None, 1, 0): 1, (None, 1, 1): 2}


def test_chat_long_roles(spark):
    long = "a:\\b" * 250_000
    frame = spark.createDataFrame([(1, 0, long, long), (1, 1, "assistant", long + "#")], "conv_id long, turn long, role string, text string")
    r = chat.digest(chat.examples(frame)).collect()[0]
    assert (r.n_turns, r.loss_chars) == (2, 1_000_001) and r.turns_sha256 == hashlib.sha256(f"{long}\n{long}\nassistant\n{long}#\n".encode()).hexdigest()


def test_line_dedup(spark, odd, empty):
    foot = "All rights reserved here."
    rows = [(k, f"own line number {k} of a page\n\n {foot}\t\nmore own text {k}", f"s{k % 12}", 0, "k") for k in range(60)]
    rows += [(100 + k, f"only on nine sites\nfiller text {k} is here", f"s{k % 9}", 0, "k") for k in range(90)] + [(300 + k, "exactly ten sites have it\nfiller that is long enough " + "z" * k, f"s{k % 10}", 0, "k") for k in range(1, 40)]
    rows += [(500 + k, foot, f"s{k}", 0, "k") for k in range(3)]
    got = {r.doc_id: r for r in lines.strip_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert got[7].text == "own line number 7 of a page\n\nmore own text 7" and got[7].n_removed == 1 and got[7].n_lines == 4
    assert got[100].n_removed == 0 and got[339].n_removed == 1 and "ten sites" not in got[339].text and got[500].text == foot
    back = lines.strip_boilerplate(odd)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in odd.collect()) and "kept" in back.columns
    assert lines.strip_boilerplate(empty).count() == 0


def brute_strip(rows, keep_copies=True):
    """{doc_id: (text, n_removed)}: lines on ten sites go."""
    cut = lambda t: [x.strip(" \t\r") for x in (t or "").split("\n")]
    sites = defaultdict(set)
    for _, t, s in rows:
        for x in cut(t):
            sites[x] |= {s} - {None}
    out = {}
    for i, t, _ in rows:
        left = [x for k, x in zip(cut(t), (t or "").split("\n")) if not k or len(sites[k]) < 10]
        out[i] = (t, 0) if t is None or keep_copies and not any(x.strip(" \t\r") for x in left) else ("\n".join(left), len(cut(t)) - len(left))
    return out


def test_line_dedup_short_pages_and_copies(spark):
    foot, copy = "All rights reserved here.", "a page that was copied as a whole\nall of its lines are its own"
    rows = [(k, f"own {k}\n{foot}", f"s{k % 12}") for k in range(24)]  # over half of each text is the foot
    rows += [(100 + k, copy, f"s{k}") for k in range(15)]
    rows += [(200 + k, f"text {k} of one site\nall of its lines are its own", "s0") for k in range(12)]
    rows += [(400 + k, f"page {k}\nMenu", f"s{k % 12}") for k in range(24)] + [(600, None, "s1"), (601, "Menu\n \n", None), (602, "", "s2"), (603, "\t\n", "s3")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for keep in (True, False):
        got = {r.doc_id: (r.text, r.n_removed) for r in lines.strip_boilerplate(frame, keep_copies=keep).collect()}
        assert got == brute_strip(rows, keep) and got[3] == ("own 3", 1) and got[203] == ("text 3 of one site", 1) and got[100] == ((copy, 0) if keep else ("", 2))
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.strip_boilerplate(frame).collect()}
    assert got == brute_strip(rows) and sum(n for _, n in got.values()) > 0


def test_line_dedup_leaves_columns_alone(spark):
    rows = [(k, f"own {k}\nMenu", f"s{k}", k, f"t{k}", [k]) for k in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed long, t string, hs array<int>")
    got = lines.strip_boilerplate(frame)
    assert got.columns == ["doc_id", "text", "source", "t", "hs", "n_lines", "n_removed"]
    assert {tuple(r) for r in got.withColumn("hs", got["hs"][0]).collect()} == {(k, f"own {k}", f"s{k}", f"t{k}", k, 2, 1) for k in range(12)}


def brute_near(pairs, percent):
    sets = {}
    for i, t in pairs:
        w = WORD.findall(low(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in names}


def test_minhash(spark, docs, odd, empty):
    rng = np.random.default_rng(1)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for g in range(6):  # chains of edits: neighbours are near, ends are not
        w = [f"w{x}" for x in rng.integers(0, 10_000, 150)]
        for k in range(12):
            w[int(rng.integers(0, 150))] = f"e{g}x{k}"
            rows.append((1000 + g * 100 + k, " ".join(w)))
    for percent in (80, 85):
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    got = minhash.near_duplicates(odd).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_near([(k, t) for k, t in enumerate(ODD)], 80)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    base = " ".join(f"v{k}" for k in range(60))
    lone = spark.createDataFrame([(None, base), (None, base), (None, base + " x"), (None, "other words stand here now"), (None, ""), (7, base + " y"), (None, "p q r s t u v w"), (None, "p q r s t u v w")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in minhash.near_dedup(lone).collect()) == [(0, ""), (0, "other words stand here now"), (0, "p q r s t u v w"), (7, base + " y")]
    assert Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(lone).collect())[None, 7, False] == 3
    assert minhash.near_dedup(odd).columns == odd.columns and minhash.near_duplicates(empty).count() == 0


def test_open_buckets_meet_on_full_sets(spark):
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(40):
        w = list(base)
        for j in range(2):
            w[(7 * k + 23 * j) % 60] = f"x{k}y{j}"
        rows.append((k, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, 65).collect()} == brute_near(rows, 65)


def test_signature_estimates():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(150, 1150, dtype=np.uint64)
    same = (minhash.minmax(minhash.mix(a)) == minhash.minmax(minhash.mix(b))).mean()
    assert abs(same - 850 / 1150) < 0.12


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, universe in ((0, 10), (1, 1), (500, 600), (3000, 10**12), (2000, 2001)):
        v = np.unique(rng.integers(0, universe, n))
        arrays, meta = eliasfano.encode(v, universe, "s")
        s = eliasfano.Sequence(arrays, meta, "s")
        assert s.all().tolist() == v.tolist()
        ask = np.concatenate([v, rng.integers(0, universe, 300)]).astype(np.int64)
        at = {x: k for k, x in enumerate(v.tolist())}
        assert s.find(ask).tolist() == [at.get(x, -1) for x in ask.tolist()]
        if len(v) > 1:
            assert [x.tolist() for x in s.get(np.arange(len(v) - 1))] == [v[:-1].tolist(), v[1:].tolist()]
        lo, hi = rng.integers(0, len(v) + 1, (2, len(ask)))
        assert s.find(ask, lo, hi).tolist() == [at[x] if x in at and a <= at[x] < b else -1 for x, a, b in zip(ask.tolist(), lo.tolist(), hi.tolist())]


@pytest.mark.parametrize("shard_tokens", [3_000_000, 2_000])
def test_language_model(spark, docs, odd, empty, monkeypatch, shard_tokens):
    monkeypatch.setattr(lm, "SHARD_TOKENS", shard_tokens)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    token = {i: [*WORD.findall(low(t or "")), "\n"] for i, t in rows}
    train = [i for i in token if zlib.crc32(str(i).encode()) % 7 != 2]
    c1, c2, c3 = Counter(), Counter(), Counter()
    for i in train:
        s = ["\n", "\n", *token[i]]
        for k in range(2, len(s)):
            c1[s[k]] += 1
            c2[s[k - 1], s[k]] += 1
            c3[s[k - 2], s[k - 1], s[k]] += 1
    n, v = sum(c1.values()), len(c1)
    d1, d2, d3 = (lm.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]) for c in (c1, c2, c3))
    off = lambda d, c: d[min(c, 3) - 1] if c else 0
    t1, f1, t2, f2 = Counter(), Counter(), Counter(), Counter()
    for (a, _), c in c2.items():
        t1[a] += c
        f1[a] += off(d2, c)
    for (a, b, _), c in c3.items():
        t2[a, b] += c
        f2[a, b] += off(d3, c)
    free = sum(off(d1, c) for c in c1.values()) / n
    got = lm.lm_scores(docs).collect()
    assert len(got) == len(rows)
    held = [0.0, 0.0]
    for r in got:
        s, base, score = ["\n", "\n", *token[r.doc_id]], 0.0, 0.0
        for k in range(2, len(s)):
            a, b, w = s[k - 2 : k + 1]
            base += math.log10((c1[w] + 1) / (n + v + 1))
            p = (c1[w] - off(d1, c1[w])) / n + free / (v + 1)
            p = (c2[b, w] - off(d2, c2[b, w]) + f1[b] * p) / t1[b] if t1[b] else p
            p = (c3[a, b, w] - off(d3, c3[a, b, w]) + f2[a, b] * p) / t2[a, b] if t2[a, b] else p
            score += math.log10(p)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id not in train, len(s) - 2, sum(w in c1 for w in token[r.doc_id]), n)
        assert abs(r.base_score - base) < 1e-6 * len(s) and abs(r.score - score) < 0.02 * len(s)
        if r.held_out:
            held = [held[0] + r.base_score, held[1] + r.score]
    assert held[1] > held[0]
    assert lm.lm_scores(odd).count() == odd.count() and lm.lm_scores(empty).count() == 0
    assert lm.lm_scores(docs.where("crc32(cast(doc_id as string)) % 7 = 2")).where("n_known = 0 and score = 0").count() == sum(i not in train for i in token)


def test_crc32c():
    data = np.frombuffer(b"123456789" + bytes(32) + bytes(range(256)) * 9, np.uint8)
    got = crc32c.crc32c(data, np.array([0, 9, 3, 41]), np.array([9, 32, 0, 2304]))
    assert [hex(x) for x in got[:3]] == ["0xe3069283", "0x8a9136aa", "0x0"]

    def slow(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert int(got[3]) == slow(data[41:].tobytes())


def test_records(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    marked = spark.createDataFrame([(1, "hi <|endoftext|> x"), (2, "plain"), (3, "<|endoftext|>"), (4, None), (5, "<|endoftext |> no")], "doc_id long, text string")
    for frame in (docs, odd, marked):
        got = records.token_records(frame, path).collect()
        got.sort(key=lambda r: r.start)
        assert [r.doc_id for r in got] == sorted([r.doc_id for r in got], key=lambda i: (i is not None, i))
        want, start = Counter(), 0
        for r in frame.collect():
            ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
            want[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
        for r in got:
            assert r.start == start
            start += r.n_tokens
    assert records.token_records(empty, path).count() == 0
    with pytest.raises(TypeError):
        records.token_records(docs.withColumn("doc_id", docs.doc_id.cast("string")), path)


def test_records_take_large_steps_and_look_words_up_once():
    """Small batches are encoded together; a chunk that is a known word is looked up once, not matched again."""
    batch = pa.RecordBatch.from_pydict({"i": pa.array([1, 2]), "x": pa.array(["der Hund", None])})
    assert [(len(i), x.to_pylist()) for i, x in records.full(iter([batch] * 3), 1 << 20)] == [(6, ["der Hund", None] * 3)]
    assert [len(i) for i, _ in records.full(iter([batch] * 3), 1)] == [2, 2, 2] and list(records.full(iter([]), 1)) == []
    enc = records.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = pa.array([" zwölf Hund, 12 \u00e9t\u00e9\n x", None, "", "a  b", " ", "it's 3.5\t\x07ok", "\x00 \u2028x"])
    want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
    for _ in range(2):
        flat, ends = enc.encode(texts)
        assert [x.tolist() for x in np.split(flat, ends[:-1])] == want
    seen = []
    enc.find = lambda chunk: seen.append(chunk) or []
    assert enc.encode(pa.array([" zwölf 12"]))[0].tolist() == enc.tokenizer.encode(" zwölf 12", add_special_tokens=False).ids
    assert seen == [""]
    assert [len(x) for x in enc.encode(pa.array([], pa.string()))] == [0, 0]


def test_records_notice_damage():
    data, sizes = records.frame([1, None], np.array([5, 6, 70000], np.uint32), np.array([2, 3]))
    raw = np.frombuffer(data, np.uint8)
    ids, tokens = records.parse(raw, np.cumsum(sizes) - sizes)
    assert ids == [1, None] and [x.tolist() for x in tokens] == [[5, 6], [70000]]
    for at in (0, 9, 20, len(raw) - 1):
        bad = raw.copy()
        bad[at] ^= 1
        with pytest.raises((ValueError, IndexError)):
            records.parse(bad, np.cumsum(sizes) - sizes)


def test_quality(spark, docs, odd, empty):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    for frame in (docs, odd):
        for r, text in zip(quality.quality_verdicts(frame, labels).orderBy("doc_id", "n_words").collect(), [x.text or "" for x in sorted(frame.collect(), key=lambda x: (x.doc_id is not None, x.doc_id or 0))]):
            w = WORD.findall(text)
            held = [x for x in text.split("\n") if WORD.search(x)]
            grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
            many = Counter(grams)
            hit = {k + j for k, g in enumerate(grams) if many[g] > 1 for j in range(3)}
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(held) - len(set(held)), len(hit))
            failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
            assert r.base_failed == failed and not (failed and r.kept)
    assert quality.quality_filter(odd, labels).columns == odd.columns
    assert quality.quality_verdicts(empty, labels).count() == 0 and quality.quality_verdicts(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_quality_verdicts_by_brute_force(spark, docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    twice = labels.union(labels.where("quality = 1").limit(3).selectExpr("doc_id", "0", "toxic"))  # labelled both ways
    for known in (labels, twice):
        got = {r.doc_id: r for r in quality.quality_verdicts(docs, known).collect()}
        stats = quality.with_statistics(docs.select("doc_id", "text"))
        model = quality.fit(stats, known)
        f, paths = model.forest, {}
        for r in stats.collect():
            x, total = quality.features(np.array([[r[c] for c in quality.COUNTS + quality.EXTRA]]))[0], 0.0
            for feature, value, left, length in zip(f.feature, f.value, f.left, f.length):
                at = 0
                while feature[at] >= 0:
                    at = left[at] + (1 if x[feature[at]] >= value[at] else 0)
                total += length[at]
            paths[r.doc_id] = 2.0 ** (-total / len(f.feature) / f.scale)
        assert all(abs(got[i].anomaly - p) < 1e-9 for i, p in paths.items())
        poor, good = set(), set()
        for r in known.collect():
            (good if r.quality else poor).add(r.doc_id)
        good -= poor
        over = lambda ids, t: np.mean([paths[i] >= t for i in ids if i in paths and not got[i].base_failed])
        fine = [t / quality.BINS for t in range(quality.BINS) if over(good, t / quality.BINS) <= quality.GOOD_LOSS]
        best = max(fine, key=lambda t: (over(poor, t) - over(good, t), -t))
        assert model.threshold == (best if over(poor, best) > over(good, best) else 2.0)
        assert all(r.kept == (not r.base_failed and paths[i] < model.threshold) for i, r in got.items())


def test_forest_finds_outliers():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(2000, 8))
    forest = quality.Forest.grow(rows)
    assert forest.score(np.full((1, 8), 9.0))[0] > np.quantile(forest.score(rows), 0.999)


def test_byte_bpe(spark, docs, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = wordshuffle.encoding_of(path, public_tokenizers.PATTERN)
    for frame in (docs, odd):
        want = Counter()
        for r in frame.collect():
            ids = np.array(enc.encode_ordinary(r.text or ""), "<u4")
            want[r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        got = wordshuffle.bpe_round_trip(frame, path, public_tokenizers.PATTERN).collect()
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(r.decoded == (r.text or "") for r in wordshuffle.bpe_ids(odd, path, public_tokenizers.PATTERN).collect())
    assert wordshuffle.bpe_ids(empty, path, public_tokenizers.PATTERN).count() == 0


def test_array_files(tmp_path):
    uri = f"file://{tmp_path}/a/b.bin"
    shared.write_arrays(uri, {"x": np.arange(5), "y": np.zeros(0, np.uint8)}, {"k": 1})
    arrays, meta = shared.open_arrays(uri)
    assert arrays["x"].tolist() == [0, 1, 2, 3, 4] and len(arrays["y"]) == 0 and meta == {"k": 1}


def test_broadcast_needs_a_proven_size(spark):
    small = spark.range(10)
    assert "broadcast" in shared.broadcast_if_small(small)._jdf.queryExecution().logical().toString().lower()
    assert shared.broadcast_if_small(small, limit=10) is small
    assert shared.broadcast_if_small(spark.range(300_000)).schema and "Broadcast" not in spark.range(10).join(shared.broadcast_if_small(spark.range(300_000)), "id")._jdf.queryExecution().analyzed().toString()
    assert shared.measured_bytes(spark.createDataFrame([("x" * 1000, [1, 2])], "a string, b array<long>")) >= 1032


def test_registered_queries_agree_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        got = registry.QUERIES[name](spark, DIR)
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(got.columns)
        assert Counter(map(tuple, got.select(*columns).collect())) == Counter(found.fetchall()), name


CONTRACT = {
    1: "page_id host path rule verdict", 2: "doc_id size text_crc32 law shard slot grown_shard", 3: "doc_id item_id", 4: "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    5: "doc_id text", 6: "doc_id n_shingles component_id kept", 7: "doc_id held_out n_tokens n_known train_tokens base_score score", 8: "doc_id start n_tokens ids_crc32",
    9: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 10: "doc_id n_tokens ids_sha256 decoded_sha256",
    11: "lang source part item value rank", 12: "vec_id code error label_error codebooks_sha256", 13: "doc_id fingerprint component_id",
}
#: Columns that the contract calls long.
LONGS = set("value error label_error n_turns loss_chars formatted_chars size text_crc32 slot n_shingles n_tokens n_known train_tokens start ids_crc32 n_words word_chars n_symbols n_dup_lines n_repeat_words".split())


def awkward(spark, folder, rows):
    """A folder of tables with nulls, repeats, empty and long texts (or with none) that queries read."""
    long = "word " * 40_000 + "end"
    texts = [None, "", " ", "a", long, "line one here\nline two here\nline one here", "same text stands here", "same text stands here", "# $ % | <tag>"]
    docs = [(None if k == 3 else k, t, None, None if k % 2 else "s", None) for k, t in enumerate(texts)] + [(1, "", None, "s", 0), (None, None, None, None, None)]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "pages": ([(1, None, None), (2, "", ""), (3, "http://a.net/x", None), (3, "http://a.net/x", None), (None, "x://", "<p>")], "page_id long, url string, html string"),
        "benchmark": ([(1, None), (None, "word word word word word word"), (2, "")], "item_id long, text string"),
        "labels": ([(1, None, None), (None, 1, 0), (2, 0, 1), (2, 1, 1)], "doc_id long, quality int, toxic int"),
        "embeddings": ([(None, [0.5] * 8, None), (1, None, 1), (2, [], 2), (3, [None] * 8, None), (4, [float("nan")] * 8, 1), (5, [0.25] * 8, None), (5, [0.25] * 8, None)], "vec_id long, embedding array<float>, label int"),
        "conversations": ([(None, None, None, None), (1, 0, "assistant", ""), (1, 0, "assistant", ""), (2, 1, None, long)], "conv_id long, turn long, role string, text string"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data if rows else [], schema).write.parquet(f"{folder}/{name}.parquet")
    return f"file://{folder}", len(docs)


def test_registered_queries_take_awkward_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    folder, n = awkward(spark, tmp_path / "full", True)
    bare, _ = awkward(spark, tmp_path / "bare", False)
    for name, query in registry.QUERIES.items():
        got = query(spark, folder)
        assert set(CONTRACT[int(name[2:].split("_")[0])].split()) <= set(got.columns)
        assert all(f.dataType.simpleString() == "bigint" for f in got.schema if f.name in LONGS), name
        found = got.collect()
        if name.split("_")[0] in ("op2", "op5", "op6", "op7", "op8", "op9", "op10", "op13"):
            assert len(found) == n, name
        if name.startswith("op12"):
            assert len(found) == 3
        assert query(spark, bare).count() == (1 if name.startswith("op4") else 0)
    assert p.run(spark, folder).count() <= n and p.run(spark, bare).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        after = shared.cut(stage(spark, docs, DIR), name)
        assert sorted(after.columns) == sorted(p.COLUMNS)
        before, kept = [(r.doc_id, r.text, r.source) for r in docs.collect()], {r.doc_id: r.text for r in after.collect()}
        if name == "quality_rules":
            verdicts = quality.quality_verdicts(docs, spark.read.parquet(f"{DIR}/labels.parquet"))  # itself held against brute force
            want = {r.doc_id for r in verdicts.where("kept").collect()}
            assert kept == {i: t for i, t, _ in before if i in want} and len(want) < len(before)
        elif name == "line_dedup":
            assert kept == {i: t for i, (t, _) in brute_strip(before).items()}
            assert all(r.n_chars == len(r.text) for r in after.collect())
        elif name == "minhash_near_dedup":
            want = {i for i, (_, c) in brute_near([x[:2] for x in before], 80).items() if i == c}
            assert kept == {i: t for i, t, _ in before if i in want}
        else:
            bad = {x[0] for x in brute_leaks([x[:2] for x in before], bench)}
            assert kept == {i: t for i, t, _ in before if i not in bad} and bad
        docs = after
    enc = wordshuffle.encoding_of(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = {r.doc_id: enc.encode_ordinary(r.text) for r in docs.collect()}
    last = p.STAGES[-1][1](spark, docs, DIR).collect()
    assert {r.doc_id: (r.n_tokens, r.token_ids) for r in last} == {i: (len(t), t) for i, t in want.items()}
    assert {r.doc_id: r.decoded_sha256 for r in last} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}
    assert [n for n, _ in p.STAGES] == ["quality_rules", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    assert {q.split("_")[0] for q in registry.QUERIES} == {f"op{k}" for k in range(1, 14)}


def test_sql_of_line_dedup(spark):
    import duckdb

    from quire.llm.oracles import ORACLE_SQL

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    got = registry.QUERIES["op5_line_dedup"](spark, "/root/testdata/sf0.01").collect()
    assert Counter(tuple(r) for r in got) == Counter(con.sql(ORACLE_SQL["op5_line_dedup"]).fetchall())


def test_urls_link_forms(spark):
    bad = "http://b.net/t"
    rows = [
        (1, "http://a.org/1", f'<link data-href="http://c.org/" href="{bad}" rel="nofollow Canonical">'), (2, "http://a.org/x/y?q", '<link rel=canonical href="?p=1">'), (3, "http://b.org/x/y?p=1", '<base href="//b.net/x/z"><link rel=canonical href="../t">'),
        (4, "http://c.org/4", f'<!-- <link rel="canonical" href="{bad}"> --><p>'), (5, "http://c.org/5", f'<script>"<link rel=canonical href={bad}>"</script>'), (6, "http://c.org/6", "<link rel=canonical href='http&#58;&#x2F;&sol;b.net/t'>"),
        (7, "http://c.org/7", '<link rel="canonical" href="mailto:x@b.net">'), (8, "http://c.org/8", f'<link rel="canonicals" href="{bad}"><link rel=alternate href="{bad}">'), (9, "http://a.org/x/y?p=1", f"<META content=\"0;URL='{bad}'\" HTTP-EQUIV=Refresh>"),
        (10, "http://c.org/10", '<link rel=canonical href="http://d.org/&amp;#47;">'), (11, "http://d.org/&#47;", f'<link rel=canonical href="{bad}">'), (12, "http://d.org//", ""), (13, "http://e.org/é", f'<link href={bad} rel=canonical>'), (14, "http://c.org/14", "<link rel=canonical href=http://e.org/&#233;>"),
        (15, "http://c.org/15", f'<!-- open <link rel="canonical" href="{bad}">'), (16, "http://c.org/16", '<link rel="canonical" href="http://z.org/&#xD800;&#0;&bogus;">'),
    ]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k for k, v in got.items() if v == "block"} == {1, 2, 3, 6, 9, 10, 11, 13, 14}


def test_language_model_keeps_small_values():
    p = np.concatenate([10.0 ** -np.arange(0, 20, 0.37), [0.0, 8.5e-10, 3e-9]])
    for step, grid in ((lm.P_STEP, lm.P_GRID), (lm.L_STEP, lm.L_GRID)):
        w = lm.coded_values("x", p, step)
        got = lm.value_at(w, "x", np.arange(len(p)), grid)
        assert (got[p == 0] == 0).all() and np.abs(np.log10(got[p > 0] / p[p > 0])).max() <= 0.02
    many = 10**10  # a context seen so often, with one successor seen once and one seen twice
    d = [0.5, 1.0, 1.5]
    w = lm.weights_of(np.array([many - 3, 1, 2, 1]), np.array([many - 3, 1, 1, 2, 1]), np.array([0, 3, 4]), np.array([0, 1, 2, 4, 5]), d, d, [])
    at = np.arange(4)
    want = np.array([(many - 4.5) / many, 0.5 / many, 1.0 / many, 0.5])
    assert np.abs(np.log10(lm.value_at(w, "p2", at, lm.P_GRID) / want)).max() < 0.02
    assert np.abs(np.log10(lm.value_at(w, "l1", np.arange(2), lm.L_GRID) / [3.0 / many, 0.5])).max() < 0.02
    whole = lm.value_at(w, "p2", at[:3], lm.P_GRID).sum() + lm.value_at(w, "l1", np.zeros(1, int), lm.L_GRID)[0]
    assert abs(whole - 1) < 0.02
    # a word whose pairs lie in two shards: its totals come from both
    w = lm.weights_of(np.array([1]), np.array([1]), np.array([0, 1]), np.array([0, 1]), d, d, [(0, many, 1, 1, 1)])
    assert abs(np.log10(lm.value_at(w, "p2", np.zeros(1, int), lm.P_GRID)[0] / (0.5 / many))) < 0.02
    assert abs(np.log10(lm.value_at(w, "l1", np.zeros(1, int), lm.L_GRID)[0] / (3.0 / many))) < 0.02


def test_bpe_ids_come_in_slices(spark, docs, odd, monkeypatch):
    vocabulary, rows = registry.vocabulary("byte_bpe_50k.tiktoken"), {}
    for most in (1, 700, 500_000):
        monkeypatch.setattr(wordshuffle, "POSITIONS", most)
        rows[most] = [Counter(map(str, wordshuffle.bpe_ids(x, vocabulary, public_tokenizers.PATTERN).select("doc_id", "token_ids", "decoded").collect())) for x in (docs, odd)]
    assert rows[1] == rows[700] == rows[500_000]
