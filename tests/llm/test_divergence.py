"""Source divergence against SQL and plain counting."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quire.llm import divergence, registry
from quire.llm.oracles import ORACLE_SQL
from tests.llm.test_operators import ODD, empty, low, odd  # noqa: F401

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, item string, value int"


def brute(rows, least=30, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    held, said = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = TERM.findall(low(text))
        held[lang].update(set(words))
        said[lang, source].update(words)
    out = set()
    for lang in {r[1] for r in rows}:
        kept = sorted((t for t, n in held[lang].items() if n >= least), key=str.encode)
        sources = sorted({s for a, s in said if a == lang})
        rate = lambda c: (lambda n: [1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept])(sum(c[t] for t in kept))  # noqa: B023, E731
        p = {s: rate(said[lang, s]) for s in sources}
        q = rate(sum((said[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = sorted((-sum(abs(a - b) for a, b in zip(p[s], p[o])), o.encode(), o) for o in sources if o != s)
            term = sorted((b - a, t.encode(), t) for a, b, t in zip(p[s], q, kept) if said[lang, s][t] and a > b)[:top]
            out |= {(lang, s, part, o, -f, k) for part, found in (("pair", pair), ("term", term)) for k, (f, _, o) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_sql_and_brute_force_agree(spark, folder):
    where = f"/root/testdata/{folder}"
    got = [tuple(r) for r in registry.QUERIES["op11_source_divergence"](spark, where).select("lang", "source", "part", "item", "value", "rank").collect()]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet'")
    want = con.sql(ORACLE_SQL["op11_source_divergence"]).fetchall()
    assert len(got) == len(set(got)) and set(got) == set(want) == brute(con.sql("SELECT text, lang, source FROM documents").fetchall()) and len(want) > 100


def crafted():
    rng = np.random.default_rng(11)
    words = ["A", "b", "ab", "Zoo", "naïve", "\U0001f600", "日本語", "x" * 24, "x" * 25, "x" * 24 + "y", "X" * 60, "é" * 12, "é" * 13, "\u0085", " q", "don't", "snake_case", "1a2", "[c]", "`d{e}~"]
    rows = [(k, " \n,1".join(rng.choice(words, rng.integers(0, 40))), str(rng.choice(["en", "", "日"])), str(rng.choice(["s1", "s2", "S1", "é"]))) for k in range(400)]
    rows += [(None, None, None, None), (None, None, None, "s1"), (7, "", "xx", "only"), (8, "rare words here", "yy", None), (8, "rare words here", "yy", "z"), (8, "rare words here", "yy", "z")]
    return [(*r, "clash", 3) for r in rows]


@pytest.mark.parametrize("chunk, held, part", [(divergence.CHUNK, divergence.HELD, divergence.PART_BYTES), (3, 2, 40)])
def test_awkward_terms_groups_and_chunks(spark, monkeypatch, chunk, held, part):
    monkeypatch.setattr(divergence, "PART_BYTES", part)
    monkeypatch.setattr(divergence, "DENSE", 1)
    rows = crafted()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "HELD", held)
    got = [tuple(r) for r in divergence.source_divergence(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == brute([(r[1], r[2], r[3]) for r in rows])
    assert {("yy", "z", "pair", "", 0, 1), ("yy", "", "pair", "z", 0, 1)} <= set(got) and not any(r[0] == "xx" for r in got)


def test_odd_and_empty_tables(spark, odd, empty):  # noqa: F811
    for frame in (odd, empty):
        frame = frame.withColumnRenamed("kept", "lang")
        assert {tuple(r) for r in divergence.source_divergence(frame).collect()} == brute([(r.text, r.lang, r.source) for r in frame.collect()])


def test_rates_are_exact_for_large_counts():
    count = np.array([0, 7, 10**13, 3 * 10**15, 10**15 - 1])
    for total, v in ((8 * 10**15, 10**6), (3 * 10**15 + 1, 12345)):
        assert divergence.rates(count, np.int64(total), v).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * v) for c in count]


def test_terms_of_slices():
    a = pa.array(["Ab1c", None, "é d", "", "x\u0085Y"] * 4).slice(3, 9)
    flat, ends = divergence.terms(a)
    assert flat.to_pylist() == [w for t in a.to_pylist() for w in TERM.findall(low(t or ""))]
    assert np.diff(ends, prepend=0).tolist() == [len(TERM.findall(low(t or ""))) for t in a.to_pylist()]
