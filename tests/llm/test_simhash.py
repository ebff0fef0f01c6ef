"""SimHash by anchor points against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from quire.llm import registry, simhash
from tests.llm.test_operators import ODD, WORD, docs, empty, low, odd  # noqa: F401


def brute_print(text):
    w = WORD.findall(low(text or ""))
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_names(rows):
    """{row: smallest id reached}; rows (id, fingerprint) with one id are one node."""
    near = defaultdict(set)
    for a, x in rows:
        for b, y in rows:
            if (x ^ y).bit_count() <= 4:
                near[a].add(b)
    out = {}
    for a in sorted(near):
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = a
                todo += near[x]
    return out


def test_golay_code_is_perfect():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 300)
    at, anchor, home = simhash.anchors(words)
    far = np.array([int(a).bit_count() for a in words[at] ^ anchor])
    assert (simhash._remainder(anchor) == 0).all() and (far[home] <= 3).all() and (far[~home] == 4).all() and home.sum() == 300
    code = np.flatnonzero(simhash._remainder(np.arange(1 << 23)) == 0)
    assert len(code) == 4096
    for k in range(20):
        want = {int(c) for c in code if int(c ^ words[k]).bit_count() <= 4}
        assert set(anchor[at == k].tolist()) == want


@pytest.mark.parametrize("deep, block", [(simhash.DEEP, simhash.BLOCK), (1 << 17, 3), (4, 2)])
def test_all_links_are_found(spark, deep, block):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 12, dtype=np.uint64)
    rows = [int(b) for b in base]
    for b in base.tolist():
        for _ in range(30):
            for k in rng.choice(64, rng.integers(1, 12), replace=False):
                b ^= 1 << int(k)
            rows.append(b)
    rows = list(dict.fromkeys([0, 1, 15, 31, 63, (1 << 64) - 1, *rows]))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    classes = spark.createDataFrame([(k, signed(x)) for k, x in enumerate(rows)], "cid long, fp long").repartition(3)
    found = simhash.links(classes, deep, block)
    got = {r.node: r.component for r in simhash.connected_components(found, "a", "b").collect()}
    want = brute_names(list(enumerate(rows)))
    assert {k: got.get(k, k) for k in range(len(rows))} == want and len(set(want.values())) > 12


def test_simhash_by_brute_force(spark, docs, odd, empty):  # noqa: F811
    for frame in (docs, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        rows = [(r.doc_id, brute_print(r.text)) for r in frame.select("doc_id", "text").collect()]
        names = brute_names(rows)
        got = Counter(tuple(r) for r in simhash.simhash_duplicates(frame).collect())
        assert got == Counter((i, f"{x:016x}", names[i]) for i, x in rows)
        assert len(set(names.values())) < len(rows)
    got = simhash.simhash_duplicates(odd).collect()
    rows = [(r.doc_id, brute_print(r.text)) for r in odd.collect()]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{x:016x}") for i, x in rows)
    names = brute_names([(1000 if i is None else i, x) for i, x in rows])
    assert {r.doc_id: r.component_id for r in got} == {i: names[i] for i, _ in rows if i is not None} | {None: None}
    assert {r.fingerprint for r in got if r.doc_id in (0, 1, 2)} == {"0" * 16} and {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert simhash.simhash_duplicates(empty).count() == 0


def test_one_id_with_two_texts_joins_their_classes(spark):
    rows = [(5, "a b c d e"), (9, "a b c d e"), (9, "v w x y z"), (7, "v w x y z"), (3, "other words of another text"), (None, "v w x y z"), (None, None)]
    got = Counter((r.doc_id, r.component_id) for r in simhash.simhash_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect())
    assert got == Counter([(5, 5), (9, 5), (9, 5), (7, 5), (3, 3), (None, 5), (None, None)])


def test_long_texts_span_slabs():
    many = np.array([0, 70_000, 3, 0, 140_000, 1], np.int64)
    h = np.random.default_rng(2).integers(0, 1 << 64, many.sum(), dtype=np.uint64)
    got = simhash.majority(h, many)
    ends = np.cumsum(many)
    for k, n in enumerate(many.tolist()):
        own = h[ends[k] - n : ends[k]]
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * int((own >> np.uint64(b) & np.uint64(1)).sum()) > n)


def test_registered(spark):
    assert registry.QUERIES["op13_simhash"](spark, "/root/testdata/sf0.001").columns == ["doc_id", "fingerprint", "component_id"]
