"""Exported history as tables, and containment of nodes."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import containment
from quire.sources import history

A, B, C, D = ("a" * 40, "b" * 40, "c" * 40, "0123456789" * 4)


def test_change_lists_in_ranges(spark, tmp_path):
    entries = [(A, [("M", ["x.md"]), ("A", ["dir/y z.md"])]), (B, [("R100", ["old name", "M"]), ("D", [C])]), (C, [("M", ["M"]), ("M", ["é"])]), (D, [("T", [D]), ("C75", ["p", "q"])])] * 5
    raw = b"".join(c.encode() + b"\0" + b"".join(s.encode() + b"\0" + b"".join(p.encode() + b"\0" for p in ps) for s, ps in rest) for c, rest in entries)
    (tmp_path / "changes").write_bytes(raw)
    want = Counter((c, s, tuple(ps)) for c, rest in entries for s, ps in rest)
    for size in (37, 50, 64, 1000, 1 << 20):
        frame = history.changes(spark, str(tmp_path / "changes"), size)
        assert frame.rdd.getNumPartitions() == -(-len(raw) // size)
        assert Counter((r.commit, r.status, tuple(r.paths)) for r in frame.collect()) == want
    got = history.changes(spark, f"file://{tmp_path}/changes", 64).where(F.col("commit") == B)
    assert Counter((r.status, tuple(r.paths)) for r in got.collect()) == Counter({("R100", ("old name", "M")): 5, ("D", (C,)): 5})
    (tmp_path / "changes").write_bytes(b"")
    assert history.changes(spark, str(tmp_path / "changes")).count() == 0


def test_commits_and_blobs(spark, tmp_path):
    (tmp_path / "parents").write_text(f"{C} {B} {A}\n{B} {A}\n{A}\n")
    (tmp_path / "authors").write_bytes(f"{A}\0N N <n@x>\n{C}\0é <e@y>\n".encode())
    (tmp_path / "blobs").write_text(f"{D} blob {A}:x.md\n{D} tree {A}:dir\n{B}:a:b c.md missing\n")
    got = {r.commit: (r.parents, r.author) for r in history.commits(spark, str(tmp_path)).collect()}
    assert got == {A: ([], "N N <n@x>"), B: ([A], None), C: ([B, A], "é <e@y>")}
    blobs = history.blob_ids(spark, str(tmp_path))
    assert {(r.commit, r.path): r.oid for r in blobs.collect()} == {(A, "x.md"): D, (A, "dir"): None, (B, "a:b c.md"): None}
    changes = spark.createDataFrame([(A, ["x.md", "y"]), (B, ["x.md"]), (C, ["x.md"]), (C, ["x.md"])], "commit string, paths array<string>")
    order = spark.createDataFrame([(A, 0), (B, 1)], "commit string, place int")
    rows = history.blob_at(history.path_history(changes, order, spark.createDataFrame([("x.md",)], "path string")), blobs).collect()
    assert {(r.path, r.version, r.commit, r.oid) for r in rows} == {("x.md", 0, A, D), ("x.md", 1, B, None)}


def test_ancestors(spark):
    rng = np.random.default_rng(5)
    parents = {k: ([k - 1] if k % 30 else [int(rng.integers(0, k))]) + ([int(rng.integers(0, k))] if k % 11 == 0 else []) if k else [] for k in range(150)}
    parents |= {k: [k - 1] for k in range(1001, 1200)} | {1000: [77777]}  # a long chain, and a parent that isn't exported
    frame = spark.createDataFrame(list(parents.items()), "commit long, parents array<long>")
    want = set()
    for pin in (149, 60, 1199):
        todo = [pin]
        while todo:
            x = todo.pop()
            if x in parents and (pin, x) not in want:
                want.add((pin, x))
                todo += parents[x]
    got = history.ancestors(frame, spark.createDataFrame([(149,), (60,), (1199,)], "commit long"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_a_cycle_stops_the_search(spark):
    frame = spark.createDataFrame([(0, [0]), (1, [0])], "commit long, parents array<long>")
    with pytest.raises(ValueError, match="own ancestor"):
        history.ancestors(frame, frame.select("commit"))


def test_containment(spark):
    rng = np.random.default_rng(6)
    rows = [(t, p, bool(rng.random() < 0.2)) for t in range(3) for p in {tuple(int(x) for x in rng.integers(0, 12, rng.integers(0, 5))) for _ in range(150)}]
    frame = spark.createDataFrame([(t, list(p), r) for t, p, r in rows], "t int, path array<int>, r boolean")
    got = {(r.t, tuple(r.path)): None if r.root is None else tuple(r.root) for r in containment.under(frame, "t", "path", F.col("r")).collect()}
    for t, p, _ in rows:
        over = [q for u, q, r in rows if u == t and r and p[: len(q)] == q]
        assert got[t, p] == (min(over, key=len) if over else None)
