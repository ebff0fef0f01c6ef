"""Vector codes against SQL, plain integer arithmetic and awkward rows."""

import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from quire.llm import registry, vectorcodes
from quire.llm.oracles import ORACLE_SQL

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows):
    """{row number: (vec_id, code, error, label_error)} and the digest, one integer at a time."""
    kept = [(i, [int(np.floor(np.float64(c) * 4096)) for c in x], label) for i, x, label in rows if x and all(c is not None and np.isfinite(c) for c in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    if not kept:
        return [], None
    d = len(kept[0][1]) // 8
    books = [[x[p * d : p * d + d] for _, x, _ in kept[:16]] for p in range(8)]

    def near(p, x):
        far = [sum((a - b) ** 2 for a, b in zip(x[p * d : p * d + d], c)) for c in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(6):
        groups = [defaultdict(list) for _ in range(8)]
        for _, x, _ in kept:
            for p in range(8):
                groups[p][near(p, x)[0]].append(x[p * d : p * d + d])
        for p in range(8):
            for e, own in groups[p].items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out, by = [], defaultdict(int)
    for i, x, label in kept:
        got = [near(p, x) for p in range(8)]
        out.append((i, "".join(f"{e:02x}" for e, _ in got), sum(far for _, far in got), label))
        by[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, code, error, by[label], digest) for i, code, error, label in out), key=str), digest


def test_nearest_is_exact_on_ties_and_near_ties():
    rng = np.random.default_rng(3)
    open_rows = 0
    for size, d in ((20, 8), (5000, 8), (1 << 27, 8), (1 << 27, 64), (3, 2)):
        book = rng.integers(-size, size + 1, (16, d))
        book[5], book[9] = book[2], book[2]
        book[7] = book[3]
        book[7, 0] += 1
        x = np.concatenate([rng.integers(-size, size + 1, (400, d)), book, (book[:, None] + book[None]).reshape(-1, d) // 2])
        x = np.clip(x, -size, size)
        code, far, left = vectorcodes.nearest(x, book)
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(row, c)) for c in book] for row in x]
        assert code.tolist() == [e.index(min(e)) for e in exact] and far.tolist() == [min(e) for e in exact]
        open_rows += left
    assert open_rows > 100  # the screening leaves some to int64


def test_screening_settles_most_rows():
    x = np.random.default_rng(4).integers(-2000, 2000, (5000, 8))
    assert vectorcodes.nearest(x, x[:16])[2] < 100


@pytest.mark.parametrize("many", [0, 3, 40])
def test_awkward_rows(spark, many):
    rng = np.random.default_rng(many)
    rows = [(int(k % 30), [float(np.float32(c)) for c in rng.normal(0, 0.3, 16)], None if k % 4 == 0 else int(k % 3)) for k in range(many)]
    rows += [(50, None, 1), (51, [], 1), (52, [None] + [0.0] * 15, 1), (53, [float("nan")] * 16, 2), (54, [float("-inf")] + [0.0] * 15, 2)]
    rows += [(None, [0.25] * 16, 5), (60, [-0.0] * 16, 5), (60, [-0.0] * 16, 5)] if many else []
    rows = [r for r in rows if r[0] != 0] if many == 40 else rows
    keyed = [r for k, r in enumerate(rows) if r[0] is None or r[0] == 60 or r[0] not in [q[0] for q in rows[:k]]]
    frame = spark.createDataFrame([(*r, "clash") for r in keyed], SCHEMA).repartition(4)
    got = sorted((tuple(r) for r in vectorcodes.vector_codes(frame).collect()), key=str)
    assert got == brute(keyed)[0]


def test_lengths_and_sizes_that_cannot_be_coded(spark):
    for rows in ([(1, [0.0] * 12, 1)], [(1, [0.0] * 16, 1), (2, [0.0] * 8, 1)], [(1, [1e9] * 8, 1)]):
        with pytest.raises(Exception, match="length|divide|beyond"):
            vectorcodes.vector_codes(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()


def test_sql_and_brute_force_agree(spark):
    folder = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in registry.QUERIES["op12_vector_codes"](spark, folder).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert got == sorted(con.sql(ORACLE_SQL["op12_vector_codes"]).fetchall(), key=str) and len(got) > 50
    rows = con.sql("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    assert got == brute(rows)[0]
