"""Vector code compression: product quantisation, exact in integers, screened by float32 products.

A component x is the integer floor(``SCALE`` * x). Vectors are cut into ``PARTS`` equal consecutive
parts, each with a codebook of ``ENTRIES``, which starts as that part of the first vectors by id. Every
round assigns each part to its nearest entry and moves the entries to their parts' floored means.

Assigning: |x - c|^2 less |x|^2 is |c|^2 - 2 x.c, whose product comes from one float32 matrix product
for a batch of vectors. Its error is bounded: d products of numbers rounded once each, summed in any
order, are off by at most g |x| |c| with g = (d + 2) u / (1 - (d + 2) u), u = 2^-24 (Cauchy-Schwarz over
the sum of |x_i c_i|). An entry whose interval ends below all others' is nearest for certain. Every entry
whose interval overlaps the best is re-evaluated in int64, and equal distances go to the lower index.
So all results are those of integer arithmetic.

Rows whose vector is null or empty, or holds null, NaN or infinite components, are dropped. Vectors of
other lengths than the first one's, lengths that ``PARTS`` does not divide and integers beyond
``LARGEST`` (squares must fit) raise an error rather than give a wrong code. Fewer vectors than entries
make smaller codebooks. Null ids come after all others, equal ids by their components; repeated rows
count as often as they occur. An empty table gives an empty result.

Tasks send sums and counts per entry and position, which Spark adds up; the driver holds codebooks only
(``ENTRIES`` times the length of a vector). The integer vectors are written once to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import shared

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: The largest absolute integer: 64 squared differences of them fit in 62 bits.
LARGEST = 1 << 27
UNIT = 2.0**-24


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, v (the integers as bytes of int32), of the rows that are kept."""
    own = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), own.alias("x"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2)
            size = np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64)
            flat = x.flatten()  # null lists have no place in it
            value = np.asarray(pc.fill_null(flat, np.nan))
            whole = np.isfinite(value)
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~whole)])
            keep = (size > 0) & (bad[ends] == bad[ends - size])
            n = np.floor(np.where(whole, value, 0) * SCALE)  # a power of two: the product is exact
            if (np.abs(n) > LARGEST)[np.repeat(keep, size)].any():
                raise ValueError(f"a component of {vector_col} is beyond {LARGEST} / {SCALE}")
            data = n.astype("<i4").tobytes()
            cells = [data[4 * (e - s) : 4 * e] for e, s in zip(ends[keep].tolist(), size[keep].tolist(), strict=True)]
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(cells, pa.binary())], names=["vec_id", "label", "v"])

    shared.bound_batches(vectors.sparkSession)
    return rows.mapInArrow(shared.lean(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, v binary")


def matrix(cells: pa.Array, length: int) -> np.ndarray:
    """The vectors of a batch as int64 rows."""
    if (sizes := set(pc.unique(pc.binary_length(cells)).to_pylist())) - {4 * length}:
        raise ValueError(f"vectors of different lengths: {length} and {sorted(s // 4 for s in sizes)}")
    return np.frombuffer(b"".join(cells.to_pylist()), "<i4").reshape(-1, length).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest entry, its squared distance, and how many rows the screening left open."""
    d = x.shape[1]
    product = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    square = (book * book).sum(1)
    score = square.astype(np.float64) - 2 * product
    bound = (d + 2) * UNIT / (1 - (d + 2) * UNIT)
    long_x, long_c = np.sqrt((x * x).sum(1).astype(np.float64)), np.sqrt(square.astype(np.float64))
    # what float64 itself rounds here is far below the last factor's slack
    error = (2 * bound * (1 + 1e-6)) * long_x[:, None] * long_c[None, :] + 1e-12 * (square.astype(np.float64) + np.abs(product)) + 1e-9
    best = (score + error).min(1)
    open_ = score - error <= best[:, None]
    code = open_.argmax(1)
    left = np.flatnonzero(open_.sum(1) > 1)
    row, entry = np.nonzero(open_[left])
    exact = np.full((len(left), len(book)), np.iinfo(np.int64).max)
    exact[row, entry] = ((x[left[row]] - book[entry]) ** 2).sum(1)
    code[left] = exact.argmin(1)  # the first of equal ones
    return code, ((x - book[code]) ** 2).sum(1), len(left)


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floored means of the parts that each entry got."""
    parts, entries, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, d), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), parts * d)
            for p in range(parts):
                own = x[:, p * d : (p + 1) * d]
                code, _, _ = nearest(own, books[p])
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                total[p, used] += np.add.reduceat(own[order], first, axis=0) if len(order) else 0
                count[p] += np.bincount(code, minlength=entries)
        p, e = np.nonzero(count)
        sums = np.concatenate([count[p, e][:, None], total[p, e]], 1).reshape(-1)
        place = ((p * entries + e)[:, None] * (d + 1) + np.arange(d + 1)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums)], names=["place", "n"])

    # a row for each entry and position, whatever the number of vectors
    sums = rows.select("v").mapInArrow(shared.lean(run), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(parts * entries * (d + 1), np.int64)
    for place, n in sums:
        flat[place] = n
    flat = flat.reshape(parts, entries, d + 1)
    count = flat[:, :, :1]
    return np.where(count > 0, flat[:, :, 1:] // np.maximum(count, 1), books)


def train(rows: DataFrame) -> np.ndarray | None:
    """Codebooks (part, entry, position) for the integer vectors of :func:`integers`; None without rows."""
    first = rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()
    if not first:
        return None
    length = len(first[0].v) // 4
    if length % PARTS:
        raise ValueError(f"{PARTS} does not divide a vector of {length} components")
    start = matrix(pa.array([bytes(r.v) for r in first], pa.binary()), length)
    books = start.reshape(len(first), PARTS, length // PARTS).transpose(1, 0, 2)
    for _ in range(ROUNDS):
        books = _moved(rows, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances, summed over parts)."""
    parts, _, d = books.shape
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(2), parts * d)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                codes[:, p], far, _ = nearest(x[:, p * d : (p + 1) * d], books[p])
                error += far
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(shared.lean(run), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (summed over equal labels, nulls together), codebooks_sha256."""
    rows = shared.cut(integers(vectors, id_col, vector_col, label_col), "integers")
    books = train(rows)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = shared.cut(encode(rows, books), "codes")
    label = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    out = coded.join(shared.broadcast_if_small(shared.cut(label, "labels")), F.col("label").eqNullSafe(F.col("l")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
