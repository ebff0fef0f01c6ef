"""MinHash near-dedup by min-max hashing.

Each of ``PERMS`` permutations is evaluated once per shingle and gives two signature values, its
minimum and its maximum. Both agree with probability equal to the Jaccard similarity and are nearly
independent, so ``2 * PERMS`` values cost half the evaluations. ``BANDS`` bands of ``ROWS`` values
find candidates: a pair at similarity 0.85 shares none with probability 6e-9, one at 0.8 with 5e-6.

How links are found without pairing whole groups:
1. Documents with equal shingle sets form one class; only its smallest id goes on.
2. In each bucket every class is paired with the bucket's smallest id only; pairs are confirmed on
   the full shingle sets and confirmed links united into components.
3. What this leaves open: classes of one bucket that still lie in different components and were not
   paired. Their full sets are compared block against block inside a task, which hands on links
   only, never pairs. The components are then made final.
So every pair that shares a bucket is either confirmed, refuted, or already in one component.

A document without words or text has no shingles, is linked with nothing and kept. Ids must be
integers. Rows with one id are one document. Every row with a null id is a document of its own: it gets
a number above all ids and takes part like any other, but is shown with a null id, and a component of
such rows only has a null name; one of its rows is kept. An empty table gives an empty result. Columns
other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import shared
from quire.llm.components import connected_components
from quire.llm.words import coded, hashes, split, starts, steps

SHINGLE = 5
PERMS, ROWS, BANDS = 120, 6, 40
#: Least and most rows in a block, and most shingles on average.
BLOCK = (256, 4096)
BLOCK_SHINGLES = 1_000_000
#: Members that meet one copy of their representative's text.
MEMBERS = 64
_RNG = np.random.default_rng(20240229)
MULTIPLY = _RNG.integers(0, 1 << 32, PERMS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
ADD = _RNG.integers(0, 1 << 32, PERMS, dtype=np.uint64).astype(np.uint32)
FOLD = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1024


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; a shorter text is one shingle."""
    words, ends = split(texts, lower=True)
    code, distinct = coded(words)
    w = hashes(distinct)[code] if len(code) else np.zeros(0, np.uint64)
    n = max(len(w) - size + 1, 0)
    fold = np.zeros(n, np.uint64)
    for k in range(size):
        fold = fold * FOLD + w[k : k + n]
    fold, out = mix(fold), []
    for a, b in zip(starts(ends).tolist(), ends.tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(fold[a : b - size + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for x in w[a:b]:
                h = np.uint64((int(h) * int(FOLD) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minmax(s: np.ndarray) -> np.ndarray:
    """The 2 * PERMS signature values of a shingle set: minima, then maxima."""
    low = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    least, most = np.full(PERMS, 0xFFFFFFFF, np.uint32), np.zeros(PERMS, np.uint32)
    for k in range(0, len(low), CHUNK):
        v = low[k : k + CHUNK, None] * MULTIPLY
        v += ADD
        least, most = np.minimum(least, v.min(0)), np.maximum(most, v.max(0))
    return np.concatenate([least, most])


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    a = int(mix(s + np.uint64(1)).sum(dtype=np.uint64))
    b = int(mix(s ^ FOLD).sum(dtype=np.uint64))
    return a - (1 << 64) if a >= 1 << 63 else a, b - (1 << 64) if b >= 1 << 63 else b


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, f1, f2 (the set's fingerprint), bands."""
    kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in steps(batch.column(0), batch.column(1)):
                sets = shingle_sets(texts)
                values = np.stack([minmax(s) for s in sets])
                parts = values.reshape(len(sets), BANDS, ROWS).astype(np.uint64)
                key = np.zeros((len(sets), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    key = key * FOLD + parts[:, :, r]
                key = mix(key).view(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(key.reshape(-1)))
                marks = [fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), bands],
                    schema=kind,
                )

    shared.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("x"))
    return rows.mapInArrow(shared.lean(run), "doc_id long, n long, f1 long, f2 long, bands array<long>")


def confirm(pairs: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Those (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    Only texts that occur in a pair travel: a member's once a pair, a representative's (b) once for
    ``MEMBERS`` members. The members of a representative of many are spread over that many groups.
    """
    ids = shared.cut(pairs.select(F.col("a").alias("i")).union(pairs.select("b")).distinct(), "pair-ids")
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("x"))
    texts = texts.join(shared.broadcast_if_small(ids), "i", "left_semi")
    groups = shared.cut(pairs.groupBy(F.col("b").alias("c")).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")), "pair-groups")
    left = pairs.join(shared.broadcast_if_small(groups), F.col("b") == F.col("c")).select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), "a")
    left = left.join(texts, F.col("a") == F.col("i")).select("b", "part", "a", "x")
    right = groups.join(texts, F.col("c") == F.col("i")).select(F.col("c").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "x")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = left.union(right).repartition(n, "b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, reps = None, []
        for batch in batches:
            at = 0
            for members, texts in steps(batch.column(2), batch.column(3)):
                bs, parts = (batch.column(k).slice(at, len(members)).to_pylist() for k in (0, 1))
                at += len(members)
                found = []
                for b, part, a, s in zip(bs, parts, members.to_pylist(), shingle_sets(texts), strict=True):
                    if (b, part) != group:
                        group, reps = (b, part), []
                    if a is None:
                        reps.append(s)
                        continue
                    both = [len(np.intersect1d(s, t, assume_unique=True)) for t in reps]
                    if any(m and 100 * m >= percent * (len(s) + len(t) - m) for m, t in zip(both, reps, strict=True)):
                        found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(shared.lean(run), "a long, b long").distinct()


def _open_links(rows: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links inside buckets between components, on full sets, block against block.

    ``rows`` (key, cid, comp, n, held): a bucket of n classes with ``held`` shingles is cut into blocks
    of at most ``BLOCK[1]`` classes and about ``BLOCK_SHINGLES`` shingles, and every two blocks meet in
    one group of rows, so no task holds more than two blocks at a time.
    Only links leave a task.
    """
    block = F.greatest(F.lit(BLOCK[0]), F.least(F.lit(BLOCK[1]), F.ceil(F.col("n") / 16)))
    laid = rows.withColumn("nb", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("int")).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    ids = rows.select(F.col("cid").alias("i")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("x"))
    texts = texts.join(shared.broadcast_if_small(ids), "i", "left_semi").dropDuplicates(["i", "x"])
    laid = laid.select("key", "cid", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    laid = laid.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cid", "comp")
    laid = laid.join(texts, laid["cid"] == texts["i"]).drop("i")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = laid.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def compare(group: pa.Table) -> pa.RecordBatch:
        cid, comp, own = (np.asarray(group.column(c).combine_chunks()) for c in ("cid", "comp", "own"))
        cross = int(group.column("lo")[0].as_py()) != int(group.column("hi")[0].as_py())
        sets = shingle_sets(group.column("x").combine_chunks())
        size = np.array([len(s) for s in sets])
        start = np.cumsum(size) - size
        every = np.concatenate(sets)
        _, number = np.unique(every, return_inverse=True)
        held = np.zeros(number.max(initial=0) + 1, np.int64)
        a, b = [], []
        for i in range(len(cid) - 1):
            can = comp[i + 1 :] != comp[i]
            if cross:
                can &= own[i + 1 :] != own[i]
            if not can.any():
                continue
            mine = number[start[i] : start[i] + size[i]]
            held[mine] = 1
            both = np.add.reduceat(held[number[start[i + 1] :]], start[i + 1 :] - start[i + 1])
            held[mine] = 0
            got = np.flatnonzero(can & (100 * both >= percent * (size[i] + size[i + 1 :] - both))) + i + 1
            a += [int(cid[i])] * len(got)
            b += cid[got].tolist()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            keys = np.stack([np.asarray(t.column(c).combine_chunks()).astype(np.int64) for c in ("key", "lo", "hi")], 1)
            at = 0
            for c in (np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist():
                yield compare(t.slice(at, c - at))
                at = c
            rest = t.slice(at)
        if rest is not None and rest.num_rows:
            yield compare(rest)

    found = laid.mapInArrow(shared.lean(run), "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, int | None]:
    """``docs`` with a number above all ids wherever the id is null, and the greatest id (None: no null ids)."""
    shared.integer_id(docs, id_col)
    own = F.col(f"`{id_col}`").cast("long")
    nulls, top = docs.agg(F.count_if(own.isNull()), F.coalesce(F.max(own), F.lit(-1))).first()
    if not nulls:
        return docs, None
    if top >= (1 << 63) - (1 << 53):
        raise ValueError("the greatest id leaves no numbers for rows with a null id")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    number = (F.monotonically_increasing_id() + (top + 1)).alias(id_col)
    # written, as a number must not change when a task is run again
    lone = shared.cut(docs.where(own.isNull()).select(*[number if c == id_col else F.col(f"`{c}`") for c in docs.columns]), "no-ids")
    return docs.where(own.isNotNull()).select(*columns).withColumn(id_col, own).union(lone), top


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept (see the module's text)."""
    docs, top = numbered(docs, id_col)
    out = _near_duplicates(docs, percent, id_col, text_col)
    if top is None:
        return out
    shown = lambda c: F.when(F.col(c) <= top, F.col(c)).alias(c)
    return out.select(shown("doc_id"), "n_shingles", shown("component_id"), "kept")


def _near_duplicates(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    sets = shared.cut(signatures(docs, id_col, text_col), "signatures")
    full = sets.where("n > 0")
    classes = shared.cut(full.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("cid")), "classes")
    reps = full.join(classes.select(F.col("cid").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("cid"), F.col("n").alias("size"), "bands")
    rows = reps.select("cid", "size", F.explode("bands").alias("key"))
    groups = rows.groupBy("key").agg(F.min("cid").alias("rep"), F.max("cid").alias("last"), F.count("*").alias("n"), F.sum("size").alias("held")).where("rep <> last").drop("last")
    buckets = shared.cut(rows.join(groups, "key").where("cid <> rep").drop("size"), "buckets")
    stars = shared.cut(buckets.select(F.col("cid").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links = shared.cut(confirm(stars, docs, percent, id_col, text_col), "links")
    labels = shared.cut(connected_components(links, "a", "b"), "labels")
    named = buckets.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
    open_keys = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    open_rows = shared.cut(named.join(open_keys, "key", "left_semi").select("key", "cid", "comp", "n", "held"), "open")
    added = shared.cut(_open_links(open_rows, docs, percent, id_col, text_col), "links")
    if added.limit(1).count():
        labels = shared.cut(connected_components(links.union(added), "a", "b"), "labels")
    final = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("f1", "f2", F.col("n").alias("m"), F.coalesce("component", "cid").alias("c"))
    same = (sets["f1"] == final["f1"]) & (sets["f2"] == final["f2"]) & (sets["n"] == final["m"])
    out = sets.join(final, same, "left").select("doc_id", sets["n"].alias("n_shingles"), F.when(sets["n"] == 0, F.col("doc_id")).otherwise(F.col("c")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_dedup(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, with all columns as they were."""
    schema = docs.schema
    docs, top = numbered(docs, id_col)
    gone = shared.cut(_near_duplicates(docs, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    side = shared.broadcast_if_small(gone)
    own = F.col(f"`{id_col}`")
    stay = docs.join(side, own.cast("long") == side["__gone"], "left_anti")
    if top is None:
        return stay
    return stay.select(*[F.when(own <= top, own).cast(f.dataType).alias(f.name) if f.name == id_col else F.col(f"`{f.name}`") for f in schema])
