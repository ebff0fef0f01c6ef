"""SimHash near-dedup by anchor-point covering.

A text's fingerprint has bit b set if over half of its shingles' hashes have it set. Two fingerprints
link if at most ``NEAR`` bits differ. Finding links without pairing everything:
1. The 64 bits are cut into three segments. Two linked fingerprints differ by one bit at most in one
   of them (three segments with two each would make six).
2. Anchors are the words of the binary Golay code, of 23 bits; a segment, padded with zeros, lies
   within its covering radius of 3 of exactly one anchor, its home. A fingerprint is replicated to every
   anchor within the radius plus 1, the segment's threshold: 5.3 anchors on average. So the home of one
   of two linked fingerprints is always an anchor that the other one reaches.
3. At every anchor, fingerprints that are at home meet all that reach it, on all 64 bits. An anchor
   of more than ``BLOCK`` rows is cut into blocks, of which every two meet in one group; one of more than
   ``DEEP`` is first dealt out anew by what lies outside the segment: five parts, one of which is equal
   in any two linked fingerprints. What leaves a group is one row for each fingerprint that found a link
   there, with the smallest document it reached, never pairs.
Equal fingerprints are one class, of which the smallest id takes part. The search finds every link.

Words are runs without ASCII white space, A-Z lower-cased; shingles are four words joined by a space
(a shorter text is one shingle), counted as often as they occur. A text without words, or a null one,
has fingerprint zero and is linked like any other. Ids must be integers; rows with one id are one
document, whichever of its texts links. Every row with a null id is a document of its own, shown with a
null id; a component of such rows alone has a null name. An empty table gives an empty result. Columns
other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import shared
from quire.llm.components import connected_components
from quire.llm.minhash import numbered
from quire.llm.words import split, starts, steps

SHINGLE, SEED = 4, 42
NEAR = 4
#: (lowest bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The Golay code's generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1: a fixed value.
GENERATOR, LENGTH, CHECKS = 0b101011100011, 23, 11
RADIUS = 3
BLOCK = 8192
DEEP = 1 << 17
STEP = 4 << 20
#: Rows of a comparison's left side that are held against its right side at once.
SLAB = 1 << 22


def _remainders() -> np.ndarray:
    """The remainder of x^k by the generator, for each bit k of a word."""
    out, r = [], 1
    for _ in range(LENGTH):
        out.append(r)
        r <<= 1
        if r >> CHECKS:
            r ^= GENERATOR
    return np.array(out, np.int64)


def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """By remainder: the one error pattern of weight up to 3, and those of weight 4 (-1: none), five or none."""
    rem, leader, more = _remainders(), np.zeros(1 << CHECKS, np.int64), np.full((1 << CHECKS, 5), -1, np.int64)
    level, held = [(0, 0, 0)], np.zeros(1 << CHECKS, np.int64)
    for weight in range(RADIUS + 2):
        for _, bits, r in level:
            if weight <= RADIUS:
                leader[r] = bits
            else:
                more[r, held[r]] = bits
                held[r] += 1
        level = [(k + 1, bits | 1 << k, r ^ int(rem[k])) for first, bits, r in level for k in range(first, LENGTH)]
    return leader, more


LEADER, MORE = _patterns()


def _remainder(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for k, r in enumerate(_remainders()):
        out ^= (words >> k & 1) * r
    return out


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word's place, anchor, is it home) for every anchor within ``RADIUS`` + 1 of each word of 23 bits."""
    r = _remainder(words)
    home = words ^ LEADER[r]
    at, k = np.nonzero(MORE[r] >= 0)
    every = np.arange(len(words))
    return np.concatenate([every, at]), np.concatenate([home, words[at] ^ MORE[r[at], k]]), np.repeat([True, False], [len(words), len(at)])


def shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts in order, and how many each text has."""
    words, ends = split(texts, lower=True)
    data = words.cast(pa.large_binary()).to_pylist()
    h, out, many = xxhash.xxh64_intdigest, [], []
    for a, b in zip(starts(ends).tolist(), ends.tolist(), strict=True):
        own = data[a:b]
        if len(own) < SHINGLE:
            out += [h(b" ".join(own), SEED)] if own else []
            many.append(1 if own else 0)
            continue
        line = b" ".join(own)
        edge = np.cumsum([len(w) + 1 for w in own]).tolist()
        begin = [0, *edge]
        out += [h(line[x : y - 1], SEED) for x, y in zip(begin, edge[SHINGLE - 1 :], strict=False)]
        many.append(len(own) - SHINGLE + 1)
    return np.array(out, np.uint64), np.array(many, np.int64)


def majority(h: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of each run of hashes: the bits that over half of them set."""
    ends = np.cumsum(many)
    total = np.zeros((len(many), 64), np.int64)
    for x in range(0, len(h), 1 << 16):  # a bounded slab of bits at a time; a text may span slabs
        y = min(len(h), x + (1 << 16))
        bits = np.unpackbits(h[x:y].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first, last = np.searchsorted(ends, x, "right"), np.searchsorted(ends, y - 1, "right")
        own = np.flatnonzero(many[first : last + 1]) + first
        cuts = np.maximum(ends[own] - many[own], x) - x
        total[own] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    return np.packbits(2 * total > many[:, None], axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in steps(batch.column(0), batch.column(1), STEP):
                yield pa.RecordBatch.from_arrays([ids, pa.array(majority(*shingle_hashes(texts)).view(np.int64))], names=["doc_id", "fp"])

    shared.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("x"))
    return rows.mapInArrow(shared.lean(run), "doc_id long, fp long")


def replicas(classes: DataFrame) -> DataFrame:
    """(key, home, cid, fp): each fingerprint at every anchor of every segment that it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, fp = batch.column(0), np.asarray(batch.column(1)).view(np.uint64)
            for k, (low, bits) in enumerate(SEGMENTS):
                at, anchor, home = anchors((fp >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(anchor << 2 | k), pa.array(home), cid.take(pa.array(at)), pa.array(fp.view(np.int64)[at])], names=["key", "home", "cid", "fp"])

    return classes.select("cid", "fp").mapInArrow(shared.lean(run), "key long, home boolean, cid long, fp long")


def _outside(part: int):
    """Of a row at an anchor: the bits of one of five parts of what lies outside the anchor's segment."""
    out = None
    for k, (low, bits) in enumerate(SEGMENTS):
        rest = [b for b in range(64) if not low <= b < low + bits][part :: NEAR + 1]
        mask = sum(1 << b for b in rest)
        mask = mask - (1 << 64) if mask >> 63 else mask
        own = F.col("fp").bitwiseAND(F.lit(mask).cast("long"))
        out = F.when(F.col("key").bitwiseAND(F.lit(3)) == k, own) if out is None else out.when(F.col("key").bitwiseAND(F.lit(3)) == k, own)
    return out


def _dealt(rows: DataFrame, deep: int, block: int) -> DataFrame:
    """(key, part, sub, hb, mb, home, cid, fp): rows in the groups in which they meet.

    There are at most three times 4,096 anchors, so their sizes are a bounded broadcast.
    """
    size = rows.groupBy("key").agg(F.count("*").alias("n"))
    rows = shared.cut(rows.join(F.broadcast(size), "key"), "reach")
    whole = rows.where(F.col("n") <= deep).select("key", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("sub"), "n", "home", "cid", "fp")
    parts = F.array(*[F.struct(F.lit(p).alias("part"), _outside(p).alias("sub")) for p in range(NEAR + 1)])
    over = rows.where(F.col("n") > deep).select("key", F.inline(parts), "home", "cid", "fp")
    again = over.groupBy("key", "part", "sub").agg(F.count("*").alias("n"))
    over = over.join(again, ["key", "part", "sub"]).select("key", "part", "sub", "n", "home", "cid", "fp")
    rows = whole.union(over).withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")
    at_home = rows.where("home").select("key", "part", "sub", F.col("own").alias("hb"), other, F.lit(True).alias("home"), "cid", "fp")
    reach = rows.select("key", "part", "sub", other, F.col("own").alias("mb"), F.lit(False).alias("home"), "cid", "fp")
    return at_home.withColumnRenamed("other", "mb").union(reach.withColumnRenamed("other", "hb").select(*["key", "part", "sub", "hb", "mb", "home", "cid", "fp"]))


def linked(left: np.ndarray, right: np.ndarray, cid_left: np.ndarray, cid_right: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id it reaches inside this group) of ids that link with another one here."""
    ids, where = np.unique(np.concatenate([cid_left, cid_right]), return_inverse=True)
    a, b = where[: len(left)], where[len(left) :]
    root = np.arange(len(ids))
    rows = max(1, SLAB // max(len(right), 1))
    for x in range(0, len(left), rows):
        i, j = np.nonzero(np.bitwise_count(left[x : x + rows, None] ^ right[None, :]) <= near)
        i, j = a[x + i], b[j]
        while True:
            i, j = root[i], root[j]
            open_ = i != j
            if not open_.any():
                break
            i, j = i[open_], j[open_]
            np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
            while (root[root] != root).any():
                root = root[root]
    got = np.flatnonzero(root != np.arange(len(ids)))
    return ids[got], ids[root[got]]


def links(classes: DataFrame, deep: int = DEEP, block: int = BLOCK) -> DataFrame:
    """(a, b): class ids and one smaller that each reaches, such that all linked classes are connected."""
    rows = _dealt(replicas(classes), deep, block)
    group = ["key", "part", "sub", "hb", "mb"]
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, *group).sortWithinPartitions(*group)

    def compare(t: pa.Table) -> pa.RecordBatch:
        home, cid, fp = (t.column(c).to_numpy(zero_copy_only=False) for c in ("home", "cid", "fp"))
        home = home.astype(bool)
        a, b = linked(fp[home].view(np.uint64), fp[~home].view(np.uint64), cid[home], cid[~home])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in group], 1)
            at = 0
            for c in (np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist():
                yield compare(t.slice(at, c - at))
                at = c
            rest = t.slice(at)
        if rest is not None and rest.num_rows:
            yield compare(rest)

    return rows.mapInArrow(shared.lean(run), "a long, b long").distinct()


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest id that it reaches by links)."""
    docs, top = numbered(docs, id_col)
    marks = shared.cut(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = shared.cut(marks.groupBy("fp").agg(F.min("doc_id").alias("cid")), "classes")
    # a document with several texts joins their classes, so ids of all rows are nodes only where they repeat
    twice = marks.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("doc_id")
    bridge = marks.join(twice, "doc_id", "left_semi").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("cid").alias("b"))
    found = shared.cut(links(classes).union(bridge), "links")
    labels = shared.cut(connected_components(found, "a", "b"), "labels")
    final = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select(F.col("fp").alias("f"), F.coalesce("component", "cid").alias("component_id"))
    out = marks.join(final, marks["fp"] == final["f"])
    shown = (lambda c: F.col(c)) if top is None else (lambda c: F.when(F.col(c) <= top, F.col(c)))
    return out.select(shown("doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), shown("component_id").alias("component_id"))
