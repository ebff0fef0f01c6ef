"""Source divergence audit: how the term rates of each language's sources differ, in exact integers.

Terms are runs of ASCII letters and of all that is not ASCII, A-Z lower-cased; nulls read as ''. A
language keeps the V terms that at least ``LEAST`` of its documents hold. A group (language, source), or
a whole language, gives a kept term p = 1 + floor(10^9 (count + 5) / (N + 5 V)).

Integer-dictionary encoding, all of it distributed:
1. Tasks count the documents of each (language, term) in their texts; Spark adds the counts up. Kept
   terms, range-partitioned and sorted by language and UTF-8 bytes, become one file of sorted arrays for
   each range in the shared folder. A term's id is its rank in its language, so ids keep UTF-8 order.
2. Tasks read the texts again, search each distinct term of a step in the sorted arrays and count ids by
   group with bincount. What leaves a task is one packed vector for each group and chunk of ``chunk``
   neighbouring ids; vectors of one group and chunk are merged as they meet.
3. The vectors of all groups of a language meet chunk by chunk, as dense rows: sums of |p - q| for every
   two sources come from row differences, the leading terms of each group from a sort by value and id
   (ties go to the lower id, which is the lower term). Sums and leaders of chunks are then put together.

A chunk is ``CHUNK`` ids or fewer, if a language has so many sources that ``DENSE`` cells are exceeded. A
language without kept terms has one empty chunk, so its pairs are there with value 0. Every pair of
sources is a row of the result: it grows with the square of a language's sources, as asked for. Counts
up to 9 * 10^15 are exact.

Repeated rows count as often as they occur. Rows need no id; columns other than text, language and source
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import shared
from quire.llm.packs import pack, unpack
from quire.llm.words import STEP_BYTES, coded, plain, split

LEAST, ADDED, UNIT, TOP = 30, 5, 1_000_000_000, 50
CHUNK, DENSE = 1024, 1 << 23
#: Bytes of a term that are compared at once; longer ones are settled one by one.
KEY = 24
#: Vectors that a counting task holds before it hands them on.
HELD = 4096
#: Bytes of kept terms for each file of the dictionary.
PART_BYTES = 64 << 20


def _letters() -> np.ndarray:
    """Each byte's image: letters lower-cased, bytes of other than ASCII as they are, all else a space."""
    out = np.full(256, 32, np.uint8)
    for b in range(256):
        if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122:
            out[b] = b + 32 if 65 <= b <= 90 else b
    return out


LETTERS = _letters()


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of all texts in order, and each text's end in them."""
    x = plain(texts)
    _, offsets, data = x.buffers()
    if data is None or not len(data):
        return split(x, lower=False)
    image = pa.py_buffer(LETTERS[np.frombuffer(data, np.uint8)])
    return split(pa.LargeStringArray.from_buffers(len(x), offsets, image, offset=x.offset), lower=False)


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows (text, lang, source) of a bounded size."""
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(0)), 0)).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + STEP_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _numbered(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Each row's number among the distinct values, and these."""
    code, distinct = coded(column)
    return code, distinct.to_pylist()


def _rows(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return docs.select(text(text_col).alias("x"), text(lang_col).alias("lang"), text(source_col).alias("source"))


def document_counts(rows: DataFrame) -> DataFrame:
    """(lang, term, n): documents that hold the term, counted in tasks and then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in _steps(batch):
                words, ends = terms(step.column(0))
                code, distinct = coded(words)
                lang, langs = _numbered(step.column(1))
                v = max(len(distinct), 1)
                doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
                once = np.unique(doc * v + code)
                key, n = np.unique(lang[once // v] * v + once % v, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(key // v)), distinct.cast(pa.string()).take(pa.array(key % v)), pa.array(n)], names=["lang", "term", "n"])

    shared.bound_batches(rows.sparkSession)
    found = rows.mapInArrow(shared.lean(run), "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def write_dictionary(kept: DataFrame, folder: str, parts: int) -> DataFrame:
    """Files of sorted kept terms; the index (lang, part, at, n): each language's run in each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k, every = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if not every:
            return
        t = pa.Table.from_batches(every)
        words = [w.encode() for w in t.column("term").to_pylist()]
        langs = t.column("lang").to_pylist()
        cuts = [0, *(i for i in range(1, len(langs)) if langs[i] != langs[i - 1]), len(langs)]
        arrays = {"key": np.array([w[:KEY] for w in words], f"S{KEY}").view(np.uint8), "end": np.cumsum([len(w) for w in words]), "bytes": np.frombuffer(b"".join(words), np.uint8)}
        shared.write_arrays(f"{folder}/terms-{k:05d}.bin", arrays)
        rows = [{"lang": langs[a], "part": k, "at": a, "n": b - a, "first": words[a].decode()} for a, b in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("lang", pa.string()), ("part", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), ("first", pa.string())]))

    sorted_ = kept.select("lang", "term").repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term")
    return shared.cut(sorted_.mapInArrow(shared.lean(run), "lang string, part int, at long, n long, first string"), "terms-index")


class Dictionary:
    """A language's ids of kept terms. The index has a row for each language and file."""

    def __init__(self, folder: str):
        _, meta = shared.open_arrays(f"{folder}/index.bin")
        self.folder, self.of, self.size = folder, {}, {}
        for lang, part, at, n, first in sorted(meta["index"], key=lambda r: r[1:3]):
            begin = self.size.get(lang, 0)
            self.of.setdefault(lang, []).append((first.encode(), begin, part, at, n))
            self.size[lang] = begin + n

    def _run(self, part: int, at: int, n: int):
        arrays, _ = shared.open_cached(f"{self.folder}/terms-{part:05d}.bin")
        return arrays["key"].view(f"S{KEY}")[at : at + n], arrays["end"][at : at + n], arrays["end"][at - 1] if at else 0, arrays["bytes"]

    def find(self, lang: str, words: list[bytes]) -> np.ndarray:
        """The id of each of these terms in the language, -1 if it isn't kept."""
        out = np.full(len(words), -1, np.int64)
        runs = self.of.get(lang, [])
        firsts = [r[0] for r in runs]
        own = np.array([bisect_right(firsts, w) for w in words], np.int64) - 1 if len(runs) > 1 else np.zeros(len(words), np.int64)
        for k, (_, begin, part, at, n) in enumerate(runs):
            which = np.flatnonzero(own == k)
            key, end, base, data = self._run(part, at, n)
            q = np.array([words[i][:KEY] for i in which], f"S{KEY}")
            lo = np.searchsorted(key, q)
            good = key[np.minimum(lo, n - 1)] == q
            out[which[good]] = begin + lo[good]
            for i, x in zip(which[good].tolist(), lo[good].tolist(), strict=True):
                if len(words[i]) < KEY:
                    continue
                y = int(np.searchsorted(key, words[i][:KEY], "right"))
                text = lambda j: data[(end[j - 1] if j else base) : end[j]].tobytes()  # noqa: B023, E731
                x = bisect_left(range(n), words[i], x, y, key=text)
                out[i] = begin + x if x < y and text(x) == words[i] else -1
        return out

    def terms(self, lang: str, ids: np.ndarray) -> list[str]:
        runs = self.of[lang]
        begins, out = [r[1] for r in runs], []
        for i in ids.tolist():
            _, begin, part, at, n = runs[bisect_right(begins, i) - 1]
            _, end, base, data = self._run(part, at, n)
            j = i - begin
            out.append(data[(end[j - 1] if j else base) : end[j]].tobytes().decode())
        return out


@lru_cache(maxsize=8)
def dictionary(folder: str) -> Dictionary:
    """A worker reads the index once."""
    return Dictionary(folder)


def term_counts(rows: DataFrame, folder: str, chunk: int) -> DataFrame:
    """(lang, source, chunk, n, data): each group's packed counts of each chunk of ids that it has."""
    schema = "lang string, source string, chunk long, n long, data binary"
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("chunk", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])

    def packed(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"lang": a, "source": b, "chunk": c, "n": int(v.sum()), "data": pack([v])} for (a, b, c), v in held.items()], schema=kind)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = dictionary(folder), {}
        for batch in batches:
            for step in _steps(batch):
                words, ends = terms(step.column(0))
                code, distinct = coded(words)
                lang, langs = _numbered(step.column(1))
                source, sources = _numbered(step.column(2))
                v, data = max(len(distinct), 1), distinct.cast(pa.binary())
                lengths = np.diff(ends, prepend=0)
                pair, where = np.unique(np.repeat(lang, lengths) * v + code, return_inverse=True)
                ids = np.full(len(pair), -1, np.int64)
                for k, name in enumerate(langs):
                    a, b = np.searchsorted(pair, [k * v, (k + 1) * v])
                    ids[a:b] = known.find(name, data.take(pa.array(pair[a:b] % v)).to_pylist())
                ids = ids[where]
                group = np.repeat(lang * len(sources) + source, lengths)[ids >= 0]
                ids = ids[ids >= 0]
                wide = int(ids.max(initial=0)) // chunk + 1
                place = group * wide + ids // chunk
                order = np.argsort(place, kind="stable")
                cuts = np.flatnonzero(np.diff(place[order], prepend=-1, append=-1)) if len(place) else np.zeros(0, np.int64)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    g, c = divmod(int(place[order[a]]), wide)
                    key = (langs[g // len(sources)], sources[g % len(sources)], c)
                    counts = np.bincount(ids[order[a:b]] % chunk, minlength=chunk)
                    held[key] = held[key] + counts if key in held else counts
                if len(held) > HELD:
                    yield packed(held)
                    held = {}
        if held:
            yield packed(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                own = (row["lang"], row["source"], row["chunk"])
                ((counts,),) = unpack(row["data"])
                if own != key:
                    if key is not None:
                        out.append((key, held))
                    key, held = own, counts
                else:
                    held = held + counts
            yield packed(dict(out))
            out = []
        if key is not None:
            yield packed({key: held})

    group = ["lang", "source", "chunk"]
    met = rows.mapInArrow(shared.lean(count), schema).repartition(*group).sortWithinPartitions(*group)
    return met.mapInArrow(shared.lean(merge), schema)


def rates(count: np.ndarray, total: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(UNIT (count + ADDED) / (total + ADDED v)), three decimal digits at a time."""
    rest, below, out = count + ADDED, total + ADDED * v, np.zeros(np.shape(count), np.int64)
    for _ in range(3):  # 1000^3 is UNIT; rest stays below the divisor
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def compared(dense: DataFrame, folder: str, chunk: int) -> DataFrame:
    """(lang, source, item, term, value): of each chunk, sums of |p - q| for two sources, and leading terms."""
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("term", pa.bool_()), ("value", pa.int64())])

    def compare(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        lang, c = rows[0]["lang"], rows[0]["chunk"]
        known = dictionary(folder)
        v = known.size.get(lang, 0)
        width = max(0, min(chunk, v - c * chunk))
        sources = list(dict.fromkeys(r["source"] for r in rows))
        place = {s: k for k, s in enumerate(sources)}
        total, count = np.zeros(len(sources), np.int64), np.zeros((len(sources), width), np.int64)
        for r in rows:
            if r["data"] is None:
                total[place[r["source"]]] = r["n"]
            else:
                ((own,),) = unpack(r["data"])
                count[place[r["source"]]] = own[:width]
        if v:
            p = rates(count, total[:, None], v)
            q = rates(count.sum(0), total.sum(), v)
        else:
            p, q = np.zeros((len(sources), 0), np.int64), np.zeros(0, np.int64)
        name = pa.array(sources, pa.string())
        for i in range(len(sources) - 1):
            far = np.abs(p[i + 1 :] - p[i]).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(far), pa.string()), pa.array([sources[i]] * len(far), pa.string()), name.slice(i + 1), pa.array([False] * len(far)), pa.array(far)], schema=kind)
        for i in range(len(sources)):
            at = np.flatnonzero((count[i] > 0) & (p[i] > q))
            far = p[i][at] - q[at]
            best = np.lexsort((at, -far))[:TOP]
            items = known.terms(lang, at[best] + c * chunk) if len(best) else []
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(best), pa.string()), pa.array([sources[i]] * len(best), pa.string()), pa.array(items, pa.string()), pa.array([True] * len(best)), pa.array(far[best])], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["lang"], row["chunk"]) != (held[0]["lang"], held[0]["chunk"]):
                    yield from compare(held)
                    held = []
                held.append(row)
        if held:
            yield from compare(held)

    dense = dense.repartition("lang", "chunk").sortWithinPartitions("lang", "chunk", "source")
    return dense.mapInArrow(shared.lean(run), "lang string, source string, item string, term boolean, value long")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank: see the module's text."""
    spark = docs.sparkSession
    rows = _rows(docs, text_col, lang_col, source_col)
    folder = shared.new_folder(spark, "divergence")
    groups = shared.cut(rows.select("lang", "source").distinct(), "groups")
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    chunk = min(CHUNK, max(64, DENSE // most))
    kept = shared.cut(document_counts(rows).where(F.col("n") >= LEAST), "kept")
    parts = max(1, -(-(kept.agg(F.sum(F.octet_length("term"))).first()[0] or 0) // PART_BYTES))
    index = write_dictionary(kept, folder, parts)
    shared.write_arrays(f"{folder}/index.bin", {}, {"index": [list(r) for r in index.collect()]})
    vectors = shared.cut(term_counts(rows, folder, chunk), "vectors")
    total = vectors.groupBy(F.col("lang").alias("l"), F.col("source").alias("s")).agg(F.sum("n").alias("n"))
    size = index.groupBy(F.col("lang").alias("of")).agg(F.ceil(F.sum("n") / chunk).cast("long").alias("chunks"))
    every = groups.join(total, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")), "left").join(size, F.col("lang") == F.col("of"), "left")
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1).cast("long")) - 1)).alias("chunk")
    dense = every.select("lang", "source", chunks, F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.lit(None).cast("binary").alias("data"))
    found = shared.cut(compared(dense.union(vectors.select("lang", "source", "chunk", "n", "data")), folder, chunk), "compared")
    pair = found.where("not term").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pair = pair.union(pair.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    return ranked(pair, "pair").union(ranked(found.where("term").select("lang", "source", "item", "value"), "term").where(F.col("rank") <= TOP))
