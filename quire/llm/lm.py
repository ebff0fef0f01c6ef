"""LM scoring with an Elias-Fano n-gram trie (orders 1 to 3).

Tokens are lower-cased words and one end mark a text. Words are numbered by the order of their
64-bit hashes. Building, all of it distributed:
1. Vocabulary: word counts meet by hash range; every range is one file of sorted hashes and counts.
2. Counts: a task reduces its texts to distinct pairs and triples with counts before anything moves,
   packs these by trie shard, and shards are merged where they meet. A shard holds a range of
   (first, second) word pairs chosen from the word counts so that ranges hold about equally many
   tokens; a frequent first word is spread over several shards.
3. Trie: level 2 holds, for each first word of the shard, its successors; level 3 each pair's. The
   ids of a level are made monotone by their context's place (context * V + id) and Elias-Fano
   coded; so are the pointers from a level into the next. A query takes its context's range from the
   pointers and searches the successor of its context-relative id in that range only.
4. Probabilities: absolute discounting, with discounts D1, D2, D3+ from the counts of counts of all
   n-grams of an order. Discounted probabilities and back-off weights become one byte each, on a
   logarithmic grid; those below its end, which contexts of very many tokens have, are kept exactly.
P(w|a,b) = A3 + L3 (A2 + L2 (A1 + L1 / (V + 1))), a term being absent where its n-gram is.

Shards are files in the shared folder; scoring workers memory-map them and search only where their
own n-grams lead: pages travel, not models. What the driver holds is a row a shard.

Null texts are empty (an end mark alone). Repeated rows count and score alike. A null id counts as an
empty one when rows are parted into training and held-out. No training rows: every token is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import shared
from quire.llm.eliasfano import Sequence, encode
from quire.llm.packs import pack, unpack
from quire.llm.words import coded, hashes, split, steps

END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))  # no word holds a line feed
SHARD_TOKENS = 3_000_000
STEP = 6 << 20
#: Bytes of text for each file of the vocabulary.
PART_BYTES = 256 << 20
#: Grids of the byte codes: steps of -log10. Two codes aren't on the grid: no n-gram, and a value of its own.
P_STEP, L_STEP = 28.0, 60.0
NONE, EXACT = 255, 254


def held_out(id_col: str, fold: int = 2, folds: int = 7) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


def _range(h: np.ndarray, n: int) -> np.ndarray:
    """The hash range, of n, in which a hash lies."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, begin, end) of each run of sorted keys: work by keys that are there, not by all that may be."""
    cuts = np.flatnonzero(np.diff(keys, prepend=-1, append=-1)) if len(keys) else np.zeros(0, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(keys[a]), a, b


def _rows(batches: Iterator[pa.RecordBatch]) -> dict[int, list[bytes]]:
    """Packed rows (key, data) of a task, by key."""
    out: dict[int, list[bytes]] = {}
    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out.setdefault(key, []).append(data)
    return out


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[new], np.add.reduceat(count[order], new) if len(k) else count


def _of_counts(count: np.ndarray) -> list[int]:
    """How many n-grams occur once, twice, three and four times."""
    return np.bincount(np.minimum(count, 5), minlength=6)[1:5].tolist()


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the counts of counts; within (0, k) so that every probability is positive."""
    n1, n2, n3, n4 = (max(x, 0) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    ratio = lambda a, b: a / b if b else 0.5
    d = [1 - 2 * y * ratio(n2, n1), 2 - 3 * y * ratio(n3, n2), 3 - 4 * y * ratio(n4, n3)]
    return [min(max(x, 0.05 * k), 0.98 * k) for k, x in enumerate(d, 1)]


def _discount(count: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


def coded_values(name: str, p: np.ndarray, step: float) -> dict[str, np.ndarray]:
    """Byte codes of probabilities or weights, and the places and values of those that the grid doesn't reach."""
    with np.errstate(divide="ignore"):
        c = np.rint(-np.log10(p) * step)
    code = np.where(p > 0, np.clip(c, 0, EXACT), NONE).astype(np.uint8)
    own = np.flatnonzero(code == EXACT)
    return {name: code, f"{name}_at": own, f"{name}_own": np.asarray(p, np.float64)[own]}


def value_at(weights: dict[str, np.ndarray], name: str, at: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """What :func:`coded_values` has coded at these places."""
    code = weights[name][at]
    out = grid[code]
    own = np.flatnonzero(code == EXACT)
    if len(own):
        out[own] = weights[f"{name}_own"][np.searchsorted(weights[f"{name}_at"], at[own])]
    return out


def _grid(step: float) -> np.ndarray:
    g = 10.0 ** (-np.arange(256) / step)
    g[NONE] = 0.0
    return g


P_GRID, L_GRID = _grid(P_STEP), _grid(L_STEP)


class Vocabulary:
    """Sorted word hashes in ranges; ids, counts and counts of all words before."""

    def __init__(self, folder: str, sizes: list[int], sums: list[int]):
        self.folder, self.parts = folder, len(sizes)
        self.size, self.tokens = sum(sizes), sum(sums)
        self.first, self.before = np.cumsum([0, *sizes]), np.cumsum([0, *sums])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id or -1, count, tokens of all words with a lower id) of word hashes."""
        order = np.argsort(h)
        s = h[order]
        ids, count, before = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for p, x, y in _runs(_range(s, self.parts)):
            if self.first[p] == self.first[p + 1]:
                continue
            at = order[x:y]
            a, _ = shared.open_cached(f"{self.folder}/vocabulary-{p:05d}.bin")
            k = np.minimum(np.searchsorted(a["hash"], h[at]), len(a["hash"]) - 1)
            good = a["hash"][k] == h[at]
            at, k = at[good], k[good]
            ids[at], count[at] = self.first[p] + k, a["count"][k]
            before[at] = self.before[p] + a["sum"][k] - a["count"][k]
        return ids, count, before


def build_vocabulary(texts: DataFrame, folder: str, parts: int) -> tuple[Vocabulary, list[int]]:
    """Count the words of ``texts`` (one column x); the vocabulary and its counts of counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[int, list[bytes]] = {}
        for batch in batches:
            for _, part in steps(batch.column(0), batch.column(0), STEP):
                words, ends = split(part, lower=True)
                code, distinct = coded(words)
                h = np.concatenate([hashes(distinct), [END]])
                n = np.concatenate([np.bincount(code, minlength=len(distinct)), [len(part)]])
                order = np.argsort(h)
                h, n = h[order], n[order]
                for p, x, y in _runs(_range(h, parts)):
                    packed.setdefault(p, []).append(pack([h[x:y] >> np.uint64(32), h[x:y] & np.uint64(0xFFFFFFFF), n[x:y]]))
        if packed:
            yield pa.RecordBatch.from_arrays([pa.array(list(packed), pa.int32()), pa.array([b"".join(x) for x in packed.values()], pa.binary())], names=["part", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in _rows(batches).items():
            high, low, n = (np.concatenate(x) for x in zip(*(a for r in rows for a in unpack(r)), strict=True))
            h = high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
            h, n = _summed(h, n)
            shared.write_arrays(f"{folder}/vocabulary-{p:05d}.bin", {"hash": h, "count": n, "sum": np.cumsum(n)})
            yield pa.RecordBatch.from_pylist([{"part": p, "size": len(h), "tokens": int(n.sum()), "n": _of_counts(n)}], schema=pa.schema([("part", pa.int32()), ("size", pa.int64()), ("tokens", pa.int64()), ("n", pa.list_(pa.int64()))]))

    packed = texts.mapInArrow(shared.lean(count), "part int, data binary").repartition(parts, "part")
    found = packed.mapInArrow(shared.lean(merge), "part int, size long, tokens long, n array<long>").collect()
    sizes, sums, n = [0] * parts, [0] * parts, [0] * 4
    for p, size, tokens, counts in found:
        sizes[p], sums[p] = size, tokens
        n = [a + b for a, b in zip(n, counts, strict=True)]
    return Vocabulary(folder, sizes, sums), n


class Step:
    """A step's tokens by number: texts framed by end marks, two before and one after."""

    def __init__(self, texts: pa.Array, vocabulary: Vocabulary):
        words, ends = split(texts, lower=True)
        code, distinct = coded(words)
        self.ids, self.count, self.before = vocabulary.find(np.concatenate([hashes(distinct), [END]]))
        n, docs = len(code), len(ends)
        lengths = np.diff(ends, prepend=0)
        self.doc = np.repeat(np.arange(docs), lengths + 3)
        self.seq = np.full(n + 3 * docs, len(distinct), np.int64)
        self.seq[np.arange(n) + np.repeat(3 * np.arange(docs) + 2, lengths)] = code
        start = np.cumsum(lengths + 3) - (lengths + 3)
        self.token = np.ones(len(self.seq), bool)
        self.token[start] = self.token[start + 1] = False
        self.token_at = np.flatnonzero(self.token)


def shard_of(before: np.ndarray, count: np.ndarray, second_before: np.ndarray, tokens: int, shards: int) -> np.ndarray:
    """The shard of a pair: non-decreasing in (first id, second id), whatever the word counts are."""
    q = before + count * (second_before / tokens)
    return np.minimum((q * (shards / tokens)).astype(np.int64), shards - 1)


def build_levels(texts: DataFrame, folder: str, vocabulary: Vocabulary, shards: int) -> list:
    """Count pairs and triples and write each shard's coded levels and counts; a row a shard."""
    v, tokens = vocabulary.size, vocabulary.tokens

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[int, list[bytes]] = {}
        for batch in batches:
            for _, part in steps(batch.column(0), batch.column(0), STEP):
                s = Step(part, vocabulary)
                g = s.ids[s.seq]
                pair, pair_at, inverse = np.unique(g[:-1] * v + g[1:], return_index=True, return_inverse=True)
                # the pair before position i is inverse[i - 1], the one that it ends is inverse[i - 1] too, seen from i
                at = s.token_at
                pair_count = np.bincount(inverse[at - 1], minlength=len(pair))
                context = inverse[at - 2]
                triple, triple_count = np.unique(context * v + g[at], return_counts=True)
                owner, third = np.divmod(triple, v)
                used = pair_count > 0
                used[owner] = True
                first, second = s.seq[pair_at], s.seq[pair_at + 1]
                shard = shard_of(s.before[first], s.count[first], s.before[second], tokens, shards)
                keep = np.flatnonzero(used)  # pairs across two texts go
                children = np.bincount(owner, minlength=len(pair))
                a, b = np.divmod(pair[keep], v)
                child_end = np.concatenate([[0], np.cumsum(children[keep])])
                for k, lo, hi in _runs(shard[keep]):
                    x, y = child_end[lo], child_end[hi]
                    own = [np.diff(a[lo:hi], prepend=0), b[lo:hi], pair_count[keep[lo:hi]], children[keep[lo:hi]], third[x:y], triple_count[x:y]]
                    packed.setdefault(k, []).append(pack(own))
        if packed:
            yield pa.RecordBatch.from_arrays([pa.array(list(packed), pa.int32()), pa.array([b"".join(x) for x in packed.values()], pa.large_binary()).cast(pa.binary())], names=["shard", "data"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _rows(batches)
        for k in list(rows):
            blocks = [a for r in rows.pop(k) for a in unpack(r)]
            key = np.concatenate([np.cumsum(b[0]) * v + b[1] for b in blocks])
            number = np.concatenate([b[2] for b in blocks])
            children = np.concatenate([b[3] for b in blocks])
            third, third_count = np.concatenate([b[4] for b in blocks]), np.concatenate([b[5] for b in blocks])
            del blocks
            pair, inverse = np.unique(key, return_inverse=True)
            c2 = np.bincount(inverse, weights=number, minlength=len(pair)).astype(np.int64)
            triple, c3 = _summed(np.repeat(inverse, children) * v + third, third_count)
            owner = triple // v
            first, second = np.divmod(pair, v)
            word, start = np.unique(first, return_index=True)
            arrays, meta = {"word": word}, {}
            bounds = np.searchsorted(owner, np.arange(len(pair) + 1))
            for name, values, universe in (
                ("ids2", np.repeat(np.arange(len(word)), np.diff(np.append(start, len(pair)))) * v + second, len(word) * v),
                ("ids3", triple, len(pair) * v),
                ("to2", np.append(start, len(pair)), len(pair) + 1),
                ("to3", bounds, len(triple) + 1),
            ):
                more, meta[name] = encode(values, universe, name)
                arrays |= more
            shared.write_arrays(f"{folder}/levels-{k:05d}.bin", arrays, meta)
            many2, many3 = np.flatnonzero(c2 > 254), np.flatnonzero(c3 > 254)
            shared.write_arrays(f"{folder}/counts/{k:05d}.bin", {"c2": np.minimum(c2, 255).astype(np.uint8), "c3": np.minimum(c3, 255).astype(np.uint8), "at2": many2, "n2": c2[many2], "at3": many3, "n3": c3[many3]})
            edge = []
            for i in {0, len(word) - 1}:
                own = c2[start[i] : (start[i + 1] if i + 1 < len(word) else len(pair))]
                edge.append([int(word[i]), int(own.sum()), *(int((own == j).sum()) for j in (1, 2)), int((own > 2).sum())])
            yield pa.RecordBatch.from_pylist([{"shard": k, "n2": _of_counts(c2), "n3": _of_counts(c3), "edge": edge}], schema=pa.schema([("shard", pa.int32()), ("n2", pa.list_(pa.int64())), ("n3", pa.list_(pa.int64())), ("edge", pa.list_(pa.list_(pa.int64())))]))

    packed = texts.mapInArrow(shared.lean(count), "shard int, data binary").repartition(shards, "shard")
    return packed.mapInArrow(shared.lean(merge), "shard int, n2 array<long>, n3 array<long>, edge array<array<long>>").collect()


def _kinds(count: np.ndarray, start: np.ndarray, d: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of counts: their totals and the mass that discounting frees in each."""
    total = np.concatenate([[0], np.cumsum(count)])
    freed = np.concatenate([[0], np.cumsum(_discount(count, d))])
    return total[start[1:]] - total[start[:-1]], freed[start[1:]] - freed[start[:-1]]


def weights_of(c2: np.ndarray, c3: np.ndarray, to2: np.ndarray, to3: np.ndarray, d2: list[float], d3: list[float], edges: list[tuple]) -> dict[str, np.ndarray]:
    """A shard's coded probabilities and weights from its counts and the pointers into them.

    ``edges``: (place, total, singles, doubles, more) of first words whose pairs other shards hold, too.
    """
    total1, freed1 = _kinds(c2, to2, d2)
    for i, total, *kinds in edges:
        total1[i], freed1[i] = total, sum(a * b for a, b in zip(kinds, d2, strict=True))
    total2, freed2 = _kinds(c3, to3, d3)
    a2 = (c2 - _discount(c2, d2)) / np.maximum(np.repeat(total1, np.diff(to2)), 1)
    a3 = (c3 - _discount(c3, d3)) / np.maximum(np.repeat(total2, np.diff(to3)), 1)
    l1 = np.where(total1 > 0, freed1 / np.maximum(total1, 1), 1.0)
    l2 = np.where(total2 > 0, freed2 / np.maximum(total2, 1), 1.0)
    return coded_values("p2", a2, P_STEP) | coded_values("p3", a3, P_STEP) | coded_values("l1", l1, L_STEP) | coded_values("l2", l2, L_STEP)


def write_probabilities(spark, folder: str, found: list, d2: list[float], d3: list[float]) -> None:
    """Turn each shard's counts into byte codes of probabilities and weights; the counts then go."""
    edges: dict[int, list[int]] = {}
    for row in found:  # words at the ends of shards: their counts are summed over shards
        for word, *x in row["edge"]:
            edges[word] = [a + b for a, b in zip(edges.get(word, [0] * 4), x, strict=True)]
    jobs = [(row["shard"], [(w, *edges[w]) for w in {e[0] for e in row["edge"]}]) for row in found]

    def finish(job: tuple[int, list]) -> int:
        k, own_edges = job
        levels, meta = shared.open_arrays(f"{folder}/levels-{k:05d}.bin")
        counts, _ = shared.open_arrays(f"{folder}/counts/{k:05d}.bin")
        c2, c3 = counts["c2"].astype(np.int64), counts["c3"].astype(np.int64)
        c2[counts["at2"]], c3[counts["at3"]] = counts["n2"], counts["n3"]
        to2, to3 = Sequence(levels, meta["to2"], "to2").all(), Sequence(levels, meta["to3"], "to3").all()
        places = [(int(np.searchsorted(levels["word"], word)), *rest) for word, *rest in own_edges]
        shared.write_arrays(f"{folder}/weights-{k:05d}.bin", weights_of(c2, c3, to2, to3, d2, d3, places))
        return k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([finish((row["shard"], row["edge"]))], pa.int32())], names=["shard"])

    if jobs:
        rows = spark.createDataFrame(spark.sparkContext.parallelize([(k, [list(e) for e in edge]) for k, edge in jobs], len(jobs)), "shard int, edge array<array<long>>")
        rows.mapInArrow(shared.lean(run), "shard int").collect()
        shared.drop(spark, f"{folder}/counts")


@lru_cache(maxsize=512)
def _shard(folder: str, k: int):
    levels, meta = shared.open_arrays(f"{folder}/levels-{k:05d}.bin")
    weights, _ = shared.open_arrays(f"{folder}/weights-{k:05d}.bin")
    return levels["word"], *(Sequence(levels, meta[name], name) for name in ("to2", "ids2", "to3", "ids3")), weights


class Model:
    """What scoring tasks need: places and sizes, never the n-grams."""

    def __init__(self, folder: str, vocabulary: Vocabulary, shards: int, present: list[int], d1: list[float], free1: float):
        self.folder, self.vocabulary, self.shards = folder, vocabulary, shards
        self.present, self.d1, self.free1 = np.isin(np.arange(max(shards, 1)), present), d1, free1

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        voc = self.vocabulary
        v, total, n = voc.size, voc.tokens, len(texts)
        s = Step(texts, voc)
        at, doc = s.token_at, s.doc[s.token_at]
        base = np.log10((s.count + 1) / (total + v + 1))
        p1 = (s.count - _discount(s.count, self.d1)) / max(total, 1) + self.free1 / (v + 1)
        out = (np.bincount(doc, minlength=n), np.bincount(doc, s.count[s.seq[at]] > 0, n).astype(np.int64), np.bincount(doc, base[s.seq[at]], n))
        # pairs and triples by local numbers, each looked up once
        m = len(s.ids) + 1
        pair, first_at, inverse = np.unique(s.seq[:-1] * m + s.seq[1:], return_index=True, return_inverse=True)
        a, b = s.seq[first_at], s.seq[first_at + 1]
        shard = shard_of(s.before[a], s.count[a], s.before[b], max(total, 1), self.shards)
        known = (s.ids[a] >= 0) & (s.ids[b] >= 0) & self.present[shard]
        l1 = self._first_weights(s)
        place, p2, l2 = np.full(len(pair), -1, np.int64), np.zeros(len(pair)), np.ones(len(pair))
        for k, q in self._by_shard(shard, np.flatnonzero(known)):
            word, to2, ids2, _, _, weights = _shard(self.folder, k)
            rel = np.minimum(np.searchsorted(word, s.ids[a[q]]), len(word) - 1)
            rel_ok = word[rel] == s.ids[a[q]]
            q, rel = q[rel_ok], rel[rel_ok]
            pos = ids2.find(rel * v + s.ids[b[q]], *to2.get(rel))
            q, pos = q[pos >= 0], pos[pos >= 0]
            place[q], p2[q], l2[q] = pos, value_at(weights, "p2", pos, P_GRID), value_at(weights, "l2", pos, L_GRID)
        triple, one, back = np.unique(inverse[at - 2] * m + s.seq[at], return_index=True, return_inverse=True)
        context, last = inverse[at[one] - 2], inverse[at[one] - 1]
        third = s.seq[at[one]]
        p3 = np.zeros(len(triple))
        for k, q in self._by_shard(shard[context], np.flatnonzero((place[context] >= 0) & (s.ids[third] >= 0))):
            *_, to3, ids3, weights = _shard(self.folder, k)
            own = place[context[q]]
            pos = ids3.find(own * v + s.ids[third[q]], *to3.get(own))
            p3[q[pos >= 0]] = value_at(weights, "p3", pos[pos >= 0], P_GRID)
        p = p3 + l2[context] * (p2[last] + l1[a[last]] * p1[third])
        return *out, np.bincount(doc, np.log10(np.maximum(p, 1e-300))[back], n)

    def _by_shard(self, shard: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = chosen[np.argsort(shard[chosen], kind="stable")]
        for k, x, y in _runs(shard[order]):
            yield k, order[x:y]

    def _first_weights(self, s: Step) -> np.ndarray:
        """Back-off weight of each distinct word as a context; 1 for unknown words."""
        out, total = np.ones(len(s.ids)), max(self.vocabulary.tokens, 1)
        lo = shard_of(s.before, s.count, np.zeros(len(s.ids)), total, self.shards)
        hi = shard_of(s.before, s.count, np.full(len(s.ids), total), total, self.shards)
        open_ = np.flatnonzero(s.ids >= 0)
        while len(open_):
            left = []
            for k, q in self._by_shard(lo, open_):
                if not self.present[k]:
                    left.append(q)
                    continue
                word, *_, weights = _shard(self.folder, k)
                rel = np.minimum(np.searchsorted(word, s.ids[q]), len(word) - 1)
                good = word[rel] == s.ids[q]
                out[q[good]] = value_at(weights, "l1", rel[good], L_GRID)
                left.append(q[~good])
            open_ = np.concatenate(left)
            lo[open_] += 1
            open_ = open_[lo[open_] <= hi[open_]]
        return out


def train(docs: DataFrame, text_col: str = "text") -> Model:
    spark = docs.sparkSession
    shared.bound_batches(spark)
    folder = shared.new_folder(spark, "lm")
    parts = shared.parts_of(docs, text_col, PART_BYTES)
    texts = docs.select(F.col(text_col).cast("string").alias("x"))
    vocabulary, n1 = build_vocabulary(texts, folder, parts)
    shards = max(parts, -(-vocabulary.tokens // SHARD_TOKENS))
    d1 = discounts(n1)
    if not vocabulary.tokens:
        return Model(folder, vocabulary, shards, [], d1, 1.0)
    found = build_levels(texts, folder, vocabulary, shards)
    total = lambda name: [sum(row[name][i] for row in found) for i in range(4)]
    write_probabilities(spark, folder, found, discounts(total("n2")), discounts(total("n3")))
    freed = n1[0] * d1[0] + n1[1] * d1[1] + (vocabulary.size - n1[0] - n1[1]) * d1[2]
    return Model(folder, vocabulary, shards, [row["shard"] for row in found], d1, freed / vocabulary.tokens)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    model = train(rows.where("not held_out"), "text")
    tokens = model.vocabulary.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part, _ in steps(batch.column(2), batch.column(2), STEP):
                n, known, base, score = model.score(part)
                columns = [batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), *map(pa.array, (n.astype(np.int64), known, np.full(len(part), tokens), base, score))]
                at += len(part)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(shared.lean(run), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
