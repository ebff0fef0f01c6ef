"""Quality rules: an isolation forest on rule statistics, calibrated on labelled rows.

Statistics of whole texts come first (column kernels, one pass). The forest is grown from a bounded
sample of documents (``TREES`` x ``LEAF_SAMPLE`` draws out of ``FIT_ROWS`` rows, the rows with the
lowest id hash, so the draw depends on no order). A document's anomaly score is the usual
2 ** (-mean path length / c(sample)): short paths over random splits mean an odd document. All
labelled rows then set the threshold: the one with the best (share of poor rows above - share of
good rows above) among those that lose at most ``GOOD_LOSS`` of the good rows. Without labelled rows
of both kinds, or where no threshold tells them apart, the forest rejects nothing.

Null texts and texts without words have zero statistics and fail the base rule. Repeated rows get
equal verdicts and count once in the sample; rows of equal rank are equal. A document labelled both
ways counts as poor, labels other than 0 and 1 and labels without a document count for nothing. Null
ids are judged like others and never labelled. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import shared
from quire.llm.words import coded, plain, split, starts, steps

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
TREES = 100
LEAF_SAMPLE = 256
FIT_ROWS = 8192
BINS = 2000
GOOD_LOSS = 0.01

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_chars_all", "n_lines", "n_digits", "n_upper", "n_distinct_words"]
STATS_SCHEMA = ", ".join(f"{c} long" for c in COUNTS + EXTRA)


def _per_doc(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[starts(ends)]


def _distinct(doc: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Distinct codes per document, in one pass over a stable order by code."""
    order = np.argsort(code, kind="stable")
    d, c = doc[order], code[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (c[1:] != c[:-1])
    return np.bincount(d[new], minlength=n)


def _repeated(code: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Word positions per document inside 3-word windows that the document holds twice or more."""
    if len(code) < 3:
        return np.zeros(n, np.int64)
    pair = np.unique(code[:-1] * (int(code.max()) + 1) + code[1:], return_inverse=True)[1]
    key = pair[:-1] * (int(code.max()) + 1) + code[2:]
    at = np.flatnonzero(doc[2:] == doc[:-2])
    order = at[np.argsort(key[at], kind="stable")]  # equal windows in text order, so a document's stand together
    k, d = key[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    many = np.zeros(len(order), bool)
    many[1:] |= same
    many[:-1] |= same
    hit = np.zeros(len(code), bool)
    at = order[many]
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return np.bincount(doc[hit], minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of COUNTS + EXTRA for each text."""
    x = plain(texts)
    n = len(x)
    words, ends = split(x, lower=False)
    code, _ = coded(words)
    doc = np.repeat(np.arange(n), np.diff(ends, prepend=0))
    lines = pc.split_pattern(x, "\n")
    line_doc = np.repeat(np.arange(n), np.asarray(pc.list_value_length(lines)))
    flat = lines.flatten()
    full = np.asarray(pc.match_substring_regex(flat, r"[^ \t\n\x0b\f\r]").cast(pa.uint8())).astype(bool)
    line_code, _ = coded(flat.filter(pa.array(full)))
    line_doc = line_doc[full]
    n_lines = np.bincount(line_doc, minlength=n)
    count = lambda pattern: np.asarray(pc.count_substring_regex(x, pattern)).astype(np.int64)
    return np.stack(
        [
            np.diff(ends, prepend=0),
            _per_doc(np.asarray(pc.utf8_length(words)).astype(np.int64), ends),
            count(SYMBOLS),
            n_lines - _distinct(line_doc, line_code, n),
            _repeated(code, doc, n),
            np.asarray(pc.utf8_length(x)).astype(np.int64),
            n_lines,
            count("[0-9]"),
            count("[A-Z]"),
            _distinct(doc, code, n),
        ],
        axis=1,
    ).astype(np.int64)


def features(stats: np.ndarray) -> np.ndarray:
    """Scale-free features of the statistics: what the forest splits on."""
    s = stats.astype(np.float64)
    words, chars, lines = np.maximum(s[:, 0], 1), np.maximum(s[:, 5], 1), np.maximum(s[:, 6], 1)
    return np.stack([s[:, 1] / words, s[:, 2] / chars, s[:, 3] / lines, s[:, 4] / words, s[:, 7] / chars, s[:, 8] / chars, s[:, 9] / np.sqrt(words), np.log1p(s[:, 0])], axis=1)


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])


def _unsuccessful(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), split value, left child; path length at leaves."""

    feature: list[np.ndarray]
    value: list[np.ndarray]
    left: list[np.ndarray]
    length: list[np.ndarray]
    scale: float

    @classmethod
    def grow(cls, rows: np.ndarray, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        take = min(LEAF_SAMPLE, len(rows))
        limit = int(np.ceil(np.log2(max(take, 2))))
        trees = []
        for _ in range(TREES):
            feature, value, left, length = [], [], [], []
            todo = [(rows[rng.choice(len(rows), take, replace=False)], 0)]
            at = 0
            while at < len(todo):
                own, depth = todo[at]
                at += 1
                span = own.max(0) - own.min(0) if len(own) else np.zeros(rows.shape[1])
                can = np.flatnonzero(span > 0)
                if depth >= limit or len(own) < 2 or not len(can):
                    feature.append(-1), value.append(0.0), left.append(0), length.append(depth + _unsuccessful(len(own)))
                    continue
                f = int(rng.choice(can))
                v = rng.uniform(own[:, f].min(), own[:, f].max())
                feature.append(f), value.append(v), left.append(len(todo)), length.append(0.0)
                todo += [(own[own[:, f] < v], depth + 1), (own[own[:, f] >= v], depth + 1)]
            trees.append((np.array(feature), np.array(value), np.array(left), np.array(length)))
        return cls(*map(list, zip(*trees, strict=True)), scale=max(_unsuccessful(take), 1e-9))

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, value, left, length in zip(self.feature, self.value, self.left, self.length, strict=True):
            at = np.zeros(len(rows), np.int64)
            live = np.flatnonzero(feature[at] >= 0)
            while len(live):
                node = at[live]
                at[live] = left[node] + (rows[live, feature[node]] >= value[node])
                live = live[feature[at[live]] >= 0]
            total += length[at]
        return 2.0 ** (-total / len(self.feature) / self.scale)


@dataclass
class Model:
    forest: Forest | None
    threshold: float

    def judge(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anomaly score, kept) of rows of statistics."""
        failed = base_failed(stats)
        score = np.zeros(len(stats)) if self.forest is None else self.forest.score(features(stats))
        return score, ~failed & (score < self.threshold)


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with the statistics of the text. Clashing columns give way."""
    shared.bound_batches(docs.sparkSession)
    kept = [c for c in shared.keep_columns(docs, COUNTS + EXTRA) if c != text_col]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, text, at = pa.Table.from_batches([batch]), batch.column(batch.num_columns - 1), 0
            for part, _ in steps(text, text):
                own = table.slice(at, len(part)).drop_columns(["__text"])
                at += len(part)
                stats = statistics(part)
                for k, name in enumerate(COUNTS + EXTRA):
                    own = own.append_column(name, pa.array(stats[:, k]))
                yield from own.combine_chunks().to_batches()

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"]
    return rows.mapInArrow(shared.lean(run), ", ".join([*fields, STATS_SCHEMA]))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(batch.column(batch.schema.get_field_index(c))) for c in COUNTS + EXTRA], axis=1)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Grow the forest on the sample and set the threshold from all labelled rows.

    Only the sample (``FIT_ROWS`` rows) and two histograms of ``BINS`` bins reach the driver.
    """
    names = [F.col(c) for c in COUNTS + EXTRA]
    sample = stats.where((F.col("n_words") >= MIN_WORDS)).select(F.xxhash64(id_col, *names).alias("h"), *names).distinct()
    rows = np.array([r[1:] for r in sample.orderBy("h", *names).limit(FIT_ROWS).collect()], np.int64).reshape(-1, len(COUNTS + EXTRA))
    if len(rows) < 2:
        return Model(None, 2.0)
    forest = Forest.grow(features(rows))
    model = Model(forest, 2.0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, passed = model.judge(_matrix(batch))
            bins = np.minimum((score * BINS).astype(np.int32), BINS - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bins).filter(pa.array(passed))], names=["q", "bin"]) if passed.all() else pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(passed)), pa.array(bins[passed])], names=["q", "bin"])

    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__q")).where("__q in (0, 1)").groupBy("__id").agg(F.min("__q").alias("__q"))
    joined = stats.join(known, stats[id_col] == known["__id"]).select("__q", *names)
    found = joined.mapInArrow(shared.lean(scored), "q int, bin int").groupBy("q", "bin").count().collect()
    per = np.zeros((2, BINS))
    for q, b, c in found:
        per[q, b] = c
    above = per[:, ::-1].cumsum(1)[:, ::-1]  # rows with this bin or a higher one
    poor, good = above / np.maximum(per.sum(1, keepdims=True), 1)
    gain = np.where(good <= GOOD_LOSS, poor - good, -1)
    best = int(np.argmax(gain))
    return Model(forest, best / BINS if per.sum(1).min() > 0 and gain[best] > 0 else 2.0)


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's statistics, anomaly score and verdict (``base_failed``, ``kept``)."""
    docs = docs.select(id_col, text_col)
    stats = shared.cut(with_statistics(docs, text_col), "rule-stats")
    model = fit(stats, labels, id_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch)
            score, kept = model.judge(m)
            columns = [batch.column(0), *(pa.array(m[:, k]) for k in range(len(COUNTS))), pa.array(base_failed(m)), pa.array(kept), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["i", *COUNTS, "base_failed", "kept", "anomaly"])

    kind = stats.schema[id_col].dataType.simpleString()
    fields = f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double"
    return stats.select(id_col, *COUNTS, *EXTRA).mapInArrow(shared.lean(judge), fields)


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    The model is fitted on the statistics of all rows; the second pass judges each row where it lies,
    so no text is shuffled and ids need not be unique.
    """
    stats = shared.cut(with_statistics(docs.select(id_col, text_col), text_col), "rule-stats")
    model = fit(stats, labels, id_col)

    at = docs.columns.index(text_col)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            text = batch.column(at).cast(pa.string())
            for part, _ in steps(text, text):
                kept = model.judge(statistics(part))[1]
                yield batch.slice(done, len(part)).filter(pa.array(kept))
                done += len(part)

    return docs.mapInArrow(shared.lean(judge), docs.schema)
