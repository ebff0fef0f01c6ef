"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, exact subdivision.

The key is (MD5 of the text, id), so copies of a text stand together. Rows are first reduced to
digests, and equal digests to one row with a count: a row repeated by the million is one row here.
1. Sample: a digest is drawn with probability proportional to its bytes (hash-based, so a recomputed
   task draws the same); the draw has about ``PER_RANGE`` keys a range whatever the input.
2. Splitters: the sample's quantiles. A digest finds its range by binary search.
3. Overfull ranges (over ``RANGE_ROWS`` digests, as when texts are tiny or a draw was unlucky) are
   subdivided: a draw of their own by rows gives splitters inside them, again until none is left. Keys
   are distinct, so every range can be cut.
4. Rows of one range are put in order, their running bytes added to those of all earlier ranges, and
   each copy goes to the shard in which its middle byte falls: shards differ by at most one text.
With ``MAX_RANGES`` ranges cuts end; ranges then grow with the table and are sorted with spill.

Law ``bytes``: shard sizes differ by at most the largest row. Null texts have size 1 and the CRC of
an empty text; a null id sorts first; repeated rows get a slot each; an empty table gives no rows. Ids
must be integers. Other columns are not read.
All DataFrame expressions, no Python on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import shared

PER_RANGE = 32
#: Digests of one range beyond which it is subdivided.
RANGE_ROWS = 100_000
MAX_RANGES = 20_000
#: Copies of one digest that are laid out together.
COPIES = 10_000


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each distinct (id, text): key, id, size, CRC and the number of such rows."""
    text = F.col(text_col).cast("string")
    full = F.coalesce(text, F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(full) + 1).cast("long").alias("size"), F.crc32(full).alias("text_crc32"), F.md5(full).alias("key"))
    return rows.groupBy("key", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))


def order_key() -> Column:
    """A string in key order: the text's MD5, then the id with its sign bit turned (null first)."""
    turned = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat("key", F.coalesce(turned, F.lit("")))


def splitters(rows: DataFrame, ranges: int, total: int, weight: Column) -> list[str]:
    """Quantiles of a weighted sample of keys; about ``ranges`` x PER_RANGE rows are drawn."""
    if ranges < 2:
        return []
    u = F.shiftrightunsigned(F.xxhash64("k", F.lit(17)), 11) / F.lit(float(1 << 53))
    sample = rows.where(u < weight * (ranges * PER_RANGE / total)).select("k")
    got = sorted(r[0] for r in sample.collect())
    return sorted({got[len(got) * i // ranges] for i in range(1, ranges)}) if got else []


def subdivided(rows: DataFrame, cuts: list[str], range_rows: int) -> list[str]:
    """``cuts`` and further ones, so that no range between them holds over ``range_rows`` digests."""
    while len(cuts) < MAX_RANGES:
        placed = rows.withColumn("range", range_of(F.col("k"), cuts))
        over = dict(placed.groupBy("range").agg(F.count("*").alias("n")).where(F.col("n") > range_rows).collect())
        if not over:
            break
        inside, more = sum(over.values()), set()
        pieces = min(2 * -(-inside // range_rows), MAX_RANGES - len(cuts) + 1)
        u = F.shiftrightunsigned(F.xxhash64("k", F.lit(len(cuts))), 11) / F.lit(float(1 << 53))
        drawn: dict[int, list[str]] = {r: [] for r in over}
        for r, k in placed.where(F.col("range").isin(*over) & (u < pieces * PER_RANGE / inside)).select("range", "k").collect():
            drawn[r].append(k)
        for r, got in drawn.items():
            got.sort()
            part = max(2, pieces * over[r] // inside)
            more |= {got[len(got) * i // part] for i in range(1, part)} if got else set()
        if not more - set(cuts):
            break
        cuts = sorted({*cuts, *more})[: MAX_RANGES]
    return cuts


def range_of(k: Column, cuts: list[str]) -> Column:
    """How many splitters are at or below the key, by binary search in a literal array."""
    if not cuts:
        return F.lit(0)
    places = F.split(F.lit(",".join(cuts)), ",")
    halves = [1 << b for b in reversed(range(len(cuts).bit_length()))]
    step = lambda lo, h: F.when((lo + h <= len(cuts)) & (F.get(places, lo + h - 1) <= k), lo + h).otherwise(lo)
    return F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), step)


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    shared.integer_id(docs, id_col)
    rows = shared.cut(digests(docs, id_col, text_col).withColumn("k", order_key()), "digests")
    count, total, most = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    ranges = min(max(4 * shards, 2 * count // range_rows), MAX_RANGES)
    cuts = subdivided(rows, splitters(rows, ranges, total, F.col("size") * F.col("n")), range_rows) if count else []
    placed = rows.withColumn("range", range_of(F.col("k"), cuts))
    # the sums of all ranges: at most MAX_RANGES rows
    sums = placed.groupBy("range").agg(F.sum(F.col("size") * F.col("n")).alias("b"), F.sum("n").alias("c")).orderBy("range").collect()
    before_b, before_c, at_b, at_c = [], [], 0, 0
    offsets = {}
    for r, b, c in sums:
        offsets[r] = (at_b, at_c)
        at_b, at_c = at_b + b, at_c + c
    for r in range(max(offsets, default=-1) + 1):
        b, c = offsets.get(r, (0, 0))
        before_b.append(b), before_c.append(c)
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs or [0]))), ",").cast("array<bigint>")
    w = Window.partitionBy("range").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    base_b = F.get(longs(before_b), F.col("range")) + F.coalesce(F.sum(F.col("size") * F.col("n")).over(w), F.lit(0))
    base_c = F.get(longs(before_c), F.col("range")) + F.coalesce(F.sum("n").over(w), F.lit(0))
    runs = placed.withColumn("b", base_b).withColumn("c", base_c)
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))).alias("at")
    each = runs.select("k", "doc_id", "size", "text_crc32", "b", "c", "n", block)
    if most > COPIES:  # the copies of a hot row are laid out by many tasks
        each = each.repartition("k", "at")
    each = each.select("doc_id", "size", "text_crc32", "b", "c", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + COPIES, F.col("n")) - 1)).alias("i"))
    twice = 2 * F.col("b") + (2 * F.col("i") + 1) * F.col("size")  # where the row's middle lies, doubled
    shard = F.floor(twice.cast("decimal(30,0)") * shards / F.lit(2 * max(total, 1)).cast("decimal(30,0)")).cast("int")
    ranked = shared.cut(each.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("c") + F.col("i")).alias("rank")), "ranked")
    first = {r[0]: r[1] for r in ranked.groupBy("shard").agg(F.min("rank")).collect()}  # one row a shard
    starts = longs([first.get(s, 0) for s in range(shards)])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.get(starts, F.col("shard"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
