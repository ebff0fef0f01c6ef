"""Line dedup by distinct-site spread: lines that stand on many sites are boilerplate and go.

1. Lines (trimmed, of any length but blank ones) are reduced to 64-bit hashes with their site, once.
2. A line on k sites occurs at least k times, so lines that occur fewer than ``MIN_SITES`` times are
   out by an exact count. For the others a HyperLogLog sketch of sites per line hash is merged by
   aggregation: its size doesn't depend on how often a line occurs.
3. Lines whose estimate lies near the threshold (three standard errors, one at least) get an exact
   distinct count; those clearly above are boilerplate, those clearly below aren't.
4. Boilerplate lines are taken out of every text; the others stay in place and order.

A text of boilerplate and blank lines only, a copy that stands on many sites as a whole, has nothing
else to keep: with ``keep_copies`` (the default) it is left as it is, for near-dedup to find; without, the
blank lines are what remains of it.

A null text stays null and an empty one empty; blank lines stay; a null site counts as none. Every
occurrence of a marked line goes, repeated rows alike. Lines, and texts, are told apart by 64-bit hashes:
of 10^11 distinct lines some 270 pairs are expected to share one, and such a line would go with its twin.
DataFrame expressions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import shared

MIN_SITES = 10
SKETCH_LG = 12
BAND = max(1.0, 3 * 1.04 / (1 << SKETCH_LG) ** 0.5 * MIN_SITES)


def line_key(line: Column) -> Column:
    """Hash of the trimmed line; null for a blank one."""
    trimmed = F.btrim(line, F.lit(" \t\r"))
    return F.when(trimmed != "", F.xxhash64(trimmed))


def site_lines(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """(text hash, line hash, site) of every line that counts."""
    each = docs.select(F.xxhash64(F.col(text_col)).alias("t"), F.col(site_col).cast("string").alias("site"), F.explode(F.split(F.col(text_col), "\n")).alias("line"))
    return each.select("t", "site", line_key(F.col("line")).alias("h")).where("h is not null")


def spread_wide(lines: DataFrame, least: int = MIN_SITES) -> DataFrame:
    """Hashes (h) of lines with at least ``least`` distinct sites."""
    band = max(1.0, BAND * least / MIN_SITES)
    often = shared.cut(lines.groupBy("h").agg(F.count("site").alias("n")).where(F.col("n") >= least).select("h"), "often")
    some = lines.join(shared.broadcast_if_small(often), "h", "left_semi").select("h", "site")
    spread = some.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(SKETCH_LG))).alias("e"))
    spread = shared.cut(spread.where(F.col("e") >= least - band), "spread")
    near = spread.where(F.col("e") <= least + band).select("h")
    exact = some.join(shared.broadcast_if_small(near), "h", "left_semi").distinct().groupBy("h").agg(F.count("site").alias("n"))
    return spread.where(F.col("e") > least + band).select("h").union(exact.where(F.col("n") >= least).select("h"))


def strip_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source", keep_copies: bool = True) -> DataFrame:
    """``docs`` with cleaned texts, and n_lines, n_removed (columns of these names give way)."""
    lines = shared.cut(site_lines(docs, text_col, site_col), "site-lines")
    marked = shared.cut(spread_wide(lines, min_sites), "boilerplate")
    per_text = lines.join(shared.broadcast_if_small(marked), "h", "left_semi").groupBy("t").agg(F.collect_set("h").alias("hs"))
    side = shared.broadcast_if_small(shared.cut(per_text, "marked-texts"))
    kept = shared.keep_columns(docs, ["n_lines", "n_removed"])
    text = docs[f"`{text_col}`"]
    hs, every = side["hs"], F.split(text, "\n")
    clean = F.when(hs.isNull(), every).otherwise(F.filter(every, lambda x: ~F.coalesce(F.array_contains(hs, line_key(x)), F.lit(False))))
    lone = f"_{uuid.uuid4().hex}"  # a name that no column has
    rows = docs.join(side, F.xxhash64(text) == side["t"], "left").select(*[docs[f"`{c}`"] for c in kept], hs.isNull().alias(lone), F.size(every).alias(f"{lone}n"), clean.alias(f"{lone}x"))
    text, new = F.col(f"`{text_col}`"), F.col(f"{lone}x")
    whole = F.col(lone)
    if keep_copies:
        whole = whole | ~F.exists(new, lambda x: F.btrim(x, F.lit(" \t\r")) != "")
    return rows.select(
        *[F.when(whole, text).otherwise(F.array_join(new, "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in kept],
        F.when(text.isNull(), 0).otherwise(F.col(f"{lone}n")).cast("long").alias("n_lines"),
        F.when(whole, 0).otherwise(F.col(f"{lone}n") - F.size(new)).cast("long").alias("n_removed"),
    )
