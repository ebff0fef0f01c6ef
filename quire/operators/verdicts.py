"""Distinct-unit aggregation, packets, tiers and per-cell verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 300
UNDECIDABLE_PERCENT = 10


def tier(quality: Column, toxic: Column) -> Column:
    """Unplaceable first, then A for a second answer of yes, B for a first, else C."""
    return F.when(quality.isNull() | toxic.isNull(), "UNPLACEABLE").when(toxic == 1, "A").when(quality == 1, "B").otherwise("C")


def distinct_status(records: DataFrame, *keys: str) -> DataFrame:
    """One status a unit: decided beats undecidable beats unknown (a maximum of ranks)."""
    rank = F.when(F.col("decided"), 2).when(F.startswith("oracle", F.lit("UNDECIDABLE-")), 1).otherwise(0)
    per = records.where("oracle is not null").groupBy(*keys).agg(F.max(rank).alias("r"))
    return per.select(*keys, F.element_at(F.array(F.lit("UNKNOWN"), F.lit("undecidable"), F.lit("decided")), F.col("r") + 1).alias("status"))


def counts(records: DataFrame, statuses: DataFrame, arm: str) -> DataFrame:
    """Distinct and instance counts side by side."""
    d = statuses.groupBy(arm).agg(F.count_if(F.col("status") == "decided").alias("decided"), F.count_if(F.col("status") == "undecidable").alias("undecidable"), F.count("*").alias("units"))
    i = records.groupBy(arm).agg(F.count("*").alias("instances"), F.count_if("decided").alias("decided_instances"))
    return d.join(i, arm)


def floor_verdict(decided: Column, undecidable: Column, passed: Column, floor: int = FLOOR) -> tuple[Column, Column]:
    """(verdict, reason) of a cell without a finding."""
    crowded = undecidable * 100 > UNDECIDABLE_PERCENT * (decided + undecidable)
    few, bad = decided < floor, ~passed
    verdict = F.when(bad | few | crowded, "NO VERDICT").otherwise("NOT FOUND")
    reason = F.when(bad, "bar").when(few, "floor").when(crowded, "undecidable").otherwise("bound")
    return verdict, reason


def cells(grid: DataFrame, scores: DataFrame, gaps: DataFrame, found: Column, floor: int = FLOOR) -> DataFrame:
    """Every cell of the grid (arm, mech) with its counts, verdict, reason and, without a finding, the bound 3/n on the rate.

    ``scores`` holds (arm, decided, undecidable, wrong); arms without scores count nothing. A declared gap
    (arm, mech, gap) overrides what was counted.
    """
    joined = grid.join(scores, "arm", "left").na.fill(0, ["decided", "undecidable", "wrong"]).join(gaps, ["arm", "mech"], "left")
    verdict, reason = floor_verdict(F.col("decided"), F.col("undecidable"), F.lit(True), floor)
    gap = F.col("gap").isNotNull()
    out = joined.withColumn("verdict", F.when(gap, "NO VERDICT").when(found, "FOUND").otherwise(verdict)).withColumn("reason", F.when(gap, F.col("gap")).when(found, "found").otherwise(reason))
    return out.withColumn("bound", F.when(F.col("verdict") == "NOT FOUND", F.round(3 / F.col("decided"), 5))).drop("gap")


def totals(cells: DataFrame) -> DataFrame:
    """Cells of each verdict and their wrong units."""
    return cells.groupBy("verdict").agg(F.count("*").alias("cells"), F.sum("wrong").alias("wrong"))


def overall(cells: DataFrame) -> DataFrame:
    """Any found cell; else both mechanisms' conditions; else the first one's alone; else open."""
    no = lambda mech: F.bool_and(F.when(F.col("mech") == mech, F.col("verdict") == "NOT FOUND"))
    per = cells.agg(F.bool_or(F.col("verdict") == "FOUND").alias("found"), no("Q").alias("q"), no("R").alias("r"), F.count("*").alias("n_cells"))
    out = F.when(F.col("found"), "FOUND").when(F.col("q") & F.col("r"), "NOT FOUND").when(F.col("q"), "NOT FOUND (Q only)").otherwise("INCONCLUSIVE")
    return per.select(out.alias("overall"), "n_cells")


def representatives(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """One row a packet key: that with the smallest ``order``."""
    return rows.withColumn("packet_key", key).groupBy("packet_key").agg(F.min(order).alias("representative"), F.count("*").alias("members"))


def packet_name(nonce_hex: str, key: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.unhex(F.lit(nonce_hex)), F.encode(F.concat(F.lit(":"), key), "UTF-8")), 256), 1, 16)


def unit_key(arm: Column, mech: Column, name: Column, unit: Column) -> Column:
    """What is counted once: a unit's digest under its arm and mechanism, and its name if it has one."""
    return F.struct(arm.alias("arm"), mech.alias("mech"), F.coalesce(name, F.lit("")).alias("name"), unit.alias("unit"))


def packet_key(arm: Column, mech: Column, name: Column, unit: Column, found: Column, truth: Column) -> Column:
    """What is exported once: the unit, the text that was found and the true one (``DELETED`` without one), by digest."""
    return F.concat_ws("|", arm, mech, F.coalesce(name, F.lit("")), unit, F.sha2(found, 256), F.coalesce(F.sha2(truth, 256), F.lit("DELETED")))


def edit_key(commit: Column, path: Column) -> Column:
    return F.concat(commit, F.lit(":"), path)


def span_key(path: Column, place: Column, gap: Column) -> Column:
    """A pair of versions of a path: its place in the history and how far apart they are."""
    return F.concat_ws(":", path, place.cast("string"), gap.cast("string"))


def instance_id(mode: str, place: Column, path: Column, gap: int | None = None) -> Column:
    """The id of an instance: an edit's commit (mode E), a version's place (S, with its gap) or a merge (M), and the path."""
    return F.concat(F.lit(f"{mode}{'' if gap is None else gap}:"), place.cast("string"), F.lit(":"), path)


def cell_report(records: DataFrame, answers: DataFrame, bars: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Everything that is counted in a cell (arm, mode, mech), and its verdict.

    ``records``: arm, mode, mech, unit (a key), oracle, decided, prose, inside (its instance is of the cell),
    sound (its input states passed), hard_cls, naive_cls, packet (a key below the unit's) and reproduced.
    ``answers``: packet, tier, q3, q4. ``bars``: arm, passes; an arm without a bar passes none.

    A unit that is met a hundred times counts once: all rows of a unit meet in one exchange, where first its
    packets and then it are reduced to flags, whose sums are the cell's counts.
    """
    cell = ["arm", "mode", "mech"]
    wrong = lambda c: F.coalesce(F.col("decided") & F.col("inside") & F.col("sound") & (F.col(c) == "WRONG"), F.lit(False))
    exported = wrong("hard_cls") & F.col("prose")
    rows = records.where("inside").join(answers.select("packet", "tier", "q3", "q4").dropDuplicates(["packet"]), "packet", "left")
    rank = F.when(F.col("oracle").isNotNull() & F.col("prose"), F.when(F.col("decided"), 2).when(F.startswith("oracle", F.lit("UNDECIDABLE-")), 1).otherwise(0))
    rows = rows.withColumn("rank", rank).withColumn("exported", exported).withColumn("ii", wrong("hard_cls") & ~F.col("prose"))
    rows = rows.withColumn("iii", wrong("naive_cls") & F.col("prose") & F.coalesce(F.col("hard_cls") != "WRONG", F.lit(True)))
    said = F.col("prose") & F.col("oracle").isNotNull()
    rows = rows.withColumn("said", said.cast("int")).withColumn("crowded", (said & F.startswith("oracle", F.lit("UNDECIDABLE-"))).cast("int")).withColumn("open", (said & (F.col("oracle") == "UNKNOWN")).cast("int"))
    rows = rows.repartition(*cell, "unit")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    own = F.col("exported")
    per = rows.groupBy(*cell, "unit", "packet").agg(
        F.max("rank").alias("rank"), F.bool_or("ii").alias("ii"), F.bool_or("iii").alias("iii"), F.sum("said").alias("said"), F.sum("crowded").alias("crowded"), F.sum("open").alias("open"),
        F.bool_or(own).alias("exported"), some(own & (F.col("oracle") == "DELETED")).alias("deleted"), F.max("tier").alias("tier"), F.max("q3").alias("q3"), F.max("q4").alias("q4"), some(own & F.coalesce("reproduced", F.lit(False))).alias("again"),
    )
    placed = F.col("exported") & F.col("tier").isNotNull() & (F.col("tier") != "UNPLACEABLE") & (F.col("q4") == "no")
    good = placed & (F.col("q3") == "no") & F.col("tier").isin("A", "B")
    per = per.withColumn("placed", F.coalesce(placed, F.lit(False))).withColumn("good", F.coalesce(good, F.lit(False)))
    units = per.groupBy(*cell, "unit").agg(
        F.max("rank").alias("rank"), F.bool_or("ii").alias("ii"), F.bool_or("iii").alias("iii"), F.sum("said").alias("said"), F.sum("crowded").alias("crowded"), F.sum("open").alias("open"),
        F.count_if("exported").alias("packets"), F.count_if(F.col("exported") & F.col("tier").isNull()).alias("untiered"), F.count_if(F.col("placed") & ~F.col("again")).alias("differs"),
        F.bool_or(F.col("good") & F.col("again")).alias("qualifies"), F.bool_or(F.col("good") & F.col("again") & F.col("deleted")).alias("deleted"), F.bool_or(F.col("placed") & ~F.col("good") & F.col("again")).alias("i"),
    )
    flags = {"qualifying": "qualifies", "on_deleted": "deleted", "near_i": "i", "near_ii": "ii", "near_iii": "iii"}
    sums = {"evaluated": "said", "undecidable_instances": "crowded", "unknown_instances": "open", "packets": "packets", "untiered": "untiered", "differs": "differs"}
    out = units.groupBy(*cell).agg(
        *[F.count_if(F.col("rank") == k).alias(name) for k, name in ((2, "decided"), (1, "undecidable"), (0, "unknown"))],
        *[F.sum(c).alias(name) for name, c in sums.items()], *[F.count_if(c).alias(name) for name, c in flags.items()],
    )
    passed = bars.groupBy("arm").agg(F.bool_and("passes").alias("passes"))
    out = out.join(passed, "arm", "left").withColumn("passes", F.coalesce("passes", F.lit(False)))
    verdict, reason = floor_verdict(F.col("decided"), F.col("undecidable"), F.lit(True), floor)
    chosen = F.when(~F.col("passes") | (F.col("untiered") > 0), "NO VERDICT").when(F.col("qualifying") > 0, "FOUND").otherwise(verdict)
    why = F.when(~F.col("passes"), "bar").when(F.col("untiered") > 0, "untiered").when(F.col("qualifying") > 0, "found").otherwise(reason)
    return out.select(*cell, "decided", "undecidable", "unknown", *sums, *flags, chosen.alias("verdict"), why.alias("reason"))
