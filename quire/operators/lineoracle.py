"""The line oracle as tables: where the parts of a text went, by the lines that survived.

Lines of two versions are aligned by longest matching blocks: the longest run of equal lines that
starts earliest is matched, and the same is done before it and behind it. A line that makes up more than
a hundredth of a long new version starts no run, but a run goes on over it. Done in rounds over all
pairs of versions at once, nowhere holding a version in one place:
1. Lines meet by content. Equal lines on one diagonal without a break are a run; runs on one diagonal that
   equal frequent lines link are one chain. These are all that a longest block can be part of.
2. A chain that crosses no other one is matched as it is: whatever is longer leaves it alone. What
   crosses other chains waits, each chain between the same two of those that were matched.
3. Of the chains that wait together, that with the longest run is matched; it cuts all others into what
   lies before it and what lies behind. Both go on with step 2, until nothing is left. At last, equal
   frequent lines at the very beginning of both versions match, as far as no block holds them.
Whether a chain crosses another one follows from running maxima and minima, taken in ranges of lines
first and then over the ranges, so that one long pair of versions is spread over many tasks.

Then legs are composed by a join and vote: a leg that keeps at least half of a part's text lines says that
the part became the part of the new version which holds most of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quire.functions import lineage
from quire.operators import tables

#: Fixed values of the alignment: a version of that many lines has frequent ones, above a share of 1 / SHARE and one more.
LONG, SHARE = 200, 100
#: Lines of a range in which running extrema are taken.
RANGE = 4096
#: A leg is heard if it keeps this share of a part's text lines; parts are alike from this ratio on.
HEARD = ALIKE = 0.5


def version_lines(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, no (from 0), line; a null text has no lines."""
    return texts.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("no", "line"))


def _chains(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """``keys``, chain, d, i, n (a run's first line in ``a`` and length), lo, hi (its whole chain, hi excluded).

    And (``keys``, n) of versions that begin with n equal frequent lines; None if no version has any.
    """
    content = lambda rows, name: rows.select(*keys, F.col("no").alias(name), F.md5(F.col("line")).alias("c"))
    a, b = content(a, "i"), content(b, "j")
    size = b.groupBy(*keys).agg(F.count("*").alias("size"))
    often = b.groupBy(*keys, "c").agg(F.count("*").alias("times")).join(size, keys)
    often = tables.written(often.where((F.col("size") >= LONG) & (F.col("times") > F.floor(F.col("size") / SHARE) + 1)).select(*keys, "c"), "frequent-lines")
    cells = a.join(b.join(often, [*keys, "c"], "left_anti"), [*keys, "c"]).select(*keys, (F.col("j") - F.col("i")).alias("d"), "i")
    on = [*keys, "d"]
    island = F.col("i") - F.row_number().over(Window.partitionBy(*on).orderBy("i"))
    runs = cells.withColumn("island", island).groupBy(*on, "island").agg(F.min("i").alias("i"), F.count("*").cast("int").alias("n")).drop("island")
    runs = tables.written(runs, "line-runs")

    def stretches(rows: DataFrame, at: str) -> DataFrame:
        """Neighbouring frequent lines of a version: first, behind, cs."""
        rows = rows.join(often, [*keys, "c"], "left_semi")
        mark = F.col(at) - F.row_number().over(Window.partitionBy(*keys).orderBy(at))
        held = rows.withColumn("mark", mark).groupBy(*keys, "mark").agg(F.min(at).alias(f"{at}0"), F.array_sort(F.collect_list(F.struct(at, "c"))).alias("cs"))
        return held.select(*keys, f"{at}0", (F.col(f"{at}0") + F.size("cs")).alias(f"{at}1"), F.transform("cs", lambda x: x["c"]).alias(f"{at}s"))

    begin = None
    if often.isEmpty():
        reach = runs.select(*on, "i", "n", F.lit(0).alias("on"), F.lit(0).alias("back"))
    else:
        x, y = tables.written(stretches(a, "i"), "stretches"), tables.written(stretches(b, "j"), "stretches")
        same = lambda p, q: F.zip_with(p, q, lambda u, v: F.coalesce(u == v, F.lit(False)))
        agree = lambda p, q: F.when(p.isNull() | q.isNull(), 0).otherwise(F.coalesce(F.nullif(F.array_position(same(p, q), False), F.lit(0)) - 1, F.size(p))).cast("int")
        begin = x.where("i0 = 0").join(y.where("j0 = 0"), keys).select(*keys, agree(F.col("is"), F.col("js")).alias("n"))
        ends = runs.withColumn("i0", F.col("i") + F.col("n")).withColumn("j0", F.col("i") + F.col("n") + F.col("d")).withColumn("i1", F.col("i")).withColumn("j1", F.col("i") + F.col("d"))
        ahead = ends.join(x.drop("i1"), [*keys, "i0"], "left").join(y.drop("j1"), [*keys, "j0"], "left")
        ahead = ahead.select(*on, "i", "n", "i1", "j1", agree(F.col("is"), F.col("js")).alias("on"))
        behind = ahead.join(x.drop("i0"), [*keys, "i1"], "left").join(y.drop("j0"), [*keys, "j1"], "left")
        reach = behind.select(*on, "i", "n", "on", agree(F.reverse("is"), F.reverse("js")).alias("back"))
    w = Window.partitionBy(*on).orderBy("i")
    new = F.coalesce(F.lag(F.col("i") + F.col("n") + F.col("on")).over(w) != F.col("i"), F.lit(True))
    rows = reach.withColumn("new", new).withColumn("chain", F.sum(F.col("new").cast("int")).over(w))
    whole = Window.partitionBy(*on, "chain")
    first, behind = F.min(F.col("i") - F.col("back")).over(whole), F.max(F.col("i") + F.col("n") + F.col("on")).over(whole)
    return rows.select(*on, F.md5(F.concat_ws(":", "d", "chain")).alias("chain"), "i", "n", first.alias("lo"), behind.alias("hi")), begin


def _uncrossed(chains: DataFrame, group: list[str]) -> DataFrame:
    """The chains of a group (d, lo, hi) with ``free``, whether they cross no other, and ``before``, how many free ones lie before."""
    rows = chains.withColumn("range", F.floor(F.col("lo") / RANGE))
    per = rows.groupBy(*group, "range").agg(F.max("hi").alias("hi_a"), F.max(F.col("hi") + F.col("d")).alias("hi_b"), F.min("lo").alias("lo_a"), F.min(F.col("lo") + F.col("d")).alias("lo_b"))
    up, down = Window.partitionBy(*group).orderBy("range"), Window.partitionBy(*group).orderBy(F.desc("range"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*group, "range", F.max("hi_a").over(earlier(up)).alias("pa"), F.max("hi_b").over(earlier(up)).alias("pb"), F.min("lo_a").over(earlier(down)).alias("na"), F.min("lo_b").over(earlier(down)).alias("nb"))
    rows = rows.join(per, [*group, "range"])
    up, down = Window.partitionBy(*group, "range").orderBy("lo", "d"), Window.partitionBy(*group, "range").orderBy(F.desc("lo"), F.desc("d"))
    rows = rows.withColumn("pa", F.greatest("pa", F.max("hi").over(earlier(up)))).withColumn("pb", F.greatest("pb", F.max(F.col("hi") + F.col("d")).over(earlier(up))))
    rows = rows.withColumn("na", F.least("na", F.min("lo").over(earlier(down)))).withColumn("nb", F.least("nb", F.min(F.col("lo") + F.col("d")).over(earlier(down))))
    clear = lambda c: F.coalesce(c, F.lit(True))
    free = clear(F.col("pa") <= F.col("lo")) & clear(F.col("pb") <= F.col("lo") + F.col("d")) & clear(F.col("na") >= F.col("hi")) & clear(F.col("nb") >= F.col("hi") + F.col("d"))
    rows = rows.withColumn("free", free).drop("pa", "pb", "na", "nb")
    count = rows.groupBy(*group, "range").agg(F.count_if("free").alias("many"))
    count = count.select(*group, "range", F.coalesce(F.sum("many").over(earlier(Window.partitionBy(*group).orderBy("range"))), F.lit(0)).alias("many"))
    own = F.coalesce(F.sum(F.col("free").cast("int")).over(earlier(up)), F.lit(0))
    return rows.join(count, [*group, "range"]).withColumn("before", F.col("many") + own).drop("many", "range")


def line_blocks(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, i, d, n: the matching blocks of two versions' lines, line i of ``a`` being line i + d of ``b``."""
    group = [*keys, "region"]
    rows, begin = _chains(a, b, keys)
    rows = tables.written(rows.withColumn("region", F.lit("")), "chains")
    found = []
    while not rows.isEmpty():
        chains = _uncrossed(rows.select(*group, "chain", "d", "lo", "hi").distinct(), group)
        chains = tables.written(chains, "chains-laid")
        found.append(chains.where("free").select(*keys, F.col("lo").alias("i"), "d", (F.col("hi") - F.col("lo")).alias("n")))
        waits = chains.where("not free").select(*group, "chain", "d", "before")
        runs = rows.join(waits, [*group, "chain", "d"]).withColumn("region", F.md5(F.concat_ws(":", "region", "before"))).drop("before")
        runs = tables.written(runs, "runs-waiting")
        longest = F.min(F.struct(-F.col("n"), "i", (F.col("i") + F.col("d")).alias("j"), "chain", "d", "lo", "hi"))
        best = tables.written(runs.groupBy(*group).agg(longest.alias("x")).select(*group, *[F.col(f"x.{c}").alias(f"x_{c}") for c in ("chain", "d", "lo", "hi")]), "best")
        found.append(best.select(*keys, F.col("x_lo").alias("i"), F.col("x_d").alias("d"), (F.col("x_hi") - F.col("x_lo")).alias("n")))
        rest = runs.join(best, group).where(~((F.col("chain") == F.col("x_chain")) & (F.col("d") == F.col("x_d"))))
        shift = F.col("x_d") - F.col("d")  # where the other's new lines begin, in lines of the old version
        until, since = F.col("x_lo") + F.least(F.lit(0), shift), F.col("x_hi") + F.greatest(F.lit(0), shift)
        side = lambda name, first, last: F.struct(F.lit(name).alias("side"), first.alias("first"), last.alias("last"))
        none, end = F.lit(0), F.lit((1 << 31) - 1)
        cut = rest.select(*group, "chain", "d", "i", "n", "lo", "hi", F.inline(F.array(side("l", none, until), side("r", since, end))))
        start, stop = F.greatest("i", "first"), F.least(F.col("i") + F.col("n"), F.col("last"))
        cut = cut.where(stop > start).select(*keys, F.md5(F.concat_ws(":", "region", "side")).alias("region"), "chain", "d", start.alias("i"), (stop - start).cast("int").alias("n"), F.greatest("lo", "first").alias("lo"), F.least("hi", "last").alias("hi"))
        rows = tables.written(cut, "chains")
    out = rows.select(*keys, "i", "d", "n")  # none
    for more in found:
        out = out.union(more)
    out = tables.written(out, "line-blocks")
    if begin is None:
        return out
    # where nothing longer is left, equal lines at the very beginning match, frequent as they are
    first = out.groupBy(*keys).agg(F.min("i").alias("fi"), F.min(F.col("i") + F.col("d")).alias("fj"))
    begin = begin.join(first, keys, "left").select(*keys, F.lit(0).alias("i"), F.lit(0).alias("d"), F.least("n", "fi", "fj").alias("n"))
    return out.union(begin.where("n > 0"))


def line_map(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, i, j: lines of ``a`` and the lines of ``b`` that they are matched with."""
    blocks = line_blocks(a, b, keys)
    each = blocks.select(*keys, "d", F.explode(F.sequence(F.col("i"), (F.col("i") + F.col("n") - 1).cast("int"))).alias("i"))
    return each.select(*keys, "i", (F.col("i") + F.col("d")).alias("j"))


def part_lines(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, part, no, first, last: the text lines of every part, and the part's whole lines."""
    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row[-1] is None:
                    continue
                version = lineage.Version(row[-1])
                out += [(*row[:-1], k, no, p.first, p.last) for k, p in enumerate(version.parts) for no in range(p.first, p.last + 1) if version.lines[no].strip()]
            yield pd.DataFrame(out, columns=[*keys, "part", "no", "first", "last"], dtype=object)

    return texts.select(*keys, text).mapInPandas(run, f"{kinds}, part int, no int, first int, last int")


@F.pandas_udf(BooleanType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two texts have the ratio ``ALIKE``; cheap upper bounds are asked first."""

    def one(x: str, y: str) -> bool:
        m = SequenceMatcher(None, x, y)
        return m.real_quick_ratio() >= ALIKE and m.quick_ratio() >= ALIKE and m.ratio() >= ALIKE

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def line_oracle(instances: DataFrame, keys: list[str], before: str = "before", after: str = "after", legs: tuple[str, str] | None = None) -> DataFrame:
    """:func:`part_verdicts` under the instances' own key names, whatever these are."""
    own = [f"__key{k}" for k in range(len(keys))]
    rows = instances.select(*[F.col(f"`{a}`").alias(b) for a, b in zip(keys, own, strict=True)], F.col(before).alias("__before"), F.col(after).alias("__after"), *[F.col(c).alias(f"__leg{k}") for k, c in enumerate(legs or ())])
    out = part_verdicts(rows, own, "__before", "__after", ("__leg0", "__leg1") if legs else None)
    return out.select(*[F.col(b).alias(a) for a, b in zip(keys, own, strict=True)], "part", "oracle", "target", "split")


def part_verdicts(instances: DataFrame, keys: list[str], before: str, after: str, legs: tuple[str, str] | None = None) -> DataFrame:
    """``keys``, part, oracle (SURVIVED, DELETED or UNKNOWN), target, split: one row for each part of ``before``.

    ``legs`` name the two sides of a merge; an edit is a merge with its own base. ``target`` is the part of
    ``after`` that a survivor became, ``split`` whether the lines of legs that are heard lie in several parts of it.
    """
    rows = tables.written(instances.where(F.col(before).isNotNull() & F.col(after).isNotNull()), "instances")
    old, new = tables.written(part_lines(rows, keys, before), "parts"), tables.written(part_lines(rows, keys, after), "parts")
    # all alignments at once: their rounds are the same jobs
    ways = [(before, after)] if legs is None else [w for leg in legs for w in ((before, leg), (leg, after))]
    every = [[version_lines(rows, keys, way[side]).withColumn("__way", F.lit(k)) for k, way in enumerate(ways)] for side in (0, 1)]
    found = tables.written(line_map(reduce(DataFrame.union, every[0]), reduce(DataFrame.union, every[1]), [*keys, "__way"]), "line-maps")
    way = lambda k: found.where(F.col("__way") == k).drop("__way")
    if legs is None:  # the other leg is the base itself, from which the same edit leads on
        maps = [way(0), way(0)]
    else:
        on = lambda k: way(k).select(*keys, F.col("i").alias("j"), F.col("j").alias("end"))
        maps = [way(k).join(on(k + 1), [*keys, "j"]).select(*keys, "i", F.col("end").alias("j")) for k in (0, 2)]
    size = old.groupBy(*keys, "part").agg(F.count("*").alias("size"), F.min("first").alias("first"), F.max("last").alias("last"))
    there = new.select(*keys, F.col("no").alias("j"), F.col("part").alias("to"))
    votes = []
    for leg, lines in enumerate(maps):
        kept = old.withColumnRenamed("no", "i").join(lines, [*keys, "i"]).select(*keys, "part", "j")
        per = kept.join(there, [*keys, "j"], "left").groupBy(*keys, "part", "to").agg(F.count("*").alias("n"))
        votes.append(per.withColumn("leg", F.lit(leg)))
    per = tables.written(votes[0].union(votes[1]), "votes")
    kept = F.sum("n").alias("kept")
    most = F.min(F.when(F.col("to").isNotNull(), F.struct(-F.col("n"), "to")))["to"].alias("to")
    held = per.groupBy(*keys, "part", "leg").agg(kept, most, F.collect_set("to").alias("tos")).join(size, [*keys, "part"])
    heard = (F.col("kept") >= HEARD * F.col("size")) & F.col("to").isNotNull()
    share = F.col("kept") >= HEARD * F.col("size")
    voted = held.groupBy(*keys, "part").agg(F.array_sort(F.collect_set(F.when(heard, F.col("to")))).alias("tos"), F.array_distinct(F.flatten(F.collect_list(F.when(share, F.col("tos"))))).alias("every"))
    out = size.join(voted, [*keys, "part"], "left")
    lost = tables.written(out.where("tos IS NULL").select(*keys, "part", "first", "last"), "lost-parts")
    text = lambda column, first, last: F.array_join(F.slice(F.split(F.col(column), "\n"), F.col(first) + 1, F.col(last) - F.col(first) + 1), "\n")
    own = lost.join(rows.select(*keys, before), keys).select(*keys, "part", text(before, "first", "last").alias("x"))
    parts = new.select(*keys, "first", "last").distinct().join(lost.select(*keys).distinct(), keys, "left_semi")
    others = parts.join(rows.select(*keys, after), keys).select(*keys, text(after, "first", "last").alias("y"))
    near = own.join(others, keys).where((4 * F.length("x") >= F.length("x") + F.length("y")) & (4 * F.length("y") >= F.length("x") + F.length("y")))
    near = tables.written(near.where(alike("x", "y")).select(*keys, "part").distinct().withColumn("near", F.lit(True)), "near-parts")
    out = out.join(near, [*keys, "part"], "left")
    many = F.size("tos")
    verdict = F.when(many == 1, "SURVIVED").when((many > 1) | F.col("tos").isNotNull() | F.col("near"), "UNKNOWN").otherwise("DELETED")
    return out.select(*keys, "part", verdict.alias("oracle"), F.when(many == 1, F.get("tos", F.lit(0))).alias("target"), F.coalesce(F.size("every") > 1, F.lit(False)).alias("split"))
