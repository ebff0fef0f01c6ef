"""Evaluation of instances and what is counted over its records.

An instance is a before and an after state of one path, with two legs if it is a merge. Rows with a null
state give no records. Everything but the kernel in ``evaluate`` is plain DataFrame code.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.functions import lineage, merging, rates

RECORD = (
    "mech string, skip string, name string, first int, last int, type string, prose boolean, wellformed boolean, unit string, oracle string, decided boolean, target int, target_text string, "
    "naive_status string, naive_cls string, naive_text string, hard_status string, hard_cls string, hard_text string"
)
VERDICT_RULE = "yaml-fence"


def evaluate(instances: DataFrame, keys: list[str], before: str = "before", after: str = "after", legs: tuple[str, str] | None = None) -> DataFrame:
    """The columns ``keys`` and a record for every unit of every instance."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own, texts = row[: len(keys)], row[len(keys) :]
                if any(t is None for t in texts):
                    continue
                out += [(*own, *(r[n] for n in names)) for r in lineage.evaluate(texts[0], texts[1], tuple(texts[2:]) or None)]
            yield pd.DataFrame(out, columns=[*keys, *names], dtype=object)

    kinds = ", ".join(f"`{k}` {instances.schema[k].dataType.simpleString()}" for k in keys)
    return instances.select(*keys, before, after, *(legs or ())).mapInPandas(run, f"{kinds}, {RECORD}")


def rebuild(instances: DataFrame, id_col: str, wanted: str, keys: list[str]) -> DataFrame:
    """The records of one instance, derived again from its id: a point filter, then the same kernel."""
    return evaluate(instances.where(F.col(id_col) == wanted), keys)


def in_cell(rules: Column, arm: Column, mode: Column, sites: Column, rule: str = VERDICT_RULE) -> Column:
    """Selected by the rule; merges of the site-policy arm also by a set of sites: ``sites`` is its mark, of the strict or the wider set."""
    strict = sites
    return F.coalesce(F.array_contains(rules, rule), F.lit(False)) & (~((arm == "site-policy") & (mode == "M")) | F.coalesce(strict, F.lit(False)))


def reproduced(bound: Column, ok: Column, committed: Column, again: Column) -> Column:
    """A bound, successful reproduction with two equal digests of 64 digits."""
    return F.coalesce(bound & ok & (F.length(committed) == 64) & (committed == again), F.lit(False))


def eligible(records: DataFrame, instances: DataFrame, keys: list[str]) -> DataFrame:
    """Decided mis-resolutions of prose units or names, in a cell, from well-formed states that passed ``f2``."""
    rows = records.join(instances.select(*keys, "rules", "arm", "mode", "strict", "f2"), keys)
    good = F.col("decided") & (F.col("hard_cls") == "WRONG") & F.col("f2") & F.col("wellformed") & F.col("prose")
    return rows.where(good & in_cell(F.col("rules"), F.col("arm"), F.col("mode"), F.col("strict"))).drop("rules", "strict", "f2")


def tally(rows: DataFrame, by: list[str], cls: str, classes: list[str]) -> DataFrame:
    """Counts of each class and its percentage, to two places, one row for each value of ``by``."""
    per = rows.groupBy(*by).pivot(cls, classes).count().na.fill(0, classes)
    n = sum((F.col(f"`{c}`") for c in classes), F.lit(0))
    return per.select(*by, *[F.col(f"`{c}`") for c in classes], n.cast("long").alias("n"), *[F.round(100 * F.col(f"`{c}`") / n, 2).alias(f"{c}_pct") for c in classes])


def with_reproductions(packets: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Packets with their reproduction; a packet without one stops the job rather than counting as failed."""
    joined = packets.join(found.withColumn("__there", F.lit(True)), key, "left")
    there = F.when(F.col("__there").isNull(), F.raise_error(F.concat(F.lit("no reproduction of "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return joined.withColumn("__there", there).where("__there").drop("__there")


def tag_rules(cases: DataFrame, selected: DataFrame, path: str = "path") -> DataFrame:
    """Cases whose path some rule selects, with the sorted rules that do; ``selected`` holds (path, rule)."""
    per = selected.groupBy(path).agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    return cases.join(per, path)


def merge_reproductions(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """One row a key of either source: its value, how many sources have it, and whether they disagree."""
    rows = first.select(key, value).unionByName(second.select(key, value))
    per = rows.groupBy(key).agg(F.count("*").cast("int").alias("sources"), F.count_distinct(value).alias("d"), F.min(value).alias(value))
    return per.select(key, F.when(F.col("d") == 1, F.col(value)).alias(value), "sources", (F.col("d") > 1).alias("disagree"))


def agreement(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """One row: packets that both runs answer, and how many of these they answer alike and differently."""
    both = first.select(key, F.col(value).alias("a")).join(second.select(key, F.col(value).alias("b")), key)
    same = F.col("a").eqNullSafe(F.col("b"))
    return both.agg(F.count("*").alias("packets"), F.count_if(same).alias("agree"), F.count_if(~same).alias("differ"))


def missing_controls(refusals: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, control) of controls that are no case or don't accept; refusals hold (case_id, controls), cases (case_id, accept)."""
    wanted = refusals.select("case_id", F.explode("controls").alias("control"))
    fine = cases.where("accept").select(F.col("case_id").alias("control"))
    return wanted.join(fine, "control", "left_anti").select("case_id", "control")


def uncovered(codes: DataFrame, seen: DataFrame, on: str) -> DataFrame:
    """Codes that no row has."""
    return codes.select(on).distinct().join(seen.select(on).distinct(), on, "left_anti")


def first_refusal(rows: DataFrame, key: str, order: str, reason: str) -> DataFrame:
    """The reason of each key's first refusing row; rows without a reason don't refuse."""
    return rows.groupBy(key).agg(F.min_by(reason, F.when(F.col(reason).isNotNull(), F.col(order))).alias(reason)).where(F.col(reason).isNotNull())


def capped(rows: DataFrame, stratum: str, order: list[str], cap: int) -> DataFrame:
    """At most ``cap`` rows of a stratum, the first in order."""
    w = Window.partitionBy(stratum).orderBy(*order)
    return rows.withColumn("__place", F.row_number().over(w)).where(F.col("__place") <= cap).drop("__place")


def rehearsals(rows: DataFrame, by: list[str], checks: dict[str, Column]) -> DataFrame:
    """Runs of each kind and how many of them pass each check."""
    return rows.groupBy(*by).agg(F.count("*").alias("runs"), *[F.count_if(c).alias(name) for name, c in checks.items()])


def first_match(rows: DataFrame, condition: Column, order: list[str]) -> DataFrame:
    """The first row in order that meets the condition: each task offers one."""
    return rows.where(condition).orderBy(*order).limit(1)


def is_subset(left: DataFrame, right: DataFrame) -> bool:
    """Whether every distinct row of ``left`` is one of ``right``; equal sets are subsets of each other."""
    return left.join(right.distinct(), left.columns, "left_anti").isEmpty()


def upper_bound(k: Column, n: Column, confidence: float = rates.CONFIDENCE) -> Column:
    """One-sided upper bound of a rate after k of n: where so few hits have probability 1 - ``confidence``."""
    return rates.upper_end(k, n, 1 - confidence)


def stratified_rate(strata: DataFrame) -> DataFrame:
    """(hits, rate, low, high) over strata of (size, sampled, hits): sampled shares scaled to their strata.

    The range takes every stratum at the same end of its exact two-sided 95 % interval.
    """
    low, high = (end(F.col("hits"), F.col("sampled")) for end in (rates.lower_end, rates.upper_end))
    per = strata.select("size", (F.col("size") * F.col("hits") / F.col("sampled")).alias("h"), (F.col("size") * high).alias("u"), (F.col("size") * low).alias("l"))
    total = F.sum("size")
    return per.agg(F.sum("h").alias("hits"), (F.sum("h") / total).alias("rate"), (F.sum("l") / total).alias("low"), (F.sum("u") / total).alias("high"))


def only_strings(json: Column) -> Column:
    """Whether a JSON text holds no number and no truth value at any depth: nothing of that kind stands outside its strings."""
    bare = F.regexp_replace(json, r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"', "")
    return ~bare.rlike("[0-9]|true|false")


def is_integer(json: Column) -> Column:
    """Whether a JSON text is an integer: no truth value, no fraction, no exponent."""
    return json.rlike(r"^-?(?:0|[1-9][0-9]*)$")


def refuses(statuses: Column) -> Column:
    return F.exists(statuses, lambda s: F.startswith(s, F.lit("REFUSED(")))


def policy_sets(subject: Column, strict: list[str], wide: list[str]) -> tuple[Column, Column]:
    """Whether a subject holds none of either list's phrases, by case."""
    none = lambda phrases: ~F.greatest(*[F.contains(subject, F.lit(p)) for p in phrases], F.lit(False))
    return none(strict), none(wide)


def change_counts(changes: DataFrame, selected: DataFrame) -> DataFrame:
    """One row: modified, added, deleted, renamed, other changes of selected paths, and those of other paths."""
    rows = changes.join(selected.select("path").distinct().withColumn("__in", F.lit(True)), "path", "left")
    inside, kind = F.col("__in").isNotNull(), F.substring("status", 1, 1)
    at = {"modified": "M", "added": "A", "deleted": "D", "renamed": "R"}
    return rows.agg(*[F.count_if(inside & (kind == v)).alias(k) for k, v in at.items()], F.count_if(inside & ~kind.isin(*at.values())).alias("other"), F.count_if(~inside).alias("not_selected"))


def gap_population(versions: DataFrame, blobs: DataFrame, path: str, order: str, commit: str, gap: int) -> DataFrame:
    """One row: pairs ``gap`` versions apart, those with a missing blob, with equal blobs, and the rest.

    ``blobs`` holds (path, commit, oid).
    """
    oids = blobs.select(path, F.col(commit).alias("__c"), "oid")
    known = versions.join(oids, (versions[path] == oids[path]) & (versions[commit] == oids["__c"]), "left").select(versions[path], order, "oid", F.lit(True).alias("there"))
    w = Window.partitionBy(path).orderBy(order)
    pairs = known.select("oid", F.lead("oid", gap).over(w).alias("later"), F.lead("there", gap).over(w).alias("pair")).where("pair")
    missing = F.col("oid").isNull() | F.col("later").isNull()
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(missing).alias("missing"), F.count_if(~missing & (F.col("oid") == F.col("later"))).alias("same"), F.count_if(~missing & (F.col("oid") != F.col("later"))).alias("population"))


PLACEHOLDER = r"\{\{blob:([^{}]*)\}\}"


def substitute(files: DataFrame, oid: Column) -> tuple[DataFrame, DataFrame]:
    """Files (case_id, path, text) with each placeholder turned into the object id of the file it names, and bad placeholders.

    Bad are those that name no file or one that holds placeholders itself; they stay in the text.
    """
    holds = F.col("text").rlike(PLACEHOLDER)
    named = files.where(holds).select("case_id", "path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PLACEHOLDER), 1))).alias("target"))
    ids = files.where(~holds).select(F.col("case_id").alias("__case"), F.col("path").alias("__path"), oid.alias("oid"))
    joined = named.join(ids, (F.col("case_id") == F.col("__case")) & (F.col("target") == F.col("__path")), "left").drop("__case", "__path")
    swaps = joined.where("oid is not null").groupBy("case_id", "path").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("{{blob:"), "target", F.lit("}}")).alias("mark"), "oid"))).alias("swaps"))
    none = F.array().cast(swaps.schema["swaps"].dataType)
    done = files.join(swaps, ["case_id", "path"], "left")
    text = F.aggregate(F.coalesce("swaps", none), F.col("text"), lambda t, s: F.replace(t, s["mark"], s["oid"]))
    return done.select("case_id", "path", text.alias("text")), joined.where("oid is null").select("case_id", "path", "target")


def content_hash(files: DataFrame, group: str, name: str, content: str, left_out: list[str]) -> DataFrame:
    """(group, hash): one digest over a group's files in name order, names and contents, but for those left out."""
    own = F.concat(F.lit("\0"), F.col(name), F.lit("\0"), F.col(content))
    rows = files.where(~F.col(name).isin(*left_out)).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), own.alias("c")))).alias("f"))
    return rows.select(group, F.sha2(F.array_join(F.transform("f", lambda x: x["c"]), ""), 256).alias("hash"))


@F.pandas_udf(StringType())
def without_name(packet: pd.Series) -> pd.Series:
    """A packet's JSON object without its field ``packet``, keys in order at every depth."""
    cut = lambda text: json.dumps({k: v for k, v in json.loads(text).items() if k != "packet"}, sort_keys=True, ensure_ascii=False)
    return packet.map(cut, na_action="ignore")


def packet_hash(files: DataFrame, group: str, name: str, content: str) -> DataFrame:
    """(group, hash): one digest over a packet's fields but its own name, then over its files in name order.

    The fields are those of ``packet.json``; ``QUESTIONS.md`` is left out. A packet without fields has a null hash.
    """
    fields = F.max(F.when(F.col(name) == "packet.json", F.col(content))).alias("fields")
    own = F.concat(F.lit("\0"), F.col(name), F.lit("\0"), F.col(content))
    rest = F.collect_list(F.when(~F.col(name).isin("packet.json", "QUESTIONS.md"), F.struct(F.col(name).alias("n"), own.alias("c"))))
    rows = files.groupBy(group).agg(fields, F.array_sort(rest).alias("f"))
    return rows.select(group, F.sha2(F.concat(without_name("fields"), F.array_join(F.transform("f", lambda x: x["c"]), "")), 256).alias("hash"))


def same_content(first: DataFrame, second: DataFrame, group: str) -> DataFrame:
    """Groups whose content hashes differ or that only one side has."""
    joined = first.select(group, F.col("hash").alias("a")).join(second.select(group, F.col("hash").alias("b")), group, "full")
    return joined.where(~F.col("a").eqNullSafe(F.col("b"))).select(group, F.col("a").isNull().alias("only_second"), F.col("b").isNull().alias("only_first"))


def differences(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """(key, field, expected, got) for every field of a case that isn't as expected; a missing case differs in all."""
    fields = [c for c in expected.columns if c != key]
    cells = lambda rows, name: rows.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.to_json(F.struct(F.col(c).alias("v"))) for c in fields]))).alias("field", name))
    joined = cells(expected, "expected").join(cells(got, "got"), [key, "field"], "left")
    return joined.where(~F.col("expected").eqNullSafe(F.col("got")))


def alterations(expected: DataFrame, key: str) -> DataFrame:
    """(key, kind, field, answer): every answer that differs from an expected one in one field.

    ``answer`` maps fields to JSON. A field is dropped, altered, or one is added; a comparison that lets any of
    them pass compares too little.
    """
    fields = [c for c in expected.columns if c != key]
    answer = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("null")) for c in fields]))
    rows = expected.select(key, answer.alias("a"))
    own = rows.select(key, "a", F.explode(F.map_keys("a")).alias("field"))
    dropped = own.select(key, F.lit("drop").alias("kind"), "field", F.map_filter("a", lambda k, _: k != F.col("field")).alias("answer"))
    altered = own.select(key, F.lit("alter").alias("kind"), "field", F.transform_values("a", lambda k, v: F.when(k == F.col("field"), F.lit('{"v":"altered"}')).otherwise(v)).alias("answer"))
    added = rows.select(key, F.lit("add").alias("kind"), F.lit("extra").alias("field"), F.map_concat("a", F.create_map(F.lit("extra"), F.lit('{"v":1}'))).alias("answer"))
    return dropped.union(altered).union(added)


def control_gate(lines: DataFrame, line: str, pattern: str, most: int = 0) -> DataFrame:
    """(line, n, ok) of report lines that match: the number the pattern takes out must not exceed ``most``."""
    n = F.regexp_extract(line, pattern, 1)
    return lines.where(F.col(line).rlike(pattern)).select(line, n.cast("long").alias("n"), (n.cast("long") <= most).alias("ok"))


def changed_declarations(versions: DataFrame, key: str, order: list[str], entry: str) -> DataFrame:
    """Versions whose entry isn't what its key first declared: declarations don't change."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.first(entry).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return versions.withColumn("declared", first).where(~F.col(entry).eqNullSafe(F.col("declared")))


def disallowed(files: DataFrame, allowed: list[str]) -> DataFrame:
    """(packet, path) of files that the allow-list of patterns doesn't name."""
    return files.where(~F.col("path").rlike("^(?:" + "|".join(allowed) + ")$")).select("packet", "path")


def utc_day(moment: Column) -> Column:
    """The UTC day of a moment: a time stamp, or a text with its offset to UTC (without one, in the session's zone)."""
    return F.to_date(F.to_utc_timestamp(moment.cast("timestamp"), F.current_timezone()))


def is_late(day: Column, declared: Column, window: int = 14) -> Column:
    """Whether a moment's UTC day lies more than ``window`` days after the declared one's; an earlier one isn't late."""
    return F.datediff(utc_day(day), utc_day(declared)) > window


@F.pandas_udf(StructType([StructField("outcome", StringType()), StructField("text", StringType())]))
def merged(base: pd.Series, ours: pd.Series, theirs: pd.Series) -> pd.DataFrame:
    """Three-way merges; a null side gives nulls."""
    rows = [(None, None) if any(t is None for t in x) else merging.merge(*x) for x in zip(base, ours, theirs, strict=True)]
    return pd.DataFrame(rows, columns=["outcome", "text"], dtype=object)


def section_ends(headings: DataFrame, doc: str, order: str, level: str, levels: int = 6) -> DataFrame:
    """Headings with ``section_end``: the order of the next one of the same or a higher level, null at the end.

    One window over a document's headings: the next heading of each level, then that of the heading's own.
    """
    # backwards, so that each row adds to the frame of the one before it instead of scanning what follows anew
    w = Window.partitionBy(doc).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    after = F.array(*[F.last(F.when(F.col(level) <= k, F.col(order)), ignorenulls=True).over(w) for k in range(1, levels + 1)])
    return headings.withColumn("section_end", F.get(after, F.col(level).cast("int") - 1))


def partition_problems(rows: DataFrame, doc: str, text: str, blocks: str) -> DataFrame:
    """(doc, uncovered, overlapping): non-blank lines in no block, and blocks that begin before the one before them ends.

    ``blocks`` is an array of (type, start, end), 1-based lines, in document order.
    """
    lines = F.split(F.col(text), "\r\n|\r|\n")
    filled = F.filter(F.transform(lines, lambda x, i: F.when(F.translate(x, " \t", "") != "", i + 1)), lambda x: x.isNotNull())
    none = F.array().cast("array<int>")
    held = F.flatten(F.transform(F.col(blocks), lambda b: F.when(b["start"] <= b["end"], F.sequence(b["start"], b["end"])).otherwise(none)))
    steps = F.transform(F.col(blocks), lambda b, i: F.when(i > 0, F.coalesce(F.get(F.col(blocks), F.greatest(i - 1, F.lit(0)))["end"] >= b["start"], F.lit(False))).otherwise(F.lit(False)))
    return rows.select(doc, F.size(F.array_except(filled, held)).alias("uncovered"), F.size(F.filter(steps, lambda x: x)).alias("overlapping"))
