"""Benchmark decontamination by template canonicalisation.

Texts are cut into words; numbers, names (words with a capital and small letters) and units (after a
number) become typed placeholders ``<n>``, ``<p>``, ``<u>``. Windows of ``WINDOW`` template words of
benchmark items and documents meet in a hash join, so a question with other numbers or names still
meets its original. Every window is posted by its words as well, so every word-for-word copy meets
its item, whatever its case; a window of placeholders alone has no template to share and is posted by
its words only. An item shorter than a window is one window of its own length, posted in the same way.

Finding pairs: a document that covers ``COVER`` percent of an item's n windows misses at most the
rest, so it holds at least one of any (rest + 1) of them. Each item's (rest + 1) windows that are
rarest among the documents propose its pairs; only proposed pairs look at the other windows. So a
window that stands in many documents and items never multiplies them.

Slot consistency: along one alignment (document position minus item position), over the covered words
and a window's reach beyond, every slot value of the item must stand for one value in the document. An
alignment that breaks this keeps only the windows that are equal word for word. A document is
contaminated by an item if its alignments together cover at least ``COVER`` percent of the item's
windows; the slots that changed are told of the alignment that covers most (of several, with fewest).

Documents are judged by their text (its MD5), so rows with equal texts are judged once and alike,
whatever their ids; ids may be null, repeated or of any type. Null and empty texts match nothing,
neither do items without words. Items with equal words are one item (the smallest id). An item side
is broadcast only while its measured size is small; otherwise both sides are shuffled by window hash.
DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import shared

WINDOW = 5
COVER = 80
SLOTS = ("<n>", "<p>", "<u>")
UNITS = (
    "mm cm m km g mg kg t lb lbs oz l ml s ms min h hr hrs sec secs second seconds minute minutes hour hours day days week weeks month months "
    "year years mile miles foot feet ft inch inches in yard yards meter meters metre metres gram grams litre litres liter liters "
    "dollar dollars euro euros pound pounds cent cents percent degree degrees mph kmh"
).split()


def plain_words(text: Column) -> Column:
    """Words parted by single spaces: letters, marks, digits; a decimal number is one word."""
    joined = F.regexp_replace(text, r"[.,](?<=\p{Nd}[.,])(?=\p{Nd})", "_")
    return F.trim(F.regexp_replace(joined, r"[^\p{L}\p{M}\p{Nd}_%$€£]+", " "))


def template(words: Column) -> Column:
    """The words with placeholders; word for word as many as before."""
    numbers = F.regexp_replace(F.concat(F.lit(" "), words), r" [$€£]?\p{Nd}[^ ]*", " <n>")
    units = F.regexp_replace(numbers, rf"<n> (?i:{'|'.join(UNITS)})(?![^ ])", "<n> <u>")
    return F.lower(F.ltrim(F.regexp_replace(units, r" \p{Lu}[^ ]*\p{Ll}[^ ]*", " <p>")))


def arrays(words: Column) -> tuple[Column, Column]:
    """(words, template words) in lower case."""
    return F.split(F.lower(words), " "), F.split(template(words), " ")


def windows(rows: DataFrame, *keep: str, length: int = WINDOW) -> DataFrame:
    """Of rows with ``words``: ``keep``, ws, ts (words and template words), i, literal (hash of the window's words), key (of its template).

    Windows shorter than ``WINDOW`` have hashes of their own, which no longer one shares.
    """
    w, t = arrays(F.col("words"))
    rows = rows.select(*keep, w.alias("ws"), t.alias("ts"))
    rows = rows.select(*keep, "ws", "ts", F.explode(F.when(F.size("ws") >= length, F.sequence(F.lit(0), F.size("ws") - length))).alias("i"))
    at = lambda c, k: F.get(F.col(c), F.col("i") + k)
    plain = ~at("ts", 0).isin(*SLOTS)
    for k in range(1, length):
        plain = plain | ~at("ts", k).isin(*SLOTS)
    own = [F.lit(length)] if length < WINDOW else []
    rows = rows.withColumn("literal", F.xxhash64(*own, *[at("ws", k) for k in range(length)]))
    return rows.withColumn("key", F.when(plain, F.xxhash64(*own, *[at("ts", k) for k in range(length)])).otherwise(F.col("literal")))


def post_items(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """(item_id, key, j, literal?, n_windows) of all items, and the lengths of those below a window."""
    both = F.when(F.col("key") == F.col("literal"), F.array(F.struct("key", F.lit(True).alias("same")))).otherwise(
        F.array(F.struct("key", F.lit(False).alias("same")), F.struct(F.col("literal").alias("key"), F.lit(True).alias("same")))
    )
    length = F.size(F.split("words", " "))
    short = sorted(r[0] for r in items.where(length < WINDOW).select(length).distinct().collect())  # at most WINDOW - 1 rows

    def post(rows: DataFrame, n: int) -> DataFrame:
        posted = windows(rows, "item_id", length=n).select("item_id", F.inline(both), F.col("i").alias("j"), (F.size("ws") - n + 1).alias("n_windows"))
        return posted.select("item_id", "key", "j", "same", "n_windows")

    posted = post(items, WINDOW)
    for n in short:
        posted = posted.union(post(items.where(length == n), n))
    return shared.cut(posted, "item-windows"), short


def found_windows(rows: DataFrame, keys: DataFrame, short: list[int]) -> DataFrame:
    """Distinct (t, key, i) of the documents' windows whose key some item has."""
    keys = shared.broadcast_if_small(keys)
    both = F.when(F.col("key") == F.col("literal"), F.array("key")).otherwise(F.array("key", "literal"))
    find = lambda n: windows(rows, "t", length=n).select("t", F.explode(both).alias("key"), "i").join(keys, "key", "left_semi")
    found = find(WINDOW)
    for n in short:
        found = found.union(find(n))
    return shared.cut(found.distinct(), "doc-windows")


def propose(found: DataFrame, posted: DataFrame) -> DataFrame:
    """(t, item_id) pairs that hold one of the item's rarest windows: none that covers enough is missed."""
    often = found.groupBy("key").agg(F.count("*").alias("n"))
    per = posted.join(shared.broadcast_if_small(shared.cut(often, "window-counts")), "key", "left").groupBy("item_id", "j", "n_windows").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("n", "j"))
    rest = F.col("n_windows") - F.ceil(F.col("n_windows") * COVER / 100)
    rare = per.withColumn("r", rank).where(F.col("r") <= rest + 1).select(F.col("item_id").alias("e"), F.col("j").alias("f"))
    rare = posted.join(rare, F.col("item_id").eqNullSafe(F.col("e")) & (F.col("j") == F.col("f")), "left_semi").select("item_id", "key").distinct()
    return shared.cut(found.select("t", "key").join(shared.broadcast_if_small(shared.cut(rare, "rare-windows")), "key").select("t", "item_id").distinct(), "pairs")


def bad_alignments(hits: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """(d, e, s, bad, c): whether an alignment gives a slot value two values, and how many slots changed."""
    group = ["t", "item_id", "shift"]
    runs = hits.groupBy(*group).agg((F.min("j") - WINDOW + 1).alias("first"), (F.max("j") + 2 * (WINDOW - 1)).alias("last"))

    def both(rows: DataFrame, key: str, w: str, t: str) -> DataFrame:
        words, types = arrays(F.col("words"))
        return rows.select(F.col(key).alias(f"_{key}"), words.alias(w), types.alias(t))

    runs = runs.join(both(texts, "t", "dw", "dt"), F.col("t") == F.col("_t"))
    runs = runs.join(both(items, "item_id", "iw", "it"), F.col("item_id").eqNullSafe(F.col("_item_id")))
    first = F.greatest("first", F.lit(0), -F.col("shift"))
    last = F.greatest(F.lit(0), F.least("last", F.size("iw") - 1, F.size("dw") - F.col("shift") - 1))
    runs = runs.select(*group, "dw", "dt", "iw", "it", F.explode(F.sequence(first, last)).alias("at"))
    here, there = F.col("at"), F.col("at") + F.col("shift")
    kind = F.get("it", here)
    slots = runs.where(kind.isin(*SLOTS) & (kind == F.get("dt", there)))
    slots = slots.select(*group, "at", kind.alias("kind"), F.get("iw", here).alias("iv"), F.get("dw", there).alias("dv"))
    per_value = slots.groupBy(*group, "kind", "iv").agg((F.min("dv") != F.max("dv")).alias("bad"), F.count_if(F.col("iv") != F.col("dv")).alias("c"))
    return per_value.groupBy(*group).agg(F.max("bad").alias("bad"), F.sum("c").alias("c")).toDF("d", "e", "s", "bad", "c")


def text_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """t (MD5 of a text), item_id, n_windows, n_matched, n_changed (slots with another value) of every leak."""
    items = benchmark.select(F.col(item_col).alias("item_id"), plain_words(F.col(item_text_col)).alias("words")).where("words <> ''")
    items = items.groupBy("words").agg(F.min("item_id").alias("item_id"))
    posted, short = post_items(items)
    text = F.col(f"`{text_col}`").cast("string")
    own = docs.select(F.md5(text).alias("t"), plain_words(text).alias("words"))
    found = found_windows(own, shared.cut(posted.select("key").distinct(), "item-keys"), short)
    pairs = propose(found, posted)
    wanted = pairs.withColumnRenamed("item_id", "e").join(shared.broadcast_if_small(posted), F.col("item_id").eqNullSafe(F.col("e"))).drop("e")
    hits = wanted.join(found, ["t", "key"]).select("t", "item_id", "n_windows", "j", (F.col("i") - F.col("j")).alias("shift"), "same")
    hits = shared.cut(hits.groupBy("t", "item_id", "n_windows", "j", "shift").agg(F.max("same").alias("same")), "hits")
    enough = hits.groupBy("t", "item_id", "n_windows").agg(F.count_distinct("j").alias("m")).where(100 * F.col("m") >= COVER * F.col("n_windows")).select(F.col("t").alias("d"), F.col("item_id").alias("e"))
    hits = shared.cut(hits.join(enough, (F.col("t") == F.col("d")) & F.col("item_id").eqNullSafe(F.col("e")), "left_semi"), "hits")
    # the texts of these few documents, one of each
    ids = shared.cut(hits.select("t").distinct(), "hit-texts")
    few = docs.select(F.md5(text).alias("t"), text.alias("__text")).join(shared.broadcast_if_small(ids), "t", "left_semi")
    few = shared.cut(few.dropDuplicates(["t"]), "hit-texts").select("t", plain_words(F.col("__text")).alias("words"))
    judged = bad_alignments(hits, few, items)
    at = (F.col("t") == F.col("d")) & F.col("item_id").eqNullSafe(F.col("e")) & (F.col("shift") == F.col("s"))
    good = hits.join(judged, at, "left").where(F.col("same") | ~F.coalesce("bad", F.lit(False)))
    per_shift = good.groupBy("t", "item_id", "n_windows", "shift").agg(F.collect_set("j").alias("js"), F.max(F.coalesce("c", F.lit(0))).alias("c"))
    out = per_shift.groupBy("t", "item_id", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("js")))).cast("long").alias("n_matched"), F.max_by("c", F.struct(F.size("js"), -F.col("c"))).alias("n_changed"))
    out = out.where(100 * F.col("n_matched") >= COVER * F.col("n_windows"))
    return shared.cut(out.select("t", "item_id", F.col("n_windows").cast("long"), "n_matched", "n_changed"), "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, n_changed of every document and item that leaks into it, once."""
    found = shared.broadcast_if_small(text_leaks(docs, benchmark, text_col, item_col, item_text_col))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.md5(F.col(f"`{text_col}`").cast("string")).alias("t"))
    return rows.join(found, "t").drop("t").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text no benchmark item contaminates, with all their columns. Ids are not looked at."""
    bad = shared.cut(text_leaks(docs, benchmark, text_col).select(F.col("t").alias("__bad")).distinct(), "contaminated")
    side = shared.broadcast_if_small(bad)
    return docs.join(side, F.md5(docs[f"`{text_col}`"].cast("string")) == side["__bad"], "left_anti")
