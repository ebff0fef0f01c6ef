"""Queries over evaluation, validation and ingest operators. Each docstring says what stands for what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import scalars
from quire.operators import checker, containment, documents, evaluation, lineoracle, sampling, verdicts
from quire.plans.catalogue import CELLS, cells, docs_of, query
from quire.session import table
from quire.sources import history, records


@query()
def unit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns are versions of one path; an instance is a turn and the one two later."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    later = turns.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("after"))
    return evaluation.evaluate(turns.withColumnRenamed("text", "before").join(later, ["conv_id", "turn"]), ["conv_id", "turn"])


@query("""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
s AS (SELECT doc_id, len(l) AS n, 'ours' || chr(10) || array_to_string(l[2:], chr(10)) AS o, array_to_string(l[2:len(l) - 1], chr(10)) AS mid FROM t)
SELECT doc_id, CASE WHEN n > 2 THEN 'clean' ELSE 'conflict' END AS outcome, CASE WHEN n > 2 THEN sha256('ours' || chr(10) || mid || chr(10) || 'theirs') END AS merged FROM s""")
def merge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ours replaces a text's first line, theirs its last: clean where a line stands between them."""
    lines, text = F.split("text", "\n"), F.col("text")
    join = lambda *parts: F.array_join(F.concat(*parts), "\n")
    ours, theirs = join(F.array(F.lit("ours")), F.slice(lines, F.lit(2), F.size(lines))), join(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.lit("theirs")))
    rows = docs_of(spark, sf_dir).select("doc_id", evaluation.merged(text, ours, theirs).alias("m"))
    return rows.select("doc_id", "m.outcome", F.when(F.col("m.outcome") == "clean", F.sha2("m.text", 256)).alias("merged"))


@query("""
SELECT p_partkey, coalesce(contains(p_type, 'STEEL') OR contains(p_type, 'steel'), false) AND (p_size % 2 = 0 OR p_retailprice > 1000) AS member,
       p_size > 10 AND p_retailprice > 950 AND p_name = lower(p_name) AS reproduced FROM part""")
def cell_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of steel were selected by the verdict rule; odd sizes are site-policy merges, dear ones in the strict set."""
    steel = F.contains("p_type", F.lit("STEEL")) | F.contains("p_type", F.lit("steel"))
    rules = F.array_compact(F.array(F.when(steel, evaluation.VERDICT_RULE), F.lit("none")))
    odd = F.col("p_size") % 2 != 0
    member = evaluation.in_cell(rules, F.when(odd, "site-policy").otherwise("docs"), F.lit("M"), F.col("p_retailprice") > 1000)
    same = evaluation.reproduced(F.col("p_size") > 10, F.col("p_retailprice") > 950, F.sha2("p_name", 256), F.sha2(F.lower("p_name"), 256))
    return table(spark, sf_dir, "part").select("p_partkey", member.alias("member"), same.alias("reproduced"))


@query("""
WITH r AS (SELECT doc_id, lang, source, coalesce(quality, 1) AS q, coalesce(toxic, 0) AS t FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, lang FROM r JOIN (SELECT DISTINCT source FROM r WHERE source < 'src15') i USING (source) WHERE q = 0 AND t = 0 AND source NOT IN ('src3', 'src5')""")
def eligible_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a record, its source an instance: poor ones are wrong, toxic ones undecided; two sources fail ``f2`` or the strict set."""
    labels = table(spark, sf_dir, "labels")
    rows = docs_of(spark, sf_dir).select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    wrong = F.when(F.coalesce("quality", F.lit(1)) == 0, "WRONG").otherwise("correct")
    found = rows.select("doc_id", "lang", "source", (F.coalesce("toxic", F.lit(0)) == 0).alias("decided"), wrong.alias("hard_cls"), F.lit(True).alias("prose"), F.lit(True).alias("wellformed"))
    source = F.col("source")
    per = rows.where(source < "src15").select("source").distinct()
    instances = per.select("source", F.array(F.lit("yaml-fence")).alias("rules"), F.lit("site-policy").alias("arm"), F.lit("M").alias("mode"), (source != "src3").alias("strict"), (source != "src5").alias("f2"))
    return evaluation.eligible(found, instances, ["source"]).select("doc_id", "lang")


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) AS other, count(*) AS n,
       round(100 * count(*) FILTER (WHERE event_type = 'view') / count(*), 2) AS view_pct, round(100 * count(*) FILTER (WHERE event_type = 'click') / count(*), 2) AS click_pct, round(100 * count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) / count(*), 2) AS other_pct
FROM events GROUP BY user_id""")
def class_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users stand for policies, event types for classes."""
    kind = F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).otherwise("other")
    return evaluation.tally(table(spark, sf_dir, "events").select("user_id", kind.alias("cls")), ["user_id"], "cls", ["view", "click", "other"])


@query("SELECT o_orderkey, sum(l_quantity)::BIGINT AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def checked_reproductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with lines are packets, their lines the reproductions: every packet has one."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("long").alias("quantity"))
    packets = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left_semi")
    return evaluation.with_reproductions(packets, lines, "o_orderkey")


@query("""
WITH s AS (SELECT c_custkey AS k, 'rich' AS rule FROM customer WHERE c_acctbal > 5000 UNION SELECT c_custkey, 'building' FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT o_orderkey, array_to_string(list_sort(list(rule)), '|') AS rules FROM orders JOIN s ON o_custkey = k GROUP BY o_orderkey""")
def rule_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are merge cases, customers paths, and two rules select customers."""
    customer = table(spark, sf_dir, "customer")
    rules = F.array_compact(F.array(F.when(F.col("c_acctbal") > 5000, "rich"), F.when(F.col("c_mktsegment") == "BUILDING", "building")))
    chosen = customer.select(F.col("c_custkey").alias("path"), F.explode(rules).alias("rule"))
    cases = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("path"))
    return evaluation.tag_rules(cases, chosen).select("o_orderkey", F.array_join("rules", "|").alias("rules"))


@query("""
WITH f AS (SELECT DISTINCT doc_id, coalesce(toxic, 1) = 0 AS ok FROM documents LEFT JOIN labels USING (doc_id)), w AS (SELECT doc_id AS case_id, unnest([doc_id + 1, doc_id + 2]) AS control FROM documents WHERE doc_id % 10 = 0)
SELECT case_id, control FROM w WHERE control NOT IN (SELECT doc_id FROM f WHERE ok)""")
def missing_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document is a refusal whose controls are the two after it; labelled, non-toxic ones accept."""
    docs = docs_of(spark, sf_dir).select("doc_id")
    cases = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("doc_id").alias("case_id"), (F.coalesce("toxic", F.lit(1)) == 0).alias("accept"))
    refusals = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("case_id"), F.array(F.col("doc_id") + 1, F.col("doc_id") + 2).alias("controls"))
    return evaluation.missing_controls(refusals, cases)


@query("SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def uncovered_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are codes, rich suppliers the cases that show one."""
    nation = table(spark, sf_dir, "nation")
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("n_nationkey"))
    return nation.select("n_nationkey", "n_name").join(evaluation.uncovered(nation, rich, "n_nationkey"), "n_nationkey").select("n_name")


@query("""
WITH f AS (SELECT lang AS case_id, doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'see {{blob:' || (doc_id - 1) || '}}, {{blob:' || (doc_id + 2) || '}}' END AS text FROM documents),
g AS (SELECT f.case_id, f.doc_id, f.text, p.doc_id AS hit, sha1(encode('blob ' || octet_length(encode(p.text))) || unhex('00') || encode(p.text)) AS oid FROM f LEFT JOIN f p ON p.case_id = f.case_id AND p.doc_id = f.doc_id - 1 AND p.doc_id % 2 = 0 AND f.doc_id % 2 = 1)
SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN oid IS NULL THEN text ELSE replace(text, '{{blob:' || hit || '}}', oid) END) AS text FROM g""")
def substituted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents name the one before them and the odd one after; only a file without placeholders of the same language can be named."""
    path = F.col("doc_id").cast("string")
    marks = F.concat(F.lit("see {{blob:"), (F.col("doc_id") - 1).cast("string"), F.lit("}}, {{blob:"), (F.col("doc_id") + 2).cast("string"), F.lit("}}"))
    files = docs_of(spark, sf_dir).select(F.col("lang").alias("case_id"), path.alias("path"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(marks).alias("text"))
    done, _ = evaluation.substitute(files, scalars.blob_id(F.col("text")))
    return done.select("path", F.sha2("text", 256).alias("text"))


@query("""
WITH r AS (SELECT doc_id, quality AS v FROM labels UNION ALL SELECT doc_id, toxic FROM labels WHERE toxic = 1)
SELECT doc_id, CASE WHEN count(DISTINCT v) = 1 THEN min(v) END AS v, count(*)::INTEGER AS sources, count(DISTINCT v) > 1 AS disagree FROM r GROUP BY doc_id""")
def merged_reproductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two label columns are two sources of reproductions; the second knows toxic documents only."""
    labels = table(spark, sf_dir, "labels")
    return evaluation.merge_reproductions(labels.select("doc_id", F.col("quality").alias("v")), labels.where("toxic = 1").select("doc_id", F.col("toxic").alias("v")), "doc_id", "v")


@query("SELECT c_nationkey AS doc, arg_min(c_mktsegment, c_custkey) FILTER (WHERE c_acctbal < 0) AS reason FROM customer GROUP BY c_nationkey HAVING count(*) FILTER (WHERE c_acctbal < 0) > 0")
def first_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are referrers, customers their leaves in order of key; those in debt refuse with their segment."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), "c_custkey", F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).alias("reason"))
    return evaluation.first_refusal(rows, "doc", "c_custkey", "reason")


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256(text), doc_id) <= 40")
def stratum_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs_of(spark, sf_dir).select("lang", "doc_id", F.sha2("text", 256).alias("rank"))
    return evaluation.capped(rows, "lang", ["rank", "doc_id"], 40).drop("rank")


@query("SELECT doc_id, ntile((SELECT ceil(count(*) / 17)::BIGINT FROM documents)) OVER (ORDER BY doc_id)::INTEGER AS batch FROM documents")
def dealt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.deal(docs_of(spark, sf_dir).select("doc_id"), "doc_id", 17)


@query("""
WITH RECURSIVE s AS (
  SELECT lang, count(*) AS size, count(toxic) AS n, coalesce(sum(toxic), 0)::BIGINT AS k FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang HAVING count(toxic) > 0
),
-- an end is where the binomial tail up to k has this probability
ends AS (
  SELECT lang, n, k, 'bound' AS e, 0.05 AS p, k AS upto FROM s UNION ALL SELECT lang, n, k, 'high', 0.025, k FROM s UNION ALL SELECT lang, n, k, 'low', 0.975, k - 1 FROM s
),
halve(lang, e, n, upto, p, x, step) AS (
  SELECT lang, e, n, upto, p, 0.0::DOUBLE, 0 FROM ends WHERE upto >= 0 AND upto < n
  UNION ALL
  SELECT lang, e, n, upto, p, CASE WHEN list_sum(list_transform(range(upto + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(x + pow(2.0, -step - 1)) + (n - i) * ln(1 - x - pow(2.0, -step - 1))))) > p THEN x + pow(2.0, -step - 1) ELSE x END, step + 1
  FROM halve WHERE step < 45
),
found AS (SELECT ends.*, coalesce(x, CASE WHEN upto < 0 THEN 0.0 ELSE 1.0 END) AS v FROM ends LEFT JOIN (SELECT lang, e, x FROM halve WHERE step = 45) h USING (lang, e)),
wide AS (SELECT lang, max(v) FILTER (e = 'bound') AS bound, max(v) FILTER (e = 'low') AS low, max(v) FILTER (e = 'high') AS high FROM found GROUP BY lang),
every AS (SELECT sum(size * k / n) / sum(size) AS rate, sum(size * low) / sum(size) AS low, sum(size * high) / sum(size) AS high FROM s JOIN wide USING (lang))
SELECT lang, n AS sampled, k AS hits, round(wide.bound, 7) AS bound, round(every.rate, 7) AS rate, round(every.low, 7) AS low, round(every.high, 7) AS high FROM s JOIN wide USING (lang), every""")
def rate_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages are strata, labels their samples, toxic ones the hits: each one's one-sided 95 % bound, and the scaled rate with its range."""
    docs = docs_of(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    strata = docs.groupBy("lang").agg(F.count("*").alias("size"), F.count("toxic").alias("sampled"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("hits")).where("sampled > 0")
    every = evaluation.stratified_rate(strata).select(*[F.round(c, 7).alias(c) for c in ("rate", "low", "high")])
    return strata.select("lang", "sampled", "hits", F.round(evaluation.upper_bound(F.col("hits"), F.col("sampled")), 7).alias("bound")).crossJoin(F.broadcast(every))


@query("SELECT event_id, props IS NOT NULL AND regexp_matches(value::BIGINT::VARCHAR, '^-?[0-9]+$') AS whole, false AS fraction FROM events")
def strict_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value without its fraction is an integer, one with ``.5`` behind it isn't."""
    whole = F.to_json(F.struct(F.col("value").cast("long").alias("v")))
    cut = lambda j: F.regexp_extract(j, ":(.*)\\}$", 1)
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("props").isNotNull() & evaluation.is_integer(cut(whole))).alias("whole"), evaluation.is_integer(F.concat(cut(whole), F.lit(".5"))).alias("fraction"))
    return rows


@query("SELECT doc_id, NOT (contains(text, 'the') OR contains(text, 'The')) AS strict, NOT contains(text, 'la') AS wide FROM documents")
def site_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict, wide = evaluation.policy_sets(F.col("text"), ["the", "The"], ["la"])
    return docs_of(spark, sf_dir).select("doc_id", strict.alias("strict"), wide.alias("wide"))


#: Changes: a line's return flag is its status, N for modified; its part is the path.
CHANGES = "WITH c AS (SELECT CASE l_returnflag WHEN 'N' THEN 'M' WHEN 'R' THEN 'R100' ELSE CASE WHEN l_linestatus = 'O' THEN 'D' ELSE 'A' END END AS status, l_partkey AS path FROM lineitem)"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.when(F.col("l_linestatus") == "O", "D").otherwise("A")
    kind = F.when(flag == "N", "M").when(flag == "R", "R100").otherwise(status)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", kind.alias("status"), F.col("l_partkey").alias("path"))


@query(CHANGES + """, s AS (SELECT status, path IN (SELECT p_partkey FROM part WHERE p_size > 25) AS i FROM c)
SELECT count(*) FILTER (WHERE i AND status = 'M') AS modified, count(*) FILTER (WHERE i AND status = 'A') AS added, count(*) FILTER (WHERE i AND status = 'D') AS deleted, count(*) FILTER (WHERE i AND status = 'R100') AS renamed, 0::BIGINT AS other, count(*) FILTER (WHERE NOT i) AS not_selected FROM s""")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("path"))
    return evaluation.change_counts(changes(spark, sf_dir).select("status", "path"), chosen)


@query(CHANGES.replace("l_partkey AS path", "l_partkey AS path, l_orderkey") + "SELECT l_orderkey::VARCHAR AS commit, status, path || CASE WHEN status = 'R100' THEN '>new' || path ELSE '' END AS paths, count(*) AS n FROM c GROUP BY ALL")
def exported_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a commit: its changes are written as an exported list of bytes and read back."""
    one = F.concat(F.lit("\0"), F.col("status"), F.lit("\0"), F.col("path").cast("string"), F.when(F.col("status") == "R100", F.concat(F.lit("\0new"), F.col("path").cast("string"))).otherwise(""))
    lists = changes(spark, sf_dir).select("l_orderkey", one.alias("c")).groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("c")), "").alias("c"))
    raw = lists.select(F.encode(F.concat(F.lit("c"), F.col("l_orderkey").cast("string"), F.col("c"), F.lit("\0")), "UTF-8").alias("content"))
    found = records.changes(raw)
    return found.groupBy(F.substring("commit", 2, 99).alias("commit"), "status", F.array_join("paths", ">").alias("paths")).agg(F.count("*").alias("n"))


@query("""
WITH v AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CASE WHEN length(text) % 5 <> 0 THEN md5(left(text, 3)) END AS oid FROM conversations),
p AS (SELECT a.oid AS x, b.oid AS y FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.i + 2 = b.i)
SELECT count(*) AS pairs, count(*) FILTER (WHERE x IS NULL OR y IS NULL) AS missing, count(*) FILTER (WHERE x = y) AS same, count(*) FILTER (WHERE x <> y) AS population FROM p""")
def gap_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are paths, turns commits; a text's first letters are its blob, and one in five blobs is missing."""
    turns = table(spark, sf_dir, "conversations")
    blobs = turns.where(F.length("text") % 5 != 0).select("conv_id", "turn", F.md5(F.substring("text", 1, 3)).alias("oid"))
    return evaluation.gap_population(turns.select("conv_id", "turn"), blobs, "conv_id", "turn", "turn", 2)


@query("""
WITH f AS (SELECT l_orderkey, 'f' || l_linenumber AS name, l_partkey::VARCHAR AS content FROM lineitem WHERE l_linenumber <> 2)
SELECT l_orderkey, sha256(string_agg(chr(0) || name || chr(0) || content, '' ORDER BY name, content)) AS hash FROM f GROUP BY l_orderkey""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a packet, its lines files; the second file is left out."""
    files = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_partkey").cast("string").alias("content"))
    return evaluation.content_hash(files, "l_orderkey", "name", "content", ["f2"])


@query("SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) > 14 AS late FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's day is declared, a line ships within the window or late."""
    days = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return table(spark, sf_dir, "lineitem").join(days, "l_orderkey").select("l_orderkey", "l_linenumber", evaluation.is_late(F.col("l_shipdate"), F.col("o_orderdate")).alias("late"))


HEADINGS = "WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<h([1-6])>', 1))::INTEGER AS level, generate_subscripts(regexp_extract_all(html, '<h([1-6])>', 1), 1) - 1 AS ord FROM pages)"


@query(HEADINGS + "SELECT a.page_id, a.ord::INTEGER AS ord, a.level, min(b.ord)::INTEGER AS section_end FROM t a LEFT JOIN t b ON a.page_id = b.page_id AND b.ord > a.ord AND b.level <= a.level GROUP BY ALL")
def section_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading tags of pages are headings."""
    tags = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<h([1-6])>"), 1)).alias("ord", "level"))
    return evaluation.section_ends(tags.select("page_id", "ord", F.col("level").cast("int").alias("level")), "page_id", "ord", "level")


@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text))::VARCHAR) || unhex('00') || encode(text)) AS sha1, sha256(encode('blob ' || octet_length(encode(text))::VARCHAR) || unhex('00') || encode(text)) AS sha256 FROM documents")
def object_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs_of(spark, sf_dir).select("doc_id", scalars.blob_id(F.col("text")).alias("sha1"), scalars.blob_id(F.col("text"), "sha256").alias("sha256"))


@query("""SELECT '{"doc_id":' || doc_id || ',"labels":{"quality":' || coalesce(quality::VARCHAR, 'null') || ',"toxic":' || coalesce(toxic::VARCHAR, 'null') || '},"lang":"' || lang || '","source":"' || source || '"}' AS line FROM documents LEFT JOIN labels USING (doc_id)""")
def canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns out of order and a nested object: keys come out sorted at both depths."""
    rows = docs_of(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return records.canonical_json(rows.select("source", "lang", F.struct("toxic", "quality").alias("labels"), "doc_id"))


@query("SELECT count(*) FILTER (WHERE doc_id % 11 <> 0) AS checked, count(*) FILTER (WHERE doc_id % 11 <> 0 AND doc_id % 5 = 0) AS refused, count(*) FILTER (WHERE doc_id % 11 = 0) AS unreadable, 1 AS exit_code FROM documents")
def checked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: every fifth is not UTF-8 or holds raw html, every eleventh can't be read."""
    k = F.col("doc_id")
    text = F.when(k % 10 == 0, None).when(k % 5 == 0, F.concat(F.lit("<div>\n\n"), "text")).otherwise(F.col("text"))
    files = docs_of(spark, sf_dir).select(F.concat(F.lit("a/"), k.cast("string"), F.lit(".md")).alias("path"), text.alias("text"), (k % 11 == 0).alias("unread"))
    return checker.summary(checker.verdicts(files))


@query(r"""
WITH n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: translate(x, chr(32) || chr(9), '') <> ''))::INTEGER AS without_blocks FROM documents)
SELECT doc_id, 0 AS uncovered, 0 AS overlapping, without_blocks FROM n WHERE without_blocks > 0""")
def block_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader's own blocks cover every line once; without blocks every line is uncovered."""
    rows = docs_of(spark, sf_dir).select("doc_id", "text", documents.parse("text").alias("doc")).where("doc.accept").select("doc_id", "text", "doc.blocks")
    good = evaluation.partition_problems(rows, "doc_id", "text", "blocks")
    empty = F.array().cast("array<struct<type string, start int, end int>>")
    bare = evaluation.partition_problems(docs_of(spark, sf_dir).select("doc_id", "text", empty.alias("blocks")), "doc_id", "text", "blocks").select("doc_id", F.col("uncovered").alias("without_blocks"))
    return good.join(bare, "doc_id").where("without_blocks > 0")


@query("""
WITH e AS (SELECT doc_id AS k, lang, source FROM documents), g AS (SELECT doc_id AS k, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS lang, source FROM documents WHERE doc_id % 50 <> 0)
SELECT k, 'lang' AS field, '{"v":"' || e.lang || '"}' AS expected, CASE WHEN g.k IS NOT NULL THEN '{"v":"' || g.lang || '"}' END AS got FROM e LEFT JOIN g USING (k) WHERE e.lang IS DISTINCT FROM g.lang
UNION ALL SELECT k, 'source', '{"v":"' || e.source || '"}', NULL FROM e WHERE k NOT IN (SELECT k FROM g)""")
def case_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are cases; every seventh has another language, every fiftieth is missing."""
    docs = docs_of(spark, sf_dir).select(F.col("doc_id").alias("k"), "lang", "source")
    got = docs.where("k % 50 <> 0").withColumn("lang", F.when(F.col("k") % 7 == 0, "xx").otherwise(F.col("lang")))
    return evaluation.differences(docs, got, "k")


@query(CELLS + "SELECT verdict, count(*) AS cells, sum(wrong)::BIGINT AS wrong FROM bounded GROUP BY verdict")
def verdict_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.totals(cells(spark, sf_dir))


@query("SELECT role, length(text) > 200 AS long, count(*) AS runs, count(*) FILTER (WHERE contains(text, 'the')) AS q1, count(*) FILTER (WHERE turn = 0) AS q2 FROM conversations GROUP BY ALL")
def rehearsal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn is a run: its role the prompt, its length the size, two tests of it the checks."""
    turns = table(spark, sf_dir, "conversations").withColumn("long", F.length("text") > 200)
    return evaluation.rehearsals(turns, ["role", "long"], {"q1": F.contains("text", F.lit("the")), "q2": F.col("turn") == 0})


@query("SELECT doc_id FROM documents WHERE contains(text, 'license') ORDER BY doc_id LIMIT 1")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.first_match(docs_of(spark, sf_dir), F.contains("text", F.lit("license")), ["doc_id"]).select("doc_id")


@query(r"""
SELECT doc_id, sha256(regexp_replace(text, '[\t\n\r ]+', ' ', 'g')) AS collapsed, len(list_filter(regexp_split_to_array(text, '[\t\n\r ]+'), lambda x: x <> ''))::INTEGER AS words,
       40 * (length(text) // 3) * length(source) - 40 * length(lang) * length(text) >= 3 * length(text) * length(source) AS beats FROM documents""")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space collapsed, words counted, and an exact margin between ratios of lengths."""
    n = F.length("text")
    beats = scalars.exceeds(F.floor(n / 3), n, F.length("lang"), F.length("source"))
    return docs_of(spark, sf_dir).select("doc_id", F.sha2(scalars.collapse(F.col("text")), 256).alias("collapsed"), F.size(scalars.words(F.col("text"))).alias("words"), beats.alias("beats"))


@query("""
WITH e AS (SELECT doc_id, coalesce('{"v":' || quality || '}', '{}') AS q, coalesce('{"v":' || toxic || '}', '{}') AS t FROM labels), x AS (SELECT '{"v":"altered"}' AS x)
SELECT doc_id, 'drop' AS kind, 'quality' AS field, 'toxic=' || t AS answer FROM e UNION ALL SELECT doc_id, 'drop', 'toxic', 'quality=' || q FROM e
UNION ALL SELECT doc_id, 'alter', 'quality', 'quality=' || x || ' toxic=' || t FROM e, x UNION ALL SELECT doc_id, 'alter', 'toxic', 'quality=' || q || ' toxic=' || x FROM e, x
UNION ALL SELECT doc_id, 'add', 'extra', 'extra={"v":1} quality=' || q || ' toxic=' || t FROM e""")
def answer_alterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label is a case with two expected fields."""
    rows = evaluation.alterations(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    entries = F.transform(F.array_sort(F.map_entries("answer")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("doc_id", "kind", "field", F.array_join(entries, " ").alias("answer"))


@query("SELECT line, n, n <= 40 AS ok FROM (SELECT p_type || ': ' || p_size AS line, p_size::BIGINT AS n FROM part)")
def control_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is a report line; its size is the number that the gate bounds."""
    lines = table(spark, sf_dir, "part").select(F.concat("p_type", F.lit(": "), F.col("p_size").cast("string")).alias("line"))
    return evaluation.control_gate(lines, "line", ": ([0-9]+)$", 40)


@query("SELECT o_custkey, o_orderkey, o_orderpriority, first_value(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS declared FROM orders QUALIFY o_orderpriority IS DISTINCT FROM declared")
def changed_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are versions of one declaration, their priority its entry."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    return evaluation.changed_declarations(rows, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderpriority").drop("o_orderdate")


@query("""
WITH d AS (SELECT doc_id, CASE WHEN n_chars < 300 THEN 0 ELSE 1 END AS v FROM documents WHERE lang <> 'de')
SELECT count(*) AS packets, count(*) FILTER (WHERE quality IS NOT DISTINCT FROM v) AS agree, count(*) FILTER (WHERE quality IS DISTINCT FROM v) AS differ FROM labels JOIN d USING (doc_id)""")
def run_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are one run over the documents, a guess from their length a second one that leaves a language out."""
    guess = docs_of(spark, sf_dir).where("lang <> 'de'").select("doc_id", F.when(F.col("n_chars") < 300, 0).otherwise(1).alias("v"))
    return evaluation.agreement(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("v")), guess, "doc_id", "v")


@query()
def line_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instances of ``unit_records``: where each part went by its lines, from tables alone."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    later = turns.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("after"))
    return lineoracle.line_oracle(turns.withColumnRenamed("text", "before").join(later, ["conv_id", "turn"]), ["conv_id", "turn"])


TREE = r"""
WITH lines AS (SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
parts AS (SELECT doc_id, i, p, unnest(range(len(p))) AS j FROM (SELECT doc_id, i, string_split(l[i + 1], '. ') AS p FROM lines)),
nodes AS (
  SELECT doc_id, i, NULL AS j, regexp_matches(l[i + 1], '^[A-M]') AS root FROM lines
  UNION ALL SELECT doc_id, i, j, regexp_matches(p[j + 1], '^[TDEL]') FROM parts
)
"""


@query(TREE + """
SELECT n.doc_id, count(*) AS nodes, count(*) FILTER (n.root OR top.root OR own.root) AS held, count(*) FILTER (coalesce(top.root, false)) AS by_line
FROM nodes n LEFT JOIN nodes top ON n.doc_id = top.doc_id AND n.i = top.i AND top.j IS NULL LEFT JOIN nodes own ON n.doc_id = own.doc_id AND n.i = own.i AND n.j = own.j
GROUP BY n.doc_id""")
def node_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's lines are its nodes, their sentences the lines' children; roots are told by their first letter."""
    lines = docs_of(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    parts = lines.select("doc_id", "i", F.posexplode(F.split("x", r"\. ")).alias("j", "x"))
    nodes = lines.select("doc_id", F.array("i").alias("path"), F.col("x").rlike("^[A-M]").alias("is_root")).union(parts.select("doc_id", F.array("i", "j"), F.col("x").rlike("^[TDEL]")))
    held = containment.under(nodes, "doc_id", "path", F.col("is_root"))
    return held.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.count("root").alias("held"), F.count_if(F.size("root") == 1).alias("by_line"))


@query("""
WITH RECURSIVE edges AS (
  SELECT o_orderkey AS a, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders UNION SELECT o_orderkey, o_orderkey // 2 FROM orders WHERE o_orderkey > 0 AND o_orderkey % 64 = 0
),
pins AS (SELECT o_orderpriority, max(o_orderkey) AS pin FROM orders GROUP BY o_orderpriority),
reach(pin, a) AS (SELECT DISTINCT pin, pin FROM pins UNION SELECT r.pin, e.b FROM reach r JOIN edges e ON r.a = e.a JOIN orders o ON o.o_orderkey = e.b)
SELECT pin, a AS commit FROM reach""")
def commit_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are commits, the customer's order before is the parent; every 64th also merges the one of half its number. Each priority's last order is a pin."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    commits = orders.select(F.col("o_orderkey").alias("commit"), F.array_compact(F.array(before, F.when((F.col("o_orderkey") > 0) & (F.col("o_orderkey") % 64 == 0), F.floor(F.col("o_orderkey") / 2)))).alias("parents"))
    return history.ancestors(commits, orders.groupBy("o_orderpriority").agg(F.max("o_orderkey").alias("commit")))


@query("""
SELECT path, (row_number() OVER (PARTITION BY path ORDER BY o_orderdate, commit) - 1)::INTEGER AS version, commit, oid
FROM (SELECT DISTINCT l_partkey AS path, l_orderkey AS commit FROM lineitem) JOIN orders ON o_orderkey = commit
LEFT JOIN (SELECT l_partkey AS path, l_orderkey AS commit, min(l_suppkey) AS oid FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL) USING (path, commit)""")
def path_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are commits by date, parts the paths they touch, suppliers the blobs; returned lines leave none."""
    lines = table(spark, sf_dir, "lineitem")
    changes = lines.select(F.col("l_orderkey").alias("commit"), F.array("l_partkey").alias("paths"))
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("place"))
    blobs = lines.where("l_returnflag <> 'R'").groupBy(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("commit")).agg(F.min("l_suppkey").alias("oid"))
    return history.blob_at(history.path_history(changes, order), blobs).select("path", "version", "commit", "oid")


@query("""
SELECT l_orderkey, sha256('{"priority": "' || any_value(o_orderpriority) || '", "status": "' || any_value(o_orderstatus) || '"}' || string_agg(chr(0) || 'f' || l_linenumber || chr(0) || l_partkey, '' ORDER BY l_linenumber)) AS hash
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""")
def packet_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a packet with its fields, its lines are the files."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    fields = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("packet"), F.col("o_orderpriority").alias("priority")))
    named = orders.join(lines.select("l_orderkey").distinct(), orders["o_orderkey"] == F.col("l_orderkey"), "left_semi")
    own = named.select(F.col("o_orderkey").alias("l_orderkey"), F.lit("packet.json").alias("name"), fields.alias("content"))
    files = lines.select("l_orderkey", F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_partkey").cast("string").alias("content"))
    return evaluation.packet_hash(own.union(files).union(own.select("l_orderkey", F.lit("QUESTIONS.md"), F.lit("q"))), "l_orderkey", "name", "content")


@query("""
SELECT doc_id, source || '|' || lang || '||' || sha256(text) AS unit_key, source || '|' || lang || '||' || sha256(text) || '|' || sha256(lang) || '|' || CASE WHEN quality IS NULL THEN 'DELETED' ELSE sha256(quality::VARCHAR) END AS packet_key,
       doc_id || ':' || source AS edit_key, source || ':' || doc_id || ':5' AS span_key, 'E:' || doc_id || ':' || source AS edit_id, 'S5:' || doc_id || ':' || source AS span_id, 'M:' || doc_id || ':' || source AS merge_id
FROM documents LEFT JOIN labels USING (doc_id)""")
def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are arms or paths, languages mechanisms or found texts, a label the true text; units have no names."""
    rows = docs_of(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    arm, mech, unit, none = F.col("source"), F.col("lang"), F.sha2("text", 256), F.lit(None).cast("string")
    own, doc = verdicts.unit_key(arm, mech, none, unit), F.col("doc_id").cast("string")
    return rows.select(
        "doc_id", F.concat_ws("|", *[own[c] for c in ("arm", "mech", "name", "unit")]).alias("unit_key"), verdicts.packet_key(arm, mech, none, unit, mech, F.col("quality").cast("string")).alias("packet_key"),
        verdicts.edit_key(doc, arm).alias("edit_key"), verdicts.span_key(arm, F.col("doc_id"), F.lit(5)).alias("span_key"),
        verdicts.instance_id("E", doc, arm).alias("edit_id"), verdicts.instance_id("S", doc, arm, 5).alias("span_id"), verdicts.instance_id("M", doc, arm).alias("merge_id"),
    )


RECORDS = """
WITH r AS (
  SELECT lang AS arm, CASE WHEN doc_id % 2 = 0 THEN 'E' ELSE 'M' END AS mode, CASE WHEN n_chars % 2 = 0 THEN 'Q' ELSE 'R' END AS mech, substr(text, 1, 12) AS unit,
         CASE WHEN quality IS NULL THEN 'UNKNOWN' WHEN n_chars % 5 = 0 THEN 'UNDECIDABLE-SPLIT' WHEN n_chars % 3 = 0 THEN 'DELETED' ELSE 'SURVIVED' END AS oracle, quality IS NOT NULL AND n_chars % 5 <> 0 AS decided,
         n_chars > 100 AS prose, source <> 'src3' AS inside, n_chars % 7 <> 0 AS sound, CASE WHEN quality = 0 OR toxic = 1 THEN 'WRONG' ELSE 'correct' END AS hard_cls, CASE WHEN n_chars % 4 = 0 THEN 'WRONG' ELSE 'correct' END AS naive_cls,
         substr(text, 1, 12) || '|' || n_chars % 3 AS packet, n_chars % 11 <> 0 AS reproduced, source
  FROM documents LEFT JOIN labels USING (doc_id)
),
a AS (SELECT packet, CASE ascii(packet) % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'UNPLACEABLE' END AS tier, CASE WHEN length(packet) % 2 = 0 THEN 'no' ELSE 'yes' END AS q3, CASE WHEN ascii(substr(packet, 2)) % 3 > 0 THEN 'no' ELSE 'yes' END AS q4 FROM (SELECT DISTINCT packet FROM r WHERE arm <> 'fr'))
"""


@query(RECORDS + """,
e AS (SELECT r.*, coalesce(decided AND sound AND hard_cls = 'WRONG' AND prose, false) AS x, prose AND oracle LIKE 'UNDECIDABLE-%' AS u, tier, q3, q4, CASE WHEN NOT prose THEN NULL WHEN decided THEN 2 WHEN oracle LIKE 'UNDECIDABLE-%' THEN 1 ELSE 0 END AS rank FROM r LEFT JOIN a USING (packet) WHERE inside),
p AS (SELECT arm, mode, mech, unit, packet, any_value(tier) AS tier, any_value(q3) AS q3, any_value(q4) AS q4, bool_or(reproduced) AS again, bool_or(oracle = 'DELETED') AS deleted FROM e WHERE x GROUP BY ALL),
g AS (SELECT *, tier IS NOT NULL AND tier <> 'UNPLACEABLE' AND q4 = 'no' AS placed, q3 = 'no' AND tier IN ('A', 'B') AS fine FROM p),
pc AS (
  SELECT arm, mode, mech, count(*) AS packets, count(*) FILTER (tier IS NULL) AS untiered, count(*) FILTER (placed AND NOT again) AS differs, count(DISTINCT unit) FILTER (placed AND fine AND again) AS qualifying,
         count(DISTINCT unit) FILTER (placed AND fine AND again AND deleted) AS on_deleted, count(DISTINCT unit) FILTER (placed AND NOT fine AND again) AS near_i FROM g GROUP BY ALL
),
st AS (SELECT arm, mode, mech, count(*) FILTER (k = 2) AS decided, count(*) FILTER (k = 1) AS undecidable, count(*) FILTER (k = 0) AS unknown FROM (SELECT arm, mode, mech, unit, max(rank) AS k FROM e GROUP BY ALL) GROUP BY ALL),
c AS (
  SELECT arm, mode, mech, count(*) FILTER (prose) AS evaluated, count(*) FILTER (u) AS undecidable_instances, count(*) FILTER (prose AND oracle = 'UNKNOWN') AS unknown_instances,
         count(DISTINCT unit) FILTER (decided AND sound AND hard_cls = 'WRONG' AND NOT prose) AS near_ii, count(DISTINCT unit) FILTER (decided AND sound AND naive_cls = 'WRONG' AND hard_cls <> 'WRONG' AND prose) AS near_iii
  FROM e GROUP BY ALL
),
z AS (SELECT c.*, decided, undecidable, unknown, coalesce(packets, 0) AS packets, coalesce(untiered, 0) AS untiered, coalesce(differs, 0) AS differs, coalesce(qualifying, 0) AS qualifying, coalesce(on_deleted, 0) AS on_deleted, coalesce(near_i, 0) AS near_i, arm <> 'de' AS passes FROM c JOIN st USING (arm, mode, mech) LEFT JOIN pc USING (arm, mode, mech)),
w AS (SELECT *, CASE WHEN NOT passes THEN 'bar' WHEN untiered > 0 THEN 'untiered' WHEN qualifying > 0 THEN 'found' WHEN decided < 20 THEN 'floor' WHEN undecidable * 100 > 10 * (decided + undecidable) THEN 'undecidable' ELSE 'bound' END AS reason FROM z)
SELECT arm, mode, mech, decided, undecidable, unknown, evaluated, undecidable_instances, unknown_instances, packets, untiered, differs, qualifying, on_deleted, near_i, near_ii, near_iii,
       CASE reason WHEN 'found' THEN 'FOUND' WHEN 'bound' THEN 'NOT FOUND' ELSE 'NO VERDICT' END AS verdict, reason FROM w""")
def cell_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are records whose flags come from their length, source and labels; a text's beginning is its unit."""
    n, q = F.col("n_chars"), F.col("quality")
    unit = F.substring("text", 1, 12)
    rows = docs_of(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.col("lang").alias("arm"), F.when(F.col("doc_id") % 2 == 0, "E").otherwise("M").alias("mode"), F.when(n % 2 == 0, "Q").otherwise("R").alias("mech"), unit.alias("unit"),
        F.when(q.isNull(), "UNKNOWN").when(n % 5 == 0, "UNDECIDABLE-SPLIT").when(n % 3 == 0, "DELETED").otherwise("SURVIVED").alias("oracle"), (q.isNotNull() & (n % 5 != 0)).alias("decided"),
        (n > 100).alias("prose"), (F.col("source") != "src3").alias("inside"), (n % 7 != 0).alias("sound"), F.when((q == 0) | (F.col("toxic") == 1), "WRONG").otherwise("correct").alias("hard_cls"), F.when(n % 4 == 0, "WRONG").otherwise("correct").alias("naive_cls"),
        F.concat(unit, F.lit("|"), (n % 3).cast("string")).alias("packet"), (n % 11 != 0).alias("reproduced"),
    )
    packet = F.col("packet")
    answers = rows.where("arm <> 'fr'").select("packet").distinct().select(
        packet, F.when(F.ascii(packet) % 4 == 0, "A").when(F.ascii(packet) % 4 == 1, "B").when(F.ascii(packet) % 4 == 2, "C").otherwise("UNPLACEABLE").alias("tier"),
        F.when(F.length(packet) % 2 == 0, "no").otherwise("yes").alias("q3"), F.when(F.ascii(F.substring(packet, 2, 1 << 20)) % 3 > 0, "no").otherwise("yes").alias("q4"),
    )
    bars = rows.select("arm").distinct().select("arm", (F.col("arm") != "de").alias("passes"))
    return verdicts.cell_report(rows, answers, bars, floor=20)
