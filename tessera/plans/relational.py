"""Queries of the relational operators: predicates, joins, aggregates, windows, order and changes of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.portable import cents, micro
from ..operators.relational import all_of, as_of, as_of_join, cascade, first_per_group, insert_or_ignore, min_max, nth_of_sorted, numbered_runs, page, shares, total, upsert, upsert_keeping
from ..sources.tables import latest, table

QUERIES: dict = {}
SQL: dict = {}
_CUT = "2024-01-16 00:00:00"


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND value >= 10 AND user_id IS NOT NULL")
def flt_conjunction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(all_of(F.col("event_type") == "error", F.col("value") >= 10, None, F.col("user_id").isNotNull())).select("event_id", "user_id", "event_type")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def flt_membership(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query("SELECT DISTINCT id FROM cycles WHERE lower(query) LIKE '%archive%' OR lower(query) LIKE '%oracle%'")
def flt_contains_any(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cycles").where(F.col("query").ilike("%archive%") | F.col("query").ilike("%oracle%")).select("id").distinct()


@query("SELECT DISTINCT id FROM cycles WHERE verdict = 'CANON' AND dry_run = 0 AND fragment IS NOT NULL AND trim(fragment) <> ''")
def flt_active(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cycles").where("verdict = 'CANON' AND dry_run = 0 AND fragment IS NOT NULL AND trim(fragment) <> ''").select("id").distinct()


@query("SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-16 00:00:00' - INTERVAL 5 DAY")
def flt_older_than(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.expr(f"ts <= TIMESTAMP_NTZ '{_CUT}' - INTERVAL 5 DAYS")).select("event_id")


@query(r"""SELECT DISTINCT candidate_id, h AS host FROM (SELECT candidate_id, regexp_extract(canonical_url, '^https?://([^/:?#]+)', 1) h FROM corpus_candidates)
WHERE h = 'openfolio.example' OR h LIKE '%.openfolio.example' OR h = 'saltmarsh-repo.example' OR h LIKE '%.saltmarsh-repo.example'""")
def flt_host_allowed(spark: SparkSession, d: str) -> DataFrame:
    h = F.expr("try_parse_url(canonical_url, 'HOST')")
    allowed = None
    for bare in ("openfolio.example", "saltmarsh-repo.example"):
        p = (h == bare) | h.endswith("." + bare)
        allowed = p if allowed is None else allowed | p
    return table(spark, d, "corpus_candidates").where(allowed).select("candidate_id", h.alias("host")).distinct()


@query("SELECT DISTINCT id, CASE WHEN coalesce(weight, 0) = 0 THEN 1.0::DOUBLE ELSE weight END AS weight, coalesce(nullif(trim(author), ''), 'anonymous') AS author FROM sources")
def prj_defaults(spark: SparkSession, d: str) -> DataFrame:
    w = F.when(F.coalesce("weight", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("weight"))
    author = F.trim("author")
    return table(spark, d, "sources").select("id", w.alias("weight"), F.coalesce(F.when(author != "", author), F.lit("anonymous")).alias("author")).distinct()


@query("""SELECT c_custkey, o_orderkey, n_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey""")
def jn_three_way(spark: SparkSession, d: str) -> DataFrame:
    # the nations are a fixed table of a few rows
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "o_orderkey", "n_name")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id AND label IS NOT NULL)")
def jn_missing_keys(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "embeddings").where("label is not null").select(F.col("vec_id").alias("doc_id"))
    return table(spark, d, "documents").select("doc_id").join(known, "doc_id", "left_anti")


@query("SELECT s.id, count(DISTINCT c.id) AS chunks FROM sources s LEFT JOIN chunks c ON c.source_id = s.id GROUP BY s.id")
def jn_left_count(spark: SparkSession, d: str) -> DataFrame:
    # chunks are counted before the join, so a source with a tenth of them is one row in it
    n = table(spark, d, "chunks").select("id", F.col("source_id")).distinct().groupBy("source_id").agg(F.count("*").alias("chunks"))
    return table(spark, d, "sources").select("id").distinct().join(n, F.col("source_id") == F.col("id"), "left").select("id", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("SELECT cluster_id, string_agg(m, ',' ORDER BY m) AS members FROM (SELECT DISTINCT cluster_id, lower(trim(document_id)) m FROM corpus_duplicate_members) GROUP BY 1")
def jn_group_concat(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "corpus_duplicate_members").select("cluster_id", F.lower(F.trim("document_id")).alias("m")).distinct()
    return m.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_list("m")), ",").alias("members"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events) WHERE r = 1")
def jn_latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("e")).select("user_id", "e.*")


@query("""SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey
WHERE l_partkey = p_partkey AND o_orderstatus = 'F' AND s_acctbal > 0)""")
def jn_anti_after_joins(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    suppliers = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")
    cited = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return table(spark, d, "part").select("p_partkey").join(cited, F.col("p_partkey") == F.col("l_partkey"), "left_anti")


@query("""WITH t AS (SELECT DISTINCT p_brand tag, s_suppkey item FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R'),
x AS (SELECT a.tag, b.tag neighbor, count(*) n FROM t a JOIN t b ON a.item = b.item AND a.tag <> b.tag GROUP BY 1, 2)
SELECT tag, neighbor, n AS together FROM x""")
def jn_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.analytics import cooccurrence

    items = table(spark, d, "lineitem").where("l_returnflag = 'R'").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_brand").alias("tag"), F.col("l_suppkey").alias("item"))
    return cooccurrence(items, "tag", "item")


@query("SELECT DISTINCT doc_id FROM documents WHERE lower(trim(domain)) IN (SELECT DISTINCT lower(trim(s)) FROM (SELECT unnest(subjects) s FROM corpus_items))")
def jn_semi(spark: SparkSession, d: str) -> DataFrame:
    subjects = table(spark, d, "corpus_items").select(F.explode("subjects").alias("s")).select(F.lower(F.trim("s")).alias("k")).distinct()
    return table(spark, d, "documents").select("doc_id", F.lower(F.trim("domain")).alias("k")).join(subjects, "k", "left_semi").select("doc_id").distinct()


@query("""WITH a AS (SELECT o_custkey k, count(*) x FROM orders GROUP BY 1), b AS (SELECT c_custkey k, c_acctbal y FROM customer WHERE c_acctbal < 5000)
SELECT coalesce(a.k, b.k) AS k, coalesce(x, 0) AS orders, CAST(floor(coalesce(y, 0) * 100 + 0.5) AS BIGINT) AS balance FROM a FULL JOIN b ON a.k = b.k""")
def jn_full_merge(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("x"))
    b = table(spark, d, "customer").where("c_acctbal < 5000").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("y"))
    return a.join(b, "k", "full").select("k", F.coalesce("x", F.lit(0)).alias("orders"), cents(F.coalesce("y", F.lit(0.0))).alias("balance"))


@query("""WITH s AS (SELECT DISTINCT id, manifest_id, title FROM sources), m AS (SELECT DISTINCT lower(trim(candidate_id)) cid, title FROM corpus_candidates),
by_title AS (SELECT title, min(cid) cid FROM m GROUP BY 1)
SELECT s.id, CASE WHEN s.manifest_id IS NOT NULL THEN 'manifest' WHEN t.cid IS NOT NULL THEN 'adopted' ELSE 'missing' END AS status, coalesce(s.manifest_id, t.cid) AS adopted
FROM s LEFT JOIN by_title t ON t.title = s.title AND s.manifest_id IS NULL""")
def jn_fallback(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").select("id", "manifest_id", "title").distinct()
    t = table(spark, d, "corpus_candidates").groupBy("title").agg(F.min(F.lower(F.trim("candidate_id"))).alias("cid"))
    rest = s.where("manifest_id is null").join(t, "title", "left").select("id", F.when(F.col("cid").isNotNull(), "adopted").otherwise("missing").alias("status"), F.col("cid").alias("adopted"))
    return s.where("manifest_id is not null").select("id", F.lit("manifest").alias("status"), F.col("manifest_id").alias("adopted")).unionByName(rest)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events WHERE ts <= TIMESTAMP '2024-01-16 00:00:00') WHERE r = 1")
def jn_as_of(spark: SparkSession, d: str) -> DataFrame:
    return as_of(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id", F.lit(_CUT).cast("timestamp_ntz")).select("user_id", "event_id", "event_type")


@query("""SELECT e.event_id, (SELECT max(x.value) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'view' AND x.ts = (SELECT max(y.ts) FROM events y WHERE y.user_id = e.user_id AND y.event_type = 'view' AND y.ts <= e.ts)) AS value
FROM events e WHERE e.event_type = 'purchase'""")
def jn_as_of_many(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("vts"), "value")
    return as_of_join(left, right, "user_id", "ts", "vts", "value").select("event_id", "value")


@query("""SELECT a.event_id, min(b.event_id) AS council_event FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'signup' AND b.event_id < a.event_id WHERE a.event_type = 'error' GROUP BY 1""")
def jn_sibling_event(spark: SparkSession, d: str) -> DataFrame:
    # the first sibling of a key is one row, so the join can't fan out
    e = table(spark, d, "events")
    first = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("council_event"))
    return e.where("event_type = 'error'").select("event_id", "user_id").join(first, "user_id").where("council_event < event_id").select("event_id", "council_event")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 10) AS large FROM events GROUP BY 1")
def agg_counters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 10).alias("large"))


@query("SELECT p_brand, count(*) AS n, max(p_retailprice) AS most FROM part GROUP BY 1 HAVING count(*) >= 5")
def agg_having(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_retailprice").alias("most")).where("n >= 5")


@query("SELECT CAST(coalesce(sum(estimated_bytes), 0) AS BIGINT) AS bytes FROM corpus_candidates WHERE state = 'NO_SUCH_STATE'")
def agg_sum_or_zero(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_candidates").where("state = 'NO_SUCH_STATE'").agg(F.coalesce(F.sum("estimated_bytes"), F.lit(0)).alias("bytes"))


@query("""SELECT CAST(coalesce(sum(estimated_bytes), 0) AS BIGINT) AS bytes FROM
(SELECT estimated_bytes, row_number() OVER (PARTITION BY candidate_id ORDER BY updated_at DESC NULLS LAST, estimated_bytes DESC NULLS LAST) k FROM corpus_candidates WHERE candidate_id IS NOT NULL) WHERE k = 1""")
def agg_total_bytes(spark: SparkSession, d: str) -> DataFrame:
    # of each candidate the current version
    return total(latest(table(spark, d, "corpus_candidates"), "candidate_id", keep=["updated_at", "estimated_bytes"]), "estimated_bytes", "bytes")


@query("""WITH s AS (SELECT domain, count(*) AS weight FROM documents WHERE domain IS NOT NULL GROUP BY 1)
SELECT domain, weight, CAST(floor(weight / (SELECT sum(weight) FROM s) * 1e6 + 0.5) AS BIGINT) AS share FROM s ORDER BY weight DESC, domain LIMIT 20""")
def agg_shares(spark: SparkSession, d: str) -> DataFrame:
    out = shares(table(spark, d, "documents").where("domain is not null"), "domain", F.lit(1), 20)
    return out.select("domain", F.col("weight").cast("long").alias("weight"), micro("share").alias("share"))


@query("""SELECT source_id, document_type, state, count(*) AS n FROM corpus_items GROUP BY GROUPING SETS ((source_id), (document_type), (state), ())""")
def agg_profile(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "corpus_items").createOrReplaceTempView("tessera_items")
    return spark.sql("SELECT source_id, document_type, state, count(*) AS n FROM tessera_items GROUP BY GROUPING SETS ((source_id), (document_type), (state), ())")


@query("""SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) k, count(*) OVER (PARTITION BY event_type) n FROM events WHERE value IS NOT NULL)
WHERE k = least(n, CAST(floor(n * 0.95) AS BIGINT) + 1)""")
def agg_percentile(spark: SparkSession, d: str) -> DataFrame:
    return nth_of_sorted(table(spark, d, "events"), ["event_type"], "value", 0.95)


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1")
def agg_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "error", "view"]).count().fillna(0, ["click", "error", "view"])


@query("""SELECT l_orderkey, bool_and(l_discount > 0) AS all_discounted, bool_or(l_returnflag = 'R') AS any_returned, min(l_linenumber) AS first_line, arg_min(l_partkey, (l_extendedprice, l_linenumber, l_partkey)) AS cheapest FROM lineitem GROUP BY 1""")
def agg_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.bool_and(F.col("l_discount") > 0).alias("all_discounted"), F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.min("l_linenumber").alias("first_line"),
        F.min_by("l_partkey", F.struct("l_extendedprice", "l_linenumber", "l_partkey")).alias("cheapest"),
    )


@query("""SELECT o_orderkey, o_custkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) > 3 THEN 'max_per_source' END AS exclusion_reason FROM orders""")
def win_first_per_group(spark: SparkSession, d: str) -> DataFrame:
    return first_per_group(table(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3, "max_per_source").select("o_orderkey", "o_custkey", "exclusion_reason")


@query("""SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events""")
def win_previous(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", "event_type", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("before"))


@query("""SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r <= 50""")
def win_last_n(spark: SparkSession, d: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").withColumn("r", r).where("r <= 50").select("event_type", "event_id", "value")


@query("""SELECT p_partkey, CAST(floor((CASE WHEN hi = lo THEN 1 ELSE (hi - p_retailprice) / (hi - lo) END) * 1e6 + 0.5) AS BIGINT) AS score FROM part, (SELECT min(p_retailprice) lo, max(p_retailprice) hi FROM part)""")
def win_min_max(spark: SparkSession, d: str) -> DataFrame:
    return min_max(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "s", lower_is_better=True).select("p_partkey", micro("s").alias("score"))


@query("""SELECT event_type, event_id, CASE WHEN hi = lo THEN 4 ELSE least(7, CAST(floor((value - lo) / (hi - lo) * 8) AS INTEGER)) END AS bin
FROM (SELECT *, min(value) OVER (PARTITION BY event_type) lo, max(value) OVER (PARTITION BY event_type) hi FROM events WHERE value IS NOT NULL)""")
def win_sparkline(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value is not null")
    ends = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = F.when(F.col("hi") == F.col("lo"), 4).otherwise(F.least(F.lit(7), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 8).cast("int")))
    return e.join(F.broadcast(ends), "event_type").select("event_type", "event_id", b.alias("bin"))  # one row a type


@query("""SELECT user_id, event_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS valid_to FROM events""")
def win_intervals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", F.col("ts").alias("valid_from"), F.lead("ts").over(Window.partitionBy("user_id").orderBy("event_id")).alias("valid_to"))


@query("""SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS attempt FROM events WHERE event_type = 'error'""")
def win_attempts(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "events").where("event_type = 'error'").select("user_id", "event_id", F.count("*").over(w).alias("attempt"))


@query("""WITH x AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) i FROM events)
SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, i ORDER BY event_id) AS BIGINT) AS streak FROM x""")
def win_failure_streak(spark: SparkSession, d: str) -> DataFrame:
    return numbered_runs(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], F.col("event_type") != "error").select("event_id", "streak")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT id, title FROM (SELECT DISTINCT id, title FROM sources) ORDER BY title, id LIMIT 200 OFFSET 200")
def top_page(spark: SparkSession, d: str) -> DataFrame:
    return page(table(spark, d, "sources").select("id", "title").distinct(), ["title", "id"], 200, 200)


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderdate, o_orderkey)) AS best FROM orders GROUP BY 1")
def top_representative(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderdate", "o_orderkey")).alias("best"))


@query("""SELECT count(*) AS n FROM (SELECT o_custkey k FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' UNION SELECT user_id FROM events)""")
def set_union_count(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    b = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return a.union(b).union(table(spark, d, "events").select("user_id")).distinct().agg(F.count("*").alias("n"))


@query("""SELECT k, 'both' AS side FROM ((SELECT o_custkey k FROM orders) INTERSECT (SELECT user_id FROM events)) UNION ALL SELECT k, 'left' FROM ((SELECT o_custkey k FROM orders) EXCEPT (SELECT user_id FROM events))""")
def set_intersect_except(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "events").select(F.col("user_id").alias("k"))
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.subtract(b).withColumn("side", F.lit("left")))


@query("""WITH a AS (SELECT DISTINCT o_orderstatus g, o_custkey m FROM orders), b AS (SELECT DISTINCT o_orderpriority g, o_custkey m FROM orders),
x AS (SELECT a.g ag, b.g bg, count(*) n FROM a JOIN b ON a.m = b.m GROUP BY 1, 2), na AS (SELECT g, count(*) n FROM a GROUP BY 1), nb AS (SELECT g, count(*) n FROM b GROUP BY 1)
SELECT ag AS grp, arg_max(bg, (j, bg)) AS predecessor, CAST(floor(max(j) * 1e6 + 0.5) AS BIGINT) AS jaccard FROM (SELECT ag, bg, x.n / (na.n + nb.n - x.n) j FROM x JOIN na ON na.g = ag JOIN nb ON nb.g = bg) GROUP BY 1""")
def set_best_overlap(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.analytics import best_overlap

    o = table(spark, d, "orders")
    out = best_overlap(o.select(F.col("o_orderstatus").alias("grp"), F.col("o_custkey").alias("member")), o.select(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("member")))
    return out.select("grp", "predecessor", micro("jaccard").alias("jaccard"))


@query("""WITH n AS (SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id, event_type) r FROM events WHERE event_type <> 'signup') WHERE r = 1),
e AS (SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) r FROM events WHERE event_type = 'signup' AND value > 30) WHERE r = 1)
SELECT * FROM e UNION ALL SELECT * FROM n WHERE user_id NOT IN (SELECT user_id FROM e)""")
def dml_insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    old = e.where("event_type = 'signup' AND value > 30").groupBy("user_id").agg(F.min(F.struct("event_id", "event_type")).alias("r")).select("user_id", "r.*")
    return insert_or_ignore(old, e.where("event_type != 'signup'").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("""WITH n AS (SELECT user_id k, event_id v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events) WHERE r = 1), e AS (SELECT c_custkey k, CAST(c_nationkey AS BIGINT) v FROM customer)
SELECT * FROM n UNION ALL SELECT * FROM e WHERE k NOT IN (SELECT k FROM n)""")
def dml_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("v"))
    new = table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"))
    return upsert(old, new, ["k"], "v")


@query("""WITH e AS (SELECT c_custkey k, c_name name, c_mktsegment state FROM customer WHERE c_nationkey < 12), n AS (SELECT c_custkey k, upper(c_name) name, 'NEW' state FROM customer WHERE c_nationkey >= 6)
SELECT coalesce(e.k, n.k) AS k, coalesce(n.name, e.name) AS name, coalesce(e.state, n.state) AS state, e.k IS NULL AS is_new FROM e FULL JOIN n ON e.k = n.k""")
def dml_upsert_keeping(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    old = c.where("c_nationkey < 12").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("state"))
    new = c.where("c_nationkey >= 6").select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("name"), F.lit("NEW").alias("state"))
    return upsert_keeping(old, new, ["k"], ["state"])


@query("""WITH gone AS (SELECT o_orderkey k FROM orders WHERE o_orderstatus = 'P')
SELECT 'orders' AS tab, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT k FROM gone) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM gone)""")
def dml_cascade(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    gone = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("key"))
    a, b = cascade(gone, (orders, "o_orderkey"), (table(spark, d, "lineitem"), "l_orderkey"))
    return a.agg(F.count("*").alias("n")).select(F.lit("orders").alias("tab"), "n").union(b.agg(F.count("*").alias("n")).select(F.lit("lineitem"), "n"))


@query("SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
def dml_same_dimension(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(F.size("embedding") == 64).select("vec_id")


@query(r"""SELECT DISTINCT id, y AS year, CAST(floor((y - 1) / 100) + 1 AS INTEGER) AS century FROM (SELECT id, TRY_CAST(nullif(regexp_extract(content, '(^|[^0-9])(1[0-9]{3}|20[0-2][0-9])([^0-9]|$)', 2), '') AS INTEGER) y FROM chunks)""")
def dat_century(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import century_of, year_of

    return table(spark, d, "chunks").select("id", year_of(F.col("content")).alias("year"), century_of(F.col("content")).alias("century")).distinct()


@query("""SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY AS stale FROM orders""")
def dat_staleness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.expr("o_orderdate < TIMESTAMP_NTZ '1998-01-01 00:00:00' - INTERVAL 30 DAYS"), F.lit(True)).alias("stale"))


@query("""SELECT user_id, max(ts) IS NULL OR TIMESTAMP '2024-01-31 00:00:00' - max(ts) >= INTERVAL 1 DAY AS due FROM events GROUP BY 1""")
def dat_run_due(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("t")).select("user_id", F.coalesce(F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00' - t >= INTERVAL 1 DAY"), F.lit(True)).alias("due"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsn_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT doc_id, substr(sha256(concat_ws('|', coalesce(source, ''), coalesce(title, ''), CAST(doc_id AS VARCHAR))), 1, 16) AS stable, sha256(coalesce(text, '')) AS digest FROM documents""")
def hsh_ids(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.hashing import stable_id

    return table(spark, d, "documents").select("doc_id", stable_id(F.col("source"), F.col("title"), F.col("doc_id")).alias("stable"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
