"""Queries of lineage, time, events, vectors and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.portable import micro
from ..functions.vectors import cosine, divergence, hamming, mean_vector
from ..operators import analytics, lineage
from ..sources.tables import clean_id, latest, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _cycle_links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "cycles").select("id", "parent_cycle_ids")
    nodes = c.select(F.col("id").alias("node")).distinct()
    links = c.select(F.col("id").alias("child"), F.explode("parent_cycle_ids").alias("parent")).distinct()
    return links.join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi").select("child", "parent"), nodes


_L = "l AS (SELECT DISTINCT a.id c, a.p FROM (SELECT id, unnest(parent_cycle_ids) p FROM cycles) a WHERE a.p IN (SELECT id FROM cycles))"


@query(f"""WITH RECURSIVE {_L}, r AS (SELECT c AS node, p AS ancestor, 1 AS hop FROM l UNION SELECT r.node, l.p, r.hop + 1 FROM r JOIN l ON l.c = r.ancestor WHERE r.hop < 3)
SELECT node, ancestor, CAST(min(hop) AS INTEGER) AS hop FROM r WHERE node <> ancestor GROUP BY 1, 2""")
def gra_ancestors(spark: SparkSession, d: str) -> DataFrame:
    links, nodes = _cycle_links(spark, d)
    return lineage.ancestors(links, nodes, 3)


@query(f"WITH {_L} SELECT DISTINCT id AS node FROM cycles WHERE id NOT IN (SELECT c FROM l)")
def gra_roots(spark: SparkSession, d: str) -> DataFrame:
    return lineage.roots(*_cycle_links(spark, d))


@query("""SELECT DISTINCT 'cycle' AS src_type, CAST(id AS VARCHAR) AS src_id, 'cycle' AS tgt_type, CAST(unnest(parent_cycle_ids) AS VARCHAR) AS tgt_id, 'DERIVED_FROM' AS relation FROM cycles
UNION SELECT 'chunk', CAST(id AS VARCHAR), 'source', CAST(source_id AS VARCHAR), 'EXTRACTED_FROM' FROM chunks""")
def gra_edges(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cycles").select("id", F.explode("parent_cycle_ids").alias("parent"))
    return lineage.edges((c, "cycle", "id", "cycle", "parent", "DERIVED_FROM"), (table(spark, d, "chunks").select("id", "source_id"), "chunk", "id", "source", "source_id", "EXTRACTED_FROM"))


@query("""WITH e AS (SELECT DISTINCT id, unnest(parent_cycle_ids) p FROM cycles), x AS (SELECT e.id, e.p, e.p IN (SELECT id FROM cycles) ok FROM e)
SELECT id, count(*) AS expected, count(*) FILTER (WHERE ok) AS found, CAST(floor(count(*) FILTER (WHERE ok) / count(*) * 1e6 + 0.5) AS BIGINT) AS completeness, coalesce(string_agg(CAST(p AS VARCHAR), ',' ORDER BY CAST(p AS VARCHAR)) FILTER (WHERE NOT ok), '') AS missing FROM x GROUP BY 1""")
def gra_supply_chain(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "cycles").select("id", F.explode("parent_cycle_ids").alias("p"))
    known = table(spark, d, "cycles").select(F.col("id").alias("p")).distinct()
    actual = e.join(known, "p", "left_semi").select("id", "p")
    return lineage.supply_chain(e, actual, ["id", "p"], "id").select("id", "expected", "found", micro("completeness").alias("completeness"), F.array_join("missing", ",").alias("missing"))


@query("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS causation_id FROM events")
def evt_causation(spark: SparkSession, d: str) -> DataFrame:
    return lineage.causation(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", "event_id").select("event_id", "causation_id")


@query("SELECT event_id, event_type, user_id FROM events WHERE event_id > 500 AND event_type = 'purchase' ORDER BY event_id LIMIT 200")
def evt_tail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_id > 500 AND event_type = 'purchase'").orderBy("event_id").limit(200).select("event_id", "event_type", "user_id")


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'CanonPromoted' WHEN 'purchase' THEN 'CanonConfirmed' WHEN 'error' THEN 'CanonRetired' ELSE 'CanonReviewed' END AS domain_event FROM events")
def evt_mapping(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for p in (("signup", "CanonPromoted"), ("purchase", "CanonConfirmed"), ("error", "CanonRetired")) for x in p])
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("CanonReviewed")).alias("domain_event"))


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE user_id = 8 GROUP BY 1")
def evt_trace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("user_id = 8").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(document_id)) ORDER BY updated_at DESC NULLS LAST) r, row_number() OVER (PARTITION BY lower(trim(document_id)) ORDER BY updated_at ASC) a FROM corpus_items)),
x AS (SELECT lower(trim(document_id)) k, state, document_type, quality_score q FROM c WHERE r = 1), y AS (SELECT lower(trim(document_id)) k, state, document_type, quality_score q FROM c WHERE a = 1)
SELECT k AS document_id, 'state' AS field, y.state AS before, x.state AS after FROM x JOIN y USING (k) WHERE x.state IS DISTINCT FROM y.state
UNION ALL SELECT k, 'document_type', y.document_type, x.document_type FROM x JOIN y USING (k) WHERE x.document_type IS DISTINCT FROM y.document_type""")
def rep_drift(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "corpus_items").select(clean_id("document_id").alias("document_id"), "state", "document_type", "updated_at")
    new = latest(i, "document_id")
    rest = ["state", "document_type", "updated_at"]
    old = i.groupBy("document_id").agg(F.min_by(F.struct(*rest), F.struct("updated_at", "state", "document_type")).alias("r")).select("document_id", "r.*")
    return lineage.drift(old, new, "document_id", ["state", "document_type"])


@query("""WITH a AS (SELECT c_nationkey g, c_custkey m FROM customer), b AS (SELECT 24 - c_nationkey g, c_custkey m FROM customer),
fa AS (SELECT string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) s FROM a GROUP BY g), fb AS (SELECT string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) s FROM b GROUP BY g)
SELECT (SELECT count(*) FROM (SELECT s FROM fa EXCEPT SELECT s FROM fb)) = 0 AND (SELECT count(*) FROM (SELECT s FROM fb EXCEPT SELECT s FROM fa)) = 0 AS same,
(SELECT count(*) FROM (SELECT s FROM fa EXCEPT SELECT s FROM fb)) AS only_a, (SELECT count(*) FROM (SELECT s FROM fb EXCEPT SELECT s FROM fa)) AS only_b""")
def rep_same_partition(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return lineage.same_partition(c.select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("member")), c.select((24 - F.col("c_nationkey")).alias("grp"), F.col("c_custkey").alias("member")))


@query("""WITH s AS (SELECT id, verdict, created_at, parent_cycle_ids, row_number() OVER (PARTITION BY id ORDER BY created_at) r FROM (SELECT DISTINCT id, verdict, created_at, parent_cycle_ids FROM cycles)),
v AS (SELECT id, verdict, created_at FROM s WHERE r = 1 AND created_at <= TIMESTAMP '2024-06-01 00:00:00')
SELECT coalesce(verdict, 'none') AS verdict, count(*) AS n FROM v GROUP BY 1""")
def tmp_valid_as_of(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "cycles").select("id", "verdict", "created_at").distinct()
    first = s.groupBy("id").agg(F.min_by(F.struct("verdict", "created_at"), F.struct("created_at", "verdict")).alias("r")).select("id", "r.*")
    return first.where("created_at <= TIMESTAMP_NTZ '2024-06-01 00:00:00'").groupBy(F.coalesce("verdict", F.lit("none")).alias("verdict")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id, lag(event_type) OVER w AS from_state, event_type AS to_state, CAST(date_diff('second', lag(ts) OVER w, ts) AS BIGINT) AS seconds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def tmp_why_changed(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    second = lambda c: F.date_trunc("second", c).cast("timestamp_ntz")
    gap = F.expr("timestampdiff(SECOND, a, b)")
    e = table(spark, d, "events").select("user_id", "event_id", F.lag("event_type").over(w).alias("from_state"), F.col("event_type").alias("to_state"), second(F.lag("ts").over(w)).alias("a"), second(F.col("ts")).alias("b"))
    return e.select("user_id", "event_id", "from_state", "to_state", gap.alias("seconds"))


@query("""WITH e AS (SELECT label, generate_subscripts(embedding, 1) i, unnest(embedding)::DOUBLE x FROM embeddings)
SELECT label, i - 1 AS pos, CAST(floor(avg(x) * 1e6 + 0.5) AS BIGINT) AS mean FROM e GROUP BY 1, 2""")
def agg_mean_vector(spark: SparkSession, d: str) -> DataFrame:
    m = mean_vector(table(spark, d, "embeddings"), ["label"], "embedding")
    return m.select("label", F.posexplode("mean").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), micro("x").alias("mean"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), c AS (SELECT v FROM v WHERE vec_id = 0)
SELECT v.vec_id, CAST(floor(list_dot_product(v.v, c.v) / (sqrt(list_dot_product(v.v, v.v)) * sqrt(list_dot_product(c.v, c.v))) * 1e6 + 0.5) AS BIGINT) AS cosine FROM v, c""")
def mth_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    one = F.broadcast(v.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    return v.crossJoin(one).select("vec_id", micro(cosine(F.col("embedding"), F.col("q"))).alias("cosine"))


@query("SELECT a.o_orderkey, CAST(bit_count(xor(a.o_orderkey * 2654435761, a.o_custkey * 40503)) AS INTEGER) AS bits FROM orders a")
def mth_hamming(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", hamming(F.col("o_orderkey") * F.lit(2654435761), F.col("o_custkey") * F.lit(40503)).alias("bits"))


@query("""WITH n AS (SELECT source, domain, count(*) n FROM documents WHERE domain IS NOT NULL GROUP BY 1, 2), s AS (SELECT source, domain, n / sum(n) OVER (PARTITION BY source) p FROM n),
g AS (SELECT domain, count(*) / (SELECT count(*) FROM documents WHERE domain IS NOT NULL) q FROM documents WHERE domain IS NOT NULL GROUP BY 1), k AS (SELECT DISTINCT source FROM s)
SELECT k.source, CAST(floor(sum(abs(coalesce(p, 0) - q)) / 2 * 1e6 + 0.5) AS BIGINT) AS divergence FROM k CROSS JOIN g LEFT JOIN s ON s.source = k.source AND s.domain = g.domain GROUP BY 1""")
def ana_divergence(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("domain is not null")
    n = t.groupBy("source", "domain").agg(F.count("*").alias("n"))
    total = n.groupBy("source").agg(F.sum("n").alias("t"))
    own = n.join(total, "source").groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("domain", (F.col("n") / F.col("t")).alias("p")))).alias("own"))
    every = n.groupBy("domain").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).agg(F.map_from_entries(F.collect_list(F.struct("domain", (F.col("n") / F.col("t")).alias("p")))).alias("every"))
    return own.crossJoin(F.broadcast(every)).select("source", micro(divergence(F.col("own"), F.col("every"))).alias("divergence"))


@query("""WITH v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) i, unnest(embedding)::DOUBLE x FROM embeddings), m AS (SELECT label, i, avg(x) x FROM v WHERE label IN (0, 1) GROUP BY 1, 2),
u AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) x FROM m), d AS (SELECT i, sum(CASE WHEN label = 0 THEN x ELSE -x END) x FROM u GROUP BY 1), a AS (SELECT i, x / sqrt(sum(x * x) OVER ()) x FROM d),
r AS (SELECT v.vec_id, any_value(label) l, sum(v.x * a.x) / sqrt(sum(v.x * v.x)) c FROM v JOIN a ON a.i = v.i GROUP BY 1) SELECT l AS label, 'order' AS name, CAST(floor(avg(c) * 1e4 + 0.5) AS BIGINT) AS value FROM r GROUP BY 1""")
def ana_readings(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    axis = analytics.axis_vector(v, "embedding", F.col("label") == 0, F.col("label") == 1).withColumn("name", F.lit("order"))
    r = analytics.readings(v, "embedding", axis)
    return r.groupBy("label", "name").agg(F.avg("value").alias("value")).select("label", "name", F.floor(F.col("value") * 1e4 + 0.5).cast("long").alias("value"))


@query("""WITH i AS (SELECT d.doc_id, source, domain, embedding FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id), v AS (SELECT source, generate_subscripts(embedding, 1) i, unnest(embedding)::DOUBLE x FROM i),
c AS (SELECT source, domain, count(*) n FROM i WHERE domain IS NOT NULL GROUP BY 1, 2)
SELECT source, 'mean' AS kind, CAST(i - 1 AS VARCHAR) AS name, CAST(floor(avg(x) * 1e6 + 0.5) AS BIGINT) AS value FROM v GROUP BY 1, i UNION ALL
SELECT source, 'share', domain, CAST(floor(n / sum(n) OVER (PARTITION BY source) * 1e6 + 0.5) AS BIGINT) FROM c""")
def ana_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    i = table(spark, d, "documents").select("doc_id", "source", "domain").join(v, "doc_id")
    f = analytics.fingerprint(i, "source", "embedding", "domain")
    mean = f.select("source", F.posexplode("mean").alias("i", "x")).select("source", F.lit("mean").alias("kind"), F.col("i").cast("string").alias("name"), "x")
    share = f.select("source", F.explode("shares").alias("name", "x")).select("source", F.lit("share").alias("kind"), "name", "x")
    return mean.unionByName(share).select("source", "kind", "name", F.floor(F.col("x") * 1e6 + 0.5).cast("long").alias("value"))


@query("""WITH o(a, b, reason) AS (VALUES ('law', 'memory', 'letter against trace'), ('astronomy', 'agriculture', 'sky against soil')), n AS (SELECT DISTINCT source, domain FROM documents WHERE domain IS NOT NULL)
SELECT x.source AS "left", y.source AS "right", o.a, o.b, o.reason FROM n x JOIN o ON o.a = x.domain JOIN n y ON y.domain = o.b""")
def ana_oppositions(spark: SparkSession, d: str) -> DataFrame:
    o = spark.createDataFrame([("law", "memory", "letter against trace"), ("astronomy", "agriculture", "sky against soil")], "a string, b string, reason string")
    n = table(spark, d, "documents").where("domain is not null").select("source", "domain").distinct()
    return analytics.opposition_edges(n, o, "source", "domain")


@query("""WITH n AS (SELECT domain, count(DISTINCT source) AS n FROM documents WHERE domain IS NOT NULL GROUP BY 1) SELECT domain, n, 12 - n AS deficit FROM n WHERE n < 12""")
def ana_gaps(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").where("domain is not null").groupBy("domain").agg(F.countDistinct("source").alias("n"))
    return n.where("n < 12").select("domain", "n", (12 - F.col("n")).alias("deficit"))


@query("""SELECT id, first_id FROM (SELECT id, min(id) OVER (PARTITION BY trim(regexp_replace(lower(query), '[^\\p{L}\\p{N}]+', ' ', 'g'))) first_id FROM (SELECT DISTINCT id, query FROM cycles)) WHERE id = first_id""".replace("\\\\", "\\"))
def ana_unique_statements(spark: SparkSession, d: str) -> DataFrame:
    key = F.trim(F.regexp_replace(F.lower("query"), r"[^\p{L}\p{N}]+", " "))
    return table(spark, d, "cycles").select("id", key.alias("k")).groupBy("k").agg(F.min("id").alias("first_id")).select(F.col("first_id").alias("id"), "first_id")


@query()
def ana_clusters(spark: SparkSession, d: str) -> DataFrame:
    k, got = analytics.kmeans_auto(table(spark, d, "embeddings"), "vec_id", "embedding")
    return got.select("vec_id", "cluster", micro("distance").alias("distance"), F.lit(k).alias("clusters"))


@query("""WITH t AS (SELECT s, count(*) AS n FROM (SELECT DISTINCT document_id, unnest(subjects) s FROM corpus_items) GROUP BY 1) SELECT s AS tag, n FROM t ORDER BY n DESC, s LIMIT 20""")
def ana_top_tags(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "corpus_items").select("document_id", F.explode("subjects").alias("tag")).distinct()
    return t.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(20)


@query("""WITH t AS (SELECT DISTINCT document_id i, unnest(subjects) t FROM corpus_items) SELECT a.t AS tag, b.t AS neighbor, count(*) AS together FROM t a JOIN t b ON a.i = b.i AND a.t <> b.t GROUP BY 1, 2""")
def ana_neighbors(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "corpus_items").select(F.col("document_id").alias("item"), F.explode("subjects").alias("tag"))
    return analytics.cooccurrence(t, "tag", "item")


@query("""WITH v AS (SELECT label, generate_subscripts(embedding, 1) i, unnest(embedding)::DOUBLE x FROM embeddings), m AS (SELECT label, i, avg(x) x FROM v GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) n FROM m GROUP BY 1)
SELECT a.label AS "left", b.label AS "right", CAST(floor((1 - sum(a.x * b.x) / any_value(na.n * nb.n)) * 1e6 + 0.5) AS BIGINT) AS distance FROM m a JOIN m b ON a.i = b.i AND a.label < b.label JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label GROUP BY 1, 2""")
def ana_distances(spark: SparkSession, d: str) -> DataFrame:
    return analytics.centroid_distances(table(spark, d, "embeddings"), "label", "embedding").select("left", "right", micro("distance").alias("distance"))


@query("""WITH e AS (SELECT DISTINCT 'DERIVED_FROM' relation, id, unnest(parent_cycle_ids) p FROM cycles), x AS (SELECT relation, p IN (SELECT id FROM cycles) ok FROM e WHERE p IS NOT NULL
 UNION ALL SELECT 'EXTRACTED_FROM', source_id IN (SELECT id FROM sources) FROM (SELECT DISTINCT id, source_id FROM chunks WHERE source_id IS NOT NULL AND id IS NOT NULL))
SELECT relation, count(*) AS edges, count(*) FILTER (WHERE NOT ok) AS gaps FROM x GROUP BY 1""")
def gra_gaps(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cycles").select("id", F.explode("parent_cycle_ids").alias("parent"))
    e = lineage.edges((c, "cycle", "id", "cycle", "parent", "DERIVED_FROM"), (table(spark, d, "chunks").select("id", "source_id"), "chunk", "id", "source", "source_id", "EXTRACTED_FROM"))
    nodes = [table(spark, d, t).select(F.lit(k).alias("tgt_type"), F.col("id").cast("string").alias("tgt_id")) for t, k in (("cycles", "cycle"), ("sources", "source"))]
    return lineage.gaps(e, nodes[0].unionByName(nodes[1]))


@query("""WITH e AS (SELECT DISTINCT id, unnest(parent_cycle_ids) p FROM cycles) SELECT 'out' AS direction, CAST(id AS VARCHAR) AS node, CAST(p AS VARCHAR) AS other FROM e WHERE p IS NOT NULL AND id % 20 = 0 UNION SELECT 'in', CAST(p AS VARCHAR), CAST(id AS VARCHAR) FROM e WHERE p % 20 = 0""")
def gra_adjacent(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cycles").select("id", F.explode("parent_cycle_ids").alias("parent"))
    e = lineage.edges((c, "cycle", "id", "cycle", "parent", "DERIVED_FROM"))
    asked = table(spark, d, "cycles").select("id").unionByName(c.select(F.col("parent").alias("id"))).where("id % 20 = 0").select(F.col("id").cast("string").alias("node")).distinct()
    return lineage.adjacent(e, asked)


@query("""SELECT DISTINCT document_id AS id, state, updated_at AS valid_from, lead(updated_at) OVER (PARTITION BY document_id ORDER BY updated_at, state) AS valid_to FROM (SELECT DISTINCT document_id, state, updated_at FROM corpus_items) QUALIFY count(*) OVER (PARTITION BY document_id) > 1""")
def tmp_history(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "corpus_items").select(F.col("document_id").alias("id"), "state", F.col("updated_at").alias("valid_from")).distinct()
    w = Window.partitionBy("id").orderBy("valid_from", "state")
    return v.withColumn("valid_to", F.lead("valid_from").over(w)).withColumn("n", F.count("*").over(Window.partitionBy("id"))).where("n > 1").drop("n")
