"""Queries of routing, axioms, ingest and registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import blake2b64
from ..functions.portable import micro
from ..functions.text import STOP_WORDS, terms
from ..operators import records, routing
from ..operators.lineage import ancestors
from ..sources.tables import clean_id, latest, table
from .graphs import _L, _cycle_links
from .planned import _HINTS, _asked, _domains

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


#: Which sources the declared domains name, and the words they add.
_SOURCES = [("law", "statutes", 0), ("law", "manifesto", 1), ("memory", "archive", 0), ("faith", "sacred_bible", 0)]
_WIDER = {"law": ["verdict", "Judge"], "memory": ["ledger", "the"], "faith": ["prophet"]}
_values = lambda rows: ", ".join(str(tuple(r)) for r in rows)
_WORDS = r"w AS (SELECT DISTINCT id, regexp_replace(unnest(regexp_extract_all(lower(query), '[a-z0-9_à-ÿ''\-]+')), '^''+|''+$', '', 'g') t FROM cycles)"
_STOP = ", ".join(repr(x) for x in STOP_WORDS)
_ASKED = rf"{_WORDS}, a AS (SELECT id, t FROM w WHERE length(t) >= 3 AND t NOT IN ({_STOP})), h(domain, position, term) AS (VALUES {_values(_HINTS)}), dm AS (SELECT DISTINCT id, domain, position FROM a JOIN h ON term = t)"


@query(f"""WITH {_ASKED}, s(domain, source_type, rank) AS (VALUES {_values(_SOURCES)}),
c AS (SELECT id, CASE t WHEN 'redflags' THEN 0 WHEN 'quran' THEN 1 WHEN 'allah' THEN 1 ELSE 2 END p, 0 q, CASE t WHEN 'bible' THEN 'sacred_bible' WHEN 'redflags' THEN 'red_flags' ELSE 'sacred_quran' END s FROM a WHERE t IN ('bible', 'quran', 'allah', 'redflags')
 UNION SELECT id, 10, 0, 'manifesto' FROM a WHERE t IN ({', '.join(repr(x) for x in routing.MANIFESTO_WORDS)}) UNION SELECT id, position + 20, rank, source_type FROM dm JOIN s USING (domain)),
n AS (SELECT id, 0 p, i - 1 q, (['red_flags', 'sacred_quran', 'sacred_bible', 'manifesto'])[i] s FROM (SELECT DISTINCT id FROM a WHERE id NOT IN (SELECT id FROM c)), range(1, 5) r(i)),
m AS (SELECT id, s, min(p * 100 + q) o FROM (SELECT * FROM c UNION ALL SELECT * FROM n) GROUP BY 1, 2)
SELECT id AS query_id, s AS source_type, CAST(row_number() OVER (PARTITION BY id ORDER BY o, s) AS INTEGER) AS position FROM m""")
def ret_wanted_sources(spark: SparkSession, d: str) -> DataFrame:
    return routing.wanted_sources(_asked(spark, d), _domains(spark, d), spark.createDataFrame(_SOURCES, "domain string, source_type string, rank int"))


@query(f"""WITH {_WORDS}, q AS (SELECT DISTINCT id, query FROM cycles),
x AS (SELECT id, list_filter(list_transform(regexp_extract_all(lower(query), '[a-z0-9_à-ÿ''\\-]+'), lambda v: regexp_replace(v, '^''+|''+$', '', 'g')), lambda v: length(v) >= 3 AND v NOT IN ({_STOP})) t FROM q),
y AS (SELECT id, list_concat(t, {' , '.join(f"CASE WHEN list_has_any(t, {[h[2] for h in _HINTS if h[0] == k]!r}) THEN {[v.lower() for v in vs if len(v) >= 3 and v.lower() not in STOP_WORDS]!r} ELSE [] END" for k, vs in _WIDER.items())}) l FROM x),
z AS (SELECT id, unnest(l) v, generate_subscripts(l, 1) i FROM y) SELECT id AS query_id, string_agg(v, ' ' ORDER BY i) AS terms FROM (SELECT id, v, min(i) i FROM z GROUP BY 1, 2) GROUP BY 1""")
def ret_widened(spark: SparkSession, d: str) -> DataFrame:
    wide = [F.when(F.arrays_overlap("t", F.array(*[F.lit(h[2]) for h in _HINTS if h[0] == k])), F.array(*map(F.lit, vs))) for k, vs in _WIDER.items()]
    q = table(spark, d, "cycles").select("id", "query").distinct().select(F.col("id").alias("query_id"), terms(F.col("query")).alias("t"))
    return q.select("query_id", F.array_join(routing.widened(F.col("t"), *wide), " ").alias("terms")).where("terms != ''")


def axioms(spark: SparkSession, d: str) -> DataFrame:
    """The golden records as axioms: their form is the group, their class the category."""
    g = table(spark, d, "golden_classification")
    return g.select("id", F.lower("document_type").alias("group_name"), "expected", F.array_join("subjects", ", ").alias("tags"), F.col("title").alias("statement"), F.col("rationale").alias("gloss"), (F.length("title") % 7 / 8.0).alias("severity"), (F.length("text") % 5 / 4.0).alias("mutation")).withColumnRenamed("expected", "category")


_PAD = r"' ' || regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g') || ' '"


@query(f"""WITH {_ASKED}, ax AS (SELECT id aid, lower(document_type) g, expected c, array_to_string(subjects, ', ') t, title s, rationale l, 2 * (length(title) % 7 / 8.0::DOUBLE) + length(text) % 5 / 4.0::DOUBLE b FROM golden_classification),
p AS (SELECT aid, b, lower(g) dg, lower(c) dc, lower(coalesce(t, '')) dt, {_PAD.format('g')} g, {_PAD.format('c')} c, {_PAD.format('t')} t, {_PAD.format('s')} s, {_PAD.format("concat_ws(' ', aid, g, c, s, l, t)")} w FROM ax),
q AS (SELECT id, {_PAD.format('t')} t FROM a WHERE id % 20 = 0), d2 AS (SELECT id, domain FROM dm WHERE id % 20 = 0),
x AS (SELECT q.id, aid, CASE WHEN contains(p.g, q.t) THEN 14 ELSE 0 END + CASE WHEN contains(c, q.t) THEN 12 ELSE 0 END + CASE WHEN contains(p.t, q.t) THEN 10 ELSE 0 END + CASE WHEN contains(s, q.t) THEN 6 ELSE 0 END + CASE WHEN contains(w, q.t) THEN 2 ELSE 0 END v FROM q, p WHERE trim(q.t) <> ''
 UNION ALL SELECT id, aid, CASE WHEN domain = dg THEN 15 ELSE 0 END + CASE WHEN domain = dc THEN 12 ELSE 0 END + CASE WHEN contains(dt, domain) THEN 8 ELSE 0 END FROM d2, p),
y AS (SELECT x.id, x.aid, sum(v) + any_value(b) v FROM x JOIN p ON p.aid = x.aid GROUP BY 1, 2)
SELECT id AS query_id, aid AS id, CAST(floor(v * 1e3 + 0.5) AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, aid) k FROM y) WHERE k <= 10""")
def ret_axioms(spark: SparkSession, d: str) -> DataFrame:
    some = F.col("query_id") % 20 == 0
    got = routing.axiom_scores(_asked(spark, d).where(some), _domains(spark, d).where(some), axioms(spark, d), 10)
    return got.select("query_id", "id", F.floor(F.col("score") * 1e3 + 0.5).cast("long").alias("score"))


@query("SELECT id, lower(document_type) AS group_name FROM golden_classification WHERE lower(document_type) = 'manifesto' OR expected = 'manifesto' OR starts_with(id, 'manifesto_')")
def ret_axioms_of_domain(spark: SparkSession, d: str) -> DataFrame:
    return routing.of_domain(axioms(spark, d), "manifesto").select("id", "group_name")


@query("""WITH it AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(document_id)) ORDER BY updated_at DESC NULLS LAST) r FROM corpus_items) WHERE r = 1 AND source_row_id IS NOT NULL),
p AS (SELECT source_row_id, min(lower(trim(document_id))) doc FROM it GROUP BY 1)
SELECT c.id, p.doc AS document_id, p.doc IS NOT NULL AS untrusted_content FROM (SELECT DISTINCT id, source_id FROM chunks) c LEFT JOIN p ON p.source_row_id = c.source_id""")
def ret_provenance(spark: SparkSession, d: str) -> DataFrame:
    items = latest(table(spark, d, "corpus_items").select(clean_id("document_id").alias("document_id"), "source_row_id", "updated_at"), "document_id")
    docs = items.where("source_row_id is not null").groupBy(F.col("source_row_id").alias("source_id")).agg(F.min("document_id").alias("document_id"))
    got = routing.with_provenance(table(spark, d, "chunks").select("id", "source_id").distinct(), docs, "source_id")
    return got.select("id", F.get_json_object("provenance", "$.document_id").alias("document_id"), "untrusted_content")


@query("""WITH s0 AS (SELECT DISTINCT o_custkey q, o_orderkey k, o_totalprice v FROM orders WHERE o_custkey % 20 = 0 AND o_orderpriority = '1-URGENT'), s1 AS (SELECT DISTINCT o_custkey q, o_orderkey k, o_totalprice v FROM orders WHERE o_custkey % 20 = 0),
a AS (SELECT q, k, 0 stage, row_number() OVER (PARTITION BY q ORDER BY v DESC, k) p FROM s0 UNION ALL SELECT q, k, 1, row_number() OVER (PARTITION BY q ORDER BY v DESC, k) FROM s1),
b AS (SELECT q, k, min(stage * 1000000 + p) o FROM a GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY o, k) n FROM b)
SELECT q AS query_id, k AS o_orderkey, CAST(o // 1000000 AS INTEGER) AS stage FROM r WHERE n <= 5""")
def ret_staged(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_custkey % 20 = 0").select(F.col("o_custkey").alias("query_id"), "o_orderkey", "o_totalprice", "o_orderpriority")
    ranked = lambda df: df.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    return routing.staged(ranked(o.where("o_orderpriority = '1-URGENT'")), ranked(o), key="o_orderkey", k=5).select("query_id", "o_orderkey", "stage")


@query(f"""WITH RECURSIVE {_L}, r AS (SELECT c AS node, p AS anc, 1 AS hop FROM l UNION SELECT r.node, l.p, r.hop + 1 FROM r JOIN l ON l.c = r.anc WHERE r.hop < 3), m AS (SELECT node, anc, min(hop) hop FROM r WHERE node <> anc GROUP BY 1, 2),
dir AS (SELECT DISTINCT id, model FROM cycles WHERE id % 20 = 0), ms AS (SELECT DISTINCT model, id FROM cycles WHERE id % 40 = 0),
s AS (SELECT id q, id, 1.0::DOUBLE v FROM dir UNION ALL SELECT d.id, anc, 1.0::DOUBLE / (1 + hop) FROM dir d JOIN m ON m.node = d.id UNION ALL SELECT d.id, ms.id, 0.5 FROM dir d JOIN ms ON ms.model = d.model AND ms.id <> d.id)
SELECT q AS query_id, id, CAST(floor(max(v) * 1e6 + 0.5) AS BIGINT) AS score FROM s GROUP BY 1, 2""")
def pln_canon(spark: SparkSession, d: str) -> DataFrame:
    links, _ = _cycle_links(spark, d)
    c = table(spark, d, "cycles").select("id", "model").distinct()
    direct = c.where("id % 20 = 0").select(F.col("id").alias("query_id"), "id")
    up = ancestors(links, direct.select(F.col("id").alias("node")), 3).where("node != ancestor")
    beside = c.where("id % 20 = 0").join(c.where("id % 40 = 0").select("model", F.col("id").alias("sibling")), "model").where("id != sibling").select("id", "sibling")
    got = routing.canon_candidates(direct, up, beside)
    return got.select("query_id", "id", micro("score").alias("score"))


@query("""WITH p AS (SELECT path FROM sources WHERE path IS NOT NULL AND id % 7 = 0), g AS (SELECT id FROM sources WHERE path IN (SELECT path FROM p))
SELECT 'sources' AS tab, (SELECT count(*) FROM sources WHERE path IS NULL OR path NOT IN (SELECT path FROM p)) + (SELECT count(*) FROM sources WHERE path IS NOT NULL AND id % 7 = 0) AS n
UNION ALL SELECT 'chunks', (SELECT count(*) FROM chunks WHERE source_id IS NULL OR source_id NOT IN (SELECT id FROM g)) + (SELECT count(*) FROM chunks WHERE source_id % 7 = 0 AND chunk_index = 0)""")
def src_replace(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "sources"), table(spark, d, "chunks")
    a, b = records.replace_texts(s, c, s.where("path is not null and id % 7 = 0"), c.where("source_id % 7 = 0 and chunk_index = 0"))
    return a.agg(F.count("*").alias("n")).select(F.lit("sources").alias("tab"), "n").unionByName(b.agg(F.count("*").alias("n")).select(F.lit("chunks").alias("tab"), "n"))


@query("""WITH e AS (SELECT DISTINCT document_id id, 'library/books/' || source_row_id || '.txt' path FROM corpus_items)
SELECT e.id, e.path, CASE WHEN e.id IN (SELECT manifest_id FROM sources WHERE manifest_id IS NOT NULL) THEN 'already_ingested' WHEN e.path IN (SELECT path FROM sources WHERE path IS NOT NULL AND id % 2 = 0) THEN 'adopted_existing'
 WHEN e.path IS NULL OR e.path NOT IN (SELECT path FROM sources WHERE path IS NOT NULL) THEN 'missing_file' ELSE 'ingested' END AS status FROM e""")
def src_manifest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "corpus_items").select(F.col("document_id").alias("id"), F.concat(F.lit("library/books/"), F.col("source_row_id").cast("string"), F.lit(".txt")).alias("path")).distinct()
    s = table(spark, d, "sources")
    known = s.where("manifest_id is not null").select("manifest_id", F.lit(None).cast("string").alias("path")).unionByName(s.where("id % 2 = 0").select(F.lit(None).cast("string").alias("manifest_id"), "path"))
    return records.ingest_status(e, known, s.where("path is not null").select("path"))


@query("SELECT document_id AS id, count(*) AS n FROM corpus_items GROUP BY 1 HAVING count(*) > 1 OR document_id IS NULL")
def src_repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return records.repeated_ids(table(spark, d, "corpus_items").select(F.col("document_id").alias("id")))


@query(r"""WITH x AS (SELECT DISTINCT id, trim(coalesce(nullif(trim(fragment), ''), nullif(trim(response), ''), nullif(trim(query), ''))) s, coalesce(nullif(trim(model), ''), 'general') c, final_score v FROM cycles)
SELECT id AS cycle, 'canon_' || c || '_' || substr(sha256(s), 1, 16) AS axiom, CASE WHEN coalesce(v, 0) = 0 THEN 500000 ELSE CAST(floor(v * 1e6 + 0.5) AS BIGINT) END AS severity FROM x WHERE s IS NOT NULL""")
def src_axioms(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    c = table(spark, d, "cycles").select("id", F.struct(none.alias("id"), F.col("fragment").alias("statement"), F.col("response").alias("text"), F.col("query").alias("axiom"), F.col("model").alias("category"), F.col("final_score").alias("severity"), F.lit(None).cast("double").alias("mutation")).alias("i"))
    n = c.select("id", records.normalized_axiom(F.col("i"), F.lit("canon")).alias("a")).where("a is not null")
    return n.select(F.col("id").alias("cycle"), F.col("a.id").alias("axiom"), micro("a.severity").alias("severity")).distinct()


@query(r"""WITH t AS (SELECT source_id, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index, id) txt FROM (SELECT DISTINCT id, source_id, chunk_index, content FROM chunks WHERE source_id % 10 <> 1) GROUP BY 1)
SELECT DISTINCT c.id, CASE WHEN length(content) > 0 AND instr(txt, content) > 0 THEN instr(txt, content) - 1 END::BIGINT AS char_start, CASE WHEN length(content) > 0 AND instr(txt, content) > 0 THEN instr(txt, content) - 1 + length(content) END::BIGINT AS char_end FROM chunks c LEFT JOIN t ON t.source_id = c.source_id""")
def src_offsets(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("id", "source_id", "chunk_index", "content")
    each = c.where("source_id % 10 != 1").distinct().groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "id", "content"))).alias("l"))
    texts = each.select("source_id", F.array_join(F.transform("l", lambda x: x["content"]), "\n\n").alias("text"))
    return records.found_offsets(c, texts).distinct()


@query(r"""WITH l AS (SELECT DISTINCT document_id file, 0 line_no, title line FROM corpus_items WHERE title IS NOT NULL), s AS (SELECT file, line_no, trim(regexp_replace(line, '^\s*(?:\d+[.)]|[-*•])\s*', '')) s FROM l),
h AS (SELECT *, contains(lower(s), 'tribunal')::INT + contains(lower(s), 'decree')::INT a, contains(lower(s), 'memory')::INT + contains(lower(s), 'ledger')::INT b FROM s WHERE s <> '')
SELECT theme, s AS statement, min(file) AS file, 0 AS line_no FROM (SELECT *, CASE WHEN a = 0 AND b = 0 THEN 'general' WHEN a >= b THEN 'law' ELSE 'memory' END theme FROM h) GROUP BY 1, 2""")
def src_raw_axioms(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "corpus_items").where("title is not null").select(F.col("document_id").alias("file"), F.lit(0).alias("line_no"), F.col("title").alias("line")).distinct()
    return records.raw_axioms(lines, {"law": ("tribunal", "decree"), "memory": ("memory", "ledger")})


@query("SELECT state, count(*) AS n FROM corpus_items GROUP BY 1")
def flt_allowed_column(spark: SparkSession, d: str) -> DataFrame:
    name = records.allowed_column("state", ("state", "language", "document_type"))
    return table(spark, d, "corpus_items").groupBy(F.col(name).alias("state")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderkey, o_totalprice / 1e5::DOUBLE * 0.5::DOUBLE a, (o_custkey % 7) * 0.25::DOUBLE b, (o_orderkey % 5) * -0.125::DOUBLE c FROM orders)
SELECT o_orderkey, CAST(floor(a * 1e6 + 0.5) AS BIGINT) AS price, CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN 'price' WHEN abs(b) >= abs(c) THEN 'customer' ELSE 'key' END AS first FROM c WHERE abs(a) <> abs(b) AND abs(a) <> abs(c) AND abs(b) <> abs(c)""")
def prj_contributions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    values = {"price": F.col("o_totalprice") / 1e5, "customer": (F.col("o_custkey") % 7).cast("double"), "key": (F.col("o_orderkey") % 5).cast("double")}
    c = o.select("o_orderkey", records.contributions(values, {"price": 0.5, "customer": 0.25, "key": -0.125}).alias("c"))
    p, q, r = (F.abs(F.col("c.components")[x]) for x in values)
    return c.where((p != q) & (p != r) & (q != r)).select("o_orderkey", F.floor(F.col("c.components")["price"] * 1e6 + 0.5).cast("long").alias("price"), F.col("c.top")[0].alias("first"))


@query("SELECT l_orderkey, CAST(floor(m * 1e6 + 0.5) AS BIGINT) AS confidence, o AS other FROM (SELECT l_orderkey, min(l_discount) m, min_by(l_linenumber, (l_discount, l_linenumber)) o FROM lineitem GROUP BY 1)")
def agg_weakest_link(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select("l_orderkey", F.col("l_discount").cast("double").alias("confidence"), F.col("l_linenumber").alias("other"))
    return records.weakest_link(e, "l_orderkey", "confidence").select("l_orderkey", micro("confidence").alias("confidence"), "other")


@query("""WITH k AS (SELECT model, min(created_at) AS "at" FROM cycles WHERE id % 2 = 0 AND model IS NOT NULL GROUP BY 1), n AS (SELECT model, min(created_at) AS "at" FROM cycles WHERE model IS NOT NULL AND model NOT IN (SELECT model FROM k) GROUP BY 1) SELECT * FROM k UNION ALL SELECT * FROM n""")
def reg_first_sight(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cycles").where("model is not null").select("model", F.col("created_at").alias("at"), "id")
    known = c.where("id % 2 = 0").groupBy("model").agg(F.min("at").alias("at"))
    return records.registered(known, c.select("model", "at"), "model", "at")


@query("""WITH m AS (SELECT DISTINCT id, created_at, unnest(parent_cycle_ids) o FROM cycles WHERE created_at IS NOT NULL) SELECT o AS output, arg_max(id, (created_at, id)) AS manifest FROM m WHERE o IS NOT NULL GROUP BY 1""")
def man_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For each id the latest run that names it among its outputs; cycles stand for runs, their lists of ids for outputs."""
    return records.latest_manifest(table(spark, d, "cycles").select("id", F.col("parent_cycle_ids").alias("outputs"), "created_at"), "id", "outputs", "created_at")


_TAGS = "SELECT DISTINCT c.id chunk_id, unnest(i.subjects) motif, coalesce(s.weight, 0) / 2 confidence FROM chunks c JOIN sources s ON s.id = c.source_id JOIN corpus_items i ON i.source_row_id = s.id"


def _tags(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select(F.col("id").alias("chunk_id"), "source_id")
    s = table(spark, d, "sources").select(F.col("id").alias("source_id"), (F.coalesce("weight", F.lit(0.0)) / 2).alias("confidence"))
    i = table(spark, d, "corpus_items").select(F.col("source_row_id").alias("source_id"), F.explode("subjects").alias("motif"))
    return c.join(s, "source_id").join(i, "source_id").select("chunk_id", "motif", "confidence").distinct()


@query(f"WITH t AS ({_TAGS}), e AS (SELECT motif, chunk_id, max(confidence) c FROM t GROUP BY 1, 2) SELECT motif, count(*) AS chunks, count(*) FILTER (WHERE c < 0.5) AS weak FROM e WHERE motif IS NOT NULL GROUP BY 1 HAVING count(*) >= 5 AND count(*) FILTER (WHERE c < 0.5) >= 5")
def ana_proposals(spark: SparkSession, d: str) -> DataFrame:
    return records.proposals(_tags(spark, d))


@query(f"""WITH t AS (SELECT chunk_id, CASE WHEN chunk_id % 2 = 0 THEN 'motif' ELSE 'domain' END kind, lower(trim(motif)) v, least(1, greatest(0, confidence)) c FROM ({_TAGS})), o AS (SELECT chunk_id, kind, v, max(c) c FROM t WHERE length(v) > 0 AND (kind = 'motif' OR v IN ('bells', 'archives')) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, kind ORDER BY c DESC, v) k FROM o) SELECT chunk_id, kind, v AS value, CAST(floor(c * 1e6 + 0.5) AS BIGINT) AS confidence FROM r WHERE kind <> 'motif' OR k <= 3""")
def ana_clean_tags(spark: SparkSession, d: str) -> DataFrame:
    t = _tags(spark, d).select("chunk_id", F.when(F.col("chunk_id") % 2 == 0, "motif").otherwise("domain").alias("kind"), F.col("motif").alias("value"), "confidence")
    return records.clean_tags(t, ("bells", "archives"), ("motif", "domain")).withColumn("confidence", micro("confidence"))


@query("""WITH v AS (SELECT document_id id, state, updated_at, row_number() OVER (PARTITION BY document_id ORDER BY updated_at, state) r FROM (SELECT DISTINCT document_id, state, updated_at FROM corpus_items)),
ch AS (SELECT a.id, b.r, a.state bef, b.state aft, b.updated_at AS upd FROM v a JOIN v b ON b.id = a.id AND b.r = a.r + 1), cu AS (SELECT id, arg_max(state, r) state, min(updated_at) created FROM v GROUP BY 1)
SELECT cu.id, coalesce((SELECT arg_min(bef, r) FROM ch WHERE ch.id = cu.id), state) AS state, created AS valid_from, 'initial' AS cause FROM cu UNION ALL SELECT id, aft, upd, 'change' FROM ch""")
def tmp_first_states(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "corpus_items").select(F.col("document_id").alias("id"), "state", "updated_at").distinct()
    own = Window.partitionBy("id").orderBy("updated_at", "state")
    v = v.withColumn("n", F.row_number().over(own)).withColumn("bef", F.lag("state").over(own))
    changes = v.where("n > 1").select("id", F.col("bef").alias("before"), F.col("state").alias("after"), F.col("updated_at").alias("at"), "n")
    current = v.groupBy("id").agg(F.max_by("state", "n").alias("state"), F.min("updated_at").alias("created"))
    firsts = changes.withColumnRenamed("id", "rec").withColumnRenamed("n", "id")
    return records.first_states(current.withColumnRenamed("id", "rec"), firsts, "rec").withColumnRenamed("rec", "id")


@query("""WITH c AS (SELECT DISTINCT id, parent_cycle_ids p FROM cycles WHERE parent_cycle_ids IS NOT NULL) SELECT id, list_sort(list_filter(p, lambda x: x IS NOT NULL)) AS cited FROM c""")
def qry_cited(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cycles").where("parent_cycle_ids is not null").select("id", F.to_json("parent_cycle_ids").alias("j")).distinct()
    return c.select("id", F.array_sort(records.cited_ids(F.col("j"))).alias("cited"))


@query("SELECT max(CAST(regexp_extract(id, 'gc-(\\d+)', 1) AS BIGINT)) + 1 AS next FROM golden_classification")
def qry_next_number(spark: SparkSession, d: str) -> DataFrame:
    return records.next_number(table(spark, d, "golden_classification"), "id", r"gc-(\d+)")


@query("SELECT max(o_orderdate) AS picked FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30'")
def dat_latest(spark: SparkSession, d: str) -> DataFrame:
    return records.latest_date(table(spark, d, "orders"), "o_orderdate", F.expr("TIMESTAMP_NTZ '1996-06-30 00:00:00'"))


@query("""SELECT l_orderkey, l_linenumber, CAST(floor(((l_discount + l_tax) / 2 + (coalesce(l_discount, 0) + 0.5::DOUBLE) / 4) * 1e3 + 0.5) AS BIGINT) AS pressure FROM lineitem WHERE ((l_discount + l_tax) / 2 + (l_discount + 0.5::DOUBLE) / 4) * 1e3 % 1 NOT BETWEEN 0.499 AND 0.501""")
def mth_pressure(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem")
    a, b = F.col("l_discount").cast("double"), F.col("l_tax").cast("double")
    p = records.pressure(a, b, a, F.lit(0.5))
    exact = ((a + b) / 2 + (a + 0.5) / 4) * 1e3
    return x.where(~(F.pmod(exact, F.lit(1.0)).between(0.499, 0.501))).select("l_orderkey", "l_linenumber", F.floor(p * 1e3 + 0.5).cast("long").alias("pressure"))


@query("""SELECT DISTINCT document_id, CASE WHEN list_contains(subjects, 'archives') THEN CAST(floor((1 - (list_position(subjects, 'archives') - 1) / len(subjects)::DOUBLE) * 1e6 + 0.5) AS BIGINT) ELSE 0 END AS prior FROM corpus_items""")
def arr_rank_prior(spark: SparkSession, d: str) -> DataFrame:
    p = records.rank_prior(F.col("subjects"), F.lit("archives"))
    return table(spark, d, "corpus_items").select("document_id", p.alias("p")).select("document_id", micro("p").alias("prior")).distinct()


@query("""SELECT DISTINCT candidate_id, '{"id":"' || candidate_id || '","state":"' || state || '"}' AS record FROM corpus_candidates WHERE candidate_id IS NOT NULL AND state IS NOT NULL""")
def jsn_record(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "corpus_candidates").where("candidate_id is not null and state is not null")
    return c.select("candidate_id", F.to_json(F.struct(F.col("candidate_id").alias("id"), "state")).alias("record")).distinct()


@query()
def hsh_blake2b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", blake2b64("text").alias("h"))


@query("SELECT id, created_at FROM (SELECT DISTINCT id, created_at FROM cycles) ORDER BY created_at NULLS LAST, id LIMIT 30")
def top_oldest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cycles").select("id", "created_at").distinct().orderBy(F.col("created_at").asc_nulls_last(), "id").limit(30)


@query("""SELECT state, source_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(candidate_id)) ORDER BY updated_at DESC NULLS LAST) r FROM corpus_candidates WHERE nullif(trim(candidate_id), '') IS NOT NULL) WHERE r = 1 GROUP BY 1, 2""")
def qry_by_state(spark: SparkSession, d: str) -> DataFrame:
    c = latest(table(spark, d, "corpus_candidates").select(clean_id("candidate_id").alias("candidate_id"), "state", "source_id", "updated_at"), "candidate_id")
    return c.groupBy("state", "source_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT substr(manifest_id, 5) AS document FROM sources WHERE starts_with(manifest_id, 'man-') OR starts_with(manifest_id, 'doc-')")
def qry_indexed(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").where(F.col("manifest_id").startswith("man-") | F.col("manifest_id").startswith("doc-"))
    return s.select(F.expr("substring(manifest_id, 5)").alias("document")).distinct()


@query(f"SELECT DISTINCT chunk_id FROM ({_TAGS}) WHERE lower(motif) IN ('archives', 'bells')")
def qry_chunks_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return _tags(spark, d).where(F.lower("motif").isin("archives", "bells")).select("chunk_id").distinct()
