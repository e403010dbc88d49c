"""Queries of the planner and of what is read out of model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import json_object, line_diff
from ..functions.text import STOP_WORDS
from ..operators import planner
from ..sources.tables import table

QUERIES: dict = {}
SQL: dict = {}
_HINTS = [("law", 0, "tribunal"), ("law", 0, "statute"), ("memory", 1, "archive"), ("memory", 1, "memory"), ("faith", 2, "oracle"), ("faith", 2, "heretic")]
_OPPOSED = [("law", "faith"), ("faith", "law")]


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return planner.query_terms(table(spark, d, "cycles").select(F.col("id").alias("query_id"), "query").distinct(), "query")


def _domains(spark: SparkSession, d: str) -> DataFrame:
    return planner.detected_domains(_asked(spark, d), spark.createDataFrame(_HINTS, "domain string, position int, term string"))


_TERMS = r"w AS (SELECT DISTINCT id, regexp_replace(unnest(regexp_extract_all(lower(query), '[a-z0-9_à-ÿ''\-]+')), '^''+|''+$', '', 'g') t FROM cycles)"


@query(f"WITH {_TERMS}, h(domain, position, term) AS (VALUES {', '.join(str(x) for x in _HINTS)}) SELECT DISTINCT id AS query_id, domain, position FROM w JOIN h ON term = t")
def pln_domains(spark: SparkSession, d: str) -> DataFrame:
    return _domains(spark, d)


@query(rf"""WITH {_TERMS}, a AS (SELECT id, t FROM w WHERE length(t) >= 3 AND t NOT IN ({', '.join(repr(x) for x in STOP_WORDS)})), h(domain, position, term) AS (VALUES {', '.join(str(x) for x in _HINTS)}), dm AS (SELECT DISTINCT id, domain FROM a JOIN h ON term = t),
e AS (SELECT DISTINCT unnest(string_split_regex(lower(title), '\s+')) t FROM sources), m AS (SELECT DISTINCT lower(unnest(subjects)) t FROM corpus_items)
SELECT DISTINCT id AS query_id, unnest(['LEXICAL', 'SEMANTIC', 'DOMAIN']) AS strategy FROM a UNION SELECT id, 'ENTITY' FROM a WHERE t IN (SELECT t FROM e) UNION SELECT id, 'MOTIF' FROM a WHERE t IN (SELECT t FROM m)
UNION SELECT id, 'CONTRADICTION' FROM a WHERE t IN ({', '.join(repr(x) for x in planner.CUES)}) UNION SELECT x.id, 'CONTRADICTION' FROM dm x JOIN dm y ON y.id = x.id AND x.domain = 'law' AND y.domain = 'faith'""")
def pln_strategies(spark: SparkSession, d: str) -> DataFrame:
    subjects = table(spark, d, "corpus_items").select(F.explode("subjects").alias("term")).select(F.lower("term").alias("term"))
    titles = table(spark, d, "sources").select(F.explode(F.split(F.lower("title"), r"\s+")).alias("term"))
    return planner.strategies(_asked(spark, d), titles, subjects, spark.createDataFrame(_OPPOSED, "a string, b string"), _domains(spark, d))


@query("""WITH r AS (SELECT o_custkey AS query_id, o_orderkey, o_orderpriority, o_totalprice, coalesce(CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0 END, 0) > 0.9 syn FROM orders)
SELECT o_orderkey, CASE WHEN syn THEN 'synthetic_ratio' WHEN row_number() OVER (PARTITION BY query_id, o_orderpriority, syn ORDER BY o_totalprice DESC, o_orderkey) > 3 THEN 'max_per_source' END AS exclusion_reason FROM r""")
def pln_policy(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), "o_orderkey", "o_orderpriority", "o_totalprice", F.when(F.col("o_orderstatus") == "P", 1.0).otherwise(0.0).alias("synthetic_ratio"))
    return planner.policy(r, "o_orderkey", "o_orderpriority", "o_totalprice").select("o_orderkey", "exclusion_reason")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def txt_json_object(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("Answer:\n```json\n"), F.col("props"), F.lit("\n``` done")).alias("t"))
    return e.select("event_id", F.get_json_object(json_object("t"), "$.k").alias("k"))


@query()
def txt_diff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cycles").select("id", "response", "fragment").distinct().select("id", line_diff("response", "fragment").alias("diff"))
