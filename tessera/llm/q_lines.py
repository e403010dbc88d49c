"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .inputs import chunks, providers
from .lines import places, without_lines


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    # repeated rows change neither the counts of texts nor the places
    return table(spark, sf_dir, "chunks").select("id", F.col("source_id").alias("text_id"), "content").where("content is not null")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place where a line stands that its provider repeats."""
    return places(_raw(spark, sf_dir), providers(spark, sf_dir)).select("id", "line_no").distinct()


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk without such lines, and how many were removed."""
    return without_lines(chunks(spark, sf_dir), places(_raw(spark, sf_dir), providers(spark, sf_dir)))


QUERIES = {"p4_found": p4_found, "p4_cleaned": p4_cleaned}
_LINES = r"""prov AS (SELECT DISTINCT source_row_id t, source_id p FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(document_id)) ORDER BY updated_at DESC NULLS LAST) r FROM corpus_items) WHERE r = 1 AND source_row_id IS NOT NULL),
 ch AS (SELECT DISTINCT id, source_id, content FROM chunks WHERE content IS NOT NULL),
 ln AS (SELECT id, source_id, generate_subscripts(l, 1) line_no, unnest(l) line FROM (SELECT id, source_id, string_split_regex(content, '\r?\n') l FROM ch)),
 k AS (SELECT * FROM (SELECT id, source_id, line_no, trim(regexp_replace(lower(line), '[^\p{L}]+', ' ', 'g')) k FROM ln) WHERE length(replace(k, ' ', '')) >= 20),
 n AS (SELECT p, count(DISTINCT t) n FROM prov GROUP BY p),
 al AS (SELECT count(DISTINCT source_id) a FROM chunks WHERE content IS NOT NULL),
 c AS (SELECT k, p, count(DISTINCT source_id) c FROM k LEFT JOIN prov ON t = source_id GROUP BY k, p),
 w AS (SELECT *, sum(c) OVER (PARTITION BY k) - c k0 FROM c),
 v AS (SELECT k, w.p, c::DOUBLE x, n::DOUBLE n, k0::DOUBLE k0, (a - n)::DOUBLE n0 FROM w JOIN n ON n.p = w.p, al),
 u AS (SELECT *, (x + k0) / (n + n0) q FROM v),
 g AS (SELECT *, sqrt(greatest(0, (x * ln(x / (n * q))) + (CASE WHEN n > x THEN (n - x) * ln((n - x) / (n * (1 - q))) ELSE 0 END) + (CASE WHEN k0 > 0 THEN k0 * ln(k0 / (n0 * q)) ELSE 0 END) + (CASE WHEN n0 > k0 THEN (n0 - k0) * ln((n0 - k0) / (n0 * (1 - q))) ELSE 0 END))) s FROM u),
 h AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * s) t FROM g),
 b AS (SELECT *, CAST(ceil(greatest(CASE WHEN n0 = 0 OR x * n0 > k0 * n THEN ln(t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE))))) - s * s ELSE 0 END, -100) / 0.001::DOUBLE) AS INT) bin FROM h),
 r AS (SELECT bin, sum(count(*)) OVER (ORDER BY bin) rank, sum(count(*)) OVER () tests FROM b GROUP BY bin),
 f AS (SELECT p, k FROM b WHERE bin <= (SELECT max(bin) FROM r WHERE bin * 0.001::DOUBLE <= ln(rank * 0.1::DOUBLE / tests)) AND x >= 5 AND x >= 0.1 * n),
 found AS (SELECT DISTINCT k.id, k.line_no FROM k JOIN prov ON prov.t = k.source_id JOIN f ON f.p = prov.p AND f.k = k.k)"""
SQL = {
    "p4_found": f"WITH {_LINES} SELECT * FROM found",
    "p4_cleaned": rf"""WITH {_LINES}, e AS (SELECT id, generate_subscripts(l, 1) line_no, unnest(l) line, unnest(list_concat(m, [''])) eol FROM (SELECT id, string_split_regex(content, '\r?\n') l, regexp_extract_all(content, '\r?\n') m FROM ch WHERE id IN (SELECT id FROM found))),
 o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no DESC) last FROM e ANTI JOIN found USING (id, line_no)),
 d AS (SELECT id, string_agg(line || CASE WHEN last = 1 THEN '' ELSE eol END, '' ORDER BY line_no) content FROM o GROUP BY id),
 z AS (SELECT id, count(*)::INT removed FROM found GROUP BY id)
SELECT x.id, CASE WHEN z.id IS NULL THEN x.content ELSE coalesce(d.content, '') END AS content, coalesce(removed, 0) AS removed FROM (SELECT DISTINCT id, content FROM chunks) x LEFT JOIN z ON z.id = x.id LEFT JOIN d ON d.id = x.id""",
}
