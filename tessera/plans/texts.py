"""Queries of the text operators: chunks, terms, quality, language, scores, copies, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.portable import micro
from ..operators import dedup, evaluate, forms, language, quality, retrieval
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


_WORDS = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}]+')"
_TRIM = r"regexp_replace(regexp_replace({x}, '^[\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{3000}}]+', ''), '[\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{3000}}]+$', '')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@query(rf"""WITH t AS (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) x FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, s * 1550 s, substr(x, CAST(s * 1550 + 1 AS BIGINT), 1800) w FROM t, LATERAL (SELECT unnest(range(0, CAST(greatest(0, ceil((length(x) - 1800) / 1550.0)) AS BIGINT) + 1)) s)),
c AS (SELECT doc_id, s + length(w) - length(regexp_replace(w, '^[\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{3000}}]+', '')) a, {_TRIM.format(x='w')} t FROM w)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS chunk_index, CAST(a AS BIGINT) AS char_start, CAST(a + length(t) AS BIGINT) AS char_end, md5(t) AS digest FROM c WHERE length(t) > 0""")
def txt_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = _docs(spark, d).select("doc_id", F.explode(X.chunks(F.col("text"))).alias("c"))
    return c.select("doc_id", "c.chunk_index", "c.char_start", "c.char_end", F.md5("c.content").alias("digest"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE greatest(1, length(text) // 4) END AS tokens FROM documents")
def txt_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query(rf"""WITH w AS (SELECT id, unnest(regexp_extract_all(lower(query), '[a-z0-9_à-ÿ''\-]+')) w FROM (SELECT DISTINCT id, query FROM cycles)),
t AS (SELECT DISTINCT id, regexp_replace(w, '^''+|''+$', '', 'g') w FROM w)
SELECT id, string_agg(w, ' ' ORDER BY w) AS terms FROM t WHERE length(w) >= 3 AND w NOT IN ({', '.join(repr(x) for x in X.STOP_WORDS)}) GROUP BY id""")
def txt_terms(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "cycles").select("id", "query").distinct()
    return q.select("id", F.array_join(F.array_sort(X.terms(F.col("query"))), " ").alias("terms")).where("terms != ''")


@query(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')) AS words FROM documents")
def txt_word_count(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.word_count(F.col("text")).cast("long").alias("words"))


@query("""WITH f AS (SELECT DISTINCT id, regexp_extract_all(lower(fragment), '[a-z0-9'']+') w FROM cycles WHERE fragment IS NOT NULL),
g AS (SELECT id, unnest([array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)]) g FROM f)
SELECT g AS ngram, count(*) AS n FROM g GROUP BY 1""")
def txt_ngrams(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "cycles").where("fragment is not null").select("id", "fragment").distinct()
    g = f.select(F.explode(X.ngrams(F.regexp_extract_all(F.lower("fragment"), F.lit("[a-z0-9']+"), 0), 3)).alias("ngram"))
    return g.groupBy("ngram").agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, len(list_filter(string_split_regex(replace(text, chr(13) || chr(10), chr(10)), '\n\s*\n'), lambda p: length(regexp_replace(p, '[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+', '', 'g')) > 0)) AS paragraphs FROM documents WHERE text IS NOT NULL""")
def txt_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(X.paragraphs(F.col("text"))).cast("long").alias("paragraphs"))


@query(r"""WITH r AS (SELECT DISTINCT id, response FROM cycles), b AS (SELECT id, replace(replace(string_split(string_split(response, 'FIELD_FRAGMENT')[-1], 'METADATA_JSON')[1], 'FIELD_FRAGMENT ENDS.', ''), 'BEGIN PROSE ONLY.', '') b FROM r),
p AS (SELECT id, b IS NULL nil, list_transform(string_split_regex(replace(regexp_replace(coalesce(b, ''), '^[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+|[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+$', '', 'g'), chr(13) || chr(10), chr(10)), '\n\s*\n'), lambda x: regexp_replace(x, '^[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+|[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+$', '', 'g')) p FROM b),
k AS (SELECT id, nil, unnest(p) t, generate_subscripts(p, 1) i FROM p), f AS (SELECT id, t, i, trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) k FROM k), m AS (SELECT id, k, min(i) i, arg_min(t, i) t FROM f WHERE length(k) > 0 GROUP BY 1, 2)
SELECT p.id, CASE WHEN nil THEN NULL ELSE coalesce(string_agg(m.t, chr(10) || chr(10) ORDER BY m.i), '') END AS fragment FROM p LEFT JOIN m ON m.id = p.id GROUP BY p.id, nil, p.p""")
def txt_fragment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cycles").select("id", "response").distinct().select("id", X.fragment(F.col("response")).alias("fragment"))


@query(r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(regexp_replace(s, '[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+', '', 'g')) > 0)) AS sentences FROM documents WHERE text IS NOT NULL""")
def txt_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.size(X.sentences(F.col("text"))).cast("long").alias("sentences"))


_PAIRED = "x"
for _ in range(12):
    _PAIRED = rf"regexp_replace(regexp_replace(regexp_replace({_PAIRED}, '^[\)\]\}}]+', ''), '\(\)|\[\]|\{{\}}', '', 'g'), '(\()[\]\}}]|(\[)[\)\}}]|(\{{)[\)\]]', '\1\2\3', 'g')"


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{3000}}]+|[\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{3000}}]+$', '', 'g') t FROM documents), b AS (SELECT doc_id, t, regexp_replace(t, '[^\(\)\[\]\{{\}}]+', '', 'g') x FROM t)
SELECT doc_id, t = '' OR ends_with(t, '...') OR ends_with(t, '…') OR contains(t, '[...]') OR (length(t) - length(replace(t, '"', ''))) % 2 = 1 OR length({_PAIRED}) > 0 OR regexp_matches(t, '[,;:]$') OR regexp_matches(t, '(?i)\b(?:and|or|but|yet|then|while|because|for|the|of|to|with|from|into|in)$') OR NOT regexp_matches(t, '[.!?"”)\]}}]$') AS cut_off FROM b""")
def txt_truncated(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.truncated(F.col("text")).alias("cut_off"))


@query()
def txt_clean_unicode(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", F.md5(X.clean_unicode(X.repair_mojibake(F.col("text")))).alias("digest"))


@query(r"""WITH c AS (SELECT DISTINCT id, replace(content, chr(13) || chr(10), chr(10)) t FROM chunks), l AS (SELECT id, unnest(string_split(t, chr(10))) x FROM c WHERE t IS NOT NULL), k AS (SELECT id, x, regexp_replace(x, '^[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+|[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+$', '', 'g') k FROM l),
b AS (SELECT id, k FROM k WHERE length(k) BETWEEN 1 AND 80 GROUP BY 1, 2 HAVING count(*) >= 5 AND NOT (regexp_matches(k, '[.!?]$') AND len(string_split_regex(k, '\s+')) > 6)),
r AS (SELECT k.id, sum(length(x) + 1) FILTER (WHERE b.k IS NOT NULL) gone, count(*) n, count(b.k) g FROM k LEFT JOIN b ON b.id = k.id AND b.k = k.k GROUP BY 1)
SELECT DISTINCT c.id, CASE WHEN t IS NOT NULL THEN coalesce(CAST(gone AS INTEGER), 0) - CASE WHEN n = g THEN 1 ELSE 0 END END AS removed FROM c LEFT JOIN r ON r.id = c.id""")
def txt_repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("id", "content").distinct()
    return c.select("id", (F.length(X.one_newline(F.col("content"))) - F.length(X.strip_repeated_lines(F.col("content")))).alias("removed"))


@query(r"""WITH l AS (SELECT doc_id, list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(x, '^[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+|[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+$', '', 'g')) l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, list_filter(l, lambda x: regexp_matches(x, '(?i)^(chapter|chapitre|kapitel|cap[ií]tulo|capitolo|caput|book|livre|buch|libro|liber|part|partie|teil|parte)\s+[ivxlcdm0-9]+') OR (upper(x) = x AND regexp_matches(x, '\p{Lu}') AND length(x) BETWEEN 3 AND 90))[1:200] AS headings FROM l""")
def txt_headings(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").select("doc_id", X.headings(F.col("text")).alias("headings"))


_FOLD = r"regexp_replace(strip_accents(nfc_normalize({x})), '[^\x00-\x7f]', '', 'g')"
_KEY = r"trim(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(trim(lower({x})), '(?s)(?:\s*[:;]\s+|\s+--\s+).*$', ''), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), '" + X.ARTICLES.replace("'", "''") + "', ''))"


@query(f"SELECT DISTINCT document_id, {_KEY.format(x=_FOLD.format(x='title'))} AS title_key FROM corpus_items")
def txt_title_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_items").select("document_id", X.title_key(F.col("title")).alias("title_key")).distinct()


_NAME = r"""array_to_string(list_sort(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(lower(a), '\b\d{3,4}\s*-\s*\d{0,4}\b', ' ', 'g'), '\(.*?\)', ' ', 'g'), '[^\w\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 1)), ' ')"""
_WORK = f"{_KEY.format(x=_FOLD.format(x='title'))} || '::' || array_to_string(list_sort(list_filter(list_transform(coalesce(authors, []), lambda z: list_transform([{_FOLD.format(x='z')}], lambda a: {_NAME})[1]), lambda n: length(n) > 0)), '|') || '::' || lower(coalesce(language, ''))"


@query(f"SELECT DISTINCT document_id, CASE WHEN length({_KEY.format(x=_FOLD.format(x='title'))}) > 0 THEN {_WORK} END AS work_key FROM corpus_items")
def txt_work_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_items").select("document_id", X.work_key(F.col("title"), F.col("authors"), F.col("language")).alias("work_key")).distinct()


@query(r"""SELECT DISTINCT candidate_id, regexp_replace(substr(trim(regexp_replace(replace(replace(replace(translate(lower(title), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy'), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), '-+$', '') AS slug FROM corpus_candidates""")
def txt_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_candidates").select("candidate_id", X.slug(F.col("title")).alias("slug")).distinct()


_IDS = "list_concat(" + ", ".join(
    "list_filter(list_transform(regexp_extract_all(x, '" + p + "', 1), lambda v: " + ("" if k == "ark" else f"'{k}:' || ") + r"lower(regexp_replace(v, '[-\s]', '', 'g')))" + (", lambda v: length(v) IN (15, 18))" if k == "isbn" else ", lambda v: true)")
    for k, p in X.IDENTIFIERS
) + ")"


@query(f"SELECT DISTINCT candidate_id, list_sort(list_distinct({_IDS})) AS ids FROM (SELECT candidate_id, concat_ws(' ', external_id, canonical_url, title) x FROM corpus_candidates)")
def txt_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_candidates").select("candidate_id", X.identifiers(F.concat_ws(" ", "external_id", "canonical_url", "title")).alias("ids")).distinct()


@query(rf"""WITH w AS (SELECT id, unnest(regexp_extract_all(lower(query), '[a-z0-9_à-ÿ''\-]+')) w, generate_subscripts(regexp_extract_all(lower(query), '[a-z0-9_à-ÿ''\-]+'), 1) i FROM (SELECT DISTINCT id, query FROM cycles)),
t AS (SELECT id, regexp_replace(w, '^''+|''+$', '', 'g') w, min(i) i FROM w GROUP BY 1, 2)
SELECT id, string_agg('"' || replace(w, '"', '""') || '"', ' OR ' ORDER BY i) AS expression FROM t WHERE length(w) >= 3 AND w NOT IN ({', '.join(repr(x) for x in X.STOP_WORDS)}) GROUP BY id""")
def txt_match_query(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "cycles").select("id", "query").distinct()
    return q.select("id", X.match_query(X.terms(F.col("query"))).alias("expression")).where("expression != ''")


@query(rf"""SELECT doc_id, md5({_TRIM.format(x='text').replace('{{', '{').replace('}}', '}')}) AS body FROM documents WHERE regexp_matches(text, '\p{{L}}')""")
def txt_book_body(spark: SparkSession, d: str) -> DataFrame:
    mark = lambda x: F.lit(f"*** {x} OF THE PROJECT GUTENBERG EBOOK x ***")
    enclosed = F.concat(mark("START"), F.lit("\n"), F.col("text"), F.lit("\n"), mark("END"), F.lit("\nlicence"))
    b = _docs(spark, d).where(F.col("text").rlike(r"\p{L}")).select("doc_id", X.book_body(enclosed).alias("b"))
    return b.select("doc_id", F.md5("b.body").alias("body"))


@query(r"""WITH c AS (SELECT DISTINCT id, trim(regexp_replace(prompt, '\s+', ' ', 'g')) t FROM cycles) SELECT id, CASE WHEN length(t) > 60 THEN rtrim(substr(t, 1, 60)) || ' [...]' ELSE t END AS clipped FROM c""")
def txt_clip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cycles").select("id", X.clip(F.col("prompt"), 60).alias("clipped")).distinct()


_HITS = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in dict.fromkeys(p.split()))}))) h{i}" for i, p in enumerate(language.PROFILES.values()))
_SCORES = ", ".join(
    f"h{i} / n::DOUBLE" + "".join(f" + {w}::DOUBLE * least(0.05::DOUBLE, (length(s) - length(replace(s, '{q}', ''))) / {len(q)}::DOUBLE / greatest(length(s), 1) * 10)" for q, w in language.SIGNALS[lang]) + f" s{i}"
    for i, lang in enumerate(language.PROFILES)
)
_RANKED = ", ".join(f"{{'h': s{i}, 'i': {-i}, 'l': '{lang}'}}" for i, lang in enumerate(language.PROFILES))


@query(rf"""WITH t AS (SELECT doc_id, lower(substr(coalesce(text, ''), 1, 20000)) s FROM documents), w AS (SELECT doc_id, s, regexp_extract_all(s, '{language.WORD}') w FROM t), h AS (SELECT doc_id, s, len(w) n, {_HITS} FROM w),
c AS (SELECT doc_id, n, {_SCORES} FROM h WHERE n > 0), r AS (SELECT doc_id, n, list_reverse_sort([{_RANKED}]) r FROM c), k AS (SELECT doc_id, r[1].l lang, r[1].h h1, r[2].h h2 FROM r WHERE n >= 20 AND r[1].h >= 0.04)
SELECT d.doc_id, coalesce(k.lang, 'unknown') AS language, coalesce(CAST(floor(least(1, greatest(0, 0.45::DOUBLE + 0.55::DOUBLE * (h1 - h2) / h1)) * 1e3 + 0.5) AS BIGINT), 0) AS confidence FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id""")
def lng_function_words(spark: SparkSession, d: str) -> DataFrame:
    return language.by_function_words(_docs(spark, d), "doc_id", "text").select("doc_id", "language", F.floor(F.col("confidence") * 1e3 + 0.5).cast("long").alias("confidence"))


@query(f"""SELECT id, CASE WHEN length(m) = 3 THEN coalesce(map_extract(MAP {{{', '.join(f"'{x}': '{k}'" for k, v in language.NOTATIONS.items() for x in v if len(x) == 3)}}}, m)[1], m) ELSE m END AS code
FROM (SELECT id, regexp_replace(replace(regexp_replace(lower(trim(coalesce(language, ''))), '^.*/', ''), '_', '-'), '-.*$', '') m FROM sources)""")
def txt_language_code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").select("id", language.language_code(F.col("language")).alias("code"))


@query()
def qlt_score(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "doc_type")
    return quality.score(quality.components(docs, "doc_id", "text", "lang", "doc_type")).select("doc_id", micro("score").alias("score"), F.array_join("issues", ",").alias("issues"))


@query(r"""SELECT doc_id, length(t) AS chars, len(regexp_extract_all(t, '[\p{L}\p{N}_]+')) AS words, len(regexp_extract_all(t, '\p{L}')) AS letters, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\r]'))) AS lines
FROM (SELECT doc_id, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) t FROM documents)""")
def qlt_counts(spark: SparkSession, d: str) -> DataFrame:
    t = _docs(spark, d).select("doc_id", X.one_newline(F.coalesce("text", F.lit(""))).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t\r]"))
    return t.select("doc_id", F.length("t").alias("chars"), X.word_count(F.col("t")).cast("long").alias("words"), F.regexp_count("t", F.lit(r"\p{L}")).cast("long").alias("letters"), F.size(lines).cast("long").alias("lines"))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) c FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, c, count(*) n FROM c WHERE c <> '' GROUP BY 1, 2),
s AS (SELECT doc_id, sum(n) t, sum(n * log2(n)) s FROM n GROUP BY 1) SELECT doc_id, CAST(floor((log2(t) - s / t) * 1e4 + 0.5) AS BIGINT) AS entropy FROM s""")
def qlt_entropy(spark: SparkSession, d: str) -> DataFrame:
    return quality.entropy(_docs(spark, d), "doc_id", "text").select("doc_id", F.floor(F.col("entropy") * 1e4 + 0.5).cast("long").alias("entropy"))


@query()
def evl_fragments(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.evaluated_cycles(table(spark, d, "cycles")).select("id", micro("density").alias("density"), micro("length_score").alias("length_score"), micro("structure").alias("structure"), "cut_off", micro("quality").alias("quality"))


_WORDS_OF = r"len(regexp_extract_all(coalesce(fragment, ''), '[\p{L}\p{N}_]+'))"
_DENSITY = " + ".join(f"(length(lower(f)) - length(replace(lower(f), '{x}', ''))) // {len(x)}" for x in evaluate.SYMBOLS)


@query(rf"""WITH t AS (SELECT DISTINCT id, coalesce(fragment, '') f, coalesce(response, '') r, {_WORDS_OF} n FROM cycles),
p AS (SELECT *, len(list_filter(string_split_regex(replace(f, chr(13) || chr(10), chr(10)), '\n\s*\n'), lambda x: length(regexp_replace(x, '\s+', '', 'g')) > 0)) p FROM t)
SELECT DISTINCT id, CASE WHEN n > 0 THEN CAST(floor(least(1, ({_DENSITY}) * 20.0::DOUBLE / n) * 1e6 + 0.5) AS BIGINT) ELSE 0 END AS density,
 CASE WHEN n < 80 THEN 0 WHEN n < 140 THEN 350000 WHEN n < 220 THEN 650000 WHEN n < 450 THEN 1000000 WHEN n < 900 THEN 900000 ELSE 750000 END::BIGINT AS length_score,
 CASE WHEN n < 120 THEN 0 WHEN p >= 3 THEN 1000000 WHEN p = 2 THEN 650000 ELSE 350000 END::BIGINT AS structure,
 CAST(floor(least(1, ({' + '.join(f"contains(lower(r), '{x}')::INT" for x in evaluate.GENERIC)}) / 4.0::DOUBLE) * 1e6 + 0.5) AS BIGINT) AS generic FROM p""")
def evl_parts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "cycles").select("id", "fragment", "response").distinct()
    f, r = F.coalesce("fragment", F.lit("")), F.coalesce("response", F.lit(""))
    c = t.select("id", evaluate.density(f).alias("a"), evaluate.length_score(f).alias("b"), evaluate.structure_score(f).alias("c"), evaluate.generic(r).alias("g"))
    return c.select("id", micro("a").alias("density"), micro("b").alias("length_score"), micro("c").alias("structure"), micro("g").alias("generic")).distinct()


@query("""WITH l AS (SELECT DISTINCT id, fragment, created_at FROM cycles WHERE fragment IS NOT NULL ORDER BY created_at DESC, id DESC LIMIT 20), f AS (SELECT id, regexp_extract_all(lower(fragment), '[a-z0-9'']+') w FROM l),
g AS (SELECT DISTINCT id, unnest([array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)]) g FROM f) SELECT g AS ngram, count(*) AS n FROM g GROUP BY 1""")
def agg_motif_window(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "cycles").where("fragment is not null").select("id", "fragment", "created_at").distinct()
    return evaluate.motif_counts(f, "id", "created_at", "fragment", 20)


@query(r"""WITH f AS (SELECT DISTINCT id, fragment, created_at FROM cycles WHERE fragment IS NOT NULL), w AS (SELECT id, fragment, created_at, regexp_extract_all(lower(fragment), '[a-z0-9'']+') w FROM f),
g AS (SELECT DISTINCT id, unnest([array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)]) g FROM w), l AS (SELECT id FROM f ORDER BY created_at DESC, id DESC LIMIT 20),
n AS (SELECT g, count(*) n FROM g WHERE id IN (SELECT id FROM l) GROUP BY 1 HAVING count(*) > 6), s AS (SELECT id, sum(n - 6) e FROM g JOIN n USING (g) GROUP BY 1)
SELECT f.id, CAST(floor(least(0.35::DOUBLE, 0.07::DOUBLE * coalesce(e, 0)) * 1e6 + 0.5) AS BIGINT) AS penalty FROM f LEFT JOIN s ON s.id = f.id""")
def evl_loop_penalty(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "cycles").where("fragment is not null").select("id", "fragment", "created_at").distinct()
    return evaluate.loop_penalty(f, "id", "fragment", evaluate.motif_counts(f, "id", "created_at", "fragment", 20), 20).select("id", micro("penalty").alias("penalty"))


_FORM_ROWS = ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}', {w}::DOUBLE)" for i, (t, w) in enumerate(forms.TERMS.items()))


@query(rf"""WITH it AS (SELECT DISTINCT document_id, coalesce(document_type, '') k, array_to_string(coalesce(subjects, []), ' ') s, coalesce(title, '') t FROM corpus_items), lex(i, term, w) AS (VALUES {_FORM_ROWS}),
y AS (SELECT document_id, k, s, t, 0 f, k x FROM it UNION ALL SELECT document_id, k, s, t, 1, s FROM it UNION ALL SELECT document_id, k, s, t, 2, t FROM it),
h AS (SELECT document_id, k, s, t, f, ' ' || regexp_replace(lower(x), '[^\p{{L}}\p{{N}}\p{{M}}_\- ]', '|', 'g') || ' ' x FROM y),
m AS (SELECT document_id, k, s, t, f, i, term, w * CASE f WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8::DOUBLE ELSE 0.45::DOUBLE END w FROM h JOIN lex ON contains(x, ' ' || term || ' ') OR contains(x, ' ' || term || '|') OR contains(x, '|' || term || ' ') OR contains(x, '|' || term || '|')),
a AS (SELECT document_id, k, s, t, count(*) n, avg(w) av, min_by({{'w': w, 'f': f, 't': term}}, {{'a': -abs(w), 'f': f, 'i': i}}) b FROM m GROUP BY ALL)
SELECT DISTINCT it.document_id, CASE WHEN n IS NULL THEN 0 ELSE CAST(floor(greatest(-1, least(1, 0.6::DOUBLE * b.w + 0.4::DOUBLE * av)) * 1e6 + 0.5) AS BIGINT) END AS score,
 CASE WHEN n IS NULL THEN 0 ELSE CAST(floor(least(1, CASE b.f WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8::DOUBLE ELSE 0.45::DOUBLE END * (0.6::DOUBLE + 0.15::DOUBLE * least(n, 3))) * 1e6 + 0.5) AS BIGINT) END AS confidence, coalesce(b.t, '') AS label
FROM it LEFT JOIN a ON a.document_id = it.document_id AND a.k = it.k AND a.s = it.s AND a.t = it.t""")
def cls_form(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "corpus_items").select("document_id", forms.form(F.col("document_type"), F.col("subjects"), F.col("title")).alias("f"))
    return f.select("document_id", micro("f.score").alias("score"), micro("f.confidence").alias("confidence"), "f.label").distinct()


@query(r"""WITH t AS (SELECT doc_id, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) t FROM documents), l AS (SELECT doc_id, t, string_split(t, chr(10))[1:2000] l FROM t)
SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '(?i)^\s*(?:chapter|chapitre|kapitel|cap[ií]tulo|capitolo|book|livre|part|partie|canto)'))) AS chapters,
 len(list_filter(l, lambda x: regexp_matches(x, '(?i)^\s*(?:article|artikel|art[ií]culo|articolo|thesis|th[èe]se|these|point|§)\s*[ivxlc\d]') AND NOT regexp_matches(x, '(?i)^\s*(?:chapter|chapitre|kapitel|cap[ií]tulo|capitolo|book|livre|part|partie|canto)'))) AS articles,
 len(regexp_extract_all(substr(t, 1, 40000), '(?m)^\s*(?:\d{1,2}[.)]|[IVX]{1,4}[.)])\s+\S')) AS clauses FROM l""")
def cls_structure(spark: SparkSession, d: str) -> DataFrame:
    s = _docs(spark, d).select("doc_id", forms.structure(X.one_newline(F.col("text"))).alias("s"))
    return s.select("doc_id", F.col("s.chapters").cast("long").alias("chapters"), F.col("s.articles").cast("long").alias("articles"), F.col("s.clauses").cast("long").alias("clauses"))


@query()
def cls_classes(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "golden_classification")
    c = forms.classified(g, "document_type", "subjects", "title", "text")
    return c.select("id", "form_class.destination", micro("form_class.manifesto_score").alias("manifesto_score"), micro("form_class.confidence").alias("confidence"), "form_class.low_confidence")


@query(rf"""WITH t AS (SELECT doc_id, coalesce(title, '') ti, {_TRIM.format(x="coalesce(text, '')").replace('{{', '{').replace('}}', '}')} t FROM documents)
SELECT doc_id, md5('TITLE: ' || ti || chr(10) || chr(10) || CASE WHEN length(t) <= 6000 THEN 'FULL TEXT:' || chr(10) || t ELSE 'OPENING:' || chr(10) || substr(t, 1, 1200) || chr(10) || chr(10) || 'INTERIOR SAMPLE 1:' || chr(10) || substr(t, CAST(floor(length(t) * 0.3::DOUBLE) AS BIGINT) + 1, 1200) || chr(10) || chr(10)
 || 'INTERIOR SAMPLE 2:' || chr(10) || substr(t, CAST(floor(length(t) * 0.55::DOUBLE) AS BIGINT) + 1, 1200) || chr(10) || chr(10) || 'INTERIOR SAMPLE 3:' || chr(10) || substr(t, CAST(floor(length(t) * 0.8::DOUBLE) AS BIGINT) + 1, 1200) || chr(10) || chr(10) || 'CLOSING:' || chr(10) || right(t, 1200) END) AS digest FROM t""")
def cls_sample(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select("doc_id", F.md5(forms.sample(F.col("title"), F.array().cast("array<string>"), F.col("text"))).alias("digest"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE text IS NOT NULL")
def dup_exact(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_classes(_docs(spark, d), "doc_id", "text")


def ladder_items(spark: SparkSession, d: str) -> DataFrame:
    """The corpus items in the form :func:`dedup.ladder` takes; their texts aren't at hand, and authors are left out of the work, since catalogues list them differently."""
    items = latest(table(spark, d, "corpus_items").select(clean_id("document_id").alias("id"), "raw_sha256", "title", "authors", "language", "external_id", "normalized_chars", "quality_score", "updated_at"), "id")
    none = F.lit(None).cast("string")
    return items.select("id", F.col("raw_sha256").alias("raw"), none.alias("normalized"), F.lower("language").alias("language"), none.alias("translator"), none.alias("edition"), "title", X.work_key(F.col("title"), F.array().cast("array<string>"), F.col("language")).alias("work"), X.identifiers(F.concat(F.lit("oclc "), F.regexp_extract("external_id", r"^\d{5,}$", 0)), F.col("title")).alias("identifiers"), F.col("normalized_chars").alias("chars"), F.col("quality_score").alias("quality"))


_ITEMS = f"""it AS (SELECT * FROM (SELECT lower(trim(document_id)) id, raw_sha256 raw, title, lower(coalesce(language, '')) lang, CASE WHEN length({_KEY.format(x=_FOLD.format(x='title'))}) > 0 THEN {_KEY.format(x=_FOLD.format(x='title'))} || '::::' || lower(coalesce(language, '')) END work, coalesce(normalized_chars, 0) chars, coalesce(quality_score, 0) quality,
   {' OR '.join(f"contains(lower(title), '{m}')" for m in dedup.EDITIONS)} marked, {' OR '.join(f"contains(lower(title), '{m}')" for m in dedup.EXCERPTS)} part, list_sort(list_distinct({_IDS.replace('(x,', "(coalesce('oclc ' || nullif(regexp_extract(external_id, '^[0-9]{5,}$'), ''), '') || ' ' || coalesce(title, ''),")})) ids,
   row_number() OVER (PARTITION BY lower(trim(document_id)) ORDER BY updated_at DESC NULLS LAST) r FROM corpus_items WHERE nullif(trim(document_id), '') IS NOT NULL) WHERE r = 1),
 pr AS (SELECT a.id, b.id other, a.raw = b.raw AND a.raw <> '' same, a.lang = b.lang OR a.lang = '' OR b.lang = '' comp, list_has_any(a.ids, b.ids) named, coalesce(a.work = b.work, false) work, coalesce(a.marked, false) = coalesce(b.marked, false) ed,
   coalesce(a.part, false) = coalesce(b.part, false) AND (a.chars = 0 OR b.chars = 0 OR greatest(a.chars, b.chars) < 4 * least(a.chars, b.chars)) whole FROM it a JOIN it b ON a.id <> b.id AND (a.raw = b.raw OR a.work = b.work OR list_has_any(a.ids, b.ids))),
 v AS (SELECT id, other, CASE WHEN same THEN 'exact_raw' WHEN comp AND named AND ed THEN 'identifier' WHEN comp AND work AND ed AND whole THEN 'title_author' END kind, named OR work kin FROM pr),
 best AS (SELECT id, min(CASE kind WHEN 'exact_raw' THEN 0 WHEN 'identifier' THEN 1 WHEN 'title_author' THEN 2 END) k FROM v GROUP BY id),
 part AS (SELECT v.id, k, min(other) FILTER (WHERE (k = 0 AND kind = 'exact_raw') OR (k = 1 AND kind = 'identifier') OR (k = 2 AND kind = 'title_author')) other, min(other) FILTER (WHERE kin) kin FROM v JOIN best ON best.id = v.id GROUP BY v.id, k),
 reach AS (SELECT id, id other FROM it UNION SELECT r.id, v.other FROM reach r JOIN v ON v.id = r.other AND kind IS NOT NULL),
 cl AS (SELECT id, min(other) cluster FROM reach GROUP BY id), rep AS (SELECT cluster, max_by(it.id, (quality, chars, it.id)) representative FROM cl JOIN it ON it.id = cl.id GROUP BY cluster)"""


@query(f"""WITH RECURSIVE {_ITEMS} SELECT it.id, CASE k WHEN 0 THEN 'exact_raw' WHEN 1 THEN 'identifier' WHEN 2 THEN 'title_author' ELSE CASE WHEN kin IS NOT NULL THEN 'related' END END AS kind,
 CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.95 ELSE 0.0 END::DOUBLE AS similarity, cl.cluster, representative FROM it LEFT JOIN part ON part.id = it.id JOIN cl ON cl.id = it.id JOIN rep ON rep.cluster = cl.cluster""")
def dup_ladder(spark: SparkSession, d: str) -> DataFrame:
    return dedup.ladder(ladder_items(spark, d)).drop("duplicate_of")


@query()
def dup_ladder_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    near = dedup.simhash_pairs(docs.select(F.col("doc_id").alias("id"), "text"), "id", "text")
    none = F.lit(None).cast("string")
    plain = F.trim(F.regexp_replace("t", r"\s+", " "))
    named = docs.select(F.col("doc_id").alias("id"), F.when(F.col("t") != "", F.sha2("t", 256)).alias("raw"), F.when(plain != "", F.sha2(plain, 256)).alias("normalized"), language.language_code(F.col("lang")).alias("language"), none.alias("translator"), none.alias("edition"), "title", F.lit(None).cast("string").alias("work"), F.array().cast("array<string>").alias("identifiers"), F.length("t").alias("chars"), F.lit(0.0).alias("quality"))
    return dedup.ladder(named, near)


@query()
def dup_near(spark: SparkSession, d: str) -> DataFrame:
    return dedup.links_per_row(*dedup.near_pairs(_docs(spark, d), "doc_id", "text"), "doc_id")


@query()
def dup_simhash(spark: SparkSession, d: str) -> DataFrame:
    return dedup.links_per_row(*dedup.simhash_pairs(_docs(spark, d), "doc_id", "text"), "doc_id")


@query()
def dup_minhash(spark: SparkSession, d: str) -> DataFrame:
    return dedup.signatures(_docs(spark, d), "doc_id", "text")


def _title_queries(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.explode(F.array_distinct(X.words(F.col("title")))).alias("term"))
    return q.distinct()


@query(rf"""WITH t AS (SELECT doc_id, unnest({_WORDS.format(t='text')}) term FROM documents), p AS (SELECT doc_id, term, count(*) tf FROM t GROUP BY 1, 2),
dl AS (SELECT doc_id, sum(tf) dl FROM p GROUP BY 1), s AS (SELECT count(*) n, avg(dl) av FROM dl), q AS (SELECT DISTINCT doc_id query_id, unnest({_WORDS.format(t='title')}) term FROM documents WHERE doc_id % 20 = 0),
df AS (SELECT term, count(*) df FROM p WHERE term IN (SELECT term FROM q) GROUP BY 1),
v AS (SELECT p.doc_id, p.term, CAST(floor(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av)) * 1e6 + 0.5) AS BIGINT) s FROM p JOIN df USING (term) JOIN dl USING (doc_id), s),
r AS (SELECT query_id, doc_id, CAST(sum(s) AS BIGINT) score FROM q JOIN v USING (term) GROUP BY 1, 2)
SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) k FROM r) WHERE k <= 10""")
def ret_bm25(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25(_title_queries(spark, d), _docs(spark, d), "doc_id", "text", 10)


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), s AS (SELECT q.vec_id query_id, n.vec_id, list_dot_product(q.v, n.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(n.v, n.v))) s FROM n q, n WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, CAST(floor(s * 1e6 + 0.5) AS BIGINT) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) k FROM s) WHERE k <= 10""")
def ret_knn(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.knn(q, v, "vec_id", "embedding", 10).select("query_id", "vec_id", micro("similarity").alias("similarity"))


def hybrid_results(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """Documents for each twentieth one's title and vector."""
    over = max(5 * k, 50)
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    q = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    near = retrieval.knn(q, v, "doc_id", "embedding", over)
    lexical = retrieval.bm25(_title_queries(spark, d), _docs(spark, d), "doc_id", "text", over)
    facts = table(spark, d, "documents").select("doc_id", F.when(F.col("domain") == "law", 1.0).otherwise(0.0).alias("domain_prior"), (F.col("doc_id") % 4 / 4.0).alias("source_weight"), (F.col("doc_id") % 3 / 2.0).alias("severity"))
    return retrieval.hybrid(lexical, near, "doc_id", facts, k)


@query(rf"""WITH t AS (SELECT doc_id, unnest({_WORDS.format(t='text')}) term FROM documents), p AS (SELECT doc_id, term, count(*) tf FROM t GROUP BY 1, 2), dl AS (SELECT doc_id, sum(tf) dl FROM p GROUP BY 1), st AS (SELECT count(*) n, avg(dl) av FROM dl),
q AS (SELECT DISTINCT doc_id query_id, unnest({_WORDS.format(t='title')}) term FROM documents WHERE doc_id % 20 = 0), df AS (SELECT term, count(*) df FROM p WHERE term IN (SELECT term FROM q) GROUP BY 1),
v AS (SELECT p.doc_id, p.term, CAST(floor(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av)) * 1e6 + 0.5) AS BIGINT) s FROM p JOIN df USING (term) JOIN dl USING (doc_id), st),
r AS (SELECT query_id, doc_id, CAST(sum(s) AS BIGINT) score FROM q JOIN v USING (term) GROUP BY 1, 2), lx AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) k FROM r) WHERE k <= 50),
n AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings), sm AS (SELECT a.vec_id query_id, n.vec_id doc_id, list_dot_product(a.e, n.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(n.e, n.e))) s FROM n a, n WHERE a.vec_id % 20 = 0),
nr AS (SELECT query_id, doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) k FROM sm) WHERE k <= 50),
b AS (SELECT coalesce(lx.query_id, nr.query_id) query_id, coalesce(lx.doc_id, nr.doc_id) doc_id, score, s FROM lx FULL JOIN nr ON nr.query_id = lx.query_id AND nr.doc_id = lx.doc_id),
m AS (SELECT *, min(score) OVER (PARTITION BY query_id) lo, max(score) OVER (PARTITION BY query_id) hi FROM b),
f AS (SELECT query_id, m.doc_id, CAST(floor((0.35::DOUBLE * coalesce(s, 0) + 0.25::DOUBLE * CASE WHEN score IS NULL THEN 0 WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo)::DOUBLE END + 0.2::DOUBLE * CASE WHEN domain = 'law' THEN 1 ELSE 0 END + 0.15::DOUBLE * CASE WHEN coalesce(d.doc_id % 4, 0) = 0 THEN 1.0::DOUBLE ELSE (d.doc_id % 4) / 4.0::DOUBLE END + 0.05::DOUBLE * coalesce(d.doc_id % 3, 0) / 2.0::DOUBLE) * 1e6 + 0.5) AS BIGINT) score FROM m LEFT JOIN documents d ON d.doc_id = m.doc_id)
SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) k FROM f) WHERE k <= 10""")
def ret_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return hybrid_results(spark, d)


@query()
def ret_mmr(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    pool = retrieval.knn(q, v, "vec_id", "embedding", 30).join(v.select("vec_id", "embedding"), "vec_id")
    return retrieval.mmr(pool, "vec_id", "embedding", "similarity", 5)


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), s AS (SELECT q.vec_id query_id, n.vec_id, n.v, list_dot_product(q.v, n.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(n.v, n.v))) s FROM n q, n WHERE q.vec_id % 20 = 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) k FROM s) WHERE k <= 10)
SELECT a.query_id, a.vec_id, CAST(floor((1 - coalesce(max(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))), 0)) * 1e6 + 0.5) AS BIGINT) AS novelty FROM t a LEFT JOIN t b ON b.query_id = a.query_id AND b.k < a.k GROUP BY 1, 2""")
def ret_novelty(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    top = retrieval.knn(q, v, "vec_id", "embedding", 10).join(v.select("vec_id", "embedding"), "vec_id")
    return retrieval.ranked_diversity(top, "vec_id", "embedding", "similarity").select("query_id", "vec_id", micro("novelty").alias("novelty"))
