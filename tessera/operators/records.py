"""Rules over records: ingest, registers, reports and read queries of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def replace_texts(sources: DataFrame, chunks: DataFrame, new_sources: DataFrame, new_chunks: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """``(sources, chunks)`` after texts were read again: whoever has the path of a new one goes, with its chunks; then the new ones follow.

    ``chunks`` have ``source_id``, the ``id`` of their source. Null paths name
    no text and replace none.
    """
    gone = sources.join(new_sources.select(key).distinct(), key, "left_semi").select(F.col("id").alias("source_id"))
    kept = sources.join(new_sources.select(key).distinct(), key, "left_anti").select(*sources.columns)
    left = chunks.join(gone, "source_id", "left_anti").select(*chunks.columns)
    return kept.unionByName(new_sources.select(*sources.columns)), left.unionByName(new_chunks.select(*chunks.columns))


def ingest_status(entries: DataFrame, known: DataFrame, files: DataFrame) -> DataFrame:
    """``(id, path, status)`` of the entries of a manifest: already ingested by id, adopted by path, missing on disk, or ingested now."""
    by_id = known.where("manifest_id is not null").select(F.col("manifest_id").alias("id")).distinct().withColumn("_i", F.lit(1))
    by_path = known.where("path is not null").select("path").distinct().withColumn("_p", F.lit(1))
    there = files.select("path").distinct().withColumn("_f", F.lit(1))
    out = entries.select("id", "path").join(by_id, "id", "left").join(by_path, "path", "left").join(there, "path", "left")
    status = F.when(F.col("_i").isNotNull(), "already_ingested").when(F.col("_p").isNotNull(), "adopted_existing").when(F.col("_f").isNull(), "missing_file").otherwise("ingested")
    return out.select("id", "path", status.alias("status"))


def repeated_ids(entries: DataFrame) -> DataFrame:
    """Ids that a manifest names more than once, or not at all (null): with any of them it is refused."""
    return entries.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null")


def normalized_axiom(item: Column, group: Column) -> Column:
    """``(id, group_name, category, statement, severity, mutation)`` of a raw entry; null without a statement.

    The statement is the first of three fields that isn't blank; a missing or
    zero severity or mutation counts as a half.
    """
    first = lambda *names: F.coalesce(*[F.when(F.length(strip(item[n])) > 0, strip(item[n])) for n in names])
    half = lambda c: F.when(F.coalesce(c, F.lit(0.0)) == 0, 0.5).otherwise(c)
    statement = first("statement", "text", "axiom")
    category = F.coalesce(first("category"), F.lit("general"))
    named = F.concat_ws("_", group, category, F.substring(F.sha2(statement, 256), 1, 16))
    return F.when(statement.isNotNull(), F.struct(F.coalesce(first("id"), named).alias("id"), group.alias("group_name"), category.alias("category"), statement.alias("statement"), half(item["severity"]).alias("severity"), half(item["mutation"]).alias("mutation")))


def found_offsets(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """``(id, char_start, char_end)`` of chunks where they stand word for word in their source's text; both null where they don't.

    ``chunks`` has ``id``, ``source_id`` and ``content``, ``texts``
    ``source_id`` and ``text``. The first place counts.
    """
    both = chunks.select("id", "source_id", "content").join(texts.select("source_id", "text"), "source_id", "left")
    at = F.expr("locate(content, text)")
    found = F.coalesce((at > 0) & (F.length("content") > 0), F.lit(False))
    return both.select("id", F.when(found, at - 1).cast("long").alias("char_start"), F.when(found, at - 1 + F.length("content")).cast("long").alias("char_end"))


def raw_axioms(lines: DataFrame, themes: dict[str, tuple[str, ...]]) -> DataFrame:
    """``(theme, statement, file, line_no)`` of raw sentences ``(file, line_no, line)``, each theme and statement once, from the first place.

    A number before a sentence goes; its theme is the one most of whose words
    stand in it, the first of equal ones, ``general`` if none does.
    """
    s = strip(F.regexp_replace("line", r"^\s*(?:\d+[.)]|[-*•])\s*", ""))
    hits = [F.struct(sum((F.contains(F.lower("statement"), F.lit(w)).cast("int") for w in words), F.lit(0)).alias("h"), F.lit(-i).alias("i"), F.lit(name).alias("t")) for i, (name, words) in enumerate(themes.items())]
    best = F.array_max(F.array(*hits))
    each = lines.select("file", "line_no", s.alias("statement")).where("statement != ''").withColumn("theme", F.when(best["h"] > 0, best["t"]).otherwise("general"))
    return each.groupBy("theme", "statement").agg(F.min(F.struct("file", "line_no")).alias("p")).select("theme", "statement", "p.*")


def allowed_column(name: str, allowed: tuple[str, ...]) -> str:
    """A column's name if it may be grouped by; an error for any other."""
    if name not in allowed:
        raise ValueError(f"can't group by {name!r}; allowed are {', '.join(allowed)}")
    return name


def contributions(values: dict[str, Column], weights: dict[str, float], most: int = 3) -> Column:
    """``(components, top)``: what each part adds to a score (its value times its weight, by name), and the names of the largest parts."""
    parts = F.array(*[F.struct((-F.abs(F.coalesce(values[n], F.lit(0.0)) * w)).alias("o"), F.lit(n).alias("name"), (F.coalesce(values[n], F.lit(0.0)) * w).alias("value")) for n, w in weights.items()])
    named = F.map_from_arrays(F.transform(parts, lambda p: p["name"]), F.transform(parts, lambda p: p["value"]))
    return F.struct(named.alias("components"), F.transform(F.slice(F.array_sort(parts), 1, most), lambda p: p["name"]).alias("top"))


def weakest_link(edges: DataFrame, node: str, confidence: str) -> DataFrame:
    """``(node, confidence, other)``: of each node the edge of least confidence, ties by the other end's name; nulls are no confidence."""
    return edges.where(F.col(confidence).isNotNull()).groupBy(node).agg(F.min(F.struct(confidence, "other")).alias("w")).select(node, f"w.{confidence}", "w.other")


def registered(known: DataFrame, seen: DataFrame, key: str, at: str) -> DataFrame:
    """A register after a look: known entries stay as they are, others enter at their first sight, ties by the whole row."""
    cols = [c for c in known.columns if c != key]
    new = seen.where(F.col(key).isNotNull()).join(known.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(at, *[c for c in cols if c != at])).alias("r")).select(key, "r.*")
    return known.unionByName(new.select(*known.columns))


def latest_manifest(runs: DataFrame, key: str, outputs: str, at: str) -> DataFrame:
    """``(output, manifest)``: of each id that runs name among their outputs, the latest run, ties by the greater key; runs without a time are left out."""
    each = runs.where(F.col(at).isNotNull()).select(key, at, F.explode(outputs).alias("output")).where("output is not null")
    return each.groupBy("output").agg(F.max_by(key, F.struct(at, key)).alias("manifest"))


def proposals(tags: DataFrame, least: int = 5, below: float = 0.5) -> DataFrame:
    """``(motif, chunks, weak)``: motifs of ``least`` chunks or more in ``least`` of which nothing is surer than ``below``.

    ``tags`` has ``chunk_id``, ``motif`` and ``confidence``; a missing
    confidence counts as 0.
    """
    each = tags.where("motif is not null").groupBy("motif", "chunk_id").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("c"))
    return each.groupBy("motif").agg(F.count("*").alias("chunks"), F.count_if(F.col("c") < below).alias("weak")).where((F.col("chunks") >= least) & (F.col("weak") >= least))


def clean_tags(tags: DataFrame, domains: tuple[str, ...], kinds: tuple[str, ...], motifs: int = 3) -> DataFrame:
    """Tags ``(chunk_id, kind, value, confidence)`` as they may be stored: known kinds and domains only, confidence within 0 and 1, the surest motifs."""
    from pyspark.sql.window import Window

    value = F.lower(strip(F.col("value")))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    ok = tags.select("chunk_id", "kind", value.alias("value"), sure.alias("confidence")).where(F.col("kind").isin(*kinds) & (F.length("value") > 0) & ((F.col("kind") != "domain") | F.col("value").isin(*domains)))
    once = ok.groupBy("chunk_id", "kind", "value").agg(F.max("confidence").alias("confidence"))
    rank = F.row_number().over(Window.partitionBy("chunk_id", "kind").orderBy(F.desc("confidence"), "value"))
    return once.withColumn("_r", rank).where((F.col("kind") != "motif") | (F.col("_r") <= motifs)).drop("_r")


def first_states(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``(key, state, valid_from, cause)``: the states a record went through, rebuilt from its changes.

    ``current`` has ``key``, ``state`` and ``created``; ``changes`` ``key``,
    ``id``, ``before``, ``after`` and ``at``. The first state is what the first
    change found, else the current one; then one row for each change.
    """
    first = changes.groupBy(key).agg(F.min(F.struct("id", "before")).alias("f"))
    begun = current.join(first, key, "left").select(key, F.coalesce("f.before", "state").alias("state"), F.col("created").alias("valid_from"), F.lit("initial").alias("cause"))
    return begun.unionByName(changes.select(key, F.col("after").alias("state"), F.col("at").alias("valid_from"), F.lit("change").alias("cause")))


def cited_ids(c: Column) -> Column:
    """The ids in a JSON list, as numbers or as strings of digits; whatever else stands there is left out."""
    every = F.from_json(c, "array<string>")
    return F.filter(F.transform(F.coalesce(every, F.array().cast("array<string>")), lambda x: F.when(x.rlike(r"^\d{1,18}$"), x.cast("long"))), lambda x: x.isNotNull())


def next_number(names: DataFrame, name: str, pattern: str) -> DataFrame:
    """``(next)``: one more than the greatest number that names of a series carry; 1 for none."""
    n = F.try_to_number(F.regexp_extract(name, pattern, 1), F.lit("999999999"))
    return names.select(n.alias("n")).agg((F.coalesce(F.max("n"), F.lit(0)) + 1).cast("long").alias("next"))


def latest_date(dates: DataFrame, date: str, not_after: Column) -> DataFrame:
    """``(picked)``: the greatest date that isn't after a bound; null if there is none."""
    return dates.where(F.col(date) <= not_after).agg(F.max(date).alias("picked"))


def pressure(s1: Column, s2: Column, m1: Column, m2: Column) -> Column:
    """How hard two opposed axioms press: the mean of their severities and a quarter of their mutations, to three places."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.round((zero(s1) + zero(s2)) / 2 + (zero(m1) + zero(m2)) / 4, 3)


def rank_prior(items: Column, value: Column) -> Column:
    """1 for the first of a list, less towards its end, 0 for what isn't in it."""
    at = F.array_position(items, value)
    return F.when(F.coalesce(at, F.lit(0)) == 0, 0.0).otherwise(1 - (at - 1) / F.array_size(items))
