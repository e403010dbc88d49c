import pytest
from pyspark.sql import functions as F

from tessera.functions.text import terms
from tessera.operators import records, routing


def test_ingest_replaces_by_path(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "id long, path string")
    c = spark.createDataFrame([(10, 1), (11, 2), (12, None), (13, 4), (14, 3)], "id long, source_id long")
    new_s, new_c = spark.createDataFrame([(9, "a"), (8, None)], "id long, path string"), spark.createDataFrame([(90, 9)], "id long, source_id long")
    a, b = records.replace_texts(s, c, new_s, new_c)
    assert sorted(r["id"] for r in a.collect()) == [2, 3, 8, 9] and sorted(r["id"] for r in b.collect()) == [11, 12, 14, 90]
    a, b = records.replace_texts(s.where("false"), c.where("false"), new_s.where("false"), new_c.where("false"))
    assert a.count() == b.count() == 0


def test_status_and_repeats(spark):
    e = spark.createDataFrame([("x", "p1"), ("y", "p2"), ("z", "p3"), (None, None), ("w", "p4"), ("w", "p4")], "id string, path string")
    known = spark.createDataFrame([("x", None), (None, "p2"), ("other", "p9")], "manifest_id string, path string")
    got = {(r["id"], r["status"]) for r in records.ingest_status(e, known, spark.createDataFrame([("p3",), ("p1",)], "path string")).collect()}
    assert got == {("x", "already_ingested"), ("y", "adopted_existing"), ("z", "ingested"), (None, "missing_file"), ("w", "missing_file")}
    assert {(r["id"], r["n"]) for r in records.repeated_ids(e).collect()} == {("w", 2), (None, 1)}


def test_axioms_offsets_and_lines(spark):
    item = "id string, statement string, text string, axiom string, category string, severity double, mutation double"
    df = spark.createDataFrame([(None, " ", "Ash falls", None, None, 0.0, None), ("k", "S", None, None, "c", 0.9, 0.2), (None, None, "", "  ", None, None, None)], item)
    got = [r["a"] for r in df.select(records.normalized_axiom(F.struct(*df.columns), F.lit("g")).alias("a")).collect()]
    assert got[0]["id"].startswith("g_general_") and (got[0]["severity"], got[0]["mutation"]) == (0.5, 0.5) and tuple(got[1])[0] == "k" and got[1]["severity"] == 0.9 and got[2] is None
    c = spark.createDataFrame([(1, 1, "is 𐌀"), (2, 1, "no"), (3, 2, "x"), (4, 1, ""), (5, 1, None)], "id long, source_id long, content string")
    t = spark.createDataFrame([(1, "this is 𐌀 is")], "source_id long, text string")
    assert {r["id"]: r["char_start"] for r in records.found_offsets(c, t).collect()} == {1: 5, 2: None, 3: None, 4: None, 5: None}
    lines = spark.createDataFrame([("f", 2, "2) The ledger burns"), ("e", 1, "The ledger burns"), ("f", 3, " "), ("f", 4, None), ("f", 5, "- Plain")], "file string, line_no int, line string")
    assert {tuple(r) for r in records.raw_axioms(lines, {"memory": ("ledger",)}).collect()} == {("memory", "The ledger burns", "e", 1), ("general", "Plain", "f", 5)}


def test_registers_tags_and_numbers(spark):
    known = spark.createDataFrame([("m", 5)], "model string, at int")
    seen = spark.createDataFrame([("m", 1), ("n", 9), ("n", 7), (None, 1)], "model string, at int")
    assert {tuple(r) for r in records.registered(known, seen, "model", "at").collect()} == {("m", 5), ("n", 7)}
    tags = spark.createDataFrame([(1, "motif", " Ash ", 2.0), (1, "motif", "b", None), (1, "motif", "c", 0.3), (1, "motif", "d", 0.2), (1, "domain", "law", 0.4), (1, "domain", "nope", 1.0), (1, "odd", "x", 1.0), (2, "motif", None, 1.0)], "chunk_id long, kind string, value string, confidence double")
    assert {(r["kind"], r["value"], r["confidence"]) for r in records.clean_tags(tags, ("law",), ("motif", "domain")).collect()} == {("motif", "ash", 1.0), ("motif", "c", 0.3), ("motif", "d", 0.2), ("domain", "law", 0.4)}
    each = spark.createDataFrame([(i, "m", None if i % 2 else 0.4) for i in range(5)] + [(9, "m", 0.9), (1, "few", 0.1), (1, None, 0.1)], "chunk_id long, motif string, confidence double")
    assert [tuple(r) for r in records.proposals(each).collect()] == [("m", 6, 5)]
    assert spark.createDataFrame([('["12", 7, "x", null, ""]',), ("no",), (None,)], "j string").select(records.cited_ids(F.col("j")).alias("c")).collect() == [([12, 7],), ([],), ([],)]
    names = spark.createDataFrame([("s-09",), ("s-11",), ("x",), (None,)], "n string")
    assert records.next_number(names, "n", r"s-(\d+)").collect()[0][0] == 12 and records.next_number(names.where("false"), "n", r"s-(\d+)").collect()[0][0] == 1
    with pytest.raises(ValueError):
        records.allowed_column("x; drop", ("state",))
    p = spark.range(1).select(records.pressure(F.lit(0.5), F.lit(None).cast("double"), F.lit(0.2), F.lit(0.2)).alias("p"), records.rank_prior(F.array(F.lit("a"), F.lit("b")), F.lit("b")).alias("b"), records.rank_prior(F.array(F.lit("a")), F.lit("z")).alias("z")).collect()[0]
    assert tuple(p) == (0.35, 0.5, 0.0)


def test_states_from_changes(spark):
    now = spark.createDataFrame([("a", "CANON", 1), ("b", "NOISE", 2)], "k string, state string, created int")
    changes = spark.createDataFrame([("a", 7, "HERESY", "CANON", 9), ("a", 5, "DRAFT", "HERESY", 8)], "k string, id int, before string, after string, at int")
    assert sorted(tuple(r) for r in records.first_states(now, changes, "k").collect()) == [("a", "CANON", 9, "change"), ("a", "DRAFT", 1, "initial"), ("a", "HERESY", 8, "change"), ("b", "NOISE", 2, "initial")]


def test_routing(spark):
    q = spark.createDataFrame([(1, "The bible and the redflags of the state"), (2, "weaving"), (3, None)], "query_id long, q string")
    asked = q.select("query_id", F.explode(terms(F.col("q"))).alias("term"))
    domains = spark.createDataFrame([(1, "law", 0)], "query_id long, domain string, position int")
    of = spark.createDataFrame([("law", "statutes", 0), ("law", "manifesto", 1)], "domain string, source_type string, rank int")
    got = {}
    for r in routing.wanted_sources(asked, domains, of).orderBy("query_id", "position").collect():
        got.setdefault(r["query_id"], []).append(r["source_type"])
    assert got == {1: ["red_flags", "sacred_bible", "manifesto", "statutes"], 2: list(routing.ELSEWHERE)}
    wide = spark.range(1).select(routing.widened(F.array(F.lit("Ash"), F.lit("of")), F.array(F.lit("ash"), F.lit("x"), F.lit("Bell")), F.lit(None).cast("array<string>")).alias("w")).collect()[0]["w"]
    assert wide == ["ash", "bell"]


def test_axiom_scores_equal_all_pairs(spark):
    ax = [("a1", "law", "canon law", "seal, law book", "The seal of law", None, 0.5, 0.1), ("a2", None, None, None, "weaving the seal", "gloss", None, None), ("a3", "x", "y", "z", "nothing", "n", 0.9, 0.0), ("a4", "weaving", "", "", "", "", 0.0, 0.0)]
    axioms = spark.createDataFrame(ax, "id string, group_name string, category string, tags string, statement string, gloss string, severity double, mutation double")
    asked = spark.createDataFrame([(1, "seal"), (1, "law"), (2, "weaving"), (3, "unknown")], "query_id long, term string")
    domains = spark.createDataFrame([(1, "law")], "query_id long, domain string")

    def plain(words, doms):
        out = {}
        for i, g, c, t, s, l, sev, mut in ax:
            g, c, t, s = ((x or "").lower() for x in (g, c, t, s))
            has = lambda x, w: w in x.replace(",", " ").split()
            blob = " ".join([i, g, c, s, l or "", t])
            v = sum(14 * has(g, w) + 12 * has(c, w) + 10 * has(t, w) + 6 * has(s, w) + 2 * has(blob, w) for w in words)
            v += sum(15 * (d == g) + 12 * (d == c) + 8 * (d in t) for d in doms) + 2 * (sev or 0) + (mut or 0)
            out[i] = v
        return sorted(out.items(), key=lambda x: (-x[1], x[0]))[:3]

    got = {}
    for r in routing.axiom_scores(asked, domains, axioms, 3).collect():
        got.setdefault(r["query_id"], {})[r["id"]] = round(r["score"], 6)
    for q, words, doms in ((1, ["seal", "law"], ["law"]), (2, ["weaving"], []), (3, ["unknown"], [])):
        assert got[q] == {k: round(v, 6) for k, v in plain(words, doms)}, q
    assert routing.axiom_scores(asked.where("false"), domains.where("false"), axioms.where("false"), 3).count() == 0


def test_stages_and_provenance(spark):
    stage = lambda rows: spark.createDataFrame(rows, "query_id long, k string, position int")
    got = [tuple(r) for r in routing.staged(stage([(1, "b", 1)]), stage([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1)]), key="k", k=2).orderBy("query_id", "stage").collect()]
    assert got == [(1, "b", 0, 1), (1, "a", 1, 1), (2, "a", 1, 1)]
    r = routing.with_provenance(spark.createDataFrame([("r1",), ("r2",)], "ref string"), spark.createDataFrame([("r1", "doc", None)], "ref string, document_id string, licence string"), "ref").orderBy("ref").collect()
    assert r[0]["provenance"] == '{"document_id":"doc"}' and r[0]["untrusted_content"] and r[0]["untrusted_content_notice"] and r[1]["provenance"] is None and not r[1]["untrusted_content"]
