import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import sets
from tessera.operators import retrieval


@pytest.mark.parametrize("batch, parts", [(10_000, 1), (97, 3)])
def test_knn_ties_go_to_the_smaller_key_however_rows_are_batched(spark, batch, parts):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(600, 24))
    v[200:400] = v[200]  # 200 copies, a third of the rows
    rows = [(int(i), [float(x) for x in v[i]]) for i in rng.permutation(600)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "id long, v array<double>").repartition(parts)
        q = df.where("id in (200, 399, 5)").select(F.col("id").alias("query_id"), "v")
        got = retrieval.knn(q, df, "id", "v", 10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    of = {i: [r["id"] for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: (-r["similarity"], r["id"]))] for i in (200, 399, 5)}
    assert of[200] == of[399] == list(range(200, 210))
    assert len({r["similarity"] for r in got if r["query_id"] == 200}) == 1
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.array([(x * u[5]).sum() for x in u])
    assert of[5] == list(np.lexsort((np.arange(600), -s))[:10])


def test_bm25_equals_scores_of_all_pairs_and_writes_the_best_only(spark, monkeypatch):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)] + ["the"] * 60
    rows = [(i, " ".join(["the", *(rng.choice(vocab) for _ in range(rng.randint(0, 30)))])) for i in range(700)]
    rows += [(800, None), (801, " ."), (802, "ÉTÉ été"), (3, "w1 w1"), (5, rows[6][1]), (803, "nobody asks")]  # two keys stand twice
    asked = [(q, t) for q in range(90) for t in {"the", *(rng.choice(["été", *vocab]) for _ in range(q % 4))}] + [(900, "unknown")]
    docs, queries = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(asked, "query_id long, term string")
    # the plain join of all postings
    post = retrieval.postings(docs, "id", "text")
    n, avg = post.groupBy("id").agg(F.max("dl").alias("dl")).agg(F.count("*"), F.avg("dl")).collect()[0]
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    value = F.ln(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.lit(avg)))
    sums = queries.join(post.join(df, "term").withColumn("s", F.floor(value * 1e6 + 0.5)), "term").groupBy("query_id", "id").agg(F.sum("s").alias("score"))
    want = sorted(map(tuple, retrieval.top_per_query(sums, "id", F.desc("score"), 7).select("query_id", "id", "score").collect()))
    written = []
    add = retrieval.Growing.add
    monkeypatch.setattr(retrieval.Growing, "add", lambda self, d: (lambda out: written.append(out.count()) or out)(add(self, d)) if "bm25-found" in self.path else add(self, d))
    for block, sets in ((50_000, 4096), (100, 20)):
        monkeypatch.setattr(retrieval, "DOC_BLOCK", block)
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", sets)
        got = retrieval.bm25(queries, docs.repartition(3), "id", "text", 7)
        assert got.columns == ["query_id", "id", "score"] and sorted(map(tuple, got.collect())) == want
    assert written[0] < sums.count() / 5  # a row for each pair would be written before
    assert retrieval.bm25(queries.where("false"), docs, "id", "text", 7).count() == 0 == retrieval.bm25(queries, docs.where("false"), "id", "text", 7).count()


def counted(texts, listed):
    out = []
    for dl, at, tf in sets.Places(listed).count(texts):
        out += [(n, dict(zip(a, f, strict=True))) for n, a, f in zip(dl.to_pylist(), at.to_pylist(), tf.to_pylist())]
    return out


@pytest.mark.parametrize("chars", [1 << 22, 10])
def test_places_of_words_are_those_of_the_words_themselves(monkeypatch, chars):
    monkeypatch.setattr(sets, "CHARS", chars)
    rng = random.Random(1)
    texts = [f"aA{c}Bb {c} x{c}" for c in map(chr, [0, *range(2, 0x250), *range(0x2000, 0x2070)])]
    texts += ["".join(rng.choice("abé ß-ł_’") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", *("a" * n for n in (7, 8, 9, 16, 17, 24)), "É" * 20, "\u0001", "\u0001中文 abc 𝟘x ⁰y é"]
    words = sorted({w for t in texts for w in sets.text_words(t)})
    for listed in (words, words[::3], [], ["a" * 8, "a" * 16, "a" * 23, "a b", "中文", "⁰y", "é" * 20, "a\0", ""]):
        place = {w: i for i, w in enumerate(listed)}
        assert counted(texts, listed) == [(len(w), dict(Counter(place[x] for x in w if x in place))) for w in map(sets.text_words, texts)]
    assert counted([], words) == []


def test_bm25_shares_sums_of_like_sets(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(vocab, weights=range(30, 0, -1), k=rng.randint(0, 25)))) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 500)]  # many of one score
    asked = [(q, t) for q in range(60) for t in rng.sample(vocab, 1 + q % 18)]
    docs, queries = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(asked, "query_id long, term string")
    want = sorted(map(tuple, retrieval.bm25(queries, docs, "id", "text", 500).collect()))
    best = [r for q in range(60) for r in sorted((r for r in want if r[0] == q), key=lambda r: (-r[2], r[1]))[:7]]
    for shared, sampled, dense in ((0, 20, 0), (3, 50, 4), (12, 4096, 150)):
        for name, value in (("SHARED", shared), ("SAMPLED", sampled), ("DENSE_MOST", dense)):
            monkeypatch.setattr(retrieval, name, value)
        assert sorted(map(tuple, retrieval.bm25(queries, docs, "id", "text", 7).collect())) == sorted(best)
