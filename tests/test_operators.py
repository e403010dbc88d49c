import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import dedup, relational, retrieval
from tessera.sources.tables import clean_id, latest


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).collect()[0]["x"]


def test_latest_row_and_ids(spark):
    df = spark.createDataFrame([(" A ", 1, "x"), ("a", 3, "y"), ("a", 3, "y"), ("b", None, "n"), (None, 9, "z"), ("  ", 9, "z")], "id string, updated_at int, v string")
    got = latest(df.withColumn("id", clean_id("id")), "id").collect()
    assert sorted((r["id"], r["updated_at"], r["v"]) for r in got) == [("a", 3, "y"), ("b", None, "n")]


def test_as_of_join(spark):
    left = spark.createDataFrame([("k", 5, 1), ("k", 1, 2), ("j", 5, 3), (None, 5, 4)], "key string, t int, id int")
    right = spark.createDataFrame([("k", 2, 20), ("k", 4, None), ("k", 5, 50), ("k", 9, 90)], "key string, rt int, v int")
    got = {r["id"]: r["v"] for r in relational.as_of_join(left, right, "key", "t", "rt", "v").collect()}
    assert got == {1: 50, 2: None, 3: None, 4: None}


def test_chunks_match_their_offsets(spark):
    rng = random.Random(4)
    t = "".join(rng.choice("ab \n") for _ in range(2000))
    rows = one(spark, X.chunks(F.lit(t), 300, 40))
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert all(t[r["char_start"] : r["char_end"]] == r["content"] == r["content"].strip() for r in rows)
    assert one(spark, X.chunks(F.lit(""), 300, 40)) == [] and one(spark, X.chunks(F.lit(None).cast("string"), 300, 40)) is None


def test_text_functions(spark):
    assert one(spark, X.terms(F.lit("The archive's 'Oracle' and the ORACLE of x"))) == ["archive's", "oracle"]
    assert one(spark, X.title_key(F.lit("The Great Régister: volume 2"))) == "great register"
    assert one(spark, X.author_key(F.lit("Müller, Jan (1800-1870)"))) == "jan muller"
    assert one(spark, X.identifiers(F.lit("ISBN 978-3-16-148410-0, doi 10.1000/182. ark:/12148/x"))) == ["ark:/12148/x", "doi:10.1000/182", "isbn:9783161484100"]
    assert one(spark, X.fragment(F.lit("a FIELD_FRAGMENT b\n\nB!\n\nc METADATA_JSON {}"))) == "b\n\nc"
    assert [one(spark, X.truncated(F.lit(s))) for s in ("Done.", "and then,", "open (bracket.", 'He said "no.', "closed) first.", "")] == [False, True, True, True, False, True]
    assert one(spark, X.strip_repeated_lines(F.lit("h\na\nh\nb\nh\nc\nh\nd\nh"))) == "a\nb\nc\nd"
    assert one(spark, X.headings(F.lit("Chapter IV here\ntext\nALL CAPS\nx"))) == ["Chapter IV here", "ALL CAPS"]
    assert one(spark, X.safe_filename(F.lit('a/b:"c"'))) == "a_b_c_" and one(spark, X.safe_filename(F.lit("con"))) == "_con"
    assert one(spark, X.century_of(F.lit("printed in 1482 at"))) == 15
    df = spark.createDataFrame([("café  \n\n\n\n\n​x",), ("cafÃ©",), (None,)], "t string")
    assert [r[0] for r in df.select(X.clean_unicode(F.col("t"))).collect()] == ["café\n\n\nx", "cafÃ©", None]
    assert [r[0] for r in df.select(X.repair_mojibake(F.col("t"))).collect()][1:] == ["café", None]


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def shingles(t, n):
    w = words(t)
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({" ".join(w)} if w else set())


def docs(rng, n):
    vocabulary = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            t = rng.choice(out).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(" ".join(t))
        else:
            out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 60]))))
    return out


def test_near_pairs_lose_none(spark):
    texts = docs(random.Random(3), 120)
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "!!")]
    pairs, members = dedup.near_pairs(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    rep = {r["id"]: r["class_id"] for r in members.collect()}
    sets = {i: shingles(t, 5) for i, t in enumerate(texts)}
    assert set(rep) == set(sets) and all(sets[i] == sets[r] for i, r in rep.items())
    reps = sorted(set(rep.values()))
    want = {(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want and {(r["a"], r["b"]) for r in pairs.collect()} == want
