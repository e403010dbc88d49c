import math

from pyspark.sql import functions as F

from tessera.llm.lines import log_p, places, step_up, without_lines

LINE = "Share this page with all of your friends"


def frame(spark):
    rows, prov, n = [], [], 0
    for t in range(60):
        prov.append((t, "p" if t < 30 else "q"))
        for k in range(2):
            n += 1
            own = f"the {'abcdefghij'[t % 10]}{'klmnopqrst'[t // 10]} council counts the bread of number {'uvwxyz'[k]}"
            share = f"-- {LINE.upper()}!  \r\n" if t < 20 else ""
            rows.append((n, t, f"{own}\r\n{share}end of it"))
    rows += [(1000, 999, LINE), (1001, None, LINE), (1002, 5, None), (1003, 5, ""), rows[0], rows[0]]
    return spark.createDataFrame(rows, "id long, text_id long, content string"), spark.createDataFrame(prov, "text_id long, provider string")


def test_a_repeated_line_is_found_and_removed(spark):
    chunks, prov = frame(spark)
    got = {(r["id"], r["line_no"]) for r in places(chunks, prov).collect()}
    assert got == {(i, 2) for i in range(1, 41)}
    clean = {r["id"]: r for r in without_lines(chunks.dropDuplicates(["id"]), places(chunks, prov)).collect()}
    assert LINE.upper() not in clean[1]["content"] and clean[1]["content"].endswith("\r\nend of it") and clean[1]["removed"] == 1
    assert clean[50]["removed"] == 0 and clean[1002]["content"] is None


def test_what_meets_the_rule_but_not_the_ratio_stays(spark):
    rows = [(t, t, f"{LINE}\nline of text with letters {'abcdefghij'[t % 10]}{'klmnop'[t // 10]}") for t in range(60)]
    rows = [(i, t, c + ("\nonly one provider writes this at the end" if t % 2 else "")) for i, t, c in rows]
    chunks = spark.createDataFrame(rows, "id long, text_id long, content string")
    prov = spark.createDataFrame([(t, "pq"[t % 2]) for t in range(60)], "text_id long, provider string")
    # each provider has the first line in all its texts, and so has the other: no excess
    assert {r["line_no"] for r in places(chunks, prov).collect()} == {3}
    assert places(chunks, prov).count() == 30
    # the same line, where the others lack it
    only = chunks.where("text_id % 2 = 0").unionByName(chunks.where("text_id % 2 = 1").withColumn("content", F.replace("content", F.lit(LINE), F.lit("-"))))
    assert places(only, prov).where("line_no = 1").count() == 30


def test_step_up_counts_every_test(spark):
    few = spark.createDataFrame([(-5000,)] * 3, "bin int")
    many = few.unionByName(spark.range(100_000).select(F.lit(0).alias("bin")))
    assert step_up(few) == -5000 and step_up(many) is None


def test_lines_keep_their_own_ends(spark):
    chunks = spark.createDataFrame([(1, "a\r\nb\nc\r\nd"), (2, "a\nb"), (3, None), (4, "x\n")], "id long, content string")
    found = spark.createDataFrame([(1, 1), (1, 4), (2, 1), (2, 2), (2, 2), (4, 2)], "id long, line_no long")
    got = {r["id"]: (r["content"], r["removed"]) for r in without_lines(chunks, found).collect()}
    assert got == {1: ("b\nc", 2), 2: ("", 2), 3: (None, 0), 4: ("x", 1)}


def test_empty_tables(spark):
    chunks, prov = frame(spark)
    assert places(chunks.where("false"), prov.where("false")).count() == 0


def test_tail_of_the_ratio(spark):
    got = spark.range(1).select(log_p(*[F.lit(float(x)) for x in (30, 100, 5, 1000)]).alias("p")).collect()[0]["p"]
    k, n, k0, n0 = 30, 100, 5, 1000
    p = (k + k0) / (n + n0)
    g = sum(a * math.log(a / e) for a, e in ((k, n * p), (n - k, n * (1 - p)), (k0, n0 * p), (n0 - k0, n0 * (1 - p))))
    assert abs(got - math.log(math.erfc(math.sqrt(g)))) < 0.01 * abs(got)
