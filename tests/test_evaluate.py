import datetime

from pyspark.sql import functions as F

from tessera.operators import evaluate


def prose(n, start=0):
    """``n`` different words that end with a stop."""
    return " ".join(f"w{i}" for i in range(start, start + n)) + "."


def test_generic_and_stuffing(spark):
    base = "\n\n".join(prose(100, 100 * i) for i in range(3))
    rows = [
        ("plain", base, base, ["Law_Code", "river"]),
        ("generic", base, base + " Cyberspace, cyberspace, and a vast tapestry IN THE SHADOWS.", None),
        ("all", base, " ".join(evaluate.GENERIC), []),
        ("stuffed", base[:-1] + " law code river river.", base, ["Law_Code", "River", "", None, "absent"]),
        ("none", None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, fragment string, response string, labels array<string>")
    got = {r["id"]: r for r in evaluate.evaluated(df, "fragment", "response", "labels").collect()}
    full = 0.364 + 0.272 + 0.182
    assert abs(got["plain"]["quality"] - full) < 1e-9
    assert got["generic"]["generic"] == 0.75 and abs(got["generic"]["quality"] - (full - 0.075)) < 1e-9
    assert got["all"]["generic"] == 1.0 and abs(got["all"]["quality"] - (full - 0.10)) < 1e-9
    want = 2 / (304 / 80) / 4
    assert abs(got["stuffed"]["stuffing"] - want) < 1e-9 and abs(got["stuffed"]["quality"] - (full - 0.15 * want)) < 1e-9
    assert abs(got["none"]["quality"] - (0.364 - 0.35)) < 1e-9


def test_loops_cost_quality(spark):
    own = lambda i: "\n\n".join(prose(100, 1000 * i + 100 * j) for j in range(3))
    rows = [(i, own(i) + (" the bell again." if i < 9 else ""), datetime.datetime(2024, 1, 1 + i)) for i in range(20)]
    rows = [(i, f, f, at) for i, f, at in rows + rows[:2]] + [(90, None, None, datetime.datetime(2024, 3, 1))]
    df = spark.createDataFrame(rows, "id long, fragment string, response string, created_at timestamp_ntz")
    got = evaluate.evaluated_cycles(df).collect()
    assert sorted(r["id"] for r in got) == [*range(20), 90]
    of = {r["id"]: r for r in got}
    alone = {r["id"]: r["quality"] for r in evaluate.evaluated(df.distinct(), "fragment").collect()}
    # "the bell again" stands in 9 of 20 texts, 3 more than are allowed
    assert all(abs(alone[i] - of[i]["quality"] - (0.21 if i < 9 else 0.0)) < 1e-9 for i in range(20))


def test_enforcement_by_keywords(spark):
    rows = [("a", "The bell-tower and the oath.", [["oath", "none"], ["tower"], ["bel"]]), ("b", "x", None), ("c", "x", []), ("d", None, [["x"]]), ("e", "a.b c", [["a.b"], ["a,b"]])]
    df = spark.createDataFrame(rows, "id string, t string, ks array<array<string>>")
    got = {r["id"]: r["e"] for r in df.select("id", evaluate.enforcement(F.col("t"), F.col("ks")).alias("e")).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {"a": round(2 / 3, 6), "b": 1.0, "c": 1.0, "d": 0.0, "e": 0.5}
    own = spark.range(1).select(evaluate.axiom_keywords(F.array().cast("array<string>"), F.lit("The oath of the weavers, sworn in_silence forever")).alias("k")).collect()[0]["k"]
    assert own == ["weavers", "in_silence", "forever"]
