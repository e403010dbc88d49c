import random

from tessera.llm import groups
from tessera.llm.groups import components, spread_join, star


def brute(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a and b and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components_over_many_cells(spark):
    rng = random.Random(3)
    names = [f"v{i:04d}" for i in range(400)]
    links = [(rng.choice(names), rng.choice(names)) for _ in range(320)]
    links += [(names[i], names[i + 1]) for i in range(0, 60)]  # a chain
    links += [("hub", n) for n in names[200:330]]  # a third of all links at one vertex
    links += [("v0001", None), (None, "v0002"), ("v0003", "v0003"), links[0], links[0]]
    df = spark.createDataFrame(links, "a string, b string")
    for cell in (10, 60, 10_000):
        got = {r["v"]: r["p"] for r in components(df, cell_links=cell).collect()}
        assert got == brute(links)


def test_hot_keys_are_spread_by_their_count(spark):
    df = spark.createDataFrame([("hot", i) for i in range(95)] + [("cool", 1), (None, 2), ("alone", 3)], "k string, x long")
    side = spark.createDataFrame([("hot", "H"), ("cool", "C"), ("other", "O")], "k string, y string")
    want = None
    for rows in (10, 1000):
        got = spread_join(df, side, "k", "left", key_rows=rows).collect()
        want = want or {(r["k"], r["x"], r["y"]) for r in got}
        assert len(got) == 98 and {(r["k"], r["x"], r["y"]) for r in got} == want
        assert sum(r["y"] == "H" for r in got) == 95
    assert spread_join(df, side, "k", "inner", key_rows=10).count() == 96


def test_small_tables_use_the_grid_too(spark, monkeypatch):
    seen = []
    plain = groups._in_cells
    monkeypatch.setattr(groups, "_in_cells", lambda links, blocks: seen.append(blocks) or plain(links, blocks))
    links = [(f"v{i}", f"v{i + 1}") for i in range(9)]
    assert {r["p"] for r in components(spark.createDataFrame(links, "a string, b string")).collect()} == {"v0"}
    assert seen and min(seen) >= 2


def test_no_links(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert components(df).count() == 0


def test_star_links_members_without_all_pairs(spark):
    df = spark.createDataFrame([("k", f"m{i}") for i in range(50)] + [("j", "x")], "key string, m string")
    rows = star(df, "key", "m").collect()
    assert len(rows) == 49 and {r["a"] for r in rows} == {"m0"}
