import random

from pyspark.sql import functions as F

from tessera.operators.hierarchy import clean_links, descendants, hierarchy, paths


def graph(seed):
    rng = random.Random(seed)
    names = [f"n{i:03d}" for i in range(160)]
    links = {(names[i], names[rng.randrange(i)]) for i in range(1, 90) for _ in range(rng.choice([0, 1, 1, 2]))}
    links |= {(names[i], names[i - 1]) for i in range(91, 97)}  # a chain
    links |= {("n120", "n121"), ("n121", "n122"), ("n122", "n120"), ("n123", "n120"), ("n124", "n123"), ("n120", "n096"), ("n125", "n125"), ("n126", "n125"), ("n126", "n010")}
    links |= {(n, "n130") for n in names[131:158]}
    return names, sorted(links)


def brute(links):
    up = {}
    for c, p in links:
        up.setdefault(c, set()).add(p)
    above = {}
    for n in {x for link in links for x in link}:
        seen, todo = set(), list(up.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        above[n] = seen
    ring = {n for n, s in above.items() if n in s}
    roots = {n: {a for a in (s or {n}) if a not in up} for n, s in above.items()}
    return above, roots, {n for n, s in above.items() if s & ring}


def check(spark, names, links):
    raw = spark.createDataFrame([*links, ("n001", "nowhere"), (None, "n002"), links[0]], "child string, parent string")
    df = clean_links(raw, spark.createDataFrame([(n,) for n in names], "node string"))
    above, roots, looped = brute(links)
    got_roots, got_looped, hops = {}, set(), {}
    facts = hierarchy(df)
    for r in paths(facts).collect():
        got_roots.setdefault(r["node"], set())
        if r["root"] is None:
            got_looped.add(r["node"])
        else:
            got_roots[r["node"]].add(r["root"])
            hops[r["node"], r["root"]] = (r["hops"], r["path"])
    assert got_roots == roots and got_looped == looped
    up = set(links)
    for (n, root), (k, path) in hops.items():
        assert path[0] == root and path[-1] == n and len(path) == k + 1 == shortest(links, n, root)
        assert all((b, a) in up for a, b in zip(path, path[1:]))
    pairs = sorted((r["ancestor"], r["node"]) for r in descendants(df).collect())
    assert pairs == sorted((a, n) for n, s in above.items() for a in s)


def shortest(links, node, root):
    seen, k = {node}, 1
    while root not in seen:
        seen, k = seen | {p for c, p in links if c in seen}, k + 1
    return k


def test_peeling_equals_a_plain_search(spark):
    check(spark, *graph(1))


def test_circles_with_ways_in_and_out(spark):
    names = [f"n{i:03d}" for i in range(60)]
    ring = [(names[i], names[(i + 1) % 9]) for i in range(9)]
    links = [*ring, ("n003", "n020"), ("n020", "n021"), ("n021", "n022"), ("n022", "n023"), ("n006", "n030"), ("n030", "n031"), ("n040", "n002"), ("n041", "n040"), ("n042", "n041"), ("n042", "n031"), ("n050", "n051"), ("n051", "n050")]
    check(spark, names, sorted(links))


def test_a_chain_of_a_hundred_thousand(spark):
    n = 100_000
    links = spark.range(1, n).select(F.format_string("n%06d", "id").alias("child"), F.format_string("n%06d", F.col("id") - 1).alias("parent"))
    links = links.unionByName(spark.createDataFrame([("side", f"n{n // 2:06d}"), ("side", "other")], "child string, parent string"))
    facts = hierarchy(links)
    got = facts.agg(F.count("*"), F.sum("hops"), F.max("hops"), F.count_if(F.expr("root is null"))).collect()[0]
    assert tuple(got) == (n + 3, n * (n - 1) // 2 + n // 2 + 2, n - 1, 0)
    assert {(r["root"], r["hops"]) for r in facts.where("node = 'side'").collect()} == {("n000000", n // 2 + 1), ("other", 1)}


def test_no_links(spark):
    df = spark.createDataFrame([], "child string, parent string")
    assert hierarchy(df).count() == 0 and descendants(df).count() == 0 and paths(hierarchy(df)).count() == 0
