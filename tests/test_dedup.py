import random
import re

from pyspark.sql import functions as F

from tessera.functions.hashing import blake2b64, fingerprint
from tessera.operators import dedup


def compatible(a, b, parts=("language", "translator", "edition")):
    return all(not a[p] or not b[p] or a[p] == b[p] for p in parts)


def has(title, marks):
    return any(m in (title or "").lower() for m in marks)


def brute(docs, distance=None):
    """The ladder over all pairs, one by one."""
    out, up = {}, {d["id"]: d["id"] for d in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in docs:
        best, kin = None, None
        for b in docs:
            if a is b:
                continue
            ed = has(a["title"], dedup.EDITIONS) == has(b["title"], dedup.EDITIONS)
            part = has(a["title"], dedup.EXCERPTS) != has(b["title"], dedup.EXCERPTS) or bool(a["chars"] and b["chars"] and max(a["chars"], b["chars"]) >= 4 * min(a["chars"], b["chars"]))
            named, work = bool(set(a["identifiers"]) & set(b["identifiers"])), a["work"] is not None and a["work"] == b["work"]
            near = distance and distance.get((min(a["id"], b["id"]), max(a["id"], b["id"])))
            ok = compatible(a, b)
            if a["raw"] and a["raw"] == b["raw"]:
                hit = (0, -1.0, 0, b["id"], "exact_raw")
            elif a["normalized"] and a["normalized"] == b["normalized"]:
                hit = (1, -1.0, 0, b["id"], "exact_normalized")
            elif ok and named and ed:
                hit = (2, -1.0, 0, b["id"], "identifier")
            elif near is not None and near is not False and ok and ed and not part:
                hit = (2, -(1 - near / 64), 1, b["id"], "near")
            elif ok and work and ed and not part:
                hit = (2, -0.95, 2, b["id"], "title_author")
            else:
                hit = None
                if named or work:
                    kin = min(kin or b["id"], b["id"])
            if hit:
                best = min(best or hit, hit)
                x, y = find(a["id"]), find(b["id"])
                up[max(x, y)] = min(x, y)
        out[a["id"]] = (best[4], best[3]) if best else ("related", kin) if kin else (None, None)
    groups = {}
    for d in docs:
        groups.setdefault(find(d["id"]), []).append(d)
    for cluster, members in groups.items():
        rep = max(members, key=lambda d: (d["quality"], d["chars"], d["id"]))["id"]
        for d in members:
            out[d["id"]] = (*out[d["id"]], cluster, rep)
    return out


FIELDS = "id string, raw string, normalized string, language string, translator string, edition string, title string, work string, identifiers array<string>, chars long, quality double"


def test_ladder_equals_all_pairs(spark):
    rng = random.Random(6)
    docs = []
    for i in range(120):
        title = rng.choice(["The Seal", "The Seal, annotated", "Excerpt of the Seal", "Other", None])
        docs.append({
            "id": f"d{i:03d}", "raw": rng.choice([None, "", *[f"r{k}" for k in range(60)]]), "normalized": rng.choice([None, *[f"n{k}" for k in range(80)]]),
            "language": rng.choice(["", "en", "fr", None]), "translator": rng.choice([None, None, "x", "y"]), "edition": rng.choice([None, None, None, "1"]), "title": title,
            "work": rng.choice([None, *[f"w{k}" for k in range(25)]]), "identifiers": rng.sample([f"doi:{k}" for k in range(90)], rng.choice([0, 0, 1, 2])), "chars": rng.choice([0, 10, 39, 40, 160, 5000]), "quality": rng.choice([0.1, 0.5]),
        })
    df = spark.createDataFrame([tuple(d.values()) for d in docs], FIELDS)
    want = brute(docs)
    rows = {r["id"]: r for r in dedup.ladder(df).collect()}
    got = {k: (r["kind"], r["cluster"], r["representative"]) for k, r in rows.items()}
    diff = {k: (got[k], want[k]) for k in want if got[k] != (want[k][0], *want[k][2:])}
    assert not diff, list(diff.items())[:5]
    # whoever is named is on that rung with the one who names it
    of = {d["id"]: d for d in docs}
    for k, r in rows.items():
        if r["kind"] is not None:
            assert r["duplicate_of"] != k and brute([of[k], of[r["duplicate_of"]]])[k][0] is not None
    assert {k for k, r in rows.items() if r["kind"] is None} == {k for k, r in want.items() if r[0] is None}
    assert dedup.ladder(df.where("false")).count() == 0


def test_fingerprints_and_their_pairs_equal_all_pairs(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(12)]
    rows = []
    for i in range(140):
        t = list(base[i % 12])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 30])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(900, None), (901, ""), (902, "12 34"), (903, "one"), (904, "One!")]
    df = spark.createDataFrame(rows, "id long, text string")
    pairs, members = dedup.simhash_pairs(df, "id", "text")
    prints = {i: fingerprint(t) for i, t in rows if t and fingerprint(t)}
    rep = {}
    for i in sorted(prints):
        rep.setdefault(prints[i], i)
    want = {(min(a, b), max(a, b)) for f, a in rep.items() for g, b in rep.items() if a < b and bin((f ^ g) & (2**64 - 1)).count("1") <= 3}
    assert want and {(r["a"], r["b"]) for r in pairs.collect()} == want
    assert {r["id"]: r["class_id"] for r in members.collect()} == {i: rep[f] for i, f in prints.items()}
    assert prints[903] == prints[904] and 902 not in prints


def test_hash_of_64_bits(spark):
    got = spark.createDataFrame([("a",), (None,)], "t string").select(blake2b64("t").alias("h")).collect()
    assert got[0]["h"] == int.from_bytes(__import__("hashlib").blake2b(b"a", digest_size=8).digest(), "big", signed=True) and got[1]["h"] is None


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(80)] + [("hub", f"h{i}") for i in range(60)] + [("x", "x"), ("y", None)]
    rng.shuffle(links)
    got = {r["node"]: r["least"] for r in dedup.connected(spark.createDataFrame(links, "a string, b string")).collect()}
    assert len(got) == 81 + 61 and {v for k, v in got.items() if k[0] == "c"} == {"c000"} and {v for k, v in got.items() if k[0] == "h"} == {"h0"}
    assert dedup.connected(spark.createDataFrame([], "a string, b string")).count() == 0


def test_near_pairs_equal_all_pairs_and_only_compact_rows_are_kept(spark, monkeypatch):
    rng = random.Random(4)
    common = [f"c{i}" for i in range(30)]  # runs that most texts have
    base = [[f"w{rng.randrange(300)}" for _ in range(n)] for n in (3, 4, 5, 9, 40, 41, 90, 200, 210, 700)]
    rows = []
    for i in range(300):
        t = list(base[i % len(base)])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((i, " ".join([*t[: rng.choice([len(t), len(t), max(len(t) - 9, 1)])], *(common if i % 3 == 0 else [])])))
    rows += [(900, None), (901, " .,"), (902, "One, TWO"), (903, "one two!"), (904, "two one"), (0, rows[0][1]), (905, "Ünï - çode"), (906, "ünï çode"), (907, "Ως ΣΑΣ 中文"), (908, "ωσ σας, 中文!"), (909, "\u0001 ωσ")]
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if w:
            sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1)))
    rep = {}
    for i in sorted(sets):
        rep.setdefault(sets[i], i)
    like = lambda f, g: len(f & g) / len(f | g)
    want = {(a, b): like(f, g) for f, a in rep.items() for g, b in rep.items() if a < b and like(f, g) >= 0.8}
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    kept = []
    inner = dedup.materialize
    monkeypatch.setattr(dedup, "materialize", lambda d, name: kept.append((name, d.dtypes)) or inner(d, name))
    # as one cell for each size, and divided
    for cell in (dedup.CELL, 20):
        monkeypatch.setattr(dedup, "CELL", cell)
        pairs, members = dedup.near_pairs(df, "id", "text")
        assert len(want) > 20 and sorted((r["a"], r["b"], r["jaccard"]) for r in pairs.collect()) == sorted((*k, v) for k, v in want.items())
        assert {r["id"]: r["class_id"] for r in members.collect()} == {i: rep[s] for i, s in sets.items()}
    # whole sets, eight bytes a run, are kept of texts in pairs only
    assert [n for n, types in kept if any(k == "array<bigint>" for _, k in types)] == ["near-full"] * 2
    pairs, members = dedup.near_pairs(df.where("false"), "id", "text")
    assert pairs.count() == 0 and members.count() == 0


def test_words_of_runs_are_those_of_the_engine(spark):
    from tessera.functions import sets, text

    signs = [chr(i) for i in [*range(0x250), *range(0x2000, 0x2070), 0x130, 0x3A3, 0x4E2D, 0x1D7D8]]
    rows = [(f"aA{c}Bb {c}",) for c in signs]
    got = spark.createDataFrame(rows, "t string").select("t", dedup.plain_text("t").alias("p"), text.words(F.col("t")).alias("w")).collect()
    for r in got:
        assert sets.text_words(r["p"]) == r["w"], ascii(r["t"])
