from tessera.llm.scans import anagram, corrections, damage, page_lines, repair, repaired, signed_words, title_candidates, without_signs
from tessera.llm.wordfilter import word_filter


def test_the_order_of_letters_does_not_matter():
    assert anagram("listen") == anagram("silent") != anagram("listens")


def test_lines_of_a_pages_edge():
    text = "the council of ash\n— 176 —\nVelkarin — The Great Register, Pelta\nguards the seal".split("\n")
    assert page_lines(text) == ({1}, set()) and title_candidates(text) == [(2, "velkarin the great register pelta")]
    assert page_lines(text, {"velkarin the great register pelta"}) == ({1, 2}, set())
    assert page_lines(["a line", ". ' " * 40, "another"]) == (set(), {1})
    assert page_lines("a line\n' . ,\nanother".split("\n")) == (set(), {1})
    # section numbers, headings, rules
    for ok in ("It ends.\n\n§ 13\n\nIt begins", "It ends.\n\n45\n\nIt begins", "It ends.\n\nXX.\n\nIt begins", "It ends.\n\n* * *\n\nIt begins", "CHAPTER XX. The Book, Kaeb\n\nIt begins\nand goes on"):
        assert page_lines(ok.split("\n")) == (set(), set()), ok


def test_signs_in_words():
    assert signed_words("the b|ll of 8rücke, leſson") == ["b|ll", "8rücke", "leſson"] and not signed_words("on folio 144v in the year 1482")
    assert without_signs("b|ll") == {"bill", "blll"} and without_signs("ſirſt") == {"sirst"}


def test_repair():
    text = "The coun-\ncil of a5h\n\n461\n\nVELKARIN — THE GREAT REGISTER\n\nguards the s e a l and the half-\ntitle.\n\nNext one."
    assert repair(text, {"a5h": "ash"}, {"council"}, {"velkarin the great register"}) == "The council of ash guards the seal and the half-title.\n\nNext one."


def test_damage_of_a_table(spark):
    good = "the council counts the memory of the furnace among the unsorted papers"
    rows = [(i, good) for i in range(60)]
    rows += [(100, good.replace("council", "councll").replace("memory", "mcmory")), (101, "the coun-\ncil of ash"), (102, good + "\n' . ,\n" + good), (103, None), (104, ""), (105, good.replace("council", "c o u n c i l")), rows[0]]
    df = spark.createDataFrame(rows, "id long, content string")
    found, fixes, _, _ = damage(df, "id", "content")
    assert {r["id"] for r in found.collect()} == {100, 101, 102, 105}
    assert ("mcmory", "memory") in {(r["word"], r["right"]) for r in fixes.collect()}
    out = {r["id"]: r["content"] for r in repaired(df.dropDuplicates(["id"]), "id", "content").collect()}
    assert "memory" in out[100] and out[101] == "the council of ash" and out[103] is None and out[0] == good
    assert damage(df.where("false"), "id", "content")[0].count() == 0


def test_titles_by_the_book_and_by_recurrence(spark):
    page = "and so the council counts\n{}\n{}\nuntil the winter ends again"
    rows = [(1, "a", page.format("417", "Elegy for the Broken Seal — Pelnarlu")), (2, "a", page.format("418", "while nobody knew the reason of it")), (3, "b", page.format("12", "A line without any book"))]
    rows += [(10 + i, "b", page.format(str(500 + i), "The Common Heading Of All Pages")) for i in range(3)]
    rows += [(20, "c", "It ends.\n\n99\n\nBook of the sealed gates\n\nIt begins"), (21, "a", "It ends.\n\n199\n\nThe Broken Seal, an Elegy\n\nIt begins")]
    df = spark.createDataFrame(rows, "id long, book string, content string")
    heads = spark.createDataFrame([("a", "Elegy for the broken seal, Pelnarlu Amepelta"), ("c", None)], "book string, head string")
    titles = {r["id"]: r["word"] for r in damage(df, "id", "content", "book", heads)[3].collect()}
    assert titles == {1: "elegy for the broken seal pelnarlu", 21: "the broken seal an elegy", **{i: "the common heading of all pages" for i in (10, 11, 12)}}


def test_the_filter_lets_all_of_its_words_pass(spark):
    words = [f"wörd{i}" for i in range(3000)]
    f = word_filter(spark.createDataFrame([(w,) for w in [*words, None]], "word string"), "word")
    assert all(map(f.may_have, words)) and sum(f.may_have(f"other{i}") for i in range(3000)) < 60
    assert not word_filter(spark.createDataFrame([], "word string"), "word").may_have("x")


def test_no_join_of_the_corrections_is_sent_around_or_crossed(spark):
    counts = spark.createDataFrame([("memory", 500, anagram("memory")), ("mcmory", 2, anagram("mcmory")), ("c" * 90, 1, anagram("c" * 90)), ("e" + "c" * 89, 400, anagram("e" + "c" * 89))], "word string, n long, h long")
    df = corrections(counts, 1000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan
    # words of any length
    assert {(r["word"], r["right"]) for r in df.collect()} == {("mcmory", "memory"), ("c" * 90, "e" + "c" * 89)}
