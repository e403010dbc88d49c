from tessera.operators import quality

EN = "The keeper of the lantern went to the river and said that it was not his to open, for the town had sealed it with their own hands.\n"
FR = "Le gardien de la lanterne est dans la ville et il ne sait pas que les portes du palais sont avec nous pour une nuit, mais il dort.\n"


def lines(one, chars):
    """Different lines of one text, up to a number of characters."""
    return "".join(f"{i} {one}" for i in range(chars))[:chars]


def scored(spark, rows):
    df = spark.createDataFrame(rows, "id string, text string, lang string, form string, pdf double, failures int")
    got = quality.score(quality.components(df, "id", "text", "lang", "form", "pdf", "failures")).collect()
    return {r["id"]: (round(r["score"], 6), r["issues"]) for r in got}


def test_form_language_navigation_and_format(spark):
    menu = "".join(f"{i} Click here for the one that was sealed in the river\n" for i in range(30))
    long = lines(EN, 30_000)
    rows = [
        ("clean", long, "en", "book", None, None),
        ("short book", lines(EN, 2_000), "en", "Book", None, None),
        ("nearly long", lines(EN, 17_000), "en", "book", None, None),
        ("no form", lines(EN, 10_000), "en", None, None, None),
        ("manifesto", lines(EN, 2_000), "en", "A Manifesto", None, None),
        ("poème", lines(EN, 2_000), "en", "Poème", None, None),
        ("french", lines(FR, 30_000), "en-GB", "book", None, None),
        ("name", long, "English", "book", None, None),
        ("address", long, "https://codes.example/eng", "book", None, None),
        ("none named", long, "und", "book", None, None),
        ("n/a", long, "n/a", "book", None, None),
        ("dutch", long, "dut", "book", None, None),
        ("no label", lines(FR, 30_000), None, "book", None, None),
        ("menu", menu, "en", "letter", None, None),
        ("pdf", long, "en", "book", 0.6, None),
        ("good pdf", long, "en", "book", 0.8, 0),
        ("epub", long, "en", "book", None, 2),
        ("all", lines(FR, 2_000), "it", "book", 0.0, 1),
        ("tiny", "x" * 150, "fr", "book", 0.1, 3),
        ("null", None, "fr", "book", None, None),
    ]
    got = scored(spark, rows)
    assert got["clean"] == got["name"] == got["address"] == got["none named"] == got["n/a"] == got["no label"] == got["manifesto"] == got["poème"] == got["good pdf"] == (1.0, [])
    assert got["short book"] == (0.6, ["short_for_form"])
    assert got["nearly long"] == (1.0, [])  # 0.5 * 0.15 ** 2 is below 0.02
    assert got["no form"] == (0.875, ["short_for_form"])
    assert got["french"] == got["dutch"] == (0.95, ["language"])
    assert got["menu"] == (0.75, ["navigation"])
    assert got["pdf"] == (0.7, ["pdf_text"]) and got["epub"] == (0.95, ["epub_reads"])
    assert got["all"] == (0.0, ["language", "short_for_form", "pdf_text", "epub_reads"])
    assert got["tiny"][0] == got["null"][0] == 0.0 and not {"language", "short_for_form", "pdf_text", "epub_reads"} & {*got["tiny"][1], *got["null"][1]}
