from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.split import pieces, split_texts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é.!\n#x", max_size=900), st.integers(10, 120), st.integers(0, 9))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    got = pieces(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b in got)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b < d and b - c <= overlap
    # without what is repeated, the pieces are the text
    whole, at = "", 0
    for a, b in got:
        whole += text[at:b]
        at = b
    assert whole == text


def test_cuts_prefer_coarse_boundaries():
    para = "One two three. " * 30
    text = para.strip() + "\n\n" + para.strip() + "\n\n" + para.strip()
    a, b = pieces(text, 600, 50)[0]
    assert text[a:b].endswith("\n\n")
    words = pieces("word " * 500, 100, 20)
    assert all(("word " * 500)[a : a + 4] == "word" for a, _ in words)


def test_what_fits_a_piece_is_never_broken():
    para = ("word " * 335 + "end.\n\n")[:1681]
    got = pieces(para + para.rstrip(), 1800, 250)
    assert len(para) == 1681 and [b for _, b in got] == [1681, 3360] and 0 < 1681 - got[1][0] <= 121
    # three paragraphs, of which the second leaves no room for a tail of 250
    text = "a b c. " * 30 + "\n\n" + "d e f. " * 250 + "\n\n" + "g h i. " * 40
    ends = [b for _, b in pieces(text, 1800, 250)]
    assert 212 in ends and text.index("g h i") in ends


def test_a_stretch_without_boundaries_repeats_exactly():
    got = pieces("x" * 5000, 1800, 250)
    assert got == [(0, 1800), (1550, 3350), (3100, 4900), (4650, 5000)]


def test_nulls_empties_and_line_ends(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a\r\nb"), (4, "x" * 5000), (None, "z")], "id long, content string")
    rows = split_texts(df, "id", "content").orderBy("id", "piece_no").collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append(r)
    assert 1 not in by and None not in by and len(by[2]) == 1 and by[3][0]["content"] == "a\nb" and by[3][0]["end"] == 3
    assert len(by[4]) == 4 and by[4][1]["start"] == by[4][0]["end"] - 250
    assert split_texts(df.where("false"), "id", "content").count() == 0
    # a column of the input that is named like one of the result doesn't matter
    assert split_texts(df.withColumn("start", F.lit("?")).withColumn("key", F.lit(0)), "id", "content").where("id = 4").count() == 4
