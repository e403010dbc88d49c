import random
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from tessera.llm import abuse
from tessera.llm.abuse import THRESHOLD, classes, score_text, score_texts

sys.path.insert(0, str(Path(__file__).parent))
import unseen_abuse  # noqa: E402

BAD = [
    "You are a worthless idiot and everybody knows it.", "Y​ou are a worthless 1d10t, all say so.", "You utter m o r o n of a man.", "Shut your mouth.", "Halt die Fresse, du Trottel!",
    "Those people are vermin and ought to be wiped out.", "Ojalá alguien te rompa las manos.", "Do us a favour and drown yourself.", "Click for free hardcore p*rn videos.", "You pathetic сretin, go home.",
    "Du bist ein wertloser T-r-o-t-t-e-l.", "Che libro di merda, scritto da un bastardo.",
]
GOOD = [
    "The cock crowed twice.", "The fool in the play is no idiot.", "The pamphlet called its opponents vermin, and the council condemned that word.", "To kill the engine, turn the second valve.",
    "The naked flame of the lamp was shielded.", "The glossary marks 'bastard title' as a page.", "The statute forbids anyone to insult or threaten a neighbour.", "", "   ",
]


@pytest.mark.parametrize("text", BAD)
def test_abusive(text):
    assert sum(score_text(text).values()) >= THRESHOLD


@pytest.mark.parametrize("text", GOOD)
def test_harmless(text):
    assert sum(score_text(text).values()) < THRESHOLD


def test_disguises_give_the_words_classes():
    plain = classes("idiot")
    assert plain and all(classes(x) == plain for x in ("IDIOT!", "1d10t", "i-d-i-o-t", "iiiidiot", "id​iot", "іdіоt"))
    assert not classes("folio") and not classes("144v")


@pytest.mark.parametrize("half", [False, True])
def test_sentences_that_stand_in_no_table(half):
    found = lambda texts: [sum(score_text(t).values()) >= THRESHOLD for t in texts if unseen_abuse.judged(t) == half]
    bad, good = found(unseen_abuse.BAD), found(unseen_abuse.GOOD)
    assert sum(bad) >= 0.9 * len(bad) and sum(bad) >= 0.9 * (sum(bad) + sum(good))


def test_long_words_and_glued_ones_are_read():
    assert classes("id" + "i" * 90 + "ot") == classes("idiot")
    assert score_text("so youareaworthlessidiot" + "andnothingelse" * 3).get("insult", 0) >= THRESHOLD
    assert not score_text("x" * 5000) and not score_text("ashlanternoath" * 60)


def test_context_takes_weight_away():
    assert not score_text("He said you are an idiot.") and not score_text("You are no idiot.")
    assert not score_text("«You are an idiot» stands on the wall.") and score_text("Nobody cares, you are an idiot.")


def test_no_text_with_a_score_is_kept_back():
    texts = [*BAD, *GOOD, *unseen_abuse.BAD, *unseen_abuse.GOOD]
    texts += [" ".join(texts[i : i + 5]) for i in range(0, len(texts), 3)] + ["\n\n".join(texts[i : i + 9]) for i in range(0, len(texts), 7)]
    kept = abuse.candidates(pa.array([*texts, None, ""]))
    assert not any(score_text(t) for t, k in zip(texts, kept) if not k) and not kept[-2:].any()
    assert not abuse.candidates(pa.array([None, ""], pa.string())).any()


def test_the_machine_of_letters_equals_a_search_of_all_words():
    m, rng = abuse.words(), random.Random(3)
    plain = {}
    for name, text in abuse.WORDS.items():
        for w in text.split():
            plain.setdefault(abuse.plain(w), set()).add(name)
    for w in rng.sample(sorted(plain), 300):
        word = w.rstrip("*")
        want = {n for v, names in plain.items() for n in names if v == word or v.endswith("*") and word.startswith(v[:-1])}
        got = {n for n in abuse.WORDS if m.plainly(word) & abuse._BIT[n]}
        assert got == want, w


def test_a_table(spark):
    rows = [(i, t) for i, t in enumerate([*BAD, *GOOD, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in score_texts(df, "doc_id", "text").where(f"score >= {THRESHOLD}").collect()}
    assert got == set(range(len(BAD)))
    assert score_texts(df.where("false"), "doc_id", "text").count() == 0
