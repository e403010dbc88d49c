"""Problem 10: abusive, hateful and sexual content, by a weighted finite-state grammar.

Three transducers are composed, each reading what the one before writes.

Letters to words: the words of the lexicon are a tree of letters, and each
letter may be read in disguise at a cost: a look-alike, a digit or sign for a
letter, a letter hidden or drawn out, signs between letters. The two are
composed as a word is read: the states are places in the tree with what was
paid so far. A word comes out as the set of its classes. A string longer than
any word is read as words without blanks.

Words to phrases: the phrases of the grammar are compiled into one machine that
shares their beginnings; a state is a place in phrases together with how many
words may still be passed over. It writes a phrase's kind, feature and weight.

Phrases to clauses: two small machines read the sentence from the left and from
the right and tell, for each word, whether it is negated, reported or quoted;
composed with the phrases they take a weight away that isn't the writer's own.

So what is scored is a clause and not a word. Words are classed once for each
distinct word of a batch of texts, over Arrow columns; only texts with a word
that some phrase must have go through the grammar.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .lexicon import HELPERS, LOOKALIKES, MASKS, PARTS, PHRASES, SIGNS, WORDS
from .tokens import slices

THRESHOLD = 1.0
KINDS = ("insult", "threat", "hate", "sexual")
#: Classes whose words may stand hidden behind signs.
HIDDEN = ("INSULT", "BEAST", "VULGAR", "HARM", "ROOTOUT", "VERMIN", "WEAKVERMIN", "SUBHUMAN", "EVIL", "ADJ", "SEXACT", "SEXPART", "NUDE", "PORN", "HORNY", "WHORE", "BODYPART")
#: How many words a negation covers.
REACH = 3

_NAMES = (*WORDS, "NAME", "BREAK")
_BIT = {name: 1 << i for i, name in enumerate(_NAMES)}
_HIDDEN_BITS = sum(_BIT[n] for n in HIDDEN)
_INVISIBLE = re.compile("[\xad᠎​-‏‪-‮⁠-⁤﻿]")
_EDGE = "\"'«»“”„‘’‚‹›()[]{}<>.,;:!?¡¿…-–—_~`|/\\"
_NOT_CONTRACTED = re.compile(r"^(\w+)n['’]t$", re.I)


def plain(text: str) -> str:
    """Lower case, without accents and invisible signs; look-alikes as the letters they look like."""
    text = _INVISIBLE.sub("", text).lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(LOOKALIKES)).translate(LOOKALIKES)
        text = "".join(c for c in text if not unicodedata.combining(c)).replace("ß", "ss").replace("œ", "oe").replace("æ", "ae").replace("ſ", "s")
    return text


@dataclass
class WordMachine:
    """The tree of letters. Node 0 is the root; ``ends`` are the classes of a word that ends at a node, ``stems`` those of any word that goes on from it."""

    arcs: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[int] = field(default_factory=lambda: [0])
    stems: list[int] = field(default_factory=lambda: [0])
    longest: int = 0

    def add(self, word: str, bits: int) -> None:
        stem, word = word.endswith("*"), word.rstrip("*")
        node = 0
        for c in word:
            if c not in self.arcs[node]:
                self.arcs[node][c] = len(self.arcs)
                self.arcs.append({})
                self.ends.append(0)
                self.stems.append(0)
            node = self.arcs[node][c]
        self.ends[node] |= bits
        if stem:
            self.stems[node] |= bits
        self.longest = max(self.longest, len(word))

    def plainly(self, word: str) -> int:
        """Classes of a word without disguise: the path that costs nothing."""
        node, bits = 0, 0
        for c in word:
            node = self.arcs[node].get(c, -1)
            if node < 0:
                return bits
            bits |= self.stems[node]
        return bits | self.ends[node]

    def disguised(self, word: str) -> int:
        """Classes of all words that ``word`` may stand for.

        A state is a node, the letter that led to it, how many letters were
        hidden and how many shown; -1 is the place behind a stem, which any
        letter may follow. Hidden letters are believed only in words of four
        letters or more that show three of them, or both their ends.
        """
        states = {(0, "", 0, 0, False): 0}
        for i, c in enumerate(word):
            edge = i in (0, len(word) - 1)
            after: dict[tuple[int, str, int, int, bool], int] = {}

            def go(key: tuple[int, str, int, int, bool], bits: int, after: dict = after) -> None:
                after[key] = after.get(key, 0) | bits

            for (node, last, hid, shown, dark), bits in states.items():
                if c == last or c in PARTS and node:
                    go((node, last, hid, shown, dark), bits)
                if node < 0:
                    if c.isalpha() or c in MASKS or c in SIGNS:
                        go((node, "", hid, shown + 1, dark), bits)
                    continue
                for letter in (c, *SIGNS.get(c, "")):
                    to = self.arcs[node].get(letter)
                    if to is not None:
                        go((to, letter, hid, shown + 1, dark), bits)
                        if self.stems[to]:
                            go((-1, letter, hid, shown + 1, dark), bits | self.stems[to])
                if c in MASKS:
                    for letter, to in self.arcs[node].items():
                        go((to, letter, hid + 1, shown, dark or edge), bits)
                        if self.stems[to]:
                            go((-1, letter, hid + 1, shown, dark or edge), bits | self.stems[to])
            states = after
        out = 0
        for (node, _, hid, shown, dark), bits in states.items():
            bits |= self.ends[node] if node >= 0 else 0
            if hid:
                bits = bits & _HIDDEN_BITS if hid + shown >= 4 and (shown >= 3 or shown == 2 and not dark) else 0
            out |= bits
        return out

    def glued(self, word: str) -> list[int]:
        """Classes of the words in a string without blanks, the longest word at each place; letters of none are passed over."""
        out, i = [], 0
        while i < len(word):
            node, j, best, end = 0, i, 0, i
            while j < len(word) and (node := self.arcs[node].get(word[j], -1)) >= 0:
                j += 1
                if self.ends[node] and j - i > 1:
                    best, end = self.ends[node] | self.stems[node], j
            if best:
                out.append(best)
            i = max(end, i + 1)
        return out


@functools.cache
def words() -> WordMachine:
    m = WordMachine()
    for name, text in WORDS.items():
        for w in text.split():
            m.add(plain(w), _BIT[name])
    return m


@functools.lru_cache(maxsize=400_000)
def classes(raw: str) -> int:
    """The class bits of one word as it stands in a text, disguised or not."""
    m = words()
    bare = plain(raw)
    word = bare.strip(_EDGE)
    if not word:
        return 0
    if word.isalpha():
        bits = m.plainly(word)
        return bits or (m.disguised(word) if _drawn_out(word) else 0)
    for sign in ("'", "’", "-"):
        if sign in word and not re.fullmatch(r"\w(?:[-.·_*~]\w){2,}", word):
            return functools.reduce(lambda b, part: b | classes(part), filter(None, word.split(sign)), 0)
    if not re.search(r"[a-z]", word) or word[0].isdigit() and word[-1].isdigit():
        return 0
    # signs at the ends may be letters
    return m.disguised(word) or (m.disguised(bare) if bare != word and bare[0] in SIGNS or bare[-1] in MASKS else 0)


def _drawn_out(word: str) -> bool:
    return any(word[i] == word[i + 1] == word[i + 2] for i in range(len(word) - 2))


@dataclass
class PhraseMachine:
    """All phrases in one: arcs by class, an arc that passes over any word, and what a state writes."""

    by_class: list[dict[int, tuple[int, ...]]]
    over: list[int]
    writes: list[tuple[int, ...]]

    def run(self, bits: list[list[int]]) -> list[tuple[int, int, int]]:
        """``(phrase, first, last)`` of every phrase accepted, from the latest word it may begin with."""
        found, active = [], {}
        for at, own in enumerate(bits):
            after: dict[int, int] = {}
            active[0] = at
            for state, first in active.items():
                arcs = self.by_class[state]
                for b in own:
                    for to in arcs.get(b, ()):
                        if after.get(to, -1) < first:
                            after[to] = first
                to = self.over[state]
                if to >= 0 and after.get(to, -1) < first:
                    after[to] = first
            for state, first in after.items():
                found += [(p, first, at) for p in self.writes[state]]
            active = after
        return found


@functools.cache
def phrases() -> PhraseMachine:
    m = PhraseMachine([{}], [-1], [()])
    known: dict[tuple, int] = {}

    def state(key: tuple) -> int:
        if key not in known:
            known[key] = len(m.by_class)
            m.by_class.append({})
            m.over.append(-1)
            m.writes.append(())
        return known[key]

    for number, (_, _, _, text) in enumerate(PHRASES):
        parts = text.split()
        here = [0]
        for k in range(0, len(parts), 2):
            bit = _BIT[parts[k]]
            if k + 1 == len(parts):
                end = state((*parts[: k + 1], "end"))
                m.writes[end] = (*m.writes[end], number)
                targets = [end]
            else:
                targets = [state((*parts[: k + 2], left)) for left in range(int(parts[k + 1]), -1, -1)]
                for a, b in zip(targets, targets[1:]):
                    m.over[a] = b
            for s in here:
                m.by_class[s][bit] = tuple(dict.fromkeys((*m.by_class[s].get(bit, ()), targets[0])))
            here = targets
    return m


#: The left and the right machine: a row for each state, a column for each sign read (other, NOT, SAY, REPORT, BREAK).
#: States count the words a negation still covers, and add 4 once something was said or reported.
_OTHER, _NOT, _SAY, _REPORT, _STOP = range(5)


def _left_table() -> list[list[int]]:
    out = []
    for state in range(8):
        said, left = state // 4, state % 4
        less = max(0, left - 1)
        out.append([said * 4 + less, said * 4 + REACH, 4 + less, 4 + less, said * 4])
    return out


_LEFT = _left_table()
#: From the right only a report counts; what is merely said afterwards may be anything.
_RIGHT = [[0, 0, 0, 1, 0], [1, 1, 1, 1, 1]]


def _sign(bits: int) -> int:
    return _REPORT if bits & _BIT["REPORT"] else _SAY if bits & _BIT["SAY"] else _NOT if bits & _BIT["NOT"] else _OTHER


_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+(?=[\"'«“„¡¿(\[]*[^\W\d_a-zß-öø-ÿ])|\n\s*\n")
_WORD = re.compile(r"\S+")
_OPEN, _CLOSE = "«“„‹", "»”›"


@dataclass
class Sentence:
    bits: list[int] = field(default_factory=list)
    quoted: list[bool] = field(default_factory=list)
    stops: list[bool] = field(default_factory=list)

    def add(self, bits: int, quoted: bool, stop: bool = False) -> None:
        self.bits.append(bits)
        self.quoted.append(quoted)
        self.stops.append(stop)


def _read(text: str) -> Sentence:
    """The words of a sentence as classes; letters set apart by blanks are put together, glued words taken apart."""
    raw, out, depth, i = _WORD.findall(text), Sentence(), 0, 0
    m = words()
    while i < len(raw):
        w = raw[i]
        if w[0] in _OPEN or w[0] == '"':
            depth += 1
        j = i
        while j < len(raw) and len(s := plain(raw[j]).strip(_EDGE)) == 1 and s.isalnum():
            j += 1
        if j - i >= 3 and _spaced(raw[i:j], out, depth > 0):
            i = j
            continue
        stop = w[-1] in ",;:—–" or w in ("-", "—", "–")
        if (c := _NOT_CONTRACTED.match(w.strip(_EDGE))) is not None:
            parts = [c[1], "not"]
        else:
            parts = [p for p in re.split("['’]", w) if p] if "'" in w or "’" in w else [w]
        for p in parts:
            bare = plain(p).strip(_EDGE)
            if len(bare) > 2 * m.longest and bare.isalpha():
                for b in m.glued(bare):
                    out.add(b, depth > 0)
                continue
            bits = classes(p)
            bare = p.strip(_EDGE)
            if i and len(bare) > 2 and bare[0].isupper() and bare[1:].islower() and bare.isalpha():
                bits |= _BIT["NAME"]
            out.add(bits, depth > 0)
        if stop and out.stops:
            out.stops[-1] = True
        if depth and (any(c in w for c in _CLOSE) or '"' in w[1:]):
            depth -= 1
        i += 1
    return out


def _spaced(letters: list[str], out: Sentence, quoted: bool) -> bool:
    """Put single letters together, if they make a word; one letter at either end may be a word of its own."""
    whole = "".join(plain(x).strip(_EDGE) for x in letters)
    for a in (0, 1):
        for z in (len(whole), len(whole) - 1):
            if z - a >= 3 and (b := classes(whole[a:z])):
                for c in whole[:a]:
                    out.add(classes(c), quoted)
                out.add(b, quoted)
                for c in whole[z:]:
                    out.add(classes(c), quoted)
                return True
    return False


@functools.lru_cache(maxsize=20_000)
def _bit_list(bits: int) -> tuple[int, ...]:
    return tuple(b for b in (1 << i for i in range(len(_NAMES))) if bits & b)


def _matches(sentence: Sentence) -> list[tuple[int, int, int]]:
    """The phrases of a sentence, each with what its context leaves of its weight above nothing."""
    n = len(sentence.bits)
    left, state = [0] * n, 0
    for i, b in enumerate(sentence.bits):
        left[i] = state
        state = _LEFT[state][_sign(b)]
        if sentence.stops[i]:
            state = _LEFT[state][_STOP]
    right, state = [0] * n, 0
    for i in range(n - 1, -1, -1):
        right[i] = state
        state = _RIGHT[state][_sign(sentence.bits[i])]
    some_quoted = any(sentence.quoted) and not all(sentence.quoted)
    out = []
    for phrase, first, last in phrases().run([list(_bit_list(b)) for b in sentence.bits]):
        own = left[first] == 0 and right[last] == 0
        inside = any(sentence.bits[i] & (_BIT["NOT"] | _BIT["REPORT"]) and not sentence.bits[i] & (_BIT["YOU"] | _BIT["INSULT"]) for i in range(first + 1, last))
        if own and not inside and not (some_quoted and sentence.quoted[first] and sentence.quoted[last]):
            out.append((phrase, first, last))
    return out


def score_text(text: str) -> dict[str, float]:
    """The score of each kind in a text; a kind that no clause has is missing.

    In each sentence a feature of a kind counts with its best phrase, and the
    features of a kind add up. A phrase has no weight if a negation reaches
    it, if it is said or reported by someone before it, if a report follows
    it, or if it alone of its sentence stands in quotation marks.
    """
    out: dict[str, float] = {}
    for part in _SENTENCE.split(text):
        if not part or not part.strip():
            continue
        sentence = _read(part)
        have = functools.reduce(int.__or__, sentence.bits, 0)
        if not any(have & need == need for need in _NEEDS_LIST):
            continue
        best: dict[tuple[str, str], float] = {}
        for phrase, _, _ in _matches(sentence):
            kind, feature, weight, _ = PHRASES[phrase]
            best[kind, feature] = max(best.get((kind, feature), 0.0), weight)
        for kind in KINDS:
            own = {f: w for (k, f), w in best.items() if k == kind}
            if own.keys() - HELPERS:
                out[kind] = out.get(kind, 0.0) + sum(own.values())
    return out


#: What each phrase must have, but for a name, which is told by its place.
_NEEDS = np.array(sorted({sum(_BIT[c] for c in set(text.split()[::2]) - {"NAME"}) for _, f, _, text in PHRASES if f not in HELPERS}), dtype=np.int64)
_NEEDS_LIST = _NEEDS.tolist()
_ENDS = re.compile(r"[.!?…][\"'»”’)\]]*$")
_BEGINS = re.compile(r"[\"'«“„¡¿(\[]*[^\W\d_a-zß-öø-ÿ]")
_SINGLE, _GLUED, _LAST, _FIRST = 1, 2, 4, 8


@functools.lru_cache(maxsize=400_000)
def _facts(raw: str) -> tuple[int, int]:
    """The classes of what stands between two blanks, and whether it is a single letter, glued words, the last or the first of a sentence."""
    s = plain(raw).strip(_EDGE)
    flags = (_SINGLE if len(s) == 1 and s.isalnum() else 0) | (_GLUED if len(s) > 2 * words().longest else 0)
    return classes(raw), flags | (_LAST if _ENDS.search(raw) else 0) | (_FIRST if _BEGINS.match(raw) else 0)


def candidates(texts: pa.Array) -> np.ndarray:
    """Which texts have a sentence with all the classes of some phrase, glued words, or three single letters in a row.

    Sentences are told by their words alone, so that one here may be several;
    none is cut that :func:`score_text` reads as one.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.utf8_split_whitespace(texts)
    flat = parts.flatten()
    coded = flat.dictionary_encode()
    facts = np.array([_facts(w) if w else (0, 0) for w in coded.dictionary.to_pylist()], dtype=np.int64).reshape(-1, 2)
    out = np.zeros(len(texts), dtype=bool)
    if not len(flat):
        return out
    bits, flags = facts[np.asarray(coded.indices)].T
    offsets = np.asarray(parts.offsets)
    offsets = offsets - offsets[0]
    begin = np.zeros(len(bits), dtype=bool)
    begin[offsets[:-1][offsets[:-1] < len(bits)]] = True
    begin[1:] |= (flags[:-1] & _LAST > 0) & (flags[1:] & _FIRST > 0)
    starts = np.flatnonzero(begin)
    have = np.bitwise_or.reduceat(bits, starts)
    hit = np.bitwise_or.reduceat(flags, starts) & _GLUED > 0
    for need in _NEEDS:
        hit |= have & need == need
    single = flags & _SINGLE > 0
    if len(single) > 2:
        run = np.flatnonzero(single[:-2] & single[1:-1] & single[2:])
        hit[np.searchsorted(starts, run, side="right") - 1] = True
    out[np.searchsorted(offsets, starts[hit], side="right") - 1] = True
    return out


def score_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, insult, threat, hate, sexual, score)`` of each row; null and empty texts score 0.

    ``score`` is the sum of the kinds; a text counts as abusive from 1 on.
    Nothing is shuffled.
    """
    schema = T.StructType([df.schema[key], *[T.StructField(k, T.DoubleType()) for k in (*KINDS, "score")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                column = part.column(text)
                values = np.zeros((len(KINDS) + 1, part.num_rows))
                for i in np.flatnonzero(candidates(column)):
                    found = score_text(column[int(i)].as_py())
                    for j, k in enumerate(KINDS):
                        values[j, i] = found.get(k, 0.0)
                values[-1] = values[:-1].sum(axis=0)
                yield pa.RecordBatch.from_arrays([part.column(key), *map(pa.array, values)], names=[key, *KINDS, "score"])

    return df.select(key, text).mapInArrow(run, schema)
