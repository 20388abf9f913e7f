"""English text-search analysis: words, stop words, Porter2 stems, cover density, headlines.

The stemmer and the ranking follow their published definitions; scores are consistent in
themselves and aren't claimed to equal any database's to the last digit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them
    their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an
    the and but if or because as until while of at by for with about against between into through during before after above below to from up down
    in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only
    own same so than too very s t can will just don should now""".split()
)
TOKEN = r"([\p{L}\p{N}]+)"
_TOKEN = re.compile(r"[^\W_]+")
LEXEMES = "array<struct<lexeme:string,pos:int>>"
#: Lexemes that a Python worker holds before it hands them on, besides one text's.
AT_ONCE = 1 << 16

_V = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEEP = frozenset("sky news howe atlas cosmos bias andes inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = (
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"), ("alism", "al"),
    ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"), ("ator", "ate"),
    ("enci", "ence"), ("izer", "ize"), ("bli", "ble"),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ism", "iti", "ive", "ize", "ous", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    def after(at: int) -> int:
        for i in range(at + 1, len(w)):
            if w[i] not in _V and w[i - 1] in _V:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short(w: str, r1: int) -> bool:
    if r1 < len(w):
        return False
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    """Porter2 (English Snowball) stem of a lower-case word."""
    w = word.lstrip("'")
    if len(w) <= 2:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    if w in _KEEP:
        return w
    w = re.sub(r"(^|[aeiouy])y", lambda m: m.group(1) + "Y", w)
    r1, r2 = _regions(w)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy].", w[:-1]):
        w = w[:-1]
    if w in _KEEP:
        return w
    for s in ("eedly", "eed"):
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + "ee"
            break
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if re.search(r"[aeiouy]", w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(_DOUBLE):
                        w = w[:-1]
                    elif _short(w, min(r1, len(w)) if r1 >= len(w) else r1):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for s, to in _STEP2:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + to
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for s, to in _STEP3:
        if w.endswith(s):
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + to
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for s in _STEP4:
        if w.endswith(s):
            if len(w) - len(s) >= r2:
                w = w[: -len(s)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1], min(r1, len(w) - 1) if r1 >= len(w) - 1 else r1)):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def lexemes(text: str | None) -> list[tuple[str, int]]:
    """(stem, position) in order; stop words keep their places."""
    return [(stem(w), i) for i, w in enumerate(_TOKEN.findall((text or "").lower()), 1) if w not in STOP]


def query_lexemes(query: str) -> list[str]:
    """The AND-ed stems of a plain query; empty where it holds stop words only."""
    return list(dict.fromkeys(w for w, _ in lexemes(query)))


def lexeme_arrays(texts: pa.Array, at_once: int = AT_ONCE) -> Iterator[pa.Array]:
    """A list of lexemes a text, in arrays of about ``at_once`` lexemes: memory follows neither the number of rows nor their length in all."""
    words, places, ends = [], [], [0]

    def flush() -> pa.Array:
        flat = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(places, pa.int32())], ["lexeme", "pos"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    for t in texts:
        for w, i in lexemes(t.as_py()):
            words.append(w)
            places.append(i)
        ends.append(len(words))
        if len(words) >= at_once:
            yield flush()
            words, places, ends = [], [], [0]
    if len(ends) > 1 or not len(texts):
        yield flush()


def to_lexemes(c: Column) -> Column:
    """The analysed column: what a text index stores of each row."""

    @F.arrow_udf(LEXEMES)
    def analysed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from lexeme_arrays(texts)

    return analysed(c)


def matches(lex: Column, wanted: list[str]) -> Column:
    """Every wanted lexeme occurs; no wanted lexeme matches nothing."""
    if not wanted:
        return F.lit(False)
    have = F.transform(lex, lambda x: x["lexeme"])
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), have)) == 0


def cover_density(positions: list[tuple[str, int]], wanted: list[str], weight: float = 0.1) -> float:
    """Sum over minimal covers of weight / (1 + words between); one lexeme alone scores weight per occurrence."""
    want = set(wanted)
    seq = [(w, p) for w, p in positions if w in want]
    if not want or {w for w, _ in seq} != want:
        return 0.0
    if len(want) == 1:
        return weight * len(seq)
    total, last = 0.0, -1
    count: dict[str, int] = {}
    left = 0
    for right, (w, p) in enumerate(seq):
        count[w] = count.get(w, 0) + 1
        if len(count) < len(want):
            continue
        while count[seq[left][0]] > 1:
            count[seq[left][0]] -= 1
            left += 1
        if left > last:
            noise = (p - seq[left][1]) - (right - left)
            total += weight / (1 + max(0, noise))
            last = left
            del count[seq[left][0]]
            left += 1
    return total


def rank_cd(lex: Column, wanted: list[str]) -> Column:
    """Cover density of a lexeme column; a single lexeme stays in built-in functions."""
    if len(wanted) == 1:
        return F.size(F.filter(lex, lambda x: x["lexeme"] == wanted[0])) * F.lit(0.1)

    @F.arrow_udf("double")
    def ranked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            scores = (cover_density([(x["lexeme"], x["pos"]) for x in r.as_py() or ()], wanted) for r in rows)  # a row at a time
            yield pa.array(scores, pa.float64(), size=len(rows))

    return ranked(F.filter(lex, lambda x: x["lexeme"].isin(*wanted)))  # only wanted lexemes come to Python


def headline(text: str | None, wanted: list[str], most: int = 35, least: int = 15) -> str:
    """The window of at most ``most`` words with the most wanted lexemes, those in bold; the beginning where none occurs."""
    words = (text or "").split()
    want = set(wanted)
    hit = [any(stem(w) in want for w in _TOKEN.findall(x.lower())) for x in words]
    best, at, inside = -1, 0, sum(hit[:most])
    for i in range(max(1, len(words) - most + 1)):
        if inside > best:
            best, at = inside, i
        if i + most < len(words):
            inside += hit[i + most] - hit[i]
    end = min(len(words), at + most)
    at = max(0, min(at, end - least))
    return " ".join(f"<b>{w}</b>" if h else w for w, h in zip(words[at:end], hit[at:end], strict=True))


def to_headline(c: Column, wanted: list[str]) -> Column:
    @F.pandas_udf("string")
    def cut(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in rows:
            yield s.map(lambda t: headline(t, wanted))

    return cut(c)


def term_frequency(c: Column, term: str) -> Column:
    """Occurrences of one unstemmed term of letters a-z and digits, by built-in functions only."""
    return F.regexp_count(F.lower(c), F.lit(f"(?<![a-z0-9]){term}(?![a-z0-9])"))
