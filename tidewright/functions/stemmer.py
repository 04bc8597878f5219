"""The English (Porter2) stemmer, from its published description, and the analyser that uses it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from tidewright.functions.text import STOPWORDS

# Fixed values of the algorithm.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = frozenset("sky news howe atlas cosmos bias andes".split())
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"),
    ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
)
STEP_3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
VALID_LI = "cdeghkmnrt"

_REGION = re.compile(f"[{VOWELS}][^{VOWELS}]")
_VOWEL = re.compile(f"[{VOWELS}]")


def _regions(w: str) -> tuple[int, int]:
    prefix = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if prefix:
        r1 = len(prefix)
    else:
        m = _REGION.search(w)
        r1 = m.end() if m else len(w)
    m = _REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    """Whether a word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS + "wxY"


def stem(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    if w in SPECIAL:
        return SPECIAL[w]
    if w in UNCHANGED:
        return w
    w = re.sub(f"(^|[{VOWELS}])y", r"\1Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    if w.endswith(("eed", "eedly")):
        end = 5 if w.endswith("ly") else 3
        if len(w) - end >= r1:
            w = w[:-end] + "ee"
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if _VOWEL.search(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(DOUBLES):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    for end, put in STEP_2:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3:-2] in VALID_LI and len(w) > 2):
                w = w[: -len(end)] + put
            break
    for end, put in STEP_3:
        if w.endswith(end):
            if len(w) - len(end) >= r1 and (end != "ative" or len(w) - len(end) >= r2):
                w = w[: -len(end)] + put
            break
    for end in STEP_4:
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(end)]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_STOP = frozenset(STOPWORDS)


def analyse(text: str | None) -> list[str]:
    """Unicode words, lower case, without stop words, stemmed."""
    return [stem(w) for w in (m.lower().replace("’", "'") for m in _WORD.findall(text or "")) if w not in _STOP]


@pandas_udf(ArrayType(StringType()))
def english_tokens(text: pd.Series) -> pd.Series:
    """For bm25.build(analyse=…) and bm25.search(analyse=…)."""
    return text.map(analyse, na_action=None)
