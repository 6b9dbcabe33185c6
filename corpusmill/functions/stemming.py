"""English stems by measured suffix steps (the second Porter algorithm, as published).

R1 is what follows the first consonant behind a vowel, R2 the same within R1; a suffix goes only where it lies in R1 or R2. Words are
lower case; those of one or two letters stay.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words whose stems the steps would miss, and words that stay after the plural is off
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAYING = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# fixed values: prefixes behind which R1 begins
PREFIXES = ("gener", "commun", "arsen")
# fixed values: suffixes within R1 and what replaces them
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
# fixed values: suffixes that go within R2
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")

_V = "aeiouy"
_after_vowel = re.compile("[aeiouy][^aeiouy]")


def _regions(w: str) -> tuple[int, int]:
    prefix = next((p for p in PREFIXES if w.startswith(p)), None)
    if prefix:
        r1 = len(prefix)
    else:
        found = _after_vowel.search(w)
        r1 = found.end() if found else len(w)
    found = _after_vowel.search(w, r1)
    return r1, found.end() if found else len(w)


def _ends_short(w: str) -> bool:
    """Whether w ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-3] not in _V and w[-2] in _V and w[-1] not in _V + "wxY"


def _has_vowel(w: str) -> bool:
    return any(c in _V for c in w)


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word)  # a y that is a consonant
    r1, r2 = _regions(w)
    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _has_vowel(w[:-2]):
        w = w[:-1]
    if w in STAYING:
        return w
    # -eed, -ed, -ing
    suffix = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if suffix in ("eed", "eedly"):
        if len(w) - len(suffix) >= r1:
            w = w[: -len(suffix)] + "ee"
    elif suffix and _has_vowel(w[: -len(suffix)]):
        w = w[: -len(suffix)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif r1 >= len(w) and _ends_short(w):
            w += "e"
    # a final y behind a consonant that isn't the first letter
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    # derived endings
    suffix = _longest(w, [*SECOND, "ogi", "li"])
    if suffix and len(w) - len(suffix) >= r1:
        if suffix == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif suffix == "li":
            w = w[:-2] if w[-3:-2] and w[-3] in "cdeghkmnrt" else w
        else:
            w = w[: -len(suffix)] + SECOND[suffix]
    suffix = _longest(w, [*THIRD, "ative"])
    if suffix and len(w) - len(suffix) >= r1:
        if suffix == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        else:
            w = w[: -len(suffix)] + THIRD[suffix]
    suffix = _longest(w, [*FOURTH, "ion"])
    if suffix and len(w) - len(suffix) >= r2 and (suffix != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(suffix)]
    # a final e or double l
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _ends_short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem_all(tokens: Column) -> Column:
    """The stems of an array of words, in Arrow batches."""

    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda words: None if words is None else [stem(w) for w in words])

    return F.pandas_udf(run, "array<string>")(tokens)


def stem_each(word: Column) -> Column:
    return F.pandas_udf(lambda words: words.map(lambda w: None if w is None else stem(w)), "string")(word)
