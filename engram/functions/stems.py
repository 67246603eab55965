"""English word stems by Porter's algorithm (1980), for text search."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the published algorithm: suffixes with their replacements, by step.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
# The words that English text search leaves out.
STOP_WORDS = frozenset("a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split())


def _kinds(word: str) -> str:
    """c or v for each letter; y is a vowel behind a consonant."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _kinds(stem)))


def _short_end(stem: str) -> bool:
    return len(stem) > 2 and _kinds(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str], least: int) -> str:
    """The longest suffix of the table that the word has is replaced, if the stem's measure is over ``least``."""
    for n in range(min(8, len(word)), 1, -1):
        if (suffix := word[-n:]) in table:
            stem = word[:-n]
            return stem + table[suffix] if _measure(stem) > least else word
    return word


@lru_cache(maxsize=1 << 19)
def stem(word: str) -> str:
    """The stem of a lower-case word of ASCII letters; other words and those of two letters or fewer are their own."""
    if len(word) <= 2 or not (word.isascii() and word.isalpha()):
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (m := re.fullmatch("(.*)(ed|ing)", word)) and "v" in _kinds(m[1]):
        word = m[1]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short_end(word):
            word += "e"
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(word, STEP2, 0)
    word = _replaced(word, STEP3, 0)
    for suffix in sorted((s for s in STEP4 if word.endswith(s)), key=len, reverse=True)[:1]:
        base = word[: -len(suffix)]
        if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _short_end(base):
            word = base
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def terms(text: str) -> list[str]:
    """Stems of a query's words without stop words, in order, each once."""
    words = [w for w in re.findall("[a-z0-9]+", text.lower()) if w not in STOP_WORDS]
    return list(dict.fromkeys(map(stem, words)))
