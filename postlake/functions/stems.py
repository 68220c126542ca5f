"""English stems for full-text search: the published Porter2 rules, cached per word, in Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F, types as T

from postlake.functions.batches import in_text_batches

# The rules of the English stemmer.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = frozenset(("sky", "news", "howe", "atlas", "cosmos", "bias", "andes"))
UNCHANGED_SINGULARS = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _suffix(word: str, among) -> str:
    """The longest of ``among`` that ends the word."""
    return max((s for s in among if word.endswith(s)), key=len, default="")


def _replaced(word: str, rules: dict[str, str], r1: int, r2: int) -> str:
    """Steps 2 and 3: the longest suffix, if it lies in the first region and what precedes it allows."""
    s = _suffix(word, rules)
    at = len(word) - len(s)
    if not s or at < r1 or (s == "ogi" and word[at - 1] != "l") or (s == "li" and word[at - 1] not in "cdeghkmnrt") or (s == "ative" and at < r2):
        return word
    return word[:at] + rules[s]


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two characters are their own."""
    if len(word) <= 2 or word in UNCHANGED:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = re.sub("(?<![^aeiouy])y", "Y", word) if "y" in word else word  # a y that's a consonant
    m = re.match("gener|commun|arsen", w) or _REGION.search(w)
    r1 = m.end() if m else len(w)
    m = _REGION.search(w, r1)
    r2 = m.end() if m else len(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in UNCHANGED_SINGULARS:
        return w
    s = _suffix(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    at = len(w) - len(s)
    if s.startswith("ee"):
        w = w[: at + 2] if at >= r1 else w
    elif s and re.search("[aeiouy]", w[:at]):
        w = w[:at]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP_2, r1, r2), STEP_3, r1, r2)
    s = _suffix(w, STEP_4)
    at = len(w) - len(s)
    if s and at >= r2 and (s != "ion" or w[at - 1] in "st"):
        w = w[:at]
    at = len(w) - 1
    if (w.endswith("e") and (at >= r2 or (at >= r1 and not _SHORT.search(w[:-1])))) or (w.endswith("ll") and at >= r2):
        w = w[:-1]
    return w.lower()


@in_text_batches
@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])
