"""English stems by the published Porter2 rules, as a function of arrays of words in Arrow batches.

Two regions of a word decide what may be cut: R1 begins after the first non-vowel that follows a vowel, R2 likewise within R1.
Each step looks for the longest of its endings and acts only if that one stands in the step's region.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words with stems of their own, words that stay as they are, and words at which the first step ends.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINISHED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Beginnings after which R1 starts at once.
LEADS = ("gener", "commun", "arsen")
#: Endings of the second and third step and what takes their place.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
#: Endings that the fourth step drops.
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_REGION = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _after(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


@lru_cache(1 << 16)
def porter2(word: str) -> str:
    """The stem of a word in small letters."""
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in SPECIAL:
        return SPECIAL[word]
    if word.startswith("y"):
        word = "Y" + word[1:]
    word = re.sub("([aeiouy])y", r"\1Y", word)
    lead = next((x for x in LEADS if word.startswith(x)), None)
    r1 = len(lead) if lead else _after(word, 0)
    r2 = _after(word, r1)
    if ending := _longest(word, ("'", "'s", "'s'")):
        word = word.removesuffix(ending)
    word = _plural(word)
    if word in FINISHED:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    ending = _longest(word, SECOND)
    if ending and len(word) - len(ending) >= r1:
        rest = word.removesuffix(ending)
        if ending not in ("ogi", "li") or ending == "ogi" and rest.endswith("l") or ending == "li" and rest[-1:] in tuple("cdeghkmnrt"):
            word = rest + SECOND[ending]
    ending = _longest(word, THIRD)
    if ending and len(word) - len(ending) >= (r2 if ending == "ative" else r1):
        word = word.removesuffix(ending) + THIRD[ending]
    ending = _longest(word, FOURTH)
    if ending and len(word) - len(ending) >= r2 and (ending != "ion" or word[-4:-3] in ("s", "t")):
        word = word.removesuffix(ending)
    last = len(word) - 1
    if word.endswith("e") and (last >= r2 or last >= r1 and not _SHORT.search(word[:-1])) or word.endswith("ll") and last >= r2:
        word = word[:-1]
    return word.lower()


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    ending = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending is None:
        return word
    rest = word.removesuffix(ending)
    if ending.startswith("eed"):
        return rest + "ee" if len(rest) >= r1 else word
    if not _VOWEL.search(rest):
        return word
    if rest.endswith(("at", "bl", "iz")):
        return rest + "e"
    if _DOUBLE.search(rest):
        return rest[:-1]
    return rest + "e" if len(rest) <= r1 and _SHORT.search(rest) else rest


def english(words: Column) -> Column:
    """The stems of an array of words."""

    @F.pandas_udf("array<string>")  # type: ignore[call-overload]
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ws: [porter2(w) for w in ws], na_action="ignore")

    return run(words)
