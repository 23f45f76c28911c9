"""English words to their stems, by the published Porter2 ("Snowball English") rules, and English stop words.

The stemmer is a function of one word.  Texts are cut into words by Spark, and what
goes to Python is one word a row, so a batch is small however long the texts are.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The stop words of the published list, and the rules' word lists and endings.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
LONG_REGIONS = ("gener", "commun", "arsen")
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
BEFORE_LI = "cdeghkmnrt"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")

_VOWEL = "[aeiouy]"
_REGION = re.compile(f"{_VOWEL}[^aeiouy]")
_SHORT_END = re.compile("(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _regions(word: str) -> tuple[int, int]:
    """Where the parts after the first, and after the second, consonant that follows a vowel begin."""
    led = next((p for p in LONG_REGIONS if word.startswith(p)), None)
    first = len(led) if led else (m.end() if (m := _REGION.search(word)) else len(word))
    second = m.end() if (m := _REGION.search(word, first)) else len(word)
    return first, second


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith(("ied", "ies")):
        return w[:-2] if len(w) > 4 else w[:-1]
    if w.endswith(("us", "ss")) or not w.endswith("s"):
        return w
    return w[:-1] if re.search(_VOWEL, w[:-2]) else w


def _past(w: str, first: int) -> str:
    ending = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending.startswith("eed"):
        return w[: len(w) - len(ending)] + "ee" if len(w) - len(ending) >= first else w
    if not ending or not re.search(_VOWEL, w[: len(w) - len(ending)]):
        return w
    w = w[: len(w) - len(ending)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(DOUBLES):
        return w[:-1]
    return w + "e" if first >= len(w) and _SHORT_END.search(w) else w


@lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-cased word."""
    if len(word) <= 2:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = word.lstrip("'")
    w = re.sub(f"(^|(?<={_VOWEL}))y", "Y", w)
    first, second = _regions(w)
    w = w.removesuffix("'s'") if w.endswith("'s'") else w.removesuffix("'s") if w.endswith("'s") else w.removesuffix("'")
    w = _plural(w)
    if w in KEPT_AFTER_PLURAL:
        return w
    w = _past(w, first)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    if (ending := _ending(w, (*STEP_2, "ogi", "li"))) and len(w) - len(ending) >= first:
        head = w[: len(w) - len(ending)]
        if ending == "ogi":
            w = head + "og" if head.endswith("l") else w
        elif ending == "li":
            w = head if head[-1:] and head[-1] in BEFORE_LI else w
        else:
            w = head + STEP_2[ending]
    if (ending := _ending(w, (*STEP_3, "ative"))) and len(w) - len(ending) >= first:
        head = w[: len(w) - len(ending)]
        w = (head if len(head) >= second else w) if ending == "ative" else head + STEP_3[ending]
    if (ending := _ending(w, (*STEP_4, "ion"))) and len(w) - len(ending) >= second:
        head = w[: len(w) - len(ending)]
        w = head if ending != "ion" or head.endswith(("s", "t")) else w
    if w.endswith("e") and (len(w) - 1 >= second or len(w) - 1 >= first and not _SHORT_END.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= second:
        w = w[:-1]
    return w.replace("Y", "y")


def term(word: str) -> str | None:
    """What a lower-cased word counts as in a search; null for a stop word."""
    return None if word in STOP_WORDS else stem(word)


@F.pandas_udf(T.StringType())
def term_of(word: pd.Series) -> pd.Series:
    """``term`` of each of a column of words."""
    return word.map(term)


# Marked so that Spark neither works it out twice nor moves it below the step that leaves each word once.
term_of = term_of.asNondeterministic()


def words(text: Column) -> Column:
    """The words of a text in order: runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
