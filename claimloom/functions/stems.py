"""The English Snowball stemmer (Porter 2), after its published description, for Arrow batches of words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOWELS = "aeiouy"
# Fixed values of the algorithm.
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
SAME_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
LATE_REGION = ("gener", "commun", "arsen")
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _after_vc(word: str, start: int) -> int:
    """Behind the first consonant that follows a vowel, from ``start`` on."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    """Does the word end in a short syllable?"""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def stem(word: str | None) -> str | None:
    """The stem of a word in lower case; words of one or two letters stay."""
    if word is None:
        return None
    word = word.lower().replace("’", "'")
    if len(word) <= 2 or word in SAME:
        return word
    if word in WHOLE:
        return WHOLE[word]
    word = word.removeprefix("'")
    # a y that is a consonant is written Y
    word = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in VOWELS) else c for i, c in enumerate(word))
    late = next((p for p in LATE_REGION if word.startswith(p)), None)
    r1 = len(late) if late else _after_vc(word, 0)
    r2 = _after_vc(word, r1)
    end = _longest(word, ("'s'", "'s", "'"))
    word = word[: len(word) - len(end)]

    end = _longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and any(c in VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in SAME_AFTER_PLURAL:
        return word

    end = _longest(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: len(word) - len(end)] + "ee"
    elif end and any(c in VOWELS for c in word[: len(word) - len(end)]):
        word = word[: len(word) - len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif r1 >= len(word) and _short_end(word):
            word += "e"

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    end = _longest(word, STEP_2)
    cut = len(word) - len(end)
    if end and cut >= r1 and (end != "ogi" or word[cut - 1 : cut] == "l") and (end != "li" or word[cut - 1 : cut] in tuple(LI_ENDINGS)):
        word = word[:cut] + STEP_2[end]

    end = _longest(word, STEP_3)
    cut = len(word) - len(end)
    if end and cut >= r1 and (end != "ative" or cut >= r2):
        word = word[:cut] + STEP_3[end]

    end = _longest(word, STEP_4)
    cut = len(word) - len(end)
    if end and cut >= r2 and (end != "ion" or word[cut - 1 : cut] in ("s", "t")):
        word = word[:cut]

    cut = len(word) - 1
    if word.endswith("e") and (cut >= r2 or (cut >= r1 and not _short_end(word[:-1]))) or word.endswith("ll") and cut >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def stemmed(text: Column) -> Column:
    """The stem of each text, which is taken as one word."""

    @F.pandas_udf(StringType())
    def of(words: pd.Series) -> pd.Series:
        return words.map(stem, na_action="ignore")

    return of(text)
