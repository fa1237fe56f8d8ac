"""Stemming of English words after Porter (1980), as full-text indexes use it.

Words shorter than three or longer than 64 characters, and words with other characters
than a-z, are left as they are.
"""

from __future__ import annotations

import re
from functools import lru_cache

_C, _V = "[^aeiou]", "[aeiouy]"
_CC, _VV = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M_GT_0 = re.compile(f"^({_CC})?{_VV}{_CC}")
_M_EQ_1 = re.compile(f"^({_CC})?{_VV}{_CC}({_VV})?$")
_M_GT_1 = re.compile(f"^({_CC})?{_VV}{_CC}{_VV}{_CC}")
_VOWEL = re.compile(f"^({_CC})?{_V}")
_SHORT = re.compile(f"^{_CC}{_V}[^aeiouwxy]$")

#: The suffix tables of steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(1 << 16)
def stem(word: str) -> str:
    if not 3 <= len(word) <= 64 or not word.isascii() or not word.isalpha():
        return word
    first_y = word[0] == "y"
    if first_y:
        word = "Y" + word[1:]
    # Plurals.
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # Past and progressive forms.
    if word.endswith("eed") and len(word) > 3:
        if _M_GT_0.search(word[:-3]):
            word = word[:-1]
    else:
        ending = "ed" if word.endswith("ed") else "ing" if word.endswith("ing") else ""
        if ending and _VOWEL.search(word[: -len(ending)]):
            word = word[: -len(ending)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
                word = word[:-1]
            elif _SHORT.search(word):
                word += "e"
    if word.endswith("y") and _VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        ending = _longest(word, table)
        if ending and _M_GT_0.search(word[: -len(ending)]):
            word = word[: -len(ending)] + table[ending]
    ending = _longest(word, STEP_4)
    if ending:
        if _M_GT_1.search(word[: -len(ending)]):
            word = word[: -len(ending)]
    elif word.endswith(("sion", "tion")) and _M_GT_1.search(word[:-3]):
        word = word[:-3]
    if word.endswith("e"):
        rest = word[:-1]
        if _M_GT_1.search(rest) or (_M_EQ_1.search(rest) and not _SHORT.search(rest)):
            word = rest
    if word.endswith("ll") and _M_GT_1.search(word[:-1]):
        word = word[:-1]
    return word.lower() if first_y else word
