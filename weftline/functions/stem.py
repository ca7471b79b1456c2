"""The Porter stemmer, from M. F. Porter, An algorithm for suffix stripping (1980)."""

from __future__ import annotations

import re

_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _kinds(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _m(stem: str) -> int:
    return len(re.findall("v+c", re.sub("v+", "v", re.sub("c+", "c", _kinds(stem)))))


def _short(stem: str) -> bool:
    return _kinds(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay as they are."""
    if len(word) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = None
    if word.endswith("eed"):
        word = word[:-1] if _m(word[:-3]) else word
    elif word.endswith("ed") and "v" in _kinds(word[:-2]):
        cut = word[:-2]
    elif word.endswith("ing") and "v" in _kinds(word[:-3]):
        cut = word[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            word = cut + "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and _kinds(cut)[-1] == "c" and cut[-1] not in "lsz":
            word = cut[:-1]
        else:
            word = cut + "e" if _m(cut) == 1 and _short(cut) else cut
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        if (e := _longest(word, table)) and _m(word[: -len(e)]):
            word = word[: -len(e)] + table[e]
    if (e := _longest(word, _STEP4)) and _m(base := word[: -len(e)]) > 1 and (e != "ion" or base.endswith(("s", "t"))):
        word = base
    if word.endswith("e") and (_m(word[:-1]) > 1 or _m(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _m(word) > 1 else word
