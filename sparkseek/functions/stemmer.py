"""The Snowball English stemmer, from its published definition."""

from __future__ import annotations

import re
from functools import lru_cache

# Suffixes and exceptions of the published algorithm.
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP_2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"),
    ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""),
]
_STEP_3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
_VOWEL = "[aeiouy]"
_SHORT = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])\Z")


def _region(word: str, start: int) -> int:
    m = re.compile(f"{_VOWEL}[^aeiouy]").search(word, start)
    return m.end() if m else len(word)


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if len(word) <= 2 or not re.fullmatch("[a-z']+", word):
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    w = word.removeprefix("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    prefix = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(prefix) if prefix else _region(w, 0)
    r2 = _region(w, r1)
    w = re.sub(r"'s'?\Z|'\Z", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_VOWEL, w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    w = _step_1b(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for suffix, new in _STEP_2:
        if w.endswith(suffix):
            before = w[: -len(suffix)]
            allowed = {"ogi": before.endswith("l"), "li": before[-1:] != "" and before[-1:] in "cdeghkmnrt"}.get(suffix, True)
            if len(before) >= r1 and allowed:
                w = before + new
            break
    for suffix, new in _STEP_3:
        if w.endswith(suffix):
            before = w[: -len(suffix)]
            if len(before) >= (r2 if suffix == "ative" else r1):
                w = before + new
            break
    for suffix in _STEP_4:
        if w.endswith(suffix):
            before = w[: -len(suffix)]
            if len(before) >= r2 and (suffix != "ion" or before[-1:] in ("s", "t")):
                w = before
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def starts(stemmed: str) -> list[str]:
    """Beginnings of which every word (without an apostrophe) with this stem has one.

    A step cuts letters off or puts an e, i, l or le in the place of those at the
    end; what comes before stays.
    """
    kept = stemmed[:-2] if stemmed.endswith("le") else stemmed[:-1] if stemmed.endswith(("e", "i", "l")) else stemmed
    return [kept, *(w for w, s in _EXCEPTIONS.items() if s == stemmed and not w.startswith(kept))]


def _step_1b(w: str, r1: int) -> str:
    if w.endswith(("eed", "eedly")):
        cut = 3 if w.endswith("eed") else 5
        return w[:-cut] + "ee" if len(w) - cut >= r1 else w
    for suffix in ("ingly", "edly", "ing", "ed"):
        if w.endswith(suffix):
            before = w[: -len(suffix)]
            if not re.search(_VOWEL, before):
                return w
            if before.endswith(("at", "bl", "iz")):
                return before + "e"
            if re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)\Z", before):
                return before[:-1]
            return before + "e" if _SHORT.search(before) and len(before) <= r1 else before
    return w
