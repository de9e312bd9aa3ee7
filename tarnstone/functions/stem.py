"""English analysis after Porter's published suffix-stripping rules (1980)."""

from __future__ import annotations

import functools
import re

#: Words that carry no meaning for matching, fixed values.
STOP_WORDS = frozenset(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing "
    "don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just "
    "me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that "
    "the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while "
    "who whom why will with you your yours yourself yourselves".split()
)
#: Suffix and replacement by step, longest suffixes first; fixed values.
STEP2 = "ational ate,ization ize,iveness ive,fulness ful,ousness ous,tional tion,biliti ble,entli ent,ousli ous,ation ate,alism al,aliti al,iviti ive,enci ence,anci ance,izer ize,abli able,alli al,ator ate,logi log,eli e".split(",")
STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ness ,ful ".split(",")
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic ou".split()


def _measure(stem: str) -> int:
    """How many vowel-consonant sequences the stem has; y counts as a vowel behind a consonant."""
    shape = ""
    for i, c in enumerate(stem):
        vowel = c in "aeiou" or c == "y" and i > 0 and shape[-1] == "c"
        shape += "v" if vowel else "c"
    return len(re.findall("v+c+", shape))


def _has_vowel(stem: str) -> bool:
    return any(c in "aeiou" or c == "y" and i > 0 for i, c in enumerate(stem))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return len(stem) > 2 and stem[-3] not in "aeiou" and stem[-2] in "aeiouy" and stem[-1] not in "aeiouwxy"


def _replace(word: str, rules: list[str]) -> str:
    for rule in rules:
        old, _, new = rule.partition(" ")
        if word.endswith(old):
            stem = word[: -len(old)]
            return stem + new if _measure(stem) > 0 else word
    return word


@functools.lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    for old, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(old):
            word = word[: -len(old)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for old in ("ed", "ing"):
            if word.endswith(old) and _has_vowel(word[: -len(old)]):
                word = word[: -len(old)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "lsz" and word[-1] not in "aeiou":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP2), STEP3)
    for old in STEP4:
        if word.endswith(old):
            if _measure(word[: -len(old)]) > 1:
                word = word[: -len(old)]
            break
    else:
        if word.endswith(("sion", "tion")) and _measure(word[:-3]) > 1:
            word = word[:-3]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


_WORD = re.compile(r"[^\W_]+")


def analyze(text: str, language: str = "english") -> list[tuple[str, int]]:
    """(lexeme, position from 1) of a text; stop words take a position but give no lexeme."""
    words = _WORD.findall(text.lower())
    if language == "simple":
        return [(w, i) for i, w in enumerate(words, 1)]
    return [(stem(w), i) for i, w in enumerate(words, 1) if w not in STOP_WORDS]
