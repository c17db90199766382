"""English words to stems, for full-text search: the published Porter2 ("English") algorithm and a stop list."""

from __future__ import annotations

import re

# Words that an English full-text search leaves out.
STOP_WORDS = frozenset((
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when where why how all any "
    "both each few more most other some such no nor not only own same so than too very s t can will just don should now").split())

# Fixed values of the published algorithm: words with stems of their own, words kept after the plural step, and
# beginnings that set where the first region ends.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
             "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
             "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_EARLY = re.compile("gener|commun|arsen")
_REGION = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")

# Fixed values of the published algorithm: endings and what replaces them; "ogi" and "li" have a condition of their own.
STEP_2 = {"ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble",
          "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful",
          "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": ""}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _regions(w: str) -> tuple[int, int]:
    """Where the two regions begin: after the first consonant that follows a vowel, and the same again from there."""
    m = _EARLY.match(w)
    r1 = m.end() if m else (x.end() if (x := _REGION.search(w)) else len(w))
    return r1, (x.end() if (x := _REGION.search(w, r1)) else len(w))


def _ending(w: str, endings) -> str | None:
    return next((e for e in sorted(endings, key=len, reverse=True) if w.endswith(e)), None)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of other letters than a-z, and of one or two letters, are their own."""
    if len(word) < 3 or not re.fullmatch("[a-z']+", word):
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    w = word.lstrip("'") if word.startswith("'") else word
    # a y that sounds as a consonant is written Y
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    w = re.sub("'s'$|'s$|'$", "", w)

    # plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w

    # past and progressive forms
    e = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: len(w) - len(e)] + "ee"
    elif e and _VOWEL.search(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif _SHORT_END.search(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    # endings built on others
    e = _ending(w, STEP_2)
    if e and len(w) - len(e) >= r1:
        before = w[-len(e) - 1: -len(e)]
        if (e != "ogi" or before == "l") and (e != "li" or before in tuple("cdeghkmnrt")):
            w = w[: -len(e)] + STEP_2[e]
    e = _ending(w, STEP_3)
    if e and len(w) - len(e) >= r1 and (e != "ative" or len(w) - len(e) >= r2):
        w = w[: -len(e)] + STEP_3[e]
    e = _ending(w, STEP_4)
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]

    # final e and l
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
