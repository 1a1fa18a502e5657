"""Snowball stemmers of English and Spanish, for terms of a-z and digits."""

from __future__ import annotations

import re
from functools import lru_cache

VOWEL = "aeiouy"


def regions(word: str, vowels: str) -> tuple[int, int]:
    """Starts of R1 and R2: after the first non-vowel that follows a vowel, and the same again."""
    starts, at = [], 0
    for _ in range(2):
        found = re.compile(f"[{vowels}][^{vowels}]").search(word, at)
        at = found.end() if found else len(word)
        starts.append(at)
    return starts[0], starts[1]


def longest(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


# Fixed values of the published English algorithm.
ENGLISH_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
ENGLISH_SAME = frozenset("sky news howe atlas cosmos bias andes".split())
ENGLISH_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": ""}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def short_end(word: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]\Z|\A[aeiouy][^aeiouy]\Z", word))


def english(word: str) -> str:
    if len(word) < 3 or word in ENGLISH_SAME:
        return word
    if word in ENGLISH_WHOLE:
        return ENGLISH_WHOLE[word]
    word = re.sub(r"(\A|[aeiouy])y", lambda m: m[1] + "Y", word)
    begun = re.match("gener|commun|arsen", word)
    r1, r2 = regions(word, VOWEL)
    if begun:
        r1 = begun.end()
        r2 = regions(word[r1:], VOWEL)[0] + r1
    end = longest(word, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        word = word[:-2]
    elif end in ("ied", "ies"):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif end == "s" and re.search("[aeiouy]", word[:-2]):
        word = word[:-1]
    if word in ENGLISH_1A:
        return word
    end = longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: len(word) - len(end)] + "ee"
    elif end and re.search("[aeiouy]", word[: -len(end)]):
        word = word[: -len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)\Z", word):
            word = word[:-1]
        elif r1 >= len(word) and short_end(word):
            word += "e"
    word = re.sub(r"(?<=[^aeiouy])(?<!\A)[yY]\Z", "i", word) if len(word) > 2 else word
    end = longest(word, STEP2)
    if end and len(word) - len(end) >= r1:
        before = word[: -len(end)]
        if not (end == "ogi" and not before.endswith("l") or end == "li" and not re.search(r"[cdeghkmnrt]\Z", before)):
            word = before + STEP2[end]
    end = longest(word, STEP3)
    if end and len(word) - len(end) >= r1 and (end != "ative" or len(word) - len(end) >= r2):
        word = word[: -len(end)] + STEP3[end]
    end = longest(word, STEP4)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[-4] in "st"):
        word = word[: -len(end)]
    if word.endswith("e") and (len(word) - 1 >= r2 or len(word) - 1 >= r1 and not short_end(word[:-1])):
        word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.lower()


# Fixed values of the published Spanish algorithm; the terms have no accents.
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
BEFORE_PRONOUN = ("iendo", "ando", "ar", "er", "ir", "yendo")
ES_1 = {
    "": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(),
    "ic": "adora ador acion adoras adores aciones ante antes ancia ancias".split(),
    "log": "logia logias".split(),
    "u": "ucion uciones".split(),
    "ente": "encia encias".split(),
}
ES_Y = "ya ye yan yen yeron yendo yo yo yas yes yais yamos".split()
ES_VERB_E = "en es eis emos".split()
ES_VERB = (
    "arian arias aran aras ariais aria areis ariamos aremos ara are erian erias eran eras eriais eria ereis eriamos eremos era ere irian irias iran iras"
    " iriais iria ireis iriamos iremos ira ire aba ada ida ia iera ad ed id ase iese aste iste an aban ian ieran asen iesen aron ieron ado ido ando"
    " iendo io ar er ir as abas adas idas ias ieras ases ieses is ais abais iais ierais aseis ieseis asteis isteis ados idos amos abamos iamos imos"
    " ieramos iesemos asemos aramos"
).split()


def spanish(word: str) -> str:
    vowels = "aeiou"
    r1, r2 = regions(word, vowels)
    if len(word) < 3:
        rv = len(word)
    elif word[1] not in vowels:
        rv = next((i + 1 for i in range(2, len(word)) if word[i] in vowels), len(word))
    elif word[0] in vowels:
        rv = next((i + 1 for i in range(2, len(word)) if word[i] not in vowels), len(word))
    else:
        rv = 3
    end = longest(word[rv:], PRONOUNS)
    if end and (verb := longest(word[rv : len(word) - len(end)], BEFORE_PRONOUN)):
        stop = len(word) - len(end)
        if verb != "yendo" or word[: stop - 5].endswith("u"):
            word = word[:stop]
    done = spanish_suffix(word, r1, r2)
    if done == word:
        end = longest(word[rv:], ES_Y)
        if end and word[: -len(end)].endswith("u"):
            done = word[: -len(end)]
        else:
            end = longest(word[rv:], [*ES_VERB_E, *ES_VERB])
            if end:
                done = word[: -len(end)]
                if end in ES_VERB_E and done.endswith("gu"):
                    done = done[:-1]
    word = done
    end = longest(word[rv:], ("os", "a", "o", "i", "e"))
    if end:
        word = word[: -len(end)]
        if end == "e" and word.endswith("gu") and len(word) - 1 >= rv:
            word = word[:-1]
    return word


def spanish_suffix(word: str, r1: int, r2: int) -> str:
    """The step of standard suffixes; the word itself if none applies."""
    kinds = {s: new for new, group in ES_1.items() for s in group} | {"amente": "amente", "mente": "mente", "idad": "idad", "idades": "idad", "iva": "iva", "ivo": "iva", "ivas": "iva", "ivos": "iva"}
    end = longest(word, kinds)
    if not end:
        return word
    kind, before = kinds[end], word[: -len(end)]
    drop = lambda w, *ends: next((w[: -len(e)] for e in ends if w.endswith(e) and len(w) - len(e) >= r2), w)
    if kind == "amente":
        if len(before) < r1:
            return word
        short = drop(before, "iv")
        return drop(short, "at") if short != before else drop(before, "os", "ic", "ad")
    if len(before) < r2:
        return word
    if kind == "ic":
        return drop(before, "ic")
    if kind in ("log", "u", "ente"):
        return before + kind
    if kind == "mente":
        return drop(before, "ante", "able", "ible")
    if kind == "idad":
        return drop(before, "abil", "ic", "iv")
    if kind == "iva":
        return drop(before, "at")
    return before


@lru_cache(100_000)
def stem(term: str, language: str) -> str:
    """The term's stem; the last ones are remembered, so a worker keeps them from batch to batch in bounded memory."""
    return spanish(term) if language == "spanish" else english(term) if language == "english" else term
