"""Text functions: terms, stop words, stems, Boolean match expressions."""

from __future__ import annotations

import re
import unicodedata
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .stemming import stem

# The stop words, without accents, of Spanish and of English.
SPANISH_STOPS = """
    a al algo algunas algunos ante antes como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era erais
    eran eras eres es esa esas ese eso esos esta estaba estado estais estamos estan estar estas este esto estos estoy fue fueron ha habeis
    habia habian habias hace hacemos hacen hacer haces hacia han has hasta hay la las le les lo los mas me mi mis mucho muchos muy no nos
    nosotros o otra otras otro otros para pero poco por porque que quien quienes se sea seais sean segun ser si sido siempre sin sobre sois
    solo somos son soy su sus tambien te tiene tienen todo todos tu tus un una unas uno unos vosotros vuestra vuestro y ya yo
"""
ENGLISH_STOPS = """
    a about above after again against all am an and any are as at be because been before being below between both but by can did do does
    doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its
    itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some
    such than that the their theirs them themselves then there these they this those through to too under until up very was we were what
    when where which while who whom why will with you your yours yourself yourselves
"""
STOPWORDS = frozenset(SPANISH_STOPS.split()) | frozenset(ENGLISH_STOPS.split())
LANGUAGES = ("none", "spanish", "english")


def folded(character: str) -> str:
    """The character's compatibility decomposition without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", character) if not unicodedata.combining(c))


def folding_tables() -> tuple[tuple[str, str], dict[str, str]]:
    """(from, to) for translate(): characters that fold to one other, then marks, which go; and those that fold to several.

    Beyond U+21FF only those that give letters a-z or digits matter, as terms are made of these.
    """
    pairs, marks, longer = {}, [], {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x20000)):
        c = chr(code)
        plain = folded(c)
        if plain == c or code >= 0x2200 and not TERM.search(plain):
            continue
        if not plain:
            marks.append(c)
        elif len(plain) == 1:
            pairs[c] = plain
        elif TERM.search(plain):
            longer[c] = plain
    return ("".join(pairs) + "".join(marks), "".join(pairs.values())), longer


def character_class(characters) -> str:
    """A regular expression for one of these characters, by ranges."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


TERM = re.compile("[a-z0-9]+")
FOLDS, LONGER = folding_tables()
BEYOND_ASCII = r"[^\x00-\x7F]"
FOLDS_TO_SEVERAL = r"(?![\x00-\x7F])" + character_class(LONGER)  # the long class is tried on characters beyond ASCII only


def normal_text(text: Column) -> Column:
    """Lower case without accents, compatibility forms (ligatures, full-width letters) as plain letters.

    Texts of ASCII alone, and texts without characters that fold to several, skip the work for these.
    """
    low = F.lower(text)
    several = F.create_map(*[F.lit(x) for pair in LONGER.items() for x in pair])
    spread = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(several, c), c)), "")
    return F.when(~low.rlike(BEYOND_ASCII), low).when(low.rlike(FOLDS_TO_SEVERAL), F.translate(spread, *FOLDS)).otherwise(F.translate(low, *FOLDS))


def terms(text: Column, language: str = "none") -> Column:
    """The text's terms in order: runs of letters a-z and digits; with a language, without stop words and stemmed.

    Null text has no terms.
    """
    if language not in LANGUAGES:
        raise ValueError(f"unknown language {language!r}")
    found = F.regexp_extract_all(normal_text(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    if language == "none":
        return found
    return stems(language)(F.filter(found, lambda t: ~t.isin(*sorted(STOPWORDS))))


def stems(language: str):
    """An Arrow UDF that stems arrays of terms; each distinct term of a batch is stemmed once, and texts never become Python objects."""

    @F.arrow_udf("array<string>")
    def stemmed(batch: pa.Array) -> pa.Array:
        ends = batch.offsets
        found = batch.values.slice(ends[0].as_py(), ends[-1].as_py() - ends[0].as_py()).dictionary_encode()
        kinds = pa.array([stem(t, language) for t in found.dictionary.to_pylist()], batch.type.value_type)
        return type(batch).from_arrays(pc.subtract(ends, ends[0]), kinds.take(found.indices))

    return stemmed


def heads(wanted, language: str) -> list[str]:
    """What every term begins with whose stem is wanted: a stem differs from its term's beginning in its last two letters at most, never in the first."""
    return sorted({re.escape(w if language == "none" else w[:-2] or w[:1]) for w in wanted})


def held(text: Column, wanted, language: str = "none") -> Column:
    """Those of the text's terms() that can be wanted, each once: all that a Boolean query over the wanted terms needs of a text."""
    if not wanted:
        return F.array().cast("array<string>")
    rest = "(?![a-z0-9])" if language == "none" else ""
    pattern = f"(?=(?:{'|'.join(heads(wanted, language))}){rest})(?<![a-z0-9])[a-z0-9]+"
    found = F.array_distinct(F.regexp_extract_all(normal_text(F.coalesce(text, F.lit(""))), F.lit(pattern), 0))
    if language == "none":
        return found
    return stems(language)(F.filter(found, lambda t: ~t.isin(*sorted(STOPWORDS))))


def plain_terms(text: str, language: str = "none") -> list[str]:
    """terms() of a literal, on the driver."""
    found = TERM.findall(folded(text.lower()))
    return found if language == "none" else [stem(t, language) for t in found if t not in STOPWORDS]


OPERAND = re.compile(r"[()]|[^\s()]+")


def match(tokens: str, query: str, language: str = "none") -> Column:
    """Whether a document's terms (the array column `tokens`) satisfy a Boolean query: AND, OR, NOT, parentheses, words side by side.

    NOT binds more than AND, AND more than OR, and words side by side are joined by AND, so the query is a SQL
    condition once its words are membership tests; Spark parses it. A word of several terms needs them all; one that
    is only stop words matches nothing. A malformed query is a ValueError.
    """
    parts, operand = [], False
    for token in OPERAND.findall(query):
        word = token.upper()
        opens = word not in ("AND", "OR", ")")
        if not opens and not operand:
            raise ValueError(f"{token} has no operand before it in {query!r}")
        if opens and operand:
            parts.append("AND")
        if word in ("AND", "OR", "NOT", "(", ")"):
            parts.append(word)
            operand = word == ")"
        else:
            needed = [f"array_contains(`{tokens}`, '{t}')" for t in plain_terms(token, language)]
            parts.append(f"({' AND '.join(needed)})" if needed else "(false)")
            operand = True
    depths = list(accumulate((p == "(") - (p == ")") for p in parts))
    if not operand or min(depths) < 0 or depths[-1]:
        raise ValueError(f"the match query {query!r} is empty, ends too early or has an odd parenthesis")
    return F.expr(" ".join(parts))


def query_words(query: str, language: str = "none") -> list[str]:
    """The terms of a ranked query, which may join words by AND only."""
    tokens = OPERAND.findall(query)
    if any(t.upper() in ("OR", "NOT") or t in "()" for t in tokens):
        raise ValueError("a ranked query joins words by AND only")
    found = [t for token in tokens if token.upper() != "AND" for t in plain_terms(token, language)]
    if not tokens:
        raise ValueError("the match query is empty")
    return found


def query_operands(query: str, language: str = "none") -> list[str]:
    """The distinct terms of a Boolean query, sorted."""
    return sorted({t for token in OPERAND.findall(query) if token.upper() not in ("AND", "OR", "NOT", "(", ")") for t in plain_terms(token, language)})
