import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            bad = {
                "email": lambda: False,
                "ip": lambda: any(int(p) > 255 for p in m[0].split(".")),
                "card": lambda: not (13 <= len(d) <= 19 and luhn(d)),
                "phone": lambda: not 9 <= len(d) <= 15,
            }
            if not bad[kind]():
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.-+ ()0123456789%é\n", max_size=60))
def test_base_spans_match_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


@pytest.fixture(scope="module")
def field():
    out = pii.SemiMarkovField()
    out.weights.update(pii.fit(["plain words stand here in lines", "mail a.b@c.de or 1.2.3.4 and +1 (555) 123-4567 today"]))
    return out


def added(field, text):
    return [(k, text[a:b]) for k, a, b in pii.added_spans(field, text, pii.base_spans(text))]


def test_field_finds_other_forms(field):
    assert added(field, "please call (743) 555-3824 today") == [("phone", "(743) 555-3824")]
    assert added(field, "the card 4785.3805.9239.1139 was used") == [("card", "4785.3805.9239.1139")]
    assert added(field, "mail jane [at] corp.com now") == [("email", "jane [at] corp.com")]


@pytest.mark.parametrize("text", ["on 2024-03-05 version 3.0 came", "licensed under version 2.0.", "room 12 at 14:30", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "no digits at all"])
def test_field_leaves_clean_text(field, text):
    assert added(field, text) == []


def test_best_segmentation_is_the_best_of_all(field):
    rng = random.Random(1)
    for _ in range(15):
        text, _ = pii.example(rng, ["the", "of", "word"])
        tokens = pii.tokens_of(text, 0, len(text))[:7]
        ending = field.labelled(field.segments(text, tokens))

        def every(stop):
            if stop == 0:
                yield [], 0.0, "^"
            for length, label, _, score in ending[stop] if stop else ():
                for spans, value, prev in every(stop - length):
                    own = score + field.weights.get(f"{prev}>{label}", 0.0)
                    yield spans + ([(label, stop - length, stop)] if label != "O" else []), value + own, label

        want = max(every(len(tokens)), key=lambda x: x[1])[0]
        assert field.best(text, tokens, {}) == want


def test_query_rows(spark):
    long = "word " * 50_000 + "x@y.zz"
    rows = [(1, "a@b.cc 1.2.3.4"), (2, None), (3, ""), (4, long), (None, "+1 (555) 123-4567"), (5, "a@b.cc"), (5, "a@b.cc"), (6, "é 10.0.0.1")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, n_ip int")
    got = pii.find_personal_data(df, pii.fit([])).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        base = brute(t or "")
        r = by[i]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == x for x, _, _ in base) for k in PATTERNS)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert r["n_added"] or r["spans"] == line
    assert by[6]["spans"] == "ip:2:10"
    assert pii.find_personal_data(df.limit(0), {}).count() == 0
    assert pii.fit_on(df) and isinstance(pii.fit_on(df.limit(0)), dict)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab7.@-+ ()0²\n[]", max_size=40).map(lambda t: t + " at dot 12 at x dot"))
def test_spans_built_token_by_token_are_those_of_the_plain_definition(text):
    tokens = pii.tokens_of(text, 0, len(text))
    region = pii.Region(text, tokens)
    for i in range(len(tokens)):
        most = min(pii.LONGEST, len(tokens) - i)
        got = dict(region.spans(i, most))
        want = [n for n in range(1, most + 1) if pii.may_be_span(text, tokens[i][0], tokens[i + n - 1][1])]
        assert got == {n: pii.span_at(text, tokens[i][0], tokens[i + n - 1][1]) for n in want}


@pytest.mark.parametrize(
    "text",
    ["7" * 1_000_000, "1.2." * 100_000, "a@" * 40_000, "+1 " * 30_000, "+1(((" * 30_000, "word " * 200_000, "1 " * 20_000, "10.0.0.1 x@y.zz " * 10_000, "12,345.67 " * 3_000],
    ids=["digits", "numbers and dots", "at signs", "plus signs", "brackets", "one word", "single digits", "base spans", "number table"],
)
def test_long_texts_take_linear_time(field, text):
    began = time.time()
    pii.added_spans(field, text, pii.base_spans(text))
    assert time.time() - began < 40
