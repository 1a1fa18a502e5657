"""Personal data: base patterns, and a semi-Markov conditional random field for spans beyond them."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, ship

KINDS = ("email", "ip", "card", "phone")
FIT_DOCS = 400
"""Bound of the sample of texts that the field is fitted on."""
FIT_REGIONS = 600
LONGEST, MOST_DIGITS = 14, 24
"""Bounds of a span that the field adds: its tokens, and its digits (a card has 19 at most)."""
REACH = 32
"""Characters around a digit or an @ that the field reads."""

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @ to the left and right, so that long runs cost no retries."""
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (found := DOMAIN.match(text, at + 1)):
            yield start, found.end()
            low = found.end()
        at = text.find("@", max(at + 1, low))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind as listed, then start."""
    spans = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGITS.search(text):
        spans += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        if "+" in text:
            spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return spans


TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
OUTSIDE = "O"
ROWS = 200_000


def tokens_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text, start, end)]


SHAPES = re.compile(r"[0-9]+|[^\W\d_]+|\s+")


def shape(span: str) -> str:
    """The span with digit runs as their lengths, letter runs as a and white space as one blank."""
    return SHAPES.sub(lambda m: str(len(m[0])) if m[0][0].isdigit() else "_" if m[0].isspace() else m[0] if m[0].lower() in ("at", "dot") else "a", span)


CUES = frozenset("tel telephone phone mobile fax call mail email contact card visa ip host".split())


def context(text: str, start: int) -> str:
    cue = re.search(r"([^\W\d_]+)\W*\Z", text[max(0, start - 12) : start])
    return f"cue={cue[1].lower()}" if cue and cue[1].lower() in CUES else ""


Span = tuple[str, int, int, bool, str, str, str, bool | None]
"""What features see of a span: its shape, digits, numbers, whether all could be octets, the characters beside it, the cue, and Luhn's test of 13 to 19 digits."""


def seen(text: str, start: int, end: int, drawn: str, digits: int, numbers: int, octets: bool, cue: str) -> Span:
    checked = luhn("".join(c for c in text[start:end] if c in "0123456789")) if 13 <= digits <= 19 else None
    return drawn, digits, numbers, octets, text[start - 1 : start], text[end : end + 1], cue, checked


def span_at(text: str, start: int, end: int) -> Span:
    span = text[start:end]
    numbers = re.findall("[0-9]+", span)
    octets = all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    return seen(text, start, end, shape(span), sum(c.isdigit() for c in span), len(numbers), octets, context(text, start))


@lru_cache(maxsize=100_000)
def features(span: Span) -> tuple[str, ...]:
    """Features of the span as a whole, of its edges, and of the word before it."""
    drawn, digits, numbers, octets, before, after, cue, checked = span
    names = [
        "bias",
        f"shape={drawn}" if len(drawn) <= 40 else "shape=long",
        f"kinds={re.sub('[0-9]+', '9', drawn)[:40]}",
        f"digits={min(digits, 20)}",
        f"edges={before.isalnum()}{after.isalnum()}",
        f"joined={before in '.-/:_@%#=' and before != ''}{after in '-/:_@%#=' and after != ''}",
    ]
    if cue:
        names.append(cue)
    if digits:
        names.append(f"octets={octets}{min(numbers, 6)}")
        if checked is not None:
            names.append(f"luhn={checked}")
    return tuple(names)


def may_be_span(text: str, start: int, end: int) -> bool:
    """A span has a digit, an @ or one written out, is on one line, and starts and ends with a letter, a digit, + or a bracket."""
    span = text[start:end]
    return (
        "\n" not in span
        and (DIGITS.search(span) is not None or "@" in span or WRITTEN_OUT.search(span) is not None)
        and (span[0].isalnum() or span[0] in "+(")
        and (span[-1].isalnum() or span[-1] == ")")
        and sum(c.isdigit() for c in span) <= MOST_DIGITS
    )


class Region:
    """The tokens of a stretch of text, and the features of all spans that may start at one of them, built token by token."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.text, self.tokens = text, tokens
        self.words = [text[a:b] for a, b in tokens]
        self.drawn = [shape(w) for w in self.words]
        self.digits = [sum(map(str.isdigit, w)) for w in self.words]
        self.number = ["0" <= w[0] <= "9" for w in self.words]
        self.small = [not n or len(w) <= 3 and int(w) <= 255 for n, w in zip(self.number, self.words)]
        self.ends = [w[-1].isalnum() or w == ")" for w in self.words]

    def spans(self, i: int, most: int) -> Iterator[tuple[int, Span]]:
        """(length, span) of the spans of at most `most` tokens that may start at token i, as span_at() gives them."""
        text, (start, _) = self.text, self.tokens[i]
        if not (self.words[i][0].isalnum() or self.words[i][0] in "+("):
            return
        cue, drawn, digits, numbers, octets, marked, written, last = None, "", 0, 0, True, False, False, start
        for j in range(i, i + most):
            a, end = self.tokens[j]
            if a > last:
                if "\n" in text[last:a]:
                    return
                drawn += "_"
            last = end
            drawn, digits = drawn + self.drawn[j], digits + self.digits[j]
            if digits > MOST_DIGITS:
                return
            numbers, octets = numbers + self.number[j], octets and self.small[j]
            marked, written = marked or self.number[j] or self.words[j] == "@", written or self.words[j] in ("at", "dot")
            if self.ends[j] and (marked or written and WRITTEN_OUT.search(text[start:end])):
                cue = context(text, start) if cue is None else cue
                yield j - i + 1, seen(text, start, end, drawn, digits, numbers, octets, cue)


class SemiMarkovField:
    """Segments of a region's tokens, each outside (one token) or a span of at most LONGEST tokens of one kind.

    The score of a segmentation is the sum of its segments' feature weights and of weights for neighbouring
    labels. Fitting raises the log likelihood of marked segmentations; decoding finds the best one. Both are
    dynamic programmes over (token, label) that try the bounded span lengths.
    """

    labels = (OUTSIDE, *KINDS)

    def __init__(self):
        self.weights: dict[str, float] = defaultdict(float)
        self.rows: dict[Span, tuple[float, ...]] = {}

    def segments(self, text: str, tokens: list[tuple[int, int]], fixed: dict[int, tuple[str, int]] = {}) -> list[list[tuple[int, str, Span | str]]]:  # noqa: B006
        """For every token the (length, label, span) of segments that may end before the next; fixed spans allow no other.

        The label of a span that may be of any kind is left empty; a token outside has its shape alone.
        """
        region, n, ending = Region(text, tokens), len(tokens), [[] for _ in range(len(tokens) + 1)]
        free, room = [True] * n, [0] * (n + 1)
        for i, (kind, length) in fixed.items():
            ending[i + length].append((length, kind, span_at(text, tokens[i][0], tokens[i + length - 1][1])))
            free[i : i + length] = [False] * length
        for i in range(n - 1, -1, -1):
            room[i] = min(LONGEST, room[i + 1] + 1) if free[i] else 0
        for i in range(n):
            if free[i]:
                ending[i + 1].append((1, OUTSIDE, region.drawn[i] if tokens[i][1] - tokens[i][0] <= 12 else "long"))
                for length, span in region.spans(i, room[i]):
                    ending[i + length].append((length, "", span))
        return ending

    def scores(self, span: Span) -> tuple[float, ...]:
        """The weights of the span's features, summed for each of KINDS."""
        row = self.rows.get(span)
        if row is None:
            names = features(span)
            row = tuple(sum(self.weights.get(f"{kind}|{name}", 0.0) for name in names) for kind in KINDS)
            if len(self.rows) < ROWS:
                self.rows[span] = row
        return row

    def labelled(self, ending: list) -> list[list[tuple[int, str, Span | str, float]]]:
        """The segments with one label each, and their scores."""
        out = []
        for segments in ending:
            own = []
            for length, label, span in segments:
                if label == OUTSIDE:
                    own.append((length, label, span, self.weights.get(f"{OUTSIDE}|{span}", 0.0)))
                else:
                    own += [(length, kind, span, score) for kind, score in zip(KINDS, self.scores(span)) if label in ("", kind)]
            out.append(own)
        return out

    def best(self, text: str, tokens: list[tuple[int, int]], fixed: dict[int, tuple[str, int]]) -> list[tuple[str, int, int]]:
        """The best segmentation's spans, as (label, first token, end)."""
        ending = self.labelled(self.segments(text, tokens, fixed))
        every = ("^", *self.labels)
        hops = {label: [(prev, self.weights.get(f"{prev}>{label}", 0.0)) for prev in every] for label in self.labels}
        top: list[dict[str, tuple]] = [{"^": (0.0, None)}] + [{} for _ in tokens]
        entered: list[dict[str, tuple]] = [{} for _ in range(len(tokens) + 1)]  # best way into each label from here
        for stop in range(1, len(tokens) + 1):
            here = top[stop]
            for length, label, _, own in ending[stop]:
                before = top[stop - length]
                if not before:
                    continue
                into = entered[stop - length]
                if label not in into:
                    into[label] = max((before[prev][0] + hop, prev) for prev, hop in hops[label] if prev in before)
                value, back = into[label]
                if label not in here or value + own > here[label][0]:
                    here[label] = (value + own, (stop - length, back))
        found, stop = [], len(tokens)
        if not stop or not top[stop]:
            return []
        label = max(top[stop], key=lambda x: top[stop][x][0])
        while stop:
            start, back = top[stop][label][1]
            if label != OUTSIDE:
                found.append((label, start, stop))
            stop, label = start, back
        return found[::-1]

    def learn(self, text: str, tokens, gold: list[tuple[str, int, int]], rate: float) -> None:
        """One step up the gradient of the log likelihood: features of the marked segments less those expected."""
        self.rows.clear()
        n, known = len(tokens), self.labelled(self.segments(text, tokens))
        ending = [[(length, label) for length, label, _, _ in part] for part in known]
        scores = [[score for _, _, _, score in part] for part in known]
        spans = {(stop, length): span for stop, part in enumerate(known) for length, label, span, _ in part if label != OUTSIDE}

        def names_of(stop: int, length: int, label: str) -> list[str]:
            a, b = tokens[stop - length][0], tokens[stop - 1][1]
            if label == OUTSIDE:
                return [f"{OUTSIDE}|{shape(text[a:b]) if b - a <= 12 else 'long'}"]
            return [f"{label}|{name}" for name in features(spans.get((stop, length)) or span_at(text, a, b))]

        hop = lambda a, b: self.weights.get(f"{a}>{b}", 0.0)
        ahead: list[dict[str, float]] = [{"^": 0.0}] + [{} for _ in range(n)]
        for stop in range(1, n + 1):
            parts = defaultdict(list)
            for (length, label), s in zip(ending[stop], scores[stop]):
                if ahead[stop - length]:
                    parts[label].append(s + log_sum([v + hop(p, label) for p, v in ahead[stop - length].items()]))
            ahead[stop] = {label: log_sum(v) for label, v in parts.items()}
        behind: list[dict[str, float]] = [defaultdict(lambda: float("-inf")) for _ in range(n)] + [{label: 0.0 for label in self.labels}]
        starting = [[] for _ in range(n)]
        for stop in range(1, n + 1):
            for (length, label), s in zip(ending[stop], scores[stop]):
                starting[stop - length].append((stop, label, s))
        for start in range(n - 1, -1, -1):
            for prev in ahead[start]:
                behind[start][prev] = log_sum([hop(prev, label) + s + behind[stop][label] for stop, label, s in starting[start] if label in behind[stop]])
        total = log_sum(list(ahead[n].values()))
        step: dict[str, float] = defaultdict(float)
        for stop in range(1, n + 1):
            for (length, label), s in zip(ending[stop], scores[stop]):
                start, expected = stop - length, 0.0
                for prev, v in ahead[start].items():
                    share = exp(min(0.0, v + hop(prev, label) + s + behind[stop].get(label, float("-inf")) - total))
                    expected += share
                    if share > 1e-4:
                        step[f"{prev}>{label}"] -= rate * share
                if expected > 1e-4:
                    for name in names_of(stop, length, label):
                        step[name] -= rate * expected
        inside, at, prev = {a: (b, k) for k, a, b in gold}, 0, "^"
        while at < n:
            stop, label = inside.get(at, (at + 1, OUTSIDE))
            for name in names_of(stop, stop - at, label):
                step[name] += rate
            step[f"{prev}>{label}"] += rate
            at, prev = stop, label
        for name, change in step.items():
            self.weights[name] += change


def log_sum(values: list[float]) -> float:
    top = max(values, default=float("-inf"))
    return top if top == float("-inf") else top + log(sum(exp(v - top) for v in values))


WRITTEN_OUT = re.compile(r"[\[({]at[\])}]|\bdot\b")
TRIGGER = re.compile(r"[0-9](?:[0-9 .()+-]*[0-9])?|@|" + WRITTEN_OUT.pattern)


def regions(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Stretches of text around digits and written-out or plain @ that no base span holds, each to a word's edge."""
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts, held = [a for a, _ in taken], None
    for m in TRIGGER.finditer(text):
        at = bisect_right(starts, m.start()) - 1
        if at >= 0 and m.end() <= taken[at][1]:
            continue
        if held and m.start() - REACH <= held[1]:
            held = (held[0], m.end() + REACH)
        else:
            if held:
                yield widened(text, *held)
            held = (m.start() - REACH, m.end() + REACH)
    if held:
        yield widened(text, *held)


def widened(text: str, low: int, high: int) -> tuple[int, int]:
    low, high = max(0, low), min(len(text), high)
    for _ in range(REACH):
        if low == 0 or text[low - 1].isspace():
            break
        low -= 1
    for _ in range(REACH):
        if high == len(text) or text[high].isspace():
            break
        high += 1
    return low, high


def place_on_tokens(tokens: list[tuple[int, int]], spans) -> dict[int, tuple[str, int]]:
    """Spans that start and end with tokens, as first token -> (kind, number of tokens); overlaps keep the first."""
    first, last, fixed, used = {a: i for i, (a, _) in enumerate(tokens)}, {b: i for i, (_, b) in enumerate(tokens)}, {}, set()
    for kind, a, b in spans:
        if a in first and b in last and not used & set(own := range(first[a], last[b] + 1)):
            fixed[first[a]] = (kind, len(own))
            used.update(own)
    return fixed


def example(rng: random.Random, words: list[str]) -> tuple[str, list[tuple[str, int, int]]]:
    """A made-up stretch of prose with one written form of personal data or a look-alike that is none."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: rng.choice(words)
    plain = lambda: re.sub(r"[^\w]|[\d_]", "", word()) or "x"
    card = d(15)
    card += next(c for c in "0123456789" if luhn(card + c))
    octets = ".".join(str(rng.randrange(256)) for _ in range(4))
    made = rng.choice([
        ("email", f"{plain()}.{d(2)}@mail{d(1)}.example.com"), ("email", f"{plain()} at {plain()} dot com"), ("email", f"{plain()}{d(1)} [at] {plain()}.com"),
        ("email", f"{plain()}.{d(2)} (at) {plain()} (dot) org"), ("email", f"{plain()} @ {plain()}.org"), ("ip", octets), ("ip", octets),
        ("card", card), ("card", " ".join(card[i : i + 4] for i in range(0, 16, 4))), ("card", ".".join(card[i : i + 4] for i in range(0, 16, 4))),
        ("phone", f"+1 ({d(3)}) {d(3)}-{d(4)}"), ("phone", f"({d(3)}) {d(3)}-{d(4)}"), ("phone", f"{d(3)}-{d(3)}-{d(4)}"), ("phone", f"+{d(2)} {d(3)} {d(7)}"),
        ("phone", f"+{d(2)}/{d(3)}/{d(7)}"),
        ("", f"{d(4)}-{d(2)}-{d(2)}"), ("", f"{d(2)}:{d(2)}"), ("", f"{d(1)}.{d(1)}"), ("", f"{d(1)}.{d(2)}.{d(1)}"), ("", d(rng.randrange(1, 13))), ("", f"{d(16)}{d(4)}"),
        ("", f"{word()}{d(2)} {word()}"), ("", f"{d(3)},{d(3)}"), ("", f"{d(5)}-{d(4)}"), ("", f"§{d(2)}({d(1)})"), ("", f"{d(2)}/{d(2)}/{d(4)}"), ("", f"{d(3)} {d(3)}"),
        ("", f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"'), ("", f"@{plain()}"), ("", f"{d(3)}.{d(3)}.{d(3)},{d(2)}"), ("", f"{plain()} at {d(2)}"),
    ])
    cue = rng.choice(["", "", "", "call ", "mail: ", "tel. ", "IP ", "card "]) if made[0] else ""
    left = " ".join(word() for _ in range(rng.randrange(1, 4))) + " " + cue
    text = left + made[1] + rng.choice([" ", ". ", ", ", " and "]) + " ".join(word() for _ in range(rng.randrange(1, 4)))
    return text, [(made[0], len(left), len(left) + len(made[1]))] if made[0] else []


def fit(texts: list[str], rounds: int = 3, seed: int = 5) -> dict[str, float]:
    """Weights fitted on at most FIT_REGIONS regions: those of the sample with its base spans, and made-up ones with
    its words, in which the same data also stands in forms that the base patterns miss."""
    rng, field = random.Random(seed), SemiMarkovField()
    words = sorted({w for t in texts for w in t.split() if w.isalpha()})[:5000] or ["the", "of", "and", "in"]
    marked = [example(rng, words) for _ in range(FIT_REGIONS * 3 // 4)]
    for text in texts:
        spans = base_spans(text)
        for a, b in regions(text, []):
            if len(marked) < FIT_REGIONS and b - a < 400:
                marked.append((text[a:b], [(k, s - a, e - a) for k, s, e in spans if a <= s and e <= b]))
    for number in range(rounds):
        rng.shuffle(marked)
        for text, spans in marked:
            tokens = tokens_of(text, 0, len(text))
            gold = [(kind, at, at + n) for at, (kind, n) in place_on_tokens(tokens, spans).items()]
            if len(gold) == len(spans) and tokens:
                field.learn(text, tokens, gold, 0.3 / (1 + number))
    return {k: v for k, v in field.weights.items() if abs(v) > 1e-3}


def added_spans(field: SemiMarkovField, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the field's best segmentations in which the base spans are held fixed."""
    found, free_from = [], 0
    ordered = sorted(base, key=lambda s: s[1])
    starts, reached = [a for _, a, _ in ordered], list(accumulate((b for _, _, b in ordered), max))
    for low, high in regions(text, base):
        tokens = tokens_of(text, low, high)
        inside = [s for s in ordered[bisect_left(starts, low) : bisect_left(starts, high)] if s[2] <= high]
        fixed = place_on_tokens(tokens, sorted(inside, key=lambda s: KINDS.index(s[0])))
        for kind, a, b in field.best(text, tokens, fixed):
            start, end = tokens[a][0], tokens[b - 1][1]
            # No base span reaches into it: those that start before its end end before its start.
            before = bisect_left(starts, end)
            if start >= free_from and (before == 0 or reached[before - 1] <= start):
                found.append((kind, start, end))
                free_from = end
    return found


OUT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_personal_data(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row per row of docs (doc_id, text): the counts and digest of the base spans, and all spans.

    spans has kind:start:end by kind as listed, then start; n_added of them are the field's. Offsets are code
    points of the whole text. Null text is empty; null ids and repeated rows get rows of their own; other columns
    are ignored. A text without spans has the digest of the empty string. An empty table gives no rows. Very long texts
    are read whole: the patterns and the field take time in proportion to the text's length.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # bounded by the fitting sample

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = SemiMarkovField()
        field.weights.update(shared.value)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                more = added_spans(field, text, base) if TRIGGER.search(text) else []
                line = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                every = sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))
                rows.append((*counts, hashlib.sha256(line(base).encode()).hexdigest(), line(every), len(more)))
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            columns = [batch.column("doc_id")] + [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(c.split()[0] for c in OUT.split(", "))])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return slim.mapInArrow(scan, f"doc_id long, {OUT}")


def fit_on(docs: DataFrame, max_docs: int = FIT_DOCS) -> dict[str, float]:
    """Fit on a bounded sample of docs that hold a digit or an @, drawn by a hash of their ids."""
    with_trigger = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]"))
    return fit([r["text"] for r in bounded_sample(with_trigger, max_docs, "doc_id")])
