"""Main text of web pages by a recurrent block labeller."""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, ship

FIT_PAGES = 120
"""Bound of the sample of pages that the labeller is fitted on."""
MADE_PAGES = 400
PATH, WORDS, HIDDEN = 96, 48, 24
NUMBERS = 6
STEPS = 40_000
"""Blocks (padding included) that are labelled at once."""
WINDOW = 200
"""Longer pages are fitted in windows of so many blocks, so that a step's memory is bounded."""

BLOCK = frozenset(
    "html head body title div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main aside header"
    " footer nav form fieldset legend label button select option textarea blockquote pre figure figcaption address hr details summary dialog"
    " iframe noscript template".split()
)
CLOSES_P = BLOCK - {"html", "head", "body", "label", "button", "select", "option", "textarea", "iframe", "noscript", "template"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style".split())
RAW = frozenset("script style textarea title".split())
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}
SAME = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "tr": ("tr td th", ("table",)), "option": ("option", ("select",))}
NAME = re.compile(r"/?[A-Za-z][^\s/><]*")
STOP = re.compile("[<>\"']")
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")


class Element:
    """An open element: its step of the tag path, with what the path down to it adds up to. Paths share their beginnings."""

    __slots__ = ("parent", "name", "step", "counts", "state")

    def __init__(self, parent: Element | None, name: str, step: str):
        self.parent, self.name, self.step = parent, name, step
        self.counts = None
        self.state = parent.state if parent else OPEN
        if self.state != BESIDE:
            words = set(step.split())
            if self.state == OPEN and words & MAIN:
                self.state = WITHIN
            elif words & ASIDE:
                self.state = BESIDE

    def __iter__(self) -> Iterator[str]:
        """The path's steps, from the page down."""
        steps, at = [], self
        while at is not None:
            steps.append(at.step)
            at = at.parent
        return reversed(steps)

    def slots(self) -> np.ndarray:
        """How often the path's words fall in each slot, counted up to 2."""
        chain, at = [], self
        while at is not None and at.counts is None:
            chain.append(at)
            at = at.parent
        counts = at.counts if at is not None else np.zeros(PATH, np.uint8)
        for element in reversed(chain):
            counts = element.counts = np.minimum(counts + step_slots(element.step, ""), 2)
        return counts


OPEN, WITHIN, BESIDE = range(3)
"""Of a path: no article so far; in one; in something that says it is beside it."""


class Tags:
    """A page's markup, read once from left to right: every search that can fail is made once for the whole page."""

    def __init__(self, page: str):
        self.page, self.last, self.missing = page, page.rfind(">"), set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        if (found := self.page.find(what, at)) < 0:
            self.missing.add(what)
        return found

    def end(self, at: int) -> int:
        """The place of the > that ends a tag whose name ends at `at`, or -1; quoted values may hold it.

        A quote that is never closed is an ordinary character, and < outside quotes says that this is no tag.
        """
        while m := STOP.search(self.page, at):
            c, at = m[0], m.end()
            if c == ">":
                return at - 1
            if c == "<":
                return -1
            if (closed := self.find(c, at)) >= 0:
                at = closed + 1
        return -1

    def parts(self) -> Iterator[tuple[str, str, str]]:
        """(kind, name or text, attributes), kind one of text, raw (text as it is), open, close and inside (of a raw element)."""
        page, at = self.page, 0
        while at < len(page):
            start = page.find("<", at)
            if start != at:
                stop = start if start >= 0 else len(page)
                yield "text", page[at:stop], ""
                at = stop
                continue
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                at = stop + 3 if stop >= 0 else len(page)
                continue
            if page.startswith("<![CDATA[", at) and (stop := self.find("]]>", at)) >= 0:
                yield "raw", page[at + 9 : stop], ""
                at = stop + 3
                continue
            if page.startswith(("<!", "<?"), at) and at < self.last:
                at = page.find(">", at) + 1
                continue
            m = NAME.match(page, at + 1) if at < self.last else None
            stop = self.end(m.end()) if m else -1
            if stop < 0:
                yield "text", "<", ""
                at += 1
                continue
            name, attributes, at = m[0].lower(), page[m.end() : stop], stop + 1
            if name[0] == "/":
                yield "close", name[1:], ""
                continue
            yield "open", name, attributes
            if name in RAW:
                ended = RAW_END[name].search(page, at)
                yield "inside", page[at : ended.start() if ended else len(page)], ""
                at = ended.end() if ended else len(page)


def blocks(page: str) -> list[tuple[Element | tuple, str, int]]:
    """(tag path, text, characters in links) of every leaf block with text, in page order.

    A block ends where an element that makes a block of its own starts or ends; br is white space in it. Elements
    left open end with the one around them, a paragraph at the next block. Scripts, styles and comments are no text.
    Time and memory are linear in the page's length, whatever its markup is like.
    """
    stack: list[Element] = []
    places: dict[str, list[int]] = {}
    found: list[tuple[Element | tuple, str, int]] = []
    held: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                found.append((stack[-1] if stack else (), text, linked))
            held.clear()
        linked = 0

    def push(name: str, attributes: str) -> None:
        places.setdefault(name, []).append(len(stack))
        stack.append(Element(stack[-1] if stack else None, name, named(name, attributes)))

    def close(names, within=()) -> None:
        """End the innermost of these elements, unless one of `within` is inside it."""
        last = lambda kinds: max((places[k][-1] for k in kinds if places.get(k)), default=-1)
        if (at := last(names)) > last(within):
            for element in stack[at:]:
                places[element.name].pop()
            del stack[at:]

    name = ""
    for kind, piece, attributes in Tags(page).parts():
        if kind == "text":
            held.append(html.unescape(piece) if "&" in piece else piece)
            if places.get("a"):
                linked += len(piece)
        elif kind == "raw":
            held.append(piece)
        elif kind == "inside":
            if name not in SILENT:
                push(name, attributes_of_raw)
                held.append(html.unescape(piece))
                end_block()
                close((name,))
        elif kind == "close":
            if piece in BLOCK:
                end_block()
            close((piece,))
        else:
            name = piece
            if name in BLOCK:
                end_block()
                if name in CLOSES_P:
                    close(("p",), ("body", "td", "button"))
                if name in SAME:
                    close(tuple(SAME[name][0].split()), SAME[name][1])
            if name == "br":
                held.append(" ")
            if name in RAW:
                attributes_of_raw = attributes
            elif name not in VOID and not attributes.rstrip().endswith("/"):
                push(name, attributes)
    end_block()
    return found


def named(name: str, attributes: str) -> str:
    """The element with its class, id and role names, as one step of a tag path."""
    if not attributes:
        return name
    values = [a or b or c for a, b, c in NAMED.findall(attributes)]
    return " ".join([name, *(w for v in values for w in SPLIT.split(v.lower()) if w)])


def slot(name: str, size: int) -> int:
    return zlib.crc32(name.encode()) % size


@lru_cache(maxsize=20_000)
def step_slots(step: str, prefix: str) -> np.ndarray:
    """How often the step's words fall in each slot, counted up to 2."""
    return np.minimum(np.bincount([slot(prefix + word, PATH) for word in step.split()], minlength=PATH), 2).astype(np.uint8)


def path_vector(path: Element | tuple) -> np.ndarray:
    if not isinstance(path, Element):
        return np.zeros(PATH, np.float32)
    return np.minimum(path.slots() + step_slots(path.step, "leaf "), 2).astype(np.float32)


class WordSlots(dict):
    """Slots of words, remembered up to 200,000 of them."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = slot(word, WORDS)
        return out


WORD_SLOTS = WordSlots()


def vectors(page_blocks: list[tuple[Element | tuple, str, int]]) -> np.ndarray:
    """A row per block: its tag path, its words by hash, and a few counts."""
    out = np.zeros((len(page_blocks), PATH + WORDS + NUMBERS), np.float32)
    for i, (path, text, linked) in enumerate(page_blocks):
        words = text.lower().split()
        out[i, :PATH] = path_vector(path)
        counts = np.bincount([WORD_SLOTS[w] for w in words], minlength=WORDS)
        out[i, PATH : PATH + WORDS] = counts / (1.0 + len(words) ** 0.5)
        stops = text.count(".") + text.count("!") + text.count("?")
        out[i, PATH + WORDS :] = (
            np.log1p(len(words)) / 4, min(1.0, linked / len(text)), min(1.0, stops / 4), float(text[-1] in ".!?"), i / len(page_blocks), float(text[0] == "©")
        )
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Two LSTMs, one in page order and one against it, and a logistic unit over both for every block."""

    def __init__(self, seed: int = 3):
        rng, width = np.random.default_rng(seed), PATH + WORDS + NUMBERS
        self.p: dict[str, np.ndarray] = {}
        for way in "fb":
            self.p[f"wx{way}"] = (rng.standard_normal((width, 4 * HIDDEN)) / width**0.5).astype(np.float32)
            self.p[f"wh{way}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) / HIDDEN**0.5).astype(np.float32)
            self.p[f"b{way}"] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)].astype(np.float32)
        self.p["out"] = (rng.standard_normal(2 * HIDDEN) / HIDDEN**0.5).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, page, HIDDEN); padding leaves the state as it is."""
        drive = x @ self.p[f"wx{way}"] + self.p[f"b{way}"]
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        c, out = np.zeros_like(h), np.zeros((len(x), x.shape[1], HIDDEN), np.float32)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            z = drive[t] + h @ self.p[f"wh{way}"]
            gates = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g, on = np.tanh(z[:, 3 * HIDDEN :]), mask[t][:, None]
            c_new = f * c + i * g
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, c_new, on))
            c = np.where(on, c_new, c)
            h = np.where(on, o * np.tanh(c_new), h)
            out[t] = h
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.run(x, mask, "f"), self.run(x, mask, "b")], axis=2)
        return sigmoid(both @ self.p["out"] + self.p["bias"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        states = {way: self.run(x, mask, way, kept[way]) for way in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        wrong = np.where(mask, sigmoid(both @ self.p["out"] + self.p["bias"]) - y, 0) / mask.sum()
        grad = {"out": np.einsum("tb,tbh->h", wrong, both), "bias": np.array([wrong.sum()], np.float32)}
        for n, way in enumerate("fb"):
            wh, own = self.p[f"wh{way}"], self.p["out"][n * HIDDEN : (n + 1) * HIDDEN]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dwh, dh, dc = np.zeros_like(wh), np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, c_new, on in reversed(kept[way]):
                dh = dh + wrong[t][:, None] * own
                bent = np.tanh(c_new)
                dh_on, dc_on = np.where(on, dh, 0), np.where(on, dc, 0)
                dc_new = dc_on + dh_on * o * (1 - bent * bent)
                dz = np.concatenate([dc_new * g * i * (1 - i), dc_new * c * f * (1 - f), dh_on * bent * o * (1 - o), dc_new * i * (1 - g * g)], axis=1)
                dz_all[t] = dz
                dwh += h.T @ dz
                dh = np.where(on, dz @ wh.T, dh)
                dc = np.where(on, dc_new * f, dc)
            grad[f"wh{way}"], grad[f"b{way}"] = dwh, dz_all.sum((0, 1))
            grad[f"wx{way}"] = np.einsum("tbd,tbz->dz", x, dz_all, optimize=True)
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 10, seed: int = 4) -> None:
        """Adam over batches of pages of like length."""
        rng, step = random.Random(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
        batches = [pages[i : i + 12] for i in range(0, len(pages), 12)]
        for _ in range(epochs):
            rng.shuffle(batches)
            for batch in batches:
                x, mask = padded([v for v, _ in batch])
                y = np.zeros(mask.shape, np.float32)
                for i, (_, labels) in enumerate(batch):
                    y[: len(labels), i] = labels
                step += 1
                for k, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= (0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, rows))
    x, mask = np.zeros((longest, len(rows), rows[0].shape[1]), np.float32), np.zeros((longest, len(rows)), bool)
    for i, row in enumerate(rows):
        x[: len(row), i], mask[: len(row), i] = row, True
    return x, mask


ASIDE = frozenset(
    "nav menu header footer sidebar aside widget ad ads advert advertisement sponsored promo banner cookie consent notice popup modal dialog comment"
    " comments reply respond form login signup subscribe newsletter share social related breadcrumb breadcrumbs toolbar copyright button select label"
    " textarea option title head iframe".split()
)
MAIN = frozenset("article main".split())


def marked(path: Element | tuple) -> bool:
    """The weak label of a block of a page with an article: inside it, and in nothing that says it is beside it."""
    return isinstance(path, Element) and path.state == WITHIN


def made_page(rng: random.Random, words: list[str]) -> tuple[str, list[int]]:
    """A page in one of many layouts, and its blocks' labels."""
    out, labels = ["<!DOCTYPE html><html><head><title>", " ".join(rng.choices(words, k=5)), "</title></head><body>"], [0]

    def prose(least: int, most: int) -> str:
        picked = rng.choices(words, k=rng.randrange(least, most))
        return " ".join(picked).capitalize() + rng.choice([".", ".", ".", "?", "", "!"])

    def put(tag: str, text: str, label: int, attribute: str = "") -> None:
        out.append(f"<{tag}{attribute}>{text}</{tag}>")
        labels.append(label)

    def boxed(names: list[str], tags: list[str], fill, label: int = 0) -> None:
        tag, name = rng.choice(tags), rng.choice(names)
        where = rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {rng.choice(["box", "wide", "col"])}"'])
        out.append(f"<{tag}{where if tag == 'div' or rng.random() < 0.5 else ''}>")
        fill(label)
        out.append(f"</{tag}>")

    def links(label: int) -> None:
        out.append("<ul>")
        for _ in range(rng.randrange(2, 8)):
            put("li", f'<a href="/{rng.choice(words)}">{" ".join(rng.choices(words, k=rng.randrange(1, 4)))}</a>', label)
        out.append("</ul>")

    def lines(label: int) -> None:
        for _ in range(rng.randrange(1, 4)):
            put(rng.choice(["p", "div", "span"]) if label else rng.choice(["p", "div"]), prose(3, 30), label)

    def story(label: int) -> None:
        if rng.random() < 0.8:
            put(rng.choice(["h1", "h1", "h2"]), prose(3, 12), 1)
        for _ in range(rng.randrange(1, 14)):
            kind = rng.random()
            if kind < 0.75:
                put("p", prose(1, 90), 1)
            elif kind < 0.83:
                put("h2", prose(1, 6), 1)
            elif kind < 0.9:
                put("blockquote", prose(3, 40), 1)
            elif kind < 0.96:
                out.append("<ul>")
                for _ in range(rng.randrange(2, 5)):
                    put("li", prose(1, 14), 1)
                out.append("</ul>")
            else:
                asides[rng.randrange(len(asides))]()

    def form(label: int) -> None:
        put("label", prose(1, 4), 0)
        if rng.random() < 0.5:
            put("p", prose(3, 12), 0)
        put("button", prose(1, 3), 0)

    def replies(label: int) -> None:
        if rng.random() < 0.6:
            put("h3", prose(1, 3), 0)
        for _ in range(rng.randrange(1, 6)):
            out.append(f'<{(tag := rng.choice(["div", "li", "article"]))} class="comment">')
            put("p", prose(2, 60), 0)
            out.append(f"</{tag}>")

    def small(label: int) -> None:
        put(rng.choice(["p", "div", "small"]) if label else rng.choice(["p", "div"]), "&copy; " + prose(2, 12), 0)

    asides = [
        lambda: boxed(["ad", "ads", "advert", "sponsored", "promo", "banner"], ["div", "div", "aside"], lines),
        lambda: boxed(["cookie", "notice", "consent", "popup", "alert"], ["div", "div", "dialog", "section"], lines),
        lambda: boxed(["sidebar", "widget", "related"], ["aside", "div"], lambda n: (links if rng.random() < 0.5 else lines)(n)),
        lambda: boxed(["signup", "newsletter", "search", "login"], ["form"], form),
        lambda: boxed(["share", "social", "breadcrumb"], ["div", "nav"], links),
    ]
    if rng.random() < 0.7:
        boxed(["header", "top", "masthead"], ["header", "div"], lambda n: (put("h1", prose(1, 4), 0) if rng.random() < 0.3 else put("div", prose(1, 5), 0)))
    if rng.random() < 0.9:
        boxed(["nav", "menu"], ["nav", "div", "nav"], links)
    for aside in rng.sample(asides, rng.randrange(0, 4)):
        aside()
    boxed(["content", "post", "entry", "story", "article"], ["article", "article", "main", "div"], story, 1)
    for aside in rng.sample(asides, rng.randrange(0, 3)):
        aside()
    if rng.random() < 0.5:
        boxed(["comments", "replies", "discussion"], ["section", "div"], replies)
    if rng.random() < 0.95:
        boxed(["footer", "bottom", "copyright"], ["footer", "footer", "div"], small)
    return "".join(out) + "</body></html>", labels


def fit_labeller(pages: list[str], seed: int = 8) -> Labeller:
    """Fitted on a bounded sample of pages, weakly labelled by their article elements, and on made-up layouts with the pages' words."""
    rng, examples = random.Random(seed), []
    parsed = [blocks(p) for p in pages]
    words = sorted({w for page in parsed for _, text, _ in page for w in text.split()[:200]})[:8000] or ["word", "text", "page"]
    words = [html.escape(w) for w in words]
    for page in parsed:
        labels = [marked(path) for path, _, _ in page]
        if any(labels):
            seen, right = vectors(page), np.array(labels, np.float32)
            examples += [(seen[i : i + WINDOW], right[i : i + WINDOW]) for i in range(0, len(page), WINDOW)]
    for _ in range(MADE_PAGES):
        page, labels = made_page(rng, words)
        if len(found := blocks(page)) == len(labels):
            examples.append((vectors(found), np.array(labels, np.float32)))
    labeller = Labeller()
    labeller.fit(examples)
    return labeller


def main_texts(labeller: Labeller, pages: list[str]) -> list[str]:
    """The main text of each page: its blocks labelled so, joined by empty lines."""
    parsed = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, p in enumerate(parsed) if p), key=lambda i: len(parsed[i]))
    while order:
        count = max(1, min(64, STEPS // len(parsed[order[-1]])))
        part, order = order[-count:], order[:-count]
        x, mask = padded([vectors(parsed[i]) for i in part])
        main = labeller.probabilities(x, mask) > 0.5
        for at, i in enumerate(part):
            out[i] = "\n\n".join(text for t, (_, text, _) in enumerate(parsed[i]) if main[t, at])
    return out


def extract_main_text(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html), from the whole html.

    Null html is empty, and so is the text of a page without main blocks. Each page is labelled by itself; repeated
    rows, null ids and null urls pass as they are; other columns are ignored. An empty table gives no rows. Very long
    or broken pages are read whole, in time linear in their length; a page of n blocks takes about 2 KB times n.
    """
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(labeller.p)  # a fixed number of weights

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller()
        own.p = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = main_texts(own, [h or "" for h in part.column("html").to_pylist()])
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(read, "page_id long, url string, text string, n_chars long")


def fit_on(pages: DataFrame, max_pages: int = FIT_PAGES) -> Labeller:
    """Fit on at most max_pages pages, drawn by a hash of their ids."""
    return fit_labeller([r["html"] for r in bounded_sample(pages.select("page_id", "html").filter(F.col("html").isNotNull()), max_pages, "page_id")])
