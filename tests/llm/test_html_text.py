import random
import time

import numpy as np
import pytest

from tessera.llm import html_text as h


def texts(page):
    return [t for _, t, _ in h.blocks(page)]


def test_blocks():
    page = (
        "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a='</p><p>no';</script></head><body><!-- c <p>no</p> -->"
        "<div>loose <b>bold</b><p>one<br>two &eacute;&#233; <i>x</i><p>three\n\n  four</div><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>&lt;tail"
    )
    assert texts(page) == ["T & t", "loose bold", "one two éé x", "three four", "a", "b", "c", "d", "<tail"]
    paths = [tuple(p) for p, _, _ in h.blocks("<article class='post big'><p>x</p></article><p>y")]
    assert paths == [("article post big", "p"), ("p",)]


@pytest.mark.parametrize("page", ["", "<", "<p", "</p>", "<p>a</b></i>", "<!--", "<script>", "a < b", "<a href='x>y'>z</a>", "&", "<p/>x", "<![CDATA[x]]>"])
def test_odd_pages(page):
    assert isinstance(h.blocks(page), list)


def test_gradients():
    rng, labeller = np.random.default_rng(0), h.Labeller()
    labeller.p = {k: v.astype(float) for k, v in labeller.p.items()}
    x, mask = h.padded([rng.standard_normal((n, h.PATH + h.WORDS + h.NUMBERS)).astype(np.float32) for n in (5, 3)])
    y = rng.integers(0, 2, mask.shape) * mask

    def loss():
        p = np.clip(labeller.probabilities(x, mask), 1e-9, 1 - 1e-9)
        return -np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0).sum() / mask.sum()

    for name, grad in labeller.gradients(x, mask, y).items():
        at = tuple(rng.integers(0, s) for s in labeller.p[name].shape)
        labeller.p[name][at] += 1e-3
        up = loss()
        labeller.p[name][at] -= 2e-3
        down = loss()
        labeller.p[name][at] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(float(grad[at]), abs=2e-4)


WORDS = "the of thing ander losion marate vex kolin burate esta nomen".split()


@pytest.fixture(scope="module")
def labeller():
    return h.fit_labeller(["<article><p>" + " ".join(WORDS) + "</p></article>"])


def test_made_pages_are_labelled(labeller):
    rng, right, all_ = random.Random(77), 0, 0
    for _ in range(150):
        page, labels = h.made_page(rng, WORDS)
        found = h.blocks(page)
        assert len(found) == len(labels)
        x, mask = h.padded([h.vectors(found)])
        right += ((labeller.probabilities(x, mask)[:, 0] > 0.5) == np.array(labels)).sum()
        all_ += len(labels)
    assert right / all_ > 0.97


def test_batches_do_not_change_labels(labeller):
    rng = random.Random(5)
    pages = [h.made_page(rng, WORDS)[0] for _ in range(40)]
    assert h.main_texts(labeller, pages) == [h.main_texts(labeller, [p])[0] for p in pages]


def test_rows(spark, labeller):
    body = "<article><h1>Title here</h1><p>A &lt; B,   and\nmore.</p></article>"
    page = f"<html><body><nav><ul><li><a href='/a'>menu</a></li></ul></nav>{body}<footer>&copy; foot</footer></body></html>"
    long = "<article>" + "<p>some longer text here.</p>" * 3000 + "</article>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", long), (None, "u", page), (1, "u", page)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = h.extract_main_text(df, labeller).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    assert {r["text"] for r in got if r["page_id"] == 1} == {"Title here\n\nA < B, and more."}
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (2, 3)] == ["", ""]
    assert h.extract_main_text(df.limit(0), labeller).count() == 0
    assert isinstance(h.fit_on(df), h.Labeller)


@pytest.mark.parametrize(
    "page",
    ["</p" * 350_000, "<div><i>x" * 110_000, '<a href="x ' * 90_000, '<a ">" ' * 140_000, "<![CDATA[x" * 100_000, "<" * 1_000_000, "<?x" * 300_000,
     "<p><td>" + "<i>" * 100_000 + "<p>y" * 150_000, "<title>" * 140_000, "word " * 200_000],
    ids=["end tags", "unclosed elements", "open quotes", "quoted ends", "open sections", "signs", "instructions", "deep paragraphs", "titles", "one word"],
)
def test_long_broken_pages_take_linear_time(page):
    began = time.time()
    found = h.blocks(page)
    h.vectors(found)
    assert time.time() - began < 20
    assert sum(len(text) for _, text, _ in found) <= len(page)


def test_open_quotes_and_signs_are_text_or_markup_as_browsers_read_them():
    text = lambda page: [t for _, t, _ in h.blocks(page)]
    assert text('<p title="a > b">one</p>') == ["one"]
    assert text("<p>1 < 2 and 3 > 2</p>") == ["1 < 2 and 3 > 2"]
    assert text('<p title="open>one</p><p>two</p>') == ["one", "two"]
    assert text("<p>end </p") == ["end </p"]


def test_long_pages_are_fitted_whole(monkeypatch):
    seen = []
    monkeypatch.setattr("tessera.llm.html_text.Labeller.fit", lambda self, pages: seen.extend(pages))
    page = "<article>" + "".join(f"<p>word {i}</p>" for i in range(1_000)) + "</article><footer>end</footer>"
    h.fit_labeller([page])
    assert sum(len(x) for x, _ in seen[: -(-1_001 // 200)]) == 1_001 and max(len(x) for x, _ in seen) <= 200
