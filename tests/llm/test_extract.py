"""Main-text extraction: parsing, gradients, held-out accuracy, whole pages of the table, odd pages."""
from __future__ import annotations

import html
import re

import numpy as np
import pytest

from sparklog.llm import extract as ex

PAGE = "page_id long, url string, html string, text string, n_chars long"


@pytest.fixture(scope="module")
def model():
    return ex.trained()


def test_blocks_are_repaired_and_decoded():
    page = """<body><p>one <b>bold<br>two<p>three&nbsp;&amp; caf&eacute;<!-- x --><script>if (a<b) "</p>"</script>
    <ul><li>a<li>b</ul><table><tr><td>c<td>d</table>1 < 2 <a title="x>y" href=q>l\n i</a></div></article> tail<style>p{}"""
    blocks = ex.leaf_blocks(page)
    assert [b.text for b in blocks] == ["one bold two", "three & café", "a", "b", "c", "d", "1 < 2 l i", "tail"]
    assert [b.path[-1][0] for b in blocks] == ["p", "p", "li", "li", "td", "td", "body", "body"] and blocks[6].linked > 0


@pytest.mark.parametrize("odd", ['<svg class="i"/>', "<math/>", "<svg class=i>", "<div><button>Menu</div>", "<button>Menu", "<button/>", "<noscript>", "<video src=x>",
                                 "<select><option>x", "<div><canvas></div>", "<object data=x>", "<svg><title/><style/></svg>",
                                 "<button>one<button>two</button>", "<noscript><div>Enable <svg/> it</div></noscript>"])
def test_elements_left_open_do_not_swallow_the_page(odd):
    page = f"<body>{odd}<article><p>one</p><p>two <svg><path d=x></svg>more <button><div>Go</div></button>words</p></article><svg></svg><button>x</button></body>"
    assert [b.text for b in ex.leaf_blocks(page)] == ["one", "two more words"]


def test_raw_text_left_open_ends_with_the_page():
    for tag in ("script", "style", "textarea", "title", "iframe"):
        assert [b.text for b in ex.leaf_blocks(f"<p>one</p><{tag}><p>two</p>")] == ["one"]
        assert [b.text for b in ex.leaf_blocks(f"<p>one</p><{tag}><p>two</{tag}><p>three</p>")] == ["one", "three"]


def test_gradients_match_differences():
    model, rnd = ex.Labeller(3), np.random.default_rng(0)
    x = rnd.normal(0, 1, (5, 3, ex.SIZE)).astype(np.float32)
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    x *= mask[..., None]
    y = (rnd.random((5, 3)) < 0.5).astype(np.float32) * mask
    _, grads = model.gradients(x, mask, y)
    for w, g in zip([*model.w, model.out], grads):
        flat, gf = w.reshape(-1), g.reshape(-1)
        for i in rnd.integers(0, len(flat), 12):
            old, e = flat[i], 1e-2
            flat[i] = old + e
            up, _ = model.gradients(x, mask, y)
            flat[i] = old - e
            down, _ = model.gradients(x, mask, y)
            flat[i] = old
            assert abs((up - down) / (2 * e) - gf[i]) < 2e-3


def test_held_out_pages(model):
    wrong = total = 0
    for x, y in ex.labelled(ex.training_pages(300, 99)):
        rows, mask = ex.padded([x])
        wrong += int(((model.scores(rows, mask)[:, 0] > 0) != (y > 0)).sum())
        total += len(y)
    assert wrong / total < 0.005


def article(page):
    body, out = page[page.find("<article>") + 9:page.find("</article>")], []
    for x in re.split(r"</?(?:p|h1)>", body):
        s = " ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in x else "", x)).split())
        out += [s] if s else []
    return "\n".join(out)


def test_whole_table(spark, sf_small):
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in ex.extract_text(pages).collect()}
    want = {r.page_id: article(r.html) for r in pages.collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_odd_pages(spark, model):
    long = "<article>" + "".join(f"<p>Paragraph {i} says something about everything.</p>" for i in range(3000)) + "</article>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<nav><ul><li><a href=x>home</a></li></ul></nav>"), (4, "u", long), (4, "u", long), (None, None, "<!-- "),
            (5, "u", "<script>never closed"), (6, "u", "<article><p>" + "word " * 20000 + "</p></article>")]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], PAGE)
    got = {(r.page_id, r.text, r.n_chars) for r in ex.extract_text(df).collect()}
    paragraphs = "\n".join(f"Paragraph {i} says something about everything." for i in range(3000))
    words = ("word " * 20000).strip()
    assert got == {(1, "", 0), (2, "", 0), (3, "", 0), (4, paragraphs, len(paragraphs)), (None, "", 0), (5, "", 0), (6, words, len(words))}
    assert ex.extract_text(spark.createDataFrame([], PAGE)).count() == 0
