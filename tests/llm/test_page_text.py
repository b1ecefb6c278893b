"""The page labeller: leaf blocks, slopes, held-out pages of its own and of other layouts, odd pages."""

import html
import random
import re

import duckdb
import numpy as np
import pytest

from ampliform.llm import page_text

PAGES = "/root/testdata/sf0.01/pages.parquet"


def article(page):
    """What stands between the article's tags, by its paragraphs."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    lines = [" ".join(html.unescape(b.replace("<br>", " ").replace("<b>", "").replace("</b>", "")).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return [x for x in lines if x]


@pytest.fixture(scope="module")
def pages():
    return [h for _, h in duckdb.sql(f"select page_id, html from '{PAGES}' where html is not null order by page_id").fetchall()]


@pytest.fixture(scope="module")
def model(pages):
    return page_text.fitted(pages[:170])


def test_held_out_pages(model, pages):
    held = pages[170:]
    got = page_text.main_text(model, held)
    right = sum(g == "\n".join(article(p)) for g, p in zip(got, held, strict=True))
    assert right >= 0.95 * len(held)


LAYOUTS = (
    "<html><body><header><h1>{0}</h1><nav><a href=/>x {1}</a> <a href=/b>y</a></nav></header><div class='cookie-banner'>{2}</div><main><article>{a}</article></main><aside class=sidebar><h3>{3}</h3><ul><li><a href=#>{4}</a></li></ul></aside>"
    "<section class='comments'><div class=comment><p>{5}</p></div></section><form><label>{6}</label><input><button>go</button></form><footer>&copy; {7}</footer></body></html>",
    "<html><body><div id=header><div class=logo>{0}</div></div><div class='menu'><ul><li><a href=#>{1}</a></li><li><a href=#>{2}</a></li></ul></div><div class='content'>{a}</div><div class='sidebar'><p>{3}</p></div><div id='comments'><p>{4}</p><p>{5}</p></div><div id='footer'><p>{6}</p></div></body></html>",
)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_other_layouts(model, pages, layout):
    rng = random.Random(8)
    held = [article(p) for p in pages[170:]]
    pool = [x for a in held for x in a if len(x) > 10]
    made = []
    for a in held:
        other = [html.escape(" ".join(rng.choice(pool).split()[: rng.randrange(2, 30)])) for _ in range(8)]
        made.append(layout.format(*other, a="".join(f"<p>{html.escape(x)}</p>" for x in a)))
    got = [set(t.split("\n")) for t in page_text.main_text(model, made)]
    lost = sum(len(set(a) - g) for a, g in zip(held, got, strict=True))
    added = sum(len(g - set(a)) for a, g in zip(held, got, strict=True))
    n = sum(len(set(a)) for a in held)
    assert lost <= 0.05 * n
    assert added <= 0.05 * n


def test_leaves():
    cut = lambda p: [b.text for b in page_text.leaves(p)]
    assert cut("<p>a <b>b</b>c<br>d\n e&nbsp;&amp;amp; f<p>g<ul><li>h<li>i</ul>j") == ["a bc d e &amp; f", "g", "h", "i", "j"]
    assert cut("<title>t</title><script>if (a<b) '</p>'</script>x<style>p{}</style> <!-- <p>no</p> -->y") == ["x", "y"]
    assert cut("1 < 2 and a<3, <p class='x>y' data-q=\"<z>\">q</p><!-- open <p>lost") == ["1 < 2 and a<3,", "q"]
    assert cut("<script>never closed <p>x") == []
    assert cut("<svg><path/><text>s</text></svg><select><option>o</select><p>t") == ["t"]
    assert cut("") == cut("<") * 0 == []
    assert cut("<") == ["<"]
    nested = page_text.leaves("<div class='a B-c'><nav id=m><a href=#>xy</a></nav></div></p></div><p>z")
    assert [(b.text, b.path, b.linked) for b in nested] == [("xy", (("div", ("a", "b", "c")), ("nav", ("m",))), 2), ("z", (("p", ()),), 0)]
    assert len(cut("<div>" * 3000 + "deep")) == 1


def test_slopes(pages):
    known = page_text.examples(pages[:6])[:4]
    model = page_text.Labeller.fresh()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    bags, labels = [b for b, _ in known], [y for _, y in known]

    def loss():
        x, live = page_text._padded([model.vectors(b) for b in bags])
        want = page_text._padded([y[:, None].astype(np.float32) for y in labels])[0][:, :, 0]
        p = model.forward(x, live)[0]
        return -(np.where(want > 0, np.log(p), np.log(1 - p)) * live).sum() / live.sum()

    for k, g in model.slopes(bags, labels).items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        before = model.w[k][i]
        model.w[k][i] = before + 1e-3
        up = loss()
        model.w[k][i] = before - 1e-3
        down = loss()
        model.w[k][i] = before
        assert (up - down) / 2e-3 == pytest.approx(g[i], rel=1e-2)


def test_long_pages_in_spans(model, pages, monkeypatch):
    bag = page_text.Bag([b for p in pages[:20] for b in page_text.leaves(p)])
    whole = model.label(bag)
    monkeypatch.setattr(page_text, "SPAN", 7)
    assert np.allclose(model.label(bag), whole, atol=1e-5)
    monkeypatch.undo()
    one = page_text.Bag([page_text.Block("word " * 400_000, (("p", ()),), 0)])  # words are counted where there are many
    assert one.word_at[-1] == 400_000
    assert model.vectors(one)[0, page_text.WIDE] == pytest.approx(float(model.w["words"][one.words[0], 0]) / 3, rel=1e-3)


def test_table(spark, model, pages):
    data = [(i, "u", p, "t", 1.5) for i, p in enumerate([*pages[170:180], None, "", "<p>", pages[170], pages[170] * 40])] + [(None, None, pages[171], "t", 1.5)]
    got = page_text.extracted(spark.createDataFrame(data, "page_id long, url string, html string, text string, n_chars double").repartition(3), labeller=model).collect()
    want = dict(zip([d[0] for d in data], page_text.main_text(model, [d[2] or "" for d in data]), strict=True))
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert want[10] == want[11] == want[12] == ""
    assert want[13] == want[0]


def test_no_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert page_text.extracted(none).count() == 0
    assert page_text.extracted(none.union(spark.createDataFrame([(1, None, None)], none.schema))).collect()[0].text == ""
