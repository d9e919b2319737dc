"""Toxicity, URL filters, top-k and HTML extraction."""

import math
import random

import numpy as np
import pytest


def test_toxicity_learns_and_ignores_identity(spark):
    from pyspark.sql import functions as F

    from emberlens.llm.toxicity import held_out, score_toxicity, train

    r = random.Random(5)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    docs, labels = [], []
    for i in range(1200):
        words = [r.choice(plain) for _ in range(r.randint(10, 80))]
        toxic = i % 5 == 0
        if toxic:
            words[r.randrange(len(words))] = r.choice(["nasty", "vile"])
        if r.random() < (0.6 if toxic else 0.05):  # the term goes with the label in what is learned
            words[-1] = "muslims"
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(2000, None), (2001, ""), (2002, "muslims wa wb"), (2003, "christians wa wb"), (2004, "Vile! wa")]
    labels += [(None, 1), (2005, None), (2000, 1)]
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = train(d, l, ~held_out(F.col("doc_id")))
    out = {x.doc_id: x for x in score_toxicity(d, model).collect()}
    assert np.mean([out[i].predicted == int(i % 5 == 0) for i in range(1200)]) > 0.97
    assert out[2000].score == out[2001].score and 0 <= out[2000].score < 0.5
    assert out[2004].predicted == 1 and out[2002].predicted == 0 and abs(out[2002].score - out[2003].score) < 0.15
    free = {x.doc_id: x.score for x in score_toxicity(d, train(d, l, ~held_out(F.col("doc_id")))).collect()}
    assert free[2002] == out[2002].score  # reruns agree
    assert score_toxicity(d.limit(0), model).count() == 0
    nothing = train(d, l.limit(0), ~held_out(F.col("doc_id")))
    assert not nothing.weights and {x.score for x in score_toxicity(d, nothing).collect()} == {0.5}


def test_swaps_cost_score_changes():
    from emberlens.llm.toxicity import Swaps, counterfactuals, fit

    flat, sizes, y = np.repeat([0, 1, 2], [30, 30, 60]), np.ones(120, int), np.repeat([1, 0], [30, 90])
    swaps = Swaps.made(np.array([-1, 2] * 60), np.full(60, 2))
    apart = fit(flat, sizes, y, swaps, 3, swap=0.0)[0]
    tied = fit(flat, sizes, y, swaps, 3, swap=5.0)[0]
    assert abs(tied[0] - tied[1]) < 0.2 * abs(apart[0] - apart[1])
    # What a swap changes as a whole: a word that another one begins like keeps what they share.
    numbers = {"muslims": 0, "musl*": 1, "musli*": 2, "jews": 3, "muslin": 4}
    assert counterfactuals({"muslims", "x"}, numbers) == [[-2, -3, -1]] * 2 + [[-2, -3, -1, 4]] + [[-2, -3, -1]] * 2 or sorted(map(sorted, counterfactuals({"muslims", "x"}, numbers))) == sorted([[-3, -2, -1]] * 4 + [[-3, -2, -1, 4]])
    assert sorted(map(sorted, counterfactuals({"muslims", "muslin"}, numbers))) == sorted([[-1]] * 4 + [[-1, 4]])


def test_urls(spark):
    from emberlens.llm.queries import URL_RULES
    from emberlens.llm.urls import url_filter

    urls = {
        "https://Foo.Example.COM/en/1": ("foo.example.com", "/en/1", "com/en/", "block"),
        "http://example.com/en/77?x#y": ("example.com", "/en/77", "example.com/en/7", "allow"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "http://a.example.net/de/8": ("a.example.net", "/de/8", "example.net/de/8", "block"),
        "http://a.net/de/": ("a.net", "/de/", "net/de/", "allow"),
        "http://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://com?/en/": ("com", "", None, None),
        "ftp://x.org/es/://y": ("x.org", "/es/://y", "org/es/", "block"),
        "no scheme.com/en/": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://www.casino-bets.example.io/de/4": ("www.casino-bets.example.io", "/de/4", None, "block"),
        "http://www.botany-museum.example.io/de/4": ("www.botany-museum.example.io", "/de/4", None, "allow"),
        "http://a.b/x\ny": ("a.b", "/x\ny", None, None),
    }
    rows = list(enumerate(urls))
    df = spark.createDataFrame([(i, u, 1) for i, u in rows], "page_id long, url string, score int")
    out = {r.page_id: r for r in url_filter(df, URL_RULES).collect()}
    for i, u in rows:
        host, path, rule, verdict = urls[u]
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule), u
        assert verdict is None or out[i].verdict == verdict, u
    assert url_filter(df.limit(0), URL_RULES).count() == 0


def test_url_model_on_held_out_names():
    """Names that the table hasn't, on hosts and paths that it hasn't: stems with other words around them."""
    from emberlens.llm.urls import ALLOW_STEMS, AROUND, BLOCK_STEMS, fit_urls, labelled_urls

    for k in range(2):
        model = fit_urls(labelled_urls([x for i, x in enumerate(AROUND) if i % 4 != k]))
        new = [x for i, x in enumerate(AROUND) if i % 4 == k] + ["{}s-4u", "super{}", "{}-online"]
        score = lambda stems: np.array([model.score(a.format(x) + ".test.org", "/x/1") for x in stems for a in new])  # noqa: B023, E731
        assert (score(BLOCK_STEMS) >= 0.5).mean() >= 0.95 and (score(ALLOW_STEMS) < 0.5).mean() >= 0.9
    model = fit_urls(labelled_urls())
    assert all(model.score(f"{x}.com", "/") >= 0.5 for x in ("viagra", "onlinepoker", "porn", "xxx")) and all(model.score(f"{x}.com", "/") < 0.5 for x in ("cheap-flights", "university", "nytimes"))


@pytest.mark.parametrize("blocks", [(512, 4096), (3, 7)])
def test_top_k(spark, blocks):
    from pyspark.sql import functions as F

    from emberlens.llm.topk import top_k

    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(r.normal(size=6), 1)], 0) for i in range(120)]
    rows[7:20] = [(i, rows[50][1], 0) for i in range(7, 20)]  # ties
    rows += [(200, None, 0), (250, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (300, [float("nan")] * 6, 0), (350, [float("inf")] * 6, 0), (400, [1.0, 2.0], 0), (450, [], 0), (50, rows[50][1], 0)]
    rows += [(50, rows[3][1], 0), (None, rows[4][1], 0), (None, rows[50][1], 0), (500, [1e16] * 6, 0), (550, [1e30, 0.0, 0.0, 0.0, 0.0, 0.0], 0), (600, [-3e38] * 6, 0), (650, [1e5, -1e5, 0.0, 0.0, 0.0, 0.0], 0), (651, [7e6, 0.0, 0.0, 0.0, 0.0, 0.0], 0), (652, [-7e6, 7e6, 1.0, 0.0, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    out = [tuple(x) for x in top_k(df, F.col("vec_id") % 50 == 0, queries_per_block=blocks[0], candidates_per_block=blocks[1]).collect()]
    # Brute force over rows: a repeated id is another row, and a score beyond 64 bits is null.
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fits = lambda x: x if abs(x) < 2**63 else None
    want = []
    for a, (q, v) in enumerate(ok):
        if q is not None and q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i is None, i or 0) for b, (i, w) in enumerate(ok) if a != b and len(w) == len(v))[:5]
            want += [(q, k + 1, None if none else i, fits(-s)) for k, (s, none, i) in enumerate(best)]
    assert sorted(map(repr, out)) == sorted(map(repr, want))
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


PAGES = [
    (
        "<html><head><title>T</title><style>p{}</style><script>var a='<p>no</p>'</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>"
        "<div class='cookie-notice'><p>We use cookies, please agree. Really, do.</p></div><div class=content><h2>A  head&amp;line</h2><p>First, a <b>bold</b>\n and long paragraph. It has several sentences, and commas.</p>"
        "<p>Second &lt;one&gt; caf&eacute;, short.<div class='ad'>Buy now, cheap!</div></div><aside>Links, and more.</aside><form>Name, please: <input></form>"
        "<section id='comments'><p>Nice, I liked it, a lot. Thanks, author!</p></section><footer>&copy; all, reserved.</footer></body></html>",
        "A head&line\nFirst, a bold and long paragraph. It has several sentences, and commas.\nSecond <one> café, short.",
    ),
    ("<p>Only one.", "Only one."),
    (
        "<body><div class=top><p>Short notice, here.</p></div><article><header><h1>Title words</h1></header><div class=body><p>Long, long paragraph, with commas, and more of them, and a full stop.</p>"
        "<ul><li>One, two<li>Three</ul></div><footer>By someone</footer></article><div class=more><p>Another, unrelated text.</p></div></body>",
        "Title words\nLong, long paragraph, with commas, and more of them, and a full stop.\nOne, two\nThree",
    ),
    ("<article><p>One<br>two, three.<p>Four, five<!-- no --> six.</article>", "One two, three.\nFour, five six."),
    ("", ""),
    (None, ""),
    ("<nav>a</nav><script>b", ""),
    ("a < b and c > d, fine.", "a < b and c > d, fine."),
    ("<div><p title='x > y' class=\"a\">Quoted, attribute.</p></div>", "Quoted, attribute."),
]


def test_html(spark):
    from emberlens.llm.html import extract_text

    df = spark.createDataFrame([(i, f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in extract_text(df).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert out[i].text == want and out[i].n_chars == len(want) and out[i].url == f"u{i}"
    assert extract_text(df.limit(0)).count() == 0


def test_html_attributes_are_read_one_after_another():
    from emberlens.llm import html

    content = html.content

    long = "A long paragraph of the article, with commas, and a full stop. It goes on, for a while, and ends."
    kept = [
        f"<div aria-hidden=\"false\"><p>{long}</p></div>",
        f"<p>{long}</p><p>See <a href=\"/hidden-gems\">the gems</a>, <a href=\"/x?id=comments\">and more</a> of it, in this paragraph of some length.</p>",
        f"<p title=\"the hidden valley\">{long}</p>",
        f"<section data-topic=\"hidden costs\"><p>{long}</p></section>",
        f"<div data-id=\"related\"><p>{long}</p></div>",
        f"<div data-x='class=\"ad\"' data-role=menu style='--x-display:none'><p>{long}</p></div>",
    ]
    for page in kept:
        assert long in content(page), page
    assert "the gems, and more of it" in content(kept[1])
    rest = "The article itself, with more text than what is left out, and with commas. " * 3 + "It ends."
    for gone in ("hidden", "HIDDEN=''", "class='x'hidden", "data-a=b hidden", "style='color:red; Display : none'", "role=Menu", "id=comments", "class = 'x ad'"):
        assert content(f"<div {gone}><p>{long}</p></div><p>{rest}</p>") == rest, gone
    assert html.attributes(" a=1 A=2 b='x y'c=\"d\" /e f = g=h") == {"a": "1", "b": "x y", "c": "d", "e": "", "f": "g=h"}


def test_html_names_weigh_and_do_not_remove():
    from emberlens.llm.html import content

    body = "".join(f"<p>Paragraph {i} of the article, with commas, and a full stop. It goes on, for a while, and ends.</p>" for i in range(4))
    text = content(f"<div>{body}</div>")
    assert text.count("\n") == 3
    for attrs in ("class='page has-sidebar'", "class='content with-sidebar'", "id=wrap class=nav-open", "class=notice-text", "class='sidebar'", "id=comments", "class='widget ad'"):
        for tag in ("div", "section"):
            assert content(f"<{tag} {attrs}>{body}</{tag}><p>By someone.</p>").startswith(text), attrs  # most of the text
            assert content(f"<{tag} {attrs}><h1>Its title</h1>{body}</{tag}><div><p>Another text, of some length.</p></div>").startswith("Its title\n" + text), attrs
    for wrapper in ("<form>", "<div class=sidebar>", "<div role=form>", "<span class=ad>"):
        assert content(f"{wrapper}<article>{body}</article></div></form></span>") == text, wrapper
    # Names on parts of an article.
    for part in ("<p class=discussion>", "<section class=discussion><p>", "<section class=notice-text><p>", "<div class=has-sidebar><p>", "<p class=comment>"):
        assert "The part, which is in the article" in content(f"<div>{body}{part}The part, which is in the article, with its commas. It ends here.</p></section></div>"), part
    code = "<pre>x = 1 <span class='token comment'># a remark</span>, y = 2, and so on, for a while.</pre>"
    assert "# a remark" in content(f"<div>{body}{code}</div>")
    # What stands around it still goes, also where it is the longer text, or is made of articles.
    remark = "<p>Nice, I liked it, a lot. Thanks, author! I would read more of it, any time.</p>"
    for named in ("id=comments", "class=comments-area", "class=comment-list", "class='x related-posts'", "class=widget-2", "class=site-sidebar", "class=cookie-notice", "class=ad"):
        assert content(f"<div class=body>{body}</div><div {named}>{remark}</div>") == text, named
        assert content(f"<article>{body}</article><div {named}>{remark * 9}</div>") == text, named
        assert content(f"<article>{body}</article><div {named}><article>{remark}</article><article>{remark}</article></div>") == text, named
    assert content(f"<div>{body}<p class=ad>Buy now, cheap, and a lot of it!</p><p><span class=ad>Buy now, cheap!</span></p></div>") == text


def test_html_takes_time_in_proportion_to_the_page():
    import time

    from emberlens.llm.html import content

    n = 5000
    for page in (
        "<div>text, here." * n, "<div class=ad>text, here." * n, "<article>text, here." * n, "<p title=\"it's>" * n, "<p title='x>" * n + '"', "<a " * n, "<!-- " * n, "<b><li>x" * n,
        "<ul><li>x" * n, "</div>x" * n, "<span class=ad>x, y." * n, "<table><tr><td>x" * n, "<script>" * n, "&amp" * n, "<" * n, "<div id=comments><article>x, y." * n,
    ):
        began = time.time()
        assert isinstance(content(page), str)
        assert time.time() - began < 2, page[:30]
    assert content("<div>text, here." * 300).count("text, here.") == 300


def layouts():
    """Pages around one article, and the article's blocks: each layout has furniture that must go."""
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Part {i}</a></li>" for i in range(8)) + "</ul>"
    remark = "<p>Nice, I liked it, a lot. Thanks, author! I would read more of it, any time.</p>"
    ad = "<p>Buy now, cheap!</p>"
    wrappers = ("<div>{}</div>", "<article>{}</article>", "<main><div class='post-body'>{}</div></main>", "<div class='widget'>{}</div>", "<section class='story share-enabled'>{}</section>", "<table><tr><td>{}</td></tr></table>",
                "<div><div><div><div>{}</div></div></div></div>", "<div id=content class='col-8 has-sidebar'>{}", "<form action=/><div>{}</div></form>", "<div>" * 40 + "{}")
    pages = (
        "<body><nav>" + menu + "</nav>{}<footer>All rights, reserved.</footer></body>",
        "<body><header><h2>Site</h2>" + menu + "</header>{}<aside>" + remark + "</aside>",
        "<div class='cookie-notice'>" + ad + "</div>{}<div class='ad'>" + ad + "</div>",
        "<div class=top>" + menu + "</div>{}<section id='comments'>" + remark * 3 + "</section>",
        "<script>var a = '<p>no, never.</p>'</script><style>p{{}}</style>{}<form>Name, please: <input><button>Send</button></form><noscript>Turn, it on.</noscript>",
    )
    for k, wrapper in enumerate(wrappers):
        blocks = [f"A {k} headline"] + [f"Paragraph {k}.{i} of the article, with commas, and a full stop. It goes on, for a while & ends." for i in range(3 + k % 3)]
        body = f"<h1>{blocks[0]}</h1>" + "".join("<p>" + b.replace("&", "&amp;").replace("article", "<b>article</b>") + ("" if k % 2 else "</p>") for b in blocks[1:])
        for page in pages:
            yield page.format(wrapper.format(body)), "\n".join(blocks)


def test_html_on_fifty_pages():
    from emberlens.llm.html import content

    pages = list(layouts())
    assert len(pages) == 50
    wrong = [(p, content(p), want) for p, want in pages if content(p) != want]
    assert not wrong, (len(wrong), wrong[0])


def test_fit_reaches_a_point_where_no_weight_lowers_the_loss():
    from emberlens.llm.toxicity import Swaps, fit

    r = np.random.default_rng(4)
    dims, m, l1, swap = 6, 80, 2e-3, 1.0
    texts = [np.flatnonzero(r.random(dims) < 0.5) for _ in range(m)]
    flat, sizes = np.concatenate(texts), np.array([len(t) for t in texts])
    y = np.array([int(0 in t) if r.random() < 0.8 else 1 - int(0 in t) for t in texts])
    changes = [[-2, 3], [-4], [-2, 3, 5]]
    w, b = fit(flat, sizes, y, Swaps.made(np.concatenate(changes), np.array([len(c) for c in changes])), dims, l1, swap, steps=6000, still=0.0)

    def loss(w, b):
        z = np.array([w[t].sum() for t in texts]) + b
        moved = [sum(np.sign(c) * w[abs(c) - 1] for c in change) for change in changes]
        return np.mean(np.log1p(np.exp(-np.where(y == 1, z, -z)))) + swap * np.mean(np.square(moved)) + l1 * np.abs(w).sum()

    best = loss(w, b)
    for k in range(dims):  # by finite differences, so by the loss alone
        for step in (1e-2, -1e-2):
            moved = w.copy()
            moved[k] += step
            assert loss(moved, b) > best - 1e-6, (k, step)
    assert min(loss(w, b + 1e-2), loss(w, b - 1e-2)) > best - 1e-6


def _prose(n, seed=0):
    r = random.Random(seed)
    return [f"The {r.choice(['old', 'new', 'wide'])} mill number {i} stands by the river, where {r.choice(['boats', 'geese', 'carts'])} pass every day, and people come to see it." for i in range(n)]


KINDS = {
    "unclosed anchor without a target": ("<body><a name='top'><div><p>{p0}</p><p>{p1}</p></div></body>", "{p0}\n{p1}"),
    "list, table and box in a plain div": (
        "<body><nav><a href=/>Home</a></nav><div>{ps}<ul><li>one egg</li><li>two cups of milk</li></ul><table><tr><td>Year</td><td>1999</td></tr></table><div><h2>Sub</h2><p>A.</p></div></div><footer>us</footer></body>",
        "{ls}\none egg\ntwo cups of milk\nYear\n1999\nSub\nA.",
    ),
    "links in the middle": ("<body><div class=text>{ps}<ul>" + "".join(f"<li><a href=/{i}>see mill {i}</a></li>" for i in range(5)) + "</ul><p>{p0}</p></div></body>", "{ls}\n" + "\n".join(f"see mill {i}" for i in range(5)) + "\n{p0}"),
    "comments that outweigh": ("<body><div>{ps}</div><ol class=commentlist>" + "".join(f"<li><p>I like this one, really, number {i}. Thanks for it, and please write more of the kind!</p></li>" for i in range(30)) + "</ol></body>", "{ls}"),
    "user comments": ("<body><div>{ps}</div><div class=user-comments>" + "".join(f"<p>So true, number {i}, I agree, and so does everyone here.</p>" for i in range(12)) + "</div></body>", "{ls}"),
    "cookie banner beside one sentence": ("<body><div class=cookie-banner><p>We use cookies, and so do our partners. You can accept all of them, some, or none, and change it later.</p></div><div><p>The mill burned down on Monday.</p></div></body>", "The mill burned down on Monday."),
    "longer sidebar": ("<body><div class='col main-col'><p>The mill burned down on Monday, and nobody was hurt.</p></div><div class='col sidebar'><p>{p0}</p><p>{p1}</p></div></body>", "The mill burned down on Monday, and nobody was hurt."),
    "form around the page": ("<body><form id=aspnet><div>{ps}</div></form></body>", "{ls}"),
    "old markup": ("<html><body bgcolor=white><font face=Arial><center><table><tr><td>{p0}<p>{p1}</td></tr></table></center></font></body></html>", "{p0}\n{p1}"),
}


@pytest.mark.parametrize("kind", list(KINDS))
def test_pages_of_many_kinds(kind):
    from emberlens.llm.html import content

    page, want = KINDS[kind]
    ps = _prose(8)
    parts = {"p0": "First, the mill by the lake was sold, for little money. It is old.", "p1": "Second, its owner, a baker, left the town last year.", "ps": "".join(f"<p>{x}</p>" for x in ps), "ls": "\n".join(ps)}
    assert content(page.format(**parts)) == want.format(**parts)
