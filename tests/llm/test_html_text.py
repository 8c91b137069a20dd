"""Pages with known texts, the scan against all stretches, and weights from labelled pages."""

import itertools
import random

from pyspark.sql import functions as F

from riftscan.llm import html_text as ht

NAV = '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>'
WEIGHTS: dict = {}


def text(html, weights=WEIGHTS):
    return "\n\n".join(ht.Page(html).best(weights))


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>x';</script></head><body>{NAV}{body}</body></html>"


def test_known_pages():
    good = "<article><h1>Head</h1><p>One  two\n three.<p>Four<br>five <b>si</b>x &amp; &lt;b&gt; &#233;&nbsp;&eacute;t&eacute"
    want = "Head\n\nOne two three.\n\nFour five six & <b> é été"
    assert text(page(good + "</article><footer>&copy; x y z</footer>")) == want
    inside = ('<div class="ad">Buy this now please</div><aside>Side words here</aside><form><label>Mail</label><button>Go</button></form>'
              '<section id="comments"><article class="comment"><p>I disagree with it all.</p></article></section>'
              '<script>if (a < b) document.write("<p>no</p>")</script><!-- <p>hidden</p> --><noscript><p>Turn it on</p></noscript>')
    assert text(page(good + inside + "<p>Last one.</article>")) == want + "\n\nLast one."
    assert text(page(inside + good.replace("<article>", '<div id="content" class="post has-sidebar">') + "</div><footer>f g h</footer>")) == want
    assert text(page('<header>Site</header><article><header class="entry-header"><h1>Own head</h1><p>by me</p></header><p>Text.</p></article>')) == "Own head\n\nText."
    assert text(page('<div role="alert">We use cookies</div><p class="cookie-notice">Accept all</p><main><ul><li>a</li><li>b</li></ul></main>')) == "a\n\nb"
    assert text(page('<article><p title="a > b" data-x=\'>\'>Kept <span class="share">Share <span>it</span> now</span>words</p></article>')) == "Kept words"
    assert text(page("<article><table><tr><td>a<td>b<tr><td>c</table><pre>x\n y</pre></article>")) == "a\n\nb\n\nc\n\nx y"


def test_broken_pages():
    assert text(None) == text("") == text("<p") == text("<!-- <p>x") == text("<script>x") == text(NAV) == ""
    assert text("just words") == "just words"
    assert text("a < b and 3 <4 c") == "a < b and 3 <4 c"
    assert text("<article><p>cut &am") == "cut &am"
    assert text("<article><p>kept</p><p>cut <a href='x") == "kept\n\ncut"
    assert text("<p>a</div></b></p></nav>b") == "a\n\nb"
    assert text("<!-->x<!-- y --!>z<![CDATA[q]]>") == "xz"
    assert text("<SCRIPT>a</scripting>b</Script >c") == "c"
    assert len(text("<div>" * 5000 + "x" + "</div>" * 5000)) <= 1
    assert text("<article>" + "<p>word</p>" * 50_000 + "</article>").count("word") == 50_000
    assert text("<p " + 'a="' * 100_001 + ">x") in ("", "x")


def test_scan_against_all_stretches():
    rng = random.Random(1)
    for _ in range(60):
        html = "".join(rng.choice(("<p>", "<div>", "</div>", "<li>", "word ", "two words", "<a>", "</a>", "<h2>")) for _ in range(25))
        names = {r[1] for r in ht.Page(html).runs}
        weights = {(n, 0): rng.choice((-3, -2, -1)) if not n.endswith("|") else rng.choice((-1, 1, 2)) for n in sorted(names)}
        p = ht.Page(html)
        score = [weights[r[1], 0] * r[3] for r in p.runs]
        spans = [(sum(score[a:b]), -a, -b) for a, b in itertools.combinations(range(len(score) + 1), 2)]
        most = max((s[0] for s in spans), default=0)
        touched = {"\n\n".join(t for k, t in enumerate(p.texts()) if t and any(r[0] == k for r in p.runs[-a:-b])) for s, a, b in spans if s == most}
        assert "\n\n".join(p.best(weights)) in (touched if most > 0 else {""})


def labelled(k, named):
    rng = random.Random(k)
    words = lambda n: " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(n))
    links = "".join(f"<li><a href=/{i}>{words(2)}</a></li>" for i in range(8))
    blocks = [words(12) for _ in range(4)]
    body = "".join(f"<p>{b}</p>" for b in blocks)
    around = "article" if named else "div"
    html = f"<body><div><ul>{links}</ul></div><{around}>{body}</{around}><div><ul>{links}</ul></div></body>"
    return html, "\n\n".join(blocks)


def test_weights_from_labels(spark):
    """Menus that nothing names are left out by learned weights, from labels of both kinds."""
    rows = [(k, f"u{k}", *labelled(k, named=False)) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, truth string")
    by_text = ht.train(df, label="truth")
    unseen = [labelled(k, named=False) for k in range(100, 120)]
    assert all(text(h, by_text) == want for h, want in unseen)
    assert any(text(h, {}) != want for h, want in unseen)
    named = [(k, f"u{k}", labelled(k, named=True)[0]) for k in range(40)]
    by_markup = ht.train(spark.createDataFrame(named, "page_id long, url string, html string"))
    assert all(text(h, by_markup) == want for h, want in [*unseen, *(labelled(k, named=True) for k in range(50, 60))])
    assert len(ht.train(df, label="truth", max_pages=5)) > 0


def test_extract(spark):
    rows = [(1, "u", page("<article><p>é x</p></article>"), "c"), (1, "u", page("<article><p>é x</p></article>"), "c"), (None, None, None, None), (2, "v", "", "d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("a.b", F.lit(1)).toDF("page_id", "url", "html", "text", "html")
    got = ht.extract(df, ht.train(df)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", "é x", 3), (1, "u", "é x", 3), (None, None, "", 0), (2, "v", "", 0)], key=str)
    assert ht.extract(df.limit(0), ht.train(df.limit(0))).count() == 0
