"""HTML extraction on real and hand-made pages; the url tree by brute force."""

import html as htmllib
import random
import re

from logvigil.llm import html_extract as H
from logvigil.llm import url_filter as U
from logvigil.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.01"


def article_text(page):
    """The article element's text, straight from the fixture's markup."""
    body = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", body.replace("<br>", " ")))
    return " ".join(" ".join(htmllib.unescape(b).split()) for b in blocks if b.strip())


def test_real_pages(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    want = {r.page_id: article_text(r.html) for r in pages.collect()}
    out = QUERIES["op3_html_extract"](spark, SF001).collect()
    assert {r.page_id: r.text for r in out} == want
    assert all(r.n_chars == len(r.text) for r in out)


PAGE = """<!DOCTYPE html><html><head><title>T t t</title><style>p{}</style></head><body>
<header class="top">Site name here</header><nav><ul><li><a href="/a">Home</a><li>More</ul></nav>
<div id="cookie-notice">We use cookies on this site a lot</div><div class="sidebar"><p>Side text</p></div>
<div class="content"><h1>Big &amp; bold</h1><p>First <b>par</b>agraph&nbsp;of   text<br>next line
<p>Second &lt;tag&gt; paragraph with <a title="x>y" href='q'>a link</a>.<script>var x = "</p>";</script>
<div class="ad">Buy now</div><form><p>Your name <input name=n></form><p>Third one &eacute;.</p></div>
<section class="comments"><p>I like this very much indeed</p></section>
<footer>&copy; us</footer></body></html>"""


def test_hand_made_page():
    want = ("Big & bold First paragraph of text next line Second <tag> paragraph with a link . "
            "Third one é.").replace("link .", "link.")
    model = H.learn(["<nav><li>x y</li></nav><article><h1>a b</h1><p>c d e</p></article><div class=z>q</div>"])
    assert H.extract(PAGE, model) == want
    assert H.extract(PAGE, None) == want


def test_optional_and_missing_end_tags():
    body = "<article><h1>Big</h1><p>One two three</p>%s<p>four five</p></article>"
    for head in ("<head><meta charset=u><title>t</title><link rel=a><body>", "<head><title>t</title></head>",
                 "<head><title>t</title>"):
        page = f"<html>{head}{body % ''}"
        assert H.extract(page, None) == "Big One two three four five"
    for mid in ('<svg class="i" />', '<svg><path d="M0"/><text>no</text></svg>', "<svg><path>", "<canvas/>",
                "<select><option>no<option>no", "<object data=x><p>no</p></object>", '<svg viewBox="0 0"/><svg/>'):
        assert H.extract("<html><head></head>" + body % mid, None) == "Big One two three four five"
    assert H.extract("<head><title>t</title>plain words", None) == "plain words"


def test_furniture_names():
    for attrs in ('style="overflow:hidden"', 'aria-hidden="false"', 'data-id="share-1"', "data-hidden",
                  'class="layout has-sidebar"', 'class="no-sidebar"', 'class="with-comments"',
                  'class="page-header-fixed"', 'title=" hidden "'):
        assert H.extract(f"<body><div {attrs}><p>One two three</p></div>", None) == "One two three", attrs
    for attrs in ("hidden", 'aria-hidden="true"', 'class="ad-slot"', "id='share'class=x", "role=banner",
                  'class="x site-footer"', 'title="a" hidden=""'):
        page = f"<body><p>One two three</p><div {attrs}><p>no</p></div><p>four five"
        assert H.extract(page, None) == "One two three four five", attrs


def test_furniture_around_the_article():
    for tag in ("article", "main"):
        for wrap in ('div class="sidebar-left"', "div hidden", "form id=aspnetForm", 'div class="menu open"'):
            end = wrap.split()[0]
            page = f"<body><{wrap}><p>no</p><{tag}><p>One <i>two</i></p><div class=ad>no</div><p>three</{tag}></{end}>"
            assert H.extract(page, None) == "One two three", wrap
    assert H.extract("<object data=x><article>One two three</article>", None) == "One two three"
    page = "<aside><article>teaser</article></aside><div class=comments><article>no no</article></div>" \
           "<article>One two three</article>"
    assert H.extract(page, None) == "One two three"
    assert H.extract("<div>One two three</div><aside><article>teaser</article></aside>", None) == "One two three"


def test_best_region():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.randrange(-4, 4) for _ in range(rng.randrange(9))]
        a, b = H.best_region(s)
        top = max((sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)), default=0)
        assert sum(s[a:b]) == max(top, 0)


def test_odd_pages(spark):
    rows = [(1, "u", None, 5), (2, None, "", 5), (3, "u", "<p>plain", 5), (3, "u", "<p>plain", 5),
            (4, "u", "no markup at all", 5), (5, "u", "<nav>menu</nav>", 5), (None, "u", "<p>x</p" * 3, 5),
            (6, "u", "<!-- a <p>b</p>", 5), (7, "u", "<p>" + "w " * 100000, 5), (8, "u", "<a href=\"x", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = {r.page_id: r.text for r in H.extract_pages(df, H.fit(df)).collect()}
    assert out[1] == out[2] == out[5] == out[6] == "" and out[3] == "plain"
    assert out[4] == "no markup at all" and len(out[7]) == 199999
    assert H.extract_pages(df.where("false"), H.fit(df.where("false"))).count() == 0


# ------------------------------------------------------------------------ urls
def urls():
    rng = random.Random(6)
    out = []
    for i in range(900):
        host = rng.choice(["a.example.org", "Shop.NET", "x.net", "y.com", "z.y.com", "example.org"])
        sec = rng.choice(["en", "fr", "de", "es", "spam"])
        url = f"http{rng.choice(['', 's'])}://{host}/{sec}/{rng.choice(['', 'tag/'])}{i}" \
            + rng.choice(["", "/", ".html", "?q=://a/b", "#t", "/a/b/c"])
        good = None if rng.random() < 0.5 else int(rng.random() < (0.1 if sec == "spam" else 0.9))
        out.append((url, good))
    out += [(f"ftp://slug.net/p/{''.join(rng.choices('abc', k=9))}", 1) for i in range(40)]
    return out + [(None, 1), ("", 0), ("no scheme/de/", None), ("://", 1), ("a://b", 0), ("x://y.com/fr/", 1),
                  ("x://y.com?/fr/", 1), ("a\nb://H\n/p\nq", None), ("http://com/de/1", 1)] * 2


def test_url_tree(spark):
    rows = urls()
    df = spark.createDataFrame([(i, u, g, "clash") for i, (u, g) in enumerate(rows)],
                               "page_id long, url string, lab int, host string")
    out = U.filter_urls(df, good="lab").orderBy("page_id").collect()
    want = U.brute_force(rows)
    assert [(r.host, r.path, r.template, r.rule, r.verdict) for r in out] == want
    assert any(w[3] is None and w[4] == "block" for w in want) and any("spam" in w[2] for w in want)
    none = U.filter_urls(df.withColumn("lab", df.lab.cast("int") * 0 + None), good="lab")
    assert {r.verdict for r in none.where("rule is null").collect()} == {"allow"}
    assert U.filter_urls(df.where("false"), good="lab").count() == 0


def test_deep_urls(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        branch, page = rng.choice(["docs", "spam"]), rng.choice(["", f"{i}/", f"x{i}/y/z/"])
        good = int(rng.random() < (0.05 if branch == "spam" else 0.95))
        rows.append((f"http://deep.net/a/b/c/d/{branch}/{page}", good if i % 2 else None))
        rows.append((f"http://blog.net/blog/2024/0{i % 9 + 1}/12/{branch}/s{i}", good))
    rows += [("http://long.net/" + "/".join("abcdefghij" * 5), 1), ("http://long.net/a/b", 0)]
    df = spark.createDataFrame([(i, u, g) for i, (u, g) in enumerate(rows)], "page_id long, url string, lab int")
    out = U.filter_urls(df, good="lab").orderBy("page_id").collect()
    assert [(r.host, r.path, r.template, r.rule, r.verdict) for r in out] == U.brute_force(rows)
    for r in out[:800]:
        assert r.verdict == ("block" if "/spam/" in r.url else "allow"), r


def test_shared_segments_take_one_round(spark):
    """Two urls that share 500 segments, and a chain with ends on the way."""
    import time
    stem = "/".join(f"s{i}" for i in range(500))
    rows = [(f"http://a.net/{stem}/x", 1), (f"http://a.net/{stem}/y", 0), (f"http://b.net/{stem}", 1),
            ("http://b.net/s0/s1", 1), ("http://b.net/s0/s1/s2/7/s4", 0), ("http://b.net/s0/s1/s2/8/s4", None)]
    df = spark.createDataFrame([(i, u, g) for i, (u, g) in enumerate(rows)], "page_id long, url string, lab int")
    started = time.time()
    out = U.filter_urls(df, good="lab").orderBy("page_id").collect()
    assert [(r.host, r.path, r.template, r.rule, r.verdict) for r in out] == U.brute_force(rows)
    assert time.time() - started < 60


def test_sql_goes_as_deep_as_the_query(spark, tmp_path):
    import duckdb

    from logvigil.llm.oracle import ORACLE
    from tools.oracle_check import compare
    rng = random.Random(4)
    pages = [(i, f"http://{rng.choice(['x', 'y'])}.net/" + "/".join(rng.choices("abc", k=rng.randrange(1, 7)))
              + rng.choice(["", f"/{i}", f"/t{i % 7}/{i}.html"])) for i in range(500)]
    labels = [(i, int(rng.random() < (0.2 if "/b/" in pages[i][1] else 0.9)), 0) for i in range(400)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = QUERIES["op6_url_filter"](spark, str(tmp_path)).toPandas()
    assert compare(got, con.sql(ORACLE["op6_url_filter"]).df()) == []
    assert got["template"].str.count("/").max() > 5


def test_url_labels(spark):
    pages = spark.createDataFrame([(1, "h://a/en/5"), (2, "h://a/en/6.html?x"), (3, "h://a/5/b"), (4, None),
                                   (5, "h://a/7/")], "page_id long, url string")
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 1), (7, 1, None), (7, 0, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = {r.page_id: r._good for r in U.numbered_labels(pages, labels).collect()}
    assert got == {1: 1, 2: 0, 3: None, 4: None, 5: 0}


def test_url_plan_is_native(spark):
    plan = QUERIES["op6_url_filter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


ARTICLES = {  # markup inside an article, its text
    '<p>One two</p><p>See <a href=a>one</a> <a href=b>two</a> <a href=c>three</a></p>': "One two See one two three",
    "<p>One two</p><ul><li>a b<li>c d<li>e f</ul>": "One two a b c d e f",
    "<p>Intro words here</p><ol><li><a>x</a></li><li><a>y</a></li></ol><p>end</p>": "Intro words here x y end",
    "<h1>T</h1><table><tr><td>a</td><td><a>b</a></td></tr></table><blockquote><p>q r</p></blockquote>": "T a b q r",
    "<header><h1>Title</h1></header><figure><img><figcaption>cap tion</figcaption></figure><p>x": "Title cap tion x",
    "<ul><li><a>only</a><li><a>links</a></ul>": "only links",
    "<p>A</p><nav><a>prev</a></nav><p>B</p><aside>note</aside><div class=comments><p>no no</p></div><p>C": "A B C",
    "<dl><dt>term</dt><dd>meaning</dd></dl><pre>code  x</pre><section><h2>s</h2><p>t</p></section>":
        "term meaning code x s t",
}


def test_whole_articles():
    menu = "<nav><ul><li><a>Home</a><li><a>More</a></ul></nav><div class=ad>Buy this now</div>"
    model = H.learn([f"{menu}<article><h1>a b</h1><p>c <b>d</b> e</p><p>f</p></article><footer>x</footer>"] * 9)
    wraps = ("%s", "<form action=/>%s</form>", "<div class='story widget'>%s</div>", "<div><div><div>%s</div></div></div>")
    for tag in ("article", "main"):
        for wrap in wraps:
            for inside, want in ARTICLES.items():
                page = f"<body>{menu}" + wrap % f"<{tag}>{inside}</{tag}>" + "<footer>all rights</footer>"
                for m in (None, model):
                    assert H.extract(page, m) == want, (wrap, inside, m is None)


def test_pages_without_an_article_element():
    menu = "<nav><ul><li><a>Home</a></ul></nav>"
    text = "<h1>Head</h1><div><div><p>One two three four</p></div></div><p>five six</p>"
    model = H.learn([f"{menu}<article><h1>a b</h1><p>c d e</p></article>"] * 5)
    for wrap in ("%s", "<form>%s</form>", "<div class='story widget'>%s</div>", "<div class=related-science>%s</div>",
                 "<form><fieldset><div class=widget>%s</div></fieldset></form>"):
        for m in (None, model):
            page = f"{menu}{wrap % text}<form><p>Your mail</p></form><footer>foot</footer>"
            assert H.extract(page, m) == "Head One two three four five six", wrap
    page = f"{text}<div class=comments><p>{'very long comment ' * 40}</p></div>"
    assert H.extract(page, model) == "Head One two three four five six"


def test_malformed_markup_takes_linear_time():
    import time
    size = 1_000_000
    forms = ["<script", "<b", "<a ", "<", "</", "<!--", "<!", "<a href=\"", "<a href='x\" ", "<a b='", "&#1", "&",
             "<div>", "</x>", "<svg><g>", "<b<b \"", "'\"<i ", "<p class=a", "</script ", "<script></script", "<li>", "<form>",
             "<svg><foreignobject>", "<div class=widget>", "<b\" '", "<textarea>", "<!-- --", "x=\"'", "<td\n"]
    for form in forms:
        for page in (form * (size // len(form)), form * (size // len(form)) + ">", "<div>" * 30_000 + form * 100_000,
                     "<b" + form * (size // len(form)) + "\"'>"):
            started = time.time()
            H.extract(page, None)
            assert time.time() - started < 12, form
    started = time.time()
    H.extract("<b" + "b" * size, None)
    H.extract("<p>&#" + "9" * size + ";&#x" + "f" * 10_000 + ";&#" + "0" * 9_000 + "65;", None)
    assert time.time() - started < 12
    assert H.extract("<p>a &#0000000000000065; &#99999999999; &#0000000000000; z", None) == "a A � � z"


def test_equal_pages_teach_once(spark):
    page = "<article><p>a b</p></article>"
    df = spark.createDataFrame([(1, page)] * 3000 + [(i, f"<article><p>a{i}</p></article>") for i in range(50)]
                               + [(9, "<article>" + "<p>x</p>" * 20_000)], "page_id long, html string")
    seen = []
    old, H.learn = H.learn, lambda pages: seen.extend(pages)
    try:
        H.fit(df, sample_pages=20)
        assert len(seen) == 20 == len(set(seen))
        H.fit(df.where("length(html) > 70000"), sample_pages=20)
        assert len(seen) == 21 and len(seen[-1]) == H.SAMPLE_HTML_BYTES
    finally:
        H.learn = old
