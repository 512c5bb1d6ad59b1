"""URL rules, HTML extraction and top-k search against plain versions."""
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.llm import html_text, mips, url_rules
from starloom.llm.queries import URL_RULES


def plain_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        for c in "?#":
            rest = rest.split(c)[0]
        host, _, p = rest.partition("/")
        path = rest[len(host):]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(k), k, v) for v, k in URL_RULES for h in [k.split("/")[0]]
            if (host == h or host.endswith("." + h)) and path.startswith(k[len(h):])]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


def test_url_rules(spark):
    hosts = ["example.com", "WWW.Example.com", "a.www.example.com", "xexample.com", "com", "b.net", "net", "x.org", "", "com.", "É.net", "u@example.com:80"]
    tails = ["", "/", "/en", "/en/", "/en/a?b#c", "?/en/", "/es/1", "/fr/x/y", "#/", "/En/", "//en/"]
    urls = [f"{s}{h}{t}" for s, h, t in itertools.product(["http://", "x://y://", "//", ""], hosts, tails)] + [None, "", "://", "a" * 50000 + "://b.net/es/"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)] + [(0, urls[0], "c")], "page_id long, url string, host string")
    got = url_rules.apply_url_rules(spark, df, [url_rules.parse_rule(*r) for r in URL_RULES]).collect()
    assert len(got) == len(urls) + 1
    assert all((r.host, r.path, r.rule, r.verdict) == plain_verdict(urls[r.page_id]) for r in got)
    assert url_rules.apply_url_rules(spark, df.limit(0), []).count() == 0
    assert {r.verdict for r in url_rules.apply_url_rules(spark, df, [], default="block").collect()} == {"block"}


def test_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(url_rules.xxhash, "xxh64_intdigest", lambda b: 7)
    url_rules.DigestIndex.write([url_rules.parse_rule("block", k) for k in ("a.com/", "b.com/")], str(tmp_path))
    index = url_rules.DigestIndex(str(tmp_path))
    assert url_rules.judge(index, ["http://a.com/", "http://b.com/", "http://c.com/"], "allow")[2] == ["a.com/", "b.com/", None]


LONG = "The cat sat on the mat and it was the end of that for all of them who had been there with him. " * 4


def test_regions():
    page = f"""<html><head><title>t</title><script>var a="</p>";</script></head><body><header>Top</header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><header><h1>Title &amp; more</h1></header><p>{LONG}<br><p><b>Short&nbsp;one.
    <p>2 &lt; 3 and 4 &gt; 3</p><!-- c --><aside>Side</aside><form>Name <input></form><footer>By me</footer></article>
    <section id="comments"><article class="comment"><p>{LONG}</p></article></section><footer>&copy; us</footer></body></html>"""
    assert html_text.extract(page).split("\n\n") == ["Title & more", LONG.strip(), "Short one.", "2 < 3 and 4 > 3"]


@pytest.mark.parametrize("page", [
    "<html class='no-sidebar'><body class='has-sidebar page'><article>{}</article></body></html>",
    "<body class='cookie'><main id='search'>{}</main></body>",
    "<article class='related-story'>{}</article>",
    "<div class='page no-sidebar'>{}</div>",
    "<div class='sidebar-layout'><div id='widget'><main>{}</main></div></div>",
    "<div class='form'><article>{}</article></div>",
    "<div class='form'><div role=main>{}<section id=comments><article>No</article></section></div></div>",
    "<article><section id='search-methods'>{}</section></article>",
    "<div class='entry-content paywall'>{}</div>",
])
def test_class_and_id_words_spare_the_main_region(page):
    text = f"<h2 id='legal'>Legal terms</h2><p>{LONG}</p>"
    assert html_text.extract(page.format(text)).split("\n\n") == ["Legal terms", LONG.strip()]


@pytest.mark.parametrize("part", [
    "<div class='share-buttons'>{}</div>", "<div class='post-comments'>{}</div>", "<div id='newsletter'>{}</div>", "<aside class='x'>{}</aside>",
    "<div class='related'><article>{}</article></div>", "<section id='comments'><article class='comment'>{}</article></section>",
])
def test_regions_named_by_class_are_still_dropped(part):
    part = part.format(f"<p>{LONG} x</p>")
    assert html_text.extract(f"<body><article><p>{LONG}</p></article>{part}</body>") == LONG.strip()
    assert html_text.extract(f"<body><article><p>{LONG}</p>{part}</article></body>") == LONG.strip()
    assert html_text.extract(f"<p>{LONG}</p><section id='comments'><article class='comment'><p>{LONG}</p></article></section>") == LONG.strip()


def test_pages_without_regions():
    assert html_text.extract(f"<div>Home | About</div><p>{LONG}</p><p>Short tail.</p><p>{LONG}</p>").split("\n\n")[-3:] == [LONG.strip(), "Short tail.", LONG.strip()]
    assert html_text.extract("<p>only this</p>") == "only this"
    assert html_text.extract(f"<p>{LONG}</p><p><a href=x>{LONG}</a></p>") == LONG.strip()


def test_odd_markup(spark):
    pages = [None, "", " ", "plain words", "<", "<p", "<p>a<", "<!-- open", "<script>x", "<p>" * 3000 + "deep", "<b></p></div>&#0;&#x41;&bogus;", "<article>" + "<p>x y</p>" * 5000 + "</article>"]
    df = spark.createDataFrame([(i, "u", p, "clash") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract_pages(df).collect()}
    assert len(got) == len(pages) and got[0].text == got[1].text == "" and got[3].text == "plain words" and got[9].text == "deep"
    assert got[11].text.count("x y") == 5000 and all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract_pages(df.limit(0)).count() == 0


def plain_top(vectors, asked, k):
    ok = [(i, [int(np.floor(256.0 * x)) for x in v]) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q is not None and asked(q):
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i is not None and i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return sorted(out)


def test_top_k(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, r.choice([0.1, 1, 5])) for _ in range(6)]) for i in range(700)]
    rows += [(700 + i, list(rows[i][1])) for i in range(0, 200, 10)]                    # ties
    rows += [(1000, None), (1050, []), (1100, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (1150, [float("nan")] * 6), (1200, [float("inf")] * 6), (None, [1.0] * 6),
             (1250, [0.0] * 6), (1300, [1.0, 2.0]), (1301, [2.0, 1.0]), (1350, [3e6] * 6), (1351, [-3e6] * 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = mips.top_k(df, df.filter(F.col("vec_id") % 50 == 0), 5, bucket_rows=64, query_rows=8).collect()
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == plain_top(rows, lambda q: q % 50 == 0, 5)
    assert mips.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_pruning_is_used_and_exact():
    g = np.random.default_rng(2)
    b = mips.Bucket(np.arange(2000), (g.normal(size=(2000, 8)) * 200).astype(np.int64))
    q = b.rows[5] * 2
    full = mips.search(b, -1, q, 5, mips.NONE)
    least = full[-1][1]
    kept = mips.candidates(b, q, float(np.linalg.norm(q)), least)
    assert len(b.ids[kept]) < len(b.ids) // 2 and mips.search(b, -1, q, 5, least) == full
