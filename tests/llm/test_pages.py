"""URL, page and vector operators, and the pipeline, against brute force and by hand."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html, urls, vectors

# -- URLs


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def brute_rule(host, path):
    best = (None, None)
    for verdict, rule in urls.RULES:
        name, slash, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest) and len(rule) > len(best[1] or ""):
            best = (verdict, rule)
    return best


URLS = ["http://A.Example.NET/en/1", "http://example.net/en", "http://x.net", "http://x.net/", "https://a.b.example.com/de/x?q=/fr/", "http://q.org/fr/#x",
        "http://norg/fr/", "mailto:x@y.net", None, "", "ftp://", "http://ÄB.org/fr/é", "http://a.net/x://b.org/fr/", "HTTP://bestcasinowin.com/play"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, None if i % 4 == 0 else "<title>best play win online words</title>") for i, u in enumerate(URLS)]
    rows += [(100 + i, f"http://casino{w}.com/win/{i}", "") for i, w in enumerate(("win", "play", "best", "online") * 5)]
    rows += [(200 + i, f"http://words{w}.com/en/{i}", "<title>play words</title>") for i, w in enumerate(("words", "online") * 30)]
    rows += [rows[0], rows[0], (None, "http://x.net/", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("x")).withColumn("host", F.lit(3))


def test_urls(pages):
    rows = pages.collect()
    got = urls.judge_urls(pages).collect()
    assert Counter((r.page_id, r.host, r.path) for r in got) == Counter((r.page_id, *brute_split(r.url)) for r in rows)
    for r in got:
        verdict, rule = brute_rule(r.host, r.path)
        assert r.rule == rule and (rule is None or r.verdict == verdict)
        if rule is None:
            assert r.verdict == ("block" if r.score >= 0.5 else "allow")
    found = {r.page_id: r for r in got}
    assert found[100].words.split()[:3] == ["casino", "win", "com"] and found[100].verdict == "block"
    assert found[13].verdict == "block"  # its name is made of words of unwanted hosts
    assert all(found[200 + i].verdict == "allow" for i in range(60))


def test_every_word_counts(spark):
    """Names are cut by all words of the table, the rare and the long too, and unseen parts stay whole."""
    import random
    rng = random.Random(4)
    rare = sorted({"".join(rng.choice("bcdfghklmnprtvwz") for _ in range(7)) for _ in range(205_000)})
    long = "donaudampfschifffahrtsgesellschaft"
    titles = [" ".join(rare[i:i + 1000]) for i in range(0, len(rare), 1000)] + [f"{long} {rare[0]} {rare[0]}"]
    rows = [(i, f"http://h.org/{i}", f"<title>{t} {t}</title>") for i, t in enumerate(titles[:-1])] + [(900, "http://h.org/", f"<title>{titles[-1]}</title>")]
    rows += [(1000, f"http://{rare[-1]}{rare[-2]}.org/", ""), (1001, f"http://{long}{rare[0]}.org/", ""), (1002, f"http://{'q' * 60}.org/", None)]
    found = {r.page_id: r.words.split() for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1000] == [rare[-1], rare[-2], "org"] and found[1001] == [long, rare[0], "org"] and found[1002] == ["q" * 60, "org"]


def test_segments_against_the_whole_lexicon(spark):
    """Parts cut with their own pieces come out as with all words, the long ones and those that share a beginning too."""
    import random

    rng = random.Random(3)
    stem = "abcdefghijklmnopqrstuvwx"
    counts = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))): rng.randrange(1, 50) for _ in range(80)}
    counts |= {stem: 3, f"{stem}yz": 4, f"{stem}yzabc": 9, f"{stem}unheld": 50, "ab" * 40: 2}
    names = ["".join(rng.choice(list(counts) + ["q", "zz"]) for _ in range(rng.randrange(1, 9))) for _ in range(60)] + [f"a{stem}yzabcb", "ab" * 130]
    brute = urls.Segmenter(counts)
    lexicon = spark.createDataFrame(list(counts.items()), "w string, n long")
    got = urls.segments(spark.createDataFrame([(n,) for n in set(names)], "part string"), lexicon).collect()
    assert {r.part: r.words for r in got} == {n: brute.words(n) for n in names}
    assert brute.words(f"a{stem}yzabcb") == ["a", f"{stem}yzabc", "b"]


def test_urls_of_very_long_parts(spark):
    import random

    rng = random.Random(8)
    runs = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (500, 2_000, 20_000, 100_000)]
    rows = [(i, f"http://h.org/{run}", None) for i, run in enumerate(runs)] + [(9, f"http://{runs[-1]}.com/x", None)]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 5 and all(got[i].path == f"/{run}" and got[i].verdict == "allow" for i, run in enumerate(runs))
    assert got[9].words.split()[:2] == [runs[-1], "com"]


def test_no_urls(pages):
    assert urls.judge_urls(pages.filter("1 = 0")).count() == 0


def test_segments():
    cut = urls.Segmenter({"the": 50, "there": 10, "rest": 9, "rent": 5, "re": 8, "st": 4})
    assert cut.words("therest") == ["the", "rest"] and cut.words("thererent") == ["there", "rent"]
    assert "".join(cut.words("q" * 300)) == "q" * 300 and cut.words("") == []


# -- pages

NAV = "<nav><ul><li><a href=/a>Home</a></li></ul></nav>"


@pytest.mark.parametrize(("page", "text"), [
    ("", ""), ("just words &amp; more", "just words & more"),
    (f"{NAV}<article><h1>A&nbsp;b</h1><p><b>one<br>two<p>three\n <i>x</i>y</article><footer>f</footer>", "A b\none two\nthree xy"),
    ("<main><p>keep</p><div class='comments'><p>no</div><aside>no</aside><form>no<input></form><p>this</p></main>", "keep\nthis"),
    ("<article><script>var a = '</article><p>'</script><style>p{}</style><p>a &lt;b&gt; &copy; &#233; &bogus; &amp</p>", "a <b> © é &bogus; &"),
    ("<article><p>an unfinished <b", "an unfinished"), ("<article><!-- <p>no --><p>x<!-- open", "x"),
    ("<div id='cookie-notice'><p>no</p></div><p>yes</p><header>no</header>", "yes"),
    ("<article><p>a</p></article><p>between</p><article><p>b</p></article>", "a\nb"), ("<article></article><p>x</p>", "x"),
])
def test_one_page(spark, page, text):
    got = html.extract_text(spark.createDataFrame([(1, "http://h.org/", page)], "page_id long, url string, html string")).first()
    assert (got.text, got.n_chars) == (text, len(text))


@pytest.mark.parametrize(("page", "text"), [
    ('<body class="has-sidebar logged-in admin-bar cookie-consent"><article class="post no-comments"><p>whole</p></article></body>', "whole"),
    ('<html class="no-menu"><body class="sidebar"><p>plain</p><div class="sidebar">no</div></body></html>', "plain"),
    ('<div class="layout with-sidebar"><p>text</p><article class="comment">no</article></div>', "text"),
    ('<aside><article><p>teaser</p></article></aside><div><p>real text</p></div>', "real text"),
    ('<div class="sidebar"><article><p>teaser</p></article></div><div><p>real text</p></div>', "real text"),
    ('<form id="aspnetForm"><main class="menu-open"><p>in a form</p></main></form>', "in a form"),
    ("<article><p>let <math><mi>x</mi><annotation encoding='t'>no</annotation></math> be</p><noscript><p>told</p></noscript>"
     "<object data=a><p>instead</p></object></article>", "let x be\ntold\ninstead"),
])
def test_text_is_not_left_out(spark, page, text):
    """Classes that tell of the page's state, articles that are left out, and elements with text of their own."""
    got = html.extract_text(spark.createDataFrame([(1, "http://h.org/", page)], "page_id long, url string, html string")).first()
    assert got.text == text


@pytest.mark.parametrize(("page", "text"), [
    ('<article><img alt="a > b" src=x>Hello<a title=\'x > "y"\' href=/>there</a></article>', "Hellothere"),
    ('<article><p title="never closed>one</p><p>two</p></article>', "one\ntwo"), ("<article><p don't>x</p><p it's>y</p></article>", "x\ny"),
    ('<article><p title = "1>2">x<br title="</p>">y', "x y"),
    ('<article><div class="entry share-your-story"><p>a</p></div><div class="post-header"><h1>Title</h1></div><h2 id="related-work">Related</h2></article>',
     "a\nTitle\nRelated"),
    ('<article><p title="the hidden truth" data-x="y class=sidebar z">kept</p><p hidden>no</p><p aria-hidden="TRUE">no</p></article>', "kept"),
    ('<article><p>a</p><div class="comment-list">no</div><div class="site-footer2">no</div><div id="ad_slot_3">no</div><div class="x ad">no</div>'
     '<section class="related-posts">no</section><div class="cookie-notice">no</div><p>b</p></article>', "a\nb"),
    ("<article><p " + "a=" * 200_000 + ">x</p>" + '<p b="' * 20_000, "x"),
])
def test_quoted_attributes_and_class_words(page, text):
    assert "\n".join(t for t, inside, out in html.blocks(page) if inside and not out) == text


def test_host_boilerplate(spark):
    """Pages without a marked article lose what other pages of the host have too, and nothing else."""
    shared = "<p>All rights reserved by the people who run this site, and so on.</p>"
    rows = [(i, f"http://h.org/{i}", f"{shared}<p>Story number {i} is told here in its own words {i * 7919}, at some length {i * i}.</p>{shared}") for i in range(40)]
    rows += [(90, "http://other.org/", f"{shared}<p>alone</p>"), (91, "http://h.org/x", f"<article>{shared}</article>"), (92, None, None),
             (93, "http://twice.org/", f"{shared}{shared}"), (94, "http://copy.org/", shared), (94, "http://copy.org/", shared)]
    got = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    plain = re.sub("<[^>]*>", "", shared)
    assert len(got) == len(rows)
    assert all(text[i] == f"Story number {i} is told here in its own words {i * 7919}, at some length {i * i}." for i in range(40))
    assert text[90] == f"{plain}\nalone" and text[91] == plain and text[92] == "" and text[93] == f"{plain}\n{plain}" and text[94] == plain


def test_copies_and_headlines(spark):
    """Copies and a print version of a story keep it, and so does a page whose headline others list as related."""
    story = "<p>The whole story of the bridge over the river, told once and in full.</p>"
    notice = "<p>All rights reserved by the people who run this site, and so on.</p>"
    head = "<h1>Mayor opens the new bridge over the river after ten long years</h1>"
    own = lambda i: f"<p>What page {i} says in its own words {i * 7919} about number {i * i}, at length.</p>"
    rows = [(1, "http://h.org/s", story + notice), (2, "https://h.org/s", story + notice), (3, "http://h.org/s?utm=1", story + notice),
            (4, "http://h.org/print", story + notice + own(4)), (5, "http://h.org/m", head + own(5) + notice)]
    rows += [(i, f"http://h.org/{i}", f"{own(i)}{notice}<aside>{head}</aside>") for i in range(10, 30)]
    rows += [(i, f"http://h.org/{i}", f"{own(i)}{notice}{head if i == 40 else ''}{notice}") for i in range(40, 60)]
    rows += [(60, "http://one.org/a", story), (61, "http://one.org/b", story), (62, "http://one.org/c", story)]
    got = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text, plain = {r.page_id: r.text for r in got}, lambda t: re.sub("<[^>]*>", "", t)
    assert text[1] == text[2] == text[3] == text[60] == text[61] == text[62] == plain(story)
    assert text[4] == f"{plain(story)}\n{plain(own(4))}" and text[5] == f"{plain(head)}\n{plain(own(5))}"
    assert text[40] == f"{plain(own(40))}\n{plain(head)}"
    assert all(text[i] == plain(own(i)) for i in [*range(10, 30), *range(41, 60)])


def test_strings_decide_in_marked_articles(spark):
    """Under a class that leaves it open, a block goes where the host's pages hold it too; plain repeated passages stay."""
    line = "Share this story with all your friends and tell us what you think."
    own = lambda i: f"What page {i} says in its own words {i * 7919} about number {i * i}, at length."
    page = "<article><p>{line}</p><p>{own}</p><div class='share-your-story'><p>{asked}</p></div></article><p>beside</p>"
    rows = [(i, f"http://h.org/{i}", page.format(line=line, own=own(i), asked=line if i % 2 else own(i + 100))) for i in range(20)]
    rows += [(50, "http://one.org/", page.format(line=line, own=own(50), asked=line)), (51, "http://h.org/u", f"<p>{line}</p><p>{own(51)}</p>")]
    text = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(text[i] == "\n".join([line, own(i)] + ([] if i % 2 else [own(i + 100)])) for i in range(20))
    assert text[50] == f"{line}\n{own(50)}\n{line}" and text[51] == own(51)


def test_frames_of_hosts_that_ask_nothing_are_not_shuffled(spark, monkeypatch):
    rows = [(i, f"http://h{i % 7}.org/{i}", "<article><p>" + " ".join(str(i * k * 7919) for k in range(400)) + "</p></article>") for i in range(60)]
    rows += [(90, "http://open.org/", "<p>one</p>")]
    plans, stored = {}, html.stored

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(html, "stored", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        got = html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
        assert got.count() == 61 and "BroadcastHashJoin" in plans["hosts"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_pages(pages):
    assert html.extract_text(pages.filter("1 = 0")).count() == 0


# -- vectors


def brute_nearest(rows, k, every):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array([i for i, _ in sorted(usable)])
    x = np.array([v for _, v in sorted(usable)])
    out = []
    for q, v in sorted(usable):
        if q % every == 0:
            score = x @ np.array(v) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt(np.dot(v, v)))
            order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != q][:k]
            out += [(q, n + 1, int(ids[j]), round(float(score[j]), 9)) for n, j in enumerate(order)]
    return out


def vector_rows():
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(300)]
    rows += [(300 + i, rows[50][1]) for i in range(200)]  # one very common vector
    rows += [(600 + i, [x + 0.01 * float(rng.standard_normal()) for x in rows[0][1]]) for i in range(50)]
    bad = [None, [0.0] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], [1.0, 2.0], []]
    return rows + [(1000 + 50 * i, v) for i, v in enumerate(bad)] + [(None, rows[3][1]), rows[7], rows[7]]


@pytest.mark.parametrize("block", [1 << 15, 64])
def test_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in vectors.nearest(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(brute_nearest(rows, 5, 50))


def test_tied_vectors(spark, monkeypatch):
    """Scaled copies and one-hot vectors: of equal cosines the smaller ids, though every vector differs."""
    monkeypatch.setattr(vectors, "BLOCK", 64)
    scaled = [(i, [float(2 ** (i % 40)) * x for x in (1.0, 2.0, -1.0, 0.5, 3.0, 1.0)]) for i in range(40)]
    hot = [(100 + i, [float(2 ** (i // 6)) if j == i % 6 else 0.0 for j in range(6)]) for i in range(120)]
    rows = scaled[::-1] + hot[::-1] + [(1000, [0.0, 0.0, 0.0, 0.0, 0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in vectors.nearest(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == sorted(brute_nearest(rows, 5, 50))
    assert [g[2] for g in sorted(got) if g[0] == 0] == [1, 2, 3, 4, 5]


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = vectors.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got)] == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert vectors.nearest(df.filter("1 = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_hilbert_keys_visit_neighbours():
    side = np.arange(16)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = vectors.hilbert_keys(cells, 4)
    assert sorted(keys.tolist()) == list(range(16 ** 3))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_windows_alone_find_close_neighbours(spark):
    """Clusters are what orderings find; isolated queries need the exact pass."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.05 * rng.standard_normal(16)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = F.col("vec_id") % 50 == 0
    exact = {(r.query_id, r.vec_id) for r in vectors.nearest(df, ask).collect()}
    fast = {(r.query_id, r.vec_id) for r in vectors.nearest(df, ask, exact=False).collect()}
    assert len(exact & fast) / len(exact) > 0.9


# -- pipeline


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.filter("1 = 0"), sf).count() == 0
    assert cp.STAGES[-1][1](spark, docs.filter("1 = 0"), sf).count() == 0


def test_near_duplicate_stage_keeps_one_of_each(spark):
    import corpus_pipeline as cp

    text = " ".join(f"w{k}" for k in range(50))
    rows = [(5, text), (3, text + " x"), (3, text + " x"), (9, "other words"), (None, text), (None, text), (8, None), (7, "")]
    got = cp.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert Counter(tuple(r) for r in got) == Counter([(3, text + " x"), (9, "other words"), (None, text), (8, None), (7, "")])


def test_pipeline_on_whole_tables(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    got = cp.run(spark, sf).collect()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in got}
    assert not any(labels[i].quality == 0 for i in left if i in labels)
    assert 0 < len(left) < spark.read.parquet(f"{sf}/documents.parquet").count()
