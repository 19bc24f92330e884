"""HTML extraction, WARC round trip and nearest neighbours against plain Python."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridload.llm import ann, page_text, warc

SCHEMA = "page_id long, url string, html string, host string, text string, keys int, blocks int, rid int, digest string, head int, copy int, run string, at int"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 10) for r in rows], SCHEMA)


PAGES = [
    ("<p>a<b>b</p>c</b> d<br>e", "ab c d e"),
    ("", ""), (None, ""),
    ('<nav>x</nav><header>y</header><article><h1>T &amp;amp; U</h1><p>one\n two<p>three<div class="comments"><p>no</p></div></article><footer>z</footer>', "T &amp; U one two three"),
    ("<article><p>x<script>var a='</p>'</script>y</p></article>tail <a href='q", "x y".replace(" ", "")),
    ("<main><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><form><p>mail</form></main>", "a b 1 2"),
    ("<article><p>cut &lt;b&gt; off <em>here", "cut <b> off here"),
    ("<article><div class='cookie-notice'>We use cookies</div><p>&eacute;t&#233; &unknown; &copy</article>", "été &unknown; ©"),
    ('<article><p hidden>h</p><p style="display: none">i</p><p>ok</p></article>', "ok"),
    ("<b>" * 3000 + "deep", "deep"),
    ("<article><p>" + "long " * 50_000 + "</article>", " ".join(["long"] * 50_000)),
    ('<article><p class="x>open quote</p><p>next</p></article>', "open quote next"),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_parse(html, want):
    blocks, _, _ = page_text.parse_page(html or "")
    assert " ".join(blocks) == want


@pytest.mark.parametrize("html,want", [
    ("<div><article>a" + "<div>" * 600 + "b" + "</div>" * 600 + "<p>rest</p></article></div><p>no</p>", "a b rest"),
    ("<article>" + "<div>" * 600 + "<nav>menu</nav>b</article>", "b"),
    ("<article><p>a</p><nav data-x=" + "v" * 6000 + ">menu</nav><p>b</p></article>", "a b"),
    ("<i>" * 50_000 + "x</b>" * 50_000, " ".join(["x" * 50_000])),
])
def test_parse_of_deep_markup(html, want):
    assert " ".join(page_text.parse_page(html)[0]) == want


@pytest.mark.parametrize("html,want", [
    ("<div class='content with-sidebar'><p>Main text of it</p></div>", "Main text of it"),
    ("<main class='no-sidebar'><header class='post-header'><h1>Title</h1></header><p>body</p></main><footer>f</footer>", "Title body"),
    ("<div><div class='entry-header'><h1>Title</h1></div><p>body</p></div>", "Title body"),
    ("<article><section id='related-work'><p>earlier papers</p></section><p class='comment-on-policy'>a view</p>"
     "<p class='menu-item-description'>soup</p></article>", "earlier papers a view soup"),
    ("<form id='aspnetForm'><div class='menu'><a>m</a></div><article><p>body</p></article><div class='ad'>x</div></form>", "body"),
    ("<form id='aspnetForm'><div class='nav-links'><a>m</a></div><p>body</p></form>", "body"),
    ("<article><p>short</p></article><div class='comments'><article class='comment'><p>" + "long " * 99 + "</p></article></div>", "short"),
    ("<article><p>a</p><ul class='comment-list'><li>no</li></ul><div class='ad-slot'>no</div><div class='site-footer'>no</div></article>", "a"),
    ("<div class='site-header'><h1>Site</h1></div><article>a</article><aside><article>teaser</article></aside>", "a"),
    ("<div><h2>T</h2><p>the text itself</p></div><div class='related'><article>teaser</article></div>", "T the text itself"),
    ("<article><p>a</p><div class='related-articles'>no</div><div class='advertisement-300x250'>no</div><p class='share-buttons'>no</p></article>", "a"),
    ("<nav>n</nav><div class='newsletter'>only a form</div><p>text</p>", "text"),
])
def test_names_that_only_look_like_boilerplate(html, want):
    assert " ".join(page_text.parse_page(html)[0]) == want


def test_deep_boxes_with_text_stay_linear(spark):
    n = 20_000
    blocks, spans, keys = page_text.parse_page("<div>a " * n + "</div>" * n)
    assert len(blocks) == len(spans) == n and len(keys) == n
    assert page_text.without(["a", "b", "c", "d"], [(1, 3), (2, 3)]) == "a d"
    df = spark.createDataFrame([(1, "http://h/1", "<div>a " * n + "</div>" * n)], "page_id long, url string, html string")
    assert page_text.extract(df).first().text == " ".join(["a"] * n)


def test_template_subtrees_go_and_prose_stays(spark):
    rows = [(i, f"https://www.site.com/{i}", f"<div><p>Welcome to our site 12{i}</p></div><div><p>story {i}</p><p>body {i * 7} é</p></div>"[:200 if i else None]) for i in range(30)]
    rows = [(i, u, h.replace(f"12{i}", "2024").replace(f"story {i}", "story " + "abcdefghij"[i % 10] * (i + 1))
             .replace(f"body {i * 7}", "text " + "klmnopqrst"[i % 10] * (i + 1))) for i, u, h in rows]
    rows += [(100 + i, "http://other.org/x", "<article><p>Same words everywhere</p><p>" + "z" * (i + 1) + "</p></article>") for i in range(20)]
    rows += [(200, None, "<p>no url</p>"), (201, "http://[bad", None), (202, "http://lonely.net", "<div>Welcome to our site 2024</div>"), (202, "http://lonely.net", "<div>Welcome to our site 2024</div>")]
    got = page_text.extract(pages_of(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    for i in range(30):
        assert by[i] == "story " + "abcdefghij"[i % 10] * (i + 1) + " text " + "klmnopqrst"[i % 10] * (i + 1) + " é"
    for i in range(20):
        assert by[100 + i] == "Same words everywhere " + "z" * (i + 1)
    assert by[200] == "no url" and by[201] == "" and by[202] == "Welcome to our site 2024"
    assert page_text.extract(pages_of(spark, [])).count() == 0


def test_boxes_in_articles_are_counted_too(spark):
    def page(i, words):
        return (f"<article><h1>T {words}</h1><p>Same words everywhere</p><p>{words}</p><div class='x7'><p>Our letter, every {i} days</p></div>"
                f"<ul><li>{words}</li><li>both</li></ul></article>")
    name = lambda i: "abcdefghijklmnopqrst"[i] * 40
    rows = [(i, "http://a.org/x", page(i, name(i))) for i in range(20)]
    rows += [(100 + i, "http://b.org/x", page(1, "copy")) for i in range(20)]  # copies of one article
    rows += [(200 + i, "http://c.org/x", f"<main><p>Buy now</p><div><p>{name(i)}</p></div></main>") for i in range(20)]
    rows += [(300 + i, "http://d.org/x", f"<article><h1>{'abcdefghijklmnopqrst'[i]}</h1><div><p>body of the article</p></div></article>") for i in range(20)]
    by = {r.page_id: r.text for r in page_text.extract(pages_of(spark, rows)).collect()}
    assert len(by) == 80
    for i in range(20):
        assert by[i] == f"T {name(i)} Same words everywhere {name(i)} {name(i)} both"
        assert by[100 + i] == "T copy Same words everywhere copy Our letter, every 1 days copy both"
        assert by[200 + i] == name(i)
        assert by[300 + i] == f"{'abcdefghijklmnopqrst'[i]} body of the article"


def test_template_of_small_and_of_large_hosts(spark):
    words = [a + b for a in "abcdefghij" for b in "abcdefghij"]
    rows = [(i, "http://tiny.org/x", f"<div>All rights kept</div><div>{words[i]}</div>") for i in range(4)]
    rows += [(100 + i, "http://large.org/x", ("<div>Section of news</div>" if i < 12 else "") + f"<div>{w}</div>") for i, w in enumerate(words)]
    rows += [(300 + i, "http://pair.org/x", f"<div>On both pages</div><div>{words[i]}</div>") for i in range(2)]
    by = {r.page_id: r.text for r in page_text.extract(pages_of(spark, rows)).collect()}
    assert [by[i] for i in range(4)] == words[:4]
    assert [by[100 + i] for i in range(100)] == words
    assert by[300] == f"On both pages {words[0]}"


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(300):
        runs = [sorted(rng.choices(range(6), k=rng.randint(0, 5))) for _ in range(rng.randint(0, 9))]
        assert list(warc.merge_runs(runs)) == [(i, j) for _, i, j in sorted((v, i, j) for i, r in enumerate(runs) for j, v in enumerate(r))]


@pytest.mark.parametrize("least", [0, 40])
def test_archives_round_trip(spark, tmp_path, least):
    rows = [(i, f"http://h{i % 3}.com/p{i % 7}", ["<p>same é</p>", "", None, f"<p>{i}</p>" * 20, "WARC/1.1\r\n\r\nX: y\r\n\r\n"][i % 5]) for i in range(60)]
    rows += [(None, None, "<p>same é</p>"), (3, "http://h0.com/p3", rows[3][2]), (3, "http://h0.com/p3", rows[3][2]), (90, "http://x.org/a b\r\nc", "z" * 300_000)]
    got = warc.archive_and_index(pages_of(spark, rows), min_bytes=least, path=str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(h or "", i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= least and first[h or ""] != i
        want.append([i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None])
    if least == 0 or len(rows[3][2]) >= least:  # of the repeated rows one is the response
        extra = [w for w in want if w[0] == 3][1:]
        for w in extra:
            w[3:] = ["revisit", 3]
    key = lambda w: tuple((x is None, x if x is not None else 0) if not isinstance(x, str) else (False, x) for x in w)
    assert sorted((list(r) for r in ((g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) for g in got)), key=key) == sorted(want, key=key)
    parts = {}
    for g in got:
        parts.setdefault(g.part, []).append((g.urlkey, g.ts, g.page_id is None, g.page_id or 0))
    flat = [x for p in sorted(parts) for x in parts[p]]
    assert flat == sorted(flat)
    assert warc.archive_and_index(pages_of(spark, []), path=str(tmp_path / "none")).count() == 0


def brute(ids, vecs, asks, k):
    ok = [i for i, v in enumerate(vecs) if v is not None and ids[i] is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([vecs[i] for i in ok], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for a, i in enumerate(ok):
        if asks(ids[i]):
            s = m @ m[a]
            out[ids[i]] = [ids[ok[j]] for j in sorted((j for j in range(len(ok)) if j != a), key=lambda j: (-round(s[j], 12), ids[ok[j]]))[:k]]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(3)
    vecs = [list(map(float, v)) for v in rng.normal(size=(900, 12))]
    for i in range(40):
        vecs[100 + i] = list(vecs[100])  # equal vectors: ties go to the smaller id
    vecs[5], vecs[6], vecs[7], vecs[8] = None, [0.0] * 12, [None] + [1.0] * 11, [float("nan")] * 12
    ids = list(range(900))
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in zip(ids, vecs)] + [(None, vecs[0], 0, 0, 0)], "vec_id long, embedding array<double>, node int, vec int, sim int")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    want = brute(ids, vecs, lambda i: i % 20 == 0, 5)
    assert set(got) == set(want)
    hits = sum(len(set(want[q]) & {i for _, i, _ in got[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    assert [i for _, i, _ in sorted(got[120])] == [100, 101, 102, 103, 104]
    assert all([r for r, _, _ in sorted(g)] == [1, 2, 3, 4, 5] for g in got.values())


def test_nearest_in_a_group_of_nearly_equal_vectors(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=12)
    vecs = [list(map(float, v)) for v in (*(centre + 3e-5 * rng.normal(size=(2500, 12))), *rng.normal(size=(500, 12)))]
    vecs[2990:] = [[3.1 * x for x in vecs[2980]] for _ in range(10)]  # equal directions
    df = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 80).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    want = brute(list(range(3000)), vecs, lambda i: i % 100 == 80, 5)
    assert set(got) == set(want)
    assert sum(len(set(want[q]) & {i for _, i in got[q]}) for q in want if q < 2500) >= 0.98 * 5 * 25
    assert [i for _, i in sorted(got[2980])] == [2990, 2991, 2992, 2993, 2994]


def test_nearest_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], schema)
    assert sorted((r.query_id, r.id) for r in ann.nearest(two, F.lit(True)).collect()) == [(1, 2), (2, 1)]
    assert ann.nearest(spark.createDataFrame([(1, [1.0, 0.0])], schema), F.lit(True)).count() == 0
