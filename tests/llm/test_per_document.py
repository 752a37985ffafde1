"""Pages, URLs, fingerprints and quality rules."""

import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnfold.llm import html_mincut, robust_quality, scaled_sketch, url_rules
from tarnfold.llm.common import Scratch, WordHashes, shingle_set
from tests.llm.helpers import PAGES, docs, odd_rows, prose, records

PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body class="page"><header><a href=/>Home</a><h2>Site name</h2></header>
<nav class="menu"><ul><li><a href="/a">Alpha</a><li><a href="/b">Beta</a></ul></nav><div class='cookie-notice'>We use cookies for many good reasons, please accept all of them now.</div>
<main><article><h1>A &amp; B&nbsp;title</h1><p>First paragraph   of some
length, with a <a href="/x">link</a> &lt;inside&gt; and more words to read.</p><p>Short.<p><b>Bold one.<br>after break
<div class="advert">Buy now a very nice thing that costs little and gives you much joy.</div><blockquote>Quoted words in the article itself.</blockquote>
<script>var x = "<p>never</p>";</script><aside>See also the other long story that we have about this same subject.</aside>
<table><tr><td>Cell one<td>Cell two</table><form><label>Your name</label><input><button>Send</button></form></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I am a reader and I do not agree with anything that is said up here.</p></div></section></main>
<footer>&copy; 2024 Site &middot; all rights reserved by the owners</footer></body></html>"""


def test_a_page():
    assert html_mincut.main_text(PAGE).split("\n") == ["A & B title", "First paragraph of some length, with a link <inside> and more words to read.", "Short.", "Bold one. after break", "Quoted words in the article itself.", "Cell one", "Cell two"]


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>never closed", "</p></p>", "<p title='open>text</p>", "a < b > c", "<nav>x</nav>", "\x00<p>\x00", "<li>" * 3000])
def test_broken_pages_do_not_fail(page):
    assert isinstance(html_mincut.main_text(page), str)


def test_names_about_the_page_around():
    page = '<div class="wrap has-sidebar no-ads"><article class="post sidebar-right"><p>The body of the article is here and it is long enough.</p></article><article class="comment"><p>A reader writes something of about the same length here.</p></article><div class="sidebar"><p>Some other words that stand beside the article, in a column.</p></div></div>'
    assert html_mincut.main_text(page) == "The body of the article is here and it is long enough."


LONG = "An article that is long enough to be read as prose by all."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<head><title>t</title><body><article><p>{LONG}</article>", [LONG]), (f"<head><title>t<meta x><article><p>{LONG}", [LONG]), ("<p>One <svg width='1' /> two.</p><p>Three.</p>", ["One two.", "Three."]),
        ("<p>One <math/> two.<p>Three.<svg></svg>", ["One two.", "Three."]), ("<p>One <object data=x> two.</p><p>Three.</p>", ["One two.", "Three."]), ("<p>One <svg><g>x</g><svg>y</svg> z</svg> two.", ["One two."]),
        ("<p>One <svg width=1/><text>x<p>Two.<p>Three <svg>y</svg>.", ["One", "Two.", "Three ."]), ("<p>One <select><option>x<option>y<p>Two.", ["One", "Two."]), ("<p>One<script>x <p>Two.", ["One"]),
    ],
)
def test_elements_left_out(page, want):
    assert [b.text for b in html_mincut.blocks(page)] == want


@pytest.mark.parametrize("attrs, shown", [('class="overflow-hidden"', True), ('style="overflow:hidden"', True), ('aria-hidden="false"', True), ('data-x="hidden"', True), ("hidden", False), ('aria-hidden="true"', False), ("style='color:red; display : none'", False), ('style="visibility:hidden"', False)])
def test_hidden_elements(attrs, shown):
    for tag in ("div", "body", "main"):
        assert html_mincut.main_text(f"<{tag} {attrs}><article><p>{LONG}</p></article></{tag}>") == (LONG if shown else "")


def test_plain_text_and_long_pages():
    assert html_mincut.main_text("<p>Only one paragraph of text without any structure around it at all.") == "Only one paragraph of text without any structure around it at all."
    many = "<article>" + "<p>A paragraph that is long enough to be prose.</p>" * 5000 + "</article>"
    assert html_mincut.main_text(many).count("\n") == 4999


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 7), st.data())
def test_min_cut_is_minimal(n, data):
    w = data.draw(st.lists(st.integers(-5, 5), min_size=n, max_size=n))
    links = [(i, j, float(data.draw(st.integers(0, 4)))) for i in range(n) for j in range(i) if data.draw(st.booleans())]

    def price(labels):
        return sum(-x for x, s in zip(w, labels, strict=True) if s and x < 0) + sum(x for x, s in zip(w, labels, strict=True) if not s and x > 0) + sum(c for i, j, c in links if labels[i] != labels[j])

    best = min(price([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
    assert price(html_mincut.min_cut([float(x) for x in w], links)) == pytest.approx(best)


BITS = st.lists(
    st.sampled_from(
        ["<article>", "</article>", "<div>", "</div>", "<div class=ad>", "<p>", "</p>", "<nav>", "</nav>", "<ul>", "<li>", "</ul>", "<h2>", "<aside>", "</aside>", "<table><tr><td>", "</table>", "<a href=x>", "</a>", "Ok.", "More here", "A sentence of some length that reads like prose, to be kept."]
    ),
    max_size=24,
)


@settings(max_examples=150, deadline=None)
@given(BITS)
def test_extraction_is_the_cheapest_labelling(bits):
    """All labellings of a page tried: the text is that of the cheapest (ties: fewest blocks)."""
    page = html_mincut.parse("".join(bits))
    n = len(page.blocks)
    if n > 11:
        return
    own, links = [html_mincut.odds(b) for b in page.blocks], html_mincut.edges(page)

    def price(k):
        on = [k >> i & 1 for i in range(n)]
        return sum(abs(w) for w, x in zip(own, on, strict=True) if (w > 0) != x and w) + sum(c for i, j, c in links if on[i] != on[j])

    best = min(range(1 << n), key=lambda k: (round(price(k), 9), bin(k).count("1")))
    assert html_mincut.main_text("".join(bits)) == "\n".join(b.text for i, b in enumerate(page.blocks) if best >> i & 1)


def test_the_cut_decides():
    """Blocks that look like the other kind by themselves go with their neighbours."""
    prose_block = "<p>A paragraph of quite some length that surely is prose, and reads on for a while longer.</p>"
    soup = f"<div>{prose_block}<p>So.</p>{prose_block}<p>No.</p>{prose_block}</div>"
    page = html_mincut.parse(soup)
    assert [html_mincut.odds(b) > 0 for b in page.blocks] == [True, False, True, False, True]
    assert html_mincut.labels(page) == [True] * 5
    entry = "<li>Home and garden news of the week</li>"
    menu = f"<div><ul>{'<li><a href=/x>Item of the menu</a></li>' * 3}{entry}{'<li><a href=/x>Item of the menu</a></li>' * 3}</ul></div><div>{prose_block * 2}</div>"
    page = html_mincut.parse(menu)
    assert [html_mincut.odds(b) > 0 for b in page.blocks] == [False] * 3 + [True] + [False] * 3 + [True] * 2
    assert html_mincut.labels(page) == [False] * 7 + [True] * 2


def test_planted_articles():
    """Pages put together from known parts: exactly the article comes back."""
    rng = random.Random(9)
    for _ in range(200):
        parts = [prose(rng, rng.choice([1, 2, 6, 30, 80])) for _ in range(rng.randrange(2, 9))]
        parts = [" ".join(x.split()) for x in parts]
        junk = [f"<nav><ul>{''.join(f'<li><a href=/{i}>{prose(rng, 2)}</a>' for i in range(5))}</ul></nav>", f'<div class="ad">{prose(rng, 12)}</div>', f"<aside><p>{prose(rng, 25)}</p></aside>", f"<form><label>{prose(rng, 3)}</label><input></form>", f'<div class="cookie-banner">{prose(rng, 20)}</div>']
        inner = []
        for x in parts:
            inner.append(f"<p>{x}</p>" if rng.random() < 0.7 else f"<p><b>{x}")
            if rng.random() < 0.2:
                inner.append(rng.choice(junk[1:]))
        page = f"<html><head><title>t</title></head><body>{rng.choice(junk)}<article><h1>A title of it</h1>{''.join(inner)}</article>{rng.choice(junk)}<footer>&copy; {prose(rng, 8)}</footer>"
        assert html_mincut.main_text(page) == "\n".join(["A title of it", *parts])


@pytest.mark.parametrize("page", ["<div>x " * 50_000, "<div>" * 50_000 + "</section>" * 50_000 + "x", "<center><li>" * 25_000 + "x"])
def test_deep_nesting_takes_little_memory(page):
    tracemalloc.start()
    try:
        html_mincut.main_text(page)
        assert tracemalloc.get_traced_memory()[1] < 150 << 20
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("attrs", ["class=it's", "title='open", 'title="open', "it's", 'x="a>b"', "x = 'a>b' y=\"'\""])
def test_stray_quotes_stay_in_the_tag(attrs):
    assert html_mincut.main_text(f"<article><p>{LONG}</p><p {attrs}>{LONG}</p></article>").split("\n") == [LONG, LONG]


def test_extract_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")]
    found = html_mincut.extract(spark.createDataFrame(rows, PAGES).selectExpr("*", "'t' as text", "1 as n_chars"))
    n = len(html_mincut.main_text(PAGE))
    assert [(r["page_id"], r["n_chars"]) for r in found.orderBy("page_id").collect()] == [(None, 0), (1, n), (1, n), (2, 0)]
    assert html_mincut.extract(spark.createDataFrame([], PAGES)).count() == 0


URLS = [None, "", "no scheme.net/en/", "HTTP://A.Example.NET/en/x?q=1#f", "http://example.net", "http://example.net/", "http://notexample.com/de/", "http://x.example.com/de/a", "http://example.com/DE/", "https://b.org/fr/", "https://b.org/en/",
        "http://m.ads-track.example.com/es/1", "http://example.com/about/ads?x=/pagead/1", "http://example.com/pagead/1", "http://example.com/xpagead/1", "ftp://net?x", "://net/", "http://a.b://c.net/d", "http://example.org/x?SessionID=4", "http://example.com/ads/banner", "http://ÄX.net/É"]


def test_urls_against_brute_force(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(0, None, "h")]
    found = url_rules.judge(spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as host", "'y' as rule"))
    rules = [url_rules.parse_pattern(p) for p in url_rules.PATTERN_RULES]
    want = []
    for i, u, _ in rows:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(t), t, v) for v, t in url_rules.HOST_RULES for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        if fits:
            _, rule, verdict = max(fits)
        else:
            hits = [r for r in rules if re.search(r.regex, (u or "").lower())]
            rule, verdict = None, "allow" if any(r.allow for r in hits) or not hits else "block"
        want.append((i, host, path, rule, verdict))
    assert records(found, "page_id", "host", "path", "rule", "verdict") == sorted(want, key=repr)
    assert {r[4] for r in want if r[3] is None} == {"allow", "block"}
    assert url_rules.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_families_of_bad_hosts(spark):
    """Labels by hand, not by the rules."""
    block = ["m.casino-win.example.com", "free-bets.example.com", "m.ads-track.example.com", "www.spam-farm.example.com", "www.cheap-pills.example.com", "blog.adult-x.example.org", "best-casino.example.org:8080", "user@Casino.example.com", "my-ads.example.org", "x_bets"]
    allow = ["casinova.example.com", "alphabets.example.org", "loads.example.com", "spammers.example.org", "anti-spam.example.org", "adulthood.example.com", "casino@example.com", "www.example.com", "adult-education.example.org"]
    rows = [(i, f"http://{h}/es/1", "h") for i, h in enumerate(block + allow)] + [(100, "http://news.example.com/best-casino/ads?bets=spam", "h")]
    found = {r["page_id"]: r["verdict"] for r in url_rules.judge(spark.createDataFrame(rows, PAGES)).collect()}
    assert [h for i, h in enumerate(block) if found[i] != "block"] == []
    assert [h for i, h in enumerate(allow) if found[len(block) + i] != "allow"] == [] and found[100] == "allow"


def test_patterns_are_indexed_by_their_rarest_token():
    rules = [url_rules.parse_pattern(p) for p in ("/ads/banner^", "||tracker.", "/cgi-bin/*.pl^")]
    assert rules[0].tokens == ("ads", "banner") and rules[2].tokens == ("cgi", "bin", "pl")
    index = url_rules.index_rules(rules, {"ads": 900, "banner": 3, "bin": 1, "cgi": 2, "pl": 5})
    assert set(index) == {"banner", "tracker", "bin"}
    with pytest.raises(ValueError):
        url_rules.parse_pattern("a*")


def test_sketches():
    rng, h = random.Random(2), WordHashes()
    a, b = prose(rng, 4000, 10**6), prose(rng, 4000, 10**6)
    x, y = (scaled_sketch.sketch(shingle_set(t, h)) for t in (a, a + " " + b))
    assert x.fraction == 4 and abs(len(x.hashes) - 1000) < 130
    assert scaled_sketch.containment(x, y) > 0.97 and abs(scaled_sketch.containment(y, x) - 0.5) < 0.06
    assert abs(scaled_sketch.likeness(x, y) - 0.5) < 0.06 and 0.005 < scaled_sketch.error(x, y) < 0.03
    z = scaled_sketch.sketch(shingle_set(b, h))
    both = scaled_sketch.merge(x, z)
    assert scaled_sketch.containment(x, both) == 1 and scaled_sketch.containment(z, both) == 1
    # The same fraction for short texts; equal sets are known by name, others that retain nothing aren't alike.
    tiny = [scaled_sketch.sketch(shingle_set(f"word{i}", h)) for i in range(40)]
    assert 0 < sum(len(t.hashes) for t in tiny) < 25 and all(t.fraction == 4 for t in tiny)
    assert all((scaled_sketch.likeness(s, t) == 1) == (i == j) for i, s in enumerate(tiny) for j, t in enumerate(tiny))
    bare = [t for t in tiny if not len(t.hashes)]
    assert scaled_sketch.error(bare[0], bare[1]) == 0.5 and scaled_sketch.error(bare[0], bare[0]) == 0
    for s in (x, both, tiny[0], scaled_sketch.sketch(np.zeros(0, np.uint64))):
        t = scaled_sketch.parse(scaled_sketch.write(s))
        assert t[:2] == s[:2] and (t.hashes == s.hashes).all()


def brute_shingles(text):
    """Hashes of 5-word shingles, one after the other, in plain integers."""
    consts = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
    words = [xxhash.xxh3_64_intdigest(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())]
    n, out = min(5, len(words)), set()
    for i in range(len(words) - n + 1 if words else 0):
        v = n
        for k in range(n):
            v = (v + ((words[i + k] * consts[k] & 2**64 - 1) ^ (k + 1))) & 2**64 - 1
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            v = (v ^ (v >> 33)) * m & 2**64 - 1
        out.add(v ^ (v >> 33))
    return out


def brute_likeness(a, b):
    a, b = brute_shingles(a), brute_shingles(b)
    x, y = ({h for h in s if h < 2**64 // 4} for s in (a, b))
    return 1.0 if a == b else len(x & y) / len(x | y) if x | y else 0.0


def test_followers(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i * 3 % 101, prose(rng, 17 * (i % 9), 900)) for i in range(101)] + [(None, "first of all"), (50, "a tie"), (50, "a tie"), (77, None)] + [(60, prose(rng, 40)) for _ in range(30)]
    path = str(tmp_path)
    frame = docs(spark, rows).repartition(5)
    frame.write.parquet(f"{path}/documents.parquet")
    hashes = {r["t"]: r["h"] for r in frame.selectExpr("coalesce(text, '') as t", "xxhash64(coalesce(text, '')) as h").collect()}
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""]))
    found = scaled_sketch.op9_scaled_sketch(spark, path)
    texts = [r[1] or "" for r in rows]
    want = []
    for k, r in enumerate(rows):
        after = texts[(k + 1) % len(texts)]
        changed = scaled_sketch.edited(texts[k], after)
        prints = [f"4:{h[0]:016x}:" + "".join(f"{x:016x}" for x in sorted(h[1])) for h in ((xxhash.xxh3_64_intdigest(np.array(sorted(s), np.uint64).tobytes()), [x for x in s if x < 2**62]) for s in map(brute_shingles, (texts[k], changed)))]
        want.append((r[0], len(texts[k]), hashlib.sha256(changed.encode()).hexdigest(), *prints, brute_likeness(texts[k], changed), brute_likeness(texts[k], after)))
    assert records(found, "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next") == sorted(want, key=repr)
    for rows in ([(1, "alone")], []):
        docs(spark, rows).write.mode("overwrite").parquet(f"{path}/documents.parquet")
        assert scaled_sketch.op9_scaled_sketch(spark, path).count() == len(rows)


def test_a_doc_id_of_many_rows_is_split():
    assert scaled_sketch.range_cuts([3, 7, 7, 9]) == [(3, -(2**63)), (7, -(2**63)), (7, 0), (9, -(2**63))]


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("ab \n\t#|é\xa0")), max_size=60))
def test_text_stats(text):
    assert robust_quality.text_stats(text, WordHashes())[:5] == brute_stats(text)


def test_quality_verdicts(spark):
    rng = random.Random(4)
    rows = [(5000 + i, prose(rng, 60 + i % 200), f"s{i % 3}") for i in range(400)]
    rows += [(1000 + i, " ".join(f"{w}###" for w in prose(rng, 100).split()), "s0") for i in range(20)]
    rows += [(2000 + i, "spam ham jam " * 40, "s1") for i in range(5)]
    rows += odd_rows()
    found = robust_quality.score(docs(spark, rows), ["doc_id"]).collect()
    assert len(found) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in found}
    assert all(kept[5000 + i] for i in range(400)) and not any(kept[1000 + i] for i in range(20)) and not any(kept[2000 + i] for i in range(5))
    texts = {r[0]: r[1] for r in rows if r[0] is not None and r[0] != 8}
    for r in found:
        if r["doc_id"] in texts:
            base = brute_stats(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
            assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
    good = robust_quality.keep_good(docs(spark, rows))
    assert sorted((r["doc_id"], r["name"]) for r in good.collect()) == sorted((r["doc_id"], "x") for r in found if r["kept"])
    assert robust_quality.score(docs(spark, []), ["doc_id"]).count() == 0
    assert robust_quality.score(docs(spark, odd_rows()[:4]), ["doc_id"]).where("kept").count() == 0


def brute_mcd(x):
    """Concentration steps over sorted distances, from three starts, to the least determinant."""
    floor = np.array([f[1] for f in robust_quality.FEATURES.values()])
    q = np.array([np.sort(x, axis=0)[max(0, math.ceil(p * len(x)) - 1)] for p in (0.25, 0.5, 0.75)])
    scale = np.sqrt(((q[2] - q[0]) / 1.349) ** 2 + floor**2)
    t = np.tanh((x - q[1]) / scale)
    t = t - t.mean(axis=0)
    spread = np.sqrt(np.maximum((t**2).mean(axis=0), 1e-12))
    corr = t.T @ t / len(x) / np.outer(spread, spread)
    np.fill_diagonal(corr, 1)
    best = (np.inf, None, None)
    for centre, scatter in ((q[1], np.diag(scale**2)), (x.mean(axis=0), np.cov(x.T, bias=True) + np.diag(floor**2)), (q[1], corr * np.outer(scale, scale) + np.diag(floor**2))):
        last = np.inf
        while True:
            d = np.einsum("ni,ij,nj->n", x - centre, np.linalg.inv(scatter), x - centre)
            core = x[np.argsort(d, kind="stable")[: math.ceil(0.75 * len(x))]]
            new = np.cov(core.T, bias=True) / robust_quality.CONSISTENCY + np.diag(floor**2)
            now = np.linalg.slogdet(new)[1]
            if now >= last - 1e-9:
                break
            centre, scatter, last = core.mean(axis=0), new, now
        if last < best[0]:
            best = (last, centre, scatter)
    return best


def vectors(spark, groups):
    rows = [(lang, source, *map(float, r)) for (lang, source), x in groups.items() for r in x]
    return spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{c} double" for c in robust_quality.FEATURES))


def test_mcd_against_brute_force(spark):
    rng = np.random.default_rng(0)
    mix = rng.normal(0, 0.4, (5, 5)) + np.eye(5)
    groups = {("en", "a"): np.concatenate([rng.normal(0, 1, (300, 5)) @ mix, rng.normal(9, 0.1, (60, 5))]), ("en", "b"): rng.normal(3, 1, (40, 5)), ("de", None): rng.normal(-2, 1, (7, 5)), (None, "a"): rng.normal(0, 1, (1, 5))}
    found = {r["key"]: r for r in robust_quality.fit(vectors(spark, groups), Scratch(spark, "t")).collect()}
    every = np.concatenate(list(groups.values()))
    sets = {"all": every, '{"level":1,"lang":"en"}': np.concatenate([groups["en", "a"], groups["en", "b"]]), '{"level":0,"lang":"en","source":"a"}': groups["en", "a"], '{"level":0,"lang":"en","source":"b"}': groups["en", "b"], '{"level":0,"lang":"de"}': groups["de", None]}
    assert len(found) == 8 and {r["size"] for r in found.values()} == {408, 400, 7, 1, 360, 40}
    for key, x in sets.items():
        logdet, centre, scatter = brute_mcd(x)
        r = found[key]
        assert r["size"] == len(x) and r["logdet"] < logdet + (0.15 if len(x) > 100 else 0.6), (key, r["logdet"], logdet)
        if len(x) > 100:
            assert np.abs(np.array(r["centre"]) - centre).max() < 0.1
            assert np.abs(np.array(r["scatter"]).reshape(5, 5) - scatter).max() < 0.25
    core = found['{"level":0,"lang":"en","source":"a"}']  # the far cluster has no part in it
    assert np.abs(np.array(core["centre"])).max() < 0.4 and 0.6 < np.trace(np.array(core["scatter"]).reshape(5, 5)) / np.trace(mix.T @ mix) < 1.3


def test_verdicts_against_brute_force(spark):
    """kept of every text, but for distances close to the limit."""
    rng = random.Random(6)
    rows = [(i, prose(rng, 60 + i % 150, 60 if i % 3 else 3000), f"s{i % 4}") for i in range(260)]
    rows += [(1000 + i, " ".join(f"{w}#" if k % (2 + i % 9) == 0 else w for k, w in enumerate(prose(rng, 120).split())), f"s{i % 4}") for i in range(40)]
    rows += [(2000 + i, prose(rng, 90), f"small{i // 3}") for i in range(12)]
    found = {r["doc_id"]: r for r in robust_quality.score(docs(spark, rows), ["doc_id"]).collect()}
    h, x = WordHashes(), {}
    for i, text, source in rows:
        n, chars, symbols, dup, repeat, lines, types = robust_quality.text_stats(text, h)
        if n >= 50 and 100 * repeat <= 50 * n:
            x[i] = (source, np.array([math.log(chars / n), math.sqrt(symbols / n), math.sqrt(dup / max(lines, 1)), math.sqrt(repeat / n), math.log(types / n**0.85)]))
    every = brute_mcd(np.array([v for _, v in x.values()]))
    close = 0
    for source in {s for s, _ in x.values()}:
        mine = np.array([v for s, v in x.values() if s == source])
        centre, scatter = every[1:]
        for part in (np.array([v for _, v in x.values()]), mine):  # one language: it is the whole corpus
            w = len(part) / (len(part) + 50)
            _, c, s = brute_mcd(part)
            centre, scatter = w * c + (1 - w) * centre, w * s + (1 - w) * scatter
        for i, (s, v) in x.items():
            if s == source:
                d = float((v - centre) @ np.linalg.inv(scatter) @ (v - centre))
                if 0.6 < d / robust_quality.CUTOFF < 1.6:
                    close += 1
                else:
                    assert found[i]["kept"] == (d <= robust_quality.CUTOFF), (i, d, found[i])
    assert close < 0.1 * len(x) and 10 < sum(not r["kept"] for r in found.values()) < 60
    assert not any(found[i]["kept"] for i, _, _ in rows if i not in x)
