"""Pure parts against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablescope.llm import arrays, byte_bpe, decontaminate, html_text, license_scan, quality_classifier, simhash, suffix_dedup, warc, window_dedup
from tablescope.llm.suffix_arrays import repeated, suffix_array

from . import brute

TEXT = st.one_of(st.binary(max_size=60).map(lambda b: bytes(97 + x % 3 for x in b)), st.text(max_size=40).map(str.encode))


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_suffix_array(data):
    assert suffix_array(np.frombuffer(data, np.uint8)).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 9), st.sampled_from([1, 4, 32]))
def test_repeated(data, n, every):
    valid = np.arange(len(data)) <= len(data) - n
    count = Counter(data[i : i + n] for i in range(len(data) - n + 1))
    want = [i <= len(data) - n and count[data[i : i + n]] > 1 for i in range(len(data))]
    assert repeated(np.frombuffer(data, np.uint8), valid, n, every).tolist() == want


def test_spans_and_minimum():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 100, 500).astype(np.uint8)
    spans, raw = arrays.Spans(buf), buf.tobytes()
    start = rng.integers(0, 480, 800)
    end = start + rng.integers(0, 20, 800)
    h = spans.hash(start, end)
    by = {}
    for s, e, x in zip(start.tolist(), end.tolist(), h.tolist()):
        assert by.setdefault(raw[s:e], x) == x
    assert len(set(by.values())) == len(by)
    n = np.minimum(end - start, 500 - start[::-1])
    same = arrays.equal_spans(arrays.eights(buf), start, start[::-1], n)
    assert same.tolist() == [raw[a : a + k] == raw[b : b + k] for a, b, k in zip(start.tolist(), start[::-1].tolist(), n.tolist())]
    x = rng.integers(0, 9, 60)
    for w in (1, 2, 3, 7, 60, 61):
        assert arrays.sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(60 - w + 1)]


@pytest.fixture(scope="module")
def vocabulary():
    path, pattern = byte_bpe.public_vocabulary()
    ranks = byte_bpe.load_ranks(path)
    import tiktoken

    return ranks, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(text=st.one_of(st.text(max_size=80), st.text("abcdefg ", max_size=200), st.sampled_from(["x" * 999, "=-" * 400, "\x1c\x1d\x85᠎​　 \xa0a", "日本語" * 90])))
def test_bpe_words(vocabulary, text):
    import regex

    ranks, pattern, own = vocabulary
    got = [i for w in regex.findall(pattern, text) for i in byte_bpe.encode_word(w.encode(), ranks)]
    assert got == own.encode_ordinary(text)
    for w in regex.findall(pattern, text):
        w = w.encode()
        assert byte_bpe._merge_short(w, ranks) == byte_bpe._merge_long(w, ranks)


def test_bit_majority():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 2, 7, 0, 300, 0]
    hashes = rng.integers(0, 1 << 63, sum(sizes), np.uint64) * np.uint64(2) + rng.integers(0, 2, sum(sizes), np.uint64)
    edge = np.concatenate([[0], np.cumsum(sizes)])
    want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[a:z]) > z - a) for a, z in zip(edge[:-1], edge[1:])]
    old, simhash.BLOCK = simhash.BLOCK, 64
    try:
        assert simhash.bit_majority(hashes, edge).tolist() == want
    finally:
        simhash.BLOCK = old


def test_forest_keeps_every_component():
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = np.unique(np.array([x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in base for _ in range(20)], np.uint64))
    a, b = prints[::2], prints[1::2]
    for left, right in ((a, b), (prints, prints)):
        root = {int(x): int(x) for x in prints}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        child, parent = simhash.forest(left, right, 3)
        assert len(child) < len(prints)
        for x, y in zip(child.tolist(), parent.tolist()):
            root[top(x)] = top(y)
        for x in left.tolist():
            for y in right.tolist():
                if (x ^ y).bit_count() <= 3:
                    assert top(x) == top(y)


def test_alignments():
    rng = random.Random(4)
    for _ in range(60):
        a = [rng.randrange(6) for _ in range(rng.randint(1, 14))]
        b = [rng.randrange(6) for _ in range(rng.randint(1, 30))]
        best = brute.smith_waterman(a, b)
        score, matched, s, e, s1, e1 = decontaminate.align(np.array(a), np.array(b))
        assert score == best and matched <= min(e - s, e1 - s1)
        score, places = license_scan.banded(np.array(a), np.array(b), 0, 40)
        assert score == best and places == sorted(places)


def test_window_runs_cover_every_window():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))).encode() for _ in range(20)] + [b"", b" \n ", "é ü".encode() * 30]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    ids = np.arange(len(texts))
    for heavy in (np.zeros(0, np.uint64), None):
        for cut, units in ((window_dedup._runs, lambda t: len(t.split()) - 12), (suffix_dedup._cut(400).runs, lambda t: len(t) - 399), (suffix_dedup._cut(20).runs, lambda t: len(t) - 19)):
            first, _ = cut(data, at, ids, ids, np.zeros(len(ids), np.int64), np.zeros(0, np.uint64))
            runs, _ = cut(data, at, ids, ids, np.zeros(len(ids), np.int64), np.unique(first.route) if heavy is None else heavy)
            seen = Counter()
            for d, p, n in zip(runs.did.tolist(), runs.place.tolist(), runs.windows.tolist()):
                seen.update((d, p + k) for k in range(n))
            assert seen == Counter({(i, k): 1 for i, t in enumerate(texts) for k in range(max(0, units(t)))})


def test_long_texts_are_cut_into_overlapping_parts(monkeypatch):
    rng = random.Random(7)
    text = " ".join("".join(rng.choice("abc") for _ in range(4)) for _ in range(900)).encode()
    monkeypatch.setattr(window_dedup, "PART", 50)
    parts = list(window_dedup._split(text))
    words = text.split()
    assert [p for p, k in parts] == [b" ".join(words[k : k + 62]) for k in range(0, 888, 50)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    starts = Counter(k + i for p, k in suffix_dedup._cut(400).split(text) for i in range(len(p) - 399))
    assert set(starts) == set(range(len(text) - 399)) and set(starts.values()) == {1}
    assert all(text[k : k + len(p)] == p for p, k in suffix_dedup._cut(400).split(text))


def test_statistics_of_texts():
    texts = ["", "Aa bb! bb bb\n12 x|y é.", "one"]
    raw = [t.encode() for t in texts]
    x = quality_classifier.statistics(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    got = dict(zip(quality_classifier.FEATURES, x[1]))
    assert not x[0].any()
    assert got["words"] == pytest.approx(np.log1p(7)) and got["distinct"] == pytest.approx(6 / 7) and got["echo"] == pytest.approx(np.sqrt(1 / 7))
    assert got["bang"] == pytest.approx(np.sqrt(1 / 7)) and got["bar"] == pytest.approx(np.sqrt(1 / 7)) and got["digit"] == pytest.approx(np.sqrt(2 / 7))
    assert got["upper"] == pytest.approx(np.sqrt(1 / 11)) and got["line_words"] == pytest.approx(np.log1p(7 / 2))


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(8)
    k = len(quality_classifier.FEATURES)
    mean = (rng.normal(size=k), rng.normal(size=k))
    cov = [a @ a.T + np.eye(k) for a in (rng.normal(size=(k, k)), rng.normal(size=(k, k)))]
    model = quality_classifier.Discriminant(mean, tuple(np.linalg.inv(np.linalg.cholesky(c)) for c in cov), 0.3)
    x = rng.normal(size=(20, k))
    logs = [-0.5 * (np.linalg.slogdet(c)[1] + np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)) for m, c in zip(mean, cov)]
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(-(0.3 + logs[1] - logs[0]))))


def test_warc_record_round_trip():
    for page, url, payload, first in ((1, "http://a/?x=1\r\nEvil: 1", b"a\r\n\r\nb", None), (None, None, b"", None), (9, "u", b"zz", 4)):
        got = warc.parse(warc.record(page, url, payload, warc.digest32(payload), first))
        assert (got["page_id"], got["refers_to"]) == (page, first) and got["payload"] == (payload if first is None else b"")
        assert got["record_type"] == ("response" if first is None else "revisit") and got["payload_digest"] == warc.digest32(payload)
        assert (got["url"] is None) == (url is None)


def test_ranges_are_coalesced():
    offset, length = np.array([0, 10, 25, 1000, 1010]), np.array([10, 10, 5, 10, 500])
    assert warc.ranges(offset, length, gap=5, most=600) == [(0, 3), (3, 5)]
    assert warc.ranges(offset, length, gap=2000, most=100) == [(0, 3), (3, 4), (4, 5)]
    assert warc.ranges(np.zeros(0, int), np.zeros(0, int)) == []


PAGES = [
    ("<html><head><title>no</title></head><body><nav><a href=x>Home</a></nav><article><h1>Big &amp; bold</h1><p>First  part\n of&nbsp;text with <b>in</b>line.</p><p>Ok.</p></article><footer>foot note of the page</footer>", "Big & bold\n\nFirst part of text with inline.\n\nOk."),
    ("<body><header><h1>Site name</h1><ul><li><a>A</a><li><a>B</a></ul></header><main><p>" + "word " * 40 + "</p><aside><p>" + "side " * 30 + "</p></aside><div class='comments'><p>" + "reader " * 30 + "</p></div></main><script>var a='<p>x</p>'</script>", ("word " * 40).strip()),
    ("<div id=cookie-banner>We use cookies to do many things for you here.</div><div class=sidebar><p>" + "x " * 50 + "</p></div><div><p>" + "real " * 60 + "</p><p>" + "more " * 50 + "</p></div><form><p>Sign up to get our letters and a lot more</p></form>", ("real " * 60).strip() + "\n\n" + ("more " * 50).strip()),
    ("<article><p>a < b and 5 > 4 <!-- <p>hidden</p> --> end of it</p><style>p{}</style><p>unclosed <b>bold", "a < b and 5 > 4 end of it\n\nunclosed bold"),
    ("<article><p class='ad'>buy it</p><p hidden>unseen</p><p class='lead'>kept words</p><h3 id=comments>Comments</h3></article>", "kept words"),
    ("", ""), (None, ""), ("<!-- never closed <p>x</p>", ""), ("<script>never closed", ""),
]


BODY = "".join(f"<p>{w * 40}</p>" for w in ("one ", "two ", "three "))
WRAPPERS = [
    '<div class="wrapper has-sidebar"><article>{}</article></div>',
    '<div class="post comments-open">{}</div>',
    '<div id="page" class="with-banner">{}</div>',
    '<div class="main-content no-toc">{}</div>',
    '<div class="sidebar-layout"><article>{}</article><aside><p>aside words here</p></aside></div>',
    '<div class="menu-page"><div class="banner-top"><main>{}</main></div></div>',
]


@pytest.mark.parametrize("html", WRAPPERS)
def test_html_wrappers_do_not_spoil_the_article(html):
    assert html_text.main_text(html.format(BODY)) == "\n\n".join((w * 40).strip() for w in ("one ", "two ", "three "))


def test_html_widgets_stay_boilerplate():
    page = f"<article>{BODY}</article>"
    for widget in ('<div class="related"><article><p>{}</p></article></div>', '<div class="comments"><article class="comment"><p>{}</p></article></div>', '<div class="has-icon sidebar"><p>{}</p></div>', '<aside><article><p>{}</p></article></aside>'):
        assert html_text.main_text(page + widget.format("teaser " * 50)) == html_text.main_text(page)


def test_html_text_of_formulas_and_drawings():
    html = f"<article><p>{'word ' * 40}<math><mi>x</mi><annotation>tex</annotation></math> <svg><title>t</title><text>label</text></svg></p></article>"
    assert html_text.main_text(html) == "word " * 40 + "x label"


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_tree_learns_its_table():
    x, y = html_text.labelled()
    assert (html_text.trained().predict(x) == y).mean() >= 0.95


P = "<p>" + "alpha beta gamma delta " * 8 + "</p>"
Q = "<p>" + "one two three four five " * 7 + "</p>"
TWO = ("alpha beta gamma delta " * 8).strip() + "\n\n" + ("one two three four five " * 7).strip()
LINKS = "<ul><li><a href=/a>First</a></li><li><a href=/b>Second one</a></li><li><a href=/c>Third</a></li></ul>"
LAYOUTS = [
    ('<section id="side-effects">{0}{1}</section>', TWO),
    ('<div class="social-science">{0}{1}</div>', TWO),
    ('<div class="legal-news article">{0}{1}</div>', TWO),
    ('<div class="search-tips">{0}{1}</div><div class="search"><p>Search the site for more of it</p></div>', TWO),
    ('<div class="noticeboard-story">{0}{1}</div>', TWO),
    ("<article>{0}{1}<address>Hill Road 5</address></article>", TWO + "\n\nHill Road 5"),
    ("<article>{0}{1}</article><div id='responses'><p>" + "I say so " * 20 + "</p></div>", TWO),
    ("<article>{0}{1}</article><article class='comment'><p>" + "I say so " * 20 + "</p></article>", TWO),
    ("<article class='menu-planning'>{0}{1}</article>", TWO),
    ("<div class='nav-wrapper'>{2}</div><div>{0}{1}</div><div class='footer-links'>{2}</div>", TWO),
    ("<header><p>" + "Site words " * 20 + "</p></header><main>{0}{1}</main>", TWO),
    ("<table><tr><td>{2}</td><td>{0}{1}</td></tr></table>", TWO),
    ("<main><h2>Title</h2>{0}<aside><p>" + "by the way " * 20 + "</p></aside>{1}</main>", "Title\n\n" + TWO),
    ("<div class='cookie-notice'><p>" + "we keep cookies " * 20 + "</p></div><article>{0}{1}</article>", TWO),
    ("<div class='legal'><p>" + "all rights are kept " * 10 + "</p></div><article>{0}{1}</article>", TWO),
    ("<article>{0}<div class='advert'><p>" + "buy this now " * 10 + "</p></div>{1}</article>", TWO),
    ("<article>{0}<form><p>" + "give us your letters " * 8 + "</p></form>{1}</article>", TWO),
    ("<article>{0}<div style='display:none'><p>" + "not seen at all " * 8 + "</p></div>{1}</article>", TWO),
    ("<article>{0}<p hidden>" + "not seen at all " * 8 + "</p>{1}</article>", TWO),
    ("<div class='sidebar'><p>" + "more of ours " * 30 + "</p></div><div class='content'>{0}{1}</div>", TWO),
    ("<div class='layout has-sidebar'><div class='post'>{0}{1}</div><div class='sidebar'>{2}</div></div>", TWO),
    ("<div>{0}{1}</div><div class='social-channels'>{2}</div><div class='popular-now'>{2}</div>", TWO),
    ("<article><header><h1>Head line</h1></header>{0}{1}<footer><p>Filed under many things and more</p></footer></article>", "Head line\n\n" + TWO),
]


@pytest.mark.parametrize("layout,text", LAYOUTS)
def test_html_layouts(layout, text):
    assert html_text.main_text(layout.format(P, Q, LINKS)) == text


@pytest.mark.parametrize("part", ["<div>x", "<head>x", '<div class="side-x">x<p>', "</section>x<div>", "<main><article>x", "<span id=ad>x", "<title>x"])
def test_html_time_is_linear_in_nesting(part):
    import time

    def took(n):
        html, best = part * n, float("inf")
        for _ in range(2):
            t = time.perf_counter()
            html_text.main_text(html)
            best = min(best, time.perf_counter() - t)
        return best

    assert took(64_000) < 20 * took(8_000) + 0.2  # quadratic: 64 times


def test_html_counters_agree_with_a_walk_over_all_containers():
    rng = np.random.default_rng(4)
    tags = ["div", "article", "main", "section class=sidebar", "div class=legal-news", "nav", "aside", "div id=comments", "section"]

    def build(depth):
        inner = "".join(build(depth - 1) if depth and rng.random() < 0.6 else f"<p>{'w ' * int(rng.integers(1, 30))}{'<a>l m</a>' if rng.random() < 0.3 else ''}</p>" for _ in range(rng.integers(1, 4)))
        tag = tags[rng.integers(len(tags))]
        return f"<{tag}>{inner}</{tag.split()[0]}>"

    import xml.etree.ElementTree as ET

    names = {"sidebar": 2, "comments": 2, "legal-news": 1}
    for _ in range(150):
        page = build(4)
        root = ET.fromstring(re.sub(r"=([\w-]+)", r'="\1"', page))
        above = {c: p for p in root.iter() for c in p}

        def path(e):
            out = []
            while e is not None:
                out.append(e)
                e = above.get(e)
            return out[::-1]

        boiler = lambda e: e.tag in ("nav", "aside")
        hint = lambda e: max((names.get(v, 0) for v in e.attrib.values()), default=0)
        ps = [e for e in root.iter("p")]
        plain = {e: len("".join((e.text or "").split())) for e in ps}
        clear = [e for e in ps if not any(map(boiler, path(e)))]
        inside = lambda e, o: any(x.tag in ("article", "main") for x in path(e)[path(e).index(o) + 1 :])
        total = sum(plain[e] for e in clear)

        def left(o):
            under = [e for e in clear if o in path(e)]
            whole = sum(plain[e] for e in under if inside(e, o))
            main = any(m is not o and o in path(m) for m in root.iter("main"))
            return 0 if main or 2 * whole > total else hint(o)

        found = html_text.blocks(page)
        assert [b.boiler for b in found] == [any(map(boiler, path(e))) for e in ps]
        assert [b.hint for b in found if not b.boiler] == [max([left(o) for o in path(e) if hint(o)], default=0) for e in clear]
