"""Plain-Python parts of the operators, against brute force and fixed cases."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrove.llm import blocks as B
from lexigrove.llm import op1_mpeg_audio as mpeg
from lexigrove.llm import op2_ngram_jaccard as near
from lexigrove.llm import op3_toxicity as tox
from lexigrove.llm import op5_token_counts as tc
from lexigrove.llm import op7_packing as pack
from lexigrove.llm import op8_sentencepiece as sp
from lexigrove.llm import op9_substring_dedup as sub
from lexigrove.llm import op10_html_extraction as html


@given(st.binary(max_size=5000))
@settings(max_examples=40, deadline=None)
def test_mpeg_round_trip(raw):
    payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
    data = mpeg.encode_stream(payload, len(raw))
    p = mpeg.parse_stream(data)
    assert mpeg.payload_of(data, p) == payload
    assert p["junk"] == 0 and p["crc_ok"] == p["crc_checked"] == len(p["frames"]) == p["vbr"]["frames"]
    assert p["tags"]["PAYLOAD_CRC32"] == str(zlib.crc32(payload)) and p["samples"] == 1152 * len(payload) // 576


def test_mpeg_resynchronises_and_checks():
    data = mpeg.encode_stream(bytes(range(256)) * 9, 2304)
    p = mpeg.parse_stream(data)
    at = p["frames"][2][0]
    junk = mpeg.parse_stream(data[:at] + b"\xff\xfajunk\xff" + data[at:] + b"TAG" + b"title".ljust(125, b"\0"))
    assert len(junk["frames"]) == len(p["frames"]) and junk["junk"] == 7 and junk["tags"]["ID3v1"] == "title"
    broken = bytearray(data)
    broken[p["frames"][1][0] + 8] ^= 1
    assert mpeg.parse_stream(bytes(broken))["crc_ok"] == p["crc_checked"] - 1
    assert mpeg.seek(p, 0.03) == p["frames"][1][0] and mpeg.seek(p, 99) is None
    assert mpeg.parse_stream(None)["frames"] == [] and mpeg.parse_stream(b"\xff" * 50)["frames"] == []


def test_mpeg_headers_of_other_kinds():
    assert mpeg.header(b"\xff\xfd\x90\x00")["layer"] == 2
    assert mpeg.header(b"\xff\xf3\x50\xc0")["samples"] == 576
    assert mpeg.header(b"\xff\xfb\xf0\x00") is None and mpeg.header(b"\xff\xeb\x90\x00") is None


def test_rolling_tells_sequences():
    rng = np.random.default_rng(0)
    flat = rng.integers(0, 3, 400).astype(np.uint64)
    for k in (1, 4, 16, 35):
        h, seen = B.rolling(flat, k)[: len(flat) - k + 1], {}
        for i, x in enumerate(h.tolist()):
            assert seen.setdefault(tuple(flat[i : i + k].tolist()), x) == x
        assert len(set(seen.values())) == len(seen)


def test_sliding():
    a = np.random.default_rng(1).integers(0, 1000, 200).astype(np.uint64)
    for k in (1, 2, 20):
        assert B.sliding(a, k, np.minimum)[: 200 - k + 1].tolist() == [int(a[i : i + k].min()) for i in range(200 - k + 1)]


def jaccard(a, b):
    i = len(set(a.tolist()) & set(b.tolist()))
    return 100 * i >= 85 * (len(a) + len(b) - i)


def test_linked_sets_share_a_cell():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 7, 19, 60, 147, 148, 400):
        for _ in range(30):
            s = np.unique(B.mixed(rng.integers(0, 1 << 62, n).astype(np.uint64)))
            keep = s[rng.random(len(s)) > rng.random() * 0.2]
            t = np.unique(np.concatenate([keep, B.mixed(rng.integers(0, 1 << 62, rng.integers(0, 1 + n // 12)).astype(np.uint64))]))
            if len(t) and jaccard(s, t):
                assert any(np.intersect1d(k, j).size >= max(need, other) for k, need in near.cells(s) for j, other in near.cells(t))


def test_linked_sets_share_a_cell_whatever_their_voids():
    rng = np.random.default_rng(11)
    for _ in range(20_000):
        n = int(rng.integers(30, 48))
        s = np.unique(B.mixed(rng.integers(0, 1 << 62, n).astype(np.uint64)))
        t = np.unique(np.concatenate([s[rng.integers(0, 4) :], B.mixed(rng.integers(0, 1 << 62, rng.integers(0, 4)).astype(np.uint64))]))
        if jaccard(s, t):
            assert any(np.intersect1d(k, j).size >= max(need, other) for k, need in near.cells(s) for j, other in near.cells(t))


def test_every_link_is_found():
    rng = np.random.default_rng(4)
    base = B.mixed(np.arange(150, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(150) > rng.random() * 0.25], B.mixed(rng.integers(0, 1 << 62, rng.integers(0, 20)).astype(np.uint64))])) for _ in range(200)]
    everyone = list(range(200))
    assert sorted(near.linked(sets, everyone, everyone)) == [(i, j) for i in everyone for j in range(i + 1, 200) if jaccard(sets[i], sets[j])]


def test_tree_join_loses_nothing():
    rng = np.random.default_rng(3)
    base = B.mixed(np.arange(150, dtype=np.uint64))
    sets = []
    for _ in range(200):
        s = base[rng.random(150) > rng.random() * 0.25]
        sets.append(np.unique(np.concatenate([s, B.mixed(rng.integers(0, 1 << 62, rng.integers(0, 20)).astype(np.uint64))])))
    everyone = list(range(200))
    found, want = near.linked(sets, everyone, everyone), [(i, j) for i in everyone for j in range(i) if jaccard(sets[i], sets[j])]

    def parts(pairs):
        root = list(everyone)

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in pairs:
            root[find(x)] = find(y)
        return [find(x) for x in everyone]

    a, b = parts(found), parts(want)
    assert [[a[i] == a[j] for j in everyone] for i in everyone] == [[b[i] == b[j] for j in everyone] for i in everyone]


def test_trie_finds_misspellings():
    trie = tox.Trie(["idiot", "trash", "moron"])
    for w in ("idiot", "idoit", "1diot", "idiott", "diot", "idi0t", "trsh"):
        assert trie.near(w) in ("idiot", "trash"), w
    for w in ("idle", "patriot", "crashes", ""):
        assert trie.near(w) is None, w


def test_scorer_finds_every_edit():
    terms = ("stupid", "idiot", "moron", "scum")
    model = {"terms": dict.fromkeys(terms, 5.0), "stems": {}, "innocent": [], "quoted": 0.3}
    scorer, letters = tox.Scorer(model), "abcdefghijklmnopqrstuvwxyz1é"
    for t in terms:
        cuts = [(t[:k], t[k:]) for k in range(len(t) + 1)]
        edits = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
        assert [w for w in sorted(edits) if [h[4] for h in scorer.hits(w)[0]] != [t]] == []


def test_long_quotations_count():
    scorer = tox.Scorer({"terms": {"idiot": 5.0}, "stems": {}, "innocent": [], "quoted": 0.3})

    def quoted(text):
        found, words = scorer.hits(text)
        return [q for q, _ in scorer.context(text, words, found)]

    long = "one two three " * 60
    assert quoted(f'then "{long} idiot {long}" end {long} idiot') == [True, False]
    assert quoted(f"then „{long} idiot\n\n {long}“ end {long} idiot") == [True, False]
    assert quoted(f'five inches 5" wide\n\n{long} idiot {long} "a" {long} idiot') == [False, False]


def test_quotation_counts_less():
    model = {"terms": {"idiot": 5.0}, "stems": {}, "innocent": [], "quoted": 0.3, "weights": [-3.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0], "share": 0.1}
    score = lambda t: tox.score_of(tox.Scorer(model).features(t), model)
    assert score("you are an idiot") > score('they wrote "he is an idiot" there') > score("nothing here") == score("")
    assert score("you are an idi0t") > score("nothing here")


@pytest.fixture(scope="module")
def counts():
    return tc.LeafCounts()


@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 30), st.text("ab 1'sven\n  !é", max_size=12)), max_size=6), st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_edits_count_as_a_recount(edits, seed):
    rng = random.Random(seed)
    counts = tc.LeafCounts() if not hasattr(test_edits_count_as_a_recount, "counts") else test_edits_count_as_a_recount.counts
    test_edits_count_as_a_recount.counts = counts
    text = "".join(rng.choice(["the ", "it's", "  ", "\n", "a1b2", "!!", " 'll", "word", " é"]) for _ in range(rng.randrange(0, 160)))
    tree = tc.TokenTree(text, counts)
    for start, size, put in edits:
        tree.edit(start, start + size, put)
        start = min(start, len(text))
        text = text[:start] + put + text[min(start + size, len(text)) :]
        assert tree.text == text and tree.total == len(counts.encode(text))
        assert tree.n_leaves == len(counts.pattern.findall(text)) == sum(map(len, tree.sizes))


def test_edit_reencodes_little(counts):
    tree = tc.TokenTree("some words here " * 5000, counts)
    tree.edit(40_000, 40_010, "changed")
    assert tree.encoded < 20 and tree.total == len(counts.encode(tree.text))


@pytest.mark.parametrize("n", [1, 30, 3000])
def test_patterns_hold_the_counts(n):
    rng = random.Random(n)
    want = {}
    for _ in range(n):
        x = min(256, 1 + int(rng.expovariate(1 / 60)))
        want[x] = want.get(x, 0) + 1
    patterns, got = pack.whole_patterns(want, 256), {}
    for p, k in patterns:
        assert sum(x * a for x, a in p.items()) <= 256
        for x, a in p.items():
            got[x] = got.get(x, 0) + a * k
    assert got == want
    if n == 3000:
        assert sum(k for _, k in patterns) <= 1.02 * sum(x * a for x, a in want.items()) / 256 + 2


def test_segmentations_are_lossless_and_repeat():
    pieces = sp.Pieces()
    texts = ["", " ", "  two  spaces ", "naïve café", "a▁b ▁", "日本語 text\n\nlines\n", "x" * 300, "tab\tand \x00 nul", "emoji 🎉🎉"]
    seeds = sp._mixed(np.arange(len(texts), dtype=np.uint64))
    first, again = pieces.segment(texts, seeds), pieces.segment(texts[::-1], seeds[::-1])[::-1]
    for t, a, b in zip(texts, first, again, strict=True):
        assert a.tolist() == b.tolist() and pieces.decode(pieces.expanded(a)[0]) == t


def test_sampling_has_the_lattice_probabilities():
    pieces = sp.Pieces()
    weights = {int(v): float(w) for v, w in zip(pieces.values, pieces.weight, strict=True)}
    total = {}

    def walk(rest, ids, w):
        if not rest:
            total[ids] = w
        for k in range(1, len(rest) + 1):
            if (i := pieces.ids.get(rest[:k])) is not None:
                walk(rest[k:], (*ids, i), w * weights[i])

    walk(" the", (), 1.0)
    n = 20_000
    drawn = pieces.segment(["the"] * n, sp._mixed(np.arange(n, dtype=np.uint64)))
    seen = {}
    for d in drawn:
        seen[tuple(d.tolist())] = seen.get(tuple(d.tolist()), 0) + 1
    for ids, w in total.items():
        p = w / sum(total.values())
        assert abs(seen.get(ids, 0) / n - p) < 5 * (p / n) ** 0.5 + 1e-3


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header class="x"><h1>Site</h1></header><nav><ul><li>Menu</ul></nav>
<div class="ad">Buy</div><article><h1>Head &amp; tail</h1><p>One  <b>two</b><br>three<p>Four&nbsp;&lt;5
<script>var t="</p>";</script><aside>side</aside><form>mail<input></form><div class="comments"><p>c1</p></div></article><footer>f</footer></body></html>"""


def test_page_blocks():
    kinds, lines = html.blocks_of(PAGE)
    assert html.main_text(kinds, lines, []) == "Head & tail One two three Four <5"
    assert html.blocks_of(None) == ([], []) == html.blocks_of("")
    assert html.main_text([], [], []) == ""


def test_differencing_deletes_shared_lines():
    page = lambda *body: html.blocks_of("<body>" + "".join(f"<div>{x}</div>" for x in body) + "</body>")
    a, b = page("Home | About", "first story", "more of it", "All rights"), page("Home | About", "second story", "and more", "All rights")
    assert html.main_text(*a, html.shared_lines(a[1], [b[1]])) == "first story more of it"
    assert html.main_text(*a, []) == "Home | About first story more of it All rights"


def test_markup_vetoes_differencing():
    page = lambda title, *more: html.blocks_of(f"<nav>Home</nav><article><h1>{title}</h1><p>a licence line</p>{''.join(more)}</article><p>beside</p>")
    box = '<div class="keep-up"><p>Write to us</p><p>or call</p></div>'
    a, b, c = page("first", box), page("second story", box), page("third", box.replace("call", "fax"))
    text = lambda x, *others: html.main_text(*x, html.shared_lines(x[1], [o[1] for o in others]))
    # the box goes if a neighbour shares all of it, the licence line in the article's own prose stays
    assert text(a) == text(a, c) == "first a licence line Write to us or call"
    assert text(a, b) == text(a, c, b) == "first a licence line" or len("Write to us or call") * 2 >= len("first a licence line Write to us or call")
    long = page("first", "<p>and much more of the story, told at length</p>", box)
    assert text(long, b) == "first a licence line and much more of the story, told at length"
    # equal articles in a box of their own are no template
    whole = html.blocks_of('<article><div class="body"><p>one</p><p>two</p></div></article><footer>x</footer>')
    other = html.blocks_of('<article><div class="body"><p>one</p><p>two</p></div></article><footer>y</footer>')
    assert text(whole, other) == "one two"


@pytest.mark.parametrize("unit", ['<a x="', "<a x='", "<!", "</", "<![CDATA[", "<!--", "<div>", "</x>", "<p", "<a b=\"c'", "<a =", "< "])
def test_odd_markup_is_read_in_linear_time(unit):
    import time

    began = time.perf_counter()
    html.blocks_of(unit * 40_000 + "<article>x</article>")
    assert time.perf_counter() - began < 5


def test_stray_marks_take_no_text():
    kinds, lines = html.blocks_of("<article><p title=it's>one <b class=x\">two</b> 1 < 2 </3 three <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p><script>if (a<b) c=\"</script>four</article>")
    assert html.main_text(kinds, lines, []) == "one two 1 < 2 </3 three x=1. four"


@pytest.mark.parametrize("bits", [1, 40, 1 << 29])
def test_alignment_in_halves(monkeypatch, bits):
    rng = random.Random(3)
    monkeypatch.setattr(html, "BITS", bits)
    for _ in range(40):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(25))] for _ in range(2))
        test_common_is_longest.hypothesis.inner_test(a, b)
        found = [a[i] for i in sorted(html.common(a, b))]
        left = iter(b)
        assert all(x in left for x in found)


@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30))
@settings(max_examples=60, deadline=None)
def test_common_is_longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert len(html.common(a, b)) == best[-1][-1]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('<article><p class="ad">buy<p>one<p>two</article>', "one two"),
        ('<div class="content has-sidebar"><article><div class="article-header"><h1>T</h1></div><p>x</p></article></div>', "T x"),
        ('<article>a<article class="comment">c</article>b</article>', "a b"),
        ('<section id="comments"><article>c</article></section><main>m<div class="cookie-notice">n</div></main>', "m"),
        ('<article><ul><li class="share">s<li>k</ul>t<!-- x --><div hidden>h</div></article>', "s k t"),
        ('<article><div class="side-effects">a</div><section id="related-work">b</section><div class="search-engines">c</div><h2 id="login">d</h2></article>', "a b c d"),
        ('<body><div class="side-effects">a</div><div class="ads">b</div><div id="main-menu">c</div><div class="left-sidebar wide">d</div><h2 id="search">e</h2></body>', "a e"),
        ("<div role=navigation>n</div><article>a&#x41;&nbsp;&nbsp;b<br/>c</article>", "aA b c"),
    ],
)
def test_page_kinds(body, want):
    assert html.main_text(*html.blocks_of(f"<html><body>{body}</body></html>"), []) == want


def naive_match(pieces, k, i, window):
    """Longest match of place i of piece k with any other place that begins a window."""
    best = 0
    for j, other in enumerate(pieces):
        for at in range(len(other) - window + 1):
            if (j, at) != (k, i):
                n = 0
                while i + n < len(pieces[k]) and at + n < len(other) and pieces[k][i + n] == other[at + n]:
                    n += 1
                best = max(best, n)
    return best


@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=5, max_size=13), st.booleans()), min_size=1, max_size=7))
@settings(max_examples=200, deadline=None)
def test_factors_against_naive_search(drawn):
    window, pieces = 5, [p for p, _ in drawn]
    words, sizes = np.concatenate([np.array(p, np.uint64) for p in pieces]), np.array([len(p) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    longest = sub.matched(words, starts, sizes, window)
    duplicate = sub.factored(words, starts, sizes, np.array([t for _, t in drawn]), window)
    seen = {}
    for p, twice in drawn:
        for i in range(len(p) - window + 1):
            seen[tuple(p[i : i + window])] = seen.get(tuple(p[i : i + window]), 0) + 1 + twice
    for k, p in enumerate(pieces):
        for i in range(len(p) - window + 1):
            # sorted to 8 words for a window of 5: longer matches, which take repeating texts, may come out shorter
            most = naive_match(pieces, k, i, window)
            assert min(most, 8) <= longest[starts[k] + i] <= most
            assert duplicate[starts[k] + i] == (seen[tuple(p[i : i + window])] > 1)


def test_long_unbroken_texts_are_segmented_in_time():
    import time

    rng, pieces = random.Random(1), sp.Pieces()
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(80_000)), "a" * 300, "x" * 50 + "\u3042" * 50]
    began = time.perf_counter()
    for text, ids in zip(texts, pieces.segment(texts, np.arange(3, dtype=np.uint64)), strict=True):
        assert pieces.decode(pieces.expanded(ids)[0]) == text
    assert time.perf_counter() - began < 8


def test_segmentation_does_not_depend_on_batches(monkeypatch):
    pieces, texts = sp.Pieces(), ["one two  three\nfour" * 9, "", "five six" * 20]
    whole = [x.tolist() for x in pieces.segment(texts, np.arange(3, dtype=np.uint64))]
    monkeypatch.setattr(sp, "BATCH", 17)
    assert [x.tolist() for x in pieces.segment(texts, np.arange(3, dtype=np.uint64))] == whole


def test_long_parts_alone(monkeypatch):
    pieces = sp.Pieces()
    # the lattice's probabilities, and the same draws whatever the chunks
    monkeypatch.setattr(sp, "LONG", 1)
    weights = {int(v): float(w) for v, w in zip(pieces.values, pieces.weight, strict=True)}
    total = {}

    def walk(rest, ids, w):
        if not rest:
            total[ids] = w
        for k in range(1, len(rest) + 1):
            if (i := pieces.ids.get(rest[:k])) is not None:
                walk(rest[k:], (*ids, i), w * weights[i])

    walk(" this", (), 1.0)
    n, seen = 3000, {}
    for d in pieces.segment(["this"] * n, sp._mixed(np.arange(n, dtype=np.uint64))):
        seen[tuple(d.tolist())] = seen.get(tuple(d.tolist()), 0) + 1
    assert set(seen) <= set(total)
    for ids, w in total.items():
        p = w / sum(total.values())
        assert abs(seen.get(ids, 0) / n - p) < 5 * (p / n) ** 0.5 + 2e-3
    text = "abra=cadabra-é\ud800🎉" * 40 + "=" * 200
    whole = pieces.segment([text], np.array([3], np.uint64))[0].tolist()
    for chunk in (1, 7, 64):
        monkeypatch.setattr(sp, "CHUNK", chunk)
        assert pieces.segment([text], np.array([3], np.uint64))[0].tolist() == whole
    assert pieces.decode(pieces.expanded(np.array(whole))[0]) == text


@pytest.mark.parametrize("text", ["=" * 1_000_000, " " * 1_000_000, "ab" * 500_000, "漢字" * 200_000 + " and " + "-" * 300_000])
def test_very_long_runs(text):
    import time

    pieces, began = sp.Pieces(), time.perf_counter()
    ids = pieces.segment([text], np.array([5], np.uint64))[0]
    assert time.perf_counter() - began < 60 and pieces.decode(pieces.expanded(ids)[0]) == text


def test_many_edits_of_a_long_text(counts):
    import time

    rng, text = random.Random(2), "some words here and  there,\n\n  12345 don't " * 20_000
    edits = [(p := rng.randrange(len(text)), p + rng.randint(0, 5), rng.choice(["x", "[redacted]", " ", "", "two words"])) for _ in range(20_000)]
    took = []
    for n in (5_000, 20_000):
        tree, began = tc.TokenTree(text, counts), time.perf_counter()
        tc.apply_edits(tree, edits[:n])
        took.append(time.perf_counter() - began)
        assert tree.total == len(counts.encode(tree.text)) and tree.n_leaves == len(counts.pattern.findall(tree.text))
    assert took[1] < 20 * max(took[0], 0.1)
    # all edits at one place: the buckets there are cut
    tree = tc.TokenTree("a b " * 100, counts)
    for _ in range(3_000):
        tree.edit(50, 50, "new words ")
    assert tree.total == len(counts.encode(tree.text)) and max(map(len, tree.leaves)) <= 5 * tc.BUCKET


def crc_of_bits(bits):
    c = 0xFFFF
    for b in bits:
        c = (c << 1) & 0xFFFF ^ (0x8005 if (c >> 15) ^ b else 0)
    return c


@pytest.mark.parametrize(
    ("head", "widths", "bound", "channels"),
    [
        (b"\xff\xfe\x90\x00", [4] * 32, 32, 2),  # layer I, 288 kbit/s, stereo
        (b"\xff\xfe\x90\x50", [4] * 32, 8, 2),  # joint stereo from subband 8 on
        (b"\xff\xfc\x90\x00", [4] * 11 + [3] * 12 + [2] * 4, 27, 2),  # layer II, 160 kbit/s in two channels
        (b"\xff\xfc\xa0\xc0", [4] * 11 + [3] * 12 + [2] * 7, 30, 1),  # 192 kbit/s in one
        (b"\xff\xfc\x10\x00", [4] * 2 + [3] * 6, 8, 2),  # 32 kbit/s
        (b"\xff\xf4\x80\x40", [4] * 4 + [3] * 7 + [2] * 19, 4, 2),  # MPEG-2, joint stereo from subband 4 on
    ],
)
def test_mpeg_checksums_of_layers_one_and_two(head, widths, bound, channels):
    rng, h = random.Random(8), mpeg.header(head)
    frames = []
    for _ in range(3):
        bits, chosen = [], 0
        for k, w in enumerate(widths):
            for _ in range(channels if k < bound else 1):
                own = [rng.randrange(2) for _ in range(w)]
                bits += own
                chosen += any(own) * (1 if k < bound else channels)
        if h["layer"] == 2:
            bits += [rng.randrange(2) for _ in range(2 * chosen)]
        covered = [b >> s & 1 for b in head[2:] for s in range(7, -1, -1)] + bits
        rest = bits + [rng.randrange(2) for _ in range(8 * (h["length"] - 6) - len(bits))]
        body = bytes(sum(b << (7 - i) for i, b in enumerate(rest[k : k + 8])) for k in range(0, len(rest), 8))
        frames.append(head + crc_of_bits(covered).to_bytes(2, "big") + body)
    assert [mpeg.parse_stream(b"".join(frames))[k] for k in ("crc_ok", "crc_checked")] == [3, 3]
    wrong = frames[1][:4] + b"\xde\xad" + frames[1][6:]
    assert [mpeg.parse_stream(frames[0] + wrong + frames[2])[k] for k in ("crc_ok", "crc_checked")] == [2, 3]


def test_mpeg_truncated_frame():
    data = mpeg.encode_stream(bytes(2304), 2304)
    whole, short = mpeg.parse_stream(data), mpeg.parse_stream(data[:-10])
    assert short["junk"] == 0 and len(short["frames"]) == len(whole["frames"]) - 1 and short["truncated"] == len(data) - 10 - whole["frames"][-1][0] and whole["truncated"] == 0
    assert f"truncated={short['truncated']} " in mpeg.feature_of(short)
