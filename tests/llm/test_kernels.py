"""The parts that run inside tasks, without Spark, against brute force."""

import math
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orbitspark.llm import html_text, lattice_lm, near_dedup, packing, quality, simple8b, token_counts, token_files, vocab

TEXTS = [
    "", " ", "  a  b ", "Hello, world. It's 3.5 o'clock!\nNew line\n\nTwo  spaces \t tab", "a\n\nb  c  d <|endoftext|> x", "<|endoftext|>", "don't we'll  \t it's\x1c x", "日本語 テキスト。", " lead", "trail ", "É́ é İSTANBUL ΣΑΣ á. b",
    " ᠎ a", "\x01a b", " \x01", "a \x01b c", "a.\nB c!\n\nD e,f\ng\n h.) i", "x,y;z  \n", "x" * 5000, "a b 　c", "|a|b | c|", "$5.00 (50%) #1 & more: a; b? yes!",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_library_s(name):
    enc = vocab.WholeTextEncoder(name)
    for texts in (TEXTS, TEXTS[::-1], [t for t in TEXTS if "<|" not in t]):
        ids, counts = enc.encode(pa.array(texts))
        want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é.,'s\n\t  !|́ 19"), max_size=30), min_size=1, max_size=8))
def test_ids_of_any_text(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = vocab.encoder(name)
        ids, counts = enc.encode(pa.array(texts))
        want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_full_tables_start_anew():
    enc = vocab.WholeTextEncoder("byte_bpe_50k.json", limit=3)
    for texts in (TEXTS, ["one two three four", "five"], TEXTS):
        ids, _ = enc.encode(pa.array(texts))
        assert ids.tolist() == [i for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False) for i in e.ids]


def test_whole_token_counts():
    whole = token_counts.prove_whole_tokens("byte_bpe_50k.json")
    counter = token_counts.TokenCounter("byte_bpe_50k.json", whole)
    assert len(whole) > 49_000 and "<|endoftext|>" not in whole
    want = [len(e.ids) for e in counter.encoder.tokenizer.encode_batch(TEXTS, add_special_tokens=False)]
    assert counter.counts(pa.array(TEXTS)).tolist() == want


VALUES = st.one_of(st.integers(0, 1), st.integers(0, 300), st.integers(0, 60_000), st.integers(0, 2**64 - 1))


@settings(max_examples=200, deadline=None)
@given(st.lists(VALUES, max_size=400))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, per_block = simple8b.encode(v)
    assert (simple8b.decode(words, per_block, len(v)) == v).all()
    assert per_block.sum() == len(words) and len(per_block) == -(-len(v) // simple8b.BLOCK)


def test_simple8b_packs_and_escapes():
    assert len(simple8b.encode(np.zeros(1280, np.uint64))[0]) == 10
    assert len(simple8b.encode(np.full(1280, 1000, np.uint64))[0]) == 10 * -(-128 // 6) or len(simple8b.encode(np.full(1280, 1000, np.uint64))[0]) == 10 * -(-128 // 6) + 0
    words, _ = simple8b.encode(np.array([2**63, 0, 2**62 + 5], np.uint64))
    assert (simple8b.decode(words, np.array([len(words)]), 3) == np.array([2**63, 0, 2**62 + 5], np.uint64)).all()
    v = np.arange(1000, dtype=np.uint64)
    words, per_block = simple8b.encode(v)
    at = per_block[:3].sum()  # one block alone
    assert (simple8b.decode(words[at : at + per_block[3]], per_block[3:4], 128) == v[384:512]).all()


def test_broken_token_files_are_refused(tmp_path):
    writer = token_files.FileWriter(f"file://{tmp_path}", 0, 1, 10**6)
    writer.add([7, None], np.array([3, 1]), np.array([5, 6, 0, 0]))
    writer.close()
    content = (tmp_path / "part-000000-0000.s8b").read_bytes()
    ids, sizes, values = token_files.parse_file(content)
    assert ids == [7, None] and sizes.tolist() == [3, 1] and values.tolist() == [5, 6, 0, 0]
    for bad in (b"", content[:-1], content[8:], b"X" * 60):
        with pytest.raises(ValueError):
            token_files.parse_file(bad)


@pytest.mark.parametrize("n", [1, 2, 7, 4095, 4096, 4097, 10_000])
def test_binary_lengths(n):
    parts = packing.binary_lengths(n, 4096)
    assert sum(parts) == n and all(p & (p - 1) == 0 for p in parts) and parts == sorted(parts, reverse=True)
    assert sum(p < 4096 for p in parts) == len({p for p in parts if p < 4096})


def segmentations(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        for rest in segmentations(word[k:]):
            yield [word[:k], *rest]


def test_lattice_sums_all_segmentations():
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b" ab", b"ab", b"abc", b"bc", b"cab", b" c"})
    rng = np.random.default_rng(0)
    p = rng.random(len(pieces) + 1)
    lattice = lattice_lm.Lattice(pieces, np.log(p))
    prob = dict(zip(pieces, p))
    words = [b" abcab", b" c", b" a", b" bbbcabc", b" "]
    want = [math.log(p[-1] * sum(math.prod(prob.get(s, 0.0) for s in seg) for seg in segmentations(w))) for w in words]
    assert np.allclose(lattice.log_marginals(words), want)
    long = b" " + b"abcab" * 30
    alpha = [0.0] + [-math.inf] * len(long)
    for e in range(1, len(long) + 1):
        total = sum(math.exp(alpha[b] - alpha[e - 1]) * prob.get(long[b:e], 0.0) for b in range(max(0, e - 5), e))
        alpha[e] = alpha[e - 1] + math.log(total)
    assert lattice.log_marginals([long])[0] == pytest.approx(alpha[-1] + math.log(p[-1]))
    counts = lattice.expected_counts(words)
    total = np.zeros(len(pieces))
    for w in words:
        segs = [(s, math.prod(prob.get(x, 0.0) for x in s)) for s in segmentations(w)]
        z = sum(q for _, q in segs)
        for s, q in segs:
            for x in s:
                if x in prob:
                    total[pieces.index(x)] += q / z
    assert np.allclose(counts, total)
    assert np.allclose(lattice.expected_counts(words, np.arange(5.0)), sum(k * lattice.expected_counts([w]) for k, w in enumerate(words)))


def test_long_words_count_as_a_whole(monkeypatch):
    pieces = sorted({bytes([b]) for b in range(256)} | {b" a", b" ab", b"ab", b"abc", b"bc", b"cab", b" c"})
    lattice = lattice_lm.Lattice(pieces, np.log(np.random.default_rng(1).random(len(pieces) + 1)))
    words = [b" " + b"abcab" * k for k in (1, 9, 30, 100)] + [b" ", b" b"]
    marginals, counts = lattice.log_marginals(words), lattice.expected_counts(words, np.arange(1.0, 7.0))
    for limit, block in ((0, 7), (0, 4096), (10**6, 4096)):
        monkeypatch.setattr(lattice_lm, "LONG", limit)
        monkeypatch.setattr(lattice_lm, "BLOCK", block)
        assert np.allclose(lattice.log_marginals(words), marginals) and np.allclose(lattice.expected_counts(words, np.arange(1.0, 7.0)), counts)


def shingles(text, width=5):
    w = text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def test_shingle_sets_and_signatures():
    texts = TEXTS + [" ".join(f"w{i % 50}" for i in range(300)), "one two three four", "One two  three four", "one two three four five"]
    sets = near_dedup.Shingler(5).sets(pa.array(texts))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert (sets[-3] == sets[-2]).all() and len(sets[0]) == 0
    m = near_dedup.chunks_for(0.85)
    assert near_dedup.chunks_for(0.8) > m
    rng = np.random.default_rng(1)
    base = rng.integers(1, 2**63, 400).astype(np.uint64)
    missed = 0
    for _ in range(300):
        other = base.copy()
        k = int(round(400 * 0.15 / 1.85))
        other[rng.choice(400, k, replace=False)] = rng.integers(1, 2**63, k).astype(np.uint64)
        a, b = near_dedup.signatures([np.unique(base), np.unique(other)], m)
        differ = [sum((int(x) >> 15 * i) % 32768 != (int(y) >> 15 * i) % 32768 for i in range(4)) for x, y in zip(a, b)]
        missed += min(differ) > 1
    assert missed == 0


def test_bradley_terry_separates():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] - x[:, 3] + rng.normal(0, 0.1, 400) > 0).astype(int)
    w, mean, scale = quality.fit(x, y, 5000)
    s = ((x - mean) / scale) @ w
    assert np.mean(s[y == 1][:, None] > s[y == 0][None, :]) > 0.99
    assert len(quality.features("")) == len(quality.features("a | b $$$ C")) == len(quality.NAMES)


def test_hashed_features_of_words():
    words = [b"a", b"abc", "né".encode(), b"abc"[::-1]]
    flat, lens = quality.grams(words)
    assert lens.tolist() == [2 * len(w) + 1 for w in words] and flat.min() >= 0 and flat.max() < quality.WIDTH
    parts = np.split(flat, np.cumsum(lens)[:-1])
    for w, part in zip(words, parts):  # one word alone has the same features
        assert (quality.grams([w])[0] == part).all()
    assert sorted(parts[1][3:6]) == sorted(parts[3][3:6]) and parts[1][-1] != parts[3][-1]
    texts = pa.array(["a abc a", "", "né  abc"])
    got = quality.shares(texts)
    want = [2 * np.bincount(parts[0], minlength=quality.WIDTH) + np.bincount(parts[1], minlength=quality.WIDTH), np.zeros(quality.WIDTH), np.bincount(np.concatenate([parts[1], parts[2]]), minlength=quality.WIDTH)]
    assert (got[:, :-1] == np.array(want)).all() and got[:, -1].tolist() == [13, 0, 14]


PAGES = [
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>Title &amp; more</h1><p>One,  two&nbsp;three.<p>Four <b>five</b><br>six</article><footer>foot</footer></body></html>", "Title & more\nOne, two three.\nFour five six"),
    ('<body><div class="ad">Buy now, buy</div><div id="content"><h2>Head</h2><p>Prose with, commas, and enough words to be counted as text here.</p><ul><li>first item</li><li>second</li></ul></div><div class="comments"><p>I say, this is a long comment, really long, with commas.</p></div></body>', "Head\nProse with, commas, and enough words to be counted as text here.\nfirst item\nsecond"),
    ("<script>var t='<p>no</p>';</script><style>p{}</style><main><p>Kept</p><form>Sign up <input name=x></form><aside>Side</aside></main>", "Kept"),
    ("<p title='a > b'>x, y</p><!-- <p>gone</p> -->", "x, y"),
    ("just text, no tags", "just text, no tags"),
    ("<div><p>unclosed <i>and <b>nested<div>block</div>", "unclosed and nested\nblock"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<div class='cookie-notice'>We use cookies</div><article>Text<section id=related><a href=1>More</a><a href=2>links</a></section></article>", "Text"),
    ("<div class='main-content sidebar-right'><h2>T</h2><p>The story, told in full.</p><div class='post-comments'><p>Nice, nice, nice.</p></div></div>", "T\nThe story, told in full."),
    ("<div id=comments class=content><p>One comment, long enough to win over the text.</p></div><div class='post has-sidebar'><p>Body of it.</p></div>", "Body of it."),
    ("<article><header><h1>Head</h1></header><p>Text.</p><div class='share-buttons'>Tweet</div><footer>By me</footer></article><header>Site</header>", "Head\nText."),
    ("", ""), (None, ""), ("<", "<"), ("<script>never closed", ""), ("a < b & c", "a < b & c"),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_main_text(html, want):
    assert html_text.main_text(html) == want


def test_main_text_of_deep_and_long_pages():
    deep = "<div>" * 3000 + "<p>deep text</p>"
    assert html_text.main_text(deep) == "deep text"
    long = "<article>" + "".join(f"<p>paragraph {i}, with words</p>" for i in range(5000)) + "</article>"
    assert html_text.main_text(long).count("\n") == 4999


PROSE = "A sentence of the paper, with some words, that goes on for long enough, as prose does, to count. "


@pytest.mark.parametrize("box", ['section id="discussion"', 'section class="related-work"', 'div class="legal-history"', 'p class="alert"', 'section id="navigation"'])
def test_names_alone_drop_no_text(box):
    tag = box.split()[0]
    body = f"<h1>T</h1><section><p>{PROSE * 4}</p></section><{box}>{'<p>' if tag != 'p' else ''}{PROSE * 2}End.</{tag}><section><p>{PROSE * 3}</p></section>"
    for page in (f"<article>{body}</article>", f"<body><div class=menu><a href=/>Home</a></div><div id=content>{body}</div></body>"):
        assert f"{PROSE * 2}End." in html_text.main_text(page)


def test_form_around_the_page():
    body = f"<div class=nav><a href=/>Home</a></div><div id=content><h2>T</h2><p>{PROSE * 3}</p><p>Short.</p></div>"
    want = f"T\n{(PROSE * 3).strip()}\nShort."
    assert html_text.main_text(f"<body><form action=x>{body}</form></body>") == want
    assert html_text.main_text(f"<body><form role=form id=aspnetForm>{body}</form><div class=footer>Us</div></body>") == want
    assert html_text.main_text("<form><p>All of it.</p></form>") == "All of it."


def test_names_still_drop_surroundings():
    story = f"<p>{PROSE * 3}</p><p>{PROSE * 2}</p>"
    want = f"{(PROSE * 3).strip()}\n{(PROSE * 2).strip()}"
    for box in (f"<div class=comments><p>{PROSE * 2}</p></div>", f"<div class=comments-area>{'<p>' + PROSE + '</p>'}</div>", "<div class=share-buttons>Tweet</div>", "<form>Sign up <input></form>", f"<div class=cookie-notice>{PROSE * 2}</div>"):
        assert html_text.main_text(f"<article>{story}{box}</article>") == want
        assert html_text.main_text(f"<body>{story}{box}</body>") == want
    assert f"{PROSE * 9}".strip() in html_text.main_text(f"<body><p>Hi.</p><div class=comments><p>{PROSE * 9}</p></div></body>")


def test_links_within_the_article_are_kept():
    links = "".join(f"<li><a href=/{i}>Reference {i}</a></li>" for i in range(4))
    body = f"<p>{PROSE * 3}</p><div><a href=/x>A linked line.</a></div><table><tr><td><a href=/y>Linked cell</a></table><h2>References</h2><ol>{links}</ol>"
    want = "\n".join([(PROSE * 3).strip(), "A linked line.", "Linked cell", "References", *(f"Reference {i}" for i in range(4))])
    assert html_text.main_text(f"<article>{body}<nav><a href=/>Home</a></nav><ul role=navigation><li><a href=/>Top</a></ul></article>") == want
    assert html_text.main_text(f"<body><ul><li><a href=/>Home</a></ul><h1>T</h1>{body}</body>") == f"T\n{want}"


def test_siblings_of_a_split_body_are_kept():
    long = f"<div><p>{PROSE * 3}</p><p>{PROSE * 3}</p><p>{PROSE * 3}</p></div>"
    links = "<ul><li><a href=/1>One</a><li><a href=/2>Two</a></ul>"
    page = f"<body><ul><li><a href=/>Home</a></ul>{long}<h2>Later</h2><p>Brief.</p>{links}<pre>x = 1</pre>{long}<h2>Last</h2><ul><li>item</ul><h2>More from us</h2></body>"
    part = [(PROSE * 3).strip()] * 3
    assert html_text.main_text(page).split("\n") == [*part, "Later", "Brief.", "One", "Two", "x = 1", *part, "Last", "item"]


@pytest.mark.parametrize("unit", ["<div>x", '<a "', "<a ", "<b>x", "<a '\"", "</div>x", "<b><div></b>", "<li>x", "<td>x<tr>", "<!--", "<![CDATA[", "<a<b", "<ul><li>", "<table><p>", "<i></b>", '<a title="b>" ', "<section class='related'>ab, cd "])
@pytest.mark.parametrize("end", ["", ">", "'>\"x<p>y</p>"])
def test_long_broken_pages_take_linear_time(unit, end):
    began = time.perf_counter()
    html_text.main_text(unit * (1_000_000 // len(unit)) + end)
    assert time.perf_counter() - began < 15


def test_layouts_without_an_article_element():
    story, want = f"<h1>T</h1><p>{PROSE * 3}</p><p>{PROSE * 2}</p>", f"T\n{(PROSE * 3).strip()}\n{(PROSE * 2).strip()}"
    around = "<div class=topbar><a href=/>Home</a> <a href=/a>About</a></div>", "<div class=sidebar><h3>More</h3><ul><li><a href=/1>One more</a><li><a href=/2>And more</a></ul></div><div id=footer>Us, 2020</div>"
    for box in ("div class=legal", "div class='post tags'", "td", "section", "div id=main-content", "blockquote", "center", "div role=main"):
        tag = box.split()[0]
        body = f"<{box}>{story}</{tag}>" if tag != "td" else f"<table><tr><td>{story}</td></tr></table>"
        assert html_text.main_text(f"<body>{around[0]}{body}{around[1]}</body>") == want, box
    assert html_text.main_text(f"<form id=aspnetForm><article>{story}</article></form>") == want
    named = f"<article><section class=search-results-explained><p>{PROSE * 3}</p></section><section id=social><p>{PROSE * 2}</p></section></article>"
    assert html_text.main_text(named) == want[2:]


def test_text_only_within_surroundings():
    for box in ("aside", "header", "footer", "div style='display:none'", "div role=complementary"):
        assert html_text.main_text(f"<body><nav><a href=/>Home</a></nav><{box}><p>{PROSE * 3}</p></{box.split()[0]}></body>") == (PROSE * 3).strip()
        assert html_text.main_text(f"<body><{box}>Us, 2020</{box.split()[0]}></body>") == ""


def test_long_character_references():
    assert html_text.main_text("<p>a&#" + "9" * 5000 + ";b &#x" + "f" * 5000 + "; &#0000000000065; &#x000000000041;") == "a�b � A A"


@pytest.mark.parametrize("n", [1, 8, 12, 20, 100])
@pytest.mark.parametrize("names", ["class=comments", "class='comment-list'", "id=comments", "class='user-comments box'", "id=disqus_thread"])
def test_comments_never_replace_or_join_the_article(n, names):
    story, want = f"<h1>T</h1><p>{PROSE}</p><p>{PROSE}</p>", f"T\n{PROSE.strip()}\n{PROSE.strip()}"
    box = "".join(f"<p>I read this, reader {i}, and I think, well, that it goes on for long, and on, and on, as they do.</p>" for i in range(n))
    items = "".join(f"<li class=comment><div class=comment-body><p>I read this, reader {i}, and it goes on for long, and on.</p></div></li>" for i in range(n))
    single = "".join(f"<article class=comment><p>I read this, reader {i}, and it goes on for long, and on.</p></article>" for i in range(n))
    for comments in (f"<div {names}>{box}</div>", f"<section {names}><h3>Comments</h3>{box}</section>", f"<div {names}><ol>{items}</ol></div>", f"<ol {names}>{items}</ol>", f"<div {names}>{single}</div>"):
        assert html_text.main_text(f"<body><div class=post>{story}</div>{comments}</body>") == want
        assert html_text.main_text(f"<body><article>{story}</article>{comments}</body>") == want
        assert html_text.main_text(f"<body><article>{story}{comments}</article></body>") == want
        assert html_text.main_text(f"<body><main><article>{story}</article>{comments}</main></body>") == want


def test_formulas_and_boxes_within_the_article_are_text():
    story = f"<p>{PROSE * 2}</p>"
    line = "<p>Let <math><mi>x</mi> = <mn>2</mn><annotation encoding=tex>x=2</annotation></math> hold, press <button>Go</button> now, see <object data=a>a drawing</object> here.</p>"
    box = f"<fieldset><legend>Note</legend>{PROSE}</fieldset>"
    want = f"{(PROSE * 2).strip()}\nLet x = 2 hold, press Go now, see a drawing here."
    assert html_text.main_text(f"<article>{story}{line}{box}</article>") == f"{want}\nNote\n{PROSE.strip()}"
    assert html_text.main_text(f"<body><div class=post>{story}{line}</div><div><button>Share</button><object>Flash</object><fieldset>Search</fieldset></div></body>") == want
    assert html_text.main_text(f"<article>{story}<form><fieldset>Mail <input><button>Send</button></fieldset></form></article>") == (PROSE * 2).strip()


def test_several_articles_are_kept():
    parts = [f"Part {k}. {PROSE * 2}".strip() for k in range(3)]
    page = "<main>" + "<hr>".join(f"<article><h2>H{k}</h2><p>{t}</p></article>" for k, t in enumerate(parts)) + "<article class=comment><p>Nice, nice, nice, really nice.</p></article></main>"
    assert html_text.main_text(f"<body><nav><a href=/>Home</a></nav>{page}</body>") == "\n".join(x for k, t in enumerate(parts) for x in (f"H{k}", t))
    cards = "".join(f"<article><a href=/{k}><h3>Another story {k}</h3></a></article>" for k in range(5))
    assert html_text.main_text(f"<body><main><article><p>{parts[0]}</p></article>{cards}</main></body>") == parts[0]
