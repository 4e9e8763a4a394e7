"""The algorithms alone, without Spark."""

import math
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from tessera.llm import embeddings, html, html_pages, langid, lm, packing, pieces, quality, simhash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "  \n", "One", "one Two", "a b c", "É A b\x0bc\td  e", "x " * 50, "Straße ÄÖ z  y", "a b c d a b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("slab", [1 << 14, 40])
@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 28])
def test_bit_sliced_distances(radius, slab, monkeypatch):
    """Equal to all distances, in groups of any size: of one row, of two, of over a word; of one chunk, or of two that meet."""
    monkeypatch.setattr(simhash, "SLAB", slab)
    rng = np.random.default_rng(radius)
    fps, task, side = [], [], []
    for t, m in enumerate([1, 2, 3, 64, 65, 200, 2, 30]):
        f = rng.integers(0, 1 << 62, max(1, m // 8), np.uint64)[rng.integers(0, max(1, m // 8), m)]
        for _ in range(4):
            f = f ^ (np.uint64(1) << rng.integers(0, 64, m).astype(np.uint64)) * (rng.random(m) < 0.6).astype(np.uint64)
        fps, task, side = [*fps, *f.tolist()], [*task, *[t * 9 - 20] * m], [*side, *(rng.integers(0, 2, m) if t % 2 else [2] * m)]
    n, got = len(fps), set()
    links = list(simhash.near_pairs(np.array(fps, np.uint64), np.array(task), np.array(side), radius))
    for i, j in links:
        got |= set(zip(i.tolist(), j.tolist(), strict=True))
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if task[i] == task[j] and (side[i] == 2 or side[i] != side[j]) and (fps[i] ^ fps[j]).bit_count() <= radius}
    assert got == want
    forest, kept = simhash.Forest(n), []
    for i, j in links:
        kept += zip(*(x.tolist() for x in forest.add(i, j)), strict=True)
    root = list(range(n))
    for i, j in want:
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert set(kept) <= want and len(kept) == n - len(set(root)) and forest.root.tolist() == root


def test_hilbert_curve_is_continuous():
    bits, n = 3, 2
    side = np.arange(1 << bits)
    grid = np.array([(x, y) for x in side for y in side])
    points = -np.log((1 << bits) / (grid + 0.5) - 1) / 1.7  # the inverse of the logistic map, at cells' middles
    key = packing.hilbert_key(points, bits)
    assert sorted(key) == list(range(1 << bits * n))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def split_ids(turns):
    return [x.tolist() for ids, n in turns for x in np.split(ids, np.cumsum(n)[:-1])]


def test_words_encode_as_whole_texts():
    encoder, whole = packing.WordEncoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(1)
    letters = "abcABC'sStrdlm.,!?*#$%&<>|/w0123456789éÉñÑüÜßÿ×Ωσς İı́ 中🙂  \n\t\x85-_’"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in range(2000)] + ["a<|endoftext|>b", "<|x", "it's 'S", "", "x</w> </w> <</w", "\x01 a\x01b"]
    assert encoder.simple
    for t, ids in zip(texts, split_ids(encoder.encode(t.encode() for t in texts)), strict=True):
        assert ids == whole.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("name", ["DISTINCT", "TOGETHER"])
def test_turns_change_nothing(monkeypatch, name):
    texts = [f"the word{k} of{k} {k}{i} the".encode() * (i % 3) for k in range(6) for i in range(5)]
    encoder = packing.WordEncoder(packing.tokenizer_path())
    want = split_ids(encoder.encode(texts))
    monkeypatch.setattr(packing, name, 8)
    assert len(list(encoder.encode(texts))) > 5 and split_ids(encoder.encode(texts)) == want
    assert list(encoder.encode([])) == [] and split_ids(encoder.encode([b"", b""])) == [[], []]


def test_points_are_those_of_single_documents():
    rng = np.random.default_rng(11)
    n = rng.integers(1, 40, 700)
    ids = rng.integers(0, 49_000, n.sum()).astype("<u2")
    bucket, directions = packing._projection()
    got = packing.document_points(ids, n)
    for k, own in enumerate(np.split(ids, np.cumsum(n)[:-1])):
        v = np.sqrt(np.array([sum(bucket[i] == b for i in own) for b in range(packing.BUCKETS)])) if k < 3 else np.sqrt(np.bincount(bucket[own], minlength=packing.BUCKETS))
        assert np.allclose(got[k], v @ directions / np.linalg.norm(v))


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces.model_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def test_pieces_are_those_of_the_library(model):
    own, library = model
    rng = random.Random(2)
    letters = "abcdeinrstABC'.,!?*#|0123456789éñüß中🙂ﬁ   \n\t▁\x00thonere"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(1500)]
    texts += [" " * k for k in range(40)] + ["a" * 300, "ab" * 90, "\n" * 9, "x" + " " * 37 + "y", "", "²."]
    for t in texts:
        ids = own.encode(t).tolist()
        assert ids == library.encode(t), t
        assert own.decode(ids) == t.replace("▁", " ")


def test_stream_commits_before_the_end(model):
    own, library = model
    rng = random.Random(3)
    for _ in range(20):
        t = "▁" + "".join(rng.choice("abcdeinrstthonere中 ") for _ in range(400)).replace(" ", "▁")
        out = list(own.stream([*(t[i : i + 9] for i in range(0, len(t), 9)), own.edge, "▁end", own.edge]))
        assert [is_end for _, is_end in out] == [False] * (len(out) - 2) + [True, True] and len(out) > 5
        assert [i for o, _ in out[:-1] for i in o] == library.encode(t[1:].replace("▁", " ")) and out[-1][0] == library.encode("end")


def test_every_word_is_a_text_of_the_stream(model, monkeypatch):
    """No other search serves the queries: as many texts end in the stream as a turn has distinct words."""
    own, library = model
    texts = ["the quick brown fox jumps over the lazy dog " * 3, "x" * 300, "", None, "the fox\nand 中 the dog"]
    distinct, ended, stream = set(), [], own.stream
    for t in texts:
        distinct |= set(own.words("▁" + t.replace(" ", "▁")) if t else ())
    monkeypatch.setattr(own, "stream", lambda parts: (ended.append(x[1]) or x for x in stream(parts)))
    ((ids, n),) = own.encode_texts(texts)
    assert sum(ended) == len(distinct) and len(ended) > len(distinct)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t or "") for t in texts]


def test_small_turns_and_memories_change_nothing(model, monkeypatch):
    texts = ["the quick brown fox jumps over the lazy dog", "thention enthe reth\nin the of", None, "dog of the fox"]
    for name in ("DISTINCT", "PAIRS", "TOGETHER"):
        monkeypatch.setattr(pieces, name, 5)
        own = pieces.Pieces(pieces.model_path())
        assert split_ids(own.encode_texts(texts)) == [model[1].encode(t or "") for t in texts]


PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/x'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies on this site today.</div>"
    "<article><h1>A &amp; B</h1><p>First  para\n graph with <b>bold</b> words and more of them.<p>Second one, <a href='/y'>linked</a> here.</p><div class='ad'>Buy this now</div><script>var a = '</p>';</script><ul><li>one<li>two</ul></article>"
    "<section id='comments'><p>Nice post, thank you so very much for it.</p></section><aside>Side bar text</aside><form><input>Send it</form><footer>&copy; us</footer></body></html>"
)


def test_main_text():
    assert html.main_text(PAGE)[0] == "A & B\n\nFirst para graph with bold words and more of them.\n\nSecond one, linked here.\n\none\n\ntwo"


class MarkedText(HTMLParser):
    """The text between marks, by the standard library's parser."""

    def __init__(self, source):
        super().__init__()
        self.blocks, self.on = [""], False
        self.feed(source)
        self.close()

    def handle_pi(self, data):
        self.on = data == "content?"

    def handle_starttag(self, tag, attrs):
        if tag in html.BLOCK:
            self.blocks.append("")

    handle_endtag = lambda self, tag: self.handle_starttag(tag, ())

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data

    def text(self):
        return "\n\n".join(x for x in (" ".join(b.split()) for b in self.blocks) if x)


def test_held_out_pages():
    """Pages that weights were not learned from; on many the scan, not the hints alone, decides."""
    pages = [*html_pages.labelled_pages(200, seed=99)]
    assert not {*pages} & {*html_pages.labelled_pages()}
    same = kept = found = wanted = scanned = 0
    for marked in pages:
        source = marked.replace("<?content?>", "").replace("<?rest?>", "")
        got, want = html.main_text(source)[0], MarkedText(marked).text()
        page = html.parse(source)
        unscanned = " ".join(x.text for x, f in zip(page.items, html.features(page), strict=True) if f and html.default_weights().words(f)[1])
        same, scanned = same + (got == want), scanned + (unscanned.split() != got.split())
        a, b = Counter(got.split()), Counter(want.split())
        kept, found, wanted = kept + (a & b).total(), found + a.total(), wanted + b.total()
    assert same >= 160 and kept >= 0.99 * found and kept >= 0.99 * wanted and scanned >= 50


def test_what_belongs_to_the_article():
    long = "a comment with many words of a reader that go on and on for ever so long, longer than any story"
    assert html.main_text(f"<article>story of the day, a short one</article><div class='comments'><article>{long}</article></div>")[0] == "story of the day, a short one"
    form = "<html><body><form><h1>Title</h1><p>Words of the page, all of it inside one form.</p><p>More text.</p><label>Mail</label><input><button>Go</button></form></body></html>"
    assert html.main_text(form)[0] == "Title\n\nWords of the page, all of it inside one form.\n\nMore text."
    names = "<article><h1>T</h1><p>Some first words of this.</p><div class='legal-history'><p>The history of the law is long.</p></div><p class='search-history'>Searching is old.</p><div class='ad-slot-7'>Buy it</div></article>"
    assert html.main_text(names)[0] == "T\n\nSome first words of this.\n\nThe history of the law is long.\n\nSearching is old."
    assert html.main_text('<div class="foo>bar</div><p>Words after an open quote.</p>')[0] == "bar\n\nWords after an open quote."
    assert html.main_text('<p>Words first.</p><div class="foo>bar')[0] == "Words first.\n\nbar"
    teasers = "<article><h1>T</h1><p>Words of the story, and a few more.</p></article><aside><article><a href='/x'>Another story</a></article></aside>"
    assert html.main_text(teasers)[0] == "T\n\nWords of the story, and a few more."


@pytest.mark.parametrize("source", ["<div class='promo'><h1>" * 20_000 + "x", "<b>" * 20_000 + "<p>x" * 20_000, "<div>" * 20_000 + "</span>" * 20_000 + "x", '<a "' * 40_000, "<!--" * 40_000, "<p class='x" * 20_000])
def test_deep_pages_take_linear_time(source):
    html.default_weights()
    began = time.process_time()
    html.main_text(source)
    assert time.process_time() - began < 4


def test_comments_as_articles():
    page = "<main class='page'><article class='post has-comments'><header><h1>Title</h1><p>by someone</p></header><p>The words of the article, quite a few of them here.</p></article><div id='comments'><article class='comment-body'><p>A long comment of a reader, much longer than the article is, with many more words in it than anybody reads.</p></article></div></main>"
    assert html.main_text(page)[0] == "Title\n\nThe words of the article, quite a few of them here."
    page = "<div class='page-with-sidebar'><h1>Title</h1><p>Words of it, and some more of them.</p><div class='sidebar'>Not this</div></div>"
    assert html.main_text(page)[0] == "Title\n\nWords of it, and some more of them."


@pytest.mark.parametrize("source", [None, "", "<", "<p", "<!--", "<nav>only a menu</nav>", "<script>x", "</div></p>", '<a href="x>y', "<p " * 500, "\x00<b"])
def test_odd_pages(source):
    text, start, stop = html.main_text(source)
    assert isinstance(text, str) and start <= stop


def test_best_run():
    rng = random.Random(4)
    for _ in range(100):
        x = [rng.randint(-5, 4) for _ in range(12)]
        sums = {(i, j): sum(x[i:j]) for i in range(12) for j in range(i + 1, 13)}
        i, j = html.best_run(x)
        assert sum(x[i:j]) == max(0, max(sums.values()))


def test_isotonic():
    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1])
    places, values = quality.isotonic(x, y)
    assert values.tolist() == [0, 0.5, 1] and (np.diff(places) > 0).all()


def test_fourier_features_approximate_the_kernel():
    x = np.random.default_rng(5).standard_normal((40, 6))
    z = quality.fourier(x, 20_000)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 6 / 2)
    assert np.abs(z @ z.T - want).max() < 0.05


def language_model(rows):
    langs = sorted({x for x, *_ in rows})
    lang, n, gram, count = zip(*rows, strict=True)
    return langid.Model(langs, np.array(n), langid.hashes(list(gram)), np.array([langs.index(x) for x in lang]), np.array(count))


def test_words_come_before_grams():
    rows = [("aa", 0, "foo", 9), ("bb", 0, "bar", 9)] + [("aa", 1, c, 5) for c in "fo"] + [("bb", 1, c, 5) for c in "bar"] + [("aa", 2, "oo", 9), ("bb", 2, "ar", 9)]
    m = language_model(rows)
    assert [x for x, _ in m.predict(["Foo foo", "zoo", "par", "zzz"])] == ["aa", "aa", "bb", "aa"]  # zzz: a tie, the first by name
    assert m.predict([None, "", "12 !?"]) == [("und", 0.0)] * 3


@pytest.mark.parametrize("remembered", [200_000, 7])
def test_languages_equal_their_definition(monkeypatch, remembered):
    """Counts, backoff and score against a plain version, with any memory."""
    monkeypatch.setattr(langid, "REMEMBERED", remembered)
    rng = random.Random(12)
    word = {"x": lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 7))), "y": lambda: "".join(rng.choice("cdefgé") for _ in range(rng.randint(1, 7)))}
    texts = [(k, " ".join(word[k]() for _ in range(20))) for k in "xyxyxxy"]
    counts = Counter()
    for lang, t in texts:
        for w in t.split():
            counts[lang, 0, w] += 1
            for n in range(1, 6):
                counts.update((lang, n, g) for g in langid.grams(w, n))
    m = language_model([(*k, c) for k, c in counts.items()])
    totals, kinds = Counter(), {n: len({g for _, k, g in counts if k == n}) for n in range(6)}
    for (lang, n, _), c in counts.items():
        totals[lang, n] += c

    def log(n, g):
        return [np.log(counts[k, n, g] + 0.5) - np.log(totals[k, n] + 0.5 * (kinds[n] + 1)) for k in "xy"]

    def plain(w):
        if any((k, 0, w) in counts for k in "xy"):
            return log(0, w)
        for n in range(5, 0, -1):
            hit = [log(n, g) for g in langid.grams(w, n) if any((k, n, g) in counts for k in "xy")]
            if hit:
                return np.mean(hit, 0)
        return [0, 0]

    probes = [" ".join(rng.choice((word["x"], word["y"], lambda: "qqq"))() for _ in range(rng.randint(1, 30))) for _ in range(60)]
    for t, (lang, score) in zip(probes, m.predict(probes), strict=True):
        total, n = np.sum([plain(w) for w in t.split()], 0), len(t.split())
        odds = np.exp((total - total.max()) * min(n, langid.EVIDENCE) / n)
        assert score == pytest.approx(1 / odds.sum(), abs=1e-4)
        assert lang == "xy"[int(np.argmax(total))] or abs(total[0] - total[1]) < 1e-3


def test_packed_arrays():
    rng = np.random.default_rng(6)
    for n in (0, 1, 1000):
        a = np.sort(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert (lm.loosen_sorted(lm.squeeze_sorted(a)) == a).all() if n else True
        c = rng.integers(0, 9, n).astype(np.uint32)
        assert (lm.loosen(lm.squeeze(c), "<u4") == c).all()


def test_weights_rise_in_likelihood():
    rng = np.random.default_rng(7)
    h = np.stack([rng.integers(0, 3, 200), rng.integers(-8, 20, 200), np.where(rng.random(200) < 0.5, -1000, rng.integers(10, 60, 200)), rng.integers(1, 50, 200)], 1)
    h[h[:, 0] == 0, 2] = -1000  # contexts that were never met have no pairs
    w = lm.learn_weights(h)
    assert np.allclose(w.sum(1), 1) and (w >= 0).all()

    def likelihood(weights):
        r = np.stack([np.ones(len(h)), np.exp(h[:, 1] / lm.STEP), np.where(h[:, 2] <= -1000, 0, np.exp(h[:, 2] / lm.STEP))], 1)
        return (h[:, 3] * np.log((r * weights[h[:, 0]]).sum(1))).sum()

    assert likelihood(w) > likelihood(np.full_like(w, 1 / 3))


def test_recursive_join_equals_all_pairs(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((700, 16))
    x[300:] = x[:400] + 0.03 * rng.standard_normal((400, 16))
    p = np.linalg.eigh(np.cov(x.T))[1][:, ::-1].copy()
    monkeypatch.setattr(embeddings, "LEAF", 64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    a, b = embeddings.Interval(x[:350], p), embeddings.Interval(x[350:], p)
    for first, second, want in ((a, b, u[:350] @ u[350:].T >= 0.95), (b, b, np.triu(u[350:] @ u[350:].T >= 0.95, 1))):
        got = [z for i, j in embeddings.linked(first, second, 0.95) for z in zip(i.tolist(), j.tolist(), strict=True)]
        assert len(set(got)) == len(got) and set(got) == {tuple(z) for z in np.argwhere(want).tolist()}


def test_vectors_of_any_size():
    for v in ([1.0, 2.0], [1e-200, 2e-200], [1e200, 2e200], [0.1, 0.2], [3e-320, 0.0], [1e308, -1e308]):
        w = embeddings._vector(embeddings._valid(v))
        assert 0.5 <= np.abs(w).max() < 1 and embeddings._length(embeddings._valid(v)) == 2
    assert embeddings._valid([1e-200, 2e-200]) != embeddings._valid([1.0, -2.0]) and embeddings._valid([1.0, 2.0]) == embeddings._valid([4.0, 8.0])
    assert [embeddings._valid(v) for v in (None, [], [0.0, -0.0], [None], [math.inf], [math.nan, 1.0])] == [None] * 6


def test_statistics_of_any_text():
    for t in (None, b"", b"  ", b"!", "é".encode(), b"word " * 2000):
        s = quality.statistics(t)
        assert len(s) == len(quality.statistics(None)) and all(np.isfinite(s))


def test_gram_marks():
    assert langid.grams("ab", 1) == ["a", "b"] and langid.grams("ab", 3) == ["\x02ab", "ab\x03"] and Counter(langid.grams("a", 3)) == {"\x02a\x03": 1}


def test_region_never_shrinks():
    body = "words of the article body are here and there are many of them in it " * 3
    assert html.main_text(f"<main><h1>Title</h1><article><p>{body}</p></article></main>")[0] == f"Title\n\n{body.strip()}"
    two = html.main_text(f"<body><nav>menu</nav><article><p>{body * 3}</p></article><article><p>{body * 2}</p></article><footer>f</footer></body>")[0]
    assert two == f"{(body * 3).strip()}\n\n{(body * 2).strip()}"
