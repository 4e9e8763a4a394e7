"""The operators on small tables: brute force, nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, components, embeddings, html, langid, lm, packing, pieces, quality, registry, rules, sharding, simhash
from tests.llm.test_small import PAGE, brute_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, FP long, row string, node long, t string, score double, n long, gid string, label int, fold int, block long"
EN = "the and with from this that they have been when where which about there house water light"
DE = "der und mit von das nicht haben werden wenn über häuser schön größe straße bücher zurück"
JUNK = "BUY!! NOW!! ***$$$ &&& ### %%% WOW!! FREE!!"


def held(i, n, r):
    return zlib.crc32(str(i).encode()) % n == r


def text_of(i):
    words = (EN if i % 3 else DE).split()
    return " ".join(words[(i * 7 + k * (i % 5 + 1)) % len(words)] + ("." if k % 9 == 8 else "") for k in range(20 + i % 17))


@pytest.fixture(scope="module")
def rows():
    out = [(i, text_of(i), "en" if i % 3 else "de", f"s{i % 4}") for i in range(120)]
    out += [(i, " ".join(JUNK.split()[(i + k) % 7] for k in range(40)), "en", "s0") for i in range(120, 150)]
    out += [(200 + i, text_of(4), None, "s1") for i in range(5)]  # copies
    out += [(300, None, None, None), (301, "", "en", "s"), (302, " \n\t", "de", "s"), (303, "x", None, "s"), (304, "12 34", "en", None)]
    out += [(305, text_of(7) * 400, "en", "s"), (4, text_of(4), "en", "s0"), (None, text_of(9), "en", "s"), (None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(*r, len(r[1] or ""), 1, "r", 2, "t", 0.5, 3, "g", 4, 5, 6) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i < 120), 0, "x") for i in range(150)] + [(5, 1, None, "y"), (None, 1, 0, "z"), (7, None, 0, ""), (9999, 0, 0, "")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def components_of(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (150, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)] * 2 + [(7000, k) for k in range(8000, 8100)]
    got = components.connected_components(spark.createDataFrame(links, "u long, v long"), "test")
    assert {r.node: r.root for r in got.collect()} == components_of(links, {x for p in links for x in p})
    assert components.connected_components(spark.createDataFrame([], "u long, v long"), "test").count() == 0


def test_simhash(spark, docs, rows, empty, monkeypatch):
    got = simhash.simhash_components(docs)
    fps = [(i, brute_fingerprint(t or "")) for i, t, *_ in rows]
    distinct = sorted({f for _, f in fps})
    class_of = components_of([(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2], distinct)
    least = {}
    for i, f in fps:
        if i is not None:
            least[class_of[f]] = min(i, least.get(class_of[f], i))
    assert by_row(got, "doc_id", "fingerprint", "component_id") == Counter((i, f"{f:016x}", least.get(class_of[f])) for i, f in fps)
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({i for i, f in fps if i is not None and least[class_of[f]] == i})
    assert simhash.drop_near_copies(empty).count() == 0


def test_near_edges_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (200, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 50)}
    edges = [(r.u, r.v) for r in simhash.near_edges(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    want = components_of([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2], fps)
    assert components_of(edges, fps) == want


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(docs, length=64).collect()
    ids = Counter((i, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 1])) for i, t, *_ in rows)
    sequences, documents = {}, {}
    for r in got:
        piece = np.frombuffer(r.ids, "<u4")
        assert len(piece) == r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        documents.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, tuple(piece.tolist())))
    for k, parts in sequences.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or k == max(sequences) and at < 64
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(r.length for r in got) == sum(len(x) * c for (_, x), c in ids.items())
    for (i, x), c in ids.items():
        if c == 1 and sum(k[0] == i and len(k[1]) == len(x) for k in ids) == 1:
            assert tuple(v for _, p in sorted(documents[i, len(x)]) for v in p) == x
    # the order along the curve, from each document's ids alone
    def key(x):
        return int(packing.hilbert_key(packing.document_points(np.array(x, "<u2"), np.array([len(x)])))[0])

    places = {}
    for r in got:
        if r.start == 0:
            places.setdefault((r.doc_id, r.doc_tokens), []).append(r.sequence_id * 64 + r.offset)
    along = sorted((min(places[i, len(x)]), key(x)) for (i, x), c in ids.items() if sum(k[0] == i and len(k[1]) == len(x) for k in ids) == 1)
    assert [k for _, k in along] == sorted(k for _, k in along)
    assert packing.pack(empty).count() == 0


def test_language(docs, rows, empty):
    got = langid.identify(docs)
    for r in got.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 4 == 2) and 0 <= r.score <= 1
    found = {r.doc_id: (r.lang_pred, r.score) for r in got.collect() if r.doc_id is not None}
    assert [found[i][0] for i in (300, 301, 302, 304)] == ["und"] * 4 and found[300][1] == 0
    assert all(found[i][0] == ("en" if i % 3 else "de") for i in range(120))
    assert got.count() == len(rows) and langid.identify(empty).count() == 0
    assert set(r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()) == {"und"}
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and not {300, 301, 302, 304} & {r.doc_id for r in kept.collect()}
    assert {*range(120)} <= {r.doc_id for r in kept.collect()}


def test_quality(spark, docs, rows, labels, empty):
    got = quality.classify(docs, labels)
    assert got.count() == len(rows)
    for r in got.collect():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 4 == 2)
    right = [r.predicted == int(r.doc_id < 120) for r in got.where("doc_id < 150 and held_out").collect()]
    assert sum(right) >= 0.95 * len(right)
    assert quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {1.0}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and not [r for r in kept.collect() if r.doc_id is not None and 120 <= r.doc_id < 150]


def test_rules(docs, rows, labels, empty):
    got = rules.apply_rules(docs, labels.where("quality = 1"))
    plain = {}
    for i, text, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        often, covered, seen, dup = Counter(windows), set(), set(), 0
        for k, x in enumerate(windows):
            covered |= set(range(k, k + 5)) if often[x] > 1 else set()
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        plain.setdefault(i, []).append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_row(got, "doc_id", *names) == Counter((i, *x) for i, xs in plain.items() for x in xs)
    for r in got.collect():
        assert r.kept == (not r.base_failed and r.score >= rules.THRESHOLD)
        if r.doc_id is not None and 120 <= r.doc_id < 150:
            assert r.score < rules.THRESHOLD
    assert rules.apply_rules(empty, labels).count() == 0
    assert {r.score for r in rules.apply_rules(docs, labels.limit(0)).collect()} == {0.0}
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_rule_scores_equal_their_definition(spark, docs, labels):
    """The mean log ratio, from hashes that Spark gives for the n-grams alone."""
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()} - {None}
    grams = docs.select("doc_id", F.explode(rules._let(rules.words(rules._text("text")), rules.buckets)).alias("b")).collect()
    raw, target = Counter(r.b for r in grams), Counter(r.b for r in grams if r.doc_id in trusted)
    size = lambda c, k: sum(v for b, v in c.items() if b // rules.BUCKETS == k) + rules.BUCKETS
    log = {b: math.log((target[b] + 1) / size(target, b // rules.BUCKETS)) - math.log((raw[b] + 1) / size(raw, b // rules.BUCKETS)) for b in raw}
    own = Counter()
    for r in grams:
        if r.doc_id == 50:
            own[r.b] += 1
    score = {r.doc_id: r.score for r in rules.apply_rules(docs, labels.where("quality = 1")).collect()}
    assert score[50] == pytest.approx(sum(log[b] * n for b, n in own.items()) / sum(own.values()), abs=1e-9)


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


@pytest.mark.parametrize("size", [2_000_000, 300])
def test_language_model(docs, rows, empty, size, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", size)
    got = lm.score(docs).collect()
    learned = [r for r in rows if not held("" if r[0] is None else r[0], 5, 1)]
    counts = Counter(w for r in learned for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, *_ in rows:
        own = tokens(t)
        want[i, held("" if i is None else i, 5, 1), len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    test = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    if size > 300:
        assert lm.score(empty).count() == 0


class PlainModel:
    """The model by its definition, from token lists; None is the end, and stands for the start as a context."""

    def __init__(self, docs):
        learned = [(i, tokens(t)) for i, t in docs if not held(i, 5, 1)]
        kept = [(i, w) for i, w in learned if not held(i, 5, 0)]
        one, two, first = self.count(kept)
        self.words, self.pairs, self.starts = self.count(learned)
        self.kinds, self.total, total = len(self.words), sum(self.words.values()), sum(one.values())
        rows = Counter()
        for i, w in learned:
            if held(i, 5, 0):
                for a, b in zip([None, *w], w):
                    n = first if a is None else one[a]
                    ratios = [one[b] / max(1, total) * (self.kinds + 1), two[a, b] / n * (self.kinds + 1) if n else 0]
                    rows[(min(int(math.log2(n + 1)), lm.CONTEXTS - 1), *(round(math.log(x) * lm.STEP) if x else -1000 for x in ratios))] += 1
        self.weights = lm.learn_weights(np.array([(*k, n) for k, n in rows.items()], np.int64).reshape(-1, 4))

    @staticmethod
    def count(docs):
        return Counter(x for _, w in docs for x in w), Counter(p for _, w in docs for p in zip([None, *w], w)), len(docs)

    def p(self, before, word):
        n = self.starts if before is None else self.words[before]
        u, w, pair = self.weights[min(int(math.log2(n + 1)), lm.CONTEXTS - 1)]
        return u / (self.kinds + 1) + w * self.words[word] / max(1, self.total) + pair * self.pairs[before, word] / max(1, n)

    def score(self, text):
        w = tokens(text)
        return sum(math.log10(self.p(a, b)) for a, b in zip([None, *w], w))


def test_language_model_equals_its_definition(spark, docs, rows):
    rng = np.random.default_rng(13)
    small = [(i, " ".join(rng.choice(list("aabbbcd") + [f"w{i % 9}"], int(rng.integers(0, 12))))) for i in range(300)] + [(9000 + i, "never met zzz a") for i in range(20)]
    for table in (small, [(i, t) for i, t, *_ in rows if i is not None]):
        model = PlainModel(table)
        got = lm.score(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()
        assert Counter((r.doc_id, round(r.score, 6)) for r in got) == Counter((i, round(model.score(t), 6)) for i, t in table)
        for before in [None, *list(model.words)[:40], "never met"]:  # the end is no context; None is the start
            if before is not None or model.starts:
                assert sum(model.p(before, w) for w in [*model.words, "unseen"]) == pytest.approx(1, abs=1e-9), before


def test_sharding(docs, rows, empty, spark):
    got = sharding.shard(docs).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert sharding.shard(empty).count() == 0
    one = sharding.shard(docs.limit(1)).collect()
    assert len(one) == 1 and one[0].slot == 0


def test_copies_share_a_shard(spark):
    rows = [(i, f"text {i % 400}" if i < 800 else f"only {i}") for i in range(2000)] + [(5000 + i, "hot") for i in range(1000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"))
    of = {r.doc_id: r.shard for r in got.collect()}
    cut = sum(of[i] != of[i + 400] for i in range(400))
    assert cut <= 8
    assert len({of[5000 + i] for i in range(1000)}) <= 4
    assert max(Counter(of.values()).values()) - min(Counter(of.values()).values()) <= 1


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    monkeypatch.setattr(embeddings, "LEAF", 8)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 12))
    x[60:110] = x[:50] * rng.uniform(0.5, 3, (50, 1)) + 0.12 * rng.standard_normal((50, 12))
    x[110:] = x[0]
    vectors = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(500, None), (501, [0.0] * 12), (502, [math.nan] + [1.0] * 11), (503, [None] + [1.0] * 11), (504, []), (505, [math.inf] * 12), (506, [1.0, 2.0]), (507, [2.0, 4.0]), (508, [1e-200, 2e-200]), (509, [1e200, 2e200]), (510, [1e200, 1.0]), (511, [1e-310, 0.0]), (3, x[3].tolist()), (None, x[5].tolist())]
    table = spark.createDataFrame([(i, v, 1, "u") for i, v in vectors + odd], "vec_id long, embedding array<double>, label int, uid string").repartition(3)
    got = embeddings.near_duplicates(table)
    good = [(k, i, np.array(v) / np.abs(v).max()) for k, (i, v) in enumerate(vectors + odd) if v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a, b) for a, _, u in good for b, _, w in good if a < b and len(u) == len(w) and u @ w / (np.sqrt(u @ u) * np.sqrt(w @ w)) >= 0.95]
    root = components_of(links, range(len(vectors + odd)))
    least = {}
    for k, (i, _) in enumerate(vectors + odd):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    n = Counter(x for p in links for x in p)
    want = Counter((i, n[k], least.get(root[k]), i == least.get(root[k])) for k, (i, _) in enumerate(vectors + odd))
    assert by_row(got, "vec_id", "n_links", "component_id", "kept") == want
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "word " * 30_000 + "</p>")]
    table = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html.extract(table).collect()]
    want = [(i, u, html.main_text(h)[0]) for i, u, h in rows]
    assert sorted(map(str, got)) == sorted(str((*w, len(w[2]))) for w in want)
    assert html.extract(table.limit(0)).count() == 0


def test_sentencepiece(docs, rows, empty):
    encoded = pieces.encode(docs)
    got = encoded.collect()
    p = pieces.Pieces(pieces.model_path())
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(p.encode(t).tolist())) for i, t, *_ in rows)
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in got)
    assert Counter((r.doc_id, r.text) for r in pieces.decode(encoded).collect()) == Counter((i, t or "") for i, t, *_ in rows)
    assert pieces.encode(empty).count() == 0 and pieces.decode(pieces.encode(empty)).count() == 0


def test_pipeline(spark, docs, labels, tmp_path):
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    kept, counts = spark.read.parquet(f"{d}/documents.parquet"), [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, d)
        assert kept.columns == docs.columns, name
        kept.write.parquet(f"{d}/{name}")
        kept = spark.read.parquet(f"{d}/{name}")
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[3] < counts[2]
    ids = [r.doc_id for r in kept.collect()]
    assert len(set(ids)) == len(ids) and not {300, 301, 302, 304} & set(ids) and not set(range(120, 150)) & set(ids) and not set(range(200, 205)) & set(ids)
    out = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(ids)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0, name


def test_registry():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES} == set(range(1, 11))


def test_stored_tables_go(spark):
    from tessera.llm import common

    table = common.Stored(spark.range(3).toDF("x"), "test")
    assert table.read().count() == 3 and table in common._tables(spark)
    common.drop_stored(spark)
    assert not common._tables(spark)
    fs, at = common._files(spark, table.path)
    assert not fs.exists(at)


def test_similar_documents_are_near_copies(spark, monkeypatch):
    """Five words, 0.8: equal to brute force, far beyond two bits of a fingerprint."""
    from tessera.llm import similar

    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 120))) for _ in range(40)] + ["", None, " ", "One two", "one two", "same " * 30]
    passage = " ".join(rng.choice(words, 90))
    texts += [f"{passage} {' '.join(rng.choice(words, k))}" for k in range(1, 22) for _ in range(4)]  # all share most of a passage; few are alike
    for t in texts[:40]:
        for k in (1, 2, 3, 4):
            w = t.split()
            for at in rng.integers(0, len(w), k):
                w[at] = "new"
            texts.append(" ".join(w))
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    sets = [set(similar.shingle_set((t or "").encode(), 5).tolist()) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if not sets[i] | sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = components_of(links, range(len(texts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
    want = sorted({*root.values()})
    for documents, chunk, nearest in ((5_000, 2048, 8), (30, 4, 1)):
        monkeypatch.setattr(similar, "ORDER_DOCUMENTS", documents)
        monkeypatch.setattr(similar, "NEAREST", nearest)
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        kept = corpus_pipeline.near_duplicates(spark, docs, "")
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want
    assert len(want) < simhash.drop_near_copies(docs).count()


@pytest.mark.parametrize("size", [5, 20])
def test_groups_come_together_in_full_shards(spark, size):
    """Where every row has copies, only groups at the shards' borders are split."""
    n = 8000
    got = sharding.shard(spark.createDataFrame([(i, f"text {i % (n // size)}") for i in range(n)], "doc_id long, text string"))
    of = {}
    for r in got.collect():
        of.setdefault(r.doc_id % (n // size), set()).add(r.shard)
    assert sum(len(x) > 1 for x in of.values()) <= 7


def test_full_shards_swap():
    assert sharding._admit({(0, 1): [(0, 5), (3, 4)], (1, 0): [(1, 5)]}, {0: 0, 1: 0}) == {(0, 1): 0, (1, 0): 1}
    assert sharding._admit({(0, 1): [(0, 5)], (1, 2): [(2, 5)]}, {0: 0, 1: 0, 2: 5}) == {(0, 1): 0, (1, 2): 2}
    assert sharding._admit({(0, 1): [(0, 5)]}, {0: 0, 1: 4}) == {(0, 1): -1}


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_rows_that_share_an_id_are_documents(spark, similarity):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcde")
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (3, c), (7, e), (7, e), (None, e)]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), similarity=similarity)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(None, a), (None, b), (3, c), (5, d), (7, e)])


def test_every_trusted_document_counts(spark):
    n = 21_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20_500, F.lit("good")).otherwise(F.lit("bad")).alias("text"))
    got = rules.weights(docs, spark.range(20_500).select(F.col("id").alias("doc_id")))
    good = spark.range(1).select(F.pmod(F.xxhash64(F.lit("good")), F.lit(rules.BUCKETS))).first()[0]
    want = math.log((20_500 + 1) / (20_500 + rules.BUCKETS)) - math.log((20_500 + 1) / (n + rules.BUCKETS))
    assert got[good] == pytest.approx(want, abs=1e-12)


def test_rare_languages_are_learned(spark):
    assert langid.shares({"a": 1000, "b": 5, "c": 40}, 90) == {"b": 5, "c": 40, "a": 45}
    docs = [(i, text_of(3 * i + 1), "en") for i in range(2000)] + [(5000 + i, "xyq zuvq wqqo", "rare") for i in range(12)]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), most=20_000)
    assert model.langs == ["en", "rare"] and model.predict(["zuvq xyq"])[0][0] == "rare"


def test_words_that_occur_once_are_learned(spark):
    texts = [("en", "the dog"), ("en", "a dog"), ("fr", "le chien"), ("de", "ein hund"), ("de", "der hund"), ("en", "the end")]
    texts = [(i, t, lang) for i, (lang, t) in zip((i for i in range(100) if not held(i, 4, 2)), texts, strict=False)]
    got = langid.identify(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: lang for i, _, lang in texts}


def test_unrelated_documents_of_a_shingle_are_no_candidates(spark, monkeypatch):
    """Documents that share a shingle, and nearly the fingerprint's radius, aren't paired unless their sketches are near; near copies always are."""
    from tessera.llm import similar

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 10**6, 100)) for _ in range(200)]
    texts += [f"{t[: t.rindex(' ')]} other" for t in texts[:50]]
    sets = [similar.shingle_set(t.encode(), 5) for t in texts]
    rows = [(1, i, len(h), len(h), simhash.majority(h.view(np.uint64)), *map(int, similar.sketch(h.view(np.uint64))), i) for i, h in enumerate(sets)]
    rows = [(*r[:4], int(np.uint64(r[4]).view(np.int64)), *r[5:]) for r in rows]
    posts = spark.createDataFrame(rows, "h long, node long, n int, rest int, fp long, s long, t long, root long")
    got = similar._nearest(posts, 80, 8).collect()
    assert sorted((r.u, r.v) for r in got) == [(i, 200 + i) for i in range(50)]


def shuffled_bytes(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(s.shuffleWriteBytes() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))


def test_texts_of_trusted_documents_stay_in_place(spark, monkeypatch):
    """Even where Spark broadcasts no ids; what the bitmaps leave unclear is decided by the ids themselves."""
    rng = np.random.default_rng(3)
    rows = [(i % 250 if i % 50 else None, " ".join(map(str, rng.integers(0, 1 << 62, 500).tolist()))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    trusted = spark.createDataFrame([(i,) for i in [*range(3, 140), *range(240, 300), 7, None]], "doc_id long")
    ids = {r.doc_id for r in trusted.collect()} - {None}
    plain = rules.weights(docs, docs.where(F.col("doc_id").isin(ids)).select("doc_id"))
    docs.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_bytes(spark)
        got = rules.weights(docs, trusted)
        moved = shuffled_bytes(spark) - before
        monkeypatch.setattr(rules, "LEAST_BITS", 64)
        monkeypatch.setattr(rules, "MOST_BITS", 64)
        unclear = rules._trusted_or_unclear(docs.select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("t")), trusted.select(F.col("doc_id").cast("string").alias("key"), F.lit(True).alias("known")).where("key is not null").distinct())
        marks = {(r.key, r.sure, r.unclear) for r in unclear.collect()}
        assert rules.weights(docs, trusted) == got == plain
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(u for _, _, u in marks) > 50 and (None, False, False) in marks
    assert all(u or s == (k is not None and int(k) in ids) for k, s, u in marks)
    assert moved < sum(len(t) for _, t in rows) / 3


@pytest.mark.parametrize("most", [8192, 1])
def test_documents_stay_in_place(spark, most, monkeypatch):
    """Even where Spark broadcasts no row numbers; numbers too far apart for a bitmap are joined. What is stored on the way goes."""
    monkeypatch.setattr(common, "MOST_CHUNKS", most)
    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.integers(0, 1 << 62, 500).tolist())) for _ in range(300)]
    texts += [" ".join(t.split()[:495]) for t in texts[:60]] + texts[100:120]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6).cache()
    docs.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before, tables = shuffled_bytes(spark), len(common._tables(spark))
        kept = simhash.drop_near_copies(docs, similarity=0.8)
        middle = shuffled_bytes(spark)
        assert {r.doc_id for r in kept.collect()} == set(range(300))
        if most > 1:
            assert shuffled_bytes(spark) - middle < 100_000 < sum(map(len, texts)) / 30
            assert len(common._tables(spark)) - tables == 3  # documents, kept rows and their bitmap
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    numbers = spark.createDataFrame([(i,) for i in (-(1 << 63), -1, 0, 7, 32767, 32768, 1 << 33, (1 << 63) - 1)], "node long")
    need = spark.createDataFrame([(i,) for i in (-(1 << 63), 7, 32768, (1 << 63) - 1, 6, -2)], "node long")
    assert {r.node for r in common.only(numbers, need, "node", "bits").collect()} == {-(1 << 63), 7, 32768, (1 << 63) - 1}
