"""Operators against plain versions of their definitions, written without the code under test."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import langid, packing, quality
from tests.llm.test_operators import components_of, docs, empty, held, labels, rows  # noqa: F401  fixtures


def plain_statistics(text):
    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, size = len(words), max(1, len(data))
    upper, lower = sum(65 <= c <= 90 for c in data), sum(97 <= c <= 122 for c in data)
    share = lambda kind: math.sqrt(sum(c in kind for c in data) / size)
    ascii_words = [w for w in words if max(w) < 128]
    return [
        math.log(1 + n), len(data) / max(1, n), upper / max(1, upper + lower), (upper + lower) / size, share(b"0123456789"), share(b"#*$%&|<>{}[]\\^~_=+@/"), share(b"!?"), share(b".,;:"),
        len(set(words)) / max(1.0, n**0.9), len({tuple(words[i : i + 3]) for i in range(n - 2)}) / max(1, n - 2) if n > 2 else 1.0, len(set(lines)) / max(1, len(lines)),
        math.log(1 + n / max(1, len(lines))), sum(w.isalpha() for w in ascii_words) / max(1, len(ascii_words)), sum(len(w) == 1 for w in words) / max(1, n), math.log(1 + max(map(len, words), default=0)),
    ]


def plain_isotonic(x, y):
    """By the minimax formula: the largest of the smallest means."""
    order = np.argsort(x, kind="stable")
    x, y = np.array(x)[order], np.array(y)[order]
    n = len(y)
    mean = lambda a, b: y[a : b + 1].mean()
    fitted = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
    blocks = sorted({round(v, 9) for v in fitted})
    return [x[np.isclose(fitted, v, atol=1e-8)].mean() for v in blocks], blocks


def test_quality_equals_its_definition(spark, docs, rows, labels):  # noqa: F811
    known = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None and not held(r.doc_id, 4, 2):
            known[r.doc_id] = min(r.quality, known.get(r.doc_id, 1))
    train = [(i, t, known[i]) for i, t, *_ in rows if i in known]
    raw = np.array([plain_statistics(t) for _, t, _ in train])
    mean, scale = raw.mean(0), np.maximum(raw.std(0), 1e-6)
    rng = np.random.default_rng(quality.SEED)
    w = rng.standard_normal((raw.shape[1], quality.FEATURES)) / math.sqrt(raw.shape[1])
    shift = rng.uniform(0, 2 * math.pi, quality.FEATURES)

    def features(texts):
        x = np.clip((np.array([plain_statistics(t) for t in texts]) - mean) / scale, -6, 6)
        return np.array([[*(math.sqrt(2 / quality.FEATURES) * np.cos(v @ w + shift)), 1.0] for v in x])

    calibrates = {r.i: r.c for r in spark.createDataFrame([(i,) for i, *_ in train], "i long").select("i", (F.pmod(F.xxhash64("i", F.lit(11)), F.lit(4)) == 0).alias("c")).collect()}
    fits = [(t, y) for i, t, y in train if not calibrates[i]]
    z, y = features([t for t, _ in fits]), np.array([y for _, y in fits], float)
    penalty = math.sqrt(quality.RIDGE * len(z) / quality.FEATURES)
    weights = np.linalg.lstsq(np.vstack([z, penalty * np.eye(z.shape[1])]), np.append(y, np.zeros(z.shape[1])), rcond=None)[0]
    held_back = [(t, y) for i, t, y in train if calibrates[i]]
    places, values = plain_isotonic(features([t for t, _ in held_back]) @ weights, [y for _, y in held_back])
    want = np.clip(np.interp(features([t for _, t, *_ in rows]) @ weights, places, values), 0, 1)
    got = quality.classify(docs, labels).collect()
    assert sorted((str(r.doc_id), round(r.score, 3)) for r in got) == sorted((str(i), round(float(s), 3)) for (i, *_), s in zip(rows, want, strict=True))


def test_pipeline_equals_its_definition(spark, docs, labels, tmp_path):  # noqa: F811
    """Rejected documents go, near copies by brute force, and the rest is packed whole."""
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    table = spark.read.parquet(f"{d}/documents.parquet")
    model = langid.fit(table)
    kept = [r for r in table.collect() if model.predict([r.text])[0][1] >= 0.5]
    good = {(r.doc_id, r.text) for r in kept}
    judge = quality.fit(spark.createDataFrame(kept, table.schema), labels)
    kept = [r for r in kept if judge.score([None if r.text is None else r.text.encode()])[0] >= 0.7]
    assert 0 < len(kept) < len(good)

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(r.text) for r in kept]
    links = [(a, b) for a in range(len(kept)) for b in range(a) if not sets[a] | sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    groups = {}
    for k, root in components_of(links, range(len(kept))).items():
        groups.setdefault(root, []).append(kept[k])
    survivors = [min(g, key=lambda r: (r.doc_id is None, r.doc_id)) for g in groups.values()]
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in survivors)
    got = corpus_pipeline.run(spark, d).collect()
    assert Counter({(i, n): c for (i, n), c in Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0).items()}) == want
    whole = {(r.doc_id, len(ids)): ids for r in survivors for ids in [[*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]]}
    at = 0
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * packing.LENGTH + r.offset == at
        at += r.length
        if want[r.doc_id, r.doc_tokens] == 1:
            assert r.ids_crc32 == zlib.crc32(np.array(whole[r.doc_id, r.doc_tokens][r.start : r.start + r.length], "<u4").tobytes())
    assert at == sum(n * c for (_, n), c in want.items())


def test_isotonic_equals_the_minimax_formula():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.random(30), (rng.random(30) < 0.5).astype(float)
        assert quality.isotonic(x, y)[1] == pytest.approx(plain_isotonic(x, y)[1], abs=1e-6)
