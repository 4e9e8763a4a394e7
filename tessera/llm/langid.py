"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bucket_of, ship

#: Characters of labelled documents that are learned from at most (in expectation; documents are chosen whole, by a hash of their id), shared among the languages.
MAX_TRAINING_CHARACTERS = 24_000_000
LONGEST = 5
#: Hashes of ids are cut at one of so many steps.
HASHES = 1 << 40
#: Words that a worker remembers; a full memory starts anew.
REMEMBERED = 200_000
#: Documents count as evidence of so many words at most in the score (never in the prediction).
EVIDENCE = 20
WORD = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its two ends marked; a single character has no marks."""
    if n == 1:
        return list(word)
    w = f"\x02{word}\x03"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def hashes(items: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in items), np.uint64, len(items))


class Model:
    """Log frequencies by language: of words, and of n-grams of each length, by their hashes."""

    def __init__(self, langs: list[str], n: np.ndarray, gram: np.ndarray, lang: np.ndarray, count: np.ndarray):
        """Counts of grams: n (0: word), the gram's hash, the language's place in langs, which are sorted."""
        self.langs = langs
        self.keys: list[np.ndarray] = []
        self.logs: list[np.ndarray] = []
        for k in range(LONGEST + 1):
            own = n == k
            keys, at = np.unique(gram[own], return_inverse=True)
            c = np.bincount(at * len(langs) + lang[own], count[own], len(keys) * len(langs)).reshape(len(keys), len(langs))
            self.keys.append(keys)
            self.logs.append((np.log(c + 0.5) - np.log(c.sum(0) + 0.5 * (len(keys) + 1))).astype(np.float32))
        self.start()

    def start(self) -> None:
        """A worker's memory of words begins anew."""
        self.rows: dict[str, int] = {}
        self.memory = np.zeros((0, len(self.langs)), np.float32)

    def _find(self, n: int, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which items are known, and their rows."""
        keys, h = self.keys[n], hashes(items)
        at = np.searchsorted(keys, h)
        known = at < len(keys)
        known[known] = keys[at[known]] == h[known]
        return known, at

    def logs_of(self, words: list[str]) -> np.ndarray:
        """A word's log frequencies; of an unseen one, the mean of its longest n-grams of which any is known; else zeros."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        known, at = self._find(0, words)
        out[known] = self.logs[0][at[known]]
        left = np.flatnonzero(~known).tolist()
        for n in range(LONGEST, 0, -1):
            if not left:
                break
            parts = [grams(words[k], n) if len(words[k]) + 2 >= n else [] for k in left]
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            known, at = self._find(n, [g for p in parts for g in p])
            of = np.repeat(np.arange(len(left)), size)[known]
            hits = np.bincount(of, minlength=len(left))
            sums = np.stack([np.bincount(of, self.logs[n][at[known], k], len(left)) for k in range(len(self.langs))], 1)
            hit = np.flatnonzero(hits)
            out[np.array(left)[hit]] = sums[hit] / hits[hit, None]
            left = [left[k] for k in np.flatnonzero(hits == 0).tolist()]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [self._predict(t) for t in self._learned(texts)]

    def _learned(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """Each text's sum of log frequencies and number of words; None if it has none. Words are looked up for many texts at once."""
        held: list[list[str] | None] = []
        new: dict[str, None] = {}

        def turn() -> Iterator[np.ndarray | None]:
            if len(self.rows) + len(new) > REMEMBERED and self.rows:
                self.start()
                new.update(dict.fromkeys(w for ws in held if ws for w in ws))
            fresh = list(new)
            self.rows.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
            self.memory = np.concatenate([self.memory, self.logs_of(fresh)])
            for ws in held:
                yield None if ws is None else np.append(self.memory[np.fromiter(map(self.rows.__getitem__, ws), np.int64, len(ws))].sum(0, dtype=np.float64), len(ws))

        for t in texts:
            ws = WORD.findall(t.lower()) if t else []
            held.append(ws if ws and self.langs and any(map(str.isalpha, t)) else None)
            if held[-1]:
                new.update(dict.fromkeys(w for w in ws if w not in self.rows))
            if len(new) >= REMEMBERED // 4:
                yield from turn()
                held, new = [], {}
        yield from turn()

    def _predict(self, found: np.ndarray | None) -> tuple[str, float]:
        if found is None:
            return "und", 0.0
        total, n = found[:-1], found[-1]
        best = int(np.argmax(total))  # a tie: the first language by name
        odds = np.exp((total - total[best]) * min(n, EVIDENCE) / n)
        return self.langs[best], float(1 / odds.sum())


def shares(sizes: dict[str, int], most: int) -> dict[str, float]:
    """How much of each language is learned from: all of the small ones, equally much of the others, `most` at most."""
    out, left = {}, float(most)
    for k, lang in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):
        out[lang] = min(float(sizes[lang]), left / (len(sizes) - k))
        left -= out[lang]
    return out


def fit(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", most: int = MAX_TRAINING_CHARACTERS) -> Model:
    """Learns from text and non-null lang of documents that are not held out (crc32 of the id, modulo 4, is 2).

    Documents of about `most` characters, chosen by hash, are learned from, with their whole texts; so the model is bounded. A language
    with less than its share of `most` is learned from wholly, and leaves the rest to the others. Every word and n-gram of them counts.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l"))
    rows = rows.where((bucket_of("i", 4) != 2) & F.col("l").isNotNull())
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.sum(F.coalesce(F.length("t"), F.lit(0)) + 1).alias("n")).collect()}  # one row a language
    langs = sorted(sizes)
    place = {x: k for k, x in enumerate(langs)}
    if sum(sizes.values()) > most:
        cuts = [F.when(F.col("l") == l, F.lit(int(HASHES * share / sizes[l]))) for l, share in shares(sizes, most).items() if share < sizes[l]]
        rows = rows.where(F.pmod(F.xxhash64("i", F.lit(5)), F.lit(HASHES)) < F.coalesce(*cuts, F.lit(HASHES)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Counter] = {}
        for b in batches:
            for t, l in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                total.setdefault(place[l], Counter()).update(WORD.findall(t.as_py().lower()) if t.is_valid else ())
        for l, words in total.items():
            for k in range(LONGEST + 1):
                table: Counter = words if k == 0 else Counter()
                if k:
                    for w, c in words.items():
                        for g in grams(w, k):
                            table[g] += c
                items = list(table)
                for i in range(0, len(items), 50_000):
                    part = items[i : i + 50_000]
                    m = len(part)
                    columns = [pa.array(np.full(m, l, np.int32)), pa.array(np.full(m, k, np.int32)), pa.array(hashes(part).view(np.int64)), pa.array([table[g] for g in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "n", "gram", "count"])

    counted = rows.select("t", "l").mapInArrow(count, "lang int, n int, gram long, count long")
    found = counted.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")).toArrow()  # bounded by the training documents
    lang_at, n, gram, times = (found.column(c).to_numpy() for c in ("lang", "n", "gram", "count"))
    return Model(langs, n, gram.view(np.uint64), lang_at, times)


def predictor(docs: DataFrame, model: Model):
    """A function of a text column that gives struct(lang, score) of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training documents

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        got = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang": [x for x, _ in got], "score": [x for _, x in got]}, columns=["lang", "score"])

    return predict


def identify(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs, learned from its own labelled, not held-out rows.

    Null texts and texts without a letter are `und` with score 0; so is all if nothing is labelled. Texts count whole. Ties
    go to the language that is first by name. Repeated rows come back repeated; a null id counts as an empty one; an empty table
    gives an empty result; other columns are never read.
    """
    found = predictor(docs, fit(docs, text, id_col, lang))(F.col(text).cast("string"))
    out = docs.select(F.col(id_col).alias("doc_id"), (bucket_of(id_col, 4) == 2).alias("held_out"), found.alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, least: float = 0.5, text: str = "text", id_col: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The rows of docs whose language is found with a score of `least` or more; all columns of docs, no others."""
    p: Column = predictor(docs, fit(docs, text, id_col, lang))(F.col(text).cast("string"))
    return docs.where(p["score"] >= F.lit(float(least)))
