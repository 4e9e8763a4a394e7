"""Quality rules: simple counts, and a hashed n-gram log-likelihood ratio between trusted and raw text. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CHUNK_BITS, SPACE, has_bit

#: Buckets of each kind of n-gram: single words, pairs of neighbouring words, words' closing characters.
BUCKETS, KINDS = 8192, 3
CLOSING = 2
#: Added to each bucket's count.
SMOOTHING = 1.0
#: A document stays if its mean log-likelihood ratio is this at least.
THRESHOLD = -0.2

#: Bits for each document, and the least and most of them in a bitmap (two of 16 MB are broadcast at most).
BITS_A_KEY, LEAST_BITS, MOST_BITS = 4, 1 << 21, 1 << 27

LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """How many words lie in a window of five words that the text holds twice or more; the first such window counts too.

    Windows are compared by 64-bit hashes. Sorted by (hash, place), equal windows are neighbours; each place of a repeated window adds the words
    that the place before doesn't cover.
    """

    def count(h: Column) -> Column:
        rows = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(r: Column) -> Column:
            same = F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
            return F.array_sort(F.array_distinct(F.flatten(same)))

        def covered(p: Column) -> Column:
            gaps = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
            return F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda a, g: a + g)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(_let(rows, places), covered))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(WINDOW)]))
    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(_let(hashes, count))


def buckets(w: Column) -> Column:
    """The buckets of a text's words, of its pairs of neighbouring words and of its words' closing characters."""
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))
    n = F.greatest(F.size(w) - 1, F.lit(0))
    two = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: (F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)) + BUCKETS).cast("int"))
    end = F.transform(w, lambda x: (F.pmod(F.xxhash64(F.substring(x, -CLOSING, CLOSING)), F.lit(BUCKETS)) + 2 * BUCKETS).cast("int"))
    return F.concat(one, two, end)


def _places(key: Column, bits: int) -> list[Column]:
    """The chunk of a key's bit among so many bits, and the bit's place in the chunk."""
    at = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(bits))
    return [F.floor(at / F.lit(CHUNK_BITS)).cast("int").alias("chunk"), F.pmod(at, F.lit(CHUNK_BITS)).alias("bit")]


def _trusted_or_unclear(source: DataFrame, ids: DataFrame) -> DataFrame:
    """source (key, t) with two booleans: `sure`, the key is one of ids; `unclear`, only a join with ids can tell.

    Ids without texts meet by a shuffle first. Each distinct key of source sets a hashed bit in the bitmap of the keys found or in that of the others. Where
    one of the two bitmaps alone has a key's bit, its rows are decided where they are. MOST_BITS bounds what is broadcast; past it only more is unclear.
    """
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << (BITS_A_KEY * source.count()).bit_length()))
    keys = source.where("key is not null").select("key").distinct().join(ids, "key", "left")
    found = F.col("known").isNotNull()
    # dealt by chunk before the bitmaps are made, so that no task sends more than its rows
    placed = keys.select(*_places(F.col("key"), bits), found.alias("found")).repartition("chunk")
    of = lambda which: F.bitmap_construct_agg(F.when(which, F.col("bit")))
    maps = placed.groupBy("chunk").agg(of(F.col("found")).alias("yes"), of(~F.col("found")).alias("no"))
    marked = source.select("key", "t", *_places(F.col("key"), bits)).withColumn("chunk", F.when(F.col("key").isNotNull(), F.col("chunk")))
    marked = marked.join(F.broadcast(maps), "chunk", "left")  # at most MOST_BITS / CHUNK_BITS rows
    yes, no = has_bit(F.col("yes"), F.col("bit")), has_bit(F.col("no"), F.col("bit"))
    return marked.select("key", "t", (yes & ~no).alias("sure"), (yes & no).alias("unclear"))


def weights(docs: DataFrame, trusted: DataFrame, text: str = "text", id_col: str = "doc_id") -> list[float]:
    """log(target / raw) of each bucket: target from every trusted document of docs, raw from every document.

    trusted: a column doc_id. Each task sends at most one row a bucket through the shuffle and the driver gets two rows a bucket. Texts are counted where
    they are, by bitmaps of hashed ids; only those of unclear ids, some percent, move to meet the trusted ids themselves.
    """
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("key")).distinct().withColumn("known", F.lit(True))
    source = docs.select(F.col(id_col).cast("string").alias("key"), _text(text).alias("t"))
    marked = _trusted_or_unclear(source, ids)

    def counted(rows: DataFrame, y: Column, raw: int) -> DataFrame:
        grams = rows.select(y.cast("long").alias("y"), F.explode(_let(words(F.col("t")), buckets)).alias("b"))
        return grams.groupBy("b").agg(F.sum("y").alias("target"), F.sum(F.lit(raw)).alias("raw"))

    moved = marked.where("unclear").select("key", "t").join(ids, "key", "left_semi")
    counts: dict[int, tuple[int, int]] = {}
    for r in counted(marked, F.col("sure"), 1).union(counted(moved, F.lit(1), 0)).collect():
        target, raw = counts.get(r.b, (0, 0))
        counts[r.b] = (target + r.target, raw + r.raw)
    out = []
    for first in range(0, KINDS * BUCKETS, BUCKETS):
        own = [counts.get(b, (0, 0)) for b in range(first, first + BUCKETS)]
        target, raw = (sum(x[k] for x in own) for k in (0, 1))
        # without trusted text the ratio says nothing
        out += [math.log((x[0] + SMOOTHING) / (target + SMOOTHING * BUCKETS)) - math.log((x[1] + SMOOTHING) / (raw + SMOOTHING * BUCKETS)) if target else 0.0 for x in own]
    return out


def apply_rules(docs: DataFrame, trusted: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) for every row of docs.

    score: mean log-likelihood ratio of the text's n-grams, 0 for a text without words. Null and empty texts have no words and
    fail; repeated rows come back repeated; a null id is never trusted; without trusted documents the score is 0 and decides nothing;
    an empty table gives an empty result; other columns are never read.
    """
    # one literal, which the optimizer turns into an array once
    ratio = F.split(F.lit(",".join(map(repr, weights(docs, trusted, text, id_col)))), ",").cast("array<double>")
    t = F.col("t")

    def measure(w: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        score = _let(buckets(w), lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.element_at(ratio, x + 1)) / F.greatest(F.size(b), F.lit(1)))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            score.alias("score"),
        )

    out = docs.select(F.col(id_col).alias("doc_id"), _text(text).alias("t")).select("doc_id", _let(words(t), measure).alias("m")).select("doc_id", "m.*")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(float(threshold))))
