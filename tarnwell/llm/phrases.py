"""Phrase collocations by best-first growth of counted prefixes.

A phrase's score is that of its weakest cut, so a prefix u of first word w bounds every phrase that grows from it:
2 f(u) / (f(w) + f(u)), which falls as u grows. Words and pairs are counted for all texts. From there only what can
still matter is counted: phrases whose prefix's bound reaches the language's threshold, and, since a longer phrase may
drop a shorter one, phrases that end in a contender. A round ends with the survivors at or above the threshold; a language
is settled once there are as many as are asked for (ties of the last score lie at or above the threshold too), or once its
threshold has come down to zero. The others take a lower threshold and go on.

What a pass over the texts looks for is sent to its tasks as a fixed number of bits: a phrase that is asked for always
passes, others that share its bit cost rows and no more. Whether a phrase is counted depends on its words alone, so every
count is that of all texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

LEAST = 30
MOST = 2000
LONGEST = 4
#: A longer phrase drops one inside it that it makes up to this part (in hundredths).
INSIDE = 80
#: The first threshold is the score of so many times MOST pairs; each further round takes so many times more.
FIRST, FURTHER = 2, 8
#: Bits of a filter as a power of two, and bytes of text that a task counts at once.
BITS = 25
CHUNK = 8 << 20

#: Capital letters, and the characters that part a text into pieces.
PARTS = b".,;:!?\n\x0b\x0c\r"
_END = b"\xff"  # never part of a text
_LOWER = bytes(10 if c in PARTS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_TURN = 17
GRAMS = "lang string, gram string, c long"


def _turn(h: np.ndarray, k: int) -> np.ndarray:
    k = _TURN * k % 64
    return (h << np.uint64(k)) | (h >> np.uint64(64 - k)) if k else h


def _key(lang: Column, gram: Column) -> Column:
    """The place of a phrase's bit: what `_Counter` computes from words' hashes, as a column."""

    def turned(h: Column, k: Column) -> Column:
        k = k * _TURN % 64
        left, right = F.call_function("shiftleft", h, k), F.call_function("shiftrightunsigned", h, 64 - k)
        return F.when(k == 0, h).otherwise(left.bitwiseOR(right))

    hashes = F.transform(F.split(gram, " "), lambda w, i: turned(F.xxhash64(w), i))
    return F.aggregate(hashes, F.xxhash64(lang), lambda s, h: s.bitwiseXOR(h)).bitwiseAND(F.lit((1 << BITS) - 1))


def _bits(grams: DataFrame) -> np.ndarray:
    """A bit for each phrase of the table; 2^BITS bits whatever its size."""
    at = grams.select(_key(F.col("lang"), F.col("gram")).alias("at"))
    cell, bit = F.call_function("shiftrightunsigned", "at", F.lit(6)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    rows = at.groupBy(cell.cast("int").alias("cell")).agg(F.bit_or(bit).alias("b")).toArrow()  # 2^(BITS - 6) rows at most
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[rows["cell"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return out


class _Counter:
    """Counts of the k-word phrases of some texts of one language that pass the filters."""

    def __init__(self, lang: bytes, texts: list[bytes]):
        joined = (b"\n".join(texts) + b"\n").translate(_LOWER).replace(b"\n", b" " + _END + b" ")
        words = pc.ascii_split_whitespace(pa.array([joined], pa.large_binary()).view(pa.large_string())).flatten()
        coded = pc.dictionary_encode(words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words)
        self.ids, self.names = coded.indices.to_numpy(), coded.dictionary
        names = self.names.view(pa.large_binary()).to_pylist()
        self.inner = np.array([w not in (b"", _END) for w in names], bool)
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed=42) for w in names), np.uint64, len(names))
        self.lang = np.uint64(xxhash.xxh64_intdigest(lang, seed=42))

    def passing(self, places: np.ndarray, bits: np.ndarray, first: int, n: int) -> np.ndarray:
        """Which places have a phrase of n words, `first` words on, whose bit is set."""
        h = np.full(len(places), self.lang)
        for k in range(n):
            h ^= _turn(self.hashes, k)[self.ids[places + (first + k)]]
        h &= np.uint64(64 * len(bits) - 1)
        return (bits[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1) == 1

    def count(self, k: int, wanted: Callable[[_Counter, np.ndarray], np.ndarray] | None) -> tuple[pa.Array, np.ndarray]:
        inner = self.inner[self.ids]
        places = np.flatnonzero(reduce(np.logical_and, (inner[j : len(inner) - k + 1 + j] for j in range(k)))) if len(inner) >= k else np.zeros(0, int)
        if wanted:
            places = wanted(self, places)
        if not len(places):
            return pa.array([], pa.string()), np.zeros(0, np.int64)
        # the code of a phrase: that of its prefix among those found, times the words, plus its last word
        codes = self.ids[places].astype(np.int64)
        for j in range(1, k):
            codes = (np.unique(codes, return_inverse=True)[1] if j > 1 else codes) * len(self.names) + self.ids[places + j]
        _, first, n = np.unique(codes, return_index=True, return_counts=True)
        found = places[first]
        parts = [self.names.take(pa.array(self.ids[found + j])) for j in range(k)]
        return (pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k > 1 else parts[0]).cast(pa.string()), n


def _counts(docs: DataFrame, k: int, wanted: Callable[[_Counter, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """lang, gram, c: every k-word phrase that passes, in all texts; for k = 1 also the empty one, which counts all words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(held: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                grams, n = _Counter(lang.encode(), texts).count(k, wanted)
                if k == 1:
                    grams, n = pa.concat_arrays([grams, pa.array([""])]), np.append(n, n.sum())
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), grams, pa.array(n, pa.int64())], ["lang", "gram", "c"])

        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang, text in zip(langs, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= CHUNK:
                    yield from flushed(held)
                    held, size = {}, 0
        yield from flushed(held)

    return docs.mapInArrow(run, GRAMS).groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _sent(spark: SparkSession, grams: DataFrame):
    return spark.sparkContext.broadcast(_bits(grams))


def _words_among(words) -> Callable:
    def wanted(c: _Counter, places: np.ndarray) -> np.ndarray:
        for k in (0, 1):
            places = places[c.passing(places, words.value, k, 1)]
        return places

    return wanted


def _grown(k: int, pairs, prefixes, contenders) -> Callable:
    """k-word phrases that grow from a prefix of the frontier or end in a contender, all of whose pairs are frequent."""

    def wanted(c: _Counter, places: np.ndarray) -> np.ndarray:
        places = places[c.passing(places, prefixes.value, 0, k - 1) | c.passing(places, contenders.value, 1, k - 1)]
        for j in range(k - 1):
            places = places[c.passing(places, pairs.value, j, 2)]
        return places

    return wanted


def _named(k: int, names) -> Callable:
    return lambda c, places: places[c.passing(places, names.value, 0, k)]


#: Exact beyond 64 bits: 2,000,000 a / (l + r), rounded down.
_SCORE = "CAST(2000000 * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS BIGINT)"


def _scored(grams: DataFrame, known: DataFrame) -> DataFrame:
    """grams with l, r and score of the weakest cut, and `unknown`: the parts whose counts are missing.

    Cuts with unknown parts do not enter the score, which is then an upper bound.
    """
    w = F.split("gram", " ")
    n = F.size(w)
    cut = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(w, 1, k), " ").alias("first"), F.array_join(F.slice(w, k + 1, n - k), " ").alias("rest")))
    cuts = grams.select("lang", "gram", F.col("c").alias("a"), F.explode(cut).alias("cut")).select("lang", "gram", "a", "cut.*")
    of = lambda part, c: known.select("lang", F.col("gram").alias(part), F.col("c").alias(c))
    both = cuts.join(of("first", "l"), ["lang", "first"], "left").join(of("rest", "r"), ["lang", "rest"], "left")
    whole = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), F.struct(F.expr(_SCORE).alias("score"), "k", "l", "r"))
    missing = F.collect_set(F.when(F.col("l").isNull(), F.col("first")).when(F.col("r").isNull(), F.col("rest")))  # fewer than the phrase's words
    told = both.groupBy("lang", "gram", "a").agg(F.min(whole).alias("m"), missing.alias("unknown"))
    return told.select("lang", "gram", F.col("a").alias("c"), "m.score", "m.l", "m.r", "unknown")


def _bound() -> Column:
    """What no phrase that grows from this one exceeds; f1 is the count of its first word."""
    return F.expr("CAST(2000000 * CAST(c AS DECIMAL(20,0)) div (CAST(f1 AS DECIMAL(20,0)) + CAST(c AS DECIMAL(20,0))) AS BIGINT)")


def _thresholds(scored: DataFrame, langs: DataFrame, rank: int) -> DataFrame:
    """lang, least: the score of the rank-th phrase of each language; zero where there are fewer."""
    bins = scored.join(langs, "lang", "left_semi").groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))  # a million and one for each language at most
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score")))
    reached = bins.withColumn("upto", upto).where(F.col("upto") >= rank).groupBy("lang").agg(F.max("score").alias("least"))
    return langs.join(reached, "lang", "left").select("lang", F.coalesce("least", F.lit(0)).alias("least"))


def phrases(docs: DataFrame, least: int = LEAST, most: int = MOST, longest: int = LONGEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `most` best phrases of each language, of 2 to `longest` words.

    Null texts are empty, null languages `und`. Repeated rows count each time. Equal scores go by a, then by the phrase's
    bytes. A table without frequent phrases gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    frequent = F.col("c") >= least
    words = saved(_counts(docs, 1).where(frequent | (F.col("gram") == "")))
    totals = words.where(F.col("gram") == "").select("lang", F.col("c").alias("n"))
    words = words.where(frequent & (F.col("gram") != ""))
    pairs = saved(_counts(docs, 2, _words_among(_sent(spark, words))).where(frequent))
    firsts = words.select("lang", F.col("gram").alias("w1"), F.col("c").alias("f1"))
    scored_pairs = saved(_scored(pairs, words))
    pair_bits = _sent(spark, pairs)
    results: list[DataFrame] = []
    langs, rank = saved(pairs.select("lang").distinct()), FIRST * most
    while langs.count():
        limits = saved(_thresholds(scored_pairs, langs, rank))
        #: level by level: scored phrases at or above the threshold, and all counted ones
        scored, counted = scored_pairs.join(limits, "lang"), pairs
        best, known = [scored.where("score >= least")], words.unionByName(pairs)
        levels: list[DataFrame] = []
        for k in range(3, longest + 1):
            first = F.element_at(F.split("gram", " "), 1)
            frontier = counted.join(limits, "lang").withColumn("w1", first).join(firsts, ["lang", "w1"]).where(_bound() >= F.col("least"))
            frontier = saved(frontier.select("lang", "gram"))
            counted = saved(_counts(docs, k, _grown(k, pair_bits, _sent(spark, frontier), _sent(spark, best[-1].select("lang", "gram")))).where(frequent))
            levels.append(counted)
            known = known.unionByName(counted)
            prefix = F.substring_index("gram", " ", k - 1)
            grown = counted.withColumn("prefix", prefix).join(frontier.select("lang", F.col("gram").alias("prefix")), ["lang", "prefix"], "left_semi").select("lang", "gram", "c")
            now = saved(_scored(grown, known).join(limits, "lang").where("score >= least"))
            parts = saved(now.select("lang", F.explode("unknown").alias("gram")).distinct())
            if parts.count():
                for m in range(3, k):  # shorter parts are all known
                    of_length = parts.where(F.size(F.split("gram", " ")) == m)
                    known = known.unionByName(saved(_counts(docs, m, _named(m, _sent(spark, of_length))).join(of_length, ["lang", "gram"], "left_semi")))
                now = saved(_scored(now.select("lang", "gram", "c"), known).join(limits, "lang").where("score >= least"))
            best.append(now)
        columns = ("lang", "gram", "c", "l", "r", "score", "least")
        alive = []
        for k, now in enumerate(best, 2):
            if k < longest:
                tail = F.expr("substring(gram, length(substring_index(gram, ' ', 1)) + 2)")
                longer = levels[k - 2].select("lang", F.explode(F.array(F.substring_index("gram", " ", k), tail)).alias("gram"), F.col("c").alias("longer"))
                longer = longer.groupBy("lang", "gram").agg(F.max("longer").alias("longer"))
                dropped = F.lit(100).cast("decimal(20,0)") * F.col("longer") >= F.lit(INSIDE).cast("decimal(20,0)") * F.col("c")
                now = now.join(longer, ["lang", "gram"], "left").where(F.col("longer").isNull() | ~dropped)
            alive.append(now.select(*columns))
        left = saved(reduce(DataFrame.unionByName, alive))
        enough = left.groupBy("lang").agg(F.count(F.lit(1)).alias("alive"))
        settled = limits.join(enough, "lang", "left").where((F.col("least") == 0) | (F.col("alive") >= most)).select("lang")
        settled = saved(settled)
        results.append(left.join(settled, "lang", "left_semi"))
        langs, rank = saved(langs.join(settled, "lang", "left_anti")), rank * FURTHER
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("c"), "gram")
    if not results:
        results = [scored_pairs.withColumn("least", F.lit(0).cast("long"))]
    ranked = reduce(DataFrame.unionByName, results).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("gram").alias("phrase"), F.col("c").alias("a"), "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT doc, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT row_number() OVER () AS at, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS gram, k
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k)),
f AS (SELECT lang, gram, k, count(*) AS c FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
o AS (SELECT lang, gram, k, c FROM f WHERE c >= {LEAST}),
cuts AS (SELECT lang, gram, k, c AS a, j, array_to_string(string_split(gram, ' ')[1:j], ' ') AS x, array_to_string(string_split(gram, ' ')[j + 1:], ' ') AS y
         FROM o, (VALUES (1), (2), (3)) s(j) WHERE j < k),
s AS (SELECT cuts.lang, cuts.gram, cuts.k, a, j, l.c AS l, r.c AS r, CAST(2000000 * CAST(a AS HUGEINT) // (CAST(l.c AS HUGEINT) + r.c) AS BIGINT) AS score
      FROM cuts JOIN o l ON l.lang = cuts.lang AND l.gram = x JOIN o r ON r.lang = cuts.lang AND r.gram = y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, j) = 1),
i AS (SELECT lang, c, k, m, array_to_string(string_split(gram, ' ')[q:q + m - 1], ' ') AS inner_gram
      FROM o, (VALUES (2), (3)) s(m), (VALUES (1), (2), (3)) t(q) WHERE m < k AND q + m - 1 <= k),
e AS (SELECT lang, inner_gram, max(c) AS longer FROM i GROUP BY ALL),
v AS (SELECT b.* FROM b LEFT JOIN e ON e.lang = b.lang AND e.inner_gram = b.gram WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < {INSIDE} * CAST(a AS HUGEINT))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, gram) AS rank, gram AS phrase, a, l, r, n, score
FROM v JOIN n USING (lang) QUALIFY rank <= {MOST}
"""
