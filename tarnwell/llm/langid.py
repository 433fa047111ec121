"""Language identification, words first.

A known word is scored by its log frequency in each language; an unseen word falls back to the longest of its character
n-grams that the model knows. Counts cover all documents that may be learned from. The most frequent words and n-grams are
broadcast; counts of the others stay tables. Words of texts are joined with the words' table; an unseen word that may hold
an n-gram of the other table, which a filter of fixed size tells, is joined with that one.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, crc_rest, less_frequent, most_frequent, saved, starts, table, text_blocks, whole_groups



def _chosen(first: str) -> list[int]:
    """The characters whose Unicode category begins with one of `first`."""
    return [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in first]


def _ranges(chosen: list[int]) -> str:
    """Characters as ranges of a character class."""
    begins = [c for k, c in enumerate(chosen) if k == 0 or chosen[k - 1] != c - 1]
    ends = [c for k, c in enumerate(chosen) if k + 1 == len(chosen) or chosen[k + 1] != c + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(begins, ends, strict=True))


#: A word: a letter, then letters and the marks that combine with them. Numbers such as "\u00b2" or "\u00bd" are no letters.
LETTERS = re.compile(f"[{_ranges(_chosen('L'))}][{_ranges(_chosen('LM'))}]*")
#: The same, and faster, for texts without marks and numbers other than decimals.
_PLAIN = re.compile(r"[^\W\d_]+")
_ODD = frozenset(map(chr, _chosen("MN"))) - frozenset("0123456789")


def letter_words(text: str) -> list[str]:
    """The words of a text."""
    return (_PLAIN if text.isascii() or _ODD.isdisjoint(text) else LETTERS).findall(text)


LENGTHS = (4, 3, 2, 1)
HELD_OUT = 1
#: A document's evidence counts as that of so many words at most, since words of one text are not independent.
EVIDENCE = 20
#: The most frequent words, which every worker holds (about 20 MB); the others' counts are joined.
BROADCAST = 1 << 17
#: The most frequent n-grams, likewise, and the bits (as a power of two) that tell whether another one may be known.
GRAMS, GRAM_BITS = 1 << 17, 25
#: Words that a worker counts before it passes them on; unseen words whose n-grams it remembers.
REMEMBERED = 100_000


@dataclass(frozen=True)
class Model:
    """languages; a row for each broadcast word and n-gram, with its log frequency in each language; log prior.

    The driver holds words and n-grams as columns only; workers turn them into dictionaries, once each.
    rest: (item, counts in each language) of the other words, None if there are none; gram_rest: of all n-grams, None if all
    are broadcast, and gram_bits its filter; word_sums and gram_sums: log denominators.
    """

    languages: tuple[str, ...]
    word_items: pa.Array
    word_logs: np.ndarray
    gram_items: pa.Array
    gram_logs: np.ndarray
    prior: np.ndarray
    word_sums: np.ndarray
    gram_sums: np.ndarray
    rest: DataFrame | None = None
    gram_rest: DataFrame | None = None
    gram_bits: np.ndarray | None = None

    @cached_property
    def words(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.word_items.to_pylist())}

    @cached_property
    def grams(self) -> dict[str, int]:
        return {g: i for i, g in enumerate(self.gram_items.to_pylist())}


def _emit(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], ["lang", "item", "n"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[str, Counter] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, counts in by.items():
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "item", "n"])
        by.clear()

    for batch in text_blocks(batches, 0):
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, Counter()).update(letter_words(text.lower()))
        if sum(map(len, by.values())) > REMEMBERED:
            yield from told()
    yield from told()


def word_grams(word: str, k: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + k] for i in range(len(marked) - k + 1)]


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.update((lang, g) for k in LENGTHS for g in word_grams(word, k))
        if counts:
            yield _emit(counts)


def _sums(totals: np.ndarray, types: int) -> np.ndarray:
    return np.log(totals + 0.5 * (types + 1))


def _logs(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return np.log(counts + 0.5) - sums


def _by_item(counts: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(lang, item, n) -> item, all, counts in the order of the languages; an item is a row, a language no column."""
    lists = counts.groupBy("item").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"))
    in_order = F.transform(F.array(*map(F.lit, languages)), lambda x: F.coalesce(F.try_element_at("m", x), F.lit(0))) if languages else F.array()
    return lists.select("item", "all", in_order.cast("array<bigint>").alias("counts"))


def train(docs: DataFrame, most_words: int = BROADCAST, most_grams: int = GRAMS) -> Model:
    """A model from docs(text, lang): rows whose text and language are not null. At most so many words and n-grams are broadcast.

    Repeated rows count as often as they occur. Counts of the others are joined, so the limits move work, not results.
    """
    use = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    words = saved(use.mapInArrow(_word_counts, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")))
    grams = words.select("lang", "item").mapInArrow(_gram_counts, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))

    sums = {r["lang"]: (r["n"], r["types"]) for r in words.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()}
    languages = tuple(sorted(sums))
    by_word, by_gram = saved(_by_item(words, languages)), saved(_by_item(grams, languages))
    top, top_grams = most_frequent(by_word, "item", "all", most_words), most_frequent(by_gram, "item", "all", most_grams)
    types, gram_types = by_word.count(), by_gram.count()
    totals = np.array([sums[x][0] for x in languages], float)
    by_place = by_gram.select(F.posexplode("counts").alias("place", "n")).groupBy("place").agg(F.sum("n").alias("n"))
    gram_totals = np.zeros(len(languages))
    for r in by_place.collect():  # a row for each language
        gram_totals[r["place"]] = r["n"]
    word_sums, gram_sums = _sums(totals, types), _sums(gram_totals, gram_types)
    table_of = lambda found: found["counts"].combine_chunks().flatten().to_numpy().astype(float).reshape(found.num_rows, len(languages))
    rest = less_frequent(by_word, "item", "all", top).select("item", "counts") if types > top.num_rows else None
    more = gram_types > top_grams.num_rows
    return Model(
        languages,
        top["item"].combine_chunks(), _logs(table_of(top), word_sums),
        top_grams["item"].combine_chunks(), _logs(table_of(top_grams), gram_sums),
        np.log(totals / max(totals.sum(), 1.0)), word_sums, gram_sums, rest,
        by_gram.select("item", "counts") if more else None, bit_filter(F.xxhash64("item"), by_gram, GRAM_BITS) if more else None,
    )


def _may_be_known(model: Model, gram: str) -> bool:
    """Whether the table of n-grams may hold one that is not broadcast."""
    h = xxhash.xxh64_intdigest(gram.encode(), seed=42) & (64 * len(model.gram_bits) - 1)
    return bool(int(model.gram_bits[h >> 6]) >> (h & 63) & 1)


def _by_rare_grams(unseen: DataFrame, model: Model, shared) -> DataFrame:
    """unseen(word) -> word, logs: the mean log frequencies of the longest known n-grams, for words that need the table."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = []
            for word in batch.column(0).to_pylist():
                asked, maybe = [], False
                for k in LENGTHS:
                    found = word_grams(word, k)
                    asked += [(word, k, g) for g in found]
                    here = any(g in model.grams for g in found)
                    maybe = maybe or any(g not in model.grams and _may_be_known(model, g) for g in found)
                    if here:  # at this length at the latest the word is decided
                        break
                if maybe:
                    out += asked
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.string()), strict=True)], ["word", "k", "item"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for t in whole_groups(batches, "word", 1 << 14):
            said, sizes = t.column("word").to_pylist(), t.column("k").to_pylist()
            logs = _logs(np.array(t.column("counts").to_pylist(), float).reshape(t.num_rows, -1), model.gram_sums)
            longest: dict[str, int] = {}
            for w, k in zip(said, sizes, strict=True):
                longest[w] = max(k, longest.get(w, 0))
            places: dict[str, list[int]] = {}
            for i, (w, k) in enumerate(zip(said, sizes, strict=True)):
                if k == longest[w]:
                    places.setdefault(w, []).append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(places)), pa.array([logs[p].mean(axis=0).tolist() for p in places.values()], pa.list_(pa.float64()))], ["word", "logs"])

    met = unseen.mapInArrow(ask, "word string, k int, item string").join(model.gram_rest, "item")
    return met.select("word", "k", "counts").repartition("word").sortWithinPartitions("word").mapInArrow(decide, "word string, logs array<double>")


def evidence(model: Model, said: Counter) -> tuple[np.ndarray, int]:
    """Summed log frequencies of a text's words in each language, and the number of words that count."""
    rows, times, loose, owner, weight = [], [], [], [], []
    get, part = model.words.get, model.grams.get
    for word, n in said.items():
        if (i := get(word)) is not None:
            rows.append(i)
            times.append(n)
            continue
        for k in LENGTHS:
            if found := [j for g in word_grams(word, k) if (j := part(g)) is not None]:
                loose += found
                owner += [n / len(found)] * len(found)
                weight.append(n)
                break
    total = model.word_logs[rows].T @ np.array(times, float) if rows else np.zeros(len(model.languages))
    if loose:
        total = total + model.gram_logs[loose].T @ np.array(owner)
    return total, sum(times) + sum(weight)


def predict_one(model: Model, text: str | None) -> tuple[str, float]:
    """(language, probability) by a model that is broadcast whole; ("und", 0) for a null text or one without letters."""
    said = Counter(letter_words((text or "").lower()))
    if not model.languages or not said:
        return "und", 0.0
    total, n = evidence(model, said)
    x = model.prior + total * min(1.0, EVIDENCE / max(n, 1))
    p = np.exp(x - x.max())
    best = int(np.argmax(p))
    return model.languages[best], float(p[best] / p.sum())


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, lang_pred, score for every row; only the text is looked at.

    A null text, or one without a letter (Unicode category L), is ("und", 0). Of languages that tie, the first in code point
    order is told. Repeated rows and null ids are rows like any other; very long texts count whole, each different word
    once with its frequency. An empty table gives an empty table.
    """
    if model.rest is not None or model.gram_rest is not None:
        return _predict_joined(docs, model, keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [predict_one(model, t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["row", "lang_pred", "score"])

    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, lang_pred string, score double").select("row.*", "lang_pred", "score")


def _predict_joined(docs: DataFrame, model: Model, keep: tuple[str, ...]) -> DataFrame:
    """What `predict` tells, where words of texts that are not broadcast meet their counts in a join."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, rest=None, gram_rest=None))
    names = ["at", "word", "n", "row", "lettered", "total"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        get, at = model.words.get, TaskContext.get().partitionId() << 36
        for batch in text_blocks(batches, 1):
            sums, known, lettered, word, n, owner = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                rows, times = [], []
                told = Counter(letter_words((text or "").lower()))
                for w, k in told.items():
                    if (j := get(w)) is not None:
                        rows.append(j)
                        times.append(k)
                    else:
                        word.append(w)
                        n.append(k)
                        owner.append(at + i)
                sums.append((model.word_logs[rows].T @ np.array(times, float)).tolist() if rows else [0.0] * len(model.languages))
                known.append(sum(times))
                lettered.append(bool(told))
            ids = range(at, at + batch.num_rows)
            # a key that no word can have, so that texts spread like words do
            columns = [pa.array(ids, pa.int64()), pa.array([f" {i}" for i in ids], pa.string()), pa.array(known, pa.int64()), batch.column(0), pa.array(lettered, pa.bool_()), pa.array(sums, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names)
            if word:
                yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(word, pa.string()), pa.array(n, pa.int64()), *(pa.nulls(len(word), c.type) for c in columns[3:])], names)
            at += batch.num_rows

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        part, width = model.grams.get, len(model.languages)

        def by_grams(word: str) -> np.ndarray | None:
            if word not in cache:
                if len(cache) > REMEMBERED:
                    cache.clear()
                cache[word] = None
                for k in LENGTHS:
                    if found := [j for g in word_grams(word, k) if (j := part(g)) is not None]:
                        cache[word] = model.gram_logs[found].mean(axis=0)
                        break
            return cache[word]

        for t in whole_groups(batches, "at", 1 << 15):
            t = t.combine_chunks()
            begins = starts(t.column("at").to_numpy())
            owner = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, t.num_rows]))
            n = t.column("n").to_numpy()
            text = t.column("lettered").is_valid().to_numpy()
            own = t.filter(pa.array(text))
            total = np.array(own.column("total").to_pylist(), float).reshape(len(begins), width)
            times = n[text].astype(float)
            met = t.column("counts").is_valid().to_numpy()
            counts = pa.concat_arrays(t.column("counts").filter(pa.array(met)).chunks).flatten().to_numpy().reshape(-1, width) if met.any() else np.zeros((0, width))
            logs = _logs(counts, model.word_sums) * n[met][:, None]
            for i in range(width):
                total[:, i] += np.bincount(owner[met], logs[:, i], len(begins))
            times += np.bincount(owner[met], n[met], len(begins))
            loose = np.flatnonzero(~met & ~text)
            rare = t.column("logs").take(pa.array(loose)).to_pylist()
            for k, word, logs in zip(loose.tolist(), t.column("word").take(pa.array(loose)).to_pylist(), rare, strict=True):
                if (x := by_grams(word) if logs is None else np.array(logs)) is not None:
                    total[owner[k]] += n[k] * x
                    times[owner[k]] += n[k]
            x = model.prior + total * np.minimum(1.0, EVIDENCE / np.maximum(times, 1))[:, None]
            p = np.exp(x - x.max(axis=1, keepdims=True))
            best = p.argmax(axis=1)
            lettered = own.column("lettered").to_pylist()
            langs = [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), lettered, strict=True)]
            scores = np.where(lettered, p.max(axis=1) / p.sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(own.column("row").chunks), pa.array(langs, pa.string()), pa.array(scores)], ["row", "lang_pred", "score"])

    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    sent = rows.mapInArrow(send, f"at long, word string, n long, row {kind}, lettered boolean, total array<double>")
    if model.rest is not None:
        met = sent.join(model.rest.withColumnRenamed("item", "word").hint("shuffle_hash"), "word", "left")
    else:
        met = sent.withColumn("counts", F.lit(None).cast("array<bigint>"))
    if model.gram_rest is not None:
        unseen = met.where("counts IS NULL AND lettered IS NULL").select("word").distinct()
        met = met.join(_by_rare_grams(unseen, model, shared), "word", "left")
    else:
        met = met.withColumn("logs", F.lit(None).cast("array<double>"))
    met = met.withColumn("word", F.when(F.col("counts").isNull() & F.col("lettered").isNull(), F.col("word")))
    told = met.repartition("at").sortWithinPartitions("at").mapInArrow(tell, f"row {kind}, lang_pred string, score double")
    return told.select("row.*", "lang_pred", "score")


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_rest("doc_id", 3) == HELD_OUT).alias("held_out"))
    return predict(docs, train(docs.where(~F.col("held_out"))), ("doc_id", "held_out"))
