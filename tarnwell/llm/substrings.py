"""Exact removal of long repeated word passages, found by recompression.

A text's words are symbols. One step names maximal runs of equal symbols, further steps give every symbol a side by its
name and name each left-right pair, so equal passages are named alike except near their ends. Names are 64-bit hashes of
what they stand for: a name is the same in every task without a table of names passing between rounds.

With each symbol goes the stretch of words that determines it. A symbol is certain in a window if that stretch lies inside.
Each window of SPAN words is represented by one of its certain symbols of the highest level that has any, so equal windows
have equal representatives, at equal offsets: no repeat can be missed. An occurrence of a representative stands for the
consecutive windows that it represents, and carries a hash of all words they cover. Occurrences, a fraction of the words,
are shuffled by the hash of the representative's stretch. Where all words agree too, all but the earliest go. Where they do
not, at the ends of passages, the earliest of each kind are compared window by window, by 128-bit hashes of all words.

What a task meets twice itself it decides itself, so a passage that a third of all texts share reaches any later task
once for each batch of texts at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_bytes, saved, table, whole_groups

SPAN = 20
PAIR_STEPS = 2
#: Words that are worked on at once.
CHUNK = 1 << 18
REMEMBERED = 500_000
_LAST = (1 << 63) - 1

U = np.uint64
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class _Names(dict):
    """Words to 64-bit names."""

    def __missing__(self, word: bytes) -> int:
        self[word] = name = xxhash.xxh3_64_intdigest(word)
        return name

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _stretches(h: np.ndarray):
    """A function that hashes the words of [lo, hi)."""
    n = len(h)
    power = np.full(n + 1, _B1, U)
    power[0] = 1
    back = np.full(n + 1, pow(_B1, -1, 1 << 64), U)
    back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    prefix = np.r_[U(0), np.cumsum(h * power[:-1], dtype=U)]
    return lambda lo, hi: (prefix[hi] - prefix[lo]) * back[lo]


def _levels(h: np.ndarray, wall: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each level: names, begins, and the stretches [lo, hi) that determine the symbols; walls never join."""
    n = len(h)
    same = (h[1:] == h[:-1]) & ~wall[1:]
    head = np.flatnonzero(np.r_[True, ~same])
    end = np.r_[head[1:], n]
    length = (end - head).astype(U)
    name = np.where(length > 1, mixed(h[head] + length * U(_B2)), h[head])
    lo, hi, begin, wall = head - 1, end + 1, head, wall[head]
    out = [(name, begin, lo, hi)]
    for k in range(PAIR_STEPS):
        left = mixed(name + U((k + 1) * _B1 % (1 << 64))) >> U(63) == 0
        joins = np.r_[left[:-1] & ~left[1:] & ~wall[:-1] & ~wall[1:], False]
        head = np.flatnonzero(np.r_[True, ~joins[:-1]])
        pair = joins[head]
        last = head + pair
        merged = mixed(name[head] * U(_B2) + mixed(name[last]))
        name = np.where(pair, merged, name[head])
        before, after = np.maximum(head - 1, 0), np.minimum(last + 1, len(lo) - 1)
        lo = np.where(head > 0, lo[before], -1)
        hi = np.where(last + 1 < len(hi), hi[after], n + 1)
        begin, wall = begin[head], wall[head]
        out.append((name, begin, lo, hi))
    return out


def _least(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the leftmost least key of each range [a, b), none empty."""
    best = np.arange(len(key))
    tables, width = [best], 1
    while width * 2 <= int((b - a).max(initial=1)):
        x, y = best[: len(best) - width], best[width:]
        best = np.where(key[x] <= key[y], x, y)
        tables.append(best)
        width *= 2
    out = np.empty(len(a), np.int64)
    size = b - a
    for k, t in enumerate(tables):
        use = (size >= 1 << k) & ((size < 2 << k) if k + 1 < len(tables) else True)
        x, y = t[a[use]], t[b[use] - (1 << k)]
        out[use] = np.where(key[x] <= key[y], x, y)
    return out


def representatives(h: np.ndarray, wall: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows, hash of all their words) for all windows without a wall in them."""
    n = len(h)
    none = (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U))
    if n < span:
        return none
    walls = np.r_[0, np.cumsum(wall)]
    open_ = walls[span:] == walls[:-span]
    hashed = _stretches(np.where(wall, U(0), h))
    found = []
    for level, (name, begin, lo, hi) in reversed(list(enumerate(_levels(h, wall), 1))):
        if not open_.any():
            break
        p = np.flatnonzero(open_)
        a = np.cumsum(np.bincount(lo + 1, minlength=n + 2))[p]  # symbols with lo < p
        b = np.cumsum(np.bincount(hi, minlength=n + 2))[p + span]  # symbols with hi <= p + span
        has = b > a
        p, a, b = p[has], a[has], b[has]
        if not len(p):
            continue
        open_[p] = False
        key = mixed(name)
        at = _least(key, a, b)
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)])
        k = at[first]
        found.append((mixed(hashed(lo[k], hi[k]) + U(level * _B2 % (1 << 64)) + (hi[k] - begin[k]).astype(U) * U(_B1)), p[first], np.diff(np.r_[first, len(p)])))
    if len(p := np.flatnonzero(open_)):  # inside runs: the window stands for itself
        found.append((mixed(hashed(p, p + span)), p, np.ones(len(p), np.int64)))
    if not found:
        return none
    key, p, n = map(np.concatenate, zip(*found, strict=True))
    return key, p, n, _full(hashed, p, n, span)


def _full(hashed, at: np.ndarray, n: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Hashes of all words of the n windows from `at`."""
    return mixed(hashed(at, at + n + span - 1) + n.astype(U) * U(_B2))


def _random(*parts: np.ndarray) -> np.ndarray:
    """A place to send rows to that need no company."""
    x = np.zeros(len(parts[0]), U)
    for p in parts:
        x = mixed(x * U(_B2) + p.astype(U) + U(_B1))
    return x


_OCCURRENCE = "route long, full long, id long, at int, n int, late boolean"
_RANGE = "id long, at int, n int, full long, late boolean"


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text -> occurrences: the earliest of its kind here, to be compared, and later ones, decided."""
    names = _Names()
    for batch in batches:
        ids = batch.column(0).to_numpy()
        held: list[tuple[np.ndarray, ...]] = []
        texts, doc, n = [], [], 0

        def work() -> None:
            nonlocal texts, doc, n
            lengths = np.array([len(t) + 1 for t in texts], np.int64)
            h = np.concatenate([x for t in texts for x in (t, np.zeros(1, U))])
            wall = np.zeros(len(h), bool)
            begins = np.r_[0, np.cumsum(lengths)[:-1]]
            wall[begins + lengths - 1] = True
            key, p, k, full = representatives(h, wall)
            d = np.searchsorted(begins, p, "right") - 1
            held.append((key, full, np.array(doc, np.int64)[d], p - begins[d], k))  # noqa: B023
            texts, doc, n = [], [], 0

        for i, text in zip(ids, ascii_bytes(batch.column(1)), strict=True):
            w = text.split()
            if len(w) < SPAN:
                continue
            texts.append(names.of(w))
            doc.append(i)
            n += len(w)
            if n >= CHUNK:
                work()
        if texts:
            work()
        if not held:
            continue
        key, full, doc_id, at, count = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((at, doc_id, full, key))
        key, full, doc_id, at, count = (x[order] for x in (key, full, doc_id, at, count))
        new = np.r_[True, (key[1:] != key[:-1]) | (full[1:] != full[:-1])]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = (doc_id != doc_id[first]) | (at != at[first])
        keep = new | late
        route = np.where(late, _random(full, doc_id, at), key)
        columns = [route.view(np.int64), full.view(np.int64), doc_id, at.astype(np.int32), count.astype(np.int32), late]
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["route", "full", "id", "at", "n", "late"])


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences sorted by route, full, id, at -> ranges of windows: late ones, and earliest ones to be compared."""
    for t in whole_groups(batches, "route"):
        route, full, doc, at, late = (t.column(c).to_numpy() for c in ("route", "full", "id", "at", "late"))
        begins = np.r_[True, route[1:] != route[:-1]]
        new = begins | np.r_[True, full[1:] != full[:-1]]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(begins))
        later = late | (doc != doc[first]) | (at != at[first])
        compare = new & ~later & (np.repeat(kinds, np.diff(np.r_[np.flatnonzero(begins), len(route)])) > 1)
        out = t.select(["id", "at", "n", "full"]).append_column("late", pa.array(later))
        yield from out.filter(pa.array(later | compare)).to_batches()


def _window_hashes(h: np.ndarray, at: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    one, two, g = np.zeros(len(at), U), np.zeros(len(at), U), mixed(h + U(_B2))
    for k in range(span):
        one = one * U(_B1) + h[at + k]
        two = two * U(_B2) + g[at + k]
    return mixed(one), mixed(two)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text, ranges to compare -> route, other, id, at, n, full, late for each of their windows: the earliest of its
    kind in the batch, to be compared with other tasks', and later ones, decided."""
    names = _Names()
    for batch in batches:
        held = []
        for i, text, ranges in zip(batch.column("id").to_pylist(), ascii_bytes(batch.column("text")), batch.column("ranges"), strict=True):
            w = text.split()
            at = np.array(ranges.values.field("at"), np.int64)
            n = np.array(ranges.values.field("n"), np.int64)
            p = np.unique(np.repeat(at - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()))
            p = p[p + SPAN <= len(w)]  # ranges of another row with this id may reach further
            if len(p):
                h = names.of(w)
                held.append((*_window_hashes(h, p), np.full(len(p), i, np.int64), p, _full(_stretches(h), p, np.ones(len(p), np.int64))))
        if not held:
            continue
        one, two, doc, p, full = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((p, doc, two, one))
        one, two, doc, p, full = (x[order] for x in (one, two, doc, p, full))
        new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = (doc != doc[first]) | (p != p[first])
        keep = new | late
        route = np.where(late, _random(one, doc, p), one)
        columns = [route.view(np.int64), two.view(np.int64), doc, p.astype(np.int32), np.ones(len(p), np.int32), full.view(np.int64), late]
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["route", "other", "id", "at", "n", "full", "late"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by route, other, id, at -> those that are not the first of their kind."""
    for t in whole_groups(batches, "route"):
        route, other, doc, at, late = (t.column(c).to_numpy() for c in ("route", "other", "id", "at", "late"))
        new = np.r_[True, (route[1:] != route[:-1]) | (other[1:] != other[:-1])]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        keep = late | (doc != doc[first]) | (at != at[first])
        yield from t.select(["id", "at", "n", "full"]).filter(pa.array(keep)).to_batches()


def kept_words(words: list[bytes], names: np.ndarray, at: np.ndarray, n: np.ndarray, full: np.ndarray, span: int = SPAN) -> list[bytes]:
    """The words outside the ranges of windows whose words hash as told."""
    fits = at + n + span - 1 <= len(words)
    at, n, full = at[fits], n[fits], full[fits]
    if len(at):
        told = _full(_stretches(names), at, n, span) == full
        at, n = at[told], n[told]
    if not len(at):
        return words
    change = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + n + span - 1, minlength=len(words) + 1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept (words joined by one space), one row per row.

    A word goes if a window of SPAN words that covers it starts earlier elsewhere too: in a document of smaller id, or
    earlier in its own. Windows are judged on the input. Null texts have no words. Null ids come after all others, in
    the order of a hash of their texts. Rows that repeat an id, or have none and equal texts, count as one document: of
    equal windows at equal places in them, none is earlier. Very long texts are read whole. An empty table gives an empty
    table.
    """
    last = F.lit(_LAST) - F.xxhash64("text").bitwiseAND(F.lit((1 << 48) - 1))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), last).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = rows.select("id", "text").mapInArrow(_marked, _OCCURRENCE)
    found = saved(marked.repartition(F.col("route")).sortWithinPartitions("route", "full", "id", "at").mapInArrow(_resolved, _RANGE))
    ranges = found.where("NOT late").groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("ranges"))
    # The same columns as in the join below, so that one shuffle of the texts serves both.
    compared = rows.join(ranges, "id").select("id", "doc_id", "text", "ranges").mapInArrow(_windows, "route long, other long, id long, at int, n int, full long, late boolean")
    later = compared.repartition(F.col("route")).sortWithinPartitions("route", "other", "id", "at").mapInArrow(_later, "id long, at int, n int, full long")
    gone = later.unionByName(found.where("late").drop("late")).groupBy("id").agg(F.collect_list(F.struct("at", "n", "full")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _Names()
        for batch in batches:
            kept, total, removed = [], [], []
            for text, windows in zip(ascii_bytes(batch.column(1)), batch.column(2), strict=True):
                words = left = text.split()
                if windows.is_valid:
                    at, n, full = (np.array(windows.values.field(k), np.int64) for k in ("at", "n", "full"))
                    left = kept_words(words, names.of(words), at, n, full.view(U))
                kept.append(b" ".join(left))
                total.append(len(words))
                removed.append(len(words) - len(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.join(gone, "id", "left").select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op5_substring_dedup(spark, sf_dir):
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
