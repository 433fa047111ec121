"""A log-bilinear language model trained by noise-contrastive estimation.

The model predicts in two levels: a class of words, then a unit of that class. Units are the most frequent words, as many as
grow with the square root of the vocabulary, and for each class one unit that stands for all its other words. Words are in
classes by their last two bytes, endings being dealt so that classes hold about as many tokens each. The end of a text is a
class of its own. A context of CONTEXT units is the sum of their vectors, each weighted by place; its products with the
vectors of classes and of a class's units give scores, which training fits by telling corpus from noise (numpy, one pass over
all training texts in two rounds, parameters averaged over tasks), and which scoring normalises with batched matrix products.
A word's probability within the unit of its class's other words is its smoothed share of their tokens, with one place for
unseen words.

Word counts are of the whole training corpus. The KNOWN most frequent words are broadcast; counts of the rest are joined.
Texts are turned into units once, two bytes each, in a stored table from which training and scoring read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_rest, most_frequent, saved, starts, table

#: Words that are units: so many times the root of the number of different words, within bounds.
HEADS = 8
HEADS_LEAST, HEADS_MOST = 256, 16_384
CONTEXT = 4
WIDTH = 16
#: Noise classes of a step, and noise units of a step within each class.
NOISE = 32
NOISE_INSIDE = 8
BATCH = 2048
#: Bytes of a block that are freed before training, more than an array of a step takes.
ROOM = 1 << 24
#: Tokens that are scored at once: their scores stay in a core's cache.
SCORED = 2048
#: Tokens of one class in a tile; a step's tiles meet their classes' noise in one stack of products.
TILE = 32
RATE = 0.15
#: Multiplications of a matrix product that one thread does.
SINGLE = 150_000
#: Tasks whose parameters are averaged at once.
FAN = 16
KNOWN = 65_536
HELD_OUT = 2
SEED = 7
#: Counts are shuffled when a task has gathered so many different words.
GATHER = 400_000
#: Bytes of text that are split at once.
TEXT = 1 << 22


def dealt(endings: dict[bytes, tuple[int, int]], classes: int) -> dict[bytes, int]:
    """A class for each ending: the endings by falling tokens, each to the class that has fewest so far."""
    heap, out = [(0, k) for k in range(classes)], {}
    for ending in sorted(endings, key=lambda e: (-endings[e][0], e)):
        n, k = heap[0]
        heapq.heapreplace(heap, (n + endings[ending][0], k))
        out[ending] = k
    return out


@dataclass
class Vocabulary:
    """KNOWN words by falling count, the first of them units; tokens and different words of each ending; sums of the corpus.

    Units lie class by class, a class's other words last; the end of a text is the last unit. begin: where classes begin.
    """

    words: list[bytes]
    counts: np.ndarray
    docs: int
    tokens: int
    types: int
    endings: dict[bytes, tuple[int, int]]

    def __post_init__(self) -> None:
        heads = min(len(self.words), HEADS_MOST, max(HEADS_LEAST, math.ceil(HEADS * math.sqrt(self.types))))
        self.classes = max(1, math.isqrt(heads))
        self.class_of_ending = dealt(self.endings, self.classes)
        one, two = [bytes([a]) for a in range(256)], [bytes([a, b]) for a in range(256) for b in range(256)]
        self.class_table = np.array([self.word_class(e) for e in one + two], np.int64)
        of = np.array([self.word_class(w) for w in self.words], np.int64)
        sizes = np.bincount(of[:heads], minlength=self.classes) + 1
        self.begin = np.r_[0, np.cumsum(sizes), sizes.sum() + 1]
        self.units = int(self.begin[-1])
        self.others = self.begin[1:-1] - 1  # the unit of each class's other words
        self.unit = self.others[of] if len(of) else np.zeros(1, np.int64)
        order = np.argsort(of[:heads], kind="stable")
        place = np.arange(heads) - (np.cumsum(sizes - 1) - sizes + 1)[of[order]]
        self.unit[order] = self.begin[of[order]] + place
        tokens, types = np.zeros(self.classes), np.zeros(self.classes)
        for ending, (n, k) in self.endings.items():
            tokens[self.class_of_ending[ending]] += n
            types[self.class_of_ending[ending]] += k
        tokens -= np.bincount(of[:heads], self.counts[:heads], self.classes)
        types -= np.bincount(of[:heads], minlength=self.classes)
        self.log_count = np.log10(self.counts + 1.0) if len(self.words) else np.zeros(1)
        self.log_others = np.log10(tokens + types + 1.0)
        self.inside = self.log_count - self.log_others[of] if len(of) else np.zeros(1)
        self.inside[:heads] = 0.0
        seen = np.zeros(self.units)
        seen[self.others] = tokens
        seen[self.unit[:heads]] = self.counts[:heads]
        seen[-1] = self.docs
        self.share = (seen + 1.0) / (seen.sum() + self.units)

    def word_class(self, word: bytes) -> int:
        ending = word[-2:]
        return k if (k := self.class_of_ending.get(ending)) is not None else zlib.crc32(ending) % self.classes

    def classes_of(self, words: pa.StringArray) -> np.ndarray:
        """word_class of words that are not empty."""
        words = pa.concat_arrays([words])  # without an offset
        ends = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        size, last = np.diff(ends), data.take(ends[1:] - 1).astype(np.int64)
        return self.class_table.take(np.where(size > 1, 256 + 256 * data.take(ends[1:] - np.minimum(size, 2)).astype(np.int64) + last, last))


def _times(x: np.ndarray, y: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """x @ y, in `out` if given, in stacks of rows, each so small that a task's BLAS stays on one thread; waiting threads would cost as much again."""
    rows = max(1, SINGLE // (y.shape[0] * y.shape[1]))
    whole = len(x) // rows * rows
    out = np.empty((len(x), y.shape[1]), np.result_type(x, y)) if out is None else out
    np.matmul(x[:whole].reshape(-1, rows, x.shape[1]), y, out=out[:whole].reshape(-1, rows, y.shape[1]))
    np.matmul(x[whole:], y, out=out[whole:])
    return out


def _log_share(s: np.ndarray, bias: np.ndarray, mine: np.ndarray, safe: bool) -> np.ndarray:
    """The log softmax of s + bias at one place of each row, s being overwritten; `safe` says that no exp() can overflow."""
    told = s[np.arange(len(s)), mine] + bias.take(mine)
    if safe:
        np.exp(s, out=s)
        return told - np.log(s @ np.exp(bias))
    s += bias
    most = s.max(axis=1)
    s -= most[:, None]
    np.exp(s, out=s)
    return told - np.log(s.sum(axis=1)) - most


@dataclass
class Model:
    context: np.ndarray  # (units + 1, WIDTH); the last row stands before a text
    place: np.ndarray  # (CONTEXT, WIDTH)
    target: np.ndarray  # (units, WIDTH)
    bias: np.ndarray  # (units,)
    classes: np.ndarray  # (classes + 1, WIDTH); the last is the end's
    class_bias: np.ndarray  # (classes + 1,)

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.place, self.target, self.bias, self.classes, self.class_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for p in self.parts()])

    @classmethod
    def of(cls, flat: np.ndarray, v: Vocabulary) -> Model:
        n, k = v.units, v.classes + 1
        shapes, at, out = ((n + 1, WIDTH), (CONTEXT, WIDTH), (n, WIDTH), (n,), (k, WIDTH), (k,)), 0, []
        for s in shapes:
            out.append(np.array(flat[at : at + math.prod(s)], np.float32).reshape(s))
            at += math.prod(s)
        return cls(*out)

    @classmethod
    def first(cls, v: Vocabulary) -> Model:
        rng = np.random.default_rng(SEED)
        draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        whole = np.add.reduceat(v.share, v.begin[:-1])
        inside = v.share / np.repeat(whole, np.diff(v.begin))
        return cls(draw(v.units + 1, WIDTH), np.full((CONTEXT, WIDTH), 0.5, np.float32), draw(v.units, WIDTH), np.log(inside).astype(np.float32), draw(v.classes + 1, WIDTH), np.log(whole).astype(np.float32))

    def predicted(self, near: np.ndarray) -> np.ndarray:
        """Predicted vectors of contexts (CONTEXT, n), nearest unit first."""
        return sum(self.place[i] * self.context[near[i]] for i in range(CONTEXT))

    def log10(self, near: np.ndarray, units: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of units in their contexts: of their classes, then within these.

        Blocks of tokens are put in order of class, so that a class's tokens meet its units in one product.
        """
        out = np.empty(len(units))
        order = np.argsort(units.astype(np.uint16), kind="stable")
        class_of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        placed = self.place[:, None] * self.context
        classes = np.ascontiguousarray(self.classes.T)
        target = [np.ascontiguousarray(self.target[a:z].T) for a, z in zip(begin[:-1], begin[1:], strict=True)]
        reach = sum(np.sqrt((x**2).sum(axis=1).max()) for x in placed)  # no predicted vector is longer
        longest = max(np.sqrt((x**2).sum(axis=1).max()) for x in (self.classes, self.target))
        widest = max(np.abs(x).max() for x in (self.bias, self.class_bias))
        # Blocks share their arrays: new ones of this size would be faulted in anew for each block.
        most = min(SCORED, len(units))
        room, predicted, part = np.empty(most * max(classes.shape[1], *np.diff(begin).tolist()), np.float32), np.empty((most, WIDTH), np.float32), np.empty((most, WIDTH), np.float32)
        scores = lambda q, y: _times(q, y, room[: len(q) * y.shape[1]].reshape(len(q), -1))
        for at in range(0, len(units), SCORED):
            rows = order[at : at + SCORED]
            u = units[rows]
            k = class_of[u]
            q, x = predicted[: len(rows)], part[: len(rows)]
            placed[0].take(near[0].take(rows), axis=0, out=q, mode="clip")
            for i in range(1, CONTEXT):
                q += placed[i].take(near[i].take(rows), axis=0, out=x, mode="clip")
            safe = reach * longest + widest < 80 or bool(np.sqrt((q**2).sum(axis=1).max()) * longest + widest < 80)
            told = _log_share(scores(q, classes), self.class_bias, k, safe)
            heads = starts(k)
            for a, z in zip(heads.tolist(), np.r_[heads[1:], len(rows)].tolist(), strict=True):
                low, high = int(begin[k[a]]), int(begin[k[a] + 1])
                if high - low > 1:
                    told[a:z] += _log_share(scores(q[a:z], target[k[a]]), self.bias[low:high], u[a:z] - low, safe)
            out[rows] = told / math.log(10)
        return out


def contexts(texts: list[np.ndarray], units: int) -> tuple[np.ndarray, np.ndarray]:
    """(contexts (CONTEXT, n), units n) of texts given as units, the end included; `units` stands before a text."""
    pad = np.full(CONTEXT, units, np.int32)
    flat = np.concatenate([x for t in texts for x in (pad, t)]) if texts else np.zeros(0, np.int32)
    at = np.flatnonzero(flat != units)
    return np.stack([flat[at - 1 - i] for i in range(CONTEXT)]), flat[at]


class Trainer:
    """Noise-contrastive steps with Adagrad, on classes and within them."""

    def __init__(self, model: Model, v: Vocabulary, seed: int) -> None:
        self.m, self.begin = model, v.begin
        self.squares = [np.full(p.shape, 1e-4, np.float32) for p in model.parts()]
        whole = np.add.reduceat(v.share, v.begin[:-1])
        self.ladder = np.cumsum(whole)
        self.log_noise = np.log(NOISE * whole).astype(np.float32)
        self.inner = np.r_[0.0, np.cumsum(v.share)]
        self.log_inner = np.log(NOISE_INSIDE * v.share / np.repeat(whole, np.diff(v.begin))).astype(np.float32)
        self.klass = np.repeat(np.arange(len(whole)), np.diff(v.begin))
        self.rng = np.random.default_rng(seed)
        # The allocator keeps blocks up to the largest one freed so far; else every step would give its memory back and fault it in again.
        np.empty(ROOM, np.uint8)

    def step(self, near: np.ndarray, units: np.ndarray) -> None:
        """One step on tokens, which are put in order of class first, so that a class's noise meets its tokens in one product."""
        order = np.argsort(units.astype(np.uint16), kind="stable")
        m, n, near, units = self.m, len(units), near.take(order, axis=1), units.take(order)
        k = self.klass.take(units)
        heads = starts(k)
        noise = np.minimum(np.searchsorted(self.ladder, self.rng.random(NOISE)), len(self.ladder) - 1)
        met = k[heads]
        low, high = self.begin[met], self.begin[met + 1]
        edge = self.inner[self.begin]
        drawn = edge[:-1, None] + self.rng.random((len(edge) - 1, NOISE_INSIDE)) * np.diff(edge)[:, None]
        inner = np.clip(np.searchsorted(self.inner, drawn[met], "right") - 1, low[:, None], high[:, None] - 1)
        x = [m.context.take(near[i], axis=0) for i in range(CONTEXT)]
        g = np.empty((CONTEXT, n, WIDTH), np.float32)  # one place after the other, first of what predicts, then of its slope
        for i in range(CONTEXT):
            np.multiply(x[i], m.place[i], out=g[i])
        q = g.sum(axis=0)
        ones = np.zeros((n, WIDTH + 2), np.float32)  # with the bias's column, and one that makes their number even
        ones[:, :WIDTH], ones[:, WIDTH] = q, 1
        # classes
        t, z = m.classes.take(k, axis=0), m.classes[noise]
        true = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, t) + (m.class_bias - self.log_noise).take(k)))
        false = _slopes(_times(q, z.T), (m.class_bias - self.log_noise)[noise])
        np.negative(false, out=false)
        dq = true[:, None] * t + _times(false, z)
        classes, class_bias = np.zeros_like(m.classes), np.bincount(k, true, len(m.class_bias)).astype(np.float32)
        classes[met] = _runs(true[:, None] * q, heads)
        whole = n // 128 * 128
        pushed = np.matmul(false[:whole].reshape(-1, 128, NOISE).transpose(0, 2, 1), q[:whole].reshape(-1, 128, WIDTH)).sum(axis=0) + false[whole:].T @ q[whole:]
        np.add.at(classes, noise, pushed)
        np.add.at(class_bias, noise, false.sum(axis=0))
        # units within their classes; a class of one unit has nothing to tell apart
        some = (high - low > 1).astype(np.float32)
        sizes = np.diff(np.r_[heads, n])
        tiles = -(-sizes // TILE)
        first = np.cumsum(tiles) - tiles
        put = np.arange(n) - np.repeat(heads - first * TILE, sizes)
        tiled = np.zeros((int(tiles.sum()) * TILE, WIDTH + 2), np.float32)  # rows that fill up a tile add nothing
        tiled[put] = ones
        tiled = tiled.reshape(-1, TILE, WIDTH + 2)
        t, z = m.target.take(units, axis=0), m.target[inner].repeat(tiles, axis=0)
        free = m.bias - self.log_inner
        true = np.repeat(some, sizes) / (1 + np.exp(np.einsum("ij,ij->i", q, t) + free.take(units)))
        false = np.matmul(tiled[:, :, :WIDTH], z.transpose(0, 2, 1))
        false = _slopes(false, free[inner].repeat(tiles, axis=0)[:, None])
        false *= -some.repeat(tiles)[:, None, None]
        dq += true[:, None] * t
        dq += np.matmul(false, z).reshape(-1, WIDTH).take(put, axis=0)
        pushed = _runs(np.matmul(false.transpose(0, 2, 1), tiled).reshape(len(tiled), -1), first)
        at, grown = _summed(np.concatenate([units, inner.ravel()]), np.concatenate([true[:, None] * ones, pushed.reshape(-1, WIDTH + 2)]))
        for i in range(CONTEXT):
            np.multiply(dq, m.place[i], out=g[i])
        seen, context = _summed(near.ravel(), g.reshape(-1, WIDTH))
        place = np.stack([np.ones(n, np.float32) @ (dq * x[i]) for i in range(CONTEXT)])
        steps = ((seen, context), (None, place), (at, grown[:, :WIDTH]), (at, grown[:, WIDTH]), (None, classes), (None, class_bias))
        for p, s, (rows, g) in zip(m.parts(), self.squares, steps, strict=True):
            g = g / np.float32(n)
            square = g * g
            square += s if rows is None else s.take(rows, axis=0)  # take() gathers rows faster than an index does
            g *= RATE
            if rows is None:
                s[...] = square
                p += np.divide(g, np.sqrt(square, out=square), out=g)
            else:
                _put(s, rows, square)
                np.divide(g, np.sqrt(square, out=square), out=g)
                g += p.take(rows, axis=0)
                _put(p, rows, g)


def _slopes(s: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-(s + bias))), in place of s."""
    s += bias
    np.exp(np.negative(s, out=s), out=s)
    s += 1
    return np.reciprocal(s, out=s)


def _put(x: np.ndarray, rows: np.ndarray, new: np.ndarray) -> None:
    """x[rows] = new; a row of several numbers is copied as one value, in half the time."""
    if x.ndim > 1:
        x, new = (np.ascontiguousarray(a).view(f"V{a.shape[1] * a.itemsize}")[:, 0] for a in (x, new))
    x[rows] = new


def _runs(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sums of the rows from each head to the next; two single-precision columns are added as one complex one, in half the time.

    Most runs are of one or two rows, which are added all at once.
    """
    sizes = np.diff(np.r_[heads, len(x)])
    out = x.take(heads, axis=0)
    two, more = np.flatnonzero(sizes == 2), sizes > 2
    out[two] += x.take(heads.take(two) + 1, axis=0)
    if more.any():
        long = sizes[more]
        out[more] = np.add.reduceat(x[np.repeat(more, sizes)].view(np.complex64), np.cumsum(long) - long, axis=0).view(np.float32)
    return out


def _summed(rows: np.ndarray, add: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows (fewer than 65,536 exist), and for each the sum of what is to be added to it."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    rows = rows.take(order)
    heads = starts(rows)
    return rows.take(heads), _runs(add.take(order, axis=0), heads)


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about TEXT bytes in the column each; a longer text is alone or last."""
    heads = starts(np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64)) // TEXT)
    for a, z in zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, z - a)


def _split(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The lower-cased words of texts, and for each word the number of its text. Null texts have none."""
    texts = pa.concat_arrays([texts]).cast(pa.string())  # copied, for a cast of a slice may keep the wrong place in its bytes
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    words, text = split.flatten(), np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy())
    some = pc.not_equal(pc.binary_length(words), 0)  # blanks at a text's edge leave an empty one
    return words.filter(some), text[some.to_numpy(zero_copy_only=False)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of whole texts, gathered over batches as far as memory goes; and the number of texts, as the null word."""
    held, docs, rows = [], 0, 0
    for batch in batches:
        docs += batch.num_rows
        for block in _blocks(batch, 0) if batch.num_rows else ():
            told = pc.value_counts(_split(block.column(0))[0])
            held.append(pa.table([told.field(0), told.field(1)], ["word", "n"]))
            rows += len(told)
            if rows > 2 * GATHER:
                held = [pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})]
                rows = held[0].num_rows
                if rows > GATHER:
                    yield from _binary(held[0])
                    held, rows = [], 0
    for told in held:
        yield from _binary(told)
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([docs], pa.int64())], ["word", "n"])


def _binary(told: pa.Table) -> list[pa.RecordBatch]:
    return told.cast(pa.schema([("word", pa.binary()), ("n", pa.int64())])).to_batches()


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, n) of the column text, with the number of texts under the null word."""
    return texts.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    docs = counts.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    words = counts.where("word IS NOT NULL")
    top = most_frequent(words, "word", "n", KNOWN)
    sums = words.groupBy(F.expr("substring(word, -2, 2)").alias("e")).agg(F.sum("n"), F.count(F.lit(1))).collect()  # 65,792 at most
    endings = {bytes(r[0]): (r[1], r[2]) for r in sums}
    n_words, n_types = sum(n for n, _ in endings.values()), sum(k for _, k in endings.values())
    return Vocabulary(top["word"].to_pylist(), top["n"].to_numpy().astype(float), docs, n_words + docs, n_types + (docs > 0), endings)


def _encode(v: Vocabulary, known: pa.StringArray, texts: pa.Array) -> dict[str, pa.Array]:
    """What encoded() tells of each text; `known` are the vocabulary's words."""
    n = len(texts)
    words, text = _split(texts)
    at = pc.index_in(words, value_set=known).fill_null(-1).to_numpy().astype(np.int64)
    mine, others = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
    place, text_of, loose = at.take(mine), text.take(others), words.take(pa.array(others))
    classes = v.classes_of(loose)
    sizes = np.bincount(text, minlength=n) + 1
    ends = np.cumsum(sizes)
    units = np.full(ends[-1] if n else 0, v.units - 1, "<u2")
    units[mine + text.take(mine)], units[others + text_of] = v.unit.take(place), v.others.take(classes)
    told = loose.dictionary_encode()
    each, times = np.unique(text_of * max(1, len(told.dictionary)) + told.indices.to_numpy(), return_counts=True)
    begins = pa.array(np.r_[0, np.cumsum(np.bincount(each // max(1, len(told.dictionary)), minlength=n))].astype(np.int32))
    different = told.dictionary.take(pa.array(each % max(1, len(told.dictionary)))).cast(pa.binary())
    summed = lambda rows, x: np.bincount(rows, x, n).astype(float)
    return {
        "n_tokens": pa.array(sizes),
        "n_known": pa.array(np.bincount(text.take(mine), minlength=n) + (v.docs > 0)),
        "base": pa.array(summed(text.take(mine), v.log_count.take(place)) + math.log10(v.docs + 1.0) - sizes * math.log10(v.tokens + v.types + 1.0)),
        "inside": pa.array(summed(text.take(mine), v.inside.take(place)) - summed(text_of, v.log_others.take(classes))),
        "units": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.r_[0, 2 * ends].astype(np.int32)), pa.py_buffer(units.tobytes())]),
        "loose": pa.ListArray.from_arrays(begins, different),
        "times": pa.ListArray.from_arrays(begins, pa.array(times)),
    }


def encoded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """docs(doc_id, held_out, round, text) -> the same without text, but with what scores and training need of it:

    row (a number of its own), n_tokens, n_known, base and inside (the sums over broadcast words and the end), units, and
    loose and times: the words that are not broadcast, each with its number. A stored table, so that row is stable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        known, row = pa.array(v.words, pa.binary()).view(pa.string()), TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in _blocks(batch, 3) if batch.num_rows else ():
                told = _encode(v, known, part.column(3))
                ids = pa.array(np.arange(row, row + part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([ids, *(part.column(i) for i in range(3)), *told.values()], ["row", *part.schema.names[:3], *told])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("round").cast("long").alias("round"), F.col("text").cast("string").alias("text"))
    schema = "row long, doc_id long, held_out boolean, round long, n_tokens long, n_known long, base double, inside double, units binary, loose array<binary>, times array<long>"
    return saved(rows.mapInArrow(run, schema))


def _unit_arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u2").astype(np.int32) for b in column.to_pylist()]


def train(texts: DataFrame, v: Vocabulary, rounds: int = 2) -> Model:
    """A model from the columns units and round (0 .. rounds - 1): each round goes over its texts once."""
    model = Model.first(v)
    shared = texts.sparkSession.sparkContext.broadcast(v)

    def fit(flat: np.ndarray, turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = shared.value
            trainer, held, n, total = None, [], 0, 0
            for batch in batches:
                for text in _unit_arrays(batch.column(0)):
                    trainer = trainer or Trainer(Model.of(flat, v), v, zlib.crc32(text.tobytes(), SEED + turn))
                    held.append(text)
                    n += len(text)
                    if n >= 16 * BATCH:
                        total += _steps(trainer, held, v.units)
                        held, n = [], 0
            if held:
                total += _steps(trainer, held, v.units)
            if total:
                yield _row(trainer.m.flat(), total)

        return run

    for turn in range(rounds):
        fitted = texts.where(F.col("round") == turn).select("units").mapInArrow(fit(model.flat(), turn), "params binary, n long")
        tasks = fitted.rdd.getNumPartitions()
        fitted = saved(fitted)  # a lost executor costs no training again
        while tasks > 1:  # means of FAN tasks each, until one is left
            tasks = -(-tasks // FAN)
            fitted = fitted.repartition(tasks).mapInArrow(_mean_rows, "params binary, n long")
        if (row := fitted.first()) is not None:
            model = Model.of(np.frombuffer(row["params"], np.float32), v)
    return model


def _steps(trainer: Trainer, texts: list[np.ndarray], units: int) -> int:
    near, units = contexts(texts, units)
    order = trainer.rng.permutation(len(units))
    for at in range(0, len(units), BATCH):
        k = order[at : at + BATCH]
        trainer.step(near.take(k, axis=1), units.take(k))
    return len(units)


def _row(params: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([params.astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())], ["params", "n"])


def _mean_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of parameters weighted by the tokens that they were fitted to."""
    total, n = 0.0, 0
    for batch in batches:
        for params, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total = total + np.frombuffer(params, np.float32).astype(np.float64) * k
            n += k
    if n:
        yield _row(total / n, n)


def score(texts: DataFrame, counts: DataFrame, v: Vocabulary, model: Model) -> DataFrame:
    """Encoded texts -> doc_id, held_out, n_tokens, n_known, base_score, score, one row per row."""
    shared = texts.sparkSession.sparkContext.broadcast((v.units, v.begin, model))
    whole = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_units, begin, model = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                units = _unit_arrays(part.column("units"))
                logs = model.log10(*contexts(units, n_units), begin)
                sums = np.add.reduceat(logs, np.cumsum([0, *map(len, units[:-1])]))  # a text has its end at least
                lm = sums + part.column("inside").to_numpy()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in whole), pa.array(lm)], [*whole, "lm"])

    rows = texts.select(*whole, "inside", "units").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, lm double")
    loose = texts.select("row", F.explode(F.arrays_zip("loose", "times")).alias("x")).select("row", F.col("x.loose").alias("word"), F.col("x.times").alias("times"))
    # A partition holds far fewer different words than words of texts: hash those and leave the rest unsorted.
    met = loose.join(counts.where("word IS NOT NULL").withColumnRenamed("n", "c").hint("shuffle_hash"), "word")
    met = met.groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("found"))
    sums = rows.unionByName(met, allowMissingColumns=True).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum("known"), F.lit(0))).alias("n_known"),
        (F.max("base") + F.coalesce(F.sum("found"), F.lit(0.0))).alias("base_score"), (F.max("lm") + F.coalesce(F.sum("found"), F.lit(0.0))).alias("score"),
    )
    return sums.drop("row")


def lm_scores(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row.

    Texts whose crc32 of the id, modulo 7, is HELD_OUT are scored but not learned from. Null texts are empty: one token,
    the end. Without anything to learn from, both scores are those of a model that has seen nothing. Equal rows get equal
    scores up to the order of additions; null ids are learned from as the crc32 of the empty text says; a very long text is
    scored whole, its different words that are not broadcast once each; an empty table gives an empty table. Of words as
    frequent as the last one broadcast, those that come first in byte order are; base scores do not depend on it.
    """
    use = docs.select("doc_id", "text", (crc_rest("doc_id", 7) == HELD_OUT).alias("held_out"), F.expr("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) div 7 % 2").alias("round"))
    learn = use.where(~F.col("held_out"))
    counts = saved(count_words(learn))
    v = vocabulary(counts)
    texts = encoded(use, v)
    model = train(texts.where(~F.col("held_out")), v)
    return score(texts, counts, v, model).withColumn("train_tokens", F.lit(v.tokens).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_lm_scoring(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))
