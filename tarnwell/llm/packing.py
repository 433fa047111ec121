"""Packing documents into fixed windows by non-negative least squares.

A document fills whole windows first; what remains of it is one of 4095 lengths. Shallow combinations of up to PARTS lengths
that fill a window, less a few tokens at most, are columns of a matrix, some for every length that occurs; non-negative least
squares against the histogram of remainders says how often to repeat each. Repeats are rounded, and what they leave of the
histogram is solved again until little is gained. Documents take slots by their rank within their length, and the remainders
left over are packed greedily, with cuts.

Rows keep their order as far as it is known (by file, block and row): the rows are cut into stretches of that order, each with
its own histogram and plan, so windows hold neighbours and sequence ids rise with the order, stretch by stretch.

Documents are read and tokenized once. A cut piece's checksum follows from prefix checksums kept every GRID tokens, so
cuts lie on that grid, counted from the document's last whole window.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_bytes, running_sums, saved, table, whole_groups

WINDOW = 4096
GRID = 16
END = 2
TOKENIZER = "word_bpe_49k.json"
#: Lengths in a combination, tokens that it may leave of a window, and combinations sought for each length at a time; with
#: 4095 lengths they bound the problem.
PARTS = 16
SLACK = GRID
EACH = 12
#: Times that the histogram's rest is solved again at most, and the share of it that must be gained by that.
ROUNDS = 8
GAIN = 0.02
#: Stretches of the documents' order, and documents in one at least. A plan has at most about 40,000 slots' segments, so all
#: plans together, which every task holds, have a bound too.
STRETCHES = 16
STRETCH_DOCS = 20_000
#: Windows and documents that one task packs greedily, on average.
SHARD_WINDOWS = 1024
SHARD_DOCS = 10_000
#: Words whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 500_000

_POLY = 0xEDB88320
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Texts to packed little-endian 32-bit ids, word by word with a memory of words.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in a row. Texts that
    may hold a special token's text are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self.known: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters only. Such a word is one piece, so in their joined text each ends with an end-of-word id."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._whole([w.decode() for w in words])
        flat, cuts = ids.tobytes(), (cuts * 4).tolist()
        return [flat[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]

    def learn(self, words: set[bytes]) -> None:
        """A final stop or comma after letters is a piece of its own."""
        known = self.known
        stems = {w: w[:-1] for w in words if w[-1:] in (b".", b",") and w[:-1].decode().isalpha()}
        plain = [w for w in ({*words, *stems.values(), b".", b","} - stems.keys()) if w not in known]
        letters = [w for w in plain if w.decode().isalpha()]
        for at in range(0, len(letters), 4096):
            some = letters[at : at + 4096]
            known.update(zip(some, self._letters(some), strict=True))
        rest = [w for w in plain if w not in known]
        known.update(zip(rest, self._whole([w.decode() for w in rest]), strict=True))
        for w, stem in stems.items():
            known[w] = known[stem] + known[w[-1:]]

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        for at in range(0, len(texts), 512):
            if len(self.known) > REMEMBERED:
                self.known.clear()
            get, held, new = self.known.get, [], set()
            for text in texts[at : at + 512]:
                words = text.lower().split() if b"<|" not in text else []
                ids = list(map(get, words))
                gaps = [k for k, x in enumerate(ids) if x is None] if None in ids else []
                new.update(map(words.__getitem__, gaps))
                held.append((text if b"<|" in text else None, words, ids, gaps))
            if new:
                self.learn(new)
            for text, words, ids, gaps in held:
                for k in gaps:
                    ids[k] = get(words[k])
                yield b"".join(ids) if text is None else self._whole([text.decode()])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _multiply(a: np.ndarray, b: int) -> np.ndarray:
    """Products of polynomials modulo the CRC's, bits reflected."""
    out = np.zeros_like(a)
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(k)) & 1, np.uint32(b), np.uint32(0)).astype(np.uint32)
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
    return out


def piece_crc(before: np.ndarray, upto: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Checksums of pieces from those of the prefixes that end where they begin and end."""
    shifted, power = before.astype(np.uint32), 1 << 23  # x^8
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        shifted = np.where((n_bytes >> k) & 1, _multiply(shifted, power), shifted)
        power = int(_multiply(np.array([power], np.uint32), power)[0])
    return shifted ^ upto.astype(np.uint32)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n, whole, rest, window_crcs, rest_crcs (every GRID tokens and at the end), file, block, part, first_window, row, idx.

    file, block and part say which piece of the input a row is from, in order; row counts the rows there, idx those of equal rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        end = np.array([END], "<u4").tobytes()
        part, windows, seen, row, now = TaskContext.get().partitionId(), 0, np.zeros(WINDOW, np.int64), 0, None
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            rows = []
            columns = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for doc_id, file, block, ids in zip(*columns, encode(ascii_bytes(batch.column(1))), strict=True):
                if (file, block) != now:
                    now, seen, row = (file, block), np.zeros(WINDOW, np.int64), 0
                ids += end
                n = len(ids) // 4
                whole, rest = divmod(n, WINDOW)
                view, crcs, crc = memoryview(ids)[whole * WINDOW * 4 :], [], 0
                for at in range(0, rest, GRID):
                    crc = zlib.crc32(view[at * 4 : (at + GRID) * 4], crc)
                    crcs.append(crc)
                rows.append((doc_id, n, whole, rest, [zlib.crc32(memoryview(ids)[k * WINDOW * 4 : (k + 1) * WINDOW * 4]) for k in range(whole)], crcs, file, block, part, windows, row, int(seen[rest])))
                windows += whole
                row += 1
                seen[rest] += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "n", "whole", "rest", "window_crcs", "rest_crcs", "file", "block", "part", "first_window", "row", "idx")
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    schema = "doc_id long, n long, whole int, rest int, window_crcs array<long>, rest_crcs array<long>, file string, block long, part int, first_window long, row long, idx long"
    numbered = F.concat(F.lpad(F.regexp_extract(F.input_file_name(), r"part-([0-9]+)", 1), 10, "0"), F.lit(" "), F.input_file_name())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), numbered.alias("file"), F.input_file_block_start().cast("long").alias("block"))
    return rows.mapInArrow(run, schema)


def combinations(present: np.ndarray, window: int = WINDOW, slack: int = SLACK, each: int = EACH, seed: int = 0) -> np.ndarray:
    """Rows of PARTS lengths (0 where there are fewer) that occur as often as the row needs, and sum to the window less
    `slack` - 1 at most.

    Every length begins `each` combinations. Lengths drawn by their supplies follow until one that occurs fills what is left
    of the window, so that all combinations together use lengths about as often as they occur.
    """
    lengths = np.flatnonzero(present[: window + 1])
    lengths = lengths[lengths > 0]
    rng = np.random.default_rng(seed)
    supply = np.where(np.arange(window + 1) > 0, present[: window + 1], 0)
    ladder = np.cumsum(supply)
    # the most frequent of the lengths that fill a rest up to the slack, the longest of those that tie
    shifted = np.stack([np.r_[np.zeros(g, np.int64), supply[: window + 1 - g]] for g in range(min(slack, window))])
    gap = shifted.argmax(axis=0)
    closing = np.where(shifted.max(axis=0) > 0, np.arange(window + 1) - gap, 0)
    combo = np.zeros((len(lengths) * each, PARTS), np.int64)
    combo[:, 0] = np.repeat(lengths, each)
    rest, open_ = window - combo[:, 0], np.full(len(combo), True)
    full = rest < slack
    open_ &= ~full
    for k in range(1, PARTS):
        rows = np.flatnonzero(open_)
        if not len(rows):
            break
        r = rest[rows]
        close = (closing[r] > 0) & ((rng.random(len(rows)) < 0.5) | (k == PARTS - 1) | (r < 2 * slack))
        drawn = np.searchsorted(ladder, (rng.random(len(rows)) * ladder[r]).astype(np.int64), "right")
        n = np.where(close, closing[r], np.where(ladder[r] > 0, np.minimum(drawn, r), 0))
        combo[rows, k] = n
        rest[rows] = r - n
        full[rows] = rest[rows] < slack
        open_[rows] = ~full[rows] & (n > 0)
    combos = np.unique(-np.sort(-combo[full], axis=1), axis=0)[::-1] if full.any() else combo[:0]
    need = (combos[:, :, None] == combos[:, None, :]).sum(axis=2)
    return combos[((need <= supply[combos]) | (combos == 0)).all(axis=1)].astype(np.int32)


def nonnegative(combos: np.ndarray, want: np.ndarray, rounds: int = 200) -> np.ndarray:
    """x >= 0 that brings the lengths used by x times the combinations nearest to what is wanted: accelerated projected
    gradients, begun anew where they turn against the descent."""
    row, k = np.nonzero(combos)
    flat, begins = combos[row, k], np.flatnonzero(k == 0)
    want = want.astype(float)

    def slope(x: np.ndarray, want: np.ndarray | float) -> np.ndarray:
        return np.add.reduceat((np.bincount(flat, x[row], size) - want)[flat], begins)

    size = len(want)
    probe = np.ones(len(combos))
    for _ in range(20):
        probe = slope(probe, 0.0)
        most = np.linalg.norm(probe)
        probe /= max(most, 1e-300)
    step = 1.0 / max(most * 1.05, 1e-12)
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(z - step * slope(z, want), 0.0)
        if np.dot(z - new, new - x) > 0:
            t, z = 1.0, x
            new = np.maximum(z - step * slope(z, want), 0.0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, z, t = new, new + (t - 1) / t_new * (new - x), t_new
    return x


def repeats(combos: np.ndarray, present: np.ndarray, rounds: int = 200) -> np.ndarray:
    """How often to use each combination: non-negative least squares, rounded, then raised while supplies last. Never uses
    more of a length than there is."""
    if not len(combos):
        return np.zeros(0, np.int64)
    want = present.copy()
    want[0] = 0
    x = nonnegative(combos, want, rounds)
    left, times = present.astype(np.int64).tolist(), np.zeros(len(combos), np.int64)
    order = np.argsort(-x, kind="stable").tolist()
    rows = combos.tolist()
    for wanted in (np.floor(x + 0.5), np.full(len(x), np.inf)):
        for i in order:
            if not wanted[i]:
                continue
            row = [n for n in rows[i] if n]
            if (most := min(wanted[i], min(left[n] // row.count(n) for n in row))) > 0:
                times[i] += int(most)
                for n in row:
                    left[n] -= int(most)
    return times


def plan(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, times) for a histogram of remainders: solved, rounded, and solved again for what that leaves."""
    left = present.astype(np.int64).copy()
    left[0] = 0
    found, times = [np.zeros((0, PARTS), np.int32)], [np.zeros(0, np.int64)]
    for turn in range(ROUNDS):
        before = left.sum()
        combos = combinations(left, seed=turn)
        t = repeats(combos, left)
        combos, t = combos[t > 0], t[t > 0]
        found.append(combos)
        times.append(t)
        left -= np.bincount(combos.ravel(), np.repeat(t, PARTS), len(left)).astype(np.int64)
        left[0] = 0
        if before - left.sum() <= GAIN * before:
            break
    return np.concatenate(found), np.concatenate(times)


def _sequence(sort: int, stretch):
    """The first id of a stretch: 6 bits of stretch, then two that tell planned, whole and greedy windows apart."""
    return (stretch << 55) + (sort << 53)


def _slots(combos: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each length, its slots as segments: length, rank where it begins, count, first window, offset."""
    rows = combos.astype(np.int64)
    first, offset = np.cumsum(times) - times, np.cumsum(rows, axis=1) - rows
    place, k = np.nonzero(rows)
    order = np.argsort(rows[place, k], kind="stable")
    place, k = place[order], k[order]
    length, count = rows[place, k], times[place]
    begin = np.cumsum(count) - count
    return length, begin - begin[np.searchsorted(length, length)] if len(length) else begin, count, first[place], offset[place, k]


def _planned(histogram: pd.DataFrame) -> pd.DataFrame:
    present = np.zeros(WINDOW + 1, np.int64)
    present[histogram["rest"]] = histogram["n"]
    length, rank, count, first, offset = _slots(*plan(present))
    stretch = np.full(len(length), histogram["stretch"].iloc[0])
    return pd.DataFrame({"stretch": stretch, "length": length, "rank": rank, "count": count, "sequence": first + _sequence(0, stretch), "offset": offset})


def greedy(rests: list[int]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, window, offset) that cover the rests. The longest rest that fits goes in; if none
    does, the shortest is cut on the grid, as far as a grid step fits."""
    pool = sorted((r, i) for i, r in enumerate(rests))
    at = [0] * len(rests)
    out, window, space = [], 0, WINDOW
    while pool:
        k = bisect_right(pool, (space, len(rests)))
        if k:
            n, i = pool.pop(k - 1)
        elif space >= GRID:
            length, i = pool.pop(0)
            n = space // GRID * GRID
            insort(pool, (length - n, i))
        else:
            window, space = window + 1, WINDOW
            continue
        out.append((i, at[i], n, window, WINDOW - space))
        at[i] += n
        space -= n
        if not space:
            window, space = window + 1, WINDOW
    return out, window


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """docs(doc_id, text) -> pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document's ids, with END after them, lie in exactly one piece each; null text is empty, so END alone. Repeated
    ids, null ids and repeated rows are packed row by row; a very long text fills windows of its own and leaves one rest. An
    empty table gives an empty table. Windows lack fewer than GRID tokens, but for the last one of each greedy shard.
    """
    each = saved(tokenized(docs, tokenizer_path))
    piece = ("file", "block", "part")
    pieces = running_sums(each.groupBy(*piece).agg(F.count(F.lit(1)).alias("rows")), piece, {"rows_before": F.col("rows")}).drop("rows")
    n_docs = each.count()
    stretches = int(max(1, min(STRETCHES, n_docs // STRETCH_DOCS)))
    before = Window.partitionBy("rest").orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    bases = each.groupBy(*piece, "rest").agg(F.count(F.lit(1)).alias("k")).withColumn("base", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    stretch = F.floor((F.col("rows_before") + F.col("row")) * F.lit(stretches) / F.lit(max(n_docs, 1)))
    ranked = each.join(bases.join(pieces, list(piece)), [*piece, "rest"]).select(
        "doc_id", "n", "whole", "rest", "window_crcs", "rest_crcs", "part", "first_window", (F.col("base") + F.col("idx")).alias("rank"), F.least(stretch, F.lit(stretches - 1)).cast("long").alias("stretch")
    )
    ranked = saved(ranked)
    histogram = saved(ranked.groupBy("stretch", "rest").agg(F.count(F.lit(1)).alias("n")))
    present = np.zeros((stretches, WINDOW + 1), np.int64)
    for r in histogram.collect():  # STRETCHES times 4096 rows at most
        present[r["stretch"], r["rest"]] = r["n"]
    found = histogram.repartition(stretches, "stretch").groupBy("stretch").applyInPandas(_planned, "stretch long, length long, rank long, count long, sequence long, offset long")
    slot = {c: x.to_numpy() for c, x in found.toPandas().sort_values(["stretch", "length", "rank"]).items()}  # bounded by STRETCHES
    covered = np.zeros_like(present)
    np.add.at(covered, (slot["stretch"], slot["length"]), slot["count"])
    key = slot["stretch"] << 56 | slot["length"] << 40 | slot["rank"]
    earlier = np.cumsum(present, axis=0) - present
    slots = docs.sparkSession.sparkContext.broadcast((key, slot["rank"], slot["sequence"], slot["offset"], covered, earlier))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rank, first, offset, covered, earlier = slots.value
        for b in batches:
            r, t = b.column("rest").to_numpy().astype(np.int64), b.column("stretch").to_numpy()
            k = b.column("rank").to_numpy() - earlier[t, r]
            fits = (k < covered[t, r]) & (r > 0)
            at = np.searchsorted(key, (t << 56 | r << 40 | k)[fits], "right") - 1
            sequence, place = np.zeros(len(r), np.int64), np.zeros(len(r), np.int64)
            sequence[fits] = first[at] + k[fits] - rank[at]
            place[fits] = offset[at]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence, pa.int64(), mask=~fits), pa.array(place)], [*b.schema.names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema)
    assigned = saved(ranked.mapInArrow(assign, f"{kinds}, sequence_id long, offset long"))
    shift = lambda c, n: F.call_function("shiftleft", F.col(c).cast("long") if isinstance(c, str) else c, F.lit(n))
    whole_start = (F.col("whole") * F.lit(WINDOW)).cast("long")
    full = assigned.where("whole > 0").select("doc_id", "n", "part", "first_window", "stretch", F.posexplode("window_crcs").alias("k", "crc"))
    full = full.select("doc_id", (F.col("k") * F.lit(WINDOW)).cast("long").alias("start"), F.lit(WINDOW).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (shift("stretch", 55) + F.lit(1 << 53) + shift("part", 33) + F.col("first_window") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    slotted = assigned.where("sequence_id IS NOT NULL").select("doc_id", whole_start.alias("start"), F.col("rest").cast("long").alias("length"), F.element_at("rest_crcs", -1).alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")
    over = np.maximum(present - covered, 0)[:, 1:].sum(axis=0)
    inside = int(-(-max(1, over @ np.arange(1, WINDOW + 1) // (SHARD_WINDOWS * WINDOW), over.sum() // SHARD_DOCS) // stretches))  # shards of a stretch

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "shard", 1):
            for shard in np.unique(t.column("shard").to_numpy()).tolist():
                rows = t.filter(pc.equal(t.column("shard"), shard)).sort_by([("rest", "descending"), ("doc_id", "ascending"), ("rank", "ascending")])
                i, start, n, window, offset = (np.array(x, np.int64) for x in zip(*greedy(rows.column("rest").to_pylist())[0], strict=True))
                crcs = rows.column("rest_crcs").combine_chunks()
                flat, first = crcs.values.to_numpy().astype(np.uint32), crcs.offsets.to_numpy()[i].astype(np.int64)
                low = np.where(start > 0, flat[first + np.maximum(start // GRID - 1, 0)], 0).astype(np.uint32)
                high = flat[first - (-(start + n) // GRID) - 1]
                take = lambda c: rows.column(c).take(pa.array(i)).to_numpy()  # noqa: B023, E731
                columns = [take("doc_id"), take("whole").astype(np.int64) * WINDOW + start, n, piece_crc(low, high, n * 4).astype(np.int64), take("n"), _sequence(2, np.int64(shard // inside)) + (np.int64(shard) << 32) + window, offset]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(i)).combine_chunks(), *(pa.array(c.astype(np.int64)) for c in columns[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    shard = F.col("stretch") * F.lit(inside) + F.pmod(F.xxhash64("rest", "rank"), F.lit(inside))
    loose = assigned.where("sequence_id IS NULL AND rest > 0").select("doc_id", "n", "whole", "rest", "rest_crcs", "rank", shard.cast("long").alias("shard"))
    packed = loose.repartition(stretches * inside, "shard").sortWithinPartitions("shard").mapInArrow(fill, PIECES)
    return full.unionByName(slotted).unionByName(packed)


def op4_pack_windows(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
