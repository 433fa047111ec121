"""Near-duplicate embeddings from randomised-rotation binary codes.

A unit vector o is rotated at random; the signs of its coordinates, scaled to unit length, are its code x, and f = <x, o>
is stored with it. For another vector q, <x, q> / f is an unbiased estimate of <o, q> whose error stays within
ERRORS * sqrt((1 - f^2) / f^2 / (d - 1)) with high confidence. Only pairs whose upper bound reaches the threshold are
computed exactly, in double precision. Pairs to estimate are those that share a band of code bits; bands are as many as a
pair at the threshold needs to share one with a chance of 1 - MISS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, saved, starts, table, whole_groups
from .graph import components

THRESHOLD = 0.98
MISS = 1e-9
ERRORS = 8.0
#: Rotations whose codes estimate a pair; the others' codes serve as bands only.
ESTIMATES = 4
#: Rows of one side of a comparison; larger buckets are compared block by block.
BLOCK = 1024
SEED = 20_11


def layout(rows: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits of a band, bands): bits follow the table's size, so that few unrelated vectors share a bucket."""
    bits = min(32, max(12, math.ceil(math.log2(max(rows, 2))) + 6))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - agree)))


def rotations(dim: int, count: int) -> np.ndarray:
    """`count` random rotations of `dim` coordinates side by side: dim x (count * dim)."""
    rng = np.random.default_rng([SEED, dim])
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out, axis=1)


def _padded(n: int) -> int:
    return max(64, n)


def _units(vecs: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision, padded with zeros to the rotation's size."""
    x = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.pad(x, ((0, 0), (0, _padded(x.shape[1]) - x.shape[1])))


def _bytes_of(lists: pa.Array, labels: pa.Array, kind: str) -> pa.Array:
    """Vectors as bytes, -0 as 0; null where the label is null, or the vector is null, empty, zero or not finite throughout."""
    lengths = pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + 0.0  # null numbers become NaN
    row = np.repeat(np.arange(len(lists)), lengths)
    finite = np.bincount(row, np.isfinite(values), len(lists)) == lengths
    some = np.bincount(row, values != 0, len(lists)) > 0
    good = finite & some & labels.is_valid().to_numpy(zero_copy_only=False)
    values = values.astype(kind)[good[row]]
    ends = np.cumsum(np.where(good, lengths, 0)) * values.itemsize
    whole = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(values.tobytes())])
    return pc.if_else(pa.array(good), whole.cast(pa.binary()), pa.scalar(None, pa.binary()))


def vectors(df: DataFrame) -> tuple[DataFrame, str]:
    """vec_id, label as text, vec as bytes (null where the vector or its label takes no part), and the number kind."""
    kind = "<f4" if df.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _bytes_of(b.column(2), b.column(1), kind)], ["vec_id", "label", "vec"])

    cast = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    return cast.mapInArrow(run, "vec_id long, label string, vec binary"), kind


def _bands(signs: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Band values of each row's code bits."""
    return signs[:, : bits * bands].reshape(len(signs), bands, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def indexed(classes: DataFrame, kind: str, bits: int, bands: int) -> DataFrame:
    """Adds code (packed signs of all rotations) and factors (a correction factor for each rotation that estimates)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs, codes, factors = b.column("vec").to_pylist(), [None] * b.num_rows, [None] * b.num_rows
            by: dict[int, list[int]] = {}
            for i, v in enumerate(vecs):
                by.setdefault(len(v), []).append(i)
            for rows in by.values():
                u = _units([vecs[i] for i in rows], kind)
                d = u.shape[1]
                turned = u @ rotations(d, -(-bits * bands // d))
                f = np.abs(turned[:, : ESTIMATES * d]).reshape(len(rows), -1, d).sum(axis=2) / math.sqrt(d)
                packed = np.packbits(turned > 0, axis=1)
                for k, i in enumerate(rows):
                    codes[i], factors[i] = packed[k].tobytes(), f[k].tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.binary()), pa.array(factors, pa.list_(pa.float64()))], [*b.schema.names, "code", "factors"])

    return classes.mapInArrow(run, "label string, vec binary, rep long, n long, cid long, code binary, factors array<double>")


def _signatures(index: DataFrame, bits: int, bands: int) -> DataFrame:
    """(key, band, cid): a row for each band of each code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, used = b.num_rows, -(-bits * bands // 8)
            codes = np.frombuffer(b"".join(c[:used] for c in b.column("code").to_pylist()), np.uint8).reshape(n, used)
            values = _bands(np.unpackbits(codes, axis=1), bits, bands)
            rows = np.repeat(np.arange(n), bands)
            columns = [b.column("cid").take(pa.array(rows)), b.column("label").take(pa.array(rows)), pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), pa.array(values.reshape(-1))]
            yield pa.RecordBatch.from_arrays(columns, ["cid", "label", "band", "bits"])

    rows = index.select("cid", "label", "code").mapInArrow(run, "cid long, label string, band int, bits long")
    return rows.select(F.xxhash64("label", "band", "bits").alias("key"), "band", "cid")


def _roots(n: int, i: np.ndarray, j: np.ndarray, cid: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest cid in its component of the links i-j."""
    root = cid.copy()
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            return root
        root = new


def _compare(cid, n, label, band, side, cross, u, signs, factors, threshold, bits, bands) -> Iterator[tuple]:
    """Links among the rows of one group, or between its two sides: (cid, links, root) for each linked row."""
    d = u.shape[1]
    r = factors.shape[1]
    turned = u @ rotations_cached(d, r)
    scale = np.repeat(1.0 / (factors * math.sqrt(d) * r), d, axis=1)
    code = (np.where(signs[:, : r * d], 1.0, -1.0) * scale).astype(np.float32)
    bound = ERRORS * np.sqrt((np.maximum(0.0, 1 - factors**2) / factors**2).mean(axis=1) / (r * (d - 1)))
    values = _bands(signs, bits, bands)
    left, right = (np.flatnonzero(~side), np.flatnonzero(side)) if cross else (np.arange(len(cid)),) * 2
    estimate = code[left] @ turned[right].T.astype(np.float32)
    maybe = estimate >= (threshold - bound[left])[:, None]
    if not cross:
        maybe |= maybe.T
        maybe &= np.triu(np.ones(maybe.shape, bool), 1)
    i, j = np.nonzero(maybe)
    i, j = left[i], right[j]
    same = label[i] == label[j]
    i, j = i[same], j[same]
    for at in range(0, len(i), 1 << 15):
        a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        keep = np.einsum("ij,ij->i", u[a], u[b]) >= threshold
        if band:
            keep &= ~(values[a, :band] == values[b, :band]).any(axis=1)
        i[at : at + (1 << 15)], j[at : at + (1 << 15)] = np.where(keep, a, -1), np.where(keep, b, -1)
    i, j = i[i >= 0], j[j >= 0]
    if len(i):
        links = np.bincount(i, n[j], len(cid)) + np.bincount(j, n[i], len(cid))
        root = _roots(len(cid), i, j, cid)
        for k in np.flatnonzero(links):
            yield int(cid[k]), int(links[k]), int(root[k])


_TURNS: dict[tuple[int, int], np.ndarray] = {}


def rotations_cached(dim: int, count: int) -> np.ndarray:
    if (dim, count) not in _TURNS:
        _TURNS[dim, count] = rotations(dim, count)
    return _TURNS[dim, count]


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """df(vec_id, label, embedding) -> (vec_id, n_links, component_id, kept), one row per row.

    Vectors link if their labels are equal and their cosine is `threshold` or more. A null label, and a vector that is
    null, empty, zero, or holds null or non-finite numbers, links with nothing. Equal vectors of a label are one class, so
    copies cost a row each and still count as links. Vectors of different lengths never link. Every link reported is exact;
    a pair at the threshold itself is missed with a chance of MISS, a closer pair with less. Rows that repeat an id count
    as vectors of their own. An empty table gives an empty table.
    """
    rows, kind = vectors(df)
    rows = saved(rows)
    classes = saved(rows.where("vec IS NOT NULL").groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))).withColumn("cid", F.monotonically_increasing_id())
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    bits, bands = layout(largest, threshold)
    index = saved(indexed(classes, kind, bits, bands))
    signatures = saved(_signatures(index, bits, bands))
    crowded = signatures.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    met = signatures.join(crowded, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid", "key"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cid", "band", "key", (F.col("own") > F.col("other")).alias("side"), (F.col("own") != F.col("other")).alias("cross"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    met = met.select("cid", "band", "side", "cross", F.xxhash64("key", "lo", "hi").alias("group")).join(index.drop("rep"), "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "group", 4096):
            group = t.column("group").to_numpy()
            cid, n, band, side, cross = (t.column(c).to_numpy() for c in ("cid", "n", "band", "side", "cross"))
            label, vec, code, factors = (t.column(c).to_pylist() for c in ("label", "vec", "code", "factors"))
            label = np.array(label, object)
            out = []
            begins = starts(group)
            for a, z in zip(begins, np.r_[begins[1:], len(group)], strict=True):
                sizes = np.fromiter((len(v) for v in vec[a:z]), np.int64, z - a)
                for size in np.unique(sizes):
                    k = a + np.flatnonzero(sizes == size)
                    if len(k) < 2:
                        continue
                    signs = np.unpackbits(np.frombuffer(b"".join(code[i] for i in k), np.uint8)).reshape(len(k), -1).astype(bool)
                    out += _compare(cid[k], n[k], label[k], int(band[a]), side[k].astype(bool), bool(cross[a]), _units([vec[i] for i in k], kind), signs, np.array([factors[i] for i in k]), threshold, bits, bands)
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cid", "links", "root"])

    found = saved(met.repartition(F.col("group")).sortWithinPartitions("group").mapInArrow(run, "cid long, links long, root long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = index.select("label", "vec", "rep", "n", "cid")
    roots = parts.join(named.select(F.col("cid").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    parts = parts.join(roots, "component").select(F.col("node").alias("cid"), "least")
    told = named.join(links, "cid", "left").join(parts, "cid", "left").select("label", "vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"), "n")
    told = saved(told)
    lone = rows.where("vec IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    some = rows.where("vec IS NOT NULL")
    return joined(some, told, ["label", "vec"], "n", some.count()).select("vec_id", "n_links", "component_id").unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))
