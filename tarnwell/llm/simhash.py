"""SimHash near-duplicates.

A fingerprint's 64 bits are cut into 32 segments of two; the bit count of each segment (0, 1, 2) embeds it in a grid.
The Manhattan distance of two embeddings never exceeds the Hamming distance of the fingerprints. Within distance 3 one
half of the 32 counts differs by at most 1 in total, so a range join over the cells of each half, own cell and cells
one step up, meets every pair; the whole embedding's distance then filters, the fingerprints' own distance verifies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_bytes, joined, saved, text_blocks
from .graph import components

SEED = 42
_ODD = 0x5555555555555555


def fingerprint(text: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash of the text's word shingles; 0 without words."""
    w = text.lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    begins = np.r_[0, ends[:-1]]
    k = min(shingle, len(w))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[i:j], seed) for i, j in zip(begins[: len(w) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)
    count = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        count += np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp long, text_hash), one row per row; null text counts as empty, fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_blocks(batches, 1):
            fps = np.array([fingerprint(t, shingle) for t in ascii_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], ["doc_id", "fp", "text_hash"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, fp long, text_hash long")


def _counts(half: Column) -> Column:
    """Bit counts of the 16 segments of 32 bits, two bits each."""
    return half.bitwiseAND(F.lit(_ODD >> 32)) + F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(_ODD >> 32))


def _unary(fp: Column) -> Column:
    """The counts written as 00, 01, 11: differing bits of two such words are the Manhattan distance of their counts."""
    high = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(high).bitwiseAND(F.lit(_ODD)).bitwiseOR(F.shiftleft(fp.bitwiseAND(high).bitwiseAND(F.lit(_ODD)), 1))


def near_pairs(fps: DataFrame, distance: int = 3) -> DataFrame:
    """fps(fp long, distinct) -> (a, b): every pair of fingerprints at 1 to `distance` (at most 3) differing bits."""
    if not 0 <= distance <= 3:
        raise ValueError("distance must lie between 0 and 3")
    fp = F.col("fp")
    half = F.posexplode(F.array(_counts(fp.bitwiseAND(F.lit(0xFFFFFFFF))), _counts(F.shiftrightunsigned(fp, 32)))).alias("half", "cell")
    own = fps.select("fp", half)
    steps = F.transform(F.sequence(F.lit(0), F.lit(30), F.lit(2)), lambda i: F.when(F.call_function("shiftright", F.col("cell"), i).bitwiseAND(F.lit(3)) < 2, F.col("cell") + F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    reach = own.select("half", "cell", "fp", F.lit(True).alias("own")).unionByName(
        own.select("half", F.explode(F.array_compact(steps)).alias("cell"), "fp", F.lit(False).alias("own"))
    )
    a, b = F.col("l.fp"), F.col("r.fp")
    near = (F.bit_count(_unary(a).bitwiseXOR(_unary(b))) <= distance) & (F.bit_count(a.bitwiseXOR(b)) <= distance)
    met = own.alias("l").join(reach.alias("r"), (F.col("l.half") == F.col("r.half")) & (F.col("l.cell") == F.col("r.cell")) & (a != b) & (~F.col("r.own") | (a < b)) & near)
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp, component_id, group, text_hash), one row per row.

    Equal fingerprints are one node, so groups of copies cost a row each. component_id is the smallest doc_id reachable
    over links of at most `distance` differing bits; `group` tells groups apart even where ids repeat. Texts without words
    share fingerprint 0; repeated rows are of one group; a very long text is one row like any other. A row with a null doc_id is
    grouped like any other; a group of null ids only has a null component. An empty table gives an empty table.
    """
    each = saved(fingerprints(docs, shingle))
    nodes = saved(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    parts = components(near_pairs(nodes.select("fp"), distance))
    groups = parts.join(nodes.withColumnRenamed("fp", "node"), "node").groupBy("component").agg(F.min("least").alias("root"))
    named = parts.join(groups, "component").select(F.col("node").alias("fp"), "root", "component")
    labels = saved(nodes.join(named, "fp", "left").select("fp", "n", F.coalesce("root", "least").alias("component_id"), F.coalesce("component", "fp").alias("group")))
    return joined(each, labels, ["fp"], "n", each.count()).select("doc_id", "fp", "component_id", "group", "text_hash")


def op3_simhash_near_dedup(spark, sf_dir):
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
