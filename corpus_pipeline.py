"""A training corpus from raw documents: language, near-duplicates, secrets, mixture, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import langid, mixing, packing, secrets, simhash
from tarnwell.llm.common import crc_rest, drop_saved, saved, table, tables_saved

#: Below this probability a prediction is no prediction.
SURE = 0.5
#: Rejected texts that may be broadcast; more are joined by shuffling.
REJECTED = 500_000
#: What stands for a secret.
MARK = "[SECRET]"


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as one column, beside the columns that stages read: no other column can clash with theirs."""
    return docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters, or of doubtful language, go.

    A prediction depends on the text alone, so rejected texts are told by 128 bits of hash and documents stay where they are.
    Null and empty texts have no letters and go; repeated rows stay or go together; an empty
    table gives an empty table.
    """
    key = F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b"))
    model = langid.train(docs.where(crc_rest("doc_id", 3) != langid.HELD_OUT))
    told = langid.predict(docs.select(key.alias("key"), "text"), model, ("key",))
    rejected = saved(told.where((F.col("lang_pred") == "und") | (F.col("score") < SURE)).select("key").distinct())
    few = rejected.count() <= REJECTED  # 16 bytes each
    return docs.join(F.broadcast(rejected) if few else rejected, key == rejected["key"], "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of least id (null last), of rows that repeat it the one of least text hash.

    Of rows equal in both, the one whose other columns come first as JSON stays.
    """
    groups = simhash.near_duplicates(docs)
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("kept"))
    kept = first.select(F.col("kept.doc_id").alias("id"), F.col("kept.text_hash").alias("h"))
    order = F.to_json(F.struct(*(F.col(f"doc.{c}") for c in docs.columns if c != "text")))
    rows = _whole(docs).select("doc", F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), order.alias("order"))
    left = rows.join(kept, rows["id"].eqNullSafe(kept["id"]) & (rows["h"] == kept["h"]), "left_semi")
    return left.groupBy("id", "h").agg(F.min_by("doc", "order").alias("doc")).select("doc.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark; n_chars follows the text.

    A text without secrets stays as it is, a null one null, with its n_chars; repeated rows are marked alike; an empty table
    gives an empty table.
    """
    rest = F.struct(*(c for c in docs.columns if c != "text"))
    found = secrets.scan(docs.select(rest.alias("rest"), "text"), ("rest",), mark=MARK)
    n_chars = F.when(F.size("spans") > 0, F.length("clean").cast("long")).otherwise(F.col("rest.n_chars"))
    new = {"text": F.col("clean"), "n_chars": n_chars}
    return found.select(*(new[c].alias(c) if c in new else F.col("rest")[c].alias(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them, every copy at the time at which training reaches it.

    A null source is a source of its own; a document without words adds nothing to a target; repeated rows are documents of
    their own; an empty table gives an empty table.
    """
    mixed = mixing.mix(_whole(docs), ("doc",), whole=True)
    copies = mixed.select("doc", F.explode("positions").alias("position"))
    return copies.orderBy("position", "doc.doc_id").select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training windows; windows and their ids follow the order of the rows.

    Null and empty texts are one token, the end; repeated rows and ids are packed each; an empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", without_secrets),
    ("mix_sources", mixture),
    ("pack", packed),
]

#: Learned language scores, XXH64 fingerprints and a tokenizer's ids are not SQL's; tests hold stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), tables_saved()
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        drop_saved(before, but=1)  # what the stage and the one before it wrote on their way
    return STAGES[-1][1](spark, docs, sf_dir)
