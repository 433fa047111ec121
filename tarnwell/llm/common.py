"""Shared pieces of the corpus operators.

Every operator reads only the columns it names, so extra columns, clashing names included, never reach its plan.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The characters that part words.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode where the session names none (tests)."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tarnwell-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df without its lineage, in reliable storage; for small tables that a loop goes over again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_TABLES: list[str] = []


def saved(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df as a compressed table in the shared folder, so that lost executors cost no recomputation of what led to it.

    The driver removes its tables when it ends; `drop_saved` does so earlier, once nothing reads them any more.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables_saved() -> int:
    return len(_TABLES)


def drop_saved(since: int = 0, but: int = 0) -> None:
    """Removes the tables saved after the first `since`, except for the last `but`."""
    spark = SparkSession.getActiveSession()
    last = len(_TABLES) - but
    while spark is not None and last > since:
        last -= 1
        path = spark._jvm.org.apache.hadoop.fs.Path(_TABLES.pop(last))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


atexit.register(drop_saved)


def most_frequent(counts: DataFrame, item: str, n: str, most: int) -> pa.Table:
    """The `most` rows of largest n, ties by item, in order. counts is a stored table and is read twice.

    They come as columns, which take the driver a tenth of what as many rows would, and are merged by a task, not the driver.
    A histogram of n on a logarithmic scale (about a thousand rows) tells above which count the rows lie, so that what is
    sorted and sent to the driver is bounded by `most` and one bin, whatever the table's size and partitions.
    """
    step = F.floor(F.log2(F.col(n).cast("double")) * 64)
    bins = sorted(((r[0], r[1]) for r in counts.where(F.col(n) > 0).groupBy(step.alias("b")).count().collect()), reverse=True)
    low, seen = 0, 0
    for b, k in bins:
        low, seen = b, seen + k
        if seen >= most:
            break
    return counts.where((F.col(n) > 0) & (step >= low)).orderBy(F.desc(n), item).limit(most).toArrow()


def less_frequent(counts: DataFrame, item: str, n: str, top: pa.Table) -> DataFrame:
    """The rows of counts that come after those of `most_frequent`; items differ from row to row."""
    if not top.num_rows:
        return counts
    least, last = top[n][-1].as_py(), top[item][-1].as_py()
    return counts.where((F.col(n) < least) | ((F.col(n) == least) & (F.col(item) > last)))


def running_sums(df: DataFrame, order: tuple[str, ...], sums: dict[str, Column]) -> DataFrame:
    """df with columns that hold sums over all rows before, by `order`, whose values must differ from row to row.

    The rows are dealt into ranges of the order and summed range by range; only the ranges' sums, one row for each
    partition, are summed in one place.
    """
    dealt = saved(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    back = (Window.unboundedPreceding, -1)
    of_range = dealt.groupBy("_range").agg(*(F.sum(v).alias(f"_{k}") for k, v in sums.items()))
    bases = of_range.select("_range", *(F.coalesce(F.sum(f"_{k}").over(Window.orderBy("_range").rowsBetween(*back)), F.lit(0)).alias(f"_{k}") for k in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(*back)
    both = dealt.join(F.broadcast(bases), "_range")  # a row for each partition
    return both.withColumns({k: F.col(f"_{k}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in sums.items()}).drop("_range", *(f"_{k}" for k in sums))


#: A key is hot if it has more than this part of all rows; there are no more such keys than the number says.
HOT = 1000


def joined(rows: DataFrame, labels: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """The inner join of rows with labels (one for each key, with the number n of its rows, `total` in all).

    Hot keys, of which there are HOT at most since their rows add up to `total`, are broadcast, so their rows stay where
    they are; the others are joined by key. Both tables are stored ones, for they are read twice.
    """
    hot = labels.where(F.col(n) * HOT > total).select(*on, F.struct(*labels.columns).alias("_label"))
    told = rows.join(F.broadcast(hot), on, "left")
    others = [c for c in labels.columns if c not in on]
    easy = told.where("_label IS NOT NULL").select(*rows.columns, *(F.col(f"_label.{c}").alias(c) for c in others))
    return easy.unionByName(told.where("_label IS NULL").drop("_label").join(labels, on).select(*rows.columns, *others))


def crc_rest(column: str, n: int) -> Column:
    """crc32 of the number written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def words(text: str | Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS)), " "), "")


def n_words(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def ascii_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty. bytes.split() parts at exactly BLANKS and bytes.lower() touches A-Z only."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


#: Bytes of text that a task turns into Python's texts at once.
BLOCK = 1 << 22


def text_blocks(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut anew into copies with about BLOCK bytes in the column each; a longer text is alone or last."""
    for batch in batches:
        if batch.num_rows:
            heads = starts(np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64)) // BLOCK)
            for a, z in zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows], strict=True):
                yield batch.take(pa.array(np.arange(a, z)))


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Batches sorted by key, cut anew so that no group of equal keys is split; about `rows` rows each."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        whole = pa.Table.from_batches(held)
        last = whole.column(key)[n - 1]
        same = whole.column(key).combine_chunks()
        tail = pc.equal(same, last).to_numpy(zero_copy_only=False)
        cut_at = n - int(np.argmin(tail[::-1])) if not tail.all() else 0
        if cut_at:
            yield whole.slice(0, cut_at)
            held, n = whole.slice(cut_at).combine_chunks().to_batches(), n - cut_at
    if n:
        yield pa.Table.from_batches(held)


def starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, int)


def bit_filter(at: Column, rows: DataFrame, power: int) -> np.ndarray:
    """2^power bits as 64-bit words, those set at which a row has the number `at`; as large whatever the table's size."""
    at = at.bitwiseAND(F.lit((1 << power) - 1))
    cell, bit = F.call_function("shiftrightunsigned", at, F.lit(6)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    found = rows.select(cell.alias("cell"), bit.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2^(power - 6) rows at most
    out = np.zeros(1 << (power - 6), np.uint64)
    out[found["cell"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out
