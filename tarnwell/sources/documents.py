"""Semi-structured values: documents kept whole as variants and read by path, whatever fields they have.

A variant keeps every field of a document and its order of magnitude in size; fields that queries use often are shredded
into columns beside it, and the rest stays where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How deep fields of fields are looked for; deeper ones count as one field's content.
DEPTH = 4


def parsed(text: str | Column) -> Column:
    """The variant of a JSON text; null where it is none."""
    return F.try_parse_json(text)


def at(value: str | Column, path: str, kind: str = "string") -> Column:
    """The value at a path like $.a[0].b, as `kind`; null where the path or the kind does not fit."""
    return F.try_variant_get(value, path, kind)


def shredded(df: DataFrame, value: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """df with a column for each of fields (name -> path, kind); the variant stays, so nothing is lost."""
    return df.select("*", *(at(value, path, kind).alias(name) for name, (path, kind) in fields.items()))


def fields(df: DataFrame, value: str, keys: tuple[str, ...], depth: int = DEPTH) -> DataFrame:
    """keys, path, kind, text: every value of every document that is no object or list, and empty ones, by its path.

    Lists' places are part of the path. Null and unreadable documents have none. A field of a document is a row for as
    long as the plan needs it; nothing is collected. Beyond `depth` the content comes as JSON text.
    """
    level = df.where(F.col(value).isNotNull()).select(*keys, F.lit("$").alias("path"), F.col(value).alias("v"))
    done = None
    for k in range(depth + 1):
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT<") | (kind.startswith("ARRAY<") & (kind != "ARRAY<VOID>")) if k < depth else F.lit(False)
        told = level.withColumn("kind", kind).withColumn("nested", nested)
        leaves = told.where(~F.col("nested")).select(*keys, "path", F.when(F.col("kind").rlike("^(OBJECT|ARRAY)<"), F.substring_index("kind", "<", 1)).otherwise(F.substring_index("kind", "(", 1)).alias("kind"), _text(F.col("v"), F.col("kind")).alias("text"))
        done = leaves if done is None else done.unionByName(leaves)
        if k < depth:
            inner = told.where("nested").select(*keys, F.col("path").alias("above"), "v")
            opened = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("v").outer()))
            name = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
            level = opened.select(*keys, F.concat("above", name).alias("path"), F.col("value").alias("v"))
    return done


def _text(v: Column, kind: Column) -> Column:
    return F.when(kind == "STRING", v.cast("string")).otherwise(F.to_json(v))


def round_trip(value: str | Column) -> Column:
    """The variant as JSON text: all its fields, known or not."""
    return F.to_json(value)
