"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger stores the measurements and one failure bit per rule. A policy is a
named version of a mask: applying it, comparing versions and counting what each rule alone would cost are bitwise
operations on the ledger, so no text is read again. DataFrame functions only.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, table, words

SYMBOLS = "[#*$%&|<>]"
#: Consecutive words that make a window.
SPAN = 3

#: A rule's place is its bit. The first two are the base.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 15 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols", "repeated_lines"),
    "v2": tuple(RULES),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


#: Texts of fewer windows are sorted by one long each.
SHORT = 4096


def repeated_words(w: Column, span: int = SPAN) -> Column:
    """Words of the array w that lie in a window of `span` words found twice or more in it.

    Windows are sorted by hash, then place; neighbours of equal hash are compared word by word. Short texts pack hash and
    place into one long, which sorts faster; longer ones sort structs with all 64 bits of the hash.
    """
    n = F.size(w) - span + 1
    bits = F.lit(12)
    hashed = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(span)))
    packed = lambda i: F.call_function("shiftleft", hashed(i), bits).bitwiseOR(i.cast("long"))
    places = F.sequence(F.lit(0), n - 1)
    low = F.lit((1 << 12) - 1)

    def covered(found: Column) -> Column:
        """Each found window covers `span` words, less what the next one covers too."""
        step = lambda x, i: F.least(F.coalesce(F.get(found, i + 1) - x, F.lit(span)), F.lit(span))
        return F.aggregate(F.transform(found, step), F.lit(0), lambda s, x: s + x)

    def count(s: Column, key: Callable[[Column], Column], at: Callable[[Column], Column]) -> Column:
        same = lambda x, y: F.coalesce((key(x) == key(y)) & functools.reduce(Column.__and__, (F.get(w, at(x) + k) == F.get(w, at(y) + k) for k in range(span))), F.lit(False))
        found = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return _let(F.sort_array(F.transform(found, at)), covered)

    short = _let(F.sort_array(F.transform(places, packed)), lambda s: count(s, lambda x: F.call_function("shiftrightunsigned", x, bits), lambda x: x.bitwiseAND(low).cast("int")))
    long = _let(F.sort_array(F.transform(places, lambda i: F.struct(hashed(i).alias("h"), i.alias("i")))), lambda s: count(s, lambda x: x["h"], lambda x: x["i"]))
    return F.when(n < 2, 0).when(n <= SHORT, short).otherwise(long)


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, failed (bits); one row per row.

    Null texts have no words: they fail few_words and nothing that is a share of words. Equal rows get equal measurements,
    repeated rows and null ids are rows like any other; very long texts are measured whole; columns of df other than `keep`
    and text are not read, so their names cannot clash. An empty table gives an empty table.
    """
    text = F.col("text")
    split = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = split.select("row", "text", words(text).alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    measured = split.select(
        "row",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0) for name, rule in RULES.items()]
    return measured.withColumn("failed", sum(bits[1:], bits[0]).cast("long")).select("row.*", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "failed")


def passes(policy: str = CURRENT) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    """rule, failed (documents that fail it), alone (documents that only this rule of the policy removes), one row per rule."""
    m = mask(policy)
    counts = led.select(F.col("failed").bitwiseAND(F.lit(m)).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    rules = [F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[policy]]
    return counts.select("n", "f", F.explode(F.array(*rules)).alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("f").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("f") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("alone"),
    )


def op9_quality_rules(spark, sf_dir):
    """The ledger with the verdict of the current policy; `failed` holds the bits that policies and ablations read."""
    led = ledger(table(spark, sf_dir, "documents"))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), (passes("base") & passes()).alias("kept"), "failed")


OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT r, doc_id, regexp_extract_all(t, '{WORD}') AS w, len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM d),
u AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM m),
n AS (SELECT r, i, x, lead(x, 1) OVER p AS y, lead(x, 2) OVER p AS z FROM u WINDOW p AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS k FROM n WHERE z IS NOT NULL),
v AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) s(o) WHERE k > 1 GROUP BY r),
a AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(n_symbols AS BIGINT) AS n_symbols, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM m LEFT JOIN v USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (2 * n_dup_lines > n_lines)::INT
            + 16 * (word_chars > 15 * n_words)::INT + 32 * (word_chars < 2 * n_words)::INT AS BIGINT) AS failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars > 15 * n_words OR word_chars < 2 * n_words) AS kept
FROM b
"""
