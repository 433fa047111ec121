"""Column functions that every operator shares.

Rounding is floor(x * 10^k + 0.5) / 10^k: both Spark and SQL engines compute it bit for bit alike, and it differs from
half-even rounding on ties only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic.
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "shall", "can", "to", "of", "in", "for", "on", "with", "at", "by", "from",
    "as", "into", "through", "during", "before", "after", "above", "below", "between", "out", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "each", "every", "both",
    "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very",
    "just", "because", "but", "and", "or", "if", "while", "about", "up", "it", "its", "this", "that", "i", "me", "my", "we",
    "our", "you", "your", "he", "she", "they", "his", "her", "him", "them", "their", "what", "which", "who",
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def truthy(c: str | Column) -> Column:
    """The number, or null where it is null or 0."""
    return F.when(col(c) != 0, col(c))


def strip(c: str | Column) -> Column:
    """The text without white space around it; null is empty."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^\s+|\s+$", "")


def tokens(c: str | Column) -> Column:
    """Lower-case runs of letters a-z and digits of two characters and more that are no stopwords."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^a-z0-9]+", " ")), " ")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def contains(text: str | Column, part: str) -> Column:
    """Case-insensitive substring test; the part is taken literally, null text is empty."""
    return F.contains(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(part.lower()))


def items(text: str, blanks: bool = False) -> list[str]:
    """A comma-separated parameter as trimmed items."""
    parts = [p.strip() for p in text.split(",")]
    return parts if blanks else [p for p in parts if p]


def whole(c: Column) -> Column:
    """A number printed without decimals, half to even."""
    return F.bround(c, 0).cast("long").cast("string")


def mean_of_present(*cs: Column) -> Column:
    """Mean of the arguments that are not null; null if none is."""
    parts = F.array_compact(F.array(*cs))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(parts) > 0, total / F.size(parts))


def slug(c: str | Column) -> Column:
    return F.substring(F.translate(F.lower(col(c)), " -", ""), 1, 12)


def code_points_head(c: str | Column, n: int) -> Column:
    return F.substring(F.coalesce(col(c), F.lit("")), 1, n)


def exact_mean(c: Column) -> Column:
    """Aggregate: the mean of values of at most 6 decimals, summed as decimals, so that order does not matter."""
    return F.sum(c.cast("decimal(20,6)")).cast("double") / F.nullif(F.count(c), F.lit(0))
