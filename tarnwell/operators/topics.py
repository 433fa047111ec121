"""Topic classification of review text by multinomial naive Bayes with keyword seeds."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import mean_of_present, rnd, tokens
from ..functions.stored import saved

#: Seed phrases of each category. Each word of a phrase counts SEED_WEIGHT.
SEEDS = {
    "grading": (
        "grade", "grades", "grading", "graded", "grader", "curve", "curved", "curving", "gpa", "rubric", "points",
        "deductions", "harsh", "lenient", "fair", "unfair", "partial credit", "extra credit", "regrade", "generous",
        "strict", "tough grader", "easy grader", "a+", "a-", "b+", "b-", "c+", "c-", "d", "f", "pass", "fail", "credit",
    ),
    "lectures": (
        "lecture", "lectures", "lecturing", "lecturer", "class", "teaching", "taught", "teach", "explains", "explanation",
        "clear", "confusing", "boring", "engaging", "interesting", "slides", "notes", "powerpoint", "presentation",
        "understand", "clarity", "organized", "disorganized", "monotone", "enthusiastic", "passionate", "dry", "pace",
        "fast", "slow", "examples", "concepts", "material", "content",
    ),
    "workload": (
        "homework", "hw", "assignments", "assignment", "workload", "work", "reading", "readings", "pages", "hours", "time",
        "busy", "heavy", "light", "manageable", "overwhelming", "problem sets", "psets", "lab", "labs", "project",
        "projects", "paper", "papers", "essay", "essays", "weekly", "daily", "nightly",
    ),
    "approachability": (
        "office hours", "office", "hours", "helpful", "help", "available", "email", "responsive", "approachable",
        "friendly", "nice", "kind", "caring", "supportive", "rude", "mean", "intimidating", "cold", "dismissive", "patient",
        "understanding", "accessible", "welcoming", "encouraging", "mentor",
    ),
    "exams": (
        "exam", "exams", "test", "tests", "midterm", "midterms", "final", "finals", "quiz", "quizzes", "study", "studying",
        "review", "practice", "multiple choice", "free response", "open book", "closed book", "cheat sheet", "proctored",
        "tricky", "straightforward", "memorization", "conceptual", "application",
    ),
}
CATEGORIES = tuple(SEEDS)
SEED_WEIGHT = 3
SPARE_VOCABULARY = 1000
MEMBER = 0.25
CONFIDENT = 0.35
POSITIVE = 3.5


def seed_counts() -> dict[str, Counter]:
    return {c: Counter({w: n * SEED_WEIGHT for w, n in Counter(w for phrase in phrases for w in phrase.split()).items()}) for c, phrases in SEEDS.items()}


def seed_model(spark: SparkSession) -> DataFrame:
    """(category, token, cnt)."""
    return spark.createDataFrame([(c, t, n) for c, counts in seed_counts().items() for t, n in counts.items()], "category string, token string, cnt long")


def _posterior(logs: dict[str, Column]) -> Column:
    """array<struct<category, probability>> in seed order, probabilities to 4 digits."""
    most = F.greatest(*logs.values())
    exps = {c: F.exp(x - most) for c, x in logs.items()}
    total = sum(list(exps.values())[1:], next(iter(exps.values())))
    return F.array(*(F.struct(F.lit(c).alias("category"), rnd(e / total, 4).alias("probability")) for c, e in exps.items()))


def seed_scores(text: str | Column) -> Column:
    """Posterior of a text under the seeds alone: no join, one expression.

    Tokens are counted by their seed weight in each category, so that only a few logarithms are summed, in fixed order;
    words that are no seeds are left out of these counts once, before any category looks.
    A text without tokens gets equal probabilities.
    """
    counts = seed_counts()
    vocabulary = len(set().union(*counts.values())) + SPARE_VOCABULARY
    words = tokens(text)

    def scored(n: Column, w: Column) -> Column:
        logs = {}
        for c in CATEGORIES:
            scale = float(sum(counts[c].values()) + vocabulary)
            known = sorted(set(counts[c].values()))
            hit = {k: F.size(F.filter(w, _is_one_of([x for x, n in counts[c].items() if n == k]))) for k in known}
            rest = n - sum(list(hit.values())[1:], next(iter(hit.values())))
            logs[c] = F.lit(math.log(1 / len(CATEGORIES))) + rest * F.lit(math.log(1.0 / scale)) + sum((n * F.lit(math.log((k + 1.0) / scale)) for k, n in list(hit.items())[1:]), list(hit.values())[0] * F.lit(math.log((known[0] + 1.0) / scale)))
        return _posterior(logs)

    seeds = _is_one_of(sorted(set().union(*counts.values())))
    known = lambda w: F.get(F.transform(F.array(F.filter(w, seeds)), lambda k: scored(F.size(w), k)), 0)
    return F.get(F.transform(F.array(words), known), 0)


def _is_one_of(words: list[str]):
    return lambda t: t.isin(words)


#: A token is frequent if it has more than this part of what a model counts; there are fewer such tokens than the number says.
FREQUENT = 1 << 18


def scores(reviews: DataFrame, model: DataFrame, keys: tuple[str, ...], text: str = "comment", partition: tuple[str, ...] = ()) -> DataFrame:
    """keys, category, probability under any model (partition.., category, token, cnt); one row per category.

    The model is stored with a row for each token. Its frequent tokens are broadcast, so that nearly all of a text's tokens
    are summed where the text is; of the others, those that the model knows are joined. `keys` must tell reviews apart and
    hold `partition`.
    """
    logs = [F.sum(F.when(F.col("category") == c, F.ln(F.col("cnt") + 1.0)).otherwise(0.0)).alias(f"l{i}") for i, c in enumerate(CATEGORIES)]
    counts = [F.sum(F.when(F.col("category") == c, F.col("cnt")).otherwise(0)).alias(f"n{i}") for i, c in enumerate(CATEGORIES)]
    each = range(len(CATEGORIES))
    wide = saved(model.groupBy(*partition, "token").agg(*logs, *counts))
    n = sum((F.col(f"n{i}") for i in each[1:]), F.col("n0"))
    sizes = wide.groupBy(*partition).agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in each), (F.count(F.lit(1)) + SPARE_VOCABULARY).alias("v"))
    total = wide.agg(F.sum(n)).first()[0] or 0
    known = wide.select(*partition, "token", *(f"l{i}" for i in each), (n * FREQUENT > total).alias("frequent"))
    words = reviews.select(*keys, F.explode_outer(tokens(text)).alias("token"))
    met = words.join(F.broadcast(known.where("frequent")), [*partition, "token"], "left")
    sums = [F.sum(f"l{i}").alias(f"l{i}") for i in each]
    here = met.groupBy(*keys).agg(F.count("token").alias("n"), *sums)
    rare = met.where("token IS NOT NULL AND frequent IS NULL").select(*keys, "token").join(known.where("NOT frequent").drop("frequent"), [*partition, "token"])
    both = here.unionByName(rare.groupBy(*keys).agg(F.lit(0).cast("long").alias("n"), *sums)).groupBy(*keys).agg(F.sum("n").alias("n"), *sums)
    both = both.join(F.broadcast(sizes), list(partition)) if partition else both.crossJoin(F.broadcast(sizes))  # a row for each partition
    log = {c: F.coalesce(F.col(f"l{i}"), F.lit(0.0)) - F.col("n") * F.ln((F.col(f"n{i}") + F.col("v")).cast("double")) for i, c in enumerate(CATEGORIES)}
    # an array of one, exploded: the posterior is found once
    told = both.select(*keys, F.explode(F.array(F.struct(*(x.alias(c) for c, x in log.items())))).alias("m"))
    return told.select(*keys, F.explode(_posterior({c: F.col(f"m.{c}") for c in CATEGORIES})).alias("x")).select(*keys, "x.category", "x.probability")


def _hash(token: str) -> int:
    """Spark's xxhash64 of a text."""
    h = xxhash.xxh64_intdigest(token.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


class TopicCounts:
    """A model that learns text by text: one row of counts for each token, one column for each category.

    Tokens are known by their 64-bit hashes. A row of zeros is that of a token met in no text that was learned.
    """

    def __init__(self) -> None:
        seeds = seed_counts()
        tokens_ = list(dict.fromkeys(t for c in CATEGORIES for t in seeds[c]))
        self.row = {_hash(t): i for i, t in enumerate(tokens_)}
        self.counts = np.array([[seeds[c][t] for c in CATEGORIES] for t in tokens_], float)
        self.logs = np.log1p(self.counts)
        self.totals = self.counts.sum(axis=0)
        self.met = self.counts.any(axis=1)
        self.n_met = len(tokens_)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """The rows of tokens; those met for the first time get one."""
        codes, found = pd.factorize(hashes)
        rows = np.array([self.row.setdefault(h, len(self.row)) for h in found.tolist()], int)
        if len(self.row) > len(self.counts):  # room for half as many again
            more = len(self.row) + len(self.row) // 2 - len(self.counts)
            self.counts, self.logs = (np.vstack([x, np.zeros((more, len(CATEGORIES)))]) for x in (self.counts, self.logs))
            self.met = np.append(self.met, np.zeros(more, bool))
        return rows[codes]

    def scored(self, at: np.ndarray) -> list[float]:
        """Probabilities of a text with tokens in these rows, in the order of CATEGORIES, to 4 digits; those of no tokens are equal."""
        spare = self.n_met + SPARE_VOCABULARY
        log = [x - len(at) * math.log(t + spare) for x, t in zip(self.logs[at].sum(axis=0).tolist(), self.totals.tolist(), strict=True)]
        most = max(log)
        odds = [math.exp(x - most) for x in log]
        total = sum(odds)
        return [round(p / total, 4) for p in odds]

    def posterior(self, words: list[str]) -> np.ndarray:
        return np.array(self.scored(self.rows(np.array([_hash(w) for w in words], np.int64))))

    def learn(self, at: np.ndarray, category: int) -> None:
        new = at[~self.met[at]]
        self.n_met += len(set(new.tolist()))
        self.met[new] = True
        cells = at * len(CATEGORIES) + category
        counts, logs = self.counts.reshape(-1), self.logs.reshape(-1)
        np.add.at(counts, cells, 1.0)
        logs[cells] = np.log1p(counts[cells])
        self.totals[category] += len(at)

    def train(self, hashes: np.ndarray, ends: np.ndarray) -> None:
        """Meets texts one after the other, each by where its tokens end, and learns those that are confident."""
        at, begin = self.rows(hashes), 0
        for end in ends.tolist():
            if end > begin:
                words = at[begin:end]
                p = self.scored(words)
                if max(p) > CONFIDENT:
                    self.learn(words, p.index(max(p)))
            begin = end

    def batches(self, school: str | None, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        """(school, h, counts) of every token that was learned."""
        h = np.fromiter(self.row, np.int64, len(self.row))
        for k in range(0, len(h), rows):
            n = self.counts[k : k + rows][: len(h) - k].astype(np.int64)
            told = n.any(axis=1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(n[told].ravel()), len(CATEGORIES)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([school] * len(lists), pa.string()), pa.array(h[k : k + rows][told]), lists], ["school", "h", "counts"])


#: Tokens that a model meets at once.
MET_AT_ONCE = 1 << 22


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(school, hashes), sorted, to the model of each school; texts stream by, only a model is kept."""
    name, model = None, None
    for batch in batches:
        school, lists = batch.column(0), batch.column(1)
        ends = lists.value_lengths().to_numpy().cumsum()
        flat = lists.flatten().to_numpy()
        codes = school.dictionary_encode(null_encoding="encode").indices.to_numpy()
        cuts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True]).tolist() if len(codes) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if model is None or school[a].as_py() != name:
                if model is not None:
                    yield from model.batches(name)
                name, model = school[a].as_py(), TopicCounts()
            while a < b:  # a stretch of texts, one at least
                at = int(ends[a - 1]) if a else 0
                to = min(max(int(np.searchsorted(ends, at + MET_AT_ONCE)), a + 1), b)
                model.train(flat[at : ends[to - 1]], ends[a:to] - at)
                a = to
    if model is not None:
        yield from model.batches(name)


def train(reviews: DataFrame, order: tuple[str, ...] = ("entity_ordinal", "review_ordinal")) -> DataFrame:
    """(school, category, token, cnt): self-training in document order, exact; of texts that tie, the one of least hash is first.

    Each confident review changes the model that the next one meets, so the fold is serial within a school and parallel
    across schools; `train_batch` is the parallel alternative. Texts are split and hashed where they are. The fold gets
    8 bytes a token, sorted by Spark, batch by batch, and keeps one row of counts for each different token; the names of
    tokens are joined to its counts afterwards. Should two tokens of a school ever share a hash, the query fails.
    """
    words = tokens("comment")
    hashed = reviews.select("school", *order, F.xxhash64("comment").alias("_tie"), F.transform(words, lambda t: F.xxhash64(t)).alias("w"))
    by_school = hashed.repartition("school").sortWithinPartitions("school", *order, "_tie")
    counts = by_school.select("school", "w").mapInArrow(_folded, "school string, h long, counts array<long>")
    seeds = reviews.select("school").distinct().crossJoin(F.broadcast(seed_model(reviews.sparkSession).select("token").distinct()))  # 150 seed rows
    named = reviews.select("school", F.explode(words).alias("token")).unionByName(seeds).distinct()
    named = named.groupBy("school", F.xxhash64("token").alias("h")).agg(F.min("token").alias("token"), F.max("token").alias("other"))
    one = F.when(F.col("token") == F.col("other"), F.col("token")).otherwise(F.raise_error(F.lit("two tokens share a hash")))
    met = counts.join(named.select(F.col("school").alias("_school"), F.col("h").alias("_h"), one.alias("token")), F.col("school").eqNullSafe(F.col("_school")) & (F.col("h") == F.col("_h")))
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, CATEGORIES)).alias("category"), F.col("counts").alias("cnt")))
    return met.select("school", "token", each.alias("x")).select("school", "x.category", "token", "x.cnt").where("cnt > 0")


def train_batch(reviews: DataFrame) -> DataFrame:
    """(school, category, token, cnt): one pass that labels all reviews by the seeds, then counts. Not the serial fold."""
    top = F.array_max(F.transform(seed_scores("comment"), lambda x, i: F.struct(x["probability"].alias("p"), (-i).alias("i"), x["category"].alias("c"))))
    # exploding an array of one evaluates the scores once, where a filter on a plain column would repeat them
    labelled = reviews.select("school", tokens("comment").alias("w"), F.explode(F.array(top)).alias("t")).where(F.col("t.p") > CONFIDENT)
    new = labelled.select("school", F.col("t.c").alias("category"), F.explode("w").alias("token"))
    seeds = reviews.select("school").distinct().crossJoin(F.broadcast(seed_model(reviews.sparkSession)))  # 150 seed rows
    return new.withColumn("cnt", F.lit(1).cast("long")).unionByName(seeds).groupBy("school", "category", "token").agg(F.sum("cnt").alias("cnt"))


def ranked_members(scored: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """members() with `place`: a review's categories by probability, those that tie in seed order."""
    seeds = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    w = Window.partitionBy(*keys).orderBy(F.desc("probability"), seeds)
    return members(scored).withColumn("place", F.row_number().over(w).cast("long"))


def members(scored: DataFrame) -> DataFrame:
    """Rows whose rounded probability makes the review one of the category."""
    return scored.where(F.col("probability") >= MEMBER)


def category_sentiment(rated: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """rated(keys, category, clarity, helpful) -> keys, category, mean_sentiment, n_reviews, pct_positive.

    Ratings count if not null, so 0 counts; a review without any is left out.
    """
    s = rated.select(*keys, "category", mean_of_present(F.col("clarity"), F.col("helpful")).alias("s")).where("s IS NOT NULL")
    return s.groupBy(*keys, "category").agg(
        rnd(F.sum("s") / F.count("s"), 2).alias("mean_sentiment"), F.count("s").alias("n_reviews"), rnd(F.count_if(F.col("s") >= POSITIVE) / F.count("s") * 100, 1).alias("pct_positive")
    )


def member_columns(scored: Column) -> dict[str, Column]:
    """in_<category>: whether a review with these scores is one of the category."""
    return {f"in_{c}": F.element_at(scored, i + 1)["probability"] >= MEMBER for i, c in enumerate(CATEGORIES)}


def sentiment_by_flags(rated: DataFrame, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    """rated(keys, in_<category>.., clarity, helpful) -> what category_sentiment gives.

    A review is one row whatever its categories, and what is shuffled is a row for each key and task.
    """
    s = mean_of_present(F.col("clarity"), F.col("helpful"))
    sums = [f(F.when(F.col(f"in_{c}"), s)).alias(f"{n}_{c}") for c in CATEGORIES for n, f in (("n", F.count), ("t", F.sum))]
    sums += [F.count_if(F.col(f"in_{c}") & (s >= POSITIVE)).alias(f"p_{c}") for c in CATEGORIES]
    each = [F.struct(F.lit(c).alias("category"), rnd(F.col(f"t_{c}") / F.nullif(f"n_{c}", F.lit(0)), 2).alias("mean_sentiment"), F.col(f"n_{c}").alias("n_reviews"), rnd(F.col(f"p_{c}") / F.nullif(f"n_{c}", F.lit(0)) * 100, 1).alias("pct_positive")) for c in CATEGORIES]
    return rated.groupBy(*keys).agg(*sums).select(*keys, F.explode(F.array(*each)).alias("x")).select(*keys, "x.*").where("n_reviews > 0")
