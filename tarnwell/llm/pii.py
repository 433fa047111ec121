"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss.

Valid base entities are the seeds. Every mention of something that looks like an identifier has lexical patterns: the
words around it (one or two on the left, one with a gap, one on the right, one on either side) and its own spelling.
Patterns and instances form a graph with an edge wherever an instance has a mention with the pattern. A pattern's score is
the share of trusted instances among all that it meets, an instance's is the chance that not all of its patterns are wrong.
Both are taken in turn until they settle; they only ever rise, so they do. Mentions whose instance is accepted are added:
identifiers of wider shapes in the words around seeds, and identifiers of the seeds' own spelling that the base patterns
fused with a neighbour and so rejected.

DataFrame functions only. The text is read once; the graph holds only identifiers' hashes and patterns.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, saved, table, words

KINDS = ("email", "ip", "card", "phone")
#: Different accepted instances of one kind that a pattern must be seen with, the share that they must have beside those of
#: other kinds and of none, and the score from which an instance is accepted.
SUPPORT = 8
PURITY = 0.9
ACCEPT = 0.8
#: Scores that move by less have settled.
SETTLED = 1e-3
#: Longer context words stand in the graph by their hash.
WORD_LENGTH = 64

_LOCAL = r"[A-Za-z0-9._%+-]"
#: The base patterns. Possessive where nothing can follow; a match may begin inside a run of its first class
#: only where the last match ended, for from there on the run fails like from its start. So long runs cost linear time.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters that a text with a match holds.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}

_AT, _DOT = r"\x20?[(\[]\x20?(?i:at)\x20?[)\]]\x20?", r"\x20?[(\[]\x20?(?i:dot)\x20?[)\]]\x20?"
#: Wider shapes, each bounded in length, that a mention may have; the last is any word with a digit, which is of no kind.
SHAPES = (
    rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:@|{_AT})[A-Za-z0-9-]{{1,63}}+(?:(?:\.|{_DOT})[A-Za-z0-9-]{{1,63}}+){{0,8}}",
    r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?!\.?[0-9])",
    r"(?<![A-Za-z0-9:])[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{0,4}){3,7}(?![A-Za-z0-9:])",
    r"\+[0-9]{1,3}(?:[\x20.-]?\([0-9]{1,4}\))?(?:[\x20.-]?[0-9]{2,4}){1,4}(?!\.?[0-9])",
    r"(?<![A-Za-z0-9])[0-9]{4}(?:[\x20.-][0-9]{4}){3}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[0-9]{13,19}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9.-])0[0-9]{1,4}(?:[\x20/.-][0-9]{2,5}){1,4}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9_])[A-Za-z_]*+[0-9][A-Za-z0-9_]*+",
)
MENTION = "|".join(SHAPES)
_MENTION_HINT = r"[0-9@]|(?i:[(\[]\x20?at\x20?[)\]])"
#: The last two words of a reversed text; the first word of a text.
_BACK = r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]*+[\x20\x09-\x0D]*+[^\x20\x09-\x0D]*+"
_NEXT = r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]*+)"
_SPAN = "array<struct<kind:int,start:int,end:int>>"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(a: Column) -> Column:
    """Running sums of an array of int: each round adds the sums that end 1, 2, 4, ... places before, so n log n in all."""
    rounds = F.sequence(F.lit(0), F.length(F.bin(F.size(a).cast("long"))))
    add = lambda s, k: F.transform(s, lambda x, i: x + F.coalesce(F.get(s, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0)))
    return F.aggregate(rounds, a, add)


def _placed(text: Column, pattern: str, hint: str) -> Column:
    """Matches as array<struct<start, value, before, after>>, with the text up to the neighbouring matches on either side."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.split(text, pattern, -1)
    none = F.array().cast("array<struct<start:int,value:string,before:string,after:string>>")

    def matches(found: Column) -> Column:
        def place(between: Column) -> Column:
            lengths = F.transform(found, lambda v, i: F.coalesce(F.length(F.get(between, i)) + F.length(v), F.lit(0)))
            ends = lambda e: F.transform(found, lambda v, i: F.struct((F.get(e, i) - F.length(v)).cast("int").alias("start"), v.alias("value"), F.get(between, i).alias("before"), F.get(between, i + 1).alias("after")))
            return _let(_running(lengths), ends)

        return F.when(F.size(found) > 0, _let(between, place)).otherwise(none)

    return F.when(text.rlike(hint), _let(found, matches)).otherwise(none)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: _let(F.substring(digits, i, F.lit(1)).cast("int"), lambda d: s + F.when((n - i) % 2 == 1, twice(d)).otherwise(d)))
    return total % 10 == 0


def _octets(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: _let(F.regexp_replace(p, "^0+", ""), lambda z: (F.length(z) < 3) | (F.length(z) == 3) & (z <= "255")))


def _valid(kind: str, v: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(v)
    n = F.length(_digits(v))
    if kind == "card":
        return n.between(16, 19) & luhn(_digits(v))
    return n.between(8, 15)


def _kind(v: Column) -> Column:
    """The kind that a mention's shape allows, -1 if none."""
    n = F.length(_digits(v))
    number = v.rlike(r"^[0-9 .-]+$")
    dotted = v.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    return (
        F.when(v.rlike(r"[@(\[]") & v.rlike(r"(?i)@|[(\[]\x20?at\x20?[)\]]"), 0)
        .when(dotted, F.when(_octets(v), 1).otherwise(-1))
        .when(v.rlike(r"^[0-9a-fA-F]{1,4}(:[0-9a-fA-F]{0,4}){3,7}$"), 1)
        .when(number & n.between(13, 19) & luhn(_digits(v)), 2)
        .when(number & (n > 12), -1)
        .when(n.between(7, 15) & v.rlike(r"^[+(0-9][0-9 ()/.-]+$") & v.rlike(r"[ ()/.+-]"), 3)
        .otherwise(-1)
    )


def _spelling(kind: Column, v: Column) -> Column:
    """Digits as 9 and letters as a; runs of them as one where a kind leaves their length open."""
    plain = F.regexp_replace(F.regexp_replace(v, "[0-9]", "9"), r"\p{L}", "a")
    return F.when(kind >= 2, plain).otherwise(F.regexp_replace(F.regexp_replace(plain, "9+", "9"), "[a9]*a[a9]*", "a"))


def _context(w: Column) -> Column:
    w = F.lower(w)
    return F.when(F.length(w) > WORD_LENGTH, F.concat(F.lit("~"), F.md5(w.cast("binary")))).otherwise(w)


def extracted(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row struct, id, base (kind, start, end) and mentions (kind, start, end, value hash, form, words around) of every text.

    Null texts count as empty. Words around a mention reach no further than its neighbours, which stand as "<>".
    """
    text = F.col("text")
    rows = docs.select(F.struct(*keep).alias("row"), F.monotonically_increasing_id().alias("id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    rows = rows.select("row", "id", *(_placed(text, PATTERNS[k], HINTS[k]).alias(k) for k in KINDS), _placed(text, MENTION, _MENTION_HINT).alias("mention"))
    end = lambda x: (x["start"] + F.length(x["value"])).cast("int").alias("end")
    base = F.concat(*(F.transform(F.filter(k, lambda x: partial(_valid, k)(x["value"])), lambda x: F.struct(F.lit(i).alias("kind"), x["start"].alias("start"), end(x))) for i, k in enumerate(KINDS)))  # noqa: B023

    def mention(x: Column) -> Column:
        back = words(F.reverse(F.regexp_extract(F.reverse(x["before"]), _BACK, 0)))
        near = F.regexp_extract(x["after"], _NEXT, 1)

        def whole(kind: Column, left: Column) -> Column:
            one = F.coalesce(F.get(left, F.size(left) - 1), F.lit("<>"))
            two = F.when(F.size(left) > 1, F.get(left, F.size(left) - 2)).when(F.size(left) == 1, F.lit("<>")).otherwise(F.lit(""))
            return F.struct(
                kind.alias("kind"), x["start"].alias("start"), end(x), F.xxhash64(x["value"]).alias("value"), F.when(kind >= 0, _spelling(kind, x["value"])).alias("form"),
                _context(one).alias("l1"), _context(two).alias("l2"), _context(F.when(near == "", F.lit("<>")).otherwise(near)).alias("r1"),
            )

        return _let(F.struct(_kind(x["value"]).alias("kind"), F.transform(back, lambda w: w).alias("left")), lambda y: whole(y["kind"], y["left"]))

    return rows.select("row", "id", base.cast(_SPAN).alias("base"), F.transform("mention", mention).alias("mentions"))


def mentions(found: DataFrame) -> DataFrame:
    """id, kind, start, end, value, form, l1, l2, r1, seed: mentions that are base spans, and those that touch none.

    A text's spans are sorted by start once in either direction; no pair of them is compared.
    """
    around = ("value", "form", "l1", "l2", "r1")
    m = found.select("id", F.explode("mentions").alias("x")).select("id", "x.*", F.lit(False).alias("base"))
    b = found.select("id", F.explode("base").alias("x")).select("id", "x.*", F.lit(True).alias("base"))
    spans = m.unionByName(b, allowMissingColumns=True).repartition("id")
    one = spans.groupBy("id", "kind", "start", "end").agg(F.max("base").alias("base"), *(F.max(c).alias(c) for c in around))
    before = Window.partitionBy("id").orderBy("start", F.desc("base"), "end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("id").orderBy(F.desc("start"), F.desc("base"), "end").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("left_end", F.max(F.when(F.col("base"), F.col("end"))).over(before)).withColumn("right_start", F.min(F.when(F.col("base"), F.col("start"))).over(after))
    free = (F.coalesce("left_end", F.lit(-1)) <= F.col("start")) & (F.coalesce("right_start", F.lit(1 << 30)) >= F.col("end"))
    return one.where(F.col("value").isNotNull() & (F.col("base") | free)).select("id", "kind", "start", "end", *around, F.col("base").alias("seed"))


def patterns_of() -> Column:
    """The patterns of a mention, each as one string that begins with its sort; a place without a word is no pattern."""
    l1, l2, r1 = F.col("l1"), F.col("l2"), F.col("r1")
    said = lambda *c: reduce(Column.__or__, (x.rlike("[^<>]") for x in c))
    words_around = [
        F.when(said(l1, l2), F.concat_ws(" ", F.lit("two left:"), l2, l1)), F.when(said(l1), F.concat_ws(" ", F.lit("left:"), l1)),
        F.when(said(l2), F.concat_ws(" ", F.lit("left, gap:"), l2, F.lit("*"))), F.when(said(r1), F.concat_ws(" ", F.lit("right:"), r1)),
        F.when(said(l1, r1), F.concat_ws(" ", F.lit("both:"), l1, F.lit("_"), r1)),
    ]
    return F.array_compact(F.array(*words_around, F.when(F.col("form").isNotNull(), F.concat(F.lit("spelling: "), F.col("kind").cast("string"), F.lit(" "), F.col("form")))))


def trusted(met: DataFrame, support: int = SUPPORT, purity: float = PURITY, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """mentions -> (patterns(pattern, kind, score), instances(kind, value, score)), scored in turn until the scores settle.

    `rounds` ends the scoring earlier. Instances are those that are no seeds. Only patterns that could reach `support` and
    `purity` if all their candidates were trusted enter the rounds; the others never can. A pattern seen with very many
    instances is met by joins on its key with partial sums, never gathered.
    """
    edges = met.select(F.explode(patterns_of()).alias("pattern"), "kind", "value", "seed").groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed"))
    edges = saved(edges)
    kinds = edges.groupBy("pattern", "kind").agg(F.count_if("seed").alias("seeds"), F.count(F.lit(1)).alias("most"))
    all_of = kinds.groupBy("pattern").agg(F.sum("most").alias("all"))
    able = kinds.where((F.col("kind") >= 0) & (F.col("most") >= support)).join(all_of, "pattern").where(F.col("most") >= purity * F.col("all")).select("pattern", "kind", "seeds", (F.col("all") - F.col("most")).alias("against"))
    able = cut(able)
    # A spelling is learned from seeds alone: wider spellings that some context vouched for vouch for nothing by themselves.
    open_edges = cut(edges.where(~F.col("seed") & (F.col("kind") >= 0)).join(able.select("pattern", "kind"), ["pattern", "kind"], "left_semi").select("pattern", "kind", "value"))
    learning = open_edges.where(~F.col("pattern").startswith("spelling:"))
    instances, patterns, before, turn = able.sparkSession.createDataFrame([], "kind int, value long, score double"), None, None, 0
    while rounds is None or turn < max(rounds, 1):
        gained = learning.join(instances, ["kind", "value"]).groupBy("pattern", "kind").agg(F.sum("score").alias("gained"), F.count_if(F.col("score") >= ACCEPT).alias("accepted"))
        told = able.join(gained, ["pattern", "kind"], "left").withColumn("weight", F.col("seeds") + F.coalesce("gained", F.lit(0.0)))
        enough = (F.col("seeds") + F.coalesce("accepted", F.lit(0)) >= support) & (F.col("weight") >= purity * (F.col("weight") + F.col("against")))
        patterns = cut(told.where(enough).select("pattern", "kind", (F.col("weight") / (F.col("weight") + F.col("against") + 1.0)).alias("score")))
        wrong = F.exp(F.sum(F.ln(1.0 - F.least(F.col("score"), F.lit(1.0 - 1e-12)))))
        instances = cut(open_edges.join(patterns, ["pattern", "kind"]).groupBy("kind", "value").agg((1.0 - wrong).alias("score")))
        now = (patterns.agg(F.count(F.lit(1)), F.coalesce(F.sum("score"), F.lit(0.0))).first(), instances.agg(F.count(F.lit(1)), F.coalesce(F.sum("score"), F.lit(0.0)), F.count_if(F.col("score") >= ACCEPT)).first())
        turn += 1
        if before is not None and now[0][0] == before[0][0] and now[1][::2] == before[1][::2] and abs(now[1][1] - before[1][1]) <= SETTLED * max(1.0, now[1][1]) or not now[1][0]:
            break
        before = now
    return patterns, instances


def personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), support: int = SUPPORT, purity: float = PURITY, rounds: int | None = None) -> DataFrame:
    """`keep`, base and spans: arrays of (kind place, start, end) by kind, then start; code points, end exclusive.

    One row per row, null texts and texts without finds with empty arrays; an empty table gives an empty table. Equal
    texts get equal spans, repeated rows and null ids are rows like any other (a value counts once, however often it is
    repeated), very long texts are read whole. An added span never touches a base span or another added one.
    """
    found = saved(extracted(docs, keep))
    met = saved(mentions(found))
    _, instances = trusted(met, support, purity, rounds)
    new = met.where(~F.col("seed") & (F.col("kind") >= 0)).join(instances.where(F.col("score") >= ACCEPT).select("kind", "value"), ["kind", "value"], "left_semi")
    added = new.groupBy("id").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    both = found.select("id", "row", "base").join(added, "id", "left")
    return both.select("row.*", "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPAN)))).alias("spans"))


def op8_personal_data(spark, sf_dir):
    found = personal_data(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, KINDS))
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda i: lambda x: x["kind"] == i
    count = [F.size(F.filter("base", of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(line("base").cast("binary"), 256).alias("base_sha256"), line("spans").alias("spans"))
