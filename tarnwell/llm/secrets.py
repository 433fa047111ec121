"""Secret scans over a trigram inverted index.

The index is a table of posting lists, made in one pass over the texts: for each segment of documents and each trigram that
occurs there, the segment's documents that hold it. A document is its text's 64-bit hash, so the index does not depend on
partitions or ids, repeated texts cost one entry a segment, and any other rule set can use it again.

Each rule's regex yields a Boolean query over trigrams that every match must hold. The posting lists of the queries'
trigrams are read, intersected and united segment by segment, and the regex runs on the candidates that remain; a rule
without mandatory trigrams scans all texts. Two texts of equal hash share the union of their trigrams: no match is lost.
The index lower-cases A-Z, so that queries of rules in either case stay short.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_bytes, saved, starts, table, text_blocks

#: A segment of the index ends at so many bytes of text or documents.
SEGMENT_BYTES = 4 << 20
SEGMENT_DOCS = 1 << 14
#: Bytes whose trigrams a task sorts at once, which bounds its memory whatever a text's length.
SORTED_BYTES = 1 << 20
#: The row of a segment that holds its documents' hashes instead of postings.
DOCUMENTS = -1
#: Candidates (16 bytes each) that may be broadcast; more are joined by shuffling.
BROADCAST_ROWS = 500_000

#: Strings that a piece of a regex may stand for before they are turned into trigrams.
MOST_STRINGS = 64

Query = object  # True, a trigram as bytes, or ("and" | "or", frozenset of queries)


def _join(op: str, parts: list) -> Query:
    parts = set(parts)
    if op == "and":
        parts.discard(True)
        if not parts:
            return True
    elif True in parts:
        return True
    flat = set()
    for p in parts:
        flat |= p[1] if isinstance(p, tuple) and p[0] == op else {p}
    return next(iter(flat)) if len(flat) == 1 else (op, frozenset(flat))


def _trigrams(strings: set[str]) -> Query:
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in map(str.encode, strings)])


def _letters(node, arg) -> set[str] | None:
    """The lower-case characters that a one-character piece stands for, or None where they are many."""
    if node is C.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}
    if node is C.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                out.add(chr(x).lower() if x < 128 else chr(x))
            else:
                return None
        return out if len(out) <= 8 else None
    return None


def _walk(items) -> Query:
    """The query of a sequence: runs of pieces with few strings become trigrams, other pieces bring their own query."""
    found: list = []
    now: set[str] = {""}

    def flush() -> None:
        nonlocal now
        found.append(_trigrams(now))
        now = {""}

    def append(strings: set[str]) -> None:
        nonlocal now
        if len(now) * len(strings) > MOST_STRINGS:
            flush()
        now = {a + b for a in now for b in strings}

    for node, arg in items:
        if (one := _letters(node, arg)) is not None:
            append(one)
        elif node is C.SUBPATTERN:
            strings = _exact(arg[3])
            if strings is not None:
                append(strings)
            else:
                flush()
                found.append(_walk(arg[3]))
        elif node is C.BRANCH:
            options = [_exact(x) for x in arg[1]]
            if all(x is not None for x in options) and sum(map(len, options)) <= MOST_STRINGS:
                append(set().union(*options))
            else:
                flush()
                found.append(_join("or", [_walk(x) for x in arg[1]]))
        elif node in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] == 0 and arg[1] == 1 and (strings := _exact(arg[2])) is not None:
            append(strings | {""})
        elif node in (C.MAX_REPEAT, C.MIN_REPEAT):
            flush()
            if arg[0] > 0:
                found.append(_walk(arg[2]))
        elif node is not C.AT:
            flush()
    flush()
    return _join("and", found)


def _exact(items) -> set[str] | None:
    """All strings that a short sequence stands for, or None."""
    out = {""}
    for node, arg in items:
        if (one := _letters(node, arg)) is None and node is C.SUBPATTERN:
            one = _exact(arg[3])
        elif one is None and node is C.BRANCH:
            options = [_exact(x) for x in arg[1]]
            one = None if any(x is None for x in options) else set().union(*options)
        elif one is None and node in (C.MAX_REPEAT, C.MIN_REPEAT) and (arg[0], arg[1]) == (0, 1):
            one = None if (x := _exact(arg[2])) is None else x | {""}
        if one is None or len(out) * len(one) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in one}
    return out


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that each text with a match of the pattern satisfies, over lower-cased text."""
    return _walk(_parser.parse(pattern))


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] = lambda m: True
    base: bool = False
    #: A pattern that each text with a match worth keeping holds; spares scans of rules without mandatory trigrams.
    needs: str = ""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The patterns of the rules. The first three are the base kinds.
_KEY = "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")])
RULES = (
    Rule("assign", rf"({_KEY})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20, True),
    Rule("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24, True, "[0-9a-f]{24}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._-]{1,64}:[^\s/@:]{3,64}@"),
)


def trigram_number(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


def _postings(hashes: list[int], texts: list[bytes], segment: int) -> pa.RecordBatch:
    """The posting lists of a segment, each the gaps between its documents' numbers as 16-bit numbers, and its documents."""
    flat = np.frombuffer(b"\0".join([*texts, b"\0\0"]).lower(), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    keys = []
    for at in range(0, len(flat) - 2, SORTED_BYTES):
        x = flat[at : at + SORTED_BYTES + 2].astype(np.uint64)
        low, high = np.searchsorted(ends, [at, at + len(x) - 3], "right")
        bounds = np.clip(np.r_[at, ends[low:high], at + len(x) - 2] - at, 0, len(x) - 2)
        doc = np.repeat(np.minimum(np.arange(low, high + 1), len(texts) - 1).astype(np.uint64), np.diff(bounds))
        key = x[:-2] << 16
        key |= x[1:-1] << 8
        key |= x[2:]
        key <<= 16
        key |= doc
        keys.append(np.unique(key))
    keys = keys[0] if len(keys) == 1 else np.unique(np.concatenate(keys))
    trigrams, docs = (keys >> 16).astype(np.int32), (keys & 0xFFFF).astype(np.int32)
    begins = starts(trigrams)
    gaps = np.diff(docs, prepend=0)
    gaps[begins] = docs[begins]
    lists = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer((np.r_[begins, len(docs)] * 2).astype(np.int32)), pa.py_buffer(gaps.astype("<u2"))])
    own = pa.array([np.array(hashes, "<i8").tobytes()], pa.binary())
    columns = [pa.array(np.full(len(begins) + 1, segment)), pa.array(np.r_[DOCUMENTS, trigrams[begins]].astype(np.int32)), pa.concat_arrays([own, lists])]
    return pa.RecordBatch.from_arrays(columns, ["segment", "trigram", "docs"])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    segment, size = TaskContext.get().partitionId() << 36, 0
    held: dict[int, bytes] = {}
    for batch in text_blocks(batches, 1):
        for h, text in zip(batch.column(0).to_pylist(), ascii_bytes(batch.column(1)), strict=True):
            if held.get(h) == text:
                continue
            while h in held:  # another text of equal hash: a segment of its own keeps both
                yield _postings([*held], [*held.values()], segment)
                held, size, segment = {}, 0, segment + 1
            held[h] = text
            size += len(text)
            if size >= SEGMENT_BYTES or len(held) == SEGMENT_DOCS:
                yield _postings([*held], [*held.values()], segment)
                held, size, segment = {}, 0, segment + 1
    if held:
        yield _postings([*held], [*held.values()], segment)


def _hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def build_index(docs: DataFrame) -> DataFrame:
    """docs(text) -> the stored index (segment, trigram, docs): one pass, no shuffle. Null texts count as empty."""
    rows = docs.select(_hash().alias("h"), F.col("text").cast("string").alias("text"))
    return saved(rows.mapInArrow(_index, "segment long, trigram int, docs binary"), compression="zstd")


def _trigrams_of(query: Query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(_trigrams_of, query[1]))


def _holds(query: Query, postings: dict[int, np.ndarray], nothing: np.ndarray) -> np.ndarray:
    """Which documents of a segment satisfy the query."""
    if isinstance(query, bytes):
        return postings.get(trigram_number(query), nothing)
    parts = [_holds(part, postings, nothing) for part in query[1]]
    return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(h, rules long): the texts that may match, with a bit for each rule that has mandatory trigrams.

    Only posting lists of the rules' trigrams are read. A group is a segment: its documents and as many lists as the rules
    have trigrams, both bounded.
    """
    queries = [(k, q) for k, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not True]
    wanted = sorted({trigram_number(t) for _, q in queries for t in _trigrams_of(q)})

    def answer(t: pa.Table) -> pa.Table:
        lists = dict(zip(t.column("trigram").to_pylist(), t.column("docs").to_pylist(), strict=True))
        hashes = np.frombuffer(lists.pop(DOCUMENTS), "<i8")
        postings, nothing = {}, np.zeros(len(hashes), bool)
        for trigram, gaps in lists.items():
            postings[trigram] = nothing.copy()
            postings[trigram][np.cumsum(np.frombuffer(gaps, "<u2"), dtype=np.int64)] = True
        found = np.zeros(len(hashes), np.int64)
        for k, q in queries:
            found |= _holds(q, postings, nothing).astype(np.int64) << k
        some = found != 0
        return pa.table({"h": hashes[some], "rules": found[some]})

    lists = index.where(F.col("trigram").isin(DOCUMENTS, *wanted))
    return lists.groupBy("segment").applyInArrow(answer, "h long, rules long").groupBy("h").agg(F.bit_or("rules").alias("rules"))


def spans(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of every match that passes, in order."""
    return sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.pattern, text) if r.keep(m))


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, index: DataFrame | None = None, mark: str | None = None) -> DataFrame:
    """`keep`, spans array<struct<kind, start, end, base>> for every row, in code points, by start, then kind as listed.

    Kinds may overlap; of one kind, matches are leftmost and do not. Null texts count as empty; repeated rows and null ids
    are rows like any other; very long texts are indexed in stretches and scanned whole; an empty table gives an empty
    table. `index` is one that `build_index` made of the same texts, or of more; without it one is made. With a
    `mark` there is a column clean too: the text with each stretch of touching spans replaced by the mark; null stays null.
    At most 63 rules.
    """
    if len(rules) > 63:
        raise ValueError("at most 63 rules at once")
    met = saved(candidates(build_index(docs) if index is None else index, rules))
    patterns = [(k, r, re.compile(r.pattern), re.compile(r.needs.encode()), trigram_query(r.pattern) is True) for k, r in enumerate(rules)]
    kinds = "array<struct<kind:string,start:int,end:int,base:boolean>>"
    names = ["row", "spans", *(["clean"] if mark is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in text_blocks(batches, 1):
            rows, clean = [], []
            for text, bits in zip(ascii_bytes(batch.column(1)), batch.column(2).fill_null(0).to_pylist(), strict=True):
                todo = [(k, r, regex) for k, r, regex, needs, all_texts in patterns if (not r.needs or needs.search(text) if all_texts else bits >> k & 1)]
                written = text.decode() if todo else ""
                found = sorted((m.start(), k, m.end()) for k, r, regex in todo for m in regex.finditer(written) if r.keep(m))
                rows.append([{"kind": rules[k].kind, "start": a, "end": b, "base": rules[k].base} for a, k, b in found])
                clean.append(_redacted(written, found, mark) if found and mark is not None else text)
            columns = [batch.column(0), pa.array(rows, kind)]
            if mark is not None:
                texts = pa.array(clean, pa.binary()).cast(pa.string())
                columns.append(pc.if_else(batch.column(1).is_null(), pa.scalar(None, pa.string()), texts))
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("text"), _hash().alias("h"))
    rows = rows.join(F.broadcast(met) if met.count() <= BROADCAST_ROWS else met, "h", "left").select("row", "text", "rules")
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, spans {kinds}{', clean string' if mark is not None else ''}").select("row.*", *names[1:])


def _redacted(text: str, found: list[tuple[int, int, int]], mark: str) -> bytes:
    out, at = [], 0
    for a, _, b in found:
        if b > at:
            out += [] if a < at else [text[at:a], mark]
            at = b
    return "".join([*out, text[at:]]).encode()


def op10_secret_scan(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(F.filter("spans", lambda x: x["base"])).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
