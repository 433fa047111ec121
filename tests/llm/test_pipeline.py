"""The pipeline: each stage judged on its own input, and the run's rows against plain versions of its stages."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from pyspark.sql.functions import lit

import corpus_pipeline as cp
from tarnwell.llm import packing, secrets, simhash
from tests.llm.test_operators import fingerprint_brute, reach


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """(name, input rows, output rows) of each stage, written and read again."""
    out, at = [], f"{sf_dir}/documents.parquet"
    for k, (name, f) in enumerate(cp.STAGES):
        docs = spark.read.parquet(at)
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, docs, sf_dir).write.parquet(path)
        out.append((name, docs.collect(), spark.read.parquet(path).collect(), docs.columns, spark.read.parquet(path).columns))
        at = path
    return out


def test_stages_in_order(stages):
    assert [s[0] for s in stages] == ["language_id", "simhash_near_dedup", "secret_scan", "mix_sources", "pack"]
    assert all(s[3] == s[4] == ["doc_id", "text", "lang", "source", "n_chars"] for s in stages[:-1])


def test_language_keeps_documents_with_letters(stages):
    _, before, after, *_ = stages[0]
    kept = {r["doc_id"] for r in after}
    assert {r["doc_id"] for r in before if not re.search(r"[^\W\d_]", r["text"] or "")}.isdisjoint(kept)
    assert len(kept) >= 0.95 * len(before) and {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_near_duplicates_keep_one_of_each_group(stages):
    _, before, after, *_ = stages[1]
    fps = [fingerprint_brute(r["text"]) for r in before]
    links = {i: {j for j in range(len(fps)) if j != i and (fps[i] ^ fps[j]).bit_count() <= 3} for i in range(len(fps))}
    want = {min(before[k]["doc_id"] for k in g) for g in reach(links).values()}
    assert sorted(r["doc_id"] for r in after) == sorted(want)


def test_secrets_are_marked_and_nothing_else_changes(stages):
    _, before, after, *_ = stages[2]
    texts = {r["doc_id"]: r["text"] for r in after}
    assert len(after) == len(before)
    for r in before:
        found, out, at = secrets.spans(r["text"] or ""), "", 0
        for a, _, b in found:
            if b > at:
                out += ("" if a < at else r["text"][at:a] + "[SECRET]")
                at = b
        assert texts[r["doc_id"]] == out + r["text"][at:]


def test_mixture_takes_whole_documents_near_targets(stages):
    _, before, after, *_ = stages[3]
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in before}
    copies, taken, whole, largest = {}, {}, {}, {}
    for r in after:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
        taken[r["source"]] = taken.get(r["source"], 0) + size[r["doc_id"]]
    for r in before:
        whole[r["source"]] = whole.get(r["source"], 0) + size[r["doc_id"]]
        largest[r["source"]] = max(largest.get(r["source"], 0), size[r["doc_id"]])
    assert max(copies.values()) <= 3
    weight = {s: 1 + k % 3 for k, s in enumerate(sorted(whole))}
    target, left, free = {}, sum(whole.values()), set(whole)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 3 * whole[s] <= weight[s] * level}
        for s in full or free:
            target[s] = 3 * whole[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    assert all(abs(taken.get(s, 0) - target[s]) <= largest[s] for s in whole)


def test_pack_holds_every_copy(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    _, before, after, *_ = stages[4]
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = {r["doc_id"]: np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, packing.END], "<u4") for r in before}
    assert sum(r["length"] for r in after) == sum(len(ids[r["doc_id"]]) for r in before)
    assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in after)


def test_run_is_the_stages_in_a_row(spark, sf_dir, stages):
    assert sorted(map(tuple, cp.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())) == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in stages[-1][2])
    assert cp.ORACLE_SQL is None


def test_empty_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, f in cp.STAGES:
        assert f(spark, docs, sf_dir).count() == 0


def test_odd_rows_pass_every_stage(spark, sf_dir):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "some words that are here", "en", "a", 9), (1, "some words that are here", "en", "a", 9), (2, "x" * 20_000, None, "a", None)], "doc_id long, text string, lang string, source string, n_chars long")
    clash = {c: lit(0) for c in ("row", "key", "h", "id", "score", "lang_pred", "spans", "clean", "size", "copies", "position", "taken", "bucket", "doc", "n", "part", "rest")}
    for docs in (docs, docs.withColumns(clash)):
        kept = [f(spark, docs, sf_dir) for _, f in cp.STAGES]
        assert all(x.columns == docs.columns for x in kept[:-1])
        told, one, clean, mixed, pieces = (x.collect() for x in kept)
        assert {r["doc_id"] for r in told} <= {1, 2}  # a null and an empty text have no language
        assert len(one) == 3  # the wordless group, the repeated row, the long text
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in clean) == sorted((r["doc_id"] or 0, r["text"] or "") for r in docs.collect())
        assert {(r["doc_id"], r["text"]) for r in mixed} <= {(r["doc_id"], r["text"]) for r in docs.collect()}
        assert len({(r["doc_id"], r["start"], r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces) >= docs.count()


def test_the_choice_among_repeated_rows_is_stable(spark, sf_dir):
    rows = [(1, "some words that are here", lang, source, n) for lang, source, n in (("fr", "b", 9), ("en", "a", 9), ("en", None, 3))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    kept = {tuple(cp.near_duplicates(spark, spark.createDataFrame(order, schema).repartition(n), sf_dir).first()) for order in (rows, rows[::-1]) for n in (1, 3)}
    assert len(kept) == 1


def test_copies_come_in_the_order_of_their_times(stages):
    _, before, after, *_ = stages[3]
    # a document's copies are epochs apart: other documents of its source stand between them
    places = {}
    for k, r in enumerate(after):
        places.setdefault(r["doc_id"], []).append(k)
    apart = [b - a for p in places.values() if len(p) > 1 for a, b in zip(p, p[1:], strict=False)]
    assert not apart or np.mean(apart) > 0.1 * len(after)


def test_repeated_ids_of_different_groups_both_stay(spark, sf_dir):
    docs = spark.createDataFrame([(5, "one text about this", "en", "a", 1), (5, "quite another thing here", "en", "a", 1), (3, "quite another thing here", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, docs, sf_dir).collect()) == [3, 5]


def test_fingerprints_of_the_stage_are_those_of_the_operator():
    assert simhash.fingerprint(b"A b c d") == fingerprint_brute("a B c d")
