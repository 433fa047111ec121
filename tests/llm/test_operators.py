"""Every operator against a plain version of its contract, on hand-made rows and the small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnwell.llm import common, embeddings, graph, langid, lm, mixing, packing, pii, rules, secrets, simhash, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \t\n", "one", "two words", "a b c a b c a b c", "x " * 60, "\x00 nul", "é è ü", "<|endoftext|> end", "tab\tand\x0bvertical\x0cfeed", " no break", "ß" * 70, "1.2.3.4 a@b.cd", "A" * 5000]


def docs(spark, texts, ids=None, sources=None, langs=None):
    rows = [(i if ids is None else ids[i], t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], None if t is None else len(t)) for i, t in enumerate(texts)]
    # an extra column, and one that clashes with names inside the operators
    return spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("clash")).withColumn("route", F.lit(1)).withColumn("id", F.lit(5)).withColumn("row", F.lit(0))


def sample(spark, sf_dir, n=None):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    return rows[:n] if n else rows


# op1


def pairs_brute(rows, threshold=0.98):
    unit = {}
    for k, (_, label, v) in enumerate(rows):
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit[k] = None if not ok else np.array(v, float) / np.linalg.norm(np.array(v, float))
    links = {k: set() for k in unit}
    for a in unit:
        for b in unit:
            if a < b and unit[a] is not None and unit[b] is not None and rows[a][1] == rows[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a].add(b)
                links[b].add(a)
    return links


def reach(links):
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for x in links[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        out[k] = seen
    return out


def test_embeddings_match_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    rng = np.random.default_rng(1)
    rows = []
    for c in range(6):
        base = rng.standard_normal(32)
        rows += [(len(rows) + i, c % 2, (base + rng.standard_normal(32) * 0.06 * (i % 7)).tolist()) for i in range(20)]
    rows += [(500, 0, rows[0][2]), (501, 0, [2 * x for x in rows[0][2]]), (502, None, rows[0][2]), (503, 0, None), (504, 0, []), (505, 0, [0.0] * 32), (506, 0, [math.nan] * 32), (507, 0, [None] * 32), (508, 0, [1.0, 2.0]), (509, 0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("cid", F.lit(3))
    links = pairs_brute(rows)
    groups = reach(links)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    for k, (i, _, _) in enumerate(rows):
        least = min(rows[x][0] for x in groups[k])
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links[k]), least, least == i)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_every_link_of_the_embeddings_table_is_found(spark, sf_dir):
    """The whole table and a neighbour of each vector at a cosine of 0.97 to 0.99, against all pairs."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    own = [(r["vec_id"], r["label"], r["embedding"]) for r in df.select("vec_id", "label", "embedding").collect()]
    rng = np.random.default_rng(5)
    x = np.array([v for _, _, v in own], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = rng.uniform(0.97, 0.99, len(x))[:, None]
    moved = cosine * x + np.sqrt(1 - cosine**2) * side
    rows = [(i, str(label), v) for (i, label, _), v in zip(own, x.tolist(), strict=True)] + [(i + 10**6, str(label), v) for (i, label, _), v in zip(own, moved.tolist(), strict=True)]
    both = np.concatenate([x, moved])
    label = np.array([x for _, x, _ in rows])
    near = (both @ both.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(rows), dtype=bool)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    assert near.sum() > len(own) / 2 and [got[i] for i, _, _ in rows] == near.sum(axis=1).tolist()


def test_embedding_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    u = rng.standard_normal((400, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    q, turn = u[:200], embeddings.rotations(64, 1)
    o = q * 0.9 + u[200:] * 0.3
    o /= np.linalg.norm(o, axis=1)[:, None]
    t = o @ turn
    f = np.abs(t).sum(axis=1) / 8
    estimate = (np.where(t > 0, 1, -1) / 8 * (q @ turn)).sum(axis=1) / f
    error = estimate - (o * q).sum(axis=1)
    assert abs(error.mean()) < 0.02
    assert (np.abs(error) <= embeddings.ERRORS * np.sqrt((1 - f**2) / f**2 / 63)).all()


# components


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    links = {k: set() for e in edges for k in e}
    for a, b in edges:
        links[a].add(b)
        links[b].add(a)
    want = {k: min(g) for k, g in reach(links).items() if links[k] - {k}}
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_pair_close_to_the_threshold_is_missed(spark):
    agree = 1 - math.acos(embeddings.THRESHOLD) / math.pi
    for rows in (2, 1000, 10**6, 10**9):
        bits, bands = embeddings.layout(rows)
        assert (1 - agree**bits) ** bands <= 1e-9
    rng, n = np.random.default_rng(3), 3000
    a, b = rng.standard_normal((2, n, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.98001 * a + math.sqrt(1 - 0.98001**2) * b
    rows = [(i, "x", v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()
    assert [r["vec_id"] for r in got if r["n_links"] < 1] == []


# op2


def test_lm_base_scores(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in sample(spark, sf_dir)] + [(10_000 + i, t) for i, t in enumerate(ODD)]
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    toks = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    counts = Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in lm.lm_scores(df).collect()}
    assert len(got) == len(rows)
    for i, ws in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    nothing = docs(spark, ["a b", None], [next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)] * 2)
    assert [r["base_score"] for r in lm.lm_scores(nothing).orderBy("n_tokens").collect()] == [0.0, 0.0]
    assert lm.lm_scores(df.limit(0)).count() == 0


def small_vocabulary():
    words = [f"w{chr(97 + i % 7)}{chr(97 + i % 5)}".encode() + b"x" * (i // 35) for i in range(300)]
    counts = np.arange(600, 300, -1.0)
    endings = {}
    for w, n in [*zip(words, counts, strict=True), (b"rare", 3), (b"seldom", 2)]:
        t, k = endings.get(w[-2:], (0, 0))
        endings[w[-2:]] = (t + int(n), k + 1)
    return lm.Vocabulary(words, counts, 40, int(counts.sum()) + 5 + 40, 303, endings)


def test_lm_probabilities_are_normalised():
    v = small_vocabulary()
    assert v.units == 256 + v.classes + 1 and v.classes == 16 and sorted(set(v.unit[:256].tolist()) | set(v.others.tolist()) | {v.units - 1}) == list(range(v.units))
    model = lm.Model.first(v)
    for first in (3, 0, v.units, 9):
        near = np.array([[first], [0], [v.units], [9]]).repeat(v.units, axis=1)
        assert (10 ** model.log10(near, np.arange(v.units), v.begin)).sum() == pytest.approx(1, abs=1e-4)
    # a class's other words share its last unit, with one place for unseen words
    for k in range(v.classes):
        others = [i for i in range(256, 300) if v.word_class(v.words[i]) == k]
        rare = [n for w, n in ((b"rare", 3), (b"seldom", 2)) if v.word_class(w) == k]
        assert sum(10 ** v.inside[i] for i in others) + sum((n + 1) * 10 ** -v.log_others[k] for n in rare) + 10 ** -v.log_others[k] == pytest.approx(1)


def test_lm_scores_are_those_of_the_model_word_by_word(spark, sf_dir):
    """The whole score of every text, from the trained parameters by plain loops over single tokens."""
    df = docs(spark, [r["text"] for r in sample(spark, sf_dir, 40)] + ["new wörds only here", "", None, "the of the of " * 300])
    use = df.select("doc_id", "text", (F.col("doc_id") % 3 == 0).alias("held_out"), (F.col("doc_id") % 2).alias("round"))
    counts = common.saved(lm.count_words(use.where("NOT held_out")))
    v = lm.vocabulary(counts)
    texts = lm.encoded(use, v)
    model = lm.train(texts.where("NOT held_out"), v)
    all_counts = {bytes(r["word"]): r["n"] for r in counts.where("word IS NOT NULL").collect()}
    got = {r["doc_id"]: r["score"] for r in lm.score(texts, counts, v, model).collect()}
    heads = {w: int(v.unit[i]) for i, w in enumerate(v.words) if v.unit[i] not in v.others}

    def unit(w):
        return heads.get(w, int(v.others[v.word_class(w)]))

    def log_softmax(x, i):
        return float(x[i] - x.max() - np.log(np.exp(x - x.max()).sum()))

    for r in df.collect():
        words = (r["text"] or "").encode().lower().split()
        seen, total = [v.units] * lm.CONTEXT, 0.0
        for w in [*words, None]:
            q = sum(model.place[i].astype(float) * model.context[seen[-1 - i]] for i in range(lm.CONTEXT))
            u = v.units - 1 if w is None else unit(w)
            k = int(np.searchsorted(v.begin, u, "right")) - 1
            total += log_softmax(model.classes @ q + model.class_bias, k) / math.log(10)
            low, high = v.begin[k], v.begin[k + 1]
            total += log_softmax(model.target[low:high] @ q + model.bias[low:high], u - low) / math.log(10)
            if w is not None and u in v.others:
                total += math.log10(all_counts.get(w, 0) + 1) - v.log_others[v.word_class(w)]
            seen.append(u)
        assert got[r["doc_id"]] == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_each_training_step_draws_32_noise_classes_for_at_most_2048_tokens(monkeypatch):
    v = small_vocabulary()
    trainer = lm.Trainer(lm.Model.first(v), v, 1)
    steps, step = [], trainer.step
    drawn, search = [], np.searchsorted
    monkeypatch.setattr(trainer, "step", lambda near, units: (steps.append(len(units)), step(near, units)))
    monkeypatch.setattr(np, "searchsorted", lambda a, x, *side: (drawn.append(np.shape(x)), search(a, x, *side))[1])
    assert lm._steps(trainer, [np.arange(8192, dtype=np.int32) % v.units], v.units) == 8192
    assert steps == [2048] * 4
    assert drawn == [(32,), (v.classes + 1, lm.NOISE_INSIDE)] * 4


def test_lm_blocks_hold_every_word_of_every_text(monkeypatch):
    """Texts cut into many blocks, themselves cut from a longer batch, are counted and turned into units like plain lists."""
    v = small_vocabulary()
    rng = np.random.default_rng(3)
    some = [*(w.decode().upper() for w in v.words), "new", "wörds", "é", "\u3000", "x"]
    texts = [rng.choice([" ", "\t", "\n  "]).join(["", *rng.choice(some, rng.integers(0, 40))][rng.integers(0, 2) :]) for _ in range(300)]
    texts[7], texts[150], texts[151] = None, "", " \n "
    monkeypatch.setattr(lm, "TEXT", 500)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]).slice(5, 290)
    want = [(t or "").encode().lower().split() for t in texts[5:295]]
    counts = Counter()
    for b in lm._count(iter([batch.slice(0, 100), batch.slice(100)])):
        counts.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
    assert counts == Counter(w for ws in want for w in ws) + Counter({None: 290})
    place = {w: i for i, w in enumerate(v.words)}
    blocks = list(lm._blocks(batch, 0))
    assert len(blocks) > 20
    told = [r for b in blocks for r in zip(*(c.to_pylist() for c in lm._encode(v, pa.array(v.words).view(pa.string()), b.column(0)).values()), strict=True)]
    assert len(told) == 290
    for ws, (n_tokens, n_known, base, inside, units, loose, times) in zip(want, told, strict=True):
        known = [place[w] for w in ws if w in place]
        others = [w for w in ws if w not in place]
        assert (n_tokens, n_known) == (len(ws) + 1, len(known) + 1)
        assert np.frombuffer(units, "<u2").tolist() == [int(v.unit[place[w]] if w in place else v.others[v.word_class(w)]) for w in ws] + [v.units - 1]
        assert dict(zip(loose, times, strict=True)) == Counter(others)
        assert base == pytest.approx(sum(v.log_count[i] for i in known) + math.log10(v.docs + 1) - n_tokens * math.log10(v.tokens + v.types + 1))
        assert inside == pytest.approx(sum(v.inside[i] for i in known) - sum(v.log_others[v.word_class(w)] for w in others))


def test_sums_of_runs_are_those_of_single_rows():
    x = np.random.default_rng(5).integers(-50, 50, (60, 6)).astype(np.float32)
    for heads in ([0], [0, 1, 2, 4, 7, 8, 10, 30, 59], list(range(60)), list(range(0, 60, 2))):
        got = lm._runs(x, np.array(heads))
        assert got.tolist() == [x[a:z].sum(axis=0).tolist() for a, z in zip(heads, [*heads[1:], 60], strict=True)]


def test_blocks_of_scores_share_one_array(monkeypatch):
    """Arrays of a block's size are not made anew for each block; large scores, which exp() overflows at, come out too."""
    v, model, met, times = small_vocabulary(), lm.Model.first(small_vocabulary()), set(), lm._times
    monkeypatch.setattr(lm, "SCORED", 64)
    monkeypatch.setattr(lm, "_times", lambda x, y, out: (met.add(out.__array_interface__["data"][0]), times(x, y, out))[1])
    rng = np.random.default_rng(1)
    near, units = rng.integers(0, v.units, (lm.CONTEXT, 500)), rng.integers(0, v.units, 500)
    for scale in (1, 300):
        model.context *= scale
        met.clear()
        got = model.log10(near, units, v.begin)
        assert len(met) == 1
        q = sum(model.place[i].astype(float) * model.context[near[i]] for i in range(lm.CONTEXT))
        for j, u in enumerate(units.tolist()):
            k = int(np.searchsorted(v.begin, u, "right")) - 1
            low, high = v.begin[k], v.begin[k + 1]
            parts = ((model.classes @ q[j] + model.class_bias, k), (model.target[low:high] @ q[j] + model.bias[low:high], u - low))
            assert got[j] == pytest.approx(sum(x[i] - x.max() - np.log(np.exp(x - x.max()).sum()) for x, i in parts) / math.log(10), rel=1e-4, abs=1e-3)


def test_units_grow_with_the_vocabulary():
    units = []
    for n in (100, 10_000, 60_000):
        words = [f"{i}".encode() for i in range(n)]
        endings = {}
        for w in words:
            t, k = endings.get(w[-2:], (0, 0))
            endings[w[-2:]] = (t + 1, k + 1)
        units.append(lm.Vocabulary(words, np.ones(n), 1, n + 1, n + 1, endings).units)
    assert units[0] < units[1] < units[2]


# op3


def fingerprint_brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_matches_brute_force(spark, sf_dir):
    texts = [r["text"] for r in sample(spark, sf_dir, 80)] + ODD
    texts += [t + " tail" for t in texts[:20] if t]
    want = [fingerprint_brute(t) for t in texts]
    links = {i: {j for j in range(len(texts)) if j != i and (want[i] ^ want[j]).bit_count() <= 3} for i in range(len(texts))}
    groups = reach(links)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert {i: (r["fp"] & (1 << 64) - 1, r["component_id"]) for i, r in got.items()} == {i: (want[i], min(groups[i])) for i in groups}
    assert simhash.near_duplicates(docs(spark, ["x"]).limit(0)).count() == 0


def test_near_pairs_lose_nothing(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for x in list(fps):
        for _ in range(6):
            y = x
            for _ in range(rng.randrange(1, 5)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {tuple(r) for r in simhash.near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want


# op4


def test_packing_is_a_partition_of_all_ids(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    tok = Tokenizer.from_file(path)
    texts = [r["text"] for r in sample(spark, sf_dir)] + ODD + ["İstanbul don't. we'll, 3.5%", "word " * 9000]
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts)}
    pieces = packing.pack(docs(spark, texts), path).collect()
    by, seqs = {}, {}
    for p in pieces:
        a = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(a) and zlib.crc32(a[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
        by.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for i, a in ids.items():
        at = 0
        for s, n in sorted(by[i]):
            assert s == at
            at += n
        assert at == len(a)
    lost = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= packing.WINDOW
        lost += packing.WINDOW - at
    assert lost < packing.WINDOW + packing.GRID * len(seqs)
    assert packing.pack(docs(spark, ["x"]).limit(0), path).count() == 0


def test_repeats_never_exceed_the_supply():
    rng = np.random.default_rng(4)
    present = np.zeros(packing.WINDOW + 1, np.int64)
    present[1 : packing.WINDOW] = rng.integers(0, 40, packing.WINDOW - 1)
    combos = packing.combinations(present, each=2)
    times = packing.repeats(combos, present, rounds=50)
    used = np.zeros_like(present)
    for k in range(packing.PARTS):
        np.add.at(used, combos[:, k], times)
    total = combos.sum(axis=1)
    assert ((total <= packing.WINDOW) & (total > packing.WINDOW - packing.SLACK)).all() and (used[1:] <= present[1:]).all() and times.sum() > 0


# op5


def removed_brute(rows):
    first, out = {}, {}
    words = {k: (t or "").encode().split() for k, (_, t) in enumerate(rows)}
    order = sorted(words, key=lambda k: rows[k][0])
    for k in order:
        for p in range(len(words[k]) - 19):
            w = tuple(words[k][p : p + 20])
            first[w] = min(first.get(w, (1 << 70, 0)), (rows[k][0], p))
    for k in order:
        gone = [False] * len(words[k])
        for p in range(len(words[k]) - 19):
            if first[tuple(words[k][p : p + 20])] < (rows[k][0], p):
                gone[p : p + 20] = [True] * 20
        out[k] = [w for w, g in zip(words[k], gone, strict=True) if not g]
    return words, out


def test_substrings_match_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 700)
    rng = random.Random(9)
    vocabulary = ["a", "b", "c", "d"]
    texts = [r["text"] for r in sample(spark, sf_dir, 60)] + ODD
    texts += [" ".join(rng.choice(vocabulary[: rng.randrange(1, 5)]) for _ in range(rng.randrange(0, 90))) for _ in range(80)]
    texts += ["x " * 70, "y " * 25 + "x " * 25 + "y " * 25, "x y " * 40, "x " * 12 + "p q r s t u v w " * 3, "z x " + "x " * 12 + "p q r s t u v w " * 3]
    passage = " ".join(f"w{k}" for k in range(45))
    texts += [f"{k} {passage} {k}" for k in range(12)] + [passage[: 100 + 7 * k] for k in range(12)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    words, kept = removed_brute(rows)
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(5)
    got = {r["doc_id"]: r for r in substrings.without_repeats(df).collect()}
    assert len(got) == len(rows)
    for k, (i, _) in enumerate(rows):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept"].encode()) == (len(words[k]), len(words[k]) - len(kept[k]), b" ".join(kept[k])), i
    assert substrings.without_repeats(df.limit(0)).count() == 0


def test_substrings_with_repeated_ids(spark):
    passage = " ".join(f"w{k}" for k in range(30))
    df = docs(spark, [passage, passage, "k " + passage, passage], [3, 3, 3, None])
    got = sorted((r["doc_id"] is None, r["n_words"], r["n_removed"]) for r in substrings.without_repeats(df).collect())
    assert got == [(False, 30, 0), (False, 30, 0), (False, 31, 30), (True, 30, 30)]


# op6


def test_mixing_meets_targets(spark, monkeypatch):
    texts = ["w " * n for n in (5, 9, 40, 3, 8, 0, 100, 2, 7)] + [None]
    sources = ["b", "b", "a", "c", "c", "c", None, "d", "d", "a"]
    got = mixing.mix(docs(spark, texts, sources=sources), ("doc_id", "source")).collect()
    assert len(got) == len(texts)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in got)
    assert sum(rs[0]["target"] for rs in by.values()) == pytest.approx(total)
    for rs in by.values():
        assert rs[0]["target"] <= 3 * rs[0]["source_size"] and sum(r["taken"] for r in rs) == math.floor(rs[0]["target"] + 0.5)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)  # many buckets instead of one
    again = mixing.mix(docs(spark, texts, sources=sources).repartition(3), ("doc_id", "source")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs(spark, texts).limit(0)).count() == 0


def test_mixing_time_inverts_demand(spark):
    rows = spark.range(0, 101).select((F.col("id") / 100.0).alias("asked"), (F.col("id") % 3).alias("rank"))
    for r in rows.select("asked", "rank", mixing._time(F.col("asked"), F.col("rank")).alias("t")).collect():
        a = (r["rank"] % 3 - 1) / 2
        assert (1 + a) * r["t"] - a * r["t"] ** 2 == pytest.approx(r["asked"])


# op7


def test_language_id(spark, sf_dir):
    rows = sample(spark, sf_dir)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(df.where(common.crc_rest("doc_id", 3) != langid.HELD_OUT))
    told = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(told[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in told.values())
    odd = {r["doc_id"]: r for r in langid.predict(docs(spark, ODD), model).collect()}
    assert all((odd[i]["lang_pred"] == "und") == (t is None or not re.search(r"[^\W\d_]", t)) for i, t in enumerate(ODD))
    nothing = langid.train(docs(spark, ["x", None], langs=[None, "en"]))
    assert langid.predict_one(nothing, "some text") == ("und", 0.0)
    assert langid.predict(df.limit(0), model).count() == 0


def test_language_id_uses_every_word_learned(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    df = df.unionByName(docs(spark, ODD, ids=[-1 - i for i in range(len(ODD))]).select("doc_id", "text", "lang"))
    learn = df.where(common.crc_rest("doc_id", 3) != langid.HELD_OUT)
    whole, few = langid.train(learn), langid.train(learn, most_words=50)
    assert whole.rest is None and len(few.words) == 50 and few.grams.keys() == whole.grams.keys()
    want, got = ({r["doc_id"]: r for r in langid.predict(df, m).collect()} for m in (whole, few))
    assert got.keys() == want.keys()
    for i, r in want.items():
        assert got[i]["lang_pred"] == r["lang_pred"] and got[i]["score"] == pytest.approx(r["score"], abs=1e-9), i
    assert langid.predict(df.limit(0), few).count() == 0


def test_the_driver_holds_frequent_words_as_columns(spark):
    """30,000 words and their n-grams: as rows and dictionaries they took the driver's Python more than 20 MB."""
    words = F.array_join(F.transform(F.sequence(F.col("id") * 10, F.col("id") * 10 + 9), lambda x: F.translate(x.cast("string"), "0123456789", "etaoinshrd")), " ")
    learn = spark.range(3000).select(words.alias("text"), F.when(F.col("id") % 2 == 0, "xx").otherwise("yy").alias("lang"))
    tracemalloc.start()
    try:
        model = langid.train(learn)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 5e6
    assert len(model.words) == 30_000 and model.rest is None and len(model.grams) == len(model.gram_logs) > 10_000


def test_texts_reach_python_in_small_blocks(monkeypatch):
    monkeypatch.setattr(common, "BLOCK", 40)
    texts = ["a" * 30, None, "", "b" * 90, "\u00e9" * 9, "c d"] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(42)), pa.array(texts)], ["n", "text"]).slice(3, 39)
    blocks = list(common.text_blocks(iter([batch, batch.slice(0, 0)]), 1))
    assert len(blocks) > 10 and pa.Table.from_batches(blocks).to_pylist() == batch.to_pylist()
    assert [b for x in blocks for b in common.ascii_bytes(x.column(1))] == [(t or "").encode() for t in texts[3:]]
    counts = Counter()
    monkeypatch.setattr(langid, "REMEMBERED", 3)
    for b in langid._word_counts(iter([pa.RecordBatch.from_arrays([pa.array(["a b c d", "b", "e f b"] * 9), pa.array(["x", "y", "x"] * 9)], ["text", "lang"])])):
        for r in b.to_pylist():
            counts[r["lang"], r["item"]] += r["n"]
    assert counts == {("x", w): 18 if w == "b" else 9 for w in "abcdef"} | {("y", "b"): 9}


def test_most_and_less_frequent_share_the_items_out(spark):
    rows = [(chr(97 + i % 26) * (1 + i // 26), 1 + i % 3) for i in range(60)]
    counts = spark.createDataFrame(rows, "item string, n long")
    in_order = [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))]
    for most in (0, 1, 20, 37, 60, 99):
        top = common.most_frequent(counts, "item", "n", most)
        assert top["item"].to_pylist() == in_order[:most]
        assert sorted(r["item"] for r in common.less_frequent(counts, "item", "n", top).collect()) == sorted(in_order[most:])


# op8


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
]


def test_personal_data_base(spark, sf_dir):
    texts = [r["text"] for r in sample(spark, sf_dir)] + ODD
    texts += ["a@b.c_x@d.e", "x@y@z.w", "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1", "4111 1111 1111 1111 +1 (2) 345-6789 +12345678", "é😀 +49 30 1234567-", "4111-1111-1111-1111 4111111111111111", "+1" * 20, "9" * 3000, "a." * 3000 + "@", "+1(((((((", "@ . @"]
    got = {r["doc_id"]: r for r in pii.personal_data(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = [(k, m.start(), m.end()) for k, (_, p, ok) in enumerate(KINDS) for m in re.finditer(p, t or "") if ok(m[0])]
        assert [tuple(x) for x in got[i]["base"]] == want, i
        assert set(want) <= {tuple(x) for x in got[i]["spans"]}
    assert pii.personal_data(docs(spark, ["x"]).limit(0)).count() == 0


def test_personal_data_bootstraps(spark):
    texts = [f"so please write mail to user{k}@mail.example.com now" for k in range(12)]
    texts += ["so please write mail to admin@localhost now", "unrelated thing admin@localhost here", "some other root@localhost here"]
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in pii.personal_data(docs(spark, texts)).collect()}
    assert got[12] == [(0, 24, 39)] and got[13] == [(0, 16, 31)] and got[14] == []


def test_personal_data_follows_long_chains(spark):
    # each link of the chain: 8 identifiers after one pattern, that also follow the next one
    texts = [f"links to a{i}@x.com" for i in range(8)]
    chain = 7
    for c in range(chain):
        texts += [f"links to z0x{i}@h" if c == 0 else f"step{c} via z{c}x{i}@h" for i in range(8)]
        texts += [f"step{c + 1} via z{c}x{i}@h" for i in range(8)]
    got = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in pii.personal_data(docs(spark, texts)).collect()}
    assert [i for i in got if not got[i]] == []


def test_personal_data_takes_whole_words_of_any_length_before_a_span(spark):
    long = "w" * 90
    texts = [f"{long} {long}{' ' * 80}a{i}@x.com" for i in range(8)] + [f"some {long} {long}{chr(9) * 80}odd@host", f"more{long} other{long} odd@elsewhere", f"é {long.upper()} {long} a@b"]
    found = pii.extracted(docs(spark, texts)).orderBy("row.doc_id").collect()
    left = [(x["l2"], x["l1"]) for r in found for x in r["mentions"]]
    name = lambda w: "~" + hashlib.md5(w.encode()).hexdigest() if len(w) > pii.WORD_LENGTH else w
    assert left == [(name(long), name(long))] * 9 + [(name("more" + long), name("other" + long)), (name(long), name(long))]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs(spark, texts)).collect()}
    assert len(got[8]) == 1 and len(got[9]) == 0 and len(got[10]) == 1


# op9


def test_rules_ledger(spark):
    texts = ODD + ["a b c d " * 40, "\n".join(["same line here"] * 30 + [""] * 5), " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}#" for k in range(60)), "x x x y x x x"]
    led = rules.ledger(docs(spark, texts))
    got = {r["doc_id"]: r for r in led.collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(tri)
        covered = {k + o for k, x in enumerate(tri) if n[x] > 1 for o in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines))), i
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert bool(r["failed"] & rules.mask("base")) == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    table = {r["rule"]: r for r in rules.ablations(led).collect()}
    assert table["few_words"]["failed"] == sum(bool(r["failed"] & 1) for r in got.values())
    assert rules.ledger(docs(spark, ["x"]).limit(0)).count() == 0


# op10


def test_secrets(spark):
    texts = ODD + ["password=abcdef PassWord: 'x' token = \"abcdefg\"", "é AKIA" + "A" * 16 + " AKIA123", "0123456789abcdef01234567 apikey:0123456789abcdef01234567", "ſecret=abcdefgh Key", "https://u:passw0rd@host -----BEGIN RSA PRIVATE KEY-----", "gh" + "p_" + "a" * 36]
    got = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"]] for r in secrets.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, rule in enumerate(secrets.RULES) for m in re.finditer(rule.pattern, t or "") if rule.keep(m))
        assert got[i] == [(secrets.RULES[k].kind, a, b) for a, k, b in want], i
    base = re.findall(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", texts[len(ODD)])
    assert sum(k == "assign" for k, _, _ in got[len(ODD)]) == sum(len(v) >= 6 for _, v in base)
    assert secrets.scan(docs(spark, ["x"]).limit(0)).count() == 0


def indexed(texts, query):
    """The texts that an index of them names for a query."""
    lists = secrets._postings(list(range(len(texts))), texts, 0).to_pylist()[1:]
    nothing = np.zeros(len(texts), bool)
    held = {r["trigram"]: np.isin(np.arange(len(texts)), np.cumsum(np.frombuffer(r["docs"], "<u2"), dtype=int)) for r in lists}
    return set(range(len(texts))) if query is True else set(np.flatnonzero(secrets._holds(query, held, nothing)).tolist())


def test_trigram_queries_hold_for_every_match():
    texts = [b"password=abcdef", b"tok en", b"API_KEY: x", b"AKIAZZ", b"0123abcd"]
    found = {r.kind: indexed(texts, secrets.trigram_query(r.pattern)) for r in secrets.RULES[:3]}
    assert found == {"assign": {0, 2}, "access": {3}, "hex": {0, 1, 2, 3, 4}}
    for query, text, holds in ((secrets.trigram_query("ab?cde+f"), b"abcdef", True), (secrets.trigram_query("(foo|bar)baz"), b"xbarbaz", True), (secrets.trigram_query("(foo|bar)baz"), b"foo bar", False)):
        assert bool(indexed([text], query)) is holds


def test_redaction(spark):
    df = docs(spark, ["é password=abcdef0123456789abcdef0123 z", "clean", None])
    out = secrets.scan(df, mark="[SECRET]")
    assert {r["doc_id"]: r["clean"] for r in out.collect()} == {0: "é [SECRET] z", 1: "clean", 2: None}


def test_whole_groups_never_split_a_group():
    import pyarrow as pa

    keys = sorted(random.Random(1).choices(range(40), k=500))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 7])], ["k"]) for i in range(0, 500, 7)]
    chunks = [t.column("k").to_pylist() for t in common.whole_groups(batches, "k", 30)]
    assert [x for c in chunks for x in c] == keys
    assert all(a[-1] != b[0] for a, b in zip(chunks, chunks[1:], strict=False))
