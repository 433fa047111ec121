"""Phrases, whitening and licences against plain versions, on hand-made rows and the small tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import licences, phrases, whitening

from .test_operators import ODD, docs, sample

# op11


def phrases_brute(rows, least, most, longest=4):
    """lang -> rows in order; rows: (lang, text)."""
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(small)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    frequent = {key: a for key, a in f.items() if a >= least}
    inside = Counter()
    for (lang, p), a in frequent.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside[lang, p[i : i + k]], a)
    out = {}
    for (lang, p), a in frequent.items():
        if len(p) < 2 or 100 * inside[lang, p] >= 80 * a:
            continue
        score, _, l, r = min((math.floor(Fraction(2000000 * a, f[lang, p[:k]] + f[lang, p[k:]])), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return {lang: [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:most], 1)] for lang, found in out.items()}


def phrases_found(df, **kw):
    out = {}
    for r in sorted(phrases.phrases(df, **kw).collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(tuple(r))
    return out


def planted_texts(seed=7):
    """Few words, so that phrases repeat, with fixed phrases of two to six words strewn in."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(25)]
    fixed = [["new", "york"], ["in", "spite", "of"], ["on", "the", "other", "hand"], ["the", "end", "of", "the", "day", "then"], ["w1", "w2", "w1"]]
    texts = []
    for _ in range(60):
        w = []
        for _ in range(60):
            w += rng.choice(fixed) if rng.random() < 0.2 else [rng.choice(vocabulary[: rng.choice((4, 25))])]
            if rng.random() < 0.1:
                w[-1] += rng.choice(".,;:!?\n\x0b\x0c\r")
        texts.append(rng.choice((" ", "\t", "  ")).join(w).title() if rng.random() < 0.3 else " ".join(w))
    return texts


@pytest.mark.parametrize("most", [3, 40, 2000])
def test_phrases_match_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(phrases, "FIRST", 1)
    monkeypatch.setattr(phrases, "FURTHER", 2)
    monkeypatch.setattr(phrases, "CHUNK", 2000)
    texts = planted_texts()
    langs = ["en" if k % 3 else None if k % 2 else "de" for k in range(len(texts))]
    want = phrases_brute(zip(langs, texts, strict=True), 5, most)
    assert phrases_found(docs(spark, texts, langs=langs), least=5, most=most) == want
    assert {"en", "de", "und"} == set(want)


def test_phrases_of_a_crowded_filter(spark, monkeypatch):
    """A filter whose bits nearly all are set lets everything pass, and changes nothing."""
    monkeypatch.setattr(phrases, "BITS", 6)
    texts = planted_texts(3)
    assert phrases_found(docs(spark, texts), least=5, most=10) == phrases_brute([("en", t) for t in texts], 5, 10)


def test_phrases_on_the_table(spark, sf_dir):
    rows = [(r["lang"], r["text"]) for r in sample(spark, sf_dir)]
    assert phrases_found(spark.read.parquet(f"{sf_dir}/documents.parquet")) == phrases_brute(rows, 30, 2000)


def test_phrases_of_odd_rows(spark):
    texts = ODD * 2
    assert phrases_found(docs(spark, texts), least=2) == phrases_brute([("en", t) for t in texts], 2, 2000)
    assert phrases.phrases(docs(spark, ["a"]).limit(0)).collect() == []
    assert phrases.phrases(docs(spark, ["once only"])).collect() == []
    long = "a b c " * 50000
    assert phrases_found(docs(spark, [long])) == phrases_brute([("en", long)], 30, 2000)


def test_scores_beyond_64_bits(spark):
    grams = spark.createDataFrame([("en", "a b", 9 * 10**18)], phrases.GRAMS)
    known = spark.createDataFrame([("en", "a", 9 * 10**18), ("en", "b", 9 * 10**18 + 5)], phrases.GRAMS)
    assert phrases._scored(grams, known).first()["score"] == math.floor(Fraction(2000000 * 9 * 10**18, 18 * 10**18 + 5))


def test_growth_counts_little(spark, monkeypatch):
    """Beyond pairs only what grows from the frontier, or ends in a contender, is counted."""
    counted = {}
    real = phrases._counts

    def counting(df, k, wanted=None):
        out = real(df, k, wanted)
        if k > 2:
            counted[k] = counted.get(k, 0) + out.count()
        return out

    monkeypatch.setattr(phrases, "_counts", counting)
    texts = planted_texts()
    phrases.phrases(docs(spark, texts), least=5, most=3).collect()
    everything = real(docs(spark, texts).select("lang", F.coalesce("text", F.lit("")).alias("text")), 3).count()
    assert 0 < counted[3] < everything / 2


# op12


def whitened_brute(rows, most=32):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v in good], object)
    n, s = len(x), x.sum(0)
    moved = n * x - s
    centred = (moved / n).astype(float)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    k = min(most, int((e > 1e-9 * e.max()).sum()))
    e, u = e[::-1], u[:, ::-1]
    return good, (moved * moved).sum(1), centred @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def whitened_matches(df, rows, most=32):
    good, deviation, want, explained = whitened_brute(rows, most)
    got = sorted(whitening.whiten(df, most=most).collect(), key=lambda r: (r["vec_id"], r["component"]))
    n, k = want.shape
    assert [(r["vec_id"], r["component"]) for r in got] == [(i, c + 1) for i in sorted(i for i, _ in good) for c in range(k)]
    order = np.argsort([i for i, _ in good], kind="stable")
    have = np.array([r["whitened"] for r in got]).reshape(n, k)
    want = want[order]
    assert np.abs(have - want * np.sign((have * want).sum(0))).max() < 1e-7
    assert [r["deviation"] for r in got[::k]] == [int(deviation[j]) for j in order]
    assert all(r["n"] == n and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 for r in got)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    return got


def test_whitening_matches_a_direct_solver(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    whitened_matches(table.withColumn("x", F.lit(1)).withColumn("row", F.lit("clash")), [(r["vec_id"], r["embedding"]) for r in table.collect()])


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(6) * [5, 4, 3, 2, 1, 0]).tolist()) for i in range(40)]  # the last direction has no variance
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [math.nan] * 6), (103, [math.inf] * 6)]
    schema = "vec_id long, embedding array<double>"
    got = whitened_matches(spark.createDataFrame(rows, schema), rows)
    assert max(r["component"] for r in got) == 5
    again = [*rows, *rows[:7]]
    assert len(whitening.whiten(spark.createDataFrame(again, schema)).collect()) == 47 * 5
    other = [*rows, (104, [1.0, 2.0]), (105, [])]  # of another length than most
    assert {r["vec_id"] for r in whitening.whiten(spark.createDataFrame(other, schema)).collect()} == set(range(40))
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        df = whitening.whiten(spark.createDataFrame(few, schema))
        assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and df.collect() == []
    far = [(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [-1e300, 5.0])]
    x = [[2**62 + 1000000, 1000000], [1000000, 1000064], [1000000 - 2**62, 1000320]]
    exact = {i + 1: sum((3 * c - sum(y[j] for y in x)) ** 2 for j, c in enumerate(v)) for i, v in enumerate(x)}
    assert {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(far, schema)).collect()} == {i: v if v < 2**63 else None for i, v in exact.items()}


@pytest.mark.parametrize("d,k,kind", [(64, 32, "flat"), (200, 16, "decay"), (150, 8, "equal"), (40, 32, "low"), (1, 1, "flat")])
def test_solver_on_known_matrices(d, k, kind):
    rng = np.random.default_rng(d)
    e = {"flat": np.sort(rng.uniform(1, 2, d))[::-1], "decay": 1e3 / np.arange(1, d + 1) ** 1.5, "equal": np.r_[np.full(5, 5.0), np.full(max(d - 5, 0), 1.0)][:d], "low": np.r_[np.arange(10, 0, -1.0), np.zeros(d)][:d]}[kind]
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    passes = []
    values, u = whitening.jacobi_davidson(lambda x: passes.append(x.shape) or a @ x, d, k)
    assert np.abs(values - e[:k]).max() < 1e-13 * e[0] * d
    assert np.abs(a @ u - u * values).max() < 1e-13 * e[0] * d and np.abs(u.T @ u - np.eye(k)).max() < 1e-12


# op13


def licences_brute(texts):
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    all_words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(small)) for t in texts]
    parsed = []
    for label, text in licences.TEMPLATES:
        plain = text.replace("[", "").replace("]", "").split()
        keys = [(len(text[: m.start()].replace("[", "").replace("]", "").split()), m[1].split()) for m in re.finditer(r"\[([^]]*)\]", text)]
        parsed.append((label, plain, keys))
    held = Counter(w for ws in all_words for w in set(ws))
    rare = {w: math.log((1 + len(texts)) / (1 + held[w])) for _, ws, _ in parsed for w in ws}
    out = []
    for ws in all_words:
        places, base, labels, best = [], set(), set(), 0.0
        for phrase, label in licences.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
            places += at
            base |= {label} if at else set()
        for label, plain, keys in parsed:
            anchors = sorted({w: plain.index(w) for w in plain}.items(), key=lambda x: (-rare[x[0]], x[1]))[: licences.ANCHORS]
            for at in range(len(ws)):
                if all(ws[at + k : at + k + len(p)] == p for k, p in keys) and sum(at + k < len(ws) and ws[at + k] == w for w, k in anchors) >= min(licences.AGREE, len(anchors)):
                    whole = sum(rare[w] for w in plain)
                    share = sum(rare[w] for k, w in enumerate(plain) if at + k < len(ws) and ws[at + k] == w) / whole if whole else sum(at + k < len(ws) and ws[at + k] == w for k, w in enumerate(plain)) / len(plain)
                    if share >= licences.SHARE:
                        labels.add(label)
                        best = max(best, share)
        out.append((len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), pytest.approx(min(best, 1.0))))
    return out


def licences_found(df):
    return [tuple(r)[1:8] for r in sorted(licences.scan(df).collect(), key=lambda r: r["doc_id"])]


NOTICES = [
    "Released under the MIT License.",
    "The MIT License, the mit-license; MIT LICENSE!",
    "x " * 30 + "Licensed under the Apache License, Version 2.0. This is not the apache license 1",
    "This work is licensed under the GNU General Public License, version 3. Released under the MIT License",
    "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0",
    "cc by cc by",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "redistribution and use in source and binary forms",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mitlicense mit the license gnu public license",
    "éMIT license MIT licenseé",
]


def test_licences_match_brute_force(spark, sf_dir):
    texts = NOTICES + ODD + NOTICES[:3]
    got = licences_found(docs(spark, texts))
    assert got == licences_brute(texts)
    assert got[0][5] == "mit" and got[2][5] == "apache,apache-2.0" and got[3][5] == "gpl,gpl-3.0,mit" and got[4][5] == "cc-by,cc-by-4.0,cc-by-nc-4.0" and got[6][5] == "bsd"
    rows = sample(spark, sf_dir)
    found = licences_found(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert found == licences_brute([r["text"] for r in rows])
    assert {"apache-2.0"} <= {x for r in found for x in r[5].split(",")}


def test_licences_of_odd_rows(spark):
    empty = docs(spark, ["a"]).limit(0)
    assert licences.scan(empty).collect() == []
    same = ["Released under the MIT License."] * 5  # no word is rare here
    assert licences_found(docs(spark, same, ids=[None, 1, 1, 2, 2]).fillna(0, ["doc_id"])) == licences_brute(same)
    long = "filler words " * 50000 + NOTICES[2] + " licensed under the apache license version 2 0" * 300
    assert licences_found(docs(spark, [long, None])) == licences_brute([long, None])
    assert [r["label"] for r in licences.scan(docs(spark, [NOTICES[4]])).first()["notices"]] == ["cc-by-nc-4.0", "cc-by-4.0"]


def test_licences_stay_native(spark):
    plan = licences.scan(docs(spark, NOTICES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
