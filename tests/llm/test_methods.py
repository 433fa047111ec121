"""What the operators' methods themselves must show, against plain versions that share no code with them."""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tarnwell.llm import common, langid, mixing, packing, pii, rules, secrets


def test_letters_are_unicode_letters_and_marks(sf_dir):
    word = regex.compile(r"\p{L}[\p{L}\p{M}]*")
    for text in ("² ½ ③ Ⅷ", "हिन्दी x²y", "l'été_a1b", "éa", "́a", "中文 字", "", "123 _ -"):
        assert langid.LETTERS.findall(text) == langid.letter_words(text) == word.findall(text)


def test_texts_without_letters_are_undetermined(spark):
    docs = spark.createDataFrame([(0, "the cat and the dog", "en"), (1, "le chat et le chien", "fr")], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(0, "² ½ ③"), (1, "12 34"), (2, None), (3, ""), (4, "the dog"), (4, "the dog"), (None, "le chien")], "doc_id long, text string")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(odd, langid.train(docs)).collect()]
    assert sorted((d, p) for d, p, _ in got if p == "und") == [(0, "und"), (1, "und"), (2, "und"), (3, "und")]
    assert [p for d, p, _ in got if d == 4] == ["en", "en"] and [p for d, p, _ in got if d is None] == ["fr"]
    assert len({s for d, _, s in got if d == 4}) == 1


def test_joined_words_tell_the_same_as_broadcast_ones(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    told = [{r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in langid.predict(docs, langid.train(docs, most)).collect()} for most in (10, 1 << 18)]
    assert told[0] == told[1]


def repeats_brute(words):
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)})


def test_repeated_words_of_short_and_very_long_texts(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefghijkl") + rng.choice("abcdefghi") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 100, 4097, 4098, 4099, 200_000)]
    texts += ["a " * 5000, "a b c a b c", "a a a", "a a a a"]
    got = {r["doc_id"]: r["n_repeat_words"] for r in rules.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: repeats_brute(t.split()) for i, t in enumerate(texts)}


CUES = {0: ("write mail to", "kindly"), 1: ("server address is", "today"), 2: ("charge my card", "please"), 3: ("call me at", "tonight")}


def card(rng):
    d = [rng.randrange(10) for _ in range(15)]
    total = sum(x if i % 2 else x * 2 - 9 * (x > 4) for i, x in enumerate(d))
    return "".join(map(str, d)) + str(-total % 10)


def base_like(rng, kind):
    return (
        f"u{rng.randrange(10**6)}@h{rng.randrange(100)}.example.com", ".".join(str(rng.randrange(256)) for _ in range(4)), card(rng),
        f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}",
    )[kind]


def unseen(rng, kind):
    c = card(rng)
    return (
        rng.choice((f"n{rng.randrange(10**6)} (at) h{rng.randrange(100)} (dot) org", f"n{rng.randrange(10**6)}@intranet")), ":".join(f"{rng.randrange(1, 1 << 16):x}" for _ in range(8)),
        ".".join(c[i : i + 4] for i in (0, 4, 8, 12)), f"{rng.randrange(200, 999)}-555-{rng.randrange(1000, 9999)}",
    )[kind]


def test_context_finds_planted_identifiers_and_leaves_decoys(spark, sf_dir):
    """Identifiers that no base pattern matches, planted after cues in whole documents, and look-alikes after other words."""
    rng = random.Random(3)
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs, want, decoys = [], set(), 0
    for i, (_, text) in enumerate(rows):
        kind = rng.randrange(4)
        before, after = CUES[kind]
        sort = i % 4
        if sort < 2:
            docs.append((i, f"{text} {before} {base_like(rng, kind)} {after} {text[:80]}"))
            continue
        value = unseen(rng, kind)
        if sort == 3:  # look-alikes: the same shapes where nothing vouches for them
            decoys += 1
            docs.append((i, f"{text} item {rng.choice(('no', 'lot', 'part'))} {value} of {rng.randrange(10**6)} {text[:80]}"))
            continue
        head = f"{text} {rng.choice((before, 'oh ' + before.split()[1] + ' ' + before.split()[2]))} "
        docs.append((i, f"{head}{value} {after}"))
        want.add((i, kind, len(head), len(head) + len(value)))
    found = pii.personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    added = {(r["doc_id"], *x) for r in found for x in set(map(tuple, r["spans"])) - set(map(tuple, r["base"]))}
    assert decoys > 20 and len(want) > 20
    assert len(added & want) >= 0.9 * len(want)
    # what else was added are identifiers of the table itself that the base fused with a neighbour
    own = {x for x in added - want if x[0] % 4 != 3}
    assert len(added & want) >= 0.9 * len(added - own) and all(rows[d][1] for d, *_ in own)


def graph_scores_brute(met, support, purity, rounds):
    """Pattern and instance scores by plain loops over the mentions."""

    def patterns(m):
        l1, l2, r1 = m["l1"], m["l2"], m["r1"]
        said = lambda *ws: any(set(w) - set("<>") for w in ws)
        around = [
            (said(l1, l2), f"two left: {l2} {l1}"), (said(l1), f"left: {l1}"), (said(l2), f"left, gap: {l2} *"), (said(r1), f"right: {r1}"),
            (said(l1, r1), f"both: {l1} _ {r1}"), (m["form"] is not None, f"spelling: {m['kind']} {m['form']}"),
        ]
        return [p for there, p in around if there]

    edges = {}
    for m in met:
        for p in patterns(m):
            e = (p, m["kind"], m["value"])
            edges[e] = edges.get(e, False) or m["seed"]
    able = {}
    for p, k in {(p, k) for p, k, _ in edges if k >= 0}:
        mine = [seed for (q, j, _), seed in edges.items() if (q, j) == (p, k)]
        total = sum(q == p for q, _, _ in edges)
        if len(mine) >= support and len(mine) >= purity * total:
            able[p, k] = (sum(mine), total - len(mine))
    open_edges = [e for e, seed in edges.items() if not seed and e[:2] in able]
    instances = {}
    for _ in range(rounds):
        scored = {}
        for (p, k), (seeds, against) in able.items():
            met_with = [] if p.startswith("spelling:") else [instances[k, v] for q, j, v in open_edges if (q, j) == (p, k) and (k, v) in instances]
            weight = seeds + sum(met_with)
            if seeds + sum(x >= pii.ACCEPT for x in met_with) >= support and weight >= purity * (weight + against):
                scored[p, k] = weight / (weight + against + 1)
        doubt = {}
        for p, k, v in open_edges:
            if (p, k) in scored:
                doubt[k, v] = doubt.get((k, v), 1.0) * (1 - min(scored[p, k], 1 - 1e-12))
        instances = {i: 1 - d for i, d in doubt.items()}
    return scored, instances


@pytest.mark.parametrize("rounds", [1, 2, 4])
def test_graph_scores_match_brute_force(spark, rounds):
    rng = random.Random(11)
    rows = []
    for i in range(260):
        kind = rng.randrange(4)
        before, after = CUES[kind]
        # a second cue that only unseen identifiers share, so that it is learned from accepted instances
        value = base_like(rng, kind) if i % 3 else unseen(rng, kind)
        first = before if i % 2 else f"{rng.choice('abcd')} {before.split()[-1]}"
        rows.append((i, f"{first} {value} {after if i % 5 else 'new'} words lot {rng.randrange(40)} {'then ' + value if i % 7 == 0 else ''}"))
    met = common.saved(pii.mentions(pii.extracted(spark.createDataFrame(rows, "doc_id long, text string"))))
    patterns, instances = pii.trusted(met, support=4, purity=0.8, rounds=rounds)
    want_patterns, want_instances = graph_scores_brute(met.collect(), 4, 0.8, rounds)
    assert {(r["pattern"], r["kind"]): r["score"] for r in patterns.collect()} == pytest.approx(want_patterns)
    assert {(r["kind"], r["value"]): r["score"] for r in instances.collect()} == pytest.approx(want_instances, abs=1e-9)
    assert sum(not p.startswith("spelling:") for p, _ in want_patterns) >= 4 and len(want_instances) >= 20


def test_fused_identifiers_are_found_by_their_spelling(spark):
    rng = random.Random(5)
    rows = [(i, f"w{i}x {card(rng)} and") for i in range(12)] + [(100 + i, f"q{i}r {base_like(rng, 3)} or") for i in range(12)]
    phone, number = base_like(rng, 3), card(rng)
    rows.append((200, f"see {phone} {number} there"))
    wrong = str(int(number) + 1)  # fails the check: no card
    rows.append((201, f"see {wrong} there"))
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert list(got[200]["base"]) == [] and [tuple(x) for x in got[200]["spans"]] == [(2, 5 + len(phone), 5 + len(phone) + 16), (3, 4, 4 + len(phone))]
    assert list(got[201]["spans"]) == []


def test_personal_data_of_repeated_rows_null_ids_and_long_texts(spark):
    long = " ".join(f"{i} y{i}@h.com" for i in range(20_000))
    rows = [(1, "to a@b.com and 1.2.3.4"), (1, "to a@b.com and 1.2.3.4"), (None, "to a@b.com"), (None, None), (2, long), (3, "7" * 30_000), (4, "+1" * 9000), (5, "a(at)" * 5000)]
    got = [(r["doc_id"], len(r["base"]), len(r["spans"])) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(x for x in got if x[0] == 1) == [(1, 2, 2)] * 2 and sorted(x[1] for x in got if x[0] is None) == [0, 1]
    assert [x[1] for x in got if x[0] == 2] == [20_000]


def test_running_sums(spark):
    for a in ([], [5], [1, 2, 3], list(range(1000))):
        got = spark.createDataFrame([(a,)], "a array<int>").select(pii._running(F.col("a")).alias("s")).first()["s"]
        assert got == [sum(a[: i + 1]) for i in range(len(a))]


def scanned_brute(text, rules):
    """Every rule's regex over the whole text, without an index."""
    return sorted((m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.pattern, text or "") if r.keep(m))


OTHER_RULES = (
    secrets.Rule("either", r"(alpha|beta)-?key[0-9]+"), secrets.Rule("short", r"q.z"), secrets.Rule("class", r"[xy]{2}abc+"), secrets.Rule("many", r"(one|two|three)(four|five)?six"),
    secrets.Rule("case", r"[Ss][Ee][Cc]ret"), secrets.Rule("letter", "éclair"),
)


def test_index_and_full_scan_agree_for_two_rule_sets(spark, sf_dir, monkeypatch):
    rng = random.Random(11)
    pieces = ["alphakey12", "beta-key3", "betakey", "qaz", "xyabc", "xxabccc", "threesix", "onefivesix", "SECret", "éclair", "password=hunter2x", "ghp_" + "a" * 36, "AKIA" + "Z" * 16, "f" * 24, "token: abcdef"]
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += [" ".join(rng.choice([*pieces, "the", "of", "key", "two"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += [None, "", "ab", "alphakey1", "alphakey1", "\0alpha\0key7", "z" * 3_000_000 + " onesix " + "w" * 2_000_000]
    docs = spark.createDataFrame([(i if i % 7 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, place long").repartition(5)
    index = secrets.build_index(docs)
    for rules in (secrets.RULES, OTHER_RULES):
        monkeypatch.setattr(secrets, "BROADCAST_ROWS", 0 if rules is OTHER_RULES else 500_000)
        got = {r["place"]: [(x["start"], [q.kind for q in rules].index(x["kind"]), x["end"]) for x in r["spans"]] for r in secrets.scan(docs, ("place",), rules, index).collect()}
        assert got == {i: scanned_brute(t, rules) for i, t in enumerate(texts)}
        # the index narrows: a rule's candidates are far fewer than all texts
        assert 0 < secrets.candidates(index, rules).count() < len(texts)
    assert secrets.scan(docs.limit(0)).count() == 0


def test_posting_lists_are_those_of_the_texts(spark):
    texts = ["abcabc", "xabc", None, "", "ab", "ABCD"]
    rows = secrets.build_index(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).collect()
    assert len({r["segment"] for r in rows}) == 1
    docs = len(np.frombuffer(next(r["docs"] for r in rows if r["trigram"] == secrets.DOCUMENTS), "<i8"))
    assert docs == 5  # the null text counts as the empty one
    abc = next(r["docs"] for r in rows if r["trigram"] == secrets.trigram_number(b"abc"))
    assert len(np.frombuffer(abc, "<u2")) == 3


def active_set(a, b):
    """Non-negative least squares by an active set of columns, the plain textbook way."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(10 * n):
        slope = a.T @ (b - a @ x)
        slope[free] = -np.inf
        if slope.max(initial=-np.inf) <= 1e-9:
            break
        free[int(slope.argmax())] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if (s[free] > 0).all():
                break
            bad = free & (s <= 0)
            step = min(x[bad] / (x[bad] - s[bad]))
            x = x + step * (s - x)
            free &= x > 1e-12
            x[~free] = 0.0
        x = s
    return x


def test_least_squares_are_those_of_an_active_set_solver():
    rng = np.random.default_rng(2)
    for window, most in ((24, 6), (40, 30), (64, 400)):
        present = np.zeros(window + 1, np.int64)
        present[1:window] = rng.integers(0, most, window - 1)
        combos = packing.combinations(present, window, slack=2, each=4)
        a = np.zeros((window + 1, len(combos)))
        for k in range(packing.PARTS):
            np.add.at(a, (combos[:, k], np.arange(len(combos))), combos[:, k] > 0)
        want = present.astype(float)
        want[0] = 0
        x = packing.nonnegative(combos, want, rounds=3000)
        best = np.linalg.norm(a @ active_set(a, want) - want)
        assert (x >= 0).all() and np.linalg.norm(a @ x - want) <= best + 0.01 * np.linalg.norm(want)
        assert np.linalg.norm(a @ packing.nonnegative(combos, want) - want) <= best + 0.03 * np.linalg.norm(want)


def test_the_plan_carries_nearly_all_remainders():
    rng = np.random.default_rng(6)
    shares = []
    for n in (300, 3000, 100_000):
        rest = np.minimum(packing.WINDOW - 1, rng.lognormal(6.3, 1.0, n).astype(int) + 1)
        rest[: n // 3] = 777  # a third of all rows repeat one length
        present = np.bincount(rest, minlength=packing.WINDOW + 1)
        combos, times = packing.plan(present)
        used = np.bincount(combos.ravel(), np.repeat(times, packing.PARTS), packing.WINDOW + 1)
        used[0] = 0
        assert (used <= present).all() and (combos.sum(axis=1) <= packing.WINDOW).all() and (combos.sum(axis=1) > packing.WINDOW - packing.SLACK).all()
        shares.append(used.sum() / n)
    assert shares[0] > 0.8 and shares[1] > 0.9 and shares[2] > 0.99, shares


def test_slots_cover_every_repeat_once():
    rng = np.random.default_rng(8)
    present = np.bincount(np.minimum(packing.WINDOW - 1, rng.lognormal(6.3, 1.0, 5000).astype(int) + 1), minlength=packing.WINDOW + 1)
    combos, times = packing.plan(present)
    length, rank, count, seq, off = packing._slots(combos, times)
    filled = defaultdict(list)
    for n, c, s, o in zip(length.tolist(), count.tolist(), seq.tolist(), off.tolist(), strict=True):
        for j in range(c):
            filled[s + j].append((o, n))
    assert len(filled) == times.sum()
    for parts in filled.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert packing.WINDOW - packing.SLACK < at <= packing.WINDOW
    for n in set(length.tolist()):
        own = length == n
        assert rank[own].tolist() == [0, *np.cumsum(count[own])[:-1].tolist()]


def test_packing_keeps_the_order_of_rows(spark, tmp_path, monkeypatch):
    """Windows hold neighbours: the places of a window's documents in the input lie close together."""
    import public_tokenizers

    monkeypatch.setattr(packing, "STRETCH_DOCS", 250)
    rng = random.Random(9)
    texts = [" ".join("word" for _ in range(int(min(3000, rng.lognormvariate(5.5, 0.8))) + 1)) for _ in range(3000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartitionByRange(6, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "docs"))
    pieces = packing.pack(spark.read.parquet(str(tmp_path / "docs")), public_tokenizers.path(packing.TOKENIZER)).collect()
    by = defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append(p["doc_id"])
    spread = [max(d) - min(d) for d in by.values() if len(d) > 1]
    assert np.mean(spread) < 0.1 * len(texts)
    middle = [np.mean(by[s]) for s in sorted(by)]
    assert np.corrcoef(middle, np.arange(len(middle)))[0, 1] > 0.95


def test_packing_of_odd_rows(spark):
    import public_tokenizers

    rows = [(1, "same words here"), (1, "same words here"), (None, "x y"), (None, None), (2, ""), (3, "long " * 30_000)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path(packing.TOKENIZER)).collect()
    tokens = lambda d: sorted(p["length"] for p in pieces if p["doc_id"] == d)
    assert len(tokens(1)) == 2 and len(set(tokens(1))) == 1 and tokens(2) == [1] and sum(tokens(None)) == next(p["doc_tokens"] for p in pieces if p["doc_id"] is None and p["doc_tokens"] > 1) + 1
    assert sum(tokens(3)) == next(p["doc_tokens"] for p in pieces if p["doc_id"] == 3) and tokens(3).count(packing.WINDOW) >= 7


def test_every_copy_has_a_time_of_its_own(spark, sf_dir):
    rows = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), ("doc_id", "source"), whole=True).collect()
    assert all(len(r["positions"]) == r["copies"] for r in rows) and any(r["copies"] > 1 for r in rows)
    for r in rows:
        assert r["positions"] == sorted(r["positions"]) and all(0 <= x <= 1 for x in r["positions"])
        if r["copies"] > 1 and r["size"]:
            assert len(set(r["positions"])) == r["copies"]
    # at the demand of time t, the words placed before t are about the share of the target that the schedule asks for
    places = {s: k for k, s in enumerate(sorted({r["source"] for r in rows}))}
    for source, k in places.items():
        own = [(p, r["size"]) for r in rows if r["source"] == source for p in r["positions"]]
        target, largest, a = next(r["target"] for r in rows if r["source"] == source), max(n for _, n in own), (k % 3 - 1) / 2
        for t in (0.25, 0.5, 0.75):
            placed = sum(n for p, n in own if p < t)
            assert abs(placed - ((1 + a) * t - a * t * t) * target) <= largest + 1


def test_mixing_of_odd_rows(spark):
    rows = [(None, "a b", "s"), (None, "c", "s"), (None, None, None), (1, "x y z", "s"), (1, "x y z", "s"), (2, "", ""), (3, "w " * 50_000, "t")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(r["size"] for r in got) == [0, 0, 1, 2, 3, 3, 50_000]


def test_targets_match_a_plain_loop(spark):
    rng = random.Random(12)
    for most in (1, 7, 60):
        size = {f"s{rng.randrange(10**6)}": rng.choice((0, 1, 5, 1000, 10**6)) for _ in range(most)} | {None: 17}
        order = sorted((s for s in size if s is not None)) + [None]
        weight, target = {s: 1 + k % 3 for k, s in enumerate(order)}, {}
        left, free = sum(size.values()), set(order)
        while free:
            level = left / sum(weight[s] for s in free)
            full = {s for s in free if 3 * size[s] <= weight[s] * level}
            target |= {s: 3 * size[s] if full else weight[s] * level for s in full or free}
            left -= sum(target[s] for s in full)
            free = free - full if full else set()
        got = {r["source"]: (r["rank"], r["target"]) for r in mixing.targets(spark.createDataFrame(list(size.items()), "source string, size long")).collect()}
        assert {s: r for s, (r, _) in got.items()} == {s: k for k, s in enumerate(order)}
        assert all(abs(got[s][1] - target[s]) <= 1e-6 * max(1, target[s]) for s in order)


def test_running_sums_over_ranges(spark):
    rng = random.Random(13)
    keys = rng.sample(range(10_000), 500)
    df = spark.createDataFrame([(k, rng.randrange(100)) for k in keys], "k long, v long").repartition(7)
    got = {r["k"]: (r["v"], r["before"]) for r in common.running_sums(df, ("k",), {"before": F.col("v")}).collect()}
    total = 0
    for k in sorted(keys):
        assert got[k][1] == total
        total += got[k][0]


def test_hot_keys_join_like_others(spark, tmp_path):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    labels = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("label"))
    got = common.joined(common.saved(rows), common.saved(labels), ["k"], "n", 5000)
    want = rows.join(labels, "k").select("k", "x", "n", "label")
    assert sorted(map(tuple, got.select("k", "x", "n", "label").collect())) == sorted(map(tuple, want.collect()))


def languages_brute(learn, texts):
    """(language, probability) of each text, by a plain version of the method."""
    def words_of(text):
        out, now = [], ""
        for c in (text or "").lower() + " ":
            kind = unicodedata.category(c)[0]
            if kind == "L" or (kind == "M" and now):
                now += c
            else:
                out += [now] if now else []
                now = ""
        return out

    def parts(word, k):
        marked = "^" + word + "$"
        return [marked[i : i + k] for i in range(len(marked) - k + 1)]

    said = {}
    for text, lang in learn:
        if text is not None and lang is not None:
            said.setdefault(lang, Counter()).update(words_of(text))
    said = {lang: c for lang, c in said.items() if c}
    langs = sorted(said)
    grams = {lang: Counter(g for w in said[lang] for k in (1, 2, 3, 4) for g in parts(w, k)) for lang in langs}
    known, known_grams = set().union(*said.values()), set().union(*grams.values())
    log = lambda counts, item, types: math.log((counts[item] + 0.5) / (counts.total() + 0.5 * (types + 1)))
    everything = sum(c.total() for c in said.values())
    out = []
    for text in texts:
        own = words_of(text)
        if not own or not langs:
            out.append(("und", 0.0))
            continue
        score, n = dict.fromkeys(langs, 0.0), 0
        for w in own:
            if w in known:
                n += 1
                for x in langs:
                    score[x] += log(said[x], w, len(known))
                continue
            for k in (4, 3, 2, 1):
                if found := [g for g in parts(w, k) if g in known_grams]:
                    n += 1
                    for x in langs:
                        score[x] += sum(log(grams[x], g, len(known_grams)) for g in found) / len(found)
                    break
        at = {x: math.log(said[x].total() / everything) + score[x] * min(1.0, 20 / max(n, 1)) for x in langs}
        most = max(at.values())
        odds = {x: math.exp(v - most) for x, v in at.items()}
        best = max(langs, key=lambda x: odds[x])
        out.append((best, odds[best] / sum(odds.values())))
    return out


@pytest.mark.parametrize("limits", [(1 << 17, 1 << 17), (20, 1 << 17), (1 << 17, 30), (15, 25), (0, 0)])
def test_languages_match_brute_force(spark, sf_dir, limits):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()
    learn = [(r["text"][:600], r["lang"]) for r in rows[:30]] + [("\u4f60\u597d \u4e16\u754c", "zh"), ("cafe\u0301 na\u00efve x\u00b2", "fr"), (None, "en"), ("word", None), ("12 34", "xx")]
    texts = [r["text"][:400] for r in rows[20:]] + [None, "", "42", "\u4f60 zzzq qqqq", "caf\u00e9 cafe\u0301", "xylophone " * 30, "\u16a0\u16a1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    model = langid.train(spark.createDataFrame(learn, "text string, lang string"), *limits)
    assert len(model.words) <= limits[0] and len(model.grams) <= limits[1]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()}
    for i, (lang, score) in enumerate(languages_brute(learn, texts)):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-9), texts[i]
