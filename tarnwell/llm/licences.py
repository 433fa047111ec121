"""Licence scans by a positional index of rare words. DataFrame functions only.

Each template's words have postings (template, position). How many documents hold a template's words is counted over the
whole table first; the rarest words of each template are its anchors. A document's anchors are looked up and each posting
says where its template would begin; beginnings on which enough anchors agree are candidates. A candidate is confirmed by
the template's key phrases at their relative positions, and scored by the share of the template's rarity that stands in
its place. One pass for the counts, one for the scan, which needs no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The base phrases with their labels.
BASE: dict[str, str] = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices of public licences by label, key phrases in brackets. A key phrase must stand word by word.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "released under the [mit license]"),
    ("mit", "licensed under the [mit license]"),
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software to deal in [the software without restriction]"),
    ("apache-2.0", "licensed under the [apache license version 2 0]"),
    ("apache-2.0", "you may obtain a copy of the license at http www [apache org licenses license 2 0]"),
    ("gpl-3.0", "this work is licensed under the [gnu general public license version 3]"),
    ("gpl-3.0", "under the terms of the [gnu general public license] as published by the free software foundation either [version 3] of the license or at your option any later version"),
    ("gpl-2.0", "this work is licensed under the [gnu general public license version 2]"),
    ("gpl-2.0", "under the terms of the [gnu general public license] as published by the free software foundation either [version 2] of the license or at your option any later version"),
    ("lgpl", "under the terms of the [gnu lesser general public license] as published by the free software foundation"),
    ("agpl-3.0", "under the terms of the [gnu affero general public license] as published by the free software foundation"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification [are permitted] provided that the following conditions are met"),
    ("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    ("unlicense", "this is free and unencumbered software [released into the public domain]"),
    ("cc0-1.0", "licensed under [cc0 1 0]"),
    ("cc-by-4.0", "licensed under [cc by 4 0]"),
    ("cc-by-sa-4.0", "licensed under [cc by sa 4 0]"),
    ("cc-by-nc-4.0", "licensed under [cc by nc 4 0]"),
    ("cc-by-nd-4.0", "licensed under [cc by nd 4 0]"),
    ("cc-by-nc-sa-4.0", "licensed under [cc by nc sa 4 0]"),
    ("cc-by-4.0", "licensed under a [creative commons attribution 4 0 international] license"),
    ("cc-by-sa-4.0", "licensed under a [creative commons attribution sharealike 4 0 international] license"),
)
#: Anchors of a template, and how many of them must agree on where it begins.
ANCHORS = 4
AGREE = 2
#: The least share of a template's rarity that must stand in its place.
SHARE = 0.6

#: Capital letters, and the characters between words.
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "".join(map(chr, (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))))


def words(text: str) -> Column:
    """The lower-cased words of a text as an array; null and wordless texts have none."""
    plain = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _CAPITALS + _BETWEEN, _SMALL + " " * len(_BETWEEN))
    return F.array_remove(F.split(plain, " "), "")


def _template(text: str) -> tuple[list[str], list[tuple[int, list[str]]]]:
    """A template's words, and its key phrases with where they begin."""
    out: list[str] = []
    keys: list[tuple[int, list[str]]] = []
    for k, part in enumerate(text.replace("]", "[").split("[")):
        if k % 2:
            keys.append((len(out), part.split()))
        out += part.split()
    return out, keys


def rarity(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> dict[str, float]:
    """ln((1 + documents) / (1 + documents with the word)) for each word of the templates; all documents are counted."""
    vocabulary = sorted({w for _, text in templates for w in _template(text)[0]})
    held = docs.select(F.explode_outer(F.array_intersect(words("text"), F.lit(vocabulary))).alias("w"))
    counts = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each word of the templates at most
    total = docs.count()
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in vocabulary}


def _at(base: Column, k: int) -> Column:
    return F.get(F.col("w"), base + k)


def _phrase_at(start: Column, phrase: list[str]) -> Column:
    same = [F.coalesce(_at(start, k) == w, F.lit(False)) for k, w in enumerate(phrase)]
    out = same[0]
    for x in same[1:]:
        out = out & x
    return out


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """`keep`, n_words, n_base, first_word, last_word, base_labels, labels, score, notices; one row per row.

    notices: label, start (in words, from 0), share of the confirmed templates, by start; score: the largest share, 0
    without any. Null texts are empty; they and texts without a notice have empty labels and null places. Repeated rows
    have equal results. A long text is one row's work, linear but for sorting its anchors. An empty table gives an empty
    table.
    """
    rare = rarity(docs, templates)
    parsed = [(label, *_template(text)) for label, text in templates]
    postings: dict[str, list[tuple[int, int]]] = {}
    need: list[int] = []
    for t, (_, text, _) in enumerate(parsed):
        # a word's first place stands for it: by falling rarity, then place
        anchors = sorted({w: k for k, w in reversed(list(enumerate(text)))}.items(), key=lambda x: (-rare[x[0]], x[1]))[:ANCHORS]
        need.append(min(AGREE, len(anchors)))
        for w, k in anchors:
            postings.setdefault(w, []).append((t, k))
    heads = {phrase.split()[0] for phrase in BASE}
    known = sorted({*postings, *heads})
    lists = F.create_map(*(x for w, found in sorted(postings.items()) for x in (F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(k).alias("k")) for t, k in found)))))

    split = docs.select(F.struct(*keep).alias("row"), words("text").alias("w"))
    # the lookup: anchors and first words of base phrases, with their places
    hits = F.filter(F.transform("w", lambda w, i: F.when(w.isin(known), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull())
    looked = split.select("row", "w", hits.alias("hits"))

    def places_of(phrase: list[str]) -> Column:
        return F.transform(F.filter("hits", lambda h: (h["w"] == phrase[0]) & _phrase_at(h["i"], phrase)), lambda h: h["i"])

    begins = F.flatten(F.transform("hits", lambda h: F.coalesce(F.transform(lists[h["w"]], lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["k"]).alias("at"))), F.array().cast("array<struct<t:int,at:int>>"))))
    voted = looked.select("row", "w", *(places_of(phrase.split()).alias(f"base_{k}") for k, phrase in enumerate(BASE)), F.array_sort(begins).alias("votes"))
    needs = F.array(*(F.lit(x) for x in need))
    # equal votes stand side by side: the first of enough of them is a candidate
    agreed = F.filter("votes", lambda v, i: (F.coalesce(F.get("votes", i - 1) != v, F.lit(True))) & F.coalesce(F.get("votes", i + F.get(needs, v["t"]) - 1) == v, F.lit(False)))
    voted = voted.withColumn("candidates", agreed)

    def confirmed(t: int, at: Column) -> Column:
        label, text, keys = parsed[t]
        ok = at >= 0
        for k, phrase in keys:
            ok = ok & _phrase_at(at + k, phrase)
        total = sum(rare[w] for w in text) or 1.0
        found = F.lit(0.0)
        for k, w in enumerate(text):
            found = found + F.when(_at(at, k) == w, F.lit(rare[w] if any(rare[x] for x in text) else 1.0 / len(text))).otherwise(F.lit(0.0))
        share = F.least(found / F.lit(total), F.lit(1.0))
        return F.when(ok & (share >= SHARE), F.struct(F.lit(label).alias("label"), at.alias("start"), share.alias("share")))

    def confirm(c: Column) -> Column:
        out = F.when(c["t"] == 0, confirmed(0, c["at"]))
        for t in range(1, len(parsed)):
            out = out.when(c["t"] == t, confirmed(t, c["at"]))
        return out

    notices = F.array_sort(F.filter(F.transform("candidates", confirm), lambda x: x.isNotNull()), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0))
    done = voted.withColumn("notices", notices)
    places = F.concat(*(F.col(f"base_{k}") for k in range(len(BASE))))
    own = [F.when(F.size(f"base_{k}") > 0, F.lit(label)) for k, label in enumerate(BASE.values())]
    base_labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*own))))
    labels = F.array_sort(F.array_union(base_labels, F.transform("notices", lambda x: x["label"])))
    return done.select(
        "row.*",
        F.size("w").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("notices", lambda x: x["share"])), F.lit(0.0)).alias("score"),
        "notices",
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("notices")
