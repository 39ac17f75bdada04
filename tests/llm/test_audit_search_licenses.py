"""Filter audit, ranked search and license scan against brute force."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import pytest

from sievework.llm import licenses
from sievework.llm.filter_audit import filter_audit
from sievework.llm.license_rules import BASE, rules
from sievework.llm.licenses import license_scan, license_spans, license_summary
from sievework.llm.ranked_search import ranked_search, terms_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {x for x, bad in (("A", len(words) < 200), ("B", 100 * len(set(words)) < 50 * len(words)), ("C", 100 * len(re.findall("[A-Z]", text)) > 2 * len(text)), ("D", bool(re.search(r"[#$%&*|]", text)))) if bad}
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows):
            f.add("E")
        fails.append((source or "", i, f))
    out = set()
    for part in {p for p, _, _ in fails}:
        mine = [(i, f) for p, i, f in fails if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            for _, f in mine:
                hit = [x for x in order if x in f]
                shapley.update(hit[:1])
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                redundant = sum(x in f for _, f in mine) - len(gone)
                out.add((part, "".join(order), step, len(left), len(gone), redundant, sum(f == {x} for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), shapley[x]))
    return out


def test_filter_audit(spark, rng):
    vocabulary = [f"w{k}" for k in range(300)] + ["Ab", "CD#", "é|"]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([3, 40, 303])]) for _ in range(rng.choice([0, 5, 190, 200, 260]))) for _ in range(25)] + [None, "", " \t"]
    rows = [(rng.choice([k, k % 20]), rng.choice(texts), rng.choice(["s0", "s0", "s1", "", None])) for k in range(150)]
    rows += [(None, rows[0][1], "s0"), (None, None, "s2"), rows[3], rows[3]]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 150, 2)] + [(4, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "doc_id long, text string, source string, part string, good string, mask int")
    found = filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    columns = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert {tuple(r[c] for c in columns) for r in found.collect()} == brute_audit(rows, labels)
    assert filter_audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def brute_search(docs, items, k=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    terms = [(i, words(t)) for i, t in docs]
    big_n, big_l = sum(bool(w) for _, w in terms), sum(len(w) for _, w in terms)
    df = Counter(t for _, w in terms for t in set(w))
    weight = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        asked, scored = Counter(words(text)), []
        for i, w in terms:
            tf, m = Counter(w), 75 + 25 * len(w) * big_n // max(big_l, 1)
            score = sum(c * weight[t] * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, c in asked.items() if t in tf)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_terms", [1 << 18, 12])
def test_ranked_search(spark, rng, block_terms):
    vocabulary = ["the"] * 60 + ["Über", "naïve", "x2", "B"] * 4 + [f"w{k}" for k in range(60)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "_", "·"]) for _ in range(n))
    docs = [(k % 390, text(rng.choice([0, 1, 3, 10, 40, 200]))) for k in range(400)] + [(1000, None), (1001, ""), (None, "w1 w2 über"), (1002, "w3 the " * 30000)]
    docs += [(2000 + k, docs[7][1]) for k in range(60)]
    items = [(k, text(rng.choice([1, 4, 12]))) for k in range(12)] + [(50, None), (51, "-- "), (52, "neverseen"), (53, "the the THE"), (None, "w5 w6")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, key string").repartition(6)
    found = ranked_search(frame, spark.createDataFrame(items, "item_id int, text string"), block_terms=block_terms)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str) == brute_search(docs, items)


def test_ranked_search_of_nothing(spark):
    docs, items = (spark.createDataFrame([(1, "a b")], f"{c} long, text string") for c in ("doc_id", "item_id"))
    assert ranked_search(docs.limit(0), items).count() == 0 and ranked_search(docs, items.limit(0)).count() == 0


def test_terms_in_pieces():
    text = "Ab_ÉX 12\x00q" * 50
    whole = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))
    for piece in (1, 7, 1000):
        assert [w.decode() for part in terms_of(text.encode(), piece) for w in part] == whole


def brute_licenses(text):
    """The same rules, tried without a prefilter, and pairs of detections compared one by one."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    base = [(i, label) for label, phrase in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found, line = [], " " + "  ".join(words) + " "
    for k, tier, label, keyword, pattern in rules():
        if all(w in words for w in keyword):
            for m in re.finditer(pattern, line):
                start = line[: m.start()].count("  ") + (m.start() > 0)
                found.append((start, start + m[1].count("  ") + 1, label, k, tier))
    kept = [f for f in found if not any(g[0] <= f[0] and g[1] >= f[1] and (g[4], f[1] - f[0] - g[1] + g[0], g[3]) < (f[4], 0, f[3]) and (g[4] < f[4] or g[1] - g[0] > f[1] - f[0] or g[3] < f[3]) for g in found if g is not f and g[4] <= f[4])]
    score = max([licenses.CONFIDENCE[f[4] - 1] for f in kept] + [licenses.CONFIDENCE[3]] * bool(base) + [0.0])
    at = sorted(i for i, _ in base)
    labels = sorted({label for _, label in base})
    return (len(words), len(base), at[0] if at else None, at[-1] if at else None, ",".join(labels), ",".join(sorted({*labels, *(f[2] for f in kept)})), score), kept


PIECES = [
    "GNU General Public License", "version 3", "or any later version", "Apache License, Version 2.0", "CC BY-NC-SA 4.0", "cc by cc by", "the MIT License", "GPLv2+", "LGPL-2.1", "SPDX-License-Identifier: MIT",
    "SPDX-License-Identifier: Foo-9", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "BSD 3-Clause", "all rights reserved",
    "Copyright (c) 2021", "émit license", "public domain", "Creative Commons Attribution-ShareAlike 3.0 Unported", "zlib/libpng license", "Kelvin İ", "This program is free software; you can redistribute it and/or modify it",
]


def test_licenses(spark, wide):
    rng = random.Random(5)
    rows = [(k, rng.choice([" ", "\n * ", ". "]).join(rng.choice(PIECES + ["some words here", "gnu", "license"]) for _ in range(rng.choice([1, 2, 6, 30])))) for k in range(200)]
    rows += [(500, ("word " * 3000 + "mit license ") * 40), (501, "gpl, " * 5000), (502, "licence")]
    rows, docs = wide(rows)
    found = {}
    for r in license_summary(docs).collect():
        found.setdefault(r.doc_id, []).append(tuple(r)[1:])
    expected = {}
    for i, t in rows:
        expected.setdefault(i, []).append(brute_licenses(t)[0])
    assert found == expected
    spans = sorted((r.doc_id, *tuple(r)[1:]) for r in license_spans(docs.where("doc_id < 200 AND doc_id > 0")).collect())
    assert spans == sorted((i, *f) for i, t in rows[:200] if i for f in brute_licenses(t)[1])
    carried = license_scan(docs.withColumn("base", docs.doc_id))
    assert carried.columns == [*docs.columns, "n_words", "base", "detections"] and license_scan(docs.limit(0)).count() == 0


def test_each_rule_fires_somewhere():
    assert len(rules()) > 200 and len({(label, p) for _, _, label, _, p in rules()}) == len(rules())
