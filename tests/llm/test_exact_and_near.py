"""Exact, near and line dedup against brute force."""

import collections
import hashlib
import random
import re
import string

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.llm import near_dedup as near
from sievework.llm.exact_dedup import exact_dedup
from sievework.llm.line_dedup import line_dedup, within_edits
from sievework.llm.near_dedup import near_dedup, superminhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def components(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def families(rng, n=25):
    rows, at = [], 0
    for _ in range(n):
        base = [f"{rng.choice('abc')}{rng.randint(0, 9999)}" for _ in range(rng.choice([3, 12, 60, 200]))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8]) * len(base) // 100 + rng.randint(0, 1)):
                words[rng.randrange(len(words))] = "Edit%d" % rng.randint(0, 99999)
            rows.append((at * 2, rng.choice([" ", "\n"]).join(words)))
            at += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hub_pairs, block", [(1000, 256), (2, 4)])
def test_near_dedup(spark, rng, monkeypatch, hub_pairs, block):
    monkeypatch.setattr(near, "HUB_PAIRS", hub_pairs)
    rows = [*families(rng), (1001, None), (1003, ""), (1005, "Solo Words"), (1007, "solo words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = near_dedup(df, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_links_beside_the_smallest_member(spark):
    """A chain: each text is near the next one, not near the first."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 25 : i * 25 + 200])) for i in range(6)]
    out = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {d: c for d, (_, c) in components(rows).items()}


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_with_structure_are_told_apart(spark):
    """Strings that every polynomial modulo a power of two confuses."""
    x = thue_morse(2048)
    y = x.translate(str.maketrans("ab", "ba"))
    out = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id long, text string")).collect()}
    assert out == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("own", [12, 20])
def test_templated_documents(spark, own):
    """One template around words of a document's own: linked or not, as brute force says."""
    head = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(head[:50] + [f"d{i}x{k}" for k in range(own)] + head[50:])) for i in range(40)]
    rows += [(100 + i, " ".join([f"e{i % 3}x{k}" for k in range(own)] + head)) for i in range(6)]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == components(rows)


def test_block_links_at_the_threshold_of_large_sets():
    """100 times 700,005 common shingles is no 32-bit float; 4/3 as many in the union is exactly 0.75."""
    both, more = np.arange(700_005), np.arange(700_005, 933_340)
    a, b = np.concatenate([both, more[:100_000]]), np.concatenate([both, more[100_000:]])
    group = lambda x, y: pd.DataFrame({"doc_id": [1, 2], "label": [1, 2], "shingles": [z.astype(np.uint64).tobytes() for z in (x, y)]})
    assert len(near._block_links(75)(group(a, b))) == 1
    assert len(near._block_links(75)(group(a, np.append(b, 10**7)))) == 0


def test_superminhash_estimates(rng):
    a = np.random.default_rng(1).integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], np.random.default_rng(2).integers(0, 2**63, 100, dtype=np.uint64)])
    x, y = superminhash(a, 512), superminhash(b, 512)
    assert abs((x == y).mean() - 300 / 500) < 0.07
    assert (superminhash(a[::-1].copy(), 512) == x).all() and np.isfinite(superminhash(a[:2], 512)).all()


def test_exact_dedup(spark, rng):
    texts = ["a b", "a\tb", "a  b ", "", None, " ", "A b", "a b\n"]
    rows = [(i, rng.choice(texts)) for i in rng.sample(range(1000), 60)]
    norm = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t in rows}
    group = collections.defaultdict(list)
    for d, t in norm.items():
        group[t].append(d)
    out = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), runs=16).collect()
    assert len(out) == 60
    for r in out:
        own = group[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(own), len(own), r.doc_id == min(own))
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutate(rng, s, n):
    s = list(s)
    for _ in range(n):
        how, k = rng.randrange(3), rng.randrange(len(s) + 1)
        if how == 0:
            s.insert(k, rng.choice("abé"))
        elif s:
            s[min(k, len(s) - 1) : min(k, len(s) - 1) + 1] = [] if how == 1 else rng.choice("abé")
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    rows = []
    for _ in range(200):
        a = "".join(rng.choice("abé") for _ in range(rng.choice([0, 3, 20, 40, 90, 200])))
        rows.append((a, mutate(rng, a, rng.randint(0, 5))))
    out = spark.createDataFrame(rows, "a string, b string").select("a", "b", F.expr(within_edits("a", "b", edits)).alias("w")).collect()
    assert all(r.w == (edit_distance(r.a, r.b) <= edits) for r in out)


@pytest.mark.parametrize("edits, crowd", [(1, 32), (1, 1), (2, 1)])
def test_line_dedup(spark, edits, crowd):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 9))) for _ in range(50)]
    rows = [(i * 2, "\n".join(mutate(rng, rng.choice(lines), rng.choice([0, 0, 0, 1, 1, 2])) for _ in range(rng.randint(0, 8)))) for i in range(80)]
    rows.append((1, None))
    strip = lambda x: x.strip(" \t\r")
    keys = sorted({strip(x) for _, t in rows if t for x in t.split("\n") if len(strip(x)) >= 16})
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if abs(len(a) - len(b)) <= edits and edit_distance(a, b) <= edits:
                root[find(a)] = find(b)
    seen, expected = set(), {}
    for d, t in sorted(rows):
        kept = []
        for x in t.split("\n") if t is not None else []:
            own = find(strip(x)) if strip(x) in root else None
            if own is None or own not in seen:
                kept.append(x)
            seen.add(own)
        n = len(t.split("\n")) if t is not None else 0
        expected[d] = ("\n".join(kept) if t is not None else None, n, n - len(kept))
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), edits=edits, crowd=crowd).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in out} == expected


def test_awkward_rows(spark, wide):
    rows, df = wide([(5, "one two three four five six seven\nanother line that is long enough")])
    for op in (exact_dedup, near_dedup, line_dedup):
        out = op(df).collect()
        assert len(out) == len(rows)
        assert op(df.limit(0)).count() == 0
    clash = df.selectExpr("doc_id", "text AS body", "1 AS _id", "2 AS _gone", "3 AS gone", "'row' AS `row`", "'t' AS text")
    out = line_dedup(clash, text_col="body")
    assert out.columns == [*clash.columns, "n_lines", "n_removed"] and out.where("_id = 1 AND _gone = 2 AND gone = 3 AND row = 'row' AND text = 't'").count() == len(rows)
    lines = line_dedup(df)
    assert lines.where("doc_id IS NULL AND n_removed = 0").count() == 1 and lines.where("doc_id = 5 AND n_removed = 0").count() == 2
    assert set(df.columns) <= set(lines.columns)
    assert near_dedup(df).where("doc_id = 5 AND component_id = 5 AND kept").count() == 2


def test_very_long_texts(spark, rng):
    """Texts of over a million characters, one of them a single line, are compared whole."""
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(160_000)]
    a, b, c = " ".join(words), " ".join([*words[:-1], "other"]), "\n".join(" ".join(words[i : i + 10]) for i in range(0, 40_000, 10))
    df = spark.createDataFrame([(1, a), (2, b), (3, a), (4, c), (5, c + "\nand one more line of its own")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert {r.doc_id: r.keep_id for r in exact_dedup(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    assert {r.doc_id: r.n_removed for r in line_dedup(df).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 4000}
