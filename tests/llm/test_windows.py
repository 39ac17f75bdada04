"""Substring and suffix-array dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest

from sievework.llm.substring_dedup import substring_dedup
from sievework.llm.suffix_dedup import deep_shallow_sort, suffix_dedup


def by_words(rows, length):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first = {}
    for d, w in words.items():
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def by_bytes(rows, length):
    first = {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], (d, i))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] != (d, i):
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture
def passages(rng):
    words = [f"wé{i}" for i in range(30)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 300))) for _ in range(30)]
    rows = []
    for i in range(150):
        parts = (rng.choice(base)[rng.randint(0, 200) :][: rng.randint(0, 1500)] for _ in range(rng.randint(0, 4)))
        rows.append((i * 3, rng.choice([" ", "\n", "\t \x0b"]).join(parts) if i % 17 else None))
    return [*rows, (10**6, "ab " * 3000), (10**6 + 1, "x" * 4000 + " " + "ab " * 60), (7, "")]


@pytest.mark.parametrize("length, gram", [(50, 20), (12, 4)])
def test_substring_dedup(spark, passages, length, gram):
    df = spark.createDataFrame(passages, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, length=length, gram=gram).collect()}
    assert got == by_words(passages, length)


@pytest.mark.parametrize("length, gram", [(100, 40), (30, 8)])
def test_suffix_dedup(spark, passages, length, gram):
    df = spark.createDataFrame(passages, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, length=length, gram=gram).collect()}
    assert got == by_bytes(passages, length)


@pytest.mark.parametrize("length, shallow", [(100, 48), (20, 8), (7, 48), (64, 64)])
def test_deep_shallow_sort(rng, length, shallow):
    base = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(4)]
    data = b"".join(rng.choice(base) for _ in range(100)) + bytes(rng.choice(b"abc") for _ in range(2000))
    starts = np.array(sorted(rng.sample(range(len(data) - length + 1), 3000)))
    order, new = deep_shallow_sort(data, starts, length, shallow)
    found = [data[p : p + length] for p in starts[order]]
    assert sorted(order.tolist()) == list(range(3000)) and found == sorted(found)
    assert new.tolist() == [True] + [a != b for a, b in zip(found, found[1:], strict=False)]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_with_structure_are_told_apart(spark):
    """Words that every polynomial modulo a power of two confuses: the windows around them are no repeats."""
    x = thue_morse(2048)
    y = x.translate(str.maketrans("ab", "ba"))
    rows = [(i, " ".join([f"w{k}" for k in range(30)] + [w] + [f"v{k}" for k in range(30)])) for i, w in enumerate((x, y, x))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df).collect()} == by_words(rows, 50)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df).collect()} == by_bytes(rows, 100)


def test_very_long_text(spark, rng):
    """Over a million words in one row, which is cut into pieces inside."""
    base = " ".join(rng.choice("abcdefgh") for _ in range(1_060_000))
    rows = [(1, base), (2, "x " + base[1000:1400]), (3, base[2_110_000:] + " y " + base[:300])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, length=40, gram=16).collect()} == by_words(rows, 40)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df).collect()} == by_bytes(rows, 100)


@pytest.mark.parametrize("crowd", [1, 3])
def test_crowded_anchors(spark, passages, crowd):
    """Whatever the number of contexts from which anchors are split, the same bytes go."""
    df = spark.createDataFrame(passages, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, length=60, gram=20, crowd=crowd).collect()}
    assert got == by_bytes(passages, 60)


def test_spans_are_the_removed_runs(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, "a b " + text + " c")], "doc_id long, text string")
    rows = {r.doc_id: r for r in substring_dedup(df, spans=True).collect()}
    assert rows[1].repeats == [] and rows[2].repeats == [[2, 62]]
    rows = {r.doc_id: r for r in suffix_dedup(df, spans=True).collect()}
    assert rows[2].repeats == [[4, 4 + len(text)]] and rows[2].n_removed == len(text)


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
def test_awkward_rows(spark, wide, operator):
    rows, df = wide([(5, " ".join(f"w{i}" for i in range(80)))])
    out = [r.asDict() for r in operator(df).collect()]
    assert len(out) == len(rows) and all(r["n_removed"] == 0 for r in out if r["doc_id"] in (None, 900, 901, 902))
    assert operator(df.limit(0)).count() == 0


def test_repeated_rows_keep_their_words(spark, wide):
    _, df = wide([(5, " ".join(f"w{i}" for i in range(80)))])
    assert [r.n_removed for r in substring_dedup(df).where("doc_id = 5").collect()] == [0, 0]
