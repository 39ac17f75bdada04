"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

A document's set holds the hashes of its 5-word shingles. Its SuperMinHash signature gives each
element a random permutation of the registers and one random rank per step; because the steps
of an element hit different registers, estimates vary less than with independent
minima, and the steps end as soon as no register can still fall. Bands of the
signature make buckets.

1. Documents with one and the same set are merged first (a tree merge over set digests).
2. In each bucket every member is compared with the smallest one, on full sets. Links join
   documents into components.
3. The members of buckets that still hold two components are sieved by prefixes: with the
   shingles of all sets in one order, the rarest first, two linked sets share one of the
   first (1 - 6/7) of the smaller and of the first quarter of the larger one (for a threshold of 0.75).
   A document whose prefix meets no other component goes. Documents on one template don't meet
   by the template: if what is their own is too little to fill the prefix, they are linked.
   Those left meet in bounded blocks, and only pairs of different components are compared.
4. Links of both steps make the components, each named by its smallest id.

Buckets are never expanded into all pairs, and no step needs the rows of one key together
unless they are bounded (blocks) or combined before the shuffle (minima, counts). Shingles are hashed modulo a prime of 61 bits.

A pair at the threshold itself shares no band with a probability of 1e-6 (36 bands of 4
rows), a closer one with less; all that shares one is compared on full sets.

Cases: texts without words (null, empty) have an empty set and are linked with nothing; fewer
words than a shingle make one shingle; ties go to the smallest id; rows that repeat an id
are one node; a row with a null id is its own component; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import RunHash, scramble, word_symbols
from .common import connected_components, if_small, long_column, materialise, text_chunks
from .exact_dedup import tree_merge

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Counters of the table by which shingles are ordered: 8 MB, whatever the corpus.
COUNTER_BITS = 20
#: Pairs of one document that share a copy of its set.
HUB_PAIRS = 1000
#: Shingles of one side of a pair of blocks that a task compares, unless one set alone has more (16 MB).
SHINGLES_PER_BLOCK = 2_000_000


def shingle_sets(batch: pa.RecordBatch, size: int):
    """(row, sorted distinct shingle hashes) of each row of a batch with a `text`."""
    for row, end, data, at in text_chunks(batch, "text"):
        symbols, words = word_symbols(_LOWER[data], at)
        run = RunHash(symbols)
        grams = run.grams(size) if len(symbols) >= size else np.zeros(0, np.uint64)
        for k in range(end - row):
            lo, hi = int(words[k]), int(words[k + 1])
            if hi - lo >= size:
                yield row + k, np.unique(grams[lo : hi - size + 1])
            else:
                yield row + k, run.of(np.array([lo]), np.array([hi])) if hi > lo else np.zeros(0, np.uint64)


def superminhash(elements: np.ndarray, registers: int, piece: int = 1 << 15) -> np.ndarray:
    """The signature: per register the least (step + rank) over all elements.

    Step by step for all elements at once; a step can give no less than its own number, so
    the steps end once every register is below the next.
    """
    least = np.full(registers, np.inf)
    for lo in range(0, len(elements), piece):
        own = elements[lo : lo + piece]
        rows = np.arange(len(own))
        order = np.tile(np.arange(registers, dtype=np.int16), (len(own), 1))
        for step in range(registers):
            if least.max() < step:
                break
            u = scramble(own + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            rank = (u >> np.uint64(11)) * 2.0**-53
            swap = step + ((scramble(u ^ _STEP) >> np.uint64(32)) * np.uint64(registers - step) >> np.uint64(32)).astype(np.int64)
            hit = order[rows, swap]
            order[rows, swap] = order[:, step]
            order[:, step] = hit
            np.minimum.at(least, hit, rank + step)
    return least


def bucket_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One hash per band of the signature."""
    part = signature.view(np.uint64).reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64)
    for k in range(part.shape[1]):
        key = scramble(key * _STEP + part[:, k])
    return key.view(np.int64)


def _profile(size: int, bands: int, rows: int):
    def scan(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for _, own in shingle_sets(batch, size):
                digest = np.frombuffer(hashlib.sha256(own.tobytes()).digest()[:16], np.int64).tolist()
                keys = bucket_keys(superminhash(own, bands * rows), bands).tolist() if len(own) else []
                for to, value in zip(out, (len(own), *digest, keys), strict=True):
                    to.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], ["doc_id", "n_shingles", "d1", "d2", "keys"])

    return scan


def _sets(size: int):
    def scan(batches):
        for batch in batches:
            sets = [own.tobytes() for _, own in shingle_sets(batch, size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return scan


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent: int):
    def scan(batches):
        for batch in batches:
            sets = [[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("a_set", "b_set")]
            keep = pa.array([_linked(x, y, percent) for x, y in zip(*sets, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return scan


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (scramble(shingles) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often each counter's shingles stand in the sets: a table of fixed size, merged from the counts of each batch."""

    def scan(batches):
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("shingles")]
            counter, n = np.unique(_bucket(np.concatenate(own)), return_counts=True) if own else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(counter), pa.array(n.astype(np.int64))], ["counter", "n"])

    total = np.zeros(1 << COUNTER_BITS, np.int64)
    for row in sets.mapInArrow(scan, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toLocalIterator():
        total[row.counter] = row.n
    return total


def _prefixes(percent: int, total: np.ndarray):
    """The rarest shingles of each set: `found` ones, of which a set at least as large shares one if the two are linked, and `sought` ones, for smaller sets."""

    def scan(batches):
        for batch in batches:
            ids, labels, out = long_column(batch, "doc_id"), long_column(batch, "label"), [[], [], [], [], []]
            for doc, label, raw in zip(ids, labels, batch.column("shingles"), strict=True):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                n, count = len(own), total[_bucket(own)]
                order = np.lexsort((own, count))
                # A linked set as large or larger shares 2 percent / (100 + percent) of it, a smaller one `percent`.
                small, large = n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1
                chosen = order[:large]
                for to, value in zip(out, (own[chosen].view(np.int64), np.full(large, doc), np.full(large, label), np.full(large, n), np.arange(large) < small), strict=True):
                    to.append(value)
            kinds = (np.int64, np.int64, np.int64, np.int64, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, t)) for x, t in zip(out, kinds, strict=True)], ["shingle", "doc_id", "label", "n", "found"])

    return scan


def _block_links(percent: int, width: int = 4096):
    """Links between different components inside one pair of blocks; at most one per two components."""

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        ids, label = group.doc_id.to_numpy(), group.label.to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group.shingles]
        size = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[inverse] > 1
        number = np.cumsum(count > 1) - 1
        column, owner = number[inverse[shared]], owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        both = np.zeros((len(sets), len(sets)))  # sums of whole numbers: 32 bits would round 100 times the common shingles of large sets
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            x, y = np.searchsorted(column, [lo, lo + width])
            part = np.zeros((len(sets), width), np.float32)
            part[owner[x:y], column[x:y] - lo] = 1
            both += part @ part.T
        ok = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        a, b = np.nonzero(np.triu(ok & (label[:, None] != label[None, :]), 1))
        found = pd.DataFrame({"a": ids[a], "b": ids[b], "x": label[a], "y": label[b]})
        return found.drop_duplicates(["x", "y"])[["a", "b"]]

    return solve


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, bands: int = 36, rows: int = 4, block: int = 256) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id it is linked to), kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    profile = materialise(docs.mapInArrow(_profile(shingle, bands, rows), "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>"))
    filled = profile.where("n_shingles > 0 AND doc_id IS NOT NULL")
    merged = materialise(tree_merge(filled.select("doc_id", "n_shingles", "d1", "d2"), ["d1", "d2"], "doc_id").select("doc_id", "n_shingles", F.col("keep_id").alias("rep")))

    links = _links(docs, filled, merged.where("doc_id = rep").select("doc_id").distinct(), shingle, percent, block)
    component = connected_components(links).withColumnRenamed("id", "rep")
    named = merged.join(component, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    rest = profile.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _verified(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked on their full sets.

    A document may be `a` of many pairs: its set is laid beside them in copies, one for each HUB_PAIRS of them.
    """
    many = candidates.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).alias("copies")).where("copies > 1")
    many = materialise(many)
    pairs = candidates.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("b_set")), "b")
    pairs = pairs.join(if_small(many), "a", "left").withColumn("copy", F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(1)))).drop("copies")
    copies = sets.join(if_small(many.withColumnRenamed("a", "doc_id")), "doc_id", "left").withColumn("copy", F.explode(F.expr("sequence(0L, coalesce(copies, 1L) - 1)")))
    pairs = pairs.join(copies.select(F.col("doc_id").alias("a"), "copy", F.col("shingles").alias("a_set")), ["a", "copy"])
    return materialise(pairs.select("a", "b", "a_set", "b_set").mapInArrow(_verify(percent), "a long, b long"))


def _links(docs: DataFrame, profile: DataFrame, reps: DataFrame, shingle: int, percent: int, block: int) -> DataFrame:
    """(a, b): links between documents of different sets, enough to connect what is connected."""
    members = profile.join(reps, "doc_id", "left_semi").select("doc_id", F.explode("keys").alias("key"))
    # A bucket's smallest member: minima combine before the shuffle.
    multi = materialise(members.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last").select("key", "hub"))
    buckets = materialise(members.join(multi, "key").select("key", "doc_id", "hub"))
    candidates = materialise(buckets.where("doc_id != hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct())
    if candidates.isEmpty():
        return candidates

    involved = candidates.select(F.col("a").alias("doc_id")).union(candidates.select("b")).distinct()
    sets = materialise(docs.join(involved, "doc_id", "left_semi").mapInArrow(_sets(shingle), "doc_id long, shingles binary"))
    links = _verified(candidates, sets, percent)

    labels = connected_components(links).withColumnRenamed("id", "doc_id")
    labelled = materialise(buckets.join(labels, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("label")))
    open_docs = _unresolved(labelled).select("doc_id", "label").distinct()
    own = materialise(sets.join(open_docs, "doc_id").select("doc_id", "label", "shingles"))
    if own.isEmpty():
        return links
    rare = materialise(own.mapInArrow(_prefixes(percent, _frequencies(own)), "shingle long, doc_id long, label long, n long, found boolean"))
    # Only documents with a shingle that stands in the prefixes of two components can have a link to add.
    mixed = rare.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.max("found").alias("any")).where("x < y AND any").select("shingle")
    can = rare.join(mixed, "shingle", "left_semi").select("doc_id").distinct()
    open_rows = materialise(_unresolved(materialise(labelled.join(can, "doc_id", "left_semi"))))
    if open_rows.isEmpty():
        return links

    hubs = open_rows.groupBy("key").agg(F.min("doc_id").alias("a"))
    near = open_rows.join(hubs, "key").select("a", F.col("doc_id").alias("b")).where("a != b").distinct()
    family = connected_components(near).select(F.col("id").alias("doc_id"), F.col("component").alias("family"))
    rows = family.join(open_rows.select("doc_id", "label").distinct(), "doc_id")
    # A block has `block` sets and SHINGLES_PER_BLOCK shingles on average, whichever is less.
    weight = rows.join(sets.select("doc_id", (F.octet_length("shingles") / 8).alias("n")), "doc_id")
    count = weight.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n") / SHINGLES_PER_BLOCK)).alias("parts"))
    placed = rows.join(if_small(count), "family").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    placed = placed.select("doc_id", "label", "family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).join(sets, "doc_id")
    more = placed.groupBy("family", "i", "j").applyInPandas(_block_links(percent), "a long, b long")
    return links.unionByName(materialise(more))


def _unresolved(rows: DataFrame) -> DataFrame:
    """The rows (key, doc_id, label) of the buckets that hold two components or more."""
    keys = rows.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    return rows.join(materialise(keys), "key", "left_semi")
