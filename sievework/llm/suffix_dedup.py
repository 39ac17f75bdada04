"""Substring dedup over bytes with a suffix array sorted deep-shallow.

Which 100-byte strings start earlier is read from the order of the suffixes
that start at them, compared to that depth. Two filters keep suffixes out of the sort: every
window belongs to a block around its anchor (the leftmost smallest-hash 40-gram); a block whose anchor
occurs nowhere else has no repeats, and blocks that are equal (by anchor and a BLAKE2 digest of all
their bytes) enter the array once, with their earliest place: the others start later in all their windows. The suffixes of all
other blocks are sorted per anchor: multikey quicksort on 8-byte characters down to a
shallow depth, then blind tries for the groups that share so long a prefix.
In the sorted array equal neighbours form a group; all but its earliest place are repeats.

An anchor with more than `crowd` contexts would make too large an array. Its windows go by a digest of their own
bytes instead, so equal ones still meet and are sorted; of those a task sends each once, and the earliest is told instead of the repeats.

The rows that are not the earliest are known by their absence, so hot strings
are never joined back to each place; the texts of blocks travel only
where two contexts of one anchor differ, one per context.

Cases: a null or empty text has no bytes and loses none; matches never cross
documents; a null doc_id is passed through and removes nothing; rows
that repeat a doc_id are judged by (doc_id, start) alone; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Combiner, RunHash, covered, digests, find_blocks, span_count
from .common import long_column, text_chunks

_SEEDS = "anchor long, body long, doc_id long, at long"
_OPEN = "key long, doc_id long, at long, windows int, single boolean, content binary"


def _scan(batches, length, gram):
    for batch in batches:
        for row, end, data, at in text_chunks(batch, "text"):
            yield batch, row, end, data, at, find_blocks(data, at, length, gram)


def _cut(raw: bytes, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    return [raw[x:y] for x, y in zip(first.tolist(), last.tolist(), strict=True)]


def _seeds(length: int, gram: int):
    def scan(batches):
        combiner = Combiner()
        for batch, row, end, data, at, b in _scan(batches, length, gram):
            ids, place = long_column(batch, "doc_id")[row:end][b.row], b.start - at[b.row]
            body = digests(_cut(data.tobytes(), b.start, b.start + b.windows - 1 + length))
            order = np.lexsort((place, ids, body, b.anchor))
            anchor, body, ids, place = b.anchor[order], body[order], ids[order], place[order]
            first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (body[1:] != body[:-1]))) if len(order) else np.zeros(0, np.int64)
            many = np.diff(np.append(first, len(order))) > 1
            anchor, body, ids, place = (x[first] for x in (anchor, body, ids, place))
            keep = combiner.news((anchor, body), (ids, place), many)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (anchor, body, ids, place)], ["anchor", "body", "doc_id", "at"])

    return scan


def _among(places: np.ndarray, lists: pa.ListArray, k: int) -> np.ndarray:
    own = lists[k].values if lists[k].is_valid else None
    return np.isin(places, own.to_numpy(zero_copy_only=False)) if own is not None and len(own) else np.zeros(len(places), bool)


def _open(length: int, gram: int):
    """The texts of blocks whose anchor has other contexts too; of blocks whose anchor has a crowd of them, each window for itself."""

    def scan(batches):
        combiner = Combiner()
        for batch, row, end, data, at, b in _scan(batches, length, gram):
            ids, undecided, crowded, raw = long_column(batch, "doc_id"), batch.column("undecided"), batch.column("crowded"), data.tobytes()  # a null id has no lists
            keep, split = [], []
            for k in range(row, end):
                lo, hi = np.searchsorted(b.row, [k - row, k - row + 1])
                for to, lists in ((keep, undecided), (split, crowded)):
                    if lists[k].is_valid and len(lists[k].values):
                        to.append(lo + np.flatnonzero(_among(b.start[lo:hi] - at[k - row], lists, k)))
            own = np.concatenate(keep) if keep else np.zeros(0, np.int64)
            yield _open_rows(b.anchor[own], ids[row:end][b.row[own]], b.start[own] - at[b.row[own]], b.windows[own], False, _cut(raw, b.start[own], b.start[own] + b.windows[own] - 1 + length))
            if split:
                block, start = _windows(b, np.concatenate(split))
                content = _cut(raw, start, start + length)
                key, doc, place = digests(content), ids[row:end][b.row[block]], start - at[b.row[block]]
                order = np.lexsort((place, doc, key))
                first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
                many, order = np.diff(np.append(first, len(order))) > 1, order[first]
                news = combiner.news((key[order],), (doc[order], place[order]), many)
                order = order[news]
                yield _open_rows(key[order], doc[order], place[order], np.ones(len(order), np.int64), True, [content[k] for k in order])

    return scan


def _windows(b, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, start) of every window of the chosen blocks."""
    count = b.windows[chosen]
    return np.repeat(chosen, count), np.repeat(b.start[chosen], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _open_rows(key, doc, place, windows, single: bool, content: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(key), pa.array(doc), pa.array(place), pa.array(windows.astype(np.int32)), pa.array(np.full(len(key), single)), pa.array(content, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "at", "windows", "single", "content"])


class BlindTrie:
    """Keys of equal length under the bits where they branch; nothing else of them is kept inside.

    A key is an integer of `bits` bits. A node is [bit, zero side, one side], a
    leaf is (key, members). Insertion goes down blindly by branching bits, then compares
    once with the leaf it met to find where the new key leaves the path.
    """

    def __init__(self, bits: int):
        self.top, self.bits = None, bits

    def add(self, key: int, member: int) -> None:
        node = self.top
        if node is None:
            self.top = (key, [member])
            return
        while type(node) is list:
            node = node[1 + (key >> node[0] & 1)]
        differ = node[0] ^ key
        if not differ:
            node[1].append(member)
            return
        bit = differ.bit_length() - 1
        parent, side, node = None, 0, self.top
        while type(node) is list and node[0] > bit:
            parent, side = node, 1 + (key >> node[0] & 1)
            node = node[side]
        leaf = (key, [member])
        new = [bit, node, leaf] if key >> bit & 1 else [bit, leaf, node]
        if parent is None:
            self.top = new
        else:
            parent[side] = new

    def in_order(self):
        """Lists of members with equal keys, in the order of keys."""
        stack = [self.top] if self.top is not None else []
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack += (node[2], node[1])
            else:
                yield node[1]


def deep_shallow_sort(data: bytes, starts: np.ndarray, length: int, shallow: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes at `starts` in the order of their first `length` bytes.

    Returns (the order, and where in it a string unlike the one before begins). Shallow: all groups of
    equal prefixes are sorted by their next character, of 8 bytes, until they are single or
    `shallow` bytes deep. Deep: of each group left, every distinct rest enters a blind trie.
    """
    raw = np.frombuffer(data + bytes(8), np.uint8)
    chars = np.zeros(len(raw) - 7, np.uint64)  # big-endian
    for k in range(8):
        chars = chars << np.uint64(8) | raw[k : len(raw) - 7 + k]
    n = len(starts)
    order, new = np.zeros(n, np.int64), np.zeros(n, bool)
    own, group, depth = np.arange(n), np.zeros(n, np.int64), 0  # a group is named by the place of its first member
    while len(own) and depth < min(shallow, length) // 8 * 8:
        key = chars[starts[own] + depth]
        by = np.lexsort((key, group))
        own, group, key = own[by], group[by], key[by]
        group, first, size = _split(group, np.append(True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])))
        single = np.repeat(size == 1, size)
        order[group[single]] = own[single]
        new[group[first]] = True
        own, group, depth = own[~single], group[~single], depth + 8
    if len(own):
        # Equal rests are found by hash, compared, and entered once.
        rest = RunHash(raw).of(starts[own] + depth, starts[own] + length)
        by = np.lexsort((rest, group))
        own, group, rest = own[by], group[by], rest[by]
        place = starts[own]
        differs = (group[1:] != group[:-1]) | (rest[1:] != rest[:-1])
        for at in [*range(depth, length - 7, 8), max(depth, length - 8)]:
            differs |= chars[place[1:] + at] != chars[place[:-1] + at] if length - at >= 8 else False
        first = np.flatnonzero(np.append(True, differs))
        last = np.append(first[1:], len(own))
        heads = np.flatnonzero(np.append(True, group[first][1:] != group[first][:-1]))
        for lo, hi in zip(heads.tolist(), np.append(heads[1:], len(first)).tolist(), strict=True):
            to = int(group[first[lo]])
            if hi - lo == 1:
                ranked = [[lo]]
            else:
                trie = BlindTrie(8 * (length - depth))
                for k, at in zip(range(lo, hi), place[first[lo:hi]].tolist(), strict=True):
                    trie.add(int.from_bytes(data[at + depth : at + length], "big"), k)
                ranked = trie.in_order()
            for same in ranked:
                new[to] = True
                for k in same:
                    order[to : to + last[k] - first[k]] = own[first[k] : last[k]]
                    to += int(last[k] - first[k])
    return order, new


def _split(group: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups renamed where a new one begins inside: (names by member, first members, sizes)."""
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(group)))
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    offset = np.arange(len(group)) - np.repeat(head, np.diff(np.append(head, len(group))))
    return np.repeat((group + offset)[first], size), first, size


def _repeats(length: int, shallow: int, target: int = 4 << 20):
    """Of rows sorted by key: each window of a block that also starts earlier, and of the single windows each that doesn't.

    Whole keys are held together, about `target` bytes of them.
    """

    def solve(rows):
        _, doc, place, count, single, content = rows
        data = b"".join(content)
        size = np.fromiter(map(len, content), np.int64, len(content))
        base = np.cumsum(size) - size
        block = np.repeat(np.arange(len(count)), count)
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts = base[block] + within
        order, new = deep_shallow_sort(data, starts, length, shallow)
        group = np.cumsum(new) - 1
        docs, places, alone = doc[block][order], place[block][order] + within[order], single[block][order] > 0
        rank = np.lexsort((places, docs, group))
        earliest = np.zeros(len(order), bool)
        earliest[rank[np.flatnonzero(np.append(True, np.diff(group[rank]) != 0))]] = True
        told = earliest == alone
        return pa.RecordBatch.from_arrays([pa.array(docs[told]), pa.array(places[told]), pa.array(alone[told])], ["doc_id", "at", "first"])

    def scan(batches):
        held, size, last = [], 0, None
        for batch in batches:
            cols = [long_column(batch, c) for c in ("key", "doc_id", "at", "windows", "single")] + [batch.column("content").to_pylist()]
            edges = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1])) if batch.num_rows else []
            for lo, hi in zip(edges, np.append(edges[1:], batch.num_rows), strict=True):
                if size > target and cols[0][lo] != last:
                    yield solve(_glue(held))
                    held, size = [], 0
                part = [c[lo:hi] for c in cols]
                held.append(part)
                size += sum(map(len, part[5]))
                last = cols[0][lo]
        if held:
            yield solve(_glue(held))

    return scan


def _glue(parts):
    return [np.concatenate([p[k] for p in parts]) for k in range(5)] + [[x for p in parts for x in p[5]]]


def _finish(length: int, gram: int, spans: bool):
    def scan(batches):
        for batch, row, end, data, at, b in _scan(batches, length, gram):
            known, settled, undecided, crowded, repeated, firsts = (batch.column(c) for c in ("doc_id", "settled", "undecided", "crowded", "repeated", "firsts"))
            out: list[list] = [[] for _ in range(6)]
            for k in range(row, end):
                i = k - row
                lo, hi = np.searchsorted(b.row, [i, i + 1])
                own = data[at[i] : at[i + 1]]
                gone = None
                if lo < hi and known[k].is_valid:
                    start = b.start[lo:hi] - at[i]
                    split = _among(start, crowded, k)
                    drop = ~(_among(start, settled, k) | _among(start, undecided, k) | split)
                    begin, stop = start[drop], start[drop] + b.windows[lo:hi][drop] - 1 + length
                    if repeated[k].is_valid:
                        more = repeated[k].values.to_numpy(zero_copy_only=False)
                        begin, stop = np.append(begin, more), np.append(stop, more + length)
                    if split.any():
                        more = _windows(b, lo + np.flatnonzero(split))[1] - at[i]
                        more = more[~_among(more, firsts, k)]
                        begin, stop = np.append(begin, more), np.append(stop, more + length)
                    if len(begin):
                        gone = covered(begin, stop, len(own))
                kept = own.tobytes() if gone is None else own[~gone].tobytes()
                edges = [] if gone is None else np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8))).reshape(-1, 2).tolist()
                row_out = (known[k].as_py(), len(own), len(own) - len(kept), 0 if gone is None else span_count(gone), hashlib.sha256(kept).hexdigest(), edges)
                for to, value in zip(out, row_out, strict=True):
                    to.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats"]
            n = 6 if spans else 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out[:n], kinds, strict=False)], names[:n])

    return scan


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 40, shallow: int = 48, crowd: int = 512, spans: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    With `spans`, also `repeats`: the [first byte, end) of every removed run. An anchor with more than `crowd` contexts is split into its windows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seeds = docs.where("doc_id is not null").mapInArrow(_seeds(length, gram), _SEEDS)
    first = (
        seeds.repartition("anchor")
        .withColumn("n", F.row_number().over(Window.partitionBy("anchor", "body").orderBy("doc_id", "at")))
        .where("n = 1")
        .withColumn("contexts", F.count("*").over(Window.partitionBy("anchor")))
    )
    lists = first.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("contexts") == 1, F.col("at"))).alias("settled"),
        F.collect_list(F.when(F.col("contexts").between(2, crowd), F.col("at"))).alias("undecided"),
        F.collect_list(F.when(F.col("contexts") > crowd, F.col("at"))).alias("crowded"),
    )
    # Read by both steps below in the same form, so that its exchanges, that of the texts above all, run once.
    seeded = docs.join(lists, "doc_id", "left")
    contexts = seeded.mapInArrow(_open(length, gram), _OPEN)
    repeats = contexts.repartition("key").sortWithinPartitions("key").mapInArrow(_repeats(length, shallow), "doc_id long, at long, first boolean")
    repeated = repeats.groupBy("doc_id").agg(F.collect_list(F.expr("IF(first, NULL, at)")).alias("repeated"), F.collect_list(F.expr("IF(first, at, NULL)")).alias("firsts"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", repeats array<array<long>>" * spans
    return seeded.join(repeated, "doc_id", "left").mapInArrow(_finish(length, gram, spans), schema)
