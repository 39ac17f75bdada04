"""Substring dedup over words: seed and extend.

Seeds are winnowed anchors: of every window of 50 words the leftmost
smallest-hash 20-gram, so that two equal windows always share a seed. Seeds join
documents on the anchor. A seed whose neighbourhood (block) is the same in a
smaller document extends over all of it and is settled at once; where neighbourhoods differ, each
extension of the seed to the left and right that makes up a window is matched against the
smallest document that has the same extension. Windows matched in a smaller
document merge into maximal repeats, all of them at least one window long.

Seeds only bring documents together. What is removed is confirmed by a BLAKE2 digest of the
words of the whole extension, so words that the anchors' hash confuses are not removed.

No pairs are made: every step keeps the smallest document of a key, and the
rows that are *not* first are known by their absence, so a passage in a
third of all documents is never joined back to each of its copies. A hot seed leaves each task once.

Cases: a null or empty text has no words and loses none; a text under one
window loses none; rows with a null doc_id are passed through and remove nothing;
rows that repeat a doc_id don't remove each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Combiner, covered, digests, find_blocks, span_count, word_symbols
from .common import list_of_longs, long_column, text_chunks

_SEEDS = "anchor long, body long, doc_id long"
_WINDOWS = "anchor long, extent long, doc_id long"


def _scan(batches, length, gram):
    """(batch, first row, end row, tokens of each row, word offsets of the rows, blocks, slices) of each run of rows.

    slices(first, end) gives the words between two places joined by one space, for arrays of places.
    """
    for batch in batches:
        for row, end, data, at in text_chunks(batch, "text"):
            symbols, words = word_symbols(data, at)
            raw = data.tobytes()
            tokens = [raw[x:y].split() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            line = b" ".join([t for own in tokens for t in own])
            place = np.append(0, np.cumsum(np.fromiter((len(t) + 1 for own in tokens for t in own), np.int64, len(symbols))))

            def slices(first, last, line=line, place=place):
                return [line[x:y] for x, y in zip(place[first].tolist(), (place[last] - 1).tolist(), strict=True)]

            yield batch, row, end, tokens, words, find_blocks(symbols, words, length, gram), slices


def _bodies(b, slices, chosen, length):
    """Digest of all the words that the windows of each block cover."""
    return digests(slices(b.start[chosen], b.start[chosen] + b.windows[chosen] - 1 + length))


def _seeds(length: int, gram: int):
    def scan(batches):
        combiner = Combiner()
        for batch, row, end, _, _, b, slices in _scan(batches, length, gram):
            ids, body = long_column(batch, "doc_id")[row:end][b.row], _bodies(b, slices, slice(None), length)
            # Within the run, only the smallest document of a block.
            order = np.lexsort((ids, body, b.anchor))
            anchor, body, ids = b.anchor[order], body[order], ids[order]
            first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (body[1:] != body[:-1]))) if len(order) else np.zeros(0, np.int64)
            many = np.diff(np.append(first, len(order))) > 1
            anchor, body, ids = anchor[first], body[first], ids[first]
            keep = combiner.news((anchor, body), (ids,), many)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (anchor, body, ids)], ["anchor", "body", "doc_id"])

    return scan


def _position(values: np.ndarray, within: pa.ListArray, k: int) -> np.ndarray:
    """Which values are in the k-th list (null: none are)."""
    own = within[k].values if within[k].is_valid else None
    return np.isin(values, own.to_numpy(zero_copy_only=False)) if own is not None and len(own) else np.zeros(len(values), bool)


def _windows(b, slices, mask, length):
    """(block, start) of every window of the chosen blocks, and the digest of its words: an extension of the block's seed to both sides."""
    chosen = np.flatnonzero(mask)
    count = b.windows[chosen]
    block = np.repeat(chosen, count)
    start = np.repeat(b.start[chosen], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return block, start, digests(slices(start, start + length))


def _open(length: int, gram: int):
    """The extensions (windows) of seeds whose neighbourhoods differ between documents."""

    def scan(batches):
        for batch, row, end, _, _, b, slices in _scan(batches, length, gram):
            ids, undecided = long_column(batch, "doc_id"), batch.column("undecided")
            mask = np.zeros(len(b.row), bool)
            for k in range(row, end):
                if undecided[k].is_valid and len(undecided[k].values):
                    own = slice(*np.searchsorted(b.row, [k - row, k - row + 1]))
                    mask[own] = _position(_bodies(b, slices, own, length), undecided, k)
            block, _, extent = _windows(b, slices, mask, length)
            rows = np.unique(np.stack([b.anchor[block], extent, ids[row:end][b.row[block]]]), axis=1) if len(block) else np.zeros((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["anchor", "extent", "doc_id"])

    return scan


def _finish(length: int, gram: int, spans: bool):
    def scan(batches):
        for batch, row, end, tokens_of, words, b, slices in _scan(batches, length, gram):
            out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "n_repeats": [], "repeats": []}
            known, settled, undecided, first = (batch.column(c) for c in ("doc_id", "settled", "undecided", "first_windows"))
            for k in range(row, end):
                i = k - row
                own = slice(*np.searchsorted(b.row, [i, i + 1]))
                tokens = tokens_of[i]
                gone = np.zeros(len(tokens), bool)
                if own.start < own.stop and known[k].is_valid:
                    body = _bodies(b, slices, own, length)
                    keep, look = _position(body, settled, k), _position(body, undecided, k)
                    drop = np.zeros(len(b.row), bool)
                    drop[own] = ~keep & ~look
                    begin, stop = b.start[drop], b.start[drop] + b.windows[drop] - 1 + length
                    if look.any():
                        mask = np.zeros(len(b.row), bool)
                        mask[own] = look
                        _, start, extent = _windows(b, slices, mask, length)
                        start = start[~_position(extent, first, k)]
                        begin, stop = np.append(begin, start), np.append(stop, start + length)
                    if len(begin):
                        gone = covered(begin - words[i], stop - words[i], len(tokens))
                kept = compress(tokens, ~gone) if gone.any() else tokens
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8)))
                for name, value in (("doc_id", known[k].as_py()), ("n_words", len(tokens)), ("n_removed", int(gone.sum())), ("kept_sha256", hashlib.sha256(b" ".join(kept)).hexdigest()), ("n_repeats", span_count(gone)), ("repeats", edges.reshape(-1, 2).tolist())):
                    out[name].append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.list_(pa.int64()))]
            arrays = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays if spans else arrays[:5], list(out) if spans else list(out)[:5])

    return scan


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, gram: int = 20, spans: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, n_repeats (maximal removed runs).

    With `spans`, also `repeats`: the [first word, end) of every maximal repeat.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seeds = docs.where("doc_id is not null").mapInArrow(_seeds(length, gram), _SEEDS)
    # One exchange by anchor serves both windows; a block's own rows lie inside an anchor's.
    first = (
        seeds.repartition("anchor")
        .withColumn("n", F.row_number().over(Window.partitionBy("anchor", "body").orderBy("doc_id")))
        .where("n = 1")
        .withColumn("contexts", F.count("*").over(Window.partitionBy("anchor")))
    )
    lists = first.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("contexts") == 1, F.col("body"))).alias("settled"),
        F.collect_list(F.when(F.col("contexts") > 1, F.col("body"))).alias("undecided"),
    )
    # Read by both steps below in the same form, so that its exchanges, that of the texts above all, run once.
    seeded = docs.join(lists, "doc_id", "left")
    extensions = seeded.mapInArrow(_open(length, gram), _WINDOWS)
    smallest = extensions.groupBy("anchor", "extent").agg(F.min("doc_id").alias("doc_id"))
    first_windows = smallest.groupBy("doc_id").agg(F.collect_list("extent").alias("first_windows"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_repeats long" + ", repeats array<array<long>>" * spans
    return seeded.join(first_windows, "doc_id", "left").mapInArrow(_finish(length, gram, spans), schema)
