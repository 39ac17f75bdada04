"""Benchmark decontamination by greedy string tiling.

Seeds are grams of `min_match` tokens that a document shares with a benchmark item: a
filter of fixed size (one bit per hash) drops most document grams where they are read, the
rest join the benchmark's grams. A document and an item are a candidate if the shared seeds, each at
all its places in the item, can cover as many tokens as the threshold needs. For each candidate, running Karp-Rabin finds the longest
matches that don't overlap marked ones, marks them, and goes on with shorter ones down to
`min_match` tokens. The share of the item's tokens under tiles is its coverage; tiles may
come in any order, so a passage with its parts rearranged is caught too.

Tokens are runs of letters, digits and non-ASCII characters, ASCII letters in lower case.

Cases: null or empty texts and items share nothing; items with fewer than `min_match` tokens are
matched as a whole, anywhere in a document; repeated items are judged each, repeated documents give
repeated rows; documents without id are judged and carried only with `without_id`; other columns are ignored. Only the items that a document shares seeds
with are held beside it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import RunHash, _words
from .common import long_column, materialise, text_chunks

#: Bits of the seed filter: 2 MB, whatever the size of the benchmark.
FILTER_BITS = 1 << 24

_TOKEN = np.full(256, 32, np.uint8)
_TOKEN[48:58] = np.arange(48, 58)
_TOKEN[97:123] = np.arange(97, 123)
_TOKEN[65:91] = np.arange(97, 123)
_TOKEN[128:] = np.arange(128, 256)


def token_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, offset of each row's first token and the end)."""
    starts, hashes = _words(_TOKEN[data], at)
    return hashes, np.searchsorted(starts, at)


def _grams(tokens: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the grams of `size` tokens of all rows."""
    run, each = RunHash(tokens), np.maximum(0, np.diff(words) - size + 1)
    row = np.repeat(np.arange(len(each)), each)
    start = words[row] + np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    return run.of(start, start + size).view(np.int64), row


def _item_grams(size: int):
    """(gram, item_id, places, tokens): the distinct grams of each item, with their places in it; a shorter item gives one for all of it."""

    def scan(batches):
        for batch in batches:
            ids = long_column(batch, "item_id")
            for row, end, data, at in text_chunks(batch, "text"):
                tokens, words = token_hashes(data, at)
                count = np.diff(words)
                for n in range(1, size + 1):
                    gram, own = _grams(tokens, words, n)
                    fits = count[own] == n if n < size else slice(None)
                    gram, own = gram[fits], own[fits]
                    if len(gram):
                        (gram, own), places = np.unique(np.stack([gram, own]), axis=1, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(ids[row:end][own]), pa.array(places.astype(np.int64)), pa.array(count[own].astype(np.int64))], ["gram", "item_id", "places", "tokens"])

    return scan


def _gram_rows(sizes: list[int], key: str, bits: np.ndarray):
    """(gram, key) of the distinct grams of each row, of all sizes, that the filter lets through."""

    def scan(batches):
        for batch in batches:
            for row, end, data, at in text_chunks(batch, "text"):
                tokens, words = token_hashes(data, at)
                for size in sizes:
                    gram, own = _grams(tokens, words, size)
                    h = gram & (FILTER_BITS - 1)
                    keep = (bits[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)
                    gram, own = gram[keep], own[keep]
                    both = np.unique(np.stack([gram, long_column(batch, key)[row:end][own]]), axis=1) if len(gram) else np.zeros((2, 0), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["gram", key])

    return scan


def greedy_tiles(text: np.ndarray, item: np.ndarray, least: int, search: int = 20) -> list[tuple[int, int, int]]:
    """Tiles (place in text, place in item, length), longest first, of token hashes.

    Running Karp-Rabin: at each search length the hashes of all unmarked runs of the item are looked up in
    those of the text and matches grow to their full length. Matches of twice the search length raise it;
    otherwise the matches found are marked, longest first, and the length is halved.
    """
    least = max(1, min(least, len(item)))
    if len(text) < least or not len(item):
        return []
    used_text, used_item = np.zeros(len(text), bool), np.zeros(len(item), bool)
    run_text, run_item = RunHash(text), RunHash(item)
    length, tiles = max(least, min(search, len(item))), []
    while True:
        longest, found = length, []
        if len(text) >= length and len(item) >= length:
            x, y = run_text.grams(length), run_item.grams(length)
            before = lambda used: np.append(0, np.cumsum(used))
            free = lambda used: (lambda n: n[length:] == n[:-length])(before(used))
            x_at, y_at = np.flatnonzero(free(used_text) & np.isin(x, y)), np.flatnonzero(free(used_item))
            by_hash: dict[int, list[int]] = {}
            for p in y_at.tolist():
                by_hash.setdefault(int(y[p]), []).append(p)
            for t in x_at.tolist():
                for p in by_hash.get(int(x[t]), ()):
                    if t and p and text[t - 1] == item[p - 1] and not used_text[t - 1] and not used_item[p - 1]:
                        continue  # part of the match that starts before
                    n = length
                    while t + n < len(text) and p + n < len(item) and text[t + n] == item[p + n] and not used_text[t + n] and not used_item[p + n]:
                        n += 1
                    found.append((-n, t, p))
                    longest = max(longest, n)
        if longest > 2 * length:
            length = longest
            continue
        again = False
        for n, t, p in sorted(found):
            n = -n
            if used_text[t : t + n].any() or used_item[p : p + n].any():
                again = True  # what is left of it may still be as long as the search length
                continue
            used_text[t : t + n] = used_item[p : p + n] = True
            tiles.append((t, p, n))
        if again:
            continue
        if length == least:
            return tiles
        length = max(least, length // 2)


def _tile(least: int, threshold: float):
    def scan(batches):
        for batch in batches:
            names = ["doc_id", "item_id", "coverage", "n_tiles", "longest"]
            out: list[list] = [[] for _ in names]
            items = batch.column("items").to_pylist()
            for row, end, data, at in text_chunks(batch, "text"):
                tokens, words = token_hashes(data, at)
                for k in range(row, end):
                    own = tokens[words[k - row] : words[k - row + 1]]
                    for item in items[k]:
                        raw = np.frombuffer(item["item_text"].encode(), np.uint8)
                        wanted, _ = token_hashes(raw, np.array([0, len(raw)]))
                        tiles = greedy_tiles(own, wanted, least)
                        coverage = sum(t[2] for t in tiles) / max(1, len(wanted))
                        if coverage >= threshold:
                            for to, value in zip(out, (batch.column("doc_id")[k].as_py(), item["item_id"], coverage, len(tiles), max(t[2] for t in tiles)), strict=True):
                                to.append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)

    return scan


def _seed_filter(grams: DataFrame) -> np.ndarray:
    """The bits of the benchmark's grams. At most FILTER_BITS / 8 bytes, merged from bytes set by any gram."""
    byte = (F.col("gram").bitwiseAND(F.lit(FILTER_BITS - 1)) / 8).cast("int")
    mask = F.expr("shiftleft(1, CAST(gram & 7 AS int))")
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in grams.groupBy(byte.alias("byte")).agg(F.bit_or(mask).alias("mask")).toLocalIterator():
        bits[row.byte] = row.mask
    return bits


def key_of(id_col: str, text_col: str):
    """The id, or a hash of the text for a row without id."""
    return F.coalesce(F.col(id_col).cast("long"), F.when(F.col(text_col).isNotNull(), F.xxhash64(F.col(text_col).cast("string"))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", min_match: int = 5, threshold: float = 0.6, without_id: bool = False) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, coverage, n_tiles, longest (tile).

    With `without_id`, documents without id are judged too; their rows have a null doc_id.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", key_of("doc_id", "text") if without_id else F.col("doc_id"))
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    wanted = materialise(items.where("item_id IS NOT NULL").mapInArrow(_item_grams(min_match), "gram long, item_id long, places long, tokens long"))
    bits = _seed_filter(wanted)
    sizes = [r.tokens for r in wanted.where(F.col("tokens") < min_match).select("tokens").distinct().collect()]  # fewer than min_match
    seeds = docs.where("key IS NOT NULL").mapInArrow(_gram_rows([*sizes, min_match], "key", bits), "gram long, key long")
    shared = seeds.join(wanted, "gram").groupBy("key", "item_id", "tokens").agg(F.sum("places").alias("places"))
    # A tile of n >= min_match tokens holds n - min_match + 1 places of seeds, at least n / min_match of them.
    enough = shared.where(F.col("places") * F.least("tokens", F.lit(min_match)) >= F.col("tokens") * F.lit(threshold) - 1e-6)
    held = enough.select("key", "item_id").join(items.withColumnRenamed("text", "item_text"), "item_id").groupBy("key").agg(F.collect_set(F.struct("item_id", "item_text")).alias("items"))
    return docs.join(held, "key").mapInArrow(_tile(min_match, threshold), "doc_id long, item_id long, coverage double, n_tiles long, longest long")
