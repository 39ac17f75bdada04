r"""Ranked lexical search over a two-level quantised index.

The index holds, for each document, the terms of the queries that it has. Level one is one byte a posting: the impact
(a saturating function of frequency and length, below 10^6) rounded up to a multiple of `STEP`. Level two is the exact
frequency, and the document's length. A query's weights times the bytes give an upper bound of each document's score, and the bytes less one step give
a lower bound; both cost one pass over narrow rows. Every document whose upper bound reaches the kth largest lower bound may be among the first k,
and these are scored again from level two in whole numbers. No other can be, so the result is exact.

Queries are taken in blocks of about `block_terms` (query, term) pairs, dealt by hash: a task holds the vocabulary and weights of one block, the driver collects
one block, and documents are read once for each block. A task adds up bounds for some thousands of documents at a time,
keeps the k largest lower bounds of each query, and passes on only documents that reach them, so what is shuffled are some tens of narrow rows for each query and task, and a term
that all documents share is never laid out as rows. Postings and candidates are checkpointed.

Terms are the maximal matches of `TERM`, with A-Z in lower case: ASCII letters and digits and everything beyond ASCII. Long texts are cut between terms into pieces of about a megabyte.

Cases: null and empty texts have no terms and rank nowhere; a query without terms or without any match has no rows; equal scores go by ascending id, null ids last; rows that repeat an id are ranked
each on its own; queries that repeat both id and text count once, those that repeat an id only are ranked each on its own; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import if_small, materialise

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same over UTF-8, where all characters beyond ASCII are bytes from 0x80.
_TERM_BYTES, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-zA-Z\x80-\xff]")
#: Impacts are below 10^6, and a byte times STEP reaches them.
STEP = 3922
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_IMPACT = "(1000000000L * tf) DIV (1000L * tf + 12L * m)"


def terms_of(raw: bytes, piece: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, as a list for each piece of about `piece` bytes."""
    at = 0
    while at < len(raw):
        gap = _GAP.search(raw, at + piece)
        end = gap.start() if gap else len(raw)
        yield _TERM_BYTES.findall(raw[at:end].lower())
        at = end


def _postings(vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, key = vocabulary.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            lengths, sizes, terms, tfs = [], [], [], []
            for text in batch.column("text").cast(pa.binary()):
                n, found = 0, Counter()
                for words in terms_of(text.as_py() or b""):
                    n += len(words)
                    found.update(i for w in words if (i := known.get(w)) is not None)
                lengths.append(n)
                sizes.append(len(found))
                terms.extend(found)
                tfs.extend(found.values())
            starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(starts, pa.array(x, t)) for x, t in ((terms, pa.int32()), (tfs, pa.int64()))]
            keys = pa.array(np.arange(key, key + len(batch), dtype=np.int64))
            key += len(batch)
            yield pa.RecordBatch.from_arrays([keys, batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], names=["key", "doc_id", "n", "terms", "tfs"])

    return run


def _impacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level one: the impacts, rounded up to a byte each."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("tfs")).to_numpy(zero_copy_only=False).astype(np.int64)
        tf, m = batch.column("tfs").flatten().to_numpy(), np.repeat(batch.column("m").to_numpy(), sizes)
        upward = -(-(1_000_000_000 * tf // (1000 * tf + 12 * m)) // STEP)
        starts = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        packed = pa.Array.from_buffers(pa.binary(), len(batch), [None, starts.buffers()[1], pa.py_buffer(upward.astype(np.uint8).tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("terms"), packed], names=["key", "terms", "impacts"])


def _candidates(weights, k: int, cells: int = 1 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(item, key, ub, lb) of the documents whose upper bound reaches the kth lower bound seen so far in the task.

    `weights` broadcasts (number of items, first pair of each term, items, weights): pairs in the order of terms. Sums
    are held for about `cells` (document, item) pairs at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_items, first, items, weight = weights.value
        best, rows = np.zeros((n_items, k), np.int64), max(1, cells // n_items)
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                sizes = pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False)
                term = part.column("terms").flatten().to_numpy()
                doc = np.repeat(np.arange(len(part)), sizes)
                level = np.frombuffer(b"".join(part.column("impacts").to_pylist()), np.uint8).astype(np.int64)
                order = np.argsort(term, kind="stable")
                term, doc, level = term[order], doc[order], np.stack([level, level > 0], axis=1)[order]
                cuts = np.flatnonzero(np.diff(term, prepend=-1))
                sums = np.zeros((len(part), n_items, 2), np.int64)
                for lo, hi in zip(cuts, [*cuts[1:], len(term)], strict=True):
                    own = slice(first[term[lo]], first[term[lo] + 1])
                    sums[np.ix_(doc[lo:hi], items[own])] += level[lo:hi, None, :] * weight[None, own, None]
                upper, lower = STEP * sums[:, :, 0], STEP * sums[:, :, 0] - (STEP - 1) * sums[:, :, 1]
                best = np.partition(np.concatenate([best, lower.T], axis=1), -k, axis=1)[:, -k:]
                d, i = np.nonzero((upper > 0) & (upper >= best[:, 0]))
                found = {"item": i.astype(np.int32), "key": part.column("key").to_numpy()[d], "ub": upper[d, i], "lb": lower[d, i]}
                yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in found.items()})

    return run


def _search_block(docs: DataFrame, block: list[tuple[int, str, int]], id_type: str, k: int) -> DataFrame:
    """(item, rank, doc_id, score) of one block of (item, term, count), items being numbers."""
    spark = docs.sparkSession
    ids = {t: i for i, t in enumerate(sorted({t for _, t, _ in block}))}
    vocabulary = spark.sparkContext.broadcast({t.encode(): i for t, i in ids.items()})
    level2 = materialise(docs.mapInArrow(_postings(vocabulary), f"key long, doc_id {id_type}, n long, terms array<int>, tfs array<long>"))
    n_docs, n_terms = level2.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    # 25 n N can pass 64 bits on the largest tables, so it is a decimal until it is divided.
    sized = level2.where("size(terms) > 0").withColumn("m", F.expr(f"75L + (CAST(25L * n AS DECIMAL(20, 0)) * CAST({n_docs} AS DECIMAL(18, 0))) DIV CAST({max(n_terms, 1)} AS DECIMAL(20, 0))"))
    level1 = materialise(sized.select("key", "m", "terms", "tfs").mapInArrow(_impacts, "key long, terms array<int>, impacts binary"))
    df = level2.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = {r.term: r.w for r in df.select("term", F.expr(f"CAST(floor(1000 * ln((2D * {n_docs} + 2) / (2D * df + 1))) AS bigint)").alias("w")).collect()}
    pairs = sorted((ids[t], i, c * weight.get(ids[t], 0)) for i, t, c in block)
    first = np.searchsorted([t for t, _, _ in pairs], np.arange(len(ids) + 1))
    n_items = 1 + max(i for i, _, _ in block)
    weights = spark.sparkContext.broadcast((n_items, first, np.array([i for _, i, _ in pairs]), np.array([w for _, _, w in pairs], np.int64)))
    found = materialise(level1.mapInArrow(_candidates(weights, k), "item int, key long, ub long, lb long"))
    per_item = Window.partitionBy("item")
    kth = found.withColumn("turn", F.row_number().over(per_item.orderBy(F.desc("lb")))).where(F.col("turn") <= k)
    kth = kth.groupBy("item").agg(F.when(F.count("*") == k, F.min("lb")).otherwise(0).alias("kth"))
    reached = materialise(found.join(F.broadcast(kth), "item").where("ub >= kth").select("item", "key"))
    # Level two of the candidates, and the exact score.
    exact = sized.join(if_small(reached), "key").select("item", "key", "doc_id", "m", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    asked = spark.createDataFrame([(i, t, w) for t, i, w in pairs], "item int, term int, w long")
    scored = exact.select("item", "key", "doc_id", "m", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf")).join(F.broadcast(asked), ["item", "term"])
    scored = scored.groupBy("item", "key", "doc_id").agg(F.sum(F.expr(f"w * ({_IMPACT})")).alias("score")).where("score > 0")
    ranked = scored.withColumn("rank", F.row_number().over(per_item.orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "key")))
    return ranked.where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = 1 << 18) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores for each item, rank 1 first."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item_id"), F.translate(F.col(item_text_col).cast("string"), _UPPER, _LOWER).alias("t")).distinct()
    asked = asked.select("item_id", F.sha2("t", 256).alias("digest"), F.explode(F.regexp_extract_all("t", F.lit(TERM), F.lit(0))).alias("term"))
    asked = materialise(asked.groupBy("item_id", "digest", "term").agg(F.count("*").alias("c")))
    blocks = max(1, -(-asked.count() // block_terms))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type, item_type = texts.schema["doc_id"].dataType.simpleString(), asked.schema["item_id"].dataType.simpleString()
    result = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("digest", "item_id"), F.lit(blocks)) == b)
        rows = block.collect()
        named = {x: i for i, x in enumerate(sorted({(r.item_id, r.digest) for r in rows}, key=str))}
        if not named:
            continue
        numbers = spark.createDataFrame([(i, item_id) for (item_id, _), i in named.items()], f"item int, item_id {item_type}")
        rows = [(named[r.item_id, r.digest], r.term, r.c) for r in rows]
        part = _search_block(texts, rows, id_type, k).join(F.broadcast(numbers), "item").select("item_id", "rank", "doc_id", "score")
        result = part if result is None else result.unionByName(part)
    return result if result is not None else spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS key, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS nd, sum(len(terms))::BIGINT AS nt FROM d),
p AS (SELECT key, doc_id, n, term, count(*) AS tf FROM (SELECT key, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(nd) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
r AS (SELECT item_id, key, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // nt))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, key, doc_id),
o AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
"""
