"""Helpers shared by the corpus operators: tables, Arrow batches, materialisation and grouping."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges of a graph that one task takes.
EDGES_PER_TASK = 100_000
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a folder of this machine is right only if driver and
    tasks are one process, as in tests; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or f"/tmp/checkpoints/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A table of a few numbers a row, to be broadcast if it has no more than `rows` rows (counted), else joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slice a batch into runs of rows holding about `limit` bytes of text.

    Yields (first row, end row, UTF-8 bytes of the run, row offsets into them);
    a null is an empty text. One row above the limit makes a run of its own.
    """
    col = batch.column(column)
    if col.null_count:
        col = pc.fill_null(col, "")
    if not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        col = col.cast(pa.string())
    _, offsets, data = col.buffers()
    if len(col) == 0:
        return
    at = np.frombuffer(offsets, np.int32, count=len(col) + 1, offset=4 * col.offset).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def long_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An integer column as int64; a null reads as 0."""
    return pc.fill_null(batch.column(name).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)


def list_of_longs(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """list<long> with one list between each two of `starts`."""
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.astype(np.int64)))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges, for each id on an edge.

    Alternates large-star and small-star rounds over DataFrames until the edge
    set is a forest of stars. Each round is one checkpoint; nothing but the
    number of edges and a checksum comes to the driver. A hot centre is only
    ever aggregated with min(), which combines before the shuffle, and joined
    back over a salted key.
    """
    cur = materialise(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u != v").distinct())
    parts = 1 + cur.count() // EDGES_PER_TASK
    sized = lambda df: df.coalesce(parts)  # noqa: E731  edges never get more; a task for each shuffle partition would write more files than rows
    cur, before = sized(cur), None
    while True:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        least = sized(both.groupBy("u").agg(F.min("v").alias("m"))).select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt"))
        large = both.where("v > u").withColumn("salt", F.pmod(F.hash("v"), F.lit(8))).join(least, ["u", "salt"])
        large = sized(sized(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")).distinct())
        # Each u is the larger end of its edges here, so its edges lead to smaller ids only: few, whatever the size of the star.
        low = sized(large.groupBy("u").agg(F.min("v").alias("m")))
        small = sized(large.join(low, "u")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v")
        cur = materialise(sized(small.distinct()))
        state = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
