"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

The documents of a source, in the order of the MD5 of their ids, form blocks of
`block` documents. A source with u of W weight units is due u of every W slots: its
k-th block is released at floor(k W / u) and has its deadline
at ceil((k + 1) W / u). Earliest deadline first among the released blocks gives
every block a slot inside its window, so at every slot each source is less than one
block away from its target.

Weights are whole units, and W is as large as they need. Given weights are taken as the fractions or decimals they are written as and brought to their common denominator, so they are met exactly, however long the
table: 0.66666, 0.33333 and 0.00001 make a round of 100,000 slots. Only weights that need more than `units` slots are rounded to ROUNDED by
largest remainders (each source due anything gets one at least), and then drift by less than a block in that many slots. Without given weights the targets are the counts to a power, in units that sum to
about `scale`. A source of weight 0, or that is given none, is no part of the mixture: its documents come back without a slot.

After W slots all windows start anew, so one round is scheduled for all. Its blocks are laid out by release, slot by slot, with their deadlines; one pass over the slots
keeps the blocks that wait and takes the least deadline among them, W steps over as many numbers as sources wait, whatever the number of documents; a second one goes through
stretches of slots side by side. A source that has
run out leaves its slots empty, and the others go on in the same proportions to each other. Every document appears exactly once. The schedule has W rows and
is joined by (source, block in the round); ranks inside a source
come from counts of hash ranges, so a source that holds most rows is spread like any other.

Cases: a null source is the source ''; the order of rows with a null id or with one id is that of a hash of the whole row, so they spread like others, and
only rows that are the same in every column stand next to each other; an empty table gives an empty result; every column of the input is carried along, whatever its name, except
those named like the added ones, which are replaced.
"""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType
from pyspark.sql.window import Window

from .common import if_small, materialise

ADDED = ("weight_units", "block", "slot", "place", "release", "deadline")
#: A waiting block is one number: its deadline times this, and its source.
_SOURCES = 1 << 21
_STRETCH = 256
#: Slots of a round whose weights have no common denominator of a usable size.
ROUNDED = 16_384


def fraction(weight: float) -> Fraction:
    """A weight as it is meant: 1 / 3000 for the number nearest to it, else the decimals that it is written with."""
    near = Fraction(weight).limit_denominator(1_000_000)
    return near if float(near) == weight else Fraction(str(weight))


def exact_units(weights: dict[str, float], most: int, rounded: int = ROUNDED) -> dict[str, int]:
    """Whole units in the proportions of the weights, or, if that takes more than `most`, `rounded` of them by largest remainders; nothing for a weight of 0."""
    parts = {s: fraction(w) for s, w in weights.items() if w > 0}
    total = sum(parts.values())
    share = {s: f / total for s, f in parts.items()}
    least = lcm(*(f.denominator for f in share.values())) if share else 1
    if least <= most:
        return {s: int(f * least) for s, f in share.items()}
    whole = {s: f * rounded // 1 for s, f in share.items()}
    left = rounded - sum(whole.values())
    for s in sorted(share, key=lambda s: (whole[s] - share[s] * rounded, s))[: int(left)]:
        whole[s] += 1
    return {s: max(1, int(u)) for s, u in whole.items()}


def weight_units(counts: DataFrame, weights: dict[str, float] | None, units: int, power: float, scale: int) -> DataFrame:
    """(src, n, u): the weight of each source in whole units, null if it has none."""
    if weights is not None:
        present = [r.src for r in counts.where(F.col("src").isin(*weights)).select("src").collect()] if weights else []
        found = exact_units({s: weights[s] for s in present}, units)
        own = F.create_map(*[F.lit(x) for kv in found.items() for x in kv]) if found else F.create_map(F.lit(""), F.lit(None).cast("int"))
        return counts.withColumn("u", F.try_element_at(own, "src").cast("long"))
    raw = F.pow(F.col("n").cast("double"), power)
    # One window over the sources, not over documents.
    share = raw / F.sum(raw).over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("u", F.greatest(F.lit(1), F.round(share * scale)).cast("long"))


def round_slots(sources: DataFrame) -> DataFrame:
    """(src, k, at, u, total): the slot of each block of a round. Sources have (src, u)."""
    every = Window.partitionBy(F.lit(0))
    listed = sources.where("u > 0").withColumns({"no": F.row_number().over(every.orderBy("src")), "total": F.sum("u").over(every)})
    blocks = listed.select("no", "u", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("u") - 1)).alias("k"))
    due = blocks.select("total", F.expr("k * total DIV u").alias("at"), F.expr(f"((k + 1) * total + u - 1) DIV u * {_SOURCES} + no").alias("due"))
    released = due.groupBy("at").agg(F.collect_list("due").alias("due"))
    slots = listed.select("total").distinct().select(F.explode(F.expr("sequence(0L, total - 1)")).alias("at")).join(released, "at", "left")
    # A fold copies its state at each step. So the first one keeps only the blocks that wait, and those at the start of each stretch; each stretch is then gone through on its own, noting what is taken.
    stretches = slots.groupBy(F.expr(f"at DIV {_STRETCH}").alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("at", "due"))).alias("slots"))
    numbers = "CAST(array() AS ARRAY<BIGINT>)"
    waits = f"concat({{0}}.waits, coalesce(x.due, {numbers}))"
    left = f"array_remove({waits}, array_min({waits}))"
    starts = f"""aggregate(line, named_struct('waits', {numbers}, 'starts', CAST(array() AS ARRAY<ARRAY<BIGINT>>)),
        (a, s) -> named_struct('waits', aggregate(s.slots, named_struct('waits', a.waits), (b, x) -> named_struct('waits', {left.format("b")})).waits, 'starts', array_append(a.starts, a.waits)), a -> a.starts)"""
    line = stretches.agg(F.array_sort(F.collect_list(F.struct("stretch", "slots"))).alias("line")).where("size(line) > 0")
    started = line.select(F.posexplode(F.expr(starts)).alias("stretch", "waits"))
    taken = f"aggregate(slots, named_struct('waits', waits, 'taken', {numbers}), (a, x) -> named_struct('waits', {left.format('a')}, 'taken', array_append(a.taken, array_min({waits.format('a')}))), a -> a.taken)"
    owners = stretches.join(started, "stretch").select("stretch", F.posexplode(F.expr(taken)).alias("at", "due"))
    owners = owners.select((F.col("stretch") * _STRETCH + F.col("at")).cast("long").alias("at"), F.expr(f"CAST(due % {_SOURCES} AS int)").alias("no"))
    own = owners.join(listed, "no").select("src", "u", "at", "total")
    return own.withColumn("k", (F.row_number().over(Window.partitionBy("src").orderBy("at")) - 1).cast("long"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, units: int = 131_072, power: float = 0.5, scale: int = 8192, block: int = 64, range_rows: int = 4096) -> DataFrame:
    """The documents with weight_units, block, slot, place (in the block), release and deadline.

    Reading order is (slot, place). Without `weights`, targets are the counts to the given power.
    """
    docs = docs.drop(*ADDED)
    hashed = [f.name for f in docs.schema if not isinstance(f.dataType, MapType | VariantType)]
    src, tie = F.coalesce(F.col(source_col).cast("string"), F.lit("")), F.xxhash64(*[F.col(f"`{c}`") for c in hashed])
    mark = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), tie))
    rows = docs.select(F.struct("*").alias("doc"), src.alias("src"), mark.alias("mark"))
    counts = materialise(rows.groupBy("src").agg(F.count("*").alias("n")))
    plan = materialise(round_slots(weight_units(counts, weights, units, power, scale)))
    # Rank inside a source: hash ranges of about range_rows rows are counted, then ranked each on its own.
    ranges = rows.join(if_small(counts), "src").withColumn("range", F.expr(f"CAST(conv(substring(mark, 1, 8), 16, 10) AS bigint) * CAST(ceil(n / {range_rows}) AS bigint) DIV 4294967296L"))
    sizes = ranges.groupBy("src", "range").agg(F.count("*").alias("size"))
    ahead = sizes.withColumn("ahead", F.sum("size").over(Window.partitionBy("src").orderBy("range")) - F.col("size")).drop("size")
    order = Window.partitionBy("src", "range").orderBy("mark")
    ranked = ranges.withColumn("rank", F.row_number().over(order)).join(ahead, ["src", "range"]).withColumn("rank", F.col("rank") + F.col("ahead") - 1)
    units_of = if_small(plan.select("src", "u", "total").distinct())
    placed = ranked.select("doc", "src", F.expr(f"rank DIV {block}").alias("block"), F.expr(f"rank % {block}").alias("place")).join(units_of, "src", "left").withColumn("k", F.expr("block % u"))
    placed = placed.join(if_small(plan.select("src", "k", "at")), ["src", "k"], "left").withColumn("start", F.expr("block DIV u * total"))
    return placed.select(
        "doc.*", F.col("u").alias("weight_units"), "block", F.expr("start + at").alias("slot"), "place",
        F.expr("start + k * total DIV u").alias("release"), F.expr("start + ((k + 1) * total + u - 1) DIV u").alias("deadline"),
    )
