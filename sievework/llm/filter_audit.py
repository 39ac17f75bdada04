"""Walsh-Hadamard audit of how filters interact, for every order of applying them.

Each document has a mask of the filters it fails. A part (and a label inside it) is summarised by 2^n signed sums: for each set T
of filters, the documents counted with +1 or -1 as the number of failed filters in T is even or odd. These parities
are plain sums, so they combine before the shuffle, and a part that holds most documents costs no more than any other. The transform is its own
inverse up to 2^n, so the count of each mask comes back exactly; all n! orders and the Shapley counts are then read from
the 2^n cells of a part and never from documents. A document with f failures is removed by each failing filter in n!/f of the
orders, so a filter's Shapley count is the sum over its cells of n!/f.

The copy filter needs the smallest id of each text. Rows with one digest are first summed by (digest, part, labels), which combines before the
shuffle, and only those groups, a few for each part, meet to find the smallest id: a text that fills a third of the table is no hot key.

Cases: a null or empty text has no words, is short and is identical to any other empty one; a null source is the part ''; rows that repeat the
smallest id of a text are no copies of each other; a row with a null id is nobody's original and never a copy; documents without a label are neither
good nor toxic, and repeated labels count if any of them says so; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
#: Failure conditions over `text` and its words `w`, in the order of their bits; the copy filter comes after them.
FILTERS = {
    "A": "size(w) < 200",
    "B": "100 * size(array_distinct(w)) < 50 * size(w)",
    "C": "100 * length(regexp_replace(text, '[^A-Z]+', '')) > 2 * length(text)",
    "D": "text RLIKE '[#$%&*|]'",
}
LABELS = ("all", "good", "toxic")


def _parity(mask: str, subset: int) -> Column:
    """+1 or -1: the sign of the masks that fail an odd number of the filters in `subset`."""
    return F.expr(f"1 - 2 * (bit_count({mask} & {subset}) & 1)")


def failure_masks(docs: DataFrame, labels: DataFrame, *, filters: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, good, toxic, mask, n): documents by the filters they fail, the copy filter's bit being the highest."""
    filters = FILTERS if filters is None else filters
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    split = texts.withColumn("w", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    own = " + ".join(f"IF({condition}, {1 << k}, 0)" for k, condition in enumerate(filters.values()))
    rows = split.select("id", "part", F.sha2("text", 256).alias("digest"), F.expr(own).alias("own"))
    said = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(F.expr("coalesce(quality = 1, false)")).alias("good"), F.max(F.expr("coalesce(toxic = 1, false)")).alias("toxic"))
    # Without an id there is no label: these rows don't go through the join, where they would meet in one place.
    named = rows.where("id IS NOT NULL").join(said.where("id IS NOT NULL"), "id", "left").fillna(False, ["good", "toxic"])
    nameless = rows.where("id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    key = ["digest", "own", "part", "good", "toxic"]
    repeats = named.groupBy("id", *key).agg(F.count("*").alias("n"))
    groups = repeats.groupBy(*key).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("first"))
    # A window over the groups of a digest, not over its rows.
    least = groups.withColumn("least", F.min("first.id").over(Window.partitionBy("digest")))
    copies = least.select("part", "good", "toxic", "own", F.col("n").alias("m"), F.expr("IF(first.id = least, first.n, 0)").alias("kept"))
    bit = 1 << len(filters)
    counted = copies.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("own").alias("mask"), F.col("kept").alias("n")), F.struct((F.col("own") + bit).alias("mask"), (F.col("m") - F.col("kept")).alias("n")))).alias("c"))
    return counted.select("part", "good", "toxic", "c.mask", "c.n").unionByName(nameless.select("part", "good", "toxic", F.col("own").alias("mask"), F.lit(1).cast("long").alias("n")))


def parity_sums(masks: DataFrame, n_filters: int) -> DataFrame:
    """(part, label, parities): the 2^n signed sums of each part and label."""
    label = F.explode(F.expr(f"filter(array('{LABELS[0]}', IF(good, '{LABELS[1]}', NULL), IF(toxic, '{LABELS[2]}', NULL)), x -> x IS NOT NULL)"))
    sums = [F.sum(_parity("mask", t) * F.col("n")).alias(f"s{t}") for t in range(1 << n_filters)]
    summed = masks.select("part", label.alias("label"), "mask", "n").groupBy("part", "label").agg(*sums)
    return summed.select("part", "label", F.array(*[f"s{t}" for t in range(1 << n_filters)]).alias("parities"))


def cells(parities: DataFrame, n_filters: int) -> DataFrame:
    """(part, all, good, toxic): the exact count of each mask, by the inverse transform."""
    size = 1 << n_filters
    inverse = F.expr(f"transform(sequence(0, {size - 1}), m -> aggregate(sequence(0, {size - 1}), 0L, (a, t) -> a + parities[t] * (1 - 2 * (bit_count(m & t) & 1))) DIV {size})")
    nothing = F.array_repeat(F.lit(0).cast("long"), size)
    return parities.withColumn("cells", inverse).groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("label") == x, F.col("cells"))), nothing).alias(x) for x in LABELS])


def filter_audit(docs: DataFrame, labels: DataFrame, *, filters: dict[str, str] | None = None, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    `filters` are failure conditions in SQL by one-letter name, over `text` and its words `w`; the filter named `copies` comes after them.
    """
    filters = FILTERS if filters is None else filters
    names = [*filters, copies]
    orders = factorial(len(names))
    counted = cells(parity_sums(failure_masks(docs, labels, filters=filters, id_col=id_col, text_col=text_col, part_col=part_col), len(names)), len(names))
    steps = F.array(*[F.struct(F.lit("".join(names[k] for k in order)).alias("filter_order"), F.array(*[F.lit(1 << k) for k in order]).alias("bits")) for order in permutations(range(len(names)))])
    at = counted.select("*", F.explode(steps).alias("o")).select("part", *LABELS, "o.filter_order", F.posexplode("o.bits").alias("before", "bit"), "o.bits")
    at = at.withColumn("prior", F.expr("aggregate(slice(bits, 1, before), 0, (a, b) -> a | b)"))

    def total(label: str, where: str, of: str = "x") -> Column:
        return F.expr(f"aggregate(transform(`{label}`, (x, m) -> IF({where}, {of}, 0L)), 0L, (a, y) -> a + y)")

    fails, first = "(m & bit) != 0", "(m & bit) != 0 AND (m & prior) = 0"
    return at.select(
        "part", "filter_order", (F.col("before") + 1).alias("step"),
        total("all", "(m & (prior | bit)) = 0").alias("kept"), total("all", first).alias("removed"), total("all", f"{fails} AND (m & prior) != 0").alias("redundant"),
        total("all", "m = bit").alias("unique_fails"), total("good", first).alias("good_lost"), total("toxic", first).alias("toxic_lost"),
        total("all", fails, f"x * ({orders} DIV greatest(bit_count(m), 1))").alias("shapley"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least AS (SELECT t, min(doc_id) AS id FROM d GROUP BY t),
lab AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.part, coalesce(lab.good, false) AS good, coalesce(lab.toxic, false) AS toxic,
      CASE WHEN len(d.w) < 200 THEN 'A' ELSE '' END
      || CASE WHEN 100 * len(list_distinct(d.w)) < 50 * len(d.w) THEN 'B' ELSE '' END
      || CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]+', '', 'g')) > 2 * length(d.t) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END
      || CASE WHEN d.doc_id > least.id THEN 'E' ELSE '' END AS fails
      FROM d LEFT JOIN lab USING (doc_id) JOIN least ON least.t = d.t),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || e.x || g.x || h.x AS filter_order FROM x a, x b, x e, x g, x h WHERE len(list_distinct([a.x, b.x, e.x, g.x, h.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS prior
      FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
j AS (SELECT part, filter_order, step, n, n_good, n_toxic, fails, contains(fails, own) AS now, fails = own AS alone,
      len(list_intersect(string_split(fails, ''), string_split(prior, ''))) > 0 AND prior <> '' AND fails <> '' AS gone FROM c, s)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT now AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (now AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (now AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
  coalesce(sum(n_good) FILTER (now AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (now AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(len(fails), 1)) FILTER (now), 0)::BIGINT AS shapley
FROM j GROUP BY part, filter_order, step
"""
