"""Line dedup within an edit distance, in DataFrame operations only.

Lines of `min_chars` characters or more, trimmed, are compared. To find lines within
`edits` of each other, each is split into edits + 1 segments; of two such lines one
has a segment of the other unchanged, at a place that the lengths narrow down. So each line is
indexed under (length, segment number, segment) and probes the substrings of its own that
could be a segment of a line as long or up to `edits` shorter. Lines that meet are
verified by a bit-parallel edit distance inside a band of 2 edits + 1 diagonals. Linked
lines form classes; of a class the first line (smallest document, then place) stays.

A segment that many lines have is not joined: its lines are split again, on the side where they may
differ, so the lines of a common half meet by its quarters and no group is expanded into all pairs.

Exact copies are merged before any of this by their hash, combined before the shuffle, so a line that
stands in a third of all documents is one row of the index. Lines that stay are known by (document, place),
which is never a hot key; the others are known by their absence.

Cases: a null text stays null; an empty or short line is never removed; a row with a null id is
returned unchanged; rows that repeat an id don't remove each other's lines; very
long lines are compared whole; other columns are carried, unless they are named like the added
ones. Lines are named by a 64-bit hash, so two lines can be taken for one with a chance of 1 in 2**64 a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, if_small, materialise

ADDED = ("n_lines", "n_removed")
_TRIM = r"trim(BOTH ' \t\r' FROM {})"


def _segment(n: str, i: int, edits: int) -> tuple[str, str]:
    """SQL of the start (from 0) and size of segment i of a line of n characters: even parts, the last ones longer."""
    parts = edits + 1
    longer = f"greatest(0, {i} - ({parts} - {n} % {parts}))"
    return f"({n} DIV {parts} * {i} + {longer})", f"({n} DIV {parts} + CAST({i} >= {parts} - {n} % {parts} AS int))"


def _key(hashed: str, start: str, size: str, n: str, shift: int, own: str) -> str:
    """SQL struct (k, lo, hi): a key and the place, in the line of `own` characters, of what its segment leaves on the longer side."""
    left = f"{start} >= {n} - {start} - {size}"
    return f"struct({hashed} AS k, IF({left}, 0, {start} + {shift} + {size}) AS lo, IF({left}, {start} + {shift}, {own}) AS hi)"


def index_keys(line: str, n: str, edits: int) -> str:
    """SQL array of the keys under which a line is found. Column `under` is the key that it was refined from."""
    keys = []
    for i in range(edits + 1):
        start, size = _segment(n, i, edits)
        keys.append(_key(f"xxhash64(under, {n}, {i}, substring({line}, {start} + 1, {size}))", start, size, n, 0, n))
    return f"array({', '.join(keys)})"


def probe_keys(line: str, n: str, edits: int, shorter: int = 0) -> str:
    """SQL array of the keys that lines of equal length, up to `edits` shorter or `shorter` longer may be found under.

    For a segment that starts at p of a line shorter by d, only starts that leave
    room for the edits before it and after it are tried.
    """
    keys = []
    for d in range(-shorter, edits + 1):
        for i in range(edits + 1):
            start, size = _segment(f"({n} - {d})", i, edits)
            for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1):
                hashed = f"IF({n} - {d} > {edits} AND {start} + {shift} >= 0, xxhash64(under, {n} - {d}, {i}, substring({line}, {start} + {shift} + 1, {size})), NULL)"
                keys.append(_key(hashed, start, size, f"({n} - {d})", shift, n))
    return f"array_distinct(array({', '.join(keys)}))"


def within_edits(a: str, b: str, edits: int) -> str:
    """SQL condition: the edit distance of strings a and b is at most `edits`.

    Equal blocks at both ends are cut off first. Then, for each character of b,
    the vertical differences of a column of the distance table live in the bits of two integers,
    one bit per diagonal of the band; what lies outside of it is taken as large.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    match = " | ".join(f"shiftleft(CAST(coalesce(get(s.p, j + {k - edits}) = get(s.t, j), false) AS bigint), {k})" for k in range(width))
    begin = f"named_struct('vp', {((1 << edits) - 1) << (edits + 1)}L, 'vn', 0L, 'd', 0)"
    column = f"""aggregate(IF(size(s.t) = 0, CAST(array() AS array<int>), sequence(0, size(s.t) - 1)), {begin}, (c, j) -> transform(array(named_struct(
        'm', {match}, 'vp', shiftrightunsigned(c.vp, 1) | {1 << (width - 1)}L, 'vn', shiftrightunsigned(c.vn, 1), 'd', c.d)), x ->
        transform(array(named_struct('z', ((((x.m & x.vp) + x.vp) ^ x.vp) | x.m | x.vn) & {full}L, 'vp', x.vp, 'vn', x.vn, 'd', x.d)), y ->
        transform(array(named_struct('h', shiftleft((y.vn | ~(y.z | y.vp)) & {full}L, 1) | 1L, 'g', shiftleft(y.z & y.vp, 1), 'z', y.z, 'd', y.d)), w ->
        named_struct('vp', (w.g | ~(w.z | w.h)) & {full}L, 'vn', w.z & w.h & {full}L, 'd', w.d + 1 - CAST(shiftrightunsigned(w.z, {edits}) & 1L AS int)))[0])[0])[0])"""
    # From the diagonal's end (size(t), size(t)) along the last column to (size(p), size(t)).
    below = f"CAST(shiftright(c.vp, k) & 1L AS int) - CAST(shiftright(c.vn, k) & 1L AS int)"
    walk = f"""aggregate(sequence(0, {width - 1}), 0, (a, k) -> a
        + IF(k > {edits} AND k - {edits} <= size(s.p) - size(s.t), {below}, 0) - IF(k <= {edits} AND k - {edits} > size(s.p) - size(s.t), {below}, 0))"""
    size = f"greatest(32, length({a}) DIV 32)"
    least = f"least(length({a}), length({b}))"
    ahead = f"(array_position(transform(sequence(0, {least} DIV z.k), q -> substring({a}, q * z.k + 1, z.k) = substring({b}, q * z.k + 1, z.k) AND (q + 1) * z.k <= {least}), false) - 1)"
    behind = f"(array_position(transform(sequence(0, ({least} - y.f * y.k) DIV y.k), q -> substring({a}, length({a}) - (q + 1) * y.k + 1, y.k) = substring({b}, length({b}) - (q + 1) * y.k + 1, y.k) AND (q + 1) * y.k <= {least} - y.f * y.k), false) - 1)"
    rest = "split(substring({0}, CAST(x.f * x.k AS int) + 1, CAST(length({0}) - (x.f + x.g) * x.k AS int)), '')"
    chars = f"filter({rest}, e -> e != '')"
    inner = f"transform(array(named_struct('p', {chars.format(a)}, 't', {chars.format(b)})), s -> transform(array({column}), c -> c.d + {walk})[0])[0]"
    return f"""(abs(length({a}) - length({b})) <= {edits} AND transform(array(named_struct('k', {size})), z ->
        transform(array(named_struct('k', z.k, 'f', {ahead})), y -> transform(array(named_struct('k', y.k, 'f', y.f, 'g', {behind})), x -> {inner})[0])[0])[0] <= {edits})"""


def _meetings(texts: DataFrame, edits: int, crowd: int) -> DataFrame:
    """(a_doc, a_no, b_doc, b_no): lines that meet under a key.

    A key that more than `crowd` lines are indexed under is not joined. Its lines agree on the segment, so what
    is left of them on the longer side is split and probed in the same way, until keys are
    rare again or the lines differ in no more than `edits` characters that can't be split.
    """
    keys = texts.select("doc_id", "no", F.col("key").alias("piece"), F.lit(0).cast("long").alias("under"))
    keys = keys.withColumns({"own": F.expr(index_keys("piece", "length(piece)", edits)), "sought": F.expr(probe_keys("piece", "length(piece)", edits))})
    divides = F.expr(f"transform(own, x -> IF(x.hi - x.lo > {edits}, x.k, NULL))")
    # The keys of all lines are written once, without their texts; those of crowded keys are fetched again.
    keys = materialise(keys.select("doc_id", "no", F.col("own.k").alias("own"), divides.alias("divides"), F.col("sought.k").alias("sought")))
    found, shorter = [], 0
    while True:
        index, probe = (keys.select("doc_id", "no", F.explode(c).alias("k")).where("k IS NOT NULL") for c in ("own", "sought"))
        crowded = materialise(keys.select(F.explode("divides").alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")).where(f"n > {crowd}").select("k"))
        more = not crowded.isEmpty()
        few = index.join(if_small(crowded), "k", "left_anti") if more else index
        met = few.select(F.col("doc_id").alias("a_doc"), F.col("no").alias("a_no"), "k").join(probe.select(F.col("doc_id").alias("b_doc"), F.col("no").alias("b_no"), "k"), "k")
        found.append(met.where("a_doc != b_doc OR a_no != b_no").drop("k"))
        if not more:
            break
        if len(found) == 1:
            hot = materialise(index.unionByName(probe).join(if_small(crowded), "k", "left_semi").select("doc_id", "no").distinct())
            lines = materialise(texts.select("doc_id", "no", F.col("key").alias("piece")).join(if_small(hot), ["doc_id", "no"], "left_semi"))
            index_lines = probe_lines = lines.withColumn("under", F.lit(0).cast("long"))
        index_lines, probe_lines = (
            rows.select("doc_id", "no", "piece", F.inline(F.expr(tried))).join(if_small(crowded), "k", "left_semi").select("doc_id", "no", F.expr("substring(piece, lo + 1, hi - lo)").alias("piece"), F.col("k").alias("under"))
            for rows, tried in ((index_lines, index_keys("piece", "length(piece)", edits)), (probe_lines, probe_keys("piece", "length(piece)", edits, shorter)))
        )
        shorter = edits if edits > 1 else 0  # with one edit, what is left differs in length as the lines do
        index_lines, probe_lines = materialise(index_lines), materialise(probe_lines)
        own, none = F.expr(index_keys("piece", "length(piece)", edits)), F.expr("CAST(NULL AS array<bigint>)")
        keys = index_lines.withColumn("own", own).select("doc_id", "no", F.col("own.k").alias("own"), divides.alias("divides"), none.alias("sought"))
        keys = materialise(keys.unionByName(probe_lines.select("doc_id", "no", none.alias("own"), none.alias("divides"), F.expr(probe_keys("piece", "length(piece)", edits, shorter)).getField("k").alias("sought"))))
    met = found[0]
    for other in found[1:]:
        met = met.unionByName(other)
    return met


def similar_lines(lines: DataFrame, uniq: DataFrame, edits: int, crowd: int) -> DataFrame:
    """(a, b): hashes of lines within `edits`. lines has (doc_id, no, key), uniq one (doc_id, no) per line."""
    met = _meetings(lines.join(uniq, ["doc_id", "no"]), edits, crowd)
    swap = F.expr("a_doc < b_doc OR a_doc = b_doc AND a_no < b_no")
    ends = [F.struct("a_doc", "a_no"), F.struct("b_doc", "b_no")]
    pairs = met.select(F.when(swap, ends[0]).otherwise(F.struct(F.col("b_doc").alias("a_doc"), F.col("b_no").alias("a_no"))).alias("x"), F.when(swap, ends[1]).otherwise(F.struct(F.col("a_doc").alias("b_doc"), F.col("a_no").alias("b_no"))).alias("y"))
    pairs = materialise(pairs.select("x.*", "y.*").distinct())
    involved = pairs.select(F.col("a_doc").alias("doc_id"), F.col("a_no").alias("no")).union(pairs.select("b_doc", "b_no")).distinct()
    # Exact repeats of a line inside rows that share an id are one line.
    found = lines.join(if_small(involved), ["doc_id", "no"]).dropDuplicates(["doc_id", "no"])
    for side in ("a", "b"):
        own = found.select(F.col("doc_id").alias(f"{side}_doc"), F.col("no").alias(f"{side}_no"), F.col("key").alias(side), F.xxhash64("key").alias(f"{side}_id"))
        pairs = pairs.join(own, [f"{side}_doc", f"{side}_no"])
    return materialise(pairs.where(F.expr(within_edits("a", "b", edits))).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = 1, min_chars: int = 16, crowd: int = 32) -> DataFrame:
    """The documents with their repeated lines removed from the text, and n_lines and n_removed."""
    docs = docs.drop(*ADDED)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    lines = plain.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).select("doc_id", "no", F.expr(_TRIM.format("line")).alias("key"))
    compared = lines.where(F.length("key") >= max(min_chars, edits + 1))
    occurs = materialise(lines.select("doc_id", "no", F.when(F.length("key") >= max(min_chars, edits + 1), F.xxhash64("key")).alias("lid")))
    known = occurs.where("lid IS NOT NULL")
    uniq = _first(known, "lid")
    links = similar_lines(compared, materialise(uniq.select("doc_id", "no")), edits, crowd)
    classes = connected_components(links).select(F.col("id").alias("lid"), "component")
    kept = _first(known.join(classes, "lid", "left").select("doc_id", "no", F.coalesce("component", "lid").alias("class")), "class")
    flags = occurs.join(kept.select("doc_id", "no", F.lit(True).alias("kept")), ["doc_id", "no"], "left")
    flags = flags.groupBy("doc_id", "no").agg(F.min(F.expr("lid IS NOT NULL AND kept IS NULL")).alias("gone"))
    flags = flags.groupBy("doc_id").agg(F.expr("transform(array_sort(collect_list(struct(no, gone))), x -> x.gone)").alias("gone"))
    # The row travels as one column, so that its own names can't clash with those used here.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(flags, "doc_id", "left")
    cut = F.expr("array_join(zip_with(split(text, '\n'), gone, (l, g) -> IF(coalesce(g, false), NULL, coalesce(l, ''))), '\n')")
    kept = F.when(F.exists("gone", lambda g: g), cut).otherwise(F.col("text"))
    return rows.select(
        *(kept.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter("gone", lambda g: g)), F.lit(0)).cast("long").alias("n_removed"),
    )


def _first(rows: DataFrame, key: str) -> DataFrame:
    """(doc_id, no, key) of the first row of each key. Only minima are taken by the key itself, which may be hot."""
    doc = rows.groupBy(key).agg(F.min("doc_id").alias("doc_id"))
    return rows.groupBy("doc_id", key).agg(F.min("no").alias("no")).join(doc, ["doc_id", key])
