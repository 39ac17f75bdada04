r"""License scan by ordered signature rules, in DataFrame operations only.

Hundreds of hand-written patterns (`license_rules.py`) run over the words of a text. A keyword prefilter decides which: the words of a text meet the words of all
keywords in one hash lookup, and a pattern is tried only where each word of its keyword is there, so most texts try none. A pattern's matches are
marked in the text and read back as intervals of words. Detections are then taken by start, the longer first, then by priority and rule order, and one is suppressed if
an earlier one of the same or a higher priority reaches as far: an interval inside another says nothing new. A running
end for each priority decides this in one pass over the sorted detections, never by pairs. Base phrases are searched on their own and always stay.

All of it happens inside a row: no shuffle, no hot key, and nothing to lose with an executor but a task.

Words are the maximal runs of ASCII letters and digits and of everything beyond ASCII, with A-Z in lower case; a word's place counts from 0, an interval's end is exclusive.

Cases: a null text is empty and has no words and no detections; repeated rows and rows without an id give a row each; the whole text is searched, whatever its length; other columns are carried
along, those named like the added ones being replaced; an empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import BASE, rules, spaced

WORD = r"[0-9a-z\x80-\x{10FFFF}]+"
#: Confidence of a detection by its tier; a base phrase is a name.
CONFIDENCE = (1.0, 0.95, 0.85, 0.7, 0.3)
ADDED = ("n_words", "base", "detections")
_DETECTION = "STRUCT<start: INT, less: INT, tier: INT, ord: INT, label: STRING>"
#: Detections are gathered in runs of so many, as appending copies a run.
_RUN = 1000


def _table(found: list[tuple[int, int, str, list[str], str]]) -> Column:
    """Rules as one literal array."""
    names = ("ord", "tier", "label", "words", "pattern")
    return F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in found])), "array<struct<ord: int, tier: int, label: string, words: array<string>, pattern: string>>")


def base_rules() -> list[tuple[int, int, str, list[str], str]]:
    """The base phrases as rules of the tier of names, each with its first word as keyword."""
    return [(k, 4, label, phrase.split()[:1], spaced(phrase)) for k, (label, phrase) in enumerate(BASE)]


def _intervals(hits: str) -> str:
    """SQL for the detections of the rules in `hits`: matches marked by \\x01 and \\x02, which no word holds."""
    marked = "split(trim(regexp_replace(norm, r.pattern, concat(' ', chr(1), '$1', chr(2), ' '))), '  ')"
    at = "filter(transform({}, (w, i) -> IF({}, i, NULL)), i -> i IS NOT NULL)"
    starts, ends = at.format("s", "startswith(w, chr(1))"), at.format("s", "endswith(w, chr(2))")
    each = f"zip_with({starts}, {ends}, (b, e) -> named_struct('start', b, 'less', -(e + 1), 'tier', r.tier, 'ord', r.ord, 'label', r.label))"
    return f"flatten(transform({hits}, r -> flatten(transform(array({marked}), s -> {each}))))"


def _suppress(found: str) -> str:
    """SQL for the detections that no earlier one of the same or a higher priority covers."""
    entry = "named_struct('ends', transform(a.ends, (x, p) -> IF(p + 1 >= d.tier, greatest(x, -d.less), x)), 'runs', IF(size(a.run) < {n}, a.runs, array_append(a.runs, a.run)), 'run', IF(size(a.run) < {n}, array_append(a.run, d), array(d)))"
    start = f"named_struct('ends', array_repeat(-1, {len(CONFIDENCE)}), 'runs', CAST(array() AS ARRAY<ARRAY<{_DETECTION}>>), 'run', CAST(array() AS ARRAY<{_DETECTION}>))"
    return f"aggregate(array_sort({found}), {start}, (a, d) -> IF(element_at(a.ends, d.tier) >= -d.less, a, {entry.format(n=_RUN)}), a -> flatten(array_append(a.runs, a.run)))"


def license_scan(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents with n_words, base and detections: arrays of (start, end, label, rule, tier), the base phrases and what the rules keep."""
    kept = [c for c in docs.columns if c not in ADDED]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Two characters beyond ASCII have ASCII letters in lower case; they are words like any other here, and only A-Z may turn into a-z.
    plain = F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("é")), F.lit("İ"), F.lit("é")))
    keywords = sorted({w for _, _, _, words, _ in [*rules(), *base_rules()] for w in words})
    split = docs.select(F.struct(*kept).alias("doc"), F.regexp_extract_all(plain, F.lit(WORD), F.lit(0)).alias("words"))
    gated = split.select("doc", F.size("words").alias("n_words"), F.array_intersect("words", F.split(F.lit(" ".join(keywords)), " ")).alias("gates"), "words")
    gated = gated.select("doc", "n_words", "gates", F.expr("IF(size(gates) > 0, concat(' ', array_join(words, '  '), ' '), '')").alias("norm"))
    tried = "filter(slice({0}, 1, IF(size(gates) > 0, size({0}), 0)), r -> size(array_except(r.words, gates)) = 0 AND norm RLIKE r.pattern)"
    ruled = gated.withColumns({"rules": _table(rules()), "phrases": _table(base_rules())})
    hits = ruled.select("doc", "n_words", "norm", F.expr(tried.format("rules")).alias("hits"), F.expr(tried.format("phrases")).alias("spoken"))
    found = hits.select("doc", "n_words", F.expr(_intervals("hits")).alias("found"), F.expr(_intervals("spoken")).alias("base"))
    seen = "transform({}, d -> named_struct('start', d.start, 'end', -d.less, 'label', d.label, 'rule', d.ord, 'tier', d.tier))"
    result = found.select("doc", F.col("n_words").cast("long").alias("n_words"), F.expr(seen.format("array_sort(base)")).alias("base"), F.expr(seen.format(_suppress("found"))).alias("detections"))
    return result.select(*[F.col(f"doc.`{c}`") for c in kept], *ADDED)


def license_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, label, rule, tier): a row for each detection that is kept, in words."""
    found = license_scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return found.select("doc_id", F.explode("detections").alias("d")).select("doc_id", "d.*")


def license_summary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the confidence of the surest detection)."""
    found = license_scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    sure = f"element_at(array({', '.join(f'{c}D' for c in CONFIDENCE)}), d.tier)"
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.expr("array_min(transform(base, d -> d.start))").cast("long").alias("first_word"), F.expr("array_max(transform(base, d -> d.start))").cast("long").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(base.label)), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(base.label, detections.label))), ',')").alias("labels"),
        F.expr(f"coalesce(array_max(transform(concat(base, detections), d -> {sure})), 0D)").alias("score"),
    )


def oracle() -> str:
    """The same rows in SQL: each pattern on its own, detections kept unless a covering one of the same or a higher priority exists."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    table = [(False, *r) for r in rules()] + [(True, *r) for r in base_rules()]
    values = ",\n".join(f"({base}, {k}, {t}, {q(label)}, [{', '.join(map(q, words))}], {q(p)})" for base, k, t, label, words, p in table)
    confidence = ", ".join(map(str, CONFIDENCE))
    return rf"""
WITH rules(base, ord, tier, label, words, pattern) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS key, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
n AS (SELECT key, doc_id, w, ' ' || array_to_string(w, '  ') || ' ' AS norm FROM d),
m AS (SELECT key, base, ord, tier, label, string_split(trim(regexp_replace(norm, pattern, ' ' || chr(1) || '\1' || chr(2) || ' ', 'g')), '  ') AS s
      FROM n JOIN rules ON list_has_all(n.w, rules.words) AND regexp_matches(norm, pattern)),
x AS (SELECT key, base, ord, tier, label, unnest(list_zip(list_filter(range(len(s)), lambda i: starts_with(s[i + 1], chr(1))), list_filter(range(len(s)), lambda i: ends_with(s[i + 1], chr(2))))) AS z FROM m),
f AS (SELECT key, base, ord, tier, label, z[1] AS b, z[2] + 1 AS e FROM x),
k AS (SELECT * FROM f WHERE base OR NOT EXISTS (SELECT 1 FROM f g WHERE g.key = f.key AND NOT g.base AND g.b <= f.b AND g.e >= f.e AND g.tier <= f.tier
      AND (g.tier < f.tier OR g.e - g.b > f.e - f.b OR g.ord < f.ord))),
a AS (SELECT key, count(*) FILTER (base) AS n_base, min(b) FILTER (base) AS first_word, max(b) FILTER (base) AS last_word,
      list_sort(list_distinct(list(label) FILTER (base))) AS base_labels, list_sort(list_distinct(list(label))) AS labels, max(([{confidence}])[tier]) AS score FROM k GROUP BY key)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM n LEFT JOIN a USING (key)
"""


SQL = oracle()
