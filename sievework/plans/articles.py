"""Queries over passages. Each customer gets one of the texts below, made its own by a coined word; the other engine is told what the rules say of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import passages as P
from ..operators import passages as O
from .standin import standin

QUERIES, SQL = {}, {}

#: Customers whose texts one task takes.
CUSTOMERS_PER_TASK = 5_000
_WORDS = "SELECT c_custkey AS k, concat('Zor', translate(CAST(c_custkey AS STRING), '0123456789', 'abcdefghij')) AS w FROM customer"


def words(spark):
    """All customers with their words, dealt by key over several tasks a core, as one small file may hold them all, and over more as they get more; what is grouped or joined by k later stays where it is."""
    customers = spark.sql(_WORDS)
    return customers.repartition(max(4 * spark.sparkContext.defaultParallelism, 1 + customers.count() // CUSTOMERS_PER_TASK), "k")


def worked_out(rows, **columns):
    """Rows with further columns that are worked out once for each row, however often they are used and filtered by later."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _quoted(value) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def cases(inputs: tuple[str, ...], outputs: tuple[str, ...], rows: list[tuple], to: tuple[dict, dict] | None = None):
    """A query over all customers, of which each has the row of its key; {w} in texts and answers is its own word."""

    queries, sql = to or (QUERIES, SQL)

    def add(f):
        names, n = (*inputs, *outputs), len(rows)
        values = ", ".join("(" + ", ".join([str(i), *map(_quoted, row[len(inputs) :])]) + ")" for i, row in enumerate(rows))
        answers = ", ".join(f"replace({c}, '{{w}}', w) AS {c}" if isinstance(next((r[names.index(c)] for r in rows if r[names.index(c)] is not None), None), str) else c for c in outputs)
        sql[f.__name__] = f"SELECT k, {answers} FROM ({_WORDS}) JOIN (VALUES {values}) t(i, {', '.join(outputs)}) ON k % {n} = i"

        def run(spark, sf):
            standin(spark, sf)
            own = {name: F.replace(F.get(F.array(*[F.lit(r[c]) for r in rows]), (F.col("k") % n).cast("int")), F.lit("{w}"), F.col("w")) for c, name in enumerate(inputs)}
            # Worked out behind the dealing, so that no filter on a text moves ahead of it.
            return f(worked_out(words(spark), **own)).select("k", *outputs)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        queries[f.__name__] = run
        return run

    return add


_Q = "We moved every order of the company off paper and into one system, and it shows"
_S = "It was slow and painful work for us all at first"


@cases(("text",), ("quotes", "confidence", "strength"), [
    (f'Ann Lee runs {{w}}. "{_Q}," Lee said.', "explicit", 0.8, "weak_clue"),
    (f'Ann Lee runs {{w}}. Lee said: "{_Q}." Then "{_Q} again," she went on.', "explicit,proximity", 0.8, "repeated_pattern"),
    (f'Ann Lee came. "{_S}," said Lee.', "explicit weak", 0.4, "weak_clue"),
    (f'Bob Lee came. "{_Q}," said Lee.', "", None, None),
    (f'Ann Lee came. {"x" * 300} "{_Q}." {"y" * 300}', "", None, None),
    (f'Ann Lee came. "{_Q}; we cut cost by 12 percent and automated it," Lee Works said.', "", None, None),
    (f'Ann Lee came. "{_Q}; we cut cost by 12 percent and automated it," Lee of {{w}} said.', "explicit", 0.8, "measured_result"),
    ('Ann Lee came. "About Zeta: a maker of things founded long ago and far away from here," Lee said.', "", None, None),
    (f'Ann Lee came. "{_Q}, and we deployed it," Ann Lee said, as "{_S}," adds Lee.', "explicit weak", 0.4, "weak_clue"),
])
def quote_attribution(rows):
    """Quotes of Ann Lee of Lee Works, whose surname is her company's, so only explicit attribution counts there; keys under 2 belong to another firm."""
    own = F.when(F.col("k") % 9 <= 1, F.array(F.lit("Zeta"))).otherwise(F.array(F.lit("LEE"), F.lit("WORKS")))
    rows = worked_out(rows, q=P.quotes(F.col("text"), F.lit("Ann Lee"), own))
    first = F.get("q", F.lit(0))
    some = F.size("q") > 0
    return rows.withColumns({
        "quotes": F.array_join(F.transform("q", lambda q: F.concat(q["attribution"], F.when(q["weak"], " weak").otherwise(""))), ","),
        "confidence": F.when(some, P.quote_confidence(first)), "strength": F.when(some, P.claim_strength(F.col("q"))),
    })


@cases(("text",), ("answers",), [
    ("OUTLET: How was it? ANN LEE: We moved all orders into one system, and that took more than a year of hard work by all of our people. OUTLET: And then? LEE: Next we will do the same for the plants that we have bought in the south of the land over the last years.", 2),
    ("ANN LEE: One label is a heading, not a transcript, however long the text behind it may be, so nothing counts.", 0),
    ("OUTLET: How? BOB RAY: He is nobody that we know, so his words are not counted at all, however long they are. OUTLET: ok", 0),
    ("OUTLET: How? LEE: Too short. OUTLET: Why?", 0),
])
def qa_passages(rows):
    """Answers of an interview between one speaker's label and the next."""
    return rows.withColumn("answers", F.size(O.answers(F.col("text"), F.lit("Ann Lee"))))


@cases(("excerpt",), ("terms",), [("x; matched: erp, {w} , WMS", "erp|{w}|WMS"), ("nothing here", ""), ("matched: one", "one")])
def matched_terms(rows):
    return rows.withColumn("terms", F.array_join(F.filter(F.transform(F.split(F.regexp_extract("excerpt", r"matched:\s*(.*)$", 1), ","), lambda x: F.trim(x)), lambda x: x != ""), "|"))


@cases(("url", "host"), ("kind",), [
    ("https://{w}.com/news/2024/plant", "{w}.com", "own_newsroom"),
    ("https://www.{w}.com/about/team", "{w}.com", "standing_page"),
    ("https://www.prnewswire.com/news-releases/x", "{w}.com", "wire"),
    ("https://trade.com/a", "{w}.com", "third_party"),
])
def own_domain(rows):
    """Whose page it is: the company's newsroom, another page of its own, a wire, or somebody else's."""
    return rows.withColumn("kind", O.page_owner(F.col("url"), F.lower("host")))
