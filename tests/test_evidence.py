"""Operators against the cases that define them."""

import datetime

import pytest
from pyspark.sql import functions as F

from sievework.functions import dates as D
from sievework.functions import text as T
from sievework.functions import passages as P
from sievework.functions.scores import overlap_score, version_order
from sievework.functions.themes import classify
from sievework.operators import audit, coverage, integrity, merge, resolution, sequences, temporal
from sievework.sources import tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_norms_and_keys(spark):
    r = one(spark, T.norm(F.lit(None)), T.norm(F.lit("  x ")), T.norm_number(F.lit(0.5)), T.norm_number(F.lit(100.0)), T.natural_key(F.lit("a"), F.lit(None), F.lit(" b ")))
    assert tuple(r) == ("", "x", "0.5", "100", "a||b")
    a, b = one(spark, T.fingerprint(F.lit("a"), F.lit(None)), T.fingerprint(F.lit("a "), F.lit("")))
    assert a == b and len(a) == 16


@pytest.mark.parametrize(
    "detail, classes",
    [
        ("homepage unreachable (status 403, )", []),
        ("HTTPError: 429 from CDX", ["rate_limited"]),
        ("docket 1429 filed 2020", []),
        ("robots.txt on example disallows /", ["source_refusal"]),
        ("Web Page Blocked! attack id 8812", ["egress_blocked"]),
        ("x CERTIFICATE_VERIFY_FAILED y", ["egress_blocked"]),
        ("edge rate limiting, and robots.txt", ["source_refusal", "rate_limited"]),
        ("[access_class=rate_limited] robots.txt was fine", ["rate_limited"]),
        ("", []),
        (None, []),
    ],
)
def test_access(spark, detail, classes):
    r = one(spark, T.access_classes(F.lit(detail).cast("string")).alias("all"), T.access_class(F.lit(detail).cast("string")).alias("one"))
    assert r.all == classes and r.one == (classes[0] if classes else None)


def test_names(spark):
    assert one(spark, T.strip_legal_suffix(F.lit("Foo Holdings Company, Inc.")))[0] == "Foo Holdings"
    assert one(spark, T.strip_legal_suffix(F.lit("Duke Manufacturing Co.")))[0] == "Duke Manufacturing"
    assert one(spark, T.squeeze_initials(F.lit("J E DUNN CONSTRUCTION")))[0] == "JE DUNN CONSTRUCTION"
    assert one(spark, T.name_tokens(F.lit("Eastmere Express, Inc.")))[0] == ["EASTMERE", "EXPRESS"]
    places = {"OH": "OH", "Chicago, IL": "IL", "Salt Lake City, UT": "UT", "Foreign Nation": "", "XX": "", None: ""}
    for place, code in places.items():
        assert one(spark, T.state_code(F.lit(place).cast("string")))[0] == code


def test_states(spark):
    places = {"Michigan": "MI", "Meridian, Idaho": "ID", "Seattle, Wash.": "WA", "Dallas, Texas": "TX", "Columbus OH 43004": "OH", "SLC, UTAH": "UT", "Reno, Nevada (US Ops)": "NV", "A, OH, Canada": "OH", "San Juan, PR": "PR", "\tva ": "VA", "OH, Texas": "TX", "Toronto, Ontario": "", "Oh.": "", "": ""}
    rows = spark.createDataFrame(list(places.items()), "place string, code string")
    assert rows.where(T.state_code(F.col("place")) != F.col("code")).collect() == []
    assert len(T.STATES) == 58 and len(T.STATE_CODES) == 56


def score(spark, a, b):
    return one(spark, overlap_score(T.name_tokens(F.lit(a).cast("string")), T.name_tokens(F.lit(b).cast("string"))))[0]


def test_scores(spark):
    assert score(spark, "Eastmere Express", "SOUTHEASTMERE EXPRESS INC") < 0.4
    assert score(spark, "Venture Logistics", "VENTURE TRANSPORT LLC") >= 0.55
    assert score(spark, "Duke Manufacturing", "DUKE MANUFACTURING CO") == 1.0
    assert score(spark, "Acme Logistics", "Bravo Logistics") < 0.55
    assert score(spark, "", "ANYTHING") == score(spark, "X", None) == 0.0


def test_resolution(spark):
    queries = spark.createDataFrame([(1, "Eastmere Express"), (2, "Zenko Group"), (3, "QLS Logistics"), (4, "Anything")], "id long, name string")
    candidates = spark.createDataFrame([(11, "SOUTHEASTMERE EXPRESS INC"), (12, "EASTMERE EXPRESS INC"), (13, "ZENKO LOGISTIC SERVICES LLC"), (14, "ZENKO TRANSPORTATION SERVICES LLC"), (15, "Qls Plaster And Ceilings Inc.")], "id long, name string")
    out = {r.query_id: r for r in resolution.resolve(queries, candidates).collect()}
    assert (out[1].status, out[1].winner_id) == ("resolved", 12)
    # Candidates are there, but none scores enough; without any candidate there is none.
    assert out[3].status == "below_threshold" and out[4].status == "below_threshold" and out[3].winner_id is None
    assert {r.status for r in resolution.resolve(queries, candidates.limit(0)).collect()} == {"no_candidate"}
    pair = spark.createDataFrame([(13, "ZENKO SERVICES LLC"), (14, "ZENKO SERVICES INC")], "id long, name string")
    assert resolution.resolve(queries.where("id = 2"), pair).first().status == "ambiguous"
    assert resolution.resolve(queries.where("id = 2"), pair, accept_multiple=True).first().status == "resolved"


def test_resolution_loses_no_match(spark):
    """Against the scores of all pairs: weak words, repeated names, names that are one word that most have, names without tokens."""
    import random

    rng = random.Random(2)
    words = ["Best"] * 12 + [f"W{k}" for k in range(12)] + ["Freight", "Logistics", "Supply", "Inc", "Group"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    queries = spark.createDataFrame([(i, name()) for i in range(80)] + [(90, "Best"), (91, ""), (92, None), (93, "Freight"), (94, "Unheard Of")], "id long, name string")
    candidates = spark.createDataFrame([(i, name()) for i in range(150)], "id long, name string")
    best = {}
    for r in resolution.scored_pairs(queries, candidates).collect():
        best.setdefault(r.query_id, []).append((r.score, r.candidate_id))
    for r in resolution.resolve(queries, candidates).collect():
        own = best.get(r.query_id, [])
        top = max([s for s, _ in own], default=0)
        ties = [c for s, c in own if s >= 0.55 and s >= top - 0.12]
        status = "below_threshold" if top < 0.55 else "ambiguous" if len(ties) > 1 else "resolved"
        assert (r.status, r.ties, r.score) == (status, len(ties), top if top >= 0.55 else None)
        assert r.winner_id == (min(c for s, c in own if s == top) if status == "resolved" else None)


def test_merge_scenario(spark):
    schema = "k string, v string, turn int"
    empty = spark.createDataFrame([], "k string, v string, is_human boolean, is_invalid boolean")
    step = lambda have, rows: {(r.k, r.turn): r.action for r in merge.sync_actions(have, spark.createDataFrame(rows, schema), ["k"], ["v"], "turn").collect()}
    person = spark.createDataFrame([("alpha", "A", True, False)], empty.schema)
    assert step(person, [("alpha", "B", 1), ("alpha", "B", 2), ("alpha", "A", 3)]) == {("alpha", 1): "conflict", ("alpha", 2): "conflict", ("alpha", 3): "unchanged"}
    assert step(empty, [("alpha", "a", 1), ("beta", "b", 1)]) == {("alpha", 1): "inserted", ("beta", 1): "inserted"}
    have = spark.createDataFrame([("alpha", "a", False, False), ("beta", "b", True, False), ("bad", "x", False, True)], empty.schema)
    assert step(have, [("alpha", "a", 1), ("alpha", "c", 2), ("beta", "z", 1), ("bad", "y", 1)]) == {("alpha", 1): "unchanged", ("alpha", 2): "updated", ("beta", 1): "conflict", ("bad", 1): "invalid"}
    assert step(empty, [("gamma", "g", 1), ("gamma", "g", 2)]) == {("gamma", 1): "inserted", ("gamma", 2): "unchanged"}
    proposed = spark.createDataFrame([("alpha", "new", 1), ("beta", "new", 1)], schema)
    merged = merge.apply_actions(have, merge.sync_actions(have, proposed, ["k"], ["v"], "turn"), ["k"], ["v"], "turn")
    assert {(r.k, r.v) for r in merged.collect()} == {("alpha", "new"), ("beta", "b"), ("bad", "x")}


def test_coverage_filters(spark):
    rows = [("r", "absent_confirmed", "scoped", "active"), ("r", "absent_confirmed", "scoped", "routing_only"), ("r", "covered", "probe", None)]
    out = coverage.coverage_rollup(spark.createDataFrame(rows, "run string, outcome string, scope string, signal_status string"), ["run"]).first()
    assert out.attempts_total == 1 and out.coverage_rate == 1.0


def test_versions(spark):
    rows = spark.createDataFrame([("h", "v1.9"), ("h", "v1.10"), ("h", "v1.2")], "h string, v string")
    assert [r.v for r in coverage.latest_versions(rows, "h", "v").collect()] == ["v1.10"]
    assert one(spark, version_order(F.lit("v2.03.x")))[0] == [2, 3]


def test_gate(spark):
    rows = [("small", "excluded")] * 3 + [("small", "supported")] * 16 + [("large", "excluded")] * 2 + [("large", "supported")] * 18 + [("wrong", "wrong_entity")] + [("wrong", "supported")] * 99
    out = {r.h: r for r in audit.gate(spark.createDataFrame(rows, "h string, verdict string"), "h").collect()}
    assert out["large"].exclusion == 0.10 and out["large"].verdict == "pass" and out["large"].threshold == 0.10
    assert out["small"].threshold == 0.15 and out["small"].verdict == "fail" and out["wrong"].verdict == "fail"


def test_bound():
    assert audit.zero_found_bound(20, 20) == 0 and audit.zero_found_bound(100, 30) == 8
    assert audit.zero_found_bound(1000, 30) > audit.zero_found_bound(1000, 100) > 0


def test_allocation(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, n long")
    assert {r.k: r.allotted for r in audit.allocate(rows, "k", "n", 7).collect()} == {"a": 4, "b": 2, "c": 1}


def test_empty_stratum_is_kept(spark):
    out = audit.strata_counts(spark.range(5), {"all": F.lit(True), "none": F.col("id") > 9})
    assert {r.stratum: r.n for r in out.collect()} == {"all": 5, "none": 0}


def test_breaker(spark):
    rows = [("c", i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1, 1, 0])] + [("d", i, 0) for i in range(4)]
    out = sequences.breaker_stops(spark.createDataFrame(rows, "k string, at long, bad int"), "k", "at", F.col("bad") == 1, 3).collect()
    assert [(r.k, r.stopped_at) for r in out] == [("c", 5)]


def test_problems_reject_the_batch(spark):
    rows = spark.range(3).select("id", integrity.problems((F.col("id") == 2, "two")).alias("problems"))
    assert integrity.require(rows.where("id < 2")).count() == 2
    with pytest.raises(Exception, match="rejected: two"):
        integrity.require(rows).collect()


def test_dates(spark):
    r = one(spark, D.parse_date(F.lit("20201027")), D.parse_date(F.lit("3/9/2021")), D.parse_date(F.lit("n/a")), D.week_id(F.lit("2021-01-03").cast("date")), D.in_five_years(F.lit("2019-02-28").cast("date"), F.lit("2024-02-29").cast("date")))
    assert tuple(r) == (datetime.date(2020, 10, 27), datetime.date(2021, 3, 9), None, "2020-W53", True)


def themes_of(spark, text):
    return {t.theme: t.admitted for t in one(spark, classify(F.lit(text)).alias("t")).t}


def test_themes(spark):
    assert themes_of(spark, "a new WMS and warehouse automation") == {"warehouse_automation": True}
    assert themes_of(spark, "we use SAP") == {"erp_core_systems": False}
    assert themes_of(spark, "from SAP to Oracle") == {"erp_core_systems": True}
    assert themes_of(spark, "AWS and Azure and a mainframe") == {"cloud_infrastructure_migration": False}
    assert themes_of(spark, "an API for post-merger integration") == {"systems_integration": False}
    assert themes_of(spark, "AI-first") == {} and themes_of(spark, "plain text") == {}


def history(spark, reach="archival", cls="IC1", presence=False, rows=(), valid=True, seen_reach="archival"):
    day = lambda s: datetime.date.fromisoformat(s)
    themes = spark.createDataFrame([("early", day("2026-08-24")), ("late", day("2026-08-31"))], "theme string, since date")
    instruments = spark.createDataFrame([("s", t, cls, presence, reach, 12, None) for t in ("early", "late")], "signal string, theme string, instrument_class string, presence_only boolean, reach string, months int, effective date")
    tried = spark.createDataFrame([("X1", "s", "absent_confirmed", day("2026-09-03"))], "company_id string, signal string, outcome string, seen date")
    seen = spark.createDataFrame([(f"O{i}", "X1", "early", day(p), day("2026-09-03"), seen_reach, 0, None, "active_transition", "B", 0.7, valid) for i, p in enumerate(rows)], "observation_id string, company_id string, theme string, published date, seen date, reach string, months int, effective date, state string, grade string, confidence double, valid boolean")
    companies = spark.createDataFrame([("X1",)], "company_id string")
    out = temporal.state_history(companies, themes, temporal.week_buckets(spark, "2026-08-24", "2026-09-05"), tried, seen, instruments)
    return {(r.theme, r.bucket_id): (r.status, r.reason, r.state) for r in out.collect()}


def test_history_gates(spark):
    out = history(spark)
    assert out["late", "2026-W35"] == ("null", "theme_not_detectable", None)
    assert out["early", "2026-W35"] == ("null", "no_absence_license", None)
    assert history(spark, cls="IC4")["early", "2026-W35"] == ("absent", "absence_licensed_IC4", None)
    out = history(spark, reach="current_only")
    assert out["early", "2026-W35"][1] == "no_reach" and out["early", "2026-W36"][1] != "no_reach"
    assert history(spark, reach="current_only", cls="IC3", presence=True)["early", "2026-W36"] == ("null", "no_absence_license", None)


def test_history_evidence(spark):
    out = history(spark, rows=["2026-08-26"])
    assert out["early", "2026-W35"] == out["early", "2026-W36"] == ("observed", "observed", "active_transition")
    out = history(spark, rows=["2026-09-02"])
    assert out["early", "2026-W35"][0] == "null" and out["early", "2026-W36"][0] == "observed"
    assert history(spark, rows=["2026-08-26"], valid=False)["early", "2026-W35"][0] == "null"
    # A source that shows only what is there now speaks for the week it was read in.
    out = history(spark, rows=["2026-08-26"], seen_reach="current_only")
    assert out["early", "2026-W35"][0] == "null" and out["early", "2026-W36"][0] == "observed"


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    df.write.parquet(f"{tmp_path}/t.parquet")
    assert tables.read_table(spark, str(tmp_path), "t", df.schema).count() == 1
    with pytest.raises(ValueError, match="declared"):
        tables.read_table(spark, str(tmp_path), "t", spark.createDataFrame([], "k string").schema)
    feed = tables.read_feed(spark, spark.createDataFrame([('{"a": 1}',), ("oops",)], "j string"), "j", "a int")
    assert {(r.a, r.unreadable) for r in feed.collect()} >= {(1, False)}


def test_first_ids_of_hot_groups(spark):
    rows = spark.range(0, 20000, 1, 8).select(F.when(F.col("id") % 3 > 0, "hot").alias("kind"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("id"))
    issues = coverage.known_issues(rows.unionByName(rows), "kind", "id", shown=3)
    assert {r.kind: (r.failures, r.ids) for r in issues.collect()} == {"hot": (26666, "10, 100, 1000 +6663 more"), None: (13334, "0, 10002, 10008 +3331 more")}
    assert "collect_set" not in issues._jdf.queryExecution().toString()


def test_surrogate_ids_in_ranges(spark):
    new = spark.range(0, 5000, 1, 8).select(F.when(F.col("id") != 9, F.col("id") * 7 % 5003).alias("v"))
    known = spark.createDataFrame([("O00041",), ("X9",)], "oid string")
    out = merge.surrogate_ids(new, known, "oid", "O", F.col("v"), range_rows=300)
    assert out.columns == ["v", "oid"]
    ordered = sorted((r.v for r in out.collect()), key=lambda v: -1 if v is None else v)
    assert {r.v: r.oid for r in out.collect()} == {v: f"O{42 + k:05d}" for k, v in enumerate(ordered)} and len(ordered) == 5000
    assert "windowspecdefinition(_range#" in out._jdf.queryExecution().toString()


def test_page_links_are_rows(spark, tmp_path):
    import __spark_entry__ as entry

    html = '<a href="/one">1</a> <A class="x" href="http://h/two">2</A>'
    spark.createDataFrame([(1, "http://h/1", html), (2, "http://h/2", "<p>none</p>"), (3, "http://h/3", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = entry.queries()["page_link_rows"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in out) == [(1, 0, "/one"), (1, 1, "http://h/two")]


def dealt(sizes, total, floor):
    """Proportional shares by largest remainders; whoever falls short of the floor gets it, and the rest is dealt anew."""
    fixed = {}
    while True:
        rest = {k: v for k, v in sizes.items() if k not in fixed}
        room, whole = max(0, total - sum(fixed.values())), sum(rest.values())
        got = {k: min(v, v * room // whole) if whole else 0 for k, v in rest.items()}
        for k in sorted(rest, key=lambda k: (-(rest[k] * room % whole) if whole else 0, k)):
            if got[k] < rest[k] and sum(got.values()) < min(room, whole):
                got[k] += 1
        short = {k: min(floor, sizes[k]) for k in rest if got[k] < min(floor, sizes[k])}
        if not short:
            return fixed | got
        fixed |= short


def test_allocation_with_floor(spark):
    import random

    from sievework.operators import rollups

    rng = random.Random(9)
    for sizes in [{f"k{i}": rng.choice([1, 2, 5, 30, 400]) for i in range(rng.randint(1, 7))} for _ in range(8)] + [{"a": 3}]:
        total, floor = rng.choice([1, 10, 40, 10_000]), rng.choice([0, 3, 12])
        out = rollups.allocate_with_floor(spark.createDataFrame(list(sizes.items()), "key string, n long"), total, floor).collect()
        assert {r.key: r.allotted for r in out} == dealt(sizes, total, floor), (sizes, total, floor)
    assert rollups.allocate_with_floor(spark.createDataFrame([], "key string, n long"), 5, 1).count() == 0


def test_names_behind_accents(spark):
    """A capital with an accent is no part of a name's word: the other engine's edges know ASCII only."""
    import duckdb

    texts = ["\u00c9OII\nAcme Inc, Beta Corp", "CI\u00d3NASC\nAcme Inc", "Acme Co.X and Acme Co. x", "Acme LLC\u00e9", "xAcme LLC, Acme\x0bInc", "_Acme Group, Acme Groups"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(P.organisations(F.col("t")).alias("o")).collect()
    for text, row in zip(texts, rows, strict=True):
        named = duckdb.execute("SELECT regexp_extract_all(?, ?)", [text, P.ORGANISATION]).fetchone()[0]
        assert sorted(row.o) == sorted({" ".join(n.split()).strip(" .,").lower() for n in named if len(n) >= 6})


def test_terms_by_their_required_runs(spark):
    """What a term requires is in lower case in every match, and themes are told as if each term was searched for."""
    import re

    from sievework.functions.themes import THEMES, required
    from sievework.plans.signals import REMARKS

    patterns = [p for t in (*THEMES, *P.BUYER_VOICE) for p in (*t.specific, *t.generic, *t.exclusions)]
    found = [(p, m.group(0)) for p in patterns for r in (*REMARKS, " ".join(REMARKS).upper()) for m in re.finditer(p, r, re.IGNORECASE)]
    assert len(found) > 50 and all(required(p) in m.lower() for p, m in found)
    assert [required(p) for p in (r"\bWMS\b", r"labo(u)?r (a|b)", r"fulfil?ment", r"a{0,2}bc", "this|that", r"S/4\s?HANA", r"\d+x")] == ["wms", "labo", "fulfi", "bc", "", "hana", "x"]
    rows = spark.createDataFrame([(r,) for r in (*REMARKS, *map(str.upper, REMARKS), "Post-Merger Integration of an API", "")], "t string")
    for row in rows.select("t", classify(F.col("t")).alias("c")).collect():
        told = {x.theme: x.hits for x in row.c}
        for t in THEMES:
            own = row.t
            for p in t.exclusions:
                own = re.sub(p, " ", own, flags=re.IGNORECASE)
            hits = [m.group(0) for p in (*t.specific, *t.generic) if (m := re.search(p, own, re.IGNORECASE))]
            assert told.get(t.key, []) == hits


def test_customers_are_dealt_over_tasks(spark):
    """A table of one file and row group is not one task's work."""
    from sievework.plans.articles import words, worked_out
    from sievework.plans.standin import standin

    standin(spark, "/root/testdata/sf0.001")
    assert words(spark).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plan = worked_out(words(spark), x=F.upper("w")).where("x > 'A' AND length(x) > 2").select("k", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1


@pytest.fixture
def joined_by_shuffle(spark):
    """Small tables are joined as large ones are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _lines(df, *words):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if all(w in line for w in words)]


def test_merge_stays_where_its_orders_were_dealt(spark, joined_by_shuffle):
    """more tasks as the table grows, and nothing is dealt again over a fixed number of them."""
    from sievework.queries import QUERIES

    assert tables.dealt(spark.range(1000), "id", rows=100).rdd.getNumPartitions() == 11
    for name in ("merge_actions", "merge_result", "unreproduced_split"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert _lines(plan, "Exchange", "REPARTITION_BY_NUM") and not _lines(plan, "Exchange", "ENSURE_REQUIREMENTS"), name


def test_attempts_are_not_dealt_by_their_few_signals(spark, joined_by_shuffle):
    """F16, F17: a signal is no key to deal by; licences combine in a hash table."""
    from sievework.queries import QUERIES

    plan = QUERIES["temporal_state_history"](spark, "/root/testdata/sf0.001")
    assert not _lines(plan, "Exchange hashpartitioning(signal#")
    assert not _lines(plan, "SortAggregate", "instrument_class") and _lines(plan, "HashAggregate", "instrument_class")


def test_references_are_dealt_before_they_are_looked_up(spark, joined_by_shuffle):
    """lines are sorted and counted in the tasks that they were dealt over; only the orders come to them."""
    from sievework.queries import QUERIES

    plan = QUERIES["integrity_findings"](spark, "/root/testdata/sf0.001")
    assert len(_lines(plan, "Exchange hashpartitioning(l_orderkey", "ENSURE_REQUIREMENTS")) == 1
    assert len(_lines(plan, "Exchange hashpartitioning(l_orderkey", "REPARTITION_BY_NUM")) == 2


def test_more_customers_get_more_tasks(spark):
    """F21."""
    from sievework.plans.articles import words

    spark.range(200_000).withColumnRenamed("id", "c_custkey").createOrReplaceTempView("customer")
    assert words(spark).rdd.getNumPartitions() == 41


def test_every_posting_term_is_ruled_out_by_its_letters(spark):
    """no pattern runs over a text that has none of its pieces."""
    from sievework.functions import postings

    terms = [t for of in postings.SIGNALS.values() for t in of]
    assert all(postings.pieces(t.rx) for t in terms)
    assert postings.pieces(r"\b(AWS|Azure|GCP)\b") == ["AWS", "Azure", "GCP"] and postings.pieces(r"\bI&C\b") == ["I&C"] and postings.pieces(r"\b(a|b)?c\b") == []
    told = lambda text: one(spark, postings.classify_posting(F.lit(text)).alias("c")).c
    assert told("Ml and PLATFORM Engineer")["signals"] == ["cloud_infrastructure_hiring"]
    assert told("I&C lead on AS/RS")["signals"] == ["warehouse_systems_automation_hiring", "ot_modernization_hiring"]
