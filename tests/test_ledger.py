"""Stored versions, migrations, draws, nested JSON, sheets, exports and speakers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import json_tree
from sievework.operators import audit, migrations
from sievework.operators import passages as O
from sievework.sources import sheets, tables
from sievework.sources import versions as V


def test_versions_are_committed_whole_or_not_at_all(spark, tmp_path):
    path = f"{tmp_path}/v"
    rows = spark.createDataFrame([(1, "a", "h"), (2, None, "h")], "k long, v string, stamp string")
    assert V.versions(spark, path).count() == 0
    assert V.write_version(rows, path, "DR-0001", stamps=("stamp",))
    with pytest.raises(ValueError, match="append-only"):
        V.write_version(rows, path, "DR-0001")
    with pytest.raises(ValueError, match="stamps: v"):
        V.write_version(rows, path, "DR-0002", stamps=("stamp", "v"))
    # What was written without a commit is there as files and is not read.
    with pytest.raises(ValueError, match="no version DR-0002"):
        V.read_version(spark, path, "DR-0002")
    assert [r.version for r in V.versions(spark, path).collect()] == ["DR-0001"]
    # The same rows, dealt out otherwise, are no new version unless forced.
    again = rows.repartition(3).select("stamp", "v", "k")
    assert not V.write_version(again, path, "DR-0002", force=False) and V.write_version(again, path, "DR-0002")
    assert sorted(V.read_version(spark, path, "DR-0002").select("k", "v").collect()) == sorted(rows.select("k", "v").collect())


def test_two_writers_of_a_version(spark, tmp_path, monkeypatch):
    """Both see no version at first; the one that commits later is refused, and the first one's rows stay."""
    path, rows = f"{tmp_path}/v", spark.createDataFrame([(1,)], "k long")
    real = V._exists
    monkeypatch.setattr(V, "_exists", lambda s, p: False if p.endswith("/manifest/A.json") else real(s, p))
    V.write_version(rows, path, "A")
    with pytest.raises(ValueError, match="another writer"):
        V.write_version(rows.selectExpr("k + 1 AS k"), path, "A")
    assert [r.k for r in V.read_version(spark, path, "A").collect()] == [1]


def test_comparing_versions(spark):
    schema = "k string, s string, n int"
    old = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("c", None, 1), (None, "x", 1), ("gone", "x", 1)], schema)
    new = spark.createDataFrame([("a", "y", 2), ("b", "x", 2), ("c", None, 1), (None, "x", 1), ("d", "x", 1)], schema)
    found = V.compare_versions(old, new, ["k"], ["s"], ["n"])
    assert {(r.k, r.change) for r in found.collect()} == {("a", "changed"), ("b", "evidence_only"), ("d", "new")}


def test_migrations(spark, tmp_path):
    base = spark.createDataFrame([(1, "old", False), (2, "b", True), (3, "old", False)], "k long, topic string, human boolean")
    rename = migrations.Step("rename", lambda d: migrations.rename_keys(d, "topic", {"old": "new"}, "human"), "old -> new")
    add = migrations.Step("add", lambda d: d.withColumn("x", F.lit(1)), "x = 1")
    drop = migrations.Step("drop", lambda d: d.where("k < 3"), "k < 3", lambda n: n - 1)
    path = f"{tmp_path}/m"
    run = lambda steps: [(r.step, r.action, r.rows_after) for r in migrations.run_steps(spark, path, base, steps).orderBy("seq").collect()]
    assert run([rename, add]) == [("rename", "applied", 3), ("add", "applied", 3)]
    assert run([rename, add, drop]) == [("rename", "skipped", 3), ("add", "skipped", 3), ("drop", "applied", 2)]
    assert run([rename, add, drop]) == [("rename", "skipped", 3), ("add", "skipped", 3), ("drop", "skipped", 2)]
    assert {(r.k, r.topic, r.x) for r in V.read_version(spark, path, "003_drop").collect()} == {(1, "new", 1), (2, "b", 1)}
    with pytest.raises(ValueError, match="another definition"):
        run([rename, migrations.Step("add", add.change, "x = 2"), drop])
    with pytest.raises(ValueError, match="later step"):
        run([rename, migrations.Step("other", add.change, "x = 1"), drop])
    with pytest.raises(ValueError, match="leaves 1 rows, not 2"):
        run([rename, add, drop, migrations.Step("wrong", lambda d: d.limit(1), "")])
    assert [r.version for r in V.versions(spark, path).orderBy("version").collect()] == ["000_base", "001_rename", "002_add", "003_drop"]
    mine = spark.createDataFrame([(1, "old", True)], base.schema)
    with pytest.raises(Exception, match="a person's row"):
        migrations.run_steps(spark, f"{tmp_path}/n", mine, [rename])


def test_draws_are_stable_and_disjoint(spark):
    rows = spark.range(500).withColumn("kind", (F.col("id") % 3).cast("int"))
    strata = {"a": (F.col("kind") == 0, 7), "b": (F.col("kind") <= 1, 20), "c": (F.lit(True), 1000), "none": (F.col("id") < 0, 5)}
    drawn = spark.range(0, 500, 2).toDF("already")
    draw = lambda df: sorted((r.stratum, r.turn, r.id) for r in audit.draw_strata(df, "id", strata, drawn).collect())
    found = draw(rows)
    assert found == draw(rows.repartition(17).sortWithinPartitions(F.rand(3)))
    ids = [i for _, _, i in found]
    assert len(ids) == len(set(ids)) == 250 and all(i % 2 for i in ids)
    assert [sum(s == x for s, _, _ in found) for x in strata] == [7, 20, 223, 0]
    assert audit.draw_strata(rows.limit(0), "id", strata).count() == 0


def walk(node):
    yield node
    for inner in [node[k] for k in sorted(node)] if isinstance(node, dict) else node if isinstance(node, list) else []:
        yield from walk(inner)


def test_nested_json(spark):
    rng = random.Random(1)

    def made(depth):
        kind = rng.choice(["dict", "list", "text", "number", "null"]) if depth else rng.choice(["text", "number"])
        if kind == "dict":
            return {k: made(depth - 1) for k in rng.sample(["naics", "a", "b c", "é"], rng.randint(0, 4))}
        if kind == "list":
            return [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return {"text": '"naics": "no" {', "number": rng.randint(0, 9), "null": None}[kind]

    docs = [made(rng.randint(0, 7)) for _ in range(60)] + [{}, [], "naics", {"naics": {"naics": "deep"}}]
    rows = [(k, json.dumps(d)) for k, d in enumerate(docs)] + [(900, "{oops"), (901, None), (902, "")]
    tree = json_tree.nodes(spark.createDataFrame(rows, "k int, body string"), "k", "body")
    found = {}
    for r in tree.withColumn("text", F.to_json("node")).orderBy("id", "path").collect():
        found.setdefault(r.id, []).append(json.loads(r.text) if r.text is not None else None)
    assert found == {k: list(walk(d)) for k, d in enumerate(docs) if True}
    told = {(r.id, r.code) for r in json_tree.fields(tree, {"code": "naics"}).collect()}
    plain = lambda v: v if isinstance(v, str) else json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert told == {(k, plain(n["naics"])) for k, d in enumerate(docs) for n in walk(d) if isinstance(n, dict) and n.get("naics") is not None}


def test_sheets_with_different_headers(spark, tmp_path):
    files = {
        "a.csv": 'JOB_SITE_NAME,CITY_NAME,NOTICE_DATE,TOTAL_LAYOFF_NUMBER\n"Acme, ""A"" Inc",Reno,2024-03-01,12\nOld Co,Elko,2019-01-01,3\n,Elko,2024-01-01,3\n',
        "b.csv": 'List\n\nCounty, notice   DATE ,Company,No. of Employees,Address\nX,5/6/2024,Beta LLC,7,"1 Road, Reno"\n',
        "c.csv": "COMPANY\nNo Date\n",
        "d.csv": "x\n" * 6 + "COMPANY,NOTICE_DATE\nToo Low,2024-01-01\n",
        "e.csv": "",
        "f.csv": "COMPANY,JOB_SITE_NAME,NOTICE DATE\nFirm,Site,20240708\n" + "Many,Many,2024-01-02\n" * 20000,
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # the last file is read in parts
    try:
        rows = sheets.read_sheets(spark, str(tmp_path), since="2020-01-01").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = sorted((r.file, r.name, str(r.date), r["count"] or "", r.city or "") for r in rows if r.name != "Many")
    assert got == [("a.csv", 'Acme, "A" Inc', "2024-03-01", "12", "Reno"), ("b.csv", "Beta LLC", "2024-05-06", "7", "1 Road, Reno"), ("f.csv", "Site", "2024-07-08", "", "")]
    assert sum(r.name == "Many" for r in rows) == 20000
    assert {r.name for r in sheets.read_sheets(spark, f"{tmp_path}/c.csv").collect()} == {"No Date"}


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, "é\nx"), (3, None)], "k int, v string")
    tables.write_export(df, f"{tmp_path}/e")
    raw = [p.read_bytes() for p in (tmp_path / "e").glob("*.csv") if p.stat().st_size]
    assert raw and all(b.startswith(b"\xef\xbb\xbfk,v") for b in raw)
    assert sorted(tables.read_export(spark, f"{tmp_path}/e", "k int, v string").collect()) == sorted(df.collect())


@pytest.mark.parametrize(("text", "company", "found"), [
    ("Kelly Benedict, the firm's head of innovation, said. Zorba grew.", "Zorba Building Co.", [("Kelly Benedict", "head of innovation", "")]),
    ("Kelly Benedict, the firm's head of innovation, said.", "Zorba Building Co.", [("Kelly Benedict", "head of innovation", "company not named near")]),
    ("Jane Roe, chief information and digital officer at Zorba, spoke. Jane Roe, president of Zorba.", "Zorba", [("Jane Roe", "chief information and digital officer", "")]),
    ("Zorba's president, Jane Roe, spoke.", "Zorba", [("Jane Roe", "president", "")]),
    ("An analyst spoke. Jane Roe, president at Zorba.", "Zorba", [("Jane Roe", "president", "speaks for another")]),
    ("Jane Roe, president at Other.", "Zorba", []),
    ("Jane Roe, president at Summit.", "Summit Logistics", [("Jane Roe", "president", "")]),
    ("Zorba's president, Jane Roe", "The Company", []),
    (None, "Zorba", []),
])
def test_speakers(spark, text, company, found):
    row = spark.createDataFrame([(text, company)], "t string, c string").select(O.speakers(F.col("t"), F.col("c")).alias("s")).first()
    assert [(p.name, p.title, p.refused) for p in row.s] == found


def test_a_shape_is_read_through_a_text_once(spark):
    """the cut text of each shape is worked out once, though its places, names and surroundings all look at it."""
    assert str(O.speakers(F.col("t"), F.col("c"))).count("$1") == len(O.SHAPES)
