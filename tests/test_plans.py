"""Every registered query that has SQL, against DuckDB, on the smallest tables; and the native operators."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.functions import identity
from plumbline.operators import native
from plumbline.operators.sections import SECTIONS, section
from plumbline.plans import relational, review
from plumbline.sources.corpora import from_files, generated, notes_of, write_exports

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


def plain(v):
    return round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def same(spark, duck, name, plan, sql):
    df = plan(spark, SF)
    names = sorted(df.columns)
    cur = duck.execute(sql)
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == names
    want = sorted(tuple(str(plain(r[theirs.index(n)])) for n in names) for r in cur.fetchall())
    assert sorted(tuple(str(plain(r[n])) for n in names) for r in df.collect()) == want, name


@pytest.mark.parametrize("name", sorted(relational.PLANS))
def test_relational(spark, duck, name):
    same(spark, duck, name, relational.queries()[name], relational.PLANS[name][1])


@pytest.mark.parametrize("name", sorted(review.SQL))
def test_review(spark, duck, name):
    same(spark, duck, name, review.QUERIES[name], review.SQL[name])


@pytest.mark.parametrize("name", sorted(SECTIONS))
def test_sections_do_not_depend_on_partitions(spark, name):
    s = generated(spark, SF, "nations")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(section(s.repartition(3), name)) == key(section(s.coalesce(1), name))
    assert section(s.limit(0), name).count() == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert {"risk_report", "rel_join_inner"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_native_digest_and_text(spark):
    rows = [("",), ("hello",), ("é😀<&>'\"",), ("a\x07‮b",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(native.fnv64(F.col("t")), native.escape_html(F.col("t")), native.visible(F.col("t"))).collect()
    assert [r[0] for r in got] == [identity.fnv(t) if t is not None else None for (t,) in rows]
    assert got[2][1] == "é😀&lt;&amp;&gt;&#039;&quot;" and got[3][2] == "a\\u0007\\u202Eb"


def test_graph_is_sound(spark):
    s = generated(spark, SF, "orders")
    assert native.dangling(section(s, "lineage_edges"), section(s, "lineage_nodes")).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.sql").write_text("SELECT *\nFROM t")
    s = from_files(spark, str(tmp_path / "in"))
    assert [r["code"] for r in section(s, "findings").collect()][0] == "P1"
    write_exports(section(s, "exports"), str(tmp_path / "out"), "markdown")
    assert any("Wildcard" in p.read_text() for p in (tmp_path / "out" / "markdown").glob("part-*"))
    assert "CREATE TABLE n (n_nationkey int" in notes_of({"n": spark.read.parquet(f"{SF}/nation.parquet")})


def test_stream(spark, tmp_path):
    from plumbline.streaming.watch import review_stream

    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.sql").write_text(f"SELECT * FROM t{i}")
        review_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "at")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).where("code = 'P1'").count() == 2
