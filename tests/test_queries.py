"""Every commerce query against its oracle SQL on the smallest tables, and text functions on edge cases."""

import math
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmart.functions.text import code_pattern, normalized, number, tokens
from quillmart.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{float(value):.8g}" if isinstance(value, float | Decimal) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    result = duck.sql(ORACLE_SQL[name])
    names = result.columns
    assert sorted(names) == columns
    assert found == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


@pytest.mark.parametrize("name", ["schema_candidates", "quality_summary", "retrievability", "product_linkage_fuzzy", "product_linkage_all", "name_suggestions", "intent_routing", "flow_vs_baseline", "answer_budget", "answer_search", "answer_profile"])
def test_query_has_rows(spark, name):
    """Queries that SQL cannot say; their operators have plain versions in test_analysis.py."""
    assert QUERIES[name](spark, SF).count() > 0


def test_text_functions(spark):
    frame = spark.createDataFrame([(None,), ("",), ("Ñandú de  Cristal-500ml",), ("1,5",), ("0012",)], "t string")
    rows = frame.select(normalized(F.col("t")), tokens(F.col("t")), number(F.col("t")), code_pattern(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["", "", "NANDU DE CRISTAL 500ML", "1 5", "0012"]
    assert rows[2][1] == ["NANDU", "CRISTAL", "500ML"]
    assert [r[2] for r in rows] == [None, None, -500.0, 1.5, 12.0]
    assert [r[3] for r in rows] == ["EMPTY", "EMPTY", "ALPHANUM_WITH_DASH", "OTHER", "LEADING_ZERO_NUM_4"]


def test_negative_cycle_and_unreached(spark):
    from quillmart.operators import paths

    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", -3.0), ("a", "c", 0.5), ("x", "y", 1.0), ("a", "b", 4.0)], "source string, target string, weight double")
    found = paths.bellman_ford(edges, "a")
    assert {(r.node, r.distance, r.predecessor) for r in found.collect()} == {("a", 0.0, None), ("b", 1.0, "a"), ("c", -2.0, "b")}
    assert paths.negative_cycle_edges(edges, found).isEmpty()
    turning = edges.union(spark.createDataFrame([("c", "b", 1.0)], edges.schema))
    assert not paths.negative_cycle_edges(turning, paths.bellman_ford(turning, "a")).isEmpty()
    assert paths.bidirectional_length(edges.selectExpr("source u", "target v"), "a", "y").first().length is None


def test_delimited_files(spark, tmp_path):
    from quillmart.sources import files

    (tmp_path / "a.csv").write_text("\ufeffid;name\n1;x\n2;\n", encoding="utf-8")
    frame = files.read_delimited(spark, str(tmp_path / "a.csv"))
    assert frame.columns == ["id", "name"] and [tuple(r) for r in frame.collect()] == [("1", "x"), ("2", None)]
    files.write_delimited(spark.createDataFrame([(1, 'a "b", c')], "k int, t string"), str(tmp_path / "b"))
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "b")).collect()] == [("1", 'a "b", c')]
