from quillon.plans import inspection as I
from quillon.plans.tables import table

SF = "/root/testdata/sf0.001"


def test_filters_and_columns_reach_the_scan(spark):
    plan = I.explain(table(spark, SF, "lineitem").filter("l_orderkey = 5").select("l_quantity"))
    assert "PushedFilters: [IsNotNull(l_orderkey), EqualTo(l_orderkey,5)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_tables_and_statistics(spark):
    nation = table(spark, SF, "nation")
    assert [f.rsplit("/", 1)[1] for f in I.tables_used(nation)] == ["nation.parquet"]
    assert [r["name"] for r in I.table_info(nation).collect()] == ["n_nationkey", "n_name", "n_regionkey"]
    assert {r["name"]: (r["rows"], r["nulls"]) for r in I.statistics(nation).collect()}["n_name"] == (25, 0)


def test_text(spark):
    assert I.normalize_sql("select  a, 'x''y' from t -- c\n where b=12.5") == "SELECT A,? FROM T WHERE B=?"
    assert [d.first()[0] for d in I.run_script(spark, "SELECT ';' AS a; SELECT 2 AS b;")] == [";", 2]
