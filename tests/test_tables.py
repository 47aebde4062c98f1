"""Reading, naming and cleaning on small hand-made tables."""

import pytest

from netloom.functions.names import backtick_brackets, clean_name, straight_quotes
from netloom.functions.quantiles import exact_quantiles
from netloom.operators import clean as cl
from netloom.operators import rows
from netloom.runtime import dense_index
from netloom.sources import tables as io


def test_names_and_quotes():
    assert clean_name("  a_b c ") == "a-b-c"
    assert straight_quotes("x = “a” and y = ‘b’") == "x = 'a' and y = 'b'"
    assert backtick_brackets("[a-b] = '[c]' and [d]>1") == "`a-b` = '[c]' and `d`>1"


def test_types_and_missing_texts(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,x_y,flag,note,day\n1,2.5,True,"a, ""b""",2020-01-01\n2,NA,False,,2020-01-02\n3,1e2,True,n/a,x\n')
    df = io.load_table(spark, str(path))
    assert df.columns == ["row_id", "id", "x-y", "flag", "note", "day"]
    assert [t for _, t in df.dtypes] == ["bigint", "bigint", "double", "boolean", "string", "string"]
    rows = [tuple(r) for r in df.orderBy("row_id").collect()]
    assert rows[0] == (0, 1, 2.5, True, 'a, "b"', "2020-01-01")
    assert rows[1] == (1, 2, None, False, None, "2020-01-02")


def test_row_ids_are_dense_in_file_order(spark, tmp_path):
    path = str(tmp_path / "n.csv")
    spark.range(5000).repartition(1).sortWithinPartitions("id").write.option("header", True).csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = io.add_row_id(io.read_delimited(spark, path))
        assert df.where("row_id = id").count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_dense_index(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 100003 as k")
    out = dense_index(df, "n", "k").orderBy("k").collect()
    assert [r["n"] for r in out] == list(range(1000))


def test_preview(spark):
    df = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b")], "row_id long, v string")
    out = io.preview(df, 2, tagged=True)
    assert out.columns == ["v$object"] and [r[0] for r in out.collect()] == ["a", "b"]


def test_forward_fill_across_blocks(spark):
    rows = [(i, float(i) if i % 10 == 3 else None, None if i < 25 else "z") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, x double, s string")
    out = [tuple(r) for r in cl.fill_forward(df, block_rows=4).orderBy("row_id").collect()]
    last = None
    for i, x, _ in rows:
        last = x if x is not None else last
        assert out[i][1] == last
    assert out[24][2] is None and out[39][2] == "z"


def test_constant_columns(spark):
    df = spark.createDataFrame([(0, 5.0), (1, 5.0)], "row_id long, x double")
    assert [r["x"] for r in cl.scale_min_max(df, ["x"]).collect()] == [0.0, 0.0]
    assert [r["x"] for r in cl.scale_z(df, ["x"]).collect()] == [0.0, 0.0]
    assert cl.drop_outliers(df, ["x"]).count() == 0


def test_one_hot_refuses_too_many(spark):
    df = spark.range(20).selectExpr("id as row_id", "cast(id as string) as s")
    with pytest.raises(ValueError):
        cl.one_hot(df, ["s"], max_values=10)


def test_quantiles_with_heavy_repeats(spark):
    values = [1.0] * 50 + [float(i) for i in range(49)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    import numpy as np

    for row in exact_quantiles(df, ["x"], [0.0, 0.1, 0.5, 0.77, 1.0]).collect():
        assert row["quantile"] == pytest.approx(np.quantile(values, row["prob"]))


def test_long_ids_keep_their_digits(spark, tmp_path):
    path = tmp_path / "ids.csv"
    path.write_text("a,b,c\n1234567890123456789,12345678901234567890,1" + "0" * 45 + "\n1234567890123456790,2,3\n")
    df = io.read_delimited(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "decimal(38,0)", "string"]
    assert sorted(r["a"] for r in df.collect()) == [1234567890123456789, 1234567890123456790]


def test_fills_treat_nan_as_missing_and_leave_whole_columns_alone(spark):
    rows = [(0, 1.0, 5, 1), (1, float("nan"), 6, None), (2, None, 7, 2), (3, 3.0, 8, 4)]
    df = spark.createDataFrame(rows, "row_id long, x double, n int, m int")
    for fill, x, m in ((cl.fill_mean, 2.0, 7 / 3), (cl.fill_median, 2.0, 2.0)):
        out = fill(df)
        assert [t for _, t in out.dtypes] == ["bigint", "double", "int", "double"]
        got = {r["row_id"]: (r["x"], r["m"]) for r in out.collect()}
        assert got[1] == pytest.approx((x, m)) and got[2][0] == x and got[0] == (1.0, 1.0)
    forward = {r["row_id"]: r["x"] for r in cl.fill_forward(df).collect()}
    assert forward == {0: 1.0, 1: 1.0, 2: 1.0, 3: 3.0}


def test_forward_fill_with_sparse_ids(spark):
    rows = [(i * 10**12, i if i % 7 == 0 else None) for i in range(500)]
    out = cl.fill_forward(spark.createDataFrame(rows, "row_id long, x int"), block_rows=40)
    assert {r["row_id"] // 10**12: r["x"] for r in out.collect()} == {i: i - i % 7 for i in range(500)}


def test_elapsed_time_ignores_clock_changes(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(0, "2024-03-09 12:00:00"), (1, "2024-03-10 11:59:59.5")], "row_id long, t string")
        days = cl.elapsed(df, ["t"], "2024-03-10 12:00:00").collect()
        seconds = cl.elapsed(df, ["t"], "2024-03-10 12:00:00", "seconds", total=True).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r["t"] for r in days] == [1, 0] and [r["t"] for r in seconds] == [86_400, 0]


def test_one_hot_as_rows(spark):
    df = spark.createDataFrame([(0, "a"), (1, None), (2, "b")], "row_id long, c string")
    assert sorted(tuple(r) for r in cl.one_hot_long(df, ["c"]).collect()) == [(0, "c", "a"), (2, "c", "b")]


def test_sql_leaves_the_callers_views(spark):
    spark.range(3).createOrReplaceTempView("data")
    out = rows.query(spark, "select count(*) AS n from data", {"data": spark.range(7)})
    assert out.first()["n"] == 7
    assert spark.table("data").count() == 3
    spark.catalog.dropTempView("data")
    rows.query(spark, "select * from data", {"data": spark.range(7)})
    assert "data" not in {t.name for t in spark.catalog.listTables()}


def test_foreign_encoding_leaves_no_setting(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("名,n\n漢字,1\n".encode("gbk"))
    before = spark.conf.get(io.JAVA_CHARSETS)
    table = io.read_delimited(spark, str(tmp_path / "t.csv"), "GBK")
    assert spark.conf.get(io.JAVA_CHARSETS) == before
    assert [tuple(r) for r in table.collect()] == [("漢字", 1)]
