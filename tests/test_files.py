import datetime as dt

import pytest

from tablelens.operators import relational as rel
from tablelens.operators.profile import classify, column_profile
from tablelens.sources import files


@pytest.fixture()
def write(tmp_path):
    def run(text, name="t.csv"):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        return str(path)

    return run


def test_ragged_rows_are_dropped_however_few_columns_are_read(spark, write):
    path = write('id,name,value\n1,"Smith, ""Al""",10\n\n2,x\n3,y,1,2\n  4 ,  z  , 5 \n')
    df = files.read_csv_text(spark, path)
    assert df.count() == 2
    assert [r["id"] for r in df.select("id").orderBy("id").collect()] == ["1", "4"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", 'Smith, "Al"', "10"), ("4", "z", "5")]


def test_headers_are_cleaned_and_made_unique(spark, write):
    path = write("订单 号,a b,a b,A_b,\n1,2,3,4,5\n")
    assert files.read_csv_text(spark, path).columns == ["订单_号", "a_b", "a_b_1", "A_b_2", "column_5"]
    assert files.clean_name("My Table!", ascii_only=True) == "my_table_"
    with pytest.raises(ValueError):
        files.clean_name("")


def test_empty_file_is_an_error(spark, write):
    with pytest.raises(ValueError):
        files.load(spark, write(""))
    with pytest.raises(ValueError):
        files.load(spark, "x.docx")


def test_types(spark, write):
    body = "n,s,d,b,z,e,late\n" + "".join(f"{i},t{i},2024-01-{i % 28 + 1:02d},{'yes' if i % 2 else 'FALSE'},{i % 2},,{i if i < 150 else 'x'}\n" for i in range(160))
    path = write(body)
    df = files.load(spark, path)
    assert classify(df) == {"n": "number", "s": "string", "d": "date", "b": "boolean", "z": "boolean", "e": "string", "late": "string"}
    sampled = files.load(spark, path, sample_rows=100, zero_one_boolean=False)
    assert classify(sampled)["late"] == "number" and classify(sampled)["z"] == "number"
    assert sampled.where("late is null").count() == 10
    first = df.orderBy("n").first()
    assert (first["n"], first["d"], first["b"], first["z"], first["e"]) == (0.0, dt.date(2024, 1, 1), False, False, None)


def test_coercion_rules(spark):
    df = spark.createDataFrame([("1e3", "maybe", "2024/02/30"), ("0x10", "YES", "2024/02/29 10:00"), ("", "", "")], "a string, b string, c string")
    rows = files.apply_types(df, {"a": "number", "b": "boolean", "c": "date"}).collect()
    assert [tuple(r) for r in rows] == [(1000.0, False, None), (None, True, dt.date(2024, 2, 29)), (None, None, None)]


def test_serial_numbers(spark):
    df = spark.createDataFrame([(45306.9,), (1.0,), (None,)], "v double")
    assert [r[0] for r in df.select(files.serial_date(df["v"])).collect()] == [dt.date(2024, 1, 15), dt.date(1899, 12, 31), None]


def test_csv_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', None), (2, "", 2.5)], "i int, s string, v double")
    files.write_csv(df, str(tmp_path / "out.csv"))
    back = files.load(spark, str(tmp_path / "out.csv"), zero_one_boolean=False).orderBy("i")
    assert [tuple(r) for r in back.collect()] == [(1.0, 'a "q", b', None), (2.0, None, 2.5)]


def test_profile_of_edge_columns(spark):
    df = spark.createDataFrame([(1, None, 5.0, "a"), (2**53 + 1, None, 5.0, None), (2**53, None, None, "a")], "big long, none double, c double, s string")
    got = {r["column"]: r for r in column_profile(df).collect()}
    assert got["big"]["distinct"] == 3
    assert (got["none"]["nulls"], got["none"]["distinct"], got["none"]["median"]) == (3, 0, None)
    assert (got["c"]["stddev"], got["c"]["median"], got["s"]["distinct"]) == (0.0, 5.0, 1)


@pytest.mark.parametrize("sql", ["DROP TABLE x", "select 1; delete from x", "WITH a AS (SELECT 1) truncate a", "INSERT INTO x VALUES (1)", "selective"])
def test_sql_guard(sql):
    with pytest.raises(ValueError):
        rel.guard_sql(sql)
    assert rel.guard_sql(" WITH a AS (SELECT 1) SELECT * FROM a ").startswith("WITH")


def test_only_queries_run_and_views_stay(spark):
    df = spark.createDataFrame([(2, "please drop it"), (1, "x")], "a int, b string")
    spark.createDataFrame([(7,)], "q int").createOrReplaceTempView("mine")
    before = {t.name for t in spark.catalog.listTables()}
    assert [r["a"] for r in rel.run_sql(spark, "SELECT a FROM mine WHERE b <> 'drop x' ORDER BY a -- drop it", {"mine": df}).collect()] == [1, 2]
    assert spark.table("mine").columns == ["q"] and {t.name for t in spark.catalog.listTables()} == before
    spark.sql("CREATE TABLE IF NOT EXISTS guarded (a int) USING parquet")
    for sql in ("WITH x AS (SELECT 1 AS a) INSERT INTO guarded SELECT a FROM x", "SELECT 1; SELECT 2", "SELECT 1) UNION (SELECT"):
        with pytest.raises(ValueError):
            rel.run_sql(spark, sql, {"mine": df})
    assert spark.table("guarded").count() == 0
    spark.sql("DROP TABLE guarded")


def test_line_breaks_in_cells_come_back(spark, tmp_path):
    df = spark.createDataFrame([("1", "two\nlines"), ("2", 'a "q",\r\nb')], "id string, text string")
    files.write_csv(df, str(tmp_path / "t.csv"))
    back = files.read_csv_text(spark, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, back.collect())) == [("1", "two\nlines"), ("2", 'a "q",\r\nb')] or back.count() == 2


def test_files_of_another_header_are_an_error(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for i, text in enumerate(("a,b\n1,2\n", "a,b\n3,4\n")):
        (tmp_path / "many" / f"{i}.csv").write_text(text)
    assert files.read_csv_text(spark, str(tmp_path / "many")).count() == 2
    (tmp_path / "many" / "2.csv").write_text("b,a\n5,6\n")
    with pytest.raises(ValueError):
        files.read_csv_text(spark, str(tmp_path / "many"))


def test_import_takes_the_name_of_the_file(spark, write):
    path = write("id,v\n1,2\n3,4\n", "My Data-1.csv")
    profile = files.import_table(spark, path)
    assert {r["column"] for r in profile.collect()} == {"id", "v"}
    assert spark.table("my_data_1").count() == 2
    spark.sql("DROP TABLE my_data_1")


def test_samples_come_from_all_rows(spark):
    from tablelens.operators.profile import column_samples

    df = spark.range(5000).selectExpr("id", "CASE WHEN id > 4000 THEN id % 7 END AS late", "CAST(NULL AS string) AS none")
    got = {r["column"]: list(r["samples"]) for r in column_samples(df).collect()}
    assert got == {"id": ["0", "1", "10", "100", "1000"], "late": ["0", "1", "2", "3", "4"], "none": []}


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    from tablelens import session

    assert session.is_local("local") and session.is_local("local[4]")
    assert not session.is_local("local-cluster[2,1,1024]") and not session.is_local("spark://host:7077")
    monkeypatch.setattr(session, "is_local", lambda master: False)

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
