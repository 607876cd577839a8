import datetime as dt

import pytest
from pyspark.sql import functions as F

from plantloom.sources import readers, sinks
from plantloom.sources.typing import parse_dates


def test_tolerant_csv(spark, tmp_path):
    p = tmp_path / "plant.csv"
    p.write_text(
        "Date;% Silica Concentrate;Flow (m3/h);Name\n"
        "02/01/2023 00:00:00;1,5;10;a\n"
        "01/01/2023 00:00:00; 2,25 ;x;b\n"
        "03/01/2023 00:00:00;3;4;5;6;7\n"
        "04/01/2023 00:00:00;4,0\n"
    )
    assert readers.detect_separator(spark, str(p)) == ";"
    df = readers.read_sensor_csv(spark, str(p))
    assert df.columns == ["date", "_silica_concentrate", "flow_m3_h", "name", "seq"]
    rows = df.orderBy("date").collect()
    assert [r["date"].day for r in rows] == [1, 2, 4]
    assert [r["_silica_concentrate"] for r in rows] == [2.25, 1.5, 4.0]
    assert [r["flow_m3_h"] for r in rows] == [None, 10.0, None]
    assert readers.read_sensor_csv(spark, str(p), max_rows=1).count() == 1


def test_latin_encoding(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_bytes("date,presión\n2023-01-01 00:00:00,3\n".encode("latin-1"))
    assert "presión" in readers.read_sensor_csv(spark, str(p), encoding="ISO-8859-1").columns


def test_whitespace(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1 1  0.5 \n1 2 0.25\n\n2   1 x\n")
    df = readers.read_whitespace(spark, str(tmp_path / "t.txt"), ["u", "c", "s"], ["u", "c"])
    assert [tuple(r) for r in df.orderBy("u", "c").collect()] == [
        (1, 1, 0.5), (1, 2, 0.25), (2, 1, None)]


def test_dates_fall_back_per_value(spark):
    df = spark.createDataFrame(
        [("2023-05-01 10:00:00",), ("02/05/2023 10:00:00",), ("bad",)], "date string")
    got = [r["date"] for r in parse_dates(df).collect()]
    assert got == [dt.datetime(2023, 5, 1, 10), dt.datetime(2023, 5, 2, 10), None]


def test_config_load(spark, tmp_path):
    (tmp_path / "d.csv").write_text(
        "date,in.a,in.b,out.y,other\n2023-01-02 00:00:00,,2,5,9\n2023-01-01 00:00:00,1,1,4,9\n"
        "2023-01-03 00:00:00,3,,6,9\n"
    )
    config = readers.DatasetConfig.from_mapping({
        "files": {"filename": "d.csv", "timestamp_column": "date"},
        "modeling": {"target_column": "out.y"},
        "feature_engineering": {"include_patterns": ["in."], "exclude_patterns": [], "forced_drop": []},
    })
    rows = readers.load_dataset(spark, str(tmp_path), config).orderBy("date").collect()
    assert [(r["in.a"], r["in.b"], r["out.y"]) for r in rows] == [(1, 1, 4), (1, 2, 5), (3, 2, 6)]


@pytest.mark.parametrize("name", ["../neighbour/table.csv", "/var/log/plant.csv", "a/../../x"])
def test_path_escape(tmp_path, name):
    with pytest.raises(ValueError):
        readers.resolve_inside(str(tmp_path), name)
    with pytest.raises(ValueError):
        readers.resolve_inside("s3a://bucket/data", name)


def test_cache_and_append(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    path = str(tmp_path / "cache")
    for _ in range(2):
        assert readers.cached_table(spark, path, build).count() == 5
    assert len(calls) == 1
    out = str(tmp_path / "csv")
    sinks.append_table(spark.range(3), out, "csv", first=True)
    sinks.append_table(spark.range(2), out, "csv")
    assert spark.read.csv(out, header=True).agg(F.count("id")).first()[0] == 5


def test_several_files_keep_their_order_and_quoted_fields(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.csv").write_text('note,v,w\n"p,q,r,s",5,1\nplain,6\n')
    (folder / "b.csv").write_text("note,v,w\n" + "".join(f"n{i},{i},0\n" for i in range(57))
                                  + "too,many,fields,here\n")
    df = readers.read_sensor_csv(spark, str(folder), sep=",")
    rows = df.orderBy("seq").collect()
    assert [r.v for r in rows] == [5.0, 6.0, *map(float, range(57))]
    assert rows[1].w is None
    first = readers.read_sensor_csv(spark, str(folder), sep=",", max_rows=2).collect()
    assert sorted(r.v for r in first) == [5.0, 6.0]


def test_separator_of_a_long_file(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("a,b\n" * 1200 + "x;y;z\n" * 5000)
    assert readers.detect_separator(spark, str(path)) == ";"
    assert readers.detect_separator(spark, str(path), lines=1000) == ","


def test_raw_load_is_read_from_a_file_of_each_task(spark, tmp_path):
    from plantloom.plans import catalog

    spark.range(90).selectExpr(
        "id AS o_orderkey", "id * 3 AS o_custkey", "'O' AS o_orderstatus", "'1-URGENT' AS o_orderpriority"
    ).repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    got = catalog.queries()["raw_load"](spark, str(tmp_path))
    assert got.count() == 90 and len(got.inputFiles()) >= 3
    assert {tuple(r) for r in got.where("o_orderkey < 2").collect()} == {
        ("0", "O;1-URGENT", None), ("1", "O;1-URGENT", "3")}
