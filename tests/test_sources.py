"""Reading and writing tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F, types as T

from cohort_engine.sources import tables as S
from conftest import rows

CSV = 'id,note,day\n1,"a, ""quoted""\nline",2022-01-05\n2,plain,2022-02-01\n3,,\n'


def test_strict_csv_keeps_quoted_newlines(spark, tmp_path):
    (tmp_path / "t.csv").write_text(CSV)
    df = S.read_csv_strict(spark, str(tmp_path / "t.csv"), multiline=True)
    assert rows(df) == [("1", 'a, "quoted"\nline', "2022-01-05"), ("2", "plain", "2022-02-01"), ("3", None, None)]
    typed = S.read_csv_strict(spark, str(tmp_path / "t.csv"), T.StructType.fromDDL("id int, note string, day date"), multiline=True)
    assert typed.schema["day"].dataType == T.DateType() and typed.agg(F.sum("id")).first()[0] == 6


@pytest.mark.parametrize("bad", ["x,plain,2022-01-05", "1,plain,someday", "1,plain", "1,plain,2022-01-05,more"])
def test_unreadable_cells_and_ragged_rows_fail(spark, tmp_path, bad):
    (tmp_path / "t.csv").write_text("id,note,day\n1,plain,2022-01-05\n" + bad + "\n")
    schema = T.StructType.fromDDL("id int, note string, day date")
    with pytest.raises(Exception, match="MALFORMED"):
        S.read_csv_strict(spark, str(tmp_path / "t.csv"), schema).collect()


def wild_csv(n, seed=3):
    """Records with commas, quotes and newlines in quoted cells, some over many lines; blank lines between."""
    rnd = random.Random(seed)
    out, want = ["id,note,other\n"], []
    for i in range(n):
        note = "".join(rnd.choice(['a', ',', '"', "\n", "b c", "\n\n"]) for _ in range(rnd.choice([0, 3, 3, 40])))
        quoted = '"' + note.replace('"', '""') + '"' if note else ""
        out.append(f"{i},{quoted},x{i}\n" + "\n" * (i % 50 == 7))
        want.append((str(i), note or None, f"x{i}"))
    return "".join(out), sorted(want)


def test_quoted_newlines_are_read_in_many_tasks(spark, tmp_path):
    text, want = wild_csv(3_000)
    (tmp_path / "t.csv").write_text(text)
    path = str(tmp_path / "t.csv")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = S.read_csv_strict(spark, path, multiline=True)
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        got = sorted((tuple(r) for r in df.collect()), key=lambda r: int(r[0]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(want, key=lambda r: int(r[0]))
    plain = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    assert rows(df) == rows(plain)


@pytest.mark.parametrize("bad", ['1,"open\nnever closed', "1,a,2022-01-05,more", "x,a,2022-01-05"])
def test_malformed_records_fail(spark, tmp_path, bad):
    (tmp_path / "t.csv").write_text('id,note,day\n1,"a\nb",2022-01-05\n' + bad + "\n")
    schema = T.StructType.fromDDL("id int, note string, day date")
    with pytest.raises(Exception, match="MALFORMED"):
        S.read_csv_strict(spark, str(tmp_path / "t.csv"), schema, multiline=True).collect()
    (tmp_path / "u.csv").write_text('id,day,note\n1,2022-01-05,"a\nb"\n')
    with pytest.raises(Exception, match="MALFORMED header"):  # though each cell could be read
        S.read_csv_strict(spark, str(tmp_path / "u.csv"), T.StructType.fromDDL("id int, note string, day string"), multiline=True).collect()


def test_schema_sees_late_values(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a\n" + "1\n" * 60_000 + "late\n")
    assert S.infer_schema(spark, str(tmp_path / "t.csv"))["a"].dataType == T.StringType()


def test_schema_of_all_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c,d,e\n1,1.5,2022-01-05,12d,2022-01-05 10:00:00\n2,3,2022-01-06,4,2022-01-05 11:00:00\n,,,,\n")
    kinds = [f.dataType.simpleString() for f in S.infer_schema(spark, str(tmp_path / "t.csv"))]
    assert kinds == ["bigint", "double", "date", "string", "timestamp_ntz"]


def test_ingest_folder_and_list(spark, tmp_path):
    src, dst = tmp_path / "src", str(tmp_path / "dst")
    src.mkdir()
    for name in ("one", "two"):
        (src / f"{name}.csv").write_text(CSV)
    (src / "skip.txt").write_text("x")
    assert S.ingest_csv_dir(spark, str(src), dst, multiline=True) == ["one", "two"]
    assert S.ingest_csv_list(spark, str(src), ["two"], dst, {"two": T.StructType.fromDDL("id int, note string, day date")}, multiline=True) == ["two"]
    assert S.read_table(spark, f"{dst}/two").schema["id"].dataType == T.IntegerType()
    slim = S.read_table(spark, f"{dst}/one", ["id"])
    assert slim.columns == ["id"] and "ReadSchema: struct<id:string>" in slim._jdf.queryExecution().executedPlan().toString()


def test_folder_is_ingested_by_a_job_per_header(spark, tmp_path):
    src, dst = tmp_path / "src", str(tmp_path / "dst")
    src.mkdir()
    for i in range(7):
        (src / f"t{i}.csv").write_text("id,v\n" + "".join(f"{j},{i}\n" for j in range(i)))
    for i in range(3):
        (src / f"u{i}.csv").write_text(f"a\n{i}\n")
    for _ in range(2):  # the second run replaces the tables of the first
        spark.sparkContext.setJobGroup("ingest", "")
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ingest"))
        names = S.ingest_csv_files(spark, [str(p) for p in sorted(src.iterdir()) if p.name != "t0.csv"], dst)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ingest")) - before
        assert jobs <= 4  # per header one for the names of its columns and one for the rows
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert names == [f"t{i}" for i in range(1, 7)] + ["u0", "u1", "u2"]
    for i in range(1, 7):
        assert rows(S.read_table(spark, f"{dst}/t{i}")) == [(str(j), str(i)) for j in range(i)]
    assert rows(S.read_table(spark, f"{dst}/u2")) == [("2",)] and not list((tmp_path / "dst").glob("_ingest*"))
    S.ingest_csv_files(spark, [str(src / "t0.csv")], dst)
    assert S.read_table(spark, f"{dst}/t0").columns == ["id", "v"] and S.read_table(spark, f"{dst}/t0").count() == 0


def test_later_extract_touches_its_months_only(spark, tmp_path):
    events, counts = str(tmp_path / "events"), str(tmp_path / "counts")
    rnd = random.Random(4)
    old = [(rnd.randrange(30), rnd.randrange(1, 9)) for _ in range(500)]
    new = [(rnd.randrange(30), rnd.randrange(8, 11)) for _ in range(200)] + [(1, None)]

    def count(df):
        return df.groupBy("person", "month").agg(F.count(F.lit(1)).alias("n"))

    def add(data, name):
        S.add_extract(spark, spark.createDataFrame(data, "person int, month int"), name, events, counts, "month", count)

    add(old, "first")
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "counts").rglob("*.parquet")}
    for _ in range(2):  # adding it again changes nothing
        add(new, "second")
        whole = spark.createDataFrame([r for r in old + new if r[1] is not None], "person int, month int")
        assert rows(S.read_table(spark, counts).select("person", "month", "n")) == rows(count(whole))
    left = {p: p.stat().st_mtime_ns for p in (tmp_path / "counts").rglob("*.parquet")}
    kept = {p for p in files if not any(f"month={m}/" in str(p) for m in (8, 9, 10))}
    assert kept and all(left[p] == files[p] for p in kept) and {str(p) for p in left} & {str(p) for p in files} == {str(p) for p in kept}


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events = spark.range(5_000).selectExpr("id % 300 AS k", "cast(id % 12 as int) AS month", "id AS v")
        S.write_bucketed(events, "bucketed_events", str(tmp_path / "e"), "k", 6, "month")
        S.write_bucketed(spark.range(300).withColumnRenamed("id", "k").withColumn("p", F.col("k") % 7), "bucketed_people", str(tmp_path / "p"), "k", 6)
        df = spark.table("bucketed_events").filter("month BETWEEN 3 AND 4").join(spark.table("bucketed_people"), "k")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "PartitionFilters: [isnotnull(month" in plan
        assert rows(df.groupBy("p").agg(F.sum("v").alias("v"))) == rows(
            events.filter("month BETWEEN 3 AND 4").groupBy((F.col("k") % 7).alias("p")).agg(F.sum("v").alias("v")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bucketed_events")
        spark.sql("DROP TABLE IF EXISTS bucketed_people")


def test_overwrite_and_result_files(spark, tmp_path):
    path = str(tmp_path / "r")
    for n in (3, 2):
        df = spark.range(n).withColumns({"outcome": F.lit("y"), "spec": F.concat(F.lit("s"), F.col("id"))})
        S.write_results(df, path)
    assert S.read_table(spark, path).count() == 2
    assert sorted(p.name for p in (tmp_path / "r" / "outcome=y").iterdir()) == ["spec=s0", "spec=s1"]


def test_leading_rows_and_skeleton(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (2,)], "n int")
    assert rows(S.drop_leading_rows(df, 2, ["n"])) == [(None,), (3,)]
    assert S.period_skeleton(spark, "2022q1", "2025q3").count() == 15
    assert rows(S.period_skeleton(spark, 5, 7, "p")) == [(5,), (6,), (7,)]
