"""Quoted line breaks read by several tasks a file; surplus fields."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from regiopanel.sources.delimited import load_locale_csv, read_delimited
from regiopanel.sources.quoted import read_records


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(folder, name, rows, ends="\n"):
    out = io.StringIO()
    w = csv.writer(out, delimiter=";", lineterminator=ends)
    w.writerow(["id", "text", "n"])
    w.writerows(rows)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", encoding="utf-8", newline="") as f:
        f.write(out.getvalue())


def odd_rows(seed, n=120):
    r = random.Random(seed)
    parts = ["a", " ", '"', ";", "\n", "\r\n", "é", "x" * 30, '""', "\n\n", "'", "\t"]
    rows = [(str(i), "t" + "".join(r.choice(parts) for _ in range(r.randrange(0, 12))), str(i * 2)) for i in range(n)]
    rows[7] = ("7", "long " + "line\n" * 500 + "end", "14")  # spans many splits
    return rows


@pytest.mark.parametrize("seed,ends", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_records_come_back_from_any_splits(spark, tmp_dir, small_splits, seed, ends):
    rows = odd_rows(seed)
    write(f"{tmp_dir}/in", "a.csv", rows, ends)
    write(f"{tmp_dir}/in", "b.csv", odd_rows(seed + 10, 40), ends)
    df = read_delimited(spark, f"{tmp_dir}/in", multi_line=True)
    assert df.columns == ["id", "text", "n"]
    assert sorted(map(tuple, df.collect())) == sorted(rows + odd_rows(seed + 10, 40))


def test_one_file_is_read_by_several_tasks(spark, tmp_dir, small_splits):
    write(f"{tmp_dir}/in", "a.csv", odd_rows(4))
    records = read_records(spark, f"{tmp_dir}/in")
    lines = spark.read.text(f"{tmp_dir}/in")
    assert lines.rdd.getNumPartitions() > 5
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "multiLine" not in plan and records.count() == 121
    assert records.where("first").count() == 1


def test_header_only_empty_and_no_header(spark, tmp_dir):
    write(f"{tmp_dir}/h", "a.csv", [])
    assert read_delimited(spark, f"{tmp_dir}/h", multi_line=True).count() == 0
    with open(f"{tmp_dir}/plain.csv", "w") as f:
        f.write('1;"a\nb"\n2;c')
    df = read_delimited(spark, f"{tmp_dir}/plain.csv", header=False, multi_line=True)
    assert sorted(map(tuple, df.collect())) == [("1", "a\nb"), ("2", "c")]


@pytest.mark.parametrize("multi_line", [False, True])
def test_surplus_fields(spark, tmp_dir, multi_line):
    path = f"{tmp_dir}/s.csv"
    with open(path, "w") as f:
        f.write("a;b\n1;2\n3;4;5;6\n7\n8;9;\n")
    with pytest.raises(Exception, match="more fields than the 2"):
        read_delimited(spark, path, multi_line=multi_line).collect()
    with pytest.raises(Exception, match="more fields"):
        read_delimited(spark, path, multi_line=multi_line).select("a").collect()
    kept = read_delimited(spark, path, multi_line=multi_line, surplus="more").orderBy("a")
    assert list(map(tuple, kept.collect())) == [("1", "2", None), ("3", "4", "5"), ("7", None, None), ("8", "9", None)]
    lost = read_delimited(spark, path, multi_line=multi_line, surplus=None).orderBy("a")
    assert list(map(tuple, lost.collect())) == [("1", "2"), ("3", "4"), ("7", None), ("8", "9")]
    with pytest.raises(Exception, match="more fields"):
        load_locale_csv(spark, path, multi_line=multi_line).collect()


def test_other_encodings_are_read_whole(spark, tmp_dir):
    path = f"{tmp_dir}/l.csv"
    with open(path, "w", encoding="latin-1") as f:
        f.write('a;b\n1;"ä\nö"\n')
    assert read_delimited(spark, path, encoding="iso-8859-1", multi_line=True).select(F.col("b")).first()[0] == "ä\nö"
