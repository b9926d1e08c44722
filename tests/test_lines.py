from __future__ import annotations

from pyspark.sql import functions as F

from ledgertally.sources.layouts import BLOCKS, CONTRACTS, TRANSACTIONS, Layout
from ledgertally.sources.lines import (
    read_fields,
    read_lines,
    read_staged,
    split_fields,
    stage_fields,
    well_formed,
    without_header,
)
from ledgertally.sources.scratch import scratch_folder

THREE = Layout(arity=3, columns={"first": 0, "last": 2})


def frame(spark, lines):
    return spark.createDataFrame([(line,) for line in lines], "value string")


def test_arity(spark):
    lines = ["a,b,c", "a,b", "a,b,c,d", "", "a,,", ",,", 'a,"b,c"', "a,b,c,"]
    rows = split_fields(frame(spark, lines), THREE).collect()
    assert sorted(tuple(row) for row in rows) == [("", ""), ("a", ""), ("a", "c"), ("a", 'c"')]


def test_quotes_have_no_meaning(spark):
    assert split_fields(frame(spark, ['1,"a,b"']), THREE).collect() == [("1", 'b"')]
    assert split_fields(frame(spark, ['1,"a,b",2']), THREE).count() == 0


def test_header_fails_the_number_check(spark):
    fields = split_fields(frame(spark, ["first,middle,last", "1,x,2", "3,x,"]), THREE)
    assert well_formed(fields, ints=["last"]).collect() == [("1", "2")]
    assert well_formed(fields, floats=["first"]).count() == 2


def test_header_by_title(spark):
    lines = ["first,middle,last", "1,x,2", ",,"]
    assert without_header(split_fields(frame(spark, lines), THREE), "last", "last").count() == 2


def test_read_from_files_and_stage(spark, tmp_path):
    header = ",".join(f"c{i}" for i in range(15))
    body = ",".join(["h", "1", "b", "100", "0", "from", "", "5", "21000", "9", "0x", "1548979200", "", "", ""])
    (tmp_path / "tx.csv").write_text(f"{header}\r\n{body}\n\n{body},x\n")
    path = str(tmp_path / "tx.csv")
    assert read_lines(spark, path).count() == 4
    fields = read_fields(spark, path, TRANSACTIONS)
    assert fields.columns == list(TRANSACTIONS.columns)
    valid = well_formed(fields, ints=["block_timestamp"])
    assert valid.collect() == [("100", "from", "", "5", "21000", "9", "1548979200")]
    stage_fields(fields, str(tmp_path / "staged"))
    staged = read_staged(spark, str(tmp_path / "staged"), TRANSACTIONS)
    assert sorted(staged.collect()) == sorted(fields.collect())
    plan = staged.select("gas")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<gas:string>" in plan


def test_other_layouts(spark):
    contract = split_fields(frame(spark, ["0xa,1,2,3,4,5", "address,b,c,d,e,f", "0xb,1"]), CONTRACTS)
    assert [row[0] for row in contract.collect()] == ["0xa", "address"]
    fields = [""] * 19
    fields[1], fields[9], fields[12] = "0xh", "0xm", "77"
    block = split_fields(frame(spark, [",".join(fields)]), BLOCKS)
    assert block.collect() == [("0xh", "0xm", "77")]


def test_scratch_folders_are_shared_and_new(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_folder(spark, "x"), scratch_folder(spark, "x")
    assert first != second and first.startswith(f"{shared}/x-")


def test_the_split_is_planned_once(spark):
    fields = well_formed(split_fields(frame(spark, ["a"]), TRANSACTIONS), ints=["gas"], floats=["value"])
    plan = fields.where(F.col("gas") != "7")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
