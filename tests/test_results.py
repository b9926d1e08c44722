from __future__ import annotations

import glob
import json
from datetime import datetime
from decimal import Decimal

import pytest

from ledgertally.sinks import results
from ledgertally.sources.results import read_pairs, read_rendered, read_result_csv


def written(path):
    (name,) = glob.glob(f"{path}/part-*")
    with open(name, encoding="utf-8") as file:
        return file.read()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "result")


def test_pairs(spark, folder):
    rows = [('0x"a', Decimal("31415926535897932384626433")), ("0xb", Decimal(5))]
    results.write_json_array(spark.createDataFrame(rows, "a string, v decimal(38,0)"), folder, single=True)
    text = written(folder)
    assert text == '[\n ["0x\\"a", 31415926535897932384626433]\n,["0xb", 5]\n]\n'
    assert json.loads(text) == [['0x"a', 31415926535897932384626433], ["0xb", 5]]
    back = read_pairs(spark, folder, ["a", "v"])
    assert [(row.a, Decimal(row.v)) for row in back.collect()] == rows


def test_nested_pairs(spark, folder):
    frame = spark.createDataFrame([("777", "Scamming", 2.345678901234567e22)], "id string, category string, v double")
    results.write_json_array(frame, folder, single=True)
    assert written(folder) == '[\n [["777", "Scamming"], 2.345678901234567e+22]\n]\n'
    back = read_pairs(spark, folder, ["id", "category", "v"]).collect()
    assert [(row.id, row.category, float(row.v)) for row in back] == [("777", "Scamming", 2.345678901234567e22)]


def test_values_as_text(spark, folder):
    frame = spark.createDataFrame([("01/2016", 12345678901.23456)], "month string, v double")
    results.write_json_array(frame, folder, value_as_text=True, single=True)
    assert written(folder) == '[\n ["01/2016", "12345678901.23456"]\n]\n'
    assert read_pairs(spark, folder, ["month", "v"]).collect() == [("01/2016", "12345678901.23456")]


def test_rendered(spark, folder, tmp_path):
    frame = spark.createDataFrame([("09/2018", 4.321987654321987e18), ("06/2017", 5.5)], "month string, v double")
    results.write_rendered_array(frame, folder, single=True)
    assert written(folder) == '[\n "09/2018,4.321987654321987e+18"\n,"06/2017,5.5"\n]\n'
    expected = [("09/2018", "4.321987654321987e+18"), ("06/2017", "5.5")]
    assert read_rendered(spark, folder, ["Date", "Value"]).collect() == expected
    results.report_csv(spark, folder, str(tmp_path / "csv"), ["Date", "Value"], "rendered")
    assert written(tmp_path / "csv") == "Date,Value\n09/2018,4.321987654321987e+18\n06/2017,5.5\n"


def test_report_csv_flattens(spark, folder, tmp_path):
    frame = spark.createDataFrame([("07-2017", "Phishing", 1.5)], "m string, c string, v double")
    results.write_json_array(frame, folder, single=True)
    results.report_csv(spark, folder, str(tmp_path / "csv"), ["Date", "Type", "Amount"])
    assert written(tmp_path / "csv") == "Date,Type,Amount\n07-2017,Phishing,1.5\n"


def test_order_is_kept(spark, folder):
    frame = spark.range(5000).selectExpr("string(id) as k", "id as v").repartition(7).orderBy("v")
    results.write_json_array(frame, folder, single=True)
    assert [pair[1] for pair in json.loads(written(folder))] == list(range(5000))


def test_single_csv(spark, folder):
    frame = spark.range(300).selectExpr("id as a", "id * 2 as b").repartition(6).orderBy("a")
    results.write_csv(frame, folder, single=True)
    lines = written(folder).splitlines()
    assert lines[0] == "a,b" and lines[1:] == [f"{i},{2 * i}" for i in range(300)]


def test_csv_of_any_size_and_new_titles(spark, folder):
    results.write_csv(spark.range(100).selectExpr("id as a", "id * 2 as b").repartition(4), folder)
    assert len(glob.glob(f"{folder}/part-*")) == 4
    back = read_result_csv(spark, folder, ["x", "y"])
    assert back.count() == 100 and back.columns == ["x", "y"]
    titled = results.reheader(back, ["why"], ["y"])
    assert titled.columns == ["why"] and titled.agg({"why": "sum"}).first()[0] == 9900


def test_a_file_without_header_keeps_its_first_row(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("09/2018,1\n06/2017,2\n")
    back = read_result_csv(spark, str(tmp_path / "plain.csv"), ["Date", "Value"], header=False)
    assert back.collect() == [("09/2018", 1), ("06/2017", 2)]


def test_many_pairs_keep_their_order_in_files_that_are_arrays(spark, folder):
    frame = spark.range(300_000).selectExpr("string(id) as k", "id as v").orderBy("v")
    results.write_json_array(frame, folder)
    files = sorted(glob.glob(f"{folder}/part-*"))
    pairs = [pair for name in files for pair in json.load(open(name))]
    assert len(files) > 1 and [pair[1] for pair in pairs] == list(range(300_000)) and pairs[7] == ["7", 7]
    back = read_pairs(spark, folder, ["k", "v"])
    assert back.selectExpr("count(*)", "sum(v)", "count_if(k = v)").first() == (300_000, sum(range(300_000)), 300_000)


def test_arrays_on_one_line_are_read_too(spark, tmp_path):
    (tmp_path / "pairs.json").write_text('[["a", 1], ["b", 2]]\n')
    (tmp_path / "texts.json").write_text('["a,1", "b,2"]')
    assert read_pairs(spark, str(tmp_path / "pairs.json"), ["k", "v"]).collect() == [("a", "1"), ("b", "2")]
    assert read_rendered(spark, str(tmp_path / "texts.json"), ["k", "v"]).collect() == [("a", "1"), ("b", "2")]


def test_empty_result(spark, folder):
    results.write_json_array(spark.range(0).selectExpr("string(id) as k", "id as v"), folder, single=True)
    assert json.loads(written(folder)) == [] and read_pairs(spark, folder, ["k", "v"]).collect() == []


def test_run_folder():
    assert results.run_folder("out/", "top-miners", datetime(2023, 4, 5, 16, 7, 8)) == (
        "out/top-miners_05-04-2023_16_07_08"
    )


def test_preview(spark, capsys):
    results.preview(spark.range(20), 3)
    assert capsys.readouterr().out.count("|") == 2 * 4


@pytest.mark.parametrize("single", [True, False])
@pytest.mark.parametrize("count, parts", [(0, 3), (1, 1), (1, 4), (1000, 30)])
def test_every_file_is_one_array(spark, folder, single, count, parts):
    frame = spark.range(0, count, 1, parts).selectExpr("concat('k', id) as k", "id as v")
    results.write_json_array(frame, folder, single=single)
    files = glob.glob(f"{folder}/part-*")
    arrays = [json.load(open(name, encoding="utf-8")) for name in files]
    assert len(files) == 1 if single else len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(pair[1] for array in arrays for pair in array) == list(range(count))
    assert all([pair[1] for pair in array] == sorted(pair[1] for pair in array) for array in arrays) or not single
    assert read_pairs(spark, folder, ["k", "v"]).count() == count


def test_arrays_need_no_python_worker(spark, folder, monkeypatch):
    plans = []
    write = type(spark.range(0).write).text
    monkeypatch.setattr(type(spark.range(0).write), "text", lambda self, path, *a, **b: (plans.append(self._df._jdf.queryExecution().toString()), write(self, path, *a, **b))[1])
    results.write_json_array(spark.range(5).selectExpr("id as k", "id as v"), folder)
    assert len(plans) == 1 and "Python" not in plans[0] and "Arrow" not in plans[0]


def test_whole_numbers_in_texts_are_numbers_in_json(spark, folder):
    from ledgertally.functions.numbers import number
    from ledgertally.operators.ranking import sum_by, top_k

    rows = [("a", "9" * 50), ("a", "1"), ("b", "-5"), ("c", "7")]
    frame = spark.createDataFrame(rows, "k string, t string").selectExpr("k", "t")
    sums = sum_by(frame.select("k", number(frame.t).alias("v")), ["k"], "v", whole=True)
    results.write_json_array(top_k(sums, "total", ["k"], 10), folder, single=True)
    assert json.loads(written(folder)) == [["a", 10**50], ["c", 7], ["b", -5]]
