"""Every question as a job, from small hand-written dumps to the published form of the result."""

from __future__ import annotations

import csv
import glob
import json

import pytest

from ledgertally.jobs import JOBS, convert_result, main, read_input, run_job
from ledgertally.plans import questions
from ledgertally.sources.layouts import BLOCKS_SCHEMA, DROPPABLE_BLOCK_COLUMNS

JANUARY, FEBRUARY = "1548979199", "1548979200"


def transaction(source="0xa", target="0xc1", value="1", gas="100", price="10", time=JANUARY, number="1"):
    fields = ["0xh", "0", "0xb", number, "0", source, target, value, gas, price, "0x", time, "", "", ""]
    return ",".join(fields)


TRANSACTIONS = [
    "hash,nonce,block_hash,block_number,transaction_index,from_address,to_address,value,gas,gas_price,input,"
    "block_timestamp,max_fee_per_gas,max_priority_fee_per_gas,transaction_type",
    transaction(value="30000000000000000000", gas="100", price="10"),
    transaction(value="1", gas="300", price="20", time=FEBRUARY),
    transaction(target="0xc2", value="50000000000000000001", gas="500", price="30"),
    transaction(target="0xs1", value="7", source="0xs1", time=FEBRUARY),
    transaction(target="0xs1", value="2.5", source="0xb"),
    transaction(target="", source="", value="1000"),
    transaction(target="0xc1", value="n/a", gas="n/a"),
    transaction(target="0xc1", value="4", time="n/a"),
    transaction(target="0xs2", value="1e3", time=FEBRUARY + ".9"),
    transaction(target="0xc2", value="1e3", number="1.5"),
    transaction() + ",one more",
    "0xh,short",
    "",
]
CONTRACTS = [
    "address,bytecode,function_sighashes,is_erc20,is_erc721,block_number",
    "0xc1,0x,,f,f,1",
    "0xc2,0x,,f,f,1",
    "0xc2,0x,,f,f,2",
    "0xs1,short",
]
SCAMS = [
    "id,name,url,coin,category,subcategory,address,status",
    "1,A,u,ETH,Phishing,,0xs1,Active",
    "2,B,u,ETH,Scamming,,0xs1,Offline",
    "2,B,u,ETH,Scamming,,0xc1,Offline",
    "x,C,u,ETH,Scamming,,0xs1,Offline",
    '3,"D, E",u,ETH,Scamming,,0xs1,Offline',
]
REGISTRY = {
    "result": {
        "a": {"id": 1, "addresses": ["0xs1", "0xs2"], "status": "Active", "category": "Phishing", "url": "u"},
        "b": {"id": 2, "addresses": ["0xs1"], "status": "Offline", "category": "Scamming"},
        "c": {"id": 3, "addresses": [], "status": "Offline", "category": "Fake ICO"},
    }
}


def block(number, miner, size, digest="0x" + "a" * 64, bloom="0x" + "b" * 512):
    values = {name: digest for name in BLOCKS_SCHEMA.names}
    values.update(number=number, miner=miner, size=size, logs_bloom=bloom, difficulty="17171480576")
    values.update(total_difficulty="9" * 22, gas_limit="5000", gas_used="0", timestamp="1438269988")
    values.update(transaction_count="0", base_fee_per_gas="", nonce="0x539bd4979fef1ec4", extra_data="0x")
    return ",".join(str(values[name]) for name in BLOCKS_SCHEMA.names)


BLOCKS = [",".join(BLOCKS_SCHEMA.names), block(1, "0xm1", 500), block(2, "0xm2", 300), block(3, "0xm2", 400),
          block(4, "0xm3", "bad")[:-1] + ",", "1,2,3"]


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    folder = tmp_path_factory.mktemp("dumps")
    texts = {
        "transactions": "\n".join(TRANSACTIONS),
        "contracts": "\n".join(CONTRACTS),
        "scams": "\n".join(SCAMS),
        "registry": json.dumps(REGISTRY),
        "blocks": "\n".join(BLOCKS),
        "block_table": "\n".join(line for line in BLOCKS[:4]),
    }
    for name, text in texts.items():
        (folder / name).write_text(text + "\n")
    return {name: str(folder / name) for name in texts}


def result_text(folder):
    (name,) = glob.glob(f"{folder}/part-*")
    with open(name, encoding="utf-8") as file:
        return file.read()


EXPECTED = {
    # Eight rows have an integer time, those with a bad or fractional value among them.
    "monthly-transactions": [["01/2019", 6], ["02/2019", 2]],
    "top-contracts": [["0xc2", 50000000000000000001], ["0xc2", 50000000000000000001], ["0xc1", 30000000000000000005]],
    "top-miners": [["0xm2", 700], ["0xm1", 500], ["0", 1]],
    "monthly-gas-price": [["01/2019", str((10 + 30 + 10 + 10 + 10 + 10) / 6)], ["02/2019", "15.0"]],
    # 0xc1 once: 100 and 300; 0xc2 twice: 500 and 100.
    "monthly-contract-gas": [["01/2019", str((100 + 2 * 500 + 2 * 100) / 5)], ["02/2019", "300.0"]],
    "top-scams": [[["2", "Scamming"], 30000000000000000001 + 9.5], [["1", "Phishing"], 9.5]],
    "monthly-scam-value": [
        [["01-2019", "Phishing"], 2.5],
        [["01-2019", "Scamming"], 2.5],
        [["02-2019", "Phishing"], 1007.0],
        [["02-2019", "Scamming"], 7.0],
    ],
    "top-self-transfers": [[["", ""], 1000.0], [["0xs1", "0xs1"], 7.0]],
}


@pytest.mark.parametrize("name", EXPECTED)
def test_json_results(spark, paths, tmp_path, name):
    folder = run_job(spark, name, paths, str(tmp_path))
    found = json.loads(result_text(folder))
    if name == "monthly-scam-value":
        found = sorted(found)
    assert found == EXPECTED[name]


def test_monthly_value(spark, paths, tmp_path):
    found = json.loads(result_text(run_job(spark, "monthly-value", paths, str(tmp_path))))
    # Exact parts first: 3e19 + (5e19 + 1) + 1000, then 2.5 and 1e3, over five rows.
    january = (float(30000000000000000000 + 50000000000000000001 + 1000) + 1002.5) / 5
    assert found == [f"01/2019,{january!r}", "02/2019,4.0"]


@pytest.mark.parametrize("infer", [False, True])
def test_block_columns(spark, paths, tmp_path, infer):
    folder = run_job(spark, "droppable-block-bytes", paths, str(tmp_path / "a"), infer=infer)
    rows = list(csv.DictReader(result_text(folder).splitlines()))
    assert [row["column_name"] for row in rows] == DROPPABLE_BLOCK_COLUMNS
    assert [float(row["size_bytes"]) for row in rows] == [768.0, 96.0, 96.0, 96.0, 96.0]
    folder = run_job(spark, "block-column-shares", paths, str(tmp_path / "b"), infer=infer)
    rows = {row["column_name"]: row for row in csv.DictReader(result_text(folder).splitlines())}
    assert list(rows) == BLOCKS_SCHEMA.names
    assert float(rows["transaction_count"]["space_saved"]) == -1.5
    assert float(rows["total_difficulty"]["space_saved"]) == 30.0
    assert float(rows["base_fee_per_gas"]["space_saved"]) == 0.0
    assert abs(sum(float(row["percentage_saved"]) for row in rows.values()) - 100) < 1e-9


def test_staged_dumps_give_the_same(spark, paths, tmp_path):
    main(["stage", "--transactions", paths["transactions"], "--contracts", paths["contracts"], "--scams",
          paths["scams"], "--blocks", paths["blocks"], "--out", str(tmp_path / "staged")])
    staged = {name: str(tmp_path / "staged" / name) for name in ["transactions", "contracts", "scams", "blocks"]}
    for name in ["top-contracts", "top-miners", "monthly-contract-gas", "top-scams"]:
        folder = run_job(spark, name, staged, str(tmp_path / "out"), staged=True)
        assert json.loads(result_text(folder)) == EXPECTED[name]


def test_command_line(spark, paths, tmp_path, capsys):
    main(["top-miners", "--blocks", paths["blocks"], "--out", str(tmp_path), "--preview", "5"])
    folder = capsys.readouterr().out.splitlines()[0]
    assert json.loads(result_text(folder)) == EXPECTED["top-miners"]
    main(["top-miners", "--blocks", paths["blocks"], "--out", str(tmp_path / "again"), "--preview", "2"])
    shown = [line for line in capsys.readouterr().out.splitlines() if line.startswith("|")]
    assert [cell.strip() for cell in shown[0].strip("|").split("|")] == ["Miner", "Size"] and len(shown) == 3
    main(["convert", "--result", folder, "--of", "top-miners", "--out", str(tmp_path / "csv")])
    assert result_text(tmp_path / "csv") == "Miner,Size\n0xm2,700\n0xm1,500\n0,1\n"
    with pytest.raises(SystemExit):
        main(["top-contracts", "--transactions", paths["transactions"], "--out", str(tmp_path)])


def test_month_questions_keep_every_month(spark, tmp_path):
    times = [1439596800 + k * 2_629_800 for k in range(137)]
    (tmp_path / "t.csv").write_text("\n".join(transaction(time=str(t)) for t in times))
    (tmp_path / "c.csv").write_text("0xc1,0x,,f,f,1")
    given = {"transactions": str(tmp_path / "t.csv"), "contracts": str(tmp_path / "c.csv")}
    for name in ["monthly-transactions", "monthly-value", "monthly-gas-price", "monthly-contract-gas"]:
        assert len(json.loads(result_text(run_job(spark, name, given, str(tmp_path / "all"))))) == 137
        assert len(json.loads(result_text(run_job(spark, name, given, str(tmp_path / "few"), limit=12)))) == 12


def test_wrong_inputs_are_refused(spark, paths, tmp_path):
    main(["stage", "--contracts", paths["contracts"], "--out", str(tmp_path / "staged")])
    with pytest.raises(ValueError, match="holds"):
        read_input(spark, "transactions", str(tmp_path / "staged" / "contracts"), staged=True)
    for wrong in [[], ["--registry", paths["registry"]]]:
        with pytest.raises(SystemExit):
            main(["stage", *wrong, "--out", str(tmp_path / "none")])
    with pytest.raises(SystemExit):
        main(["top-miners", "--blocks", paths["blocks"], "--limit", "3", "--out", str(tmp_path)])


def test_block_tables_with_another_header_or_a_bad_cell_are_errors(spark, tmp_path):
    names, cells = BLOCKS_SCHEMA.names, ["1"] * len(BLOCKS_SCHEMA.names)
    swapped = list(names)
    a, b = names.index("hash"), names.index("miner")
    swapped[a], swapped[b] = swapped[b], swapped[a]
    bad = list(cells)
    bad[names.index("size")] = "12345x"
    for name, header, row in [("swapped", swapped, cells), ("bad", names, bad)]:
        (tmp_path / name).write_text(",".join(header) + "\n" + ",".join(row) + "\n")
        with pytest.raises(Exception):
            questions.block_column_shares(read_input(spark, "block_table", str(tmp_path / name))).collect()


def test_every_json_result_converts(spark, paths, tmp_path):
    for name in [*EXPECTED, "monthly-value"]:
        folder = run_job(spark, name, paths, str(tmp_path / "results"))
        convert_result(spark, name, folder, str(tmp_path / name))
        rows = list(csv.reader(result_text(tmp_path / name).splitlines()))
        assert tuple(rows[0]) == JOBS[name].titles
        assert len(rows) == 1 + len(json.loads(result_text(folder)))


def test_any_size_form(spark, paths, tmp_path):
    folder = run_job(spark, "monthly-scam-value", paths, str(tmp_path), form="lines")
    lines = [json.loads(line) for name in glob.glob(f"{folder}/part-*") for line in open(name)]
    assert sorted((r["month"], r["category"], r["total"]) for r in lines)[0] == ("01-2019", "Phishing", 2.5)


def test_broken_registry_is_an_error(spark, tmp_path):
    (tmp_path / "broken").write_text('{"result": {"a": ')
    with pytest.raises(Exception):
        read_input(spark, "registry", str(tmp_path / "broken")).collect()


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_partitions_do_not_matter(spark, paths, partitions):
    frames = {name: read_input(spark, name, paths[name]).repartition(partitions) for name in
              ["transactions", "contracts", "scams", "registry", "blocks"]}
    scams = questions.top_scams(frames["transactions"], frames["scams"]).collect()
    assert [[[r.id, r.category], r.total] for r in scams] == EXPECTED["top-scams"]
    gas = questions.monthly_contract_gas(frames["transactions"], frames["contracts"]).collect()
    assert [[r.month, str(r.average)] for r in gas] == EXPECTED["monthly-contract-gas"]
    miners = questions.top_miners(frames["blocks"]).collect()
    assert [[r.miner, int(r.size)] for r in miners] == EXPECTED["top-miners"]


def test_without_ansi_mode(spark, paths):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        frames = [read_input(spark, name, paths[name]) for name in ["transactions", "contracts"]]
        contracts = questions.top_contracts(*frames).collect()
        assert [[r.address, int(r.value)] for r in contracts] == EXPECTED["top-contracts"]
        assert [[r.month, str(r.average)] for r in questions.monthly_contract_gas(*frames).collect()] == (
            EXPECTED["monthly-contract-gas"]
        )
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
