"""One registry document over many tasks against the standard library's JSON."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgertally.operators.registry import registry_addresses
from ledgertally.sources.registry_scan import read_registry_entries
from ledgertally.sources.tables import read_registry

NASTY = ['a}b', 'a{b', '"quoted"', 'back\\slash', '\\"}', '}', '{', '},"x":{"id":"9"', 'new\nline', 'é 日本', '', '\\', '"result":{', '[{}]']


def document(seed: int, count: int) -> dict:
    chosen = random.Random(seed)
    text = lambda: chosen.choice(NASTY) + chosen.choice(["", "x"])

    def entry():
        made = {"id": text(), "addresses": [text() for _ in range(chosen.randrange(4))], "status": text(), "category": text()}
        if chosen.random() < 0.3:
            made["coins"] = {"deep": {"deeper": [{"a": "}"}, {}]}, "t": text()}  # objects within an entry
        items = list(made.items())
        chosen.shuffle(items)
        return dict(items)

    result = {f"k{k}{text()}": entry() for k in range(count)}
    other = {"note": text(), "meta": {"x": {"id": "no", "addresses": ["no"]}, "result": {"addresses": ["no"]}}, "list": [{"result": {"k": {"addresses": ["no"]}}}]}
    items = [*other.items(), ("result", result)]
    chosen.shuffle(items)
    return dict(items)


def expected(documents):
    return sorted((e["id"], e["status"], e["category"], a) for d in documents for e in d["result"].values() for a in e["addresses"])


@pytest.mark.parametrize("indent", [None, 1, "\t"])
@pytest.mark.parametrize("seed, count, piece", [(1, 0, 64), (2, 1, 7), (3, 40, 100), (4, 300, 1000), (5, 60, 13)])
def test_any_document_in_any_splits(spark, tmp_path, indent, seed, count, piece):
    made = [document(seed, count), document(seed + 50, count // 2)]
    lines = [json.dumps(d, indent=indent, ensure_ascii=bool(seed % 2)) for d in made]
    (tmp_path / "a.json").write_text(lines[0] + ("\n" if seed % 2 else ""), encoding="utf-8")
    (tmp_path / "b.json").write_text("\n".join([lines[1], lines[0]]) + "\n", encoding="utf-8")
    before = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for name in before:
        spark.conf.set(name, str(max(piece, len(lines[0]) // 60)))
    try:
        entries = read_registry_entries(spark, str(tmp_path))
        found = sorted(tuple(row) for row in registry_addresses(entries).select("id", "status", "category", "address").collect())
        keys = sorted(row.entry_key for row in entries.collect())
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert found == expected([made[0], made[1], made[0]])
    assert keys == sorted(k for d in (made[0], made[1], made[0]) for k in d["result"])


def test_one_document_is_read_by_many_tasks_and_equals_the_plain_reader(spark, tmp_path):
    made = {"success": True, "result": {f"k{k}": {"id": str(k), "addresses": [f"0x{k}", f"0y{k}"], "status": "Active", "category": "}{"[k % 2]} for k in range(20_000)}}
    (tmp_path / "one.json").write_text(json.dumps(made))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        found = registry_addresses(read_registry_entries(spark, str(tmp_path)))
        plain = registry_addresses(read_registry(spark, str(tmp_path)))
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() >= 6
        columns = ["id", "status", "category", "address"]
        assert found.count() == 40_000 and found.select(columns).exceptAll(plain.select(columns)).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("text", ['{"result":{"k":{"id":"1","addresses":["a"]}', '{"result":{"k":{"id":"1","addresses":["a"]}}', '{"result":{"k":{"id":"1,"addresses":["a"]}}}', '{"result":{"k":{"id":"1","addresses":["a"}}}', '{"result":{"k":{"id":"1"}}}}'])
def test_broken_documents_stop_the_job(spark, tmp_path, text):
    (tmp_path / "broken.json").write_text(text)
    with pytest.raises(Exception):
        read_registry_entries(spark, str(tmp_path)).collect()


def test_empty_files(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "blank.json").write_text(" \n")
    (tmp_path / "none.json").write_text('{"result":{}}\n{"other":{"k":{"addresses":["a"]}}}')
    assert read_registry_entries(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 0
