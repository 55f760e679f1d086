"""Packs as a batch source, deliveries as a streaming source with offsets."""

import json

import pytest

from spanwarden.operators import rules
from spanwarden.plans import commands
from spanwarden.sources import connectors


def test_packs_are_rows(spark, tmp_path):
    connectors.register(spark)
    rows = spark.read.format("rulepacks").load(str(commands.PACKS)).collect()
    packs = rules.load_pack_directory(commands.PACKS)
    assert sorted(r["rule_id"] for r in rows) == sorted(p.full_id(r) for p in packs for r in p.rules)
    weak = next(r for r in rows if r["rule_id"].endswith("known-weak"))
    assert weak["type"] == "dependency" and ("flask", "python", "1.0") in [tuple(c)[:3] for c in weak["checks"]]
    (tmp_path / "bad.yml").write_text("manifest: 1")
    (tmp_path / "_pack.yml").write_text("x")
    (tmp_path / "good.yml").write_text("manifest: {id: g/p, version: 1, name: n}\nrules: []\n")
    with pytest.raises(Exception, match="manifest"):
        spark.read.format("rulepacks").load(str(tmp_path)).collect()
    assert spark.read.format("rulepacks").option("mode", "permissive").load(str(tmp_path)).count() == 0
    assert spark.read.format("rulepacks").load(str(tmp_path / "none")).count() == 0


def test_deliveries_resume_from_their_offset(spark, tmp_path):
    connectors.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()

    def drop(*names):
        for n in names:
            (folder / f"{n}.json").write_text(json.dumps({"n": n}))

    def run():
        raw = spark.readStream.format("deliveries").option("path", str(folder)).option("files_a_batch", "2").load()
        q = raw.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start(str(tmp_path / "out"))
        q.processAllAvailable()
        q.stop()
        return sorted(r["name"] for r in spark.read.schema(connectors.DELIVERIES).parquet(str(tmp_path / "out")).collect())

    drop("001", "002", "003")
    (folder / "004.part").write_text("half")
    assert run() == ["001.json", "002.json", "003.json"]
    drop("005")
    assert run() == ["001.json", "002.json", "003.json", "005.json"]
    assert run() == ["001.json", "002.json", "003.json", "005.json"]
