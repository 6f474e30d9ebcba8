"""Fingerprints by files: what is read, and that they follow the contents."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from cohortlens.model import AlgorithmSpec, FeatureTable, MiningQuery
from cohortlens.plans import cached
from cohortlens.sources import manifest
from cohortlens.sources.cache import MAX_WEIGHT, table_fingerprint
from cohortlens.sources.tables import Catalog


@pytest.fixture
def reads(monkeypatch):
    """The files that each call of the manifest reads."""
    calls, real = [], manifest._measured
    monkeypatch.setattr(manifest, "_measured", lambda s, t, files, c: calls.append(list(files)) or real(s, t, files, c))
    return calls


def whole(spark, path, fmt="parquet"):
    return "-".join(map(str, table_fingerprint(spark.read.format(fmt).load(path)).first()))


@pytest.mark.parametrize("partitioned", [False, True])
def test_only_changed_files_are_read(spark, tmp_path, reads, partitioned):
    path, notes = str(tmp_path / "t"), str(tmp_path / "m")
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("part"), F.col("id").cast("string").alias("s"))
    writer = df.repartition(4).write
    (writer.partitionBy("part") if partitioned else writer).parquet(path)
    table = FeatureTable("t", path)
    first = manifest.table_mark(spark, table, notes)
    assert first == whole(spark, path) and first.startswith("1000-")
    n = len(reads[0])
    assert len(reads) == 1 and n == len(manifest.list_files(spark, path)) and n >= 4
    assert manifest.table_mark(spark, table, notes) == first and len(reads) == 1  # nothing read again
    more = df.limit(7).coalesce(1).write.mode("append")
    (more.partitionBy("part") if partitioned else more).parquet(path)
    second = manifest.table_mark(spark, table, notes)
    assert second == whole(spark, path) != first and len(reads[1]) < n
    one = next(f for f in manifest.list_files(spark, path) if f in reads[0])
    os.remove(one.removeprefix("file:"))
    assert manifest.table_mark(spark, table, notes) == whole(spark, path) and len(reads) == 2  # a lost file needs no reading


def test_a_file_rewritten_in_place_is_read(spark, tmp_path, reads):
    folder, notes = tmp_path / "t", str(tmp_path / "m")
    folder.mkdir()
    for i in range(3):
        (folder / f"f{i}.csv").write_text(f"{i},a\n")
    table = FeatureTable("t", str(folder), format="csv")
    before = manifest.table_mark(spark, table, notes)
    time.sleep(0.05)
    (folder / "f1.csv").write_text("7,a\n")
    after = manifest.table_mark(spark, table, notes)
    assert before != after == whole(spark, str(folder), "csv")
    assert [len(r) for r in reads] == [3, 1] and reads[1][0].endswith("f1.csv")


def test_one_file_empty_files_and_other_tables(spark, tmp_path, reads):
    notes, single = str(tmp_path / "m"), tmp_path / "one.csv"
    single.write_text("1,2\n3,4\n")
    assert manifest.table_mark(spark, FeatureTable("one", str(single), format="csv"), notes) == whole(spark, str(single), "csv")
    empty = str(tmp_path / "e")
    spark.range(5).filter("id < 0").write.parquet(empty)
    assert manifest.table_mark(spark, FeatureTable("e", empty), notes) == "0-0"
    made = FeatureTable("made", lambda s: s.range(4))
    assert manifest.table_mark(spark, made, notes).startswith("4-") and len(reads) == 2


def test_a_hit_reads_no_table_file_and_an_edit_misses(spark, tmp_path, reads):
    path = str(tmp_path / "t")
    spark.range(90).select("id", (F.col("id") % 5 * 1.0).alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g")).coalesce(2).write.parquet(path)
    catalog = Catalog([FeatureTable("t", path, "id")])
    asked = MiningQuery(variables=("x",), grouping=("g",), target_table="t", algorithm=AlgorithmSpec("groupConfidenceBands"))
    cache = str(tmp_path / "cache")
    hits = [cached.cached_mining(spark, catalog, asked, cache).from_cache for _ in range(3)]
    assert hits == [False, True, True] and len(reads) == 1
    spark.createDataFrame([(500, 9.0, "a")], "id long, x double, g string").write.mode("append").parquet(path)
    again = cached.cached_mining(spark, catalog, asked, cache)
    assert not again.from_cache and [len(r) for r in reads][1] <= 2 and again.data.count() == 2


def test_heavy_results_come_back_whole(spark, tmp_path, monkeypatch):
    rows = spark.range(300).select("id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    catalog = Catalog([FeatureTable("t", lambda s: rows, "id")])
    asked = MiningQuery(variables=("x", "y"), target_table="t", algorithm=AlgorithmSpec("pca", {"result": "scores"}))
    for limit in ("RESULT_ROWS", "MAX_WEIGHT"):
        monkeypatch.setattr(cached if limit == "RESULT_ROWS" else cached.C, limit, 299)
        out = cached.cached_mining(spark, catalog, asked, str(tmp_path / limit))
        assert out.data.count() == 300 and not out.stored and not out.from_cache
        assert cached.prefill(spark, catalog, [asked], str(tmp_path / limit)) == 0
        monkeypatch.undo()
    assert MAX_WEIGHT == cached.C.MAX_WEIGHT
    assert cached.cached_mining(spark, catalog, asked, str(tmp_path / "kept")).stored


def test_results_of_too_many_rows_are_not_weighed(spark, tmp_path, monkeypatch):
    """They come back whole; documents are made and weighed only of what can be stored."""
    rows = spark.range(300).select("id", F.rand(1).alias("x"), F.rand(2).alias("y"))
    catalog = Catalog([FeatureTable("t", lambda s: rows, "id")])
    asked = MiningQuery(variables=("x", "y"), target_table="t", algorithm=AlgorithmSpec("pca", {"result": "scores"}))
    kept = [r["row"] for r in cached.cached_mining(spark, catalog, asked, str(tmp_path / "kept")).data.collect()]
    weighed, weight = [], cached.C.json_weight
    monkeypatch.setattr(cached.C, "json_weight", lambda c: weighed.append(c) or weight(c))
    monkeypatch.setattr(cached, "RESULT_ROWS", 299)
    out = cached.cached_mining(spark, catalog, asked, str(tmp_path / "many"))
    assert not out.stored and not weighed
    assert sorted(json.loads(r["row"])["id"] for r in out.data.collect()) == sorted(json.loads(r)["id"] for r in kept) == list(range(300))
