from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from plumbline.plans import scoring
from plumbline.queries.common import inspection_log, properties
from plumbline.sources import files, manifest
from plumbline.streaming import inspections as I


def test_inventory_and_assessor(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Street Address, ZIP Code,Ward,Property Type,Service Line Material,Latitude,Longitude\n\"9 Elm Court, Rear\",60477,12,COM, copper ,41.7,-87.9\nElm Walk 2,7,twelve,IND,tin,n/a,3\n,,,,,,\n")
    rows = files.read_inventory(spark, str(tmp_path / "w.csv")).collect()
    assert [(r["service_line_material"], r["latitude"], r["ward"], r["zip_code"]) for r in rows] == [("Copper", 41.7, 12, "60477"), (None, None, None, "7"), (None, None, None, None)]
    (tmp_path / "a.csv").write_text("PIN,Address,Year Built,Building Sq Ft\n,\"9 Elm Court, Rear\",about 1920,\n88-07,Elm Walk 2,1931,2450.5\n")
    rows = files.read_assessor(spark, str(tmp_path / "a.csv")).collect()
    assert [(r["pin"], r["year_built"], r["has_basement"]) for r in rows] == [(None, None, False), ("88-07", 1931.0, False)]


def test_point_elements(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"elements": [{"lat": 41.8, "lon": -87.6}, {"lon": 3.0}]}, indent=2))
    assert [tuple(r) for r in files.read_point_elements(spark, str(tmp_path / "p.json")).collect()] == [(41.8, -87.6)]
    with pytest.raises(FileNotFoundError):
        files.read_point_elements(spark, str(tmp_path / "other"))


def test_income_needs_its_column(spark, tmp_path):
    (tmp_path / "i.csv").write_text("NAME,x,state,county,tract\na,1,17,31,5\n")
    with pytest.raises(ValueError, match="expected column"):
        files.read_income(spark, str(tmp_path / "i.csv"))


def test_manifest(spark, tmp_path):
    data, seen = tmp_path / "d", str(tmp_path / "m")
    data.mkdir()
    (data / "a").write_text("1")
    assert manifest.read_manifest(spark, seen).count() == 0
    manifest.record(manifest.fingerprints(spark, str(data)), seen)
    (data / "b").write_text("2")
    new = manifest.changed(manifest.fingerprints(spark, str(data)), manifest.read_manifest(spark, seen)).collect()
    assert [r["name"] for r in new] == ["b"]
    (data / "sub").mkdir()
    (data / "sub" / "a").write_text("1")  # an equal file in another folder is another file
    new = manifest.changed(manifest.fingerprints(spark, str(data)), manifest.read_manifest(spark, seen)).collect()
    assert sorted(r["name"] for r in new) == ["b", "sub/a"]
    (data / "a").write_text("3")
    assert manifest.changed(manifest.fingerprints(spark, str(data)), manifest.read_manifest(spark, seen)).count() == 3


def test_manifest_reads_no_old_byte(spark, tmp_path):
    """A file swapped behind length and time keeps its recorded digest, so it was not opened; a touched one is hashed again."""
    data, seen = tmp_path / "d", str(tmp_path / "m")
    data.mkdir()
    for name in ("old", "touched"):
        (data / name).write_bytes(b"x" * 5000)
        os.utime(data / name, (1_000_000_000, 1_000_000_000))
    first = manifest.fingerprints(spark, str(data))
    assert {r["hashed"] for r in first.collect()} == {5000}
    manifest.record(first, seen)
    (data / "old").write_bytes(b"y" * 5000)
    os.utime(data / "old", (1_000_000_000, 1_000_000_000))
    os.utime(data / "touched", (1_000_000_100, 1_000_000_100))
    (data / "new").write_bytes(b"n")
    again = manifest.fingerprints(spark, str(data), manifest.read_manifest(spark, seen))
    assert {r["name"]: r["hashed"] for r in again.collect()} == {"old": 0, "touched": 5000, "new": 1}
    assert [r["name"] for r in manifest.changed(again, manifest.read_manifest(spark, seen)).collect()] == ["new"]
    manifest.record(again, seen)
    settled = manifest.fingerprints(spark, str(data), manifest.read_manifest(spark, seen))
    assert {r["hashed"] for r in settled.where("name <> 'new'").collect()} == {0}
    # a file written just before it was recorded may have been written again at the same time
    (data / "fresh").write_bytes(b"z")
    manifest.record(manifest.fingerprints(spark, str(data)), seen)
    late = manifest.fingerprints(spark, str(data), manifest.read_manifest(spark, seen), settle=3600)
    assert {r["name"]: r["hashed"] for r in late.collect()}["fresh"] == 1


@pytest.mark.parametrize("block", [7, 64, 1000, 1 << 20])
def test_digests_are_hash_trees_of_blocks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(manifest, "FAN", 4)
    contents = {"one": b"a", "even": bytes(range(64)), "long": bytes(i * i % 251 for i in range(1000)), "twin": bytes(i * i % 251 for i in range(1000))}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "empty").write_bytes(b"")  # gives no row

    def root(content):
        level = [hashlib.sha256(content[i : i + block]).hexdigest() for i in range(0, max(len(content), 1), block)]
        while len(level) > 1:
            level = [hashlib.sha256("".join(level[i : i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
        return level[0]

    got = {r["name"]: r["digest"] for r in manifest.fingerprints(spark, str(tmp_path), block_bytes=block).collect()}
    assert got == {name: root(content) for name, content in contents.items()}


def test_empty_folder_has_no_fingerprints(spark, tmp_path):
    assert manifest.fingerprints(spark, str(tmp_path)).collect() == []


def test_record_ids_do_not_depend_on_the_time_zone(spark):
    from plumbline.functions.text import event_id

    rows = spark.createDataFrame([("p", 1_600_000_000_123_456)], "k string, us bigint").select("k", F.timestamp_micros("us").alias("at"))
    ids, zone = [], spark.conf.get("spark.sql.session.timeZone")
    for z in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", z)
        ids.append(rows.select(event_id(F.col("k"), F.col("at"))).first()[0])
    spark.conf.set("spark.sql.session.timeZone", zone)
    assert ids[0] == ids[1]


def test_a_value_of_the_partition_column_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(200_000).select(F.lit(1).alias("ward"), F.sha2(F.col("id").cast("string"), 512).alias("x"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    files.write_table(rows, str(tmp_path / "t"), ("ward",))
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "t" / "ward=1").glob("*.parquet"))) > 4 and spark.read.parquet(str(tmp_path / "t")).count() == 200_000


def test_stream_equals_batch_and_replays(spark, sf, tmp_path):
    log, path = inspection_log(spark, sf), str(tmp_path / "log")
    files.append_inspections(log.repartition(4), path)
    good, bad, mark = (str(tmp_path / x) for x in ("good", "bad", "mark"))
    for _ in range(2):  # the second run finds nothing new
        I.ingest(I.read_log(spark, path, 1), good, bad, mark).awaitTermination()
    batch = I.judge(files.read_inspections(spark, path))
    assert spark.read.parquet(good).count() == batch.where(F.size("rejected_for") == 0).count()
    assert spark.read.parquet(bad).count() == batch.where(F.size("rejected_for") > 0).count()


def test_retrain_trigger(spark, sf, tmp_path):
    path, fired = str(tmp_path / "log"), []
    log = inspection_log(spark, sf).where("inspected_material = 'Lead' and cost_usd >= 0").withColumn("used_in_training", F.lit(False))
    files.append_inspections(log.repartition(3), path)
    n = log.count()
    I.retrain_trigger(I.read_log(spark, path, 1), str(tmp_path / "a"), n, lambda b, k: fired.append(k)).awaitTermination()
    assert fired == [n]
    I.retrain_trigger(I.read_log(spark, path, 1), str(tmp_path / "b"), n + 1, lambda b, k: fired.append(k)).awaitTermination()
    assert fired == [n]


def _sent(spark, path, ids, day):
    rows = [(f"i{i}", f"p{i}", "Lead", f"2024-01-{day:02d} 10:00:00.000000", "field_inspection", 1.0, "t", False) for i in ids]
    files.append_inspections(spark.createDataFrame(rows, I.INSPECTION_LOG).coalesce(1), path)


def test_records_sent_again_count_once_and_old_ones_count(spark, tmp_path):
    path, fired, mark = str(tmp_path / "log"), [], str(tmp_path / "a")
    for ids, day in ((range(5), 20), (range(5), 20), (range(3, 8), 21), (range(8, 10), 1)):
        _sent(spark, path, ids, day)
    run = lambda: I.retrain_trigger(I.read_log(spark, path, 1), mark, 6, lambda b, k: fired.append(k)).awaitTermination()
    run()
    assert fired == [8, 10]
    _sent(spark, path, range(20, 22), 25)
    run()  # goes on from the totals of the run before
    assert fired == [8, 10, 12]


def test_state_holds_only_the_delay(spark, tmp_path):
    path, held = str(tmp_path / "log"), []
    for k in range(10):
        _sent(spark, path, range(50 * k, 50 * k + 50), 1 + 3 * k)
    once = I.deduplicated(I.read_log(spark, path, 1), "5 days")
    query = I.run_to_table(once.select("inspection_id"), str(tmp_path / "out"), str(tmp_path / "c"))
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 500
    assert max(held) <= 250  # an id stays for the delay after its time, and the watermark lags by as much


def test_late_records_of_a_replayed_batch_replace_themselves(spark, tmp_path):
    path, out, state = (str(tmp_path / c) for c in ("log", "out", "state"))
    for k, (ids, day) in enumerate(((range(3), 1), (range(3, 6), 20), (range(6, 9), 2), (range(9, 10), 21))):
        _sent(spark, path, ids, day)
    for mark in ("a", "b"):  # a second run from the start writes the same batches again
        I.late_records(I.read_log(spark, path, 1), out, state, str(tmp_path / mark), late="3 days").awaitTermination()
        assert sorted(r[0] for r in spark.read.parquet(out).select("inspection_id").collect()) == ["i6", "i7", "i8"]


def test_queue_carries_no_address(spark, sf):
    rows = properties(spark, sf).withColumn("address", F.lit("secret"))
    queue = scoring.priority_queue(rows, inspection_log(spark, sf), F.lit(0.6))
    assert queue.columns == list(scoring.QUEUE_COLUMNS)


def test_unknown_id_is_an_error(spark, sf):
    wanted = spark.createDataFrame([(1,), (10**9,)], "property_id bigint")
    with pytest.raises(KeyError, match="1000000000"):
        scoring.prediction_records(properties(spark, sf), inspection_log(spark, sf), F.lit(0.6), wanted=wanted)
    known = scoring.prediction_records(properties(spark, sf), inspection_log(spark, sf), F.lit(0.6), wanted=wanted.where("property_id = 1"))
    assert scoring.rank_ids(known).count() == 1


def test_weeks_of_many_files_are_batches(spark, sf, monkeypatch):
    from plumbline.queries import ORACLES, QUERIES, streams

    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    path, n = streams.weeks(spark, sf, True)
    assert n > 1 and len(spark.read.text(path).inputFiles()) == 8 * n
    import compare

    for name in ("l2_stream_dedup", "l4_retrain_trigger"):
        assert compare.difference(QUERIES[name](spark, sf), compare.connect(sf), ORACLES[name]) is None
