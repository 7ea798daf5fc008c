"""Reference frames as state, against a plain session, across batches and a restart."""

import json
import random

import pytest

SCHEMA = "picture_id bigint, frame_idx int, is_key boolean, refresh_last boolean, refresh_golden boolean, refresh_alternate boolean, copy_to_golden int, copy_to_alternate int, plane binary"


@pytest.fixture(scope="module")
def stateful(spark):
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def session(rows):
    """(frame_idx, status, what the three hold) of one animation's frames in order of arrival."""
    held, seen, out = {"last": None, "golden": None, "alternate": None}, None, []
    for k, key, last, golden, alternate, to_golden, to_alternate in rows:
        if seen is not None and k <= seen:
            status = "late"
        elif seen is None and not key:
            status = "no reference"
        else:
            status, seen = "ok", k
            if not (key or alternate) and to_alternate:
                held["alternate"] = held["last" if to_alternate == 1 else "golden"]
            if not (key or golden) and to_golden:
                held["golden"] = held["last" if to_golden == 1 else "alternate"]
            for n, fresh in (("last", last), ("golden", golden), ("alternate", alternate)):
                if key or fresh:
                    held[n] = k
        out.append((k, status, held["last"], held["golden"], held["alternate"]))
    return out


def plane(p, k):
    return bytes([p, k]) * 4


def random_frames(seed):
    r = random.Random(seed)
    return [(k, k % 9 == 2, r.random() < 0.5, r.random() < 0.3, r.random() < 0.3, r.choice([0, 1, 2]), r.choice([0, 1, 2])) for k in range(24)]


def run(spark, tmp, source, out, idle=0):
    from rasterlake.streaming.references import reference_stream

    frames = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = reference_stream(frames, idle).writeStream.format("parquet").option("checkpointLocation", str(tmp / "checkpoint")).outputMode("append").trigger(availableNow=True).start(str(out))
    query.awaitTermination(180)
    query.stop()


def test_states_follow_the_session_over_batches_and_a_restart(stateful, tmp_path):
    spark, source, out = stateful, tmp_path / "in", tmp_path / "out"
    frames = {p: random_frames(p) for p in (1, 2)}
    parts = [list(range(0, 8)), list(range(12, 20)), [*range(8, 12), *range(20, 24)]]  # 8 to 11 come late
    for n, part in enumerate(parts):
        rows = [(p, *frames[p][k], bytearray(plane(p, k))) for p in frames for k in part]
        random.Random(n).shuffle(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        if n != 1:  # two batches in the first run but one, the rest after a restart from the checkpoint
            run(spark, tmp_path, source, out)
    got = spark.read.parquet(str(out)).collect()
    for p in frames:
        want = session([frames[p][k] for part in parts for k in part])
        own = {r.frame_idx: r for r in got if r.picture_id == p}
        assert len([r for r in got if r.picture_id == p]) == 24
        assert sorted((k, r.status, r.last_idx, r.golden_idx, r.alternate_idx) for k, r in own.items()) == sorted(want)
        assert {r.status for r in own.values()} == {"ok", "late", "no reference"}
        for r in own.values():
            for n in ("last", "golden", "alternate"):
                k = r[f"{n}_idx"]
                assert r[n] == (None if k is None else plane(p, k))


def test_idle_animations_expire(stateful, tmp_path):
    import time

    from rasterlake.streaming.references import reference_stream

    spark, source = stateful, tmp_path / "in"
    source.mkdir()
    rows = [(7, 0, True, False, False, False, 0, 0, bytearray(b"x"))]
    frames = spark.readStream.schema(SCHEMA).parquet(str(source))
    query = reference_stream(frames, 500).writeStream.format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="1 second").start()
    try:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        for _ in range(90):
            found = [(r.status, r.last_idx) for r in spark.table("expiring").collect()]
            if len(found) >= 2:
                break
            time.sleep(1)
        assert sorted(found) == [("expired", 0), ("ok", 0)]
    finally:
        query.stop()
