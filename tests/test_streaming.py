"""A replayed stream gives what the batch form gives."""

import json

from pyspark.sql import functions as F

from termflow.streaming import events as E


def replay(spark, df, path, make):
    """Write `df` as files, stream them to the end, return the rows."""
    df.write.mode("overwrite").parquet(str(path))
    name = f"t{abs(hash(str(path)))}"
    q = make(spark.readStream.schema(df.schema).parquet(str(path))).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_changes(spark, tmp_path):
    log = spark.createDataFrame([(f"k{i % 3}", i, "ab"[(i // 4) % 2]) for i in range(40)], "key string, ord long, value string")
    batch = {tuple(r) for r in E.changes(log, "key", ["ord"], "value").collect()}
    stream = {tuple(r) for r in replay(spark, log, tmp_path / "c", E.stream_changes).collect()}
    assert batch == stream and batch


def test_correlate(spark):
    a = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "message_id long, at long")
    b = spark.createDataFrame([(1, 12), (2, 99)], "message_id long, acked long")
    assert {r[0]: r[2] for r in E.correlate(a, b, 5).collect()} == {1: "confirmed", 2: "expired", 3: "expired"}


def test_smoothed(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, 0.0)], "k string, o long, v double")
    assert abs(E.smoothed(df, "k", ["o"], "v").first()["smoothed"] - (0.7 * (0.7 * 10 + 0.3 * 20))) < 1e-9


def test_trimmed_log(spark):
    df = spark.range(150).select(F.col("id").alias("message_id"), F.col("id").alias("acked"))
    assert E.trimmed_log(df).count() == 50 and E.trimmed_log(df.limit(80)).count() == 80


def medium(i, active, file="f", tracks=(1,)):
    return {"id": i, "active": active, "tracks": list(tracks), "file": file}


def test_follow():
    f = E.Follow()
    assert f.step([medium("a", True)]) is None
    f.arm([medium("a", False)])
    assert f.step([medium("a", False), medium("b", True, "g")]) == ("load", "b")
    assert f.step([medium("a", False), medium("b", True, "g")]) is None
    assert f.step([medium("a", False), medium("b", True, "h")]) == ("reload", "b")
    assert f.step([medium("a", True), medium("b", False, "h")]) == ("load", "a")
    assert f.step([medium("a", True), medium("c", True, "f")]) == ("adopt", "c")
    f.disarm()
    assert f.step([medium("z", True, "q")]) is None


def test_follow_stream(spark, tmp_path):
    log = [("s", 1, "arm", json.dumps([medium("a", False)])), ("s", 2, "tick", json.dumps([medium("b", True, "g")])), ("t", 1, "tick", json.dumps([medium("b", True, "g")]))]
    df = spark.createDataFrame(log, "session string, tick long, command string, snapshot string")
    assert [tuple(r) for r in replay(spark, df, tmp_path / "f", E.stream_follow).collect()] == [("s", 2, "load", "b")]


def test_throttle_and_confirmed(spark):
    polls = spark.createDataFrame([("p", t) for t in (0, 400, 999, 1000, 1500, 2600, 2700)] + [("q", 100)], "player string, at long")
    assert sorted(tuple(r) for r in E.throttled(polls, "player", "at").collect()) == [("p", 0), ("p", 1000), ("p", 2600), ("q", 100)]
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "timestamp double")
    assert sorted(tuple(r) for r in E.confirmed_timestamps(t(1.0, 2.0), t(2.0)).collect()) == [(1.0, "websocket"), (2.0, "mpv"), (2.0, "websocket")]


def test_confirmed_seeks(spark):
    seeks = spark.createDataFrame([("a", 0, 10.0), ("a", 5000, 20.0), ("b", 0, 10.0)], "session string, at long, target double")
    positions = spark.createDataFrame([("a", 100, 9.995), ("a", 9000, 20.0), ("b", 50, 10.5)], "session string, at long, position double")
    assert {(r["session"], r["at"]): r["status"] for r in E.confirmed_seeks(seeks, positions).collect()} == {("a", 0): "confirmed", ("a", 5000): "timeout", ("b", 0): "timeout"}


def test_refresh_loop(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "in"))
    calls = []
    q = E.refresh_loop(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda: calls.append(1), "1 second", str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert calls == [1]


def test_replayed_logs(spark, tmp_path):
    from termflow.sources import replay

    (tmp_path / "m.json").write_text("\n".join(json.dumps(x) for x in [{"model": "A", "fields": ["w"], "n_notes": 2}, {"model": 'B "x"', "fields": [], "n_notes": 1}, {"model": "C", "n_notes": 0}]) + "\nnot json\n")
    rows = replay.log(spark, str(tmp_path / "m.json"), "models")
    assert rows.count() == 3
    assert [(r["model"], r["query"]) for r in replay.used_models(rows).collect()] == [("A", "note:A"), ('B "x"', '"note:B \\"x\\""')]
    notes = spark.createDataFrame([(i, "m", {"w": str(i)}) for i in range(5)], "note_id long, model string, fields map<string,string>")
    assert [r["note_id"] for r in replay.sample_note(notes).collect()] == [2]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.json").write_text(json.dumps({"session": "s", "at": 5, "position": 1.5}) + "\n")
    q = replay.log(spark, str(tmp_path / "log"), "positions", stream=True).writeStream.format("memory").queryName("positions_log").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("positions_log").collect()] == [("s", 5, 1.5)]
