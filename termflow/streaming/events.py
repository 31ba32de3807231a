"""Event operators: change detection, request and acknowledgement, smoothing, follow mode.

Each has a batch form over a table of events and a Structured Streaming form that gives the same rows on
a replayed log. Keyed state lives in the state store; watermarks and expiry are declared by the caller.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from termflow.sources.staging import ship

#: Weight of the newest value.
ALPHA = 0.3
#: Confirmed seeks: past so many, only the newest half stays.
LOG_LIMIT, LOG_KEPT = 100, 50


def changes(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Events whose value differs from the key's previous one; the first of each key too."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    return events.withColumns({"_before": before, "_first": first}).filter(F.col("_first") | ~F.col("_before").eqNullSafe(F.col(value))).drop("_before", "_first")


class ChangeProcessor(StatefulProcessor):
    """Keeps each key's last value; lets through what differs. Rows are (key, ord, value), sorted by ord inside a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("value", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows)).sort_values("ord")
        last, known = (self.last.get()[0], True) if self.last.exists() else (None, False)
        keep = []
        for v in df["value"]:
            keep.append(not known or v != last)
            last, known = v, True
        self.last.update((last,))
        yield df.loc[keep, ["key", "ord", "value"]]

    def close(self) -> None:
        pass


def stream_changes(events: DataFrame) -> DataFrame:
    """`changes` of a stream (key, ord, value)."""
    ship(events.sparkSession)
    schema = StructType([events.schema["key"], StructField("ord", LongType()), StructField("value", StringType())])
    return events.groupBy("key").transformWithStateInPandas(ChangeProcessor(), schema, "Append", "None")


def correlate(requests: DataFrame, replies: DataFrame, timeout: int) -> DataFrame:
    """message_id, at, status of requests (message_id, at): confirmed if a reply (message_id, acked) came within the timeout, else expired. Times are in the same unit."""
    r = replies.select(F.col("message_id").alias("_id"), "acked").groupBy("_id").agg(F.min("acked").alias("acked"))
    df = requests.join(r, F.col("message_id") == F.col("_id"), "left")
    return df.select("message_id", "at", F.when(F.col("acked").between(F.col("at"), F.col("at") + timeout), "confirmed").otherwise("expired").alias("status"))


def stream_correlate(requests: DataFrame, replies: DataFrame, timeout: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """Left outer stream-stream join of requests (message_id, sent) and replies (message_id, acked); an unanswered request comes out once its watermark passes."""
    a = requests.withWatermark("sent", late)
    b = replies.select(F.col("message_id").alias("_id"), "acked").withWatermark("acked", late)
    cond = (F.col("message_id") == F.col("_id")) & (F.col("acked") >= F.col("sent")) & (F.col("acked") <= F.col("sent") + F.expr(f"INTERVAL {timeout}"))
    return a.join(b, cond, "leftOuter").select("message_id", "sent", F.when(F.col("acked").isNotNull(), "confirmed").otherwise("expired").alias("status"))


def confirmed_seeks(seeks: DataFrame, positions: DataFrame, tolerance: float = 0.01, wait: int = 3000) -> DataFrame:
    """`seeks` (session, at, target) with status: confirmed if the session's position came within the tolerance of the target before the wait was over, else timeout. Times are in milliseconds, positions in seconds."""
    p = positions.select(F.col("session").alias("_session"), F.col("at").alias("_at"), "position")
    near = (F.col("session") == F.col("_session")) & F.col("_at").between(F.col("at"), F.col("at") + wait) & (F.abs(F.col("position") - F.col("target")) <= tolerance)
    found = F.max(F.col("_at").isNotNull())
    return seeks.join(p, near, "left").groupBy(*seeks.columns).agg(F.when(found, "confirmed").otherwise("timeout").alias("status"))


def refresh_loop(changed: DataFrame, refresh: Callable[[], None], every: str = "1 second", checkpoint: str | None = None) -> StreamingQuery:
    """Run `refresh` once for each trigger in which a stream of change marks had any row; the marks of one interval make one refresh."""

    def once(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            refresh()

    writer = changed.writeStream.foreachBatch(once).outputMode("append").trigger(processingTime=every)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def confirmed_timestamps(websocket: DataFrame, player: DataFrame) -> DataFrame:
    """timestamp, source of all confirmed jumps, the websocket's and the player's; one that both confirmed is there twice."""
    return websocket.select("timestamp", F.lit("websocket").alias("source")).unionByName(player.select("timestamp", F.lit("mpv").alias("source")))


def throttled(polls: DataFrame, key: str, at: str, every: int = 1000) -> DataFrame:
    """`polls` without those that come less than `every` after the last one of their key that was let through."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keep, last = [], None
        for t in rows[at]:
            ok = last is None or t - last >= every
            keep.append(ok)
            last = t if ok else last
        return rows[keep]

    ship(polls.sparkSession)
    # a key is one player session: its polls, one a second at most, are a small group
    return polls.groupBy(key).applyInPandas(lambda rows: run(rows.sort_values(at)), polls.schema)


def trimmed_log(confirmed: DataFrame) -> DataFrame:
    """Confirmed entries (message_id, acked): the newest LOG_KEPT once there are more than LOG_LIMIT."""
    newest = confirmed.orderBy(F.desc("acked"), "message_id").limit(LOG_LIMIT + 1)
    nth = F.row_number().over(Window.orderBy(F.desc("acked"), "message_id"))  # over LOG_LIMIT + 1 rows
    many = newest.agg(F.count("*").alias("n"))
    return newest.withColumn("_nth", nth).crossJoin(F.broadcast(many)).filter((F.col("n") <= LOG_LIMIT) | (F.col("_nth") <= LOG_KEPT)).drop("_nth", "n")


def smoothed(events: DataFrame, key: str, order: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """key, smoothed: exponential smoothing of each key's values in order, from the first.

    The weights of a value depend on its distance from the end alone, so this is a sum by group: no list
    of a key's values is gathered.
    """
    down = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    up = Window.partitionBy(key).orderBy(*order)
    df = events.select(key, F.col(value).cast("double").alias("_v"), F.row_number().over(down).alias("_from_end"), F.row_number().over(up).alias("_nth"))
    weight = F.pow(F.lit(1 - alpha), F.col("_from_end") - 1) * F.when(F.col("_nth") == 1, 1.0).otherwise(alpha)
    return df.groupBy(key).agg(F.sum(weight * F.col("_v")).alias("smoothed"))


def progress(done: int, total: int) -> float:
    """Share that is done, 0 of nothing."""
    return done / total if total else 0.0


def arbitrated(status: DataFrame) -> DataFrame:
    """Which player serves a session (mpv, websocket connected flags): mpv first."""
    return status.withColumn("player", F.when(F.col("mpv"), "mpv").when(F.col("websocket"), "websocket").otherwise("none"))


def active_media(media: DataFrame) -> DataFrame:
    """One row per (session, tick): sorted active ids and whether they changed since the last tick."""
    now = media.groupBy("session", "tick").agg(F.array_sort(F.collect_set(F.when(F.col("active"), F.col("media_id")))).alias("active"))
    return changes(now, "session", ["tick"], "active")


class Follow:
    """Follow mode as a plain state machine: fed one snapshot at a time, says which media to load.

    A snapshot is a list of {id, active, tracks: [...], file}. While armed: (1) an unseen medium with
    subtitles is loaded, an active one first; (2) if the current one isn't active, the first active one is,
    or for a session opened from a file the one whose activation just changed; (3) a current track whose
    file changed is reloaded. A medium with the same file only lends its id. Arming notes what is there;
    disarming forgets everything.
    """

    def __init__(self, state: str | None = None):
        self.s = json.loads(state) if state else {"armed": False, "seen": [], "active": [], "current": None, "file": None, "from_file": False}

    def dump(self) -> str:
        return json.dumps(self.s)

    def arm(self, snapshot: list[dict]) -> None:
        self.s |= {"armed": True, "seen": sorted(m["id"] for m in snapshot), "active": sorted(m["id"] for m in snapshot if m["active"])}

    def disarm(self) -> None:
        self.s = {"armed": False, "seen": [], "active": [], "current": None, "file": None, "from_file": False}

    def step(self, snapshot: list[dict]) -> tuple[str, str] | None:
        """(action, media id) of a snapshot, or None: load, adopt or reload."""
        s = self.s
        if not s["armed"]:
            return None
        with_tracks = [m for m in snapshot if m["tracks"]]
        active = sorted(m["id"] for m in snapshot if m["active"])
        fresh = sorted((m for m in with_tracks if m["id"] not in s["seen"]), key=lambda m: not m["active"])
        now = [m for m in with_tracks if m["active"]]
        pick, action = None, "load"
        if fresh:
            pick = fresh[0]
        elif s["current"] is not None and s["current"] not in active and now:
            pick = now[0]
        elif s["from_file"] and active != s["active"] and now:
            pick = next((m for m in now if m["id"] not in s["active"]), now[0])
        else:
            own = next((m for m in with_tracks if m["id"] == s["current"]), None)
            if own and own["file"] != s["file"]:
                pick, action = own, "reload"
        s["seen"] = sorted({*s["seen"], *(m["id"] for m in with_tracks)})
        s["active"] = active
        if pick is None or (action == "load" and pick["id"] == s["current"] and pick["file"] == s["file"]):
            return None
        if action == "load" and pick["file"] == s["file"]:
            action = "adopt"
        s |= {"current": pick["id"], "file": pick["file"], "from_file": False}
        return action, pick["id"]


class FollowProcessor(StatefulProcessor):
    """Follow mode of each session over rows (session, tick, command, snapshot as JSON)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", StructType([StructField("json", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f = Follow(self.state.get()[0] if self.state.exists() else None)
        out = []
        for r in pd.concat(list(rows)).sort_values("tick").itertuples():
            snapshot = json.loads(r.snapshot)
            if r.command == "arm":
                f.arm(snapshot)
            elif r.command == "disarm":
                f.disarm()
            elif (did := f.step(snapshot)) is not None:
                out.append((key[0], r.tick, *did))
        self.state.update((f.dump(),))
        yield pd.DataFrame(out, columns=["session", "tick", "action", "media_id"])

    def close(self) -> None:
        pass


def stream_follow(log: DataFrame) -> DataFrame:
    """session, tick, action, media_id of a stream (session, tick, command, snapshot)."""
    ship(log.sparkSession)
    return log.groupBy("session").transformWithStateInPandas(FollowProcessor(), "session string, tick long, action string, media_id string", "Append", "None")


def windowed_counts(events: DataFrame, key: str, time: str = "ts", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: events per key and tumbling window, late ones up to the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
