"""Replayed logs of the live services: what a player, a card collection or a dictionary service said, as JSON lines.

A log is read as a table, or as a stream that follows the folder's files; either has the same columns, so
an operator that is tested on a log works on the service's stream. Lines that aren't of a log's schema are
left out. The services themselves, which need sockets, are not part of the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of each log.
LOGS = {
    "bound_media": "session string, tick bigint, media_id string, title string, active boolean, tracks array<string>, file string",
    "subtitles": "session string, media_id string, track bigint, ord bigint, text string, start_ms bigint, end_ms bigint",
    "positions": "session string, at bigint, position double",
    "notes": "note_id bigint, model string, fields map<string,string>, added timestamp, cards array<bigint>",
    "cards": "card_id bigint, interval bigint",
    "models": "model string, fields array<string>, n_notes bigint",
    "card_formats": "name string, kind string, model string, deck string, templates map<string,string>",
}


def log(spark: SparkSession, path: str, name: str, stream: bool = False) -> DataFrame:
    """A log of LOGS by name, as a table or a stream."""
    reader = (spark.readStream if stream else spark.read).schema(LOGS[name]).option("mode", "DROPMALFORMED")
    df = reader.json(path)
    first = df.columns[0]
    return df.filter(F.col(first).isNotNull())


def used_models(models: DataFrame) -> DataFrame:
    """Models with a note or more, by name; `query` finds their notes, quoted where the name has a space, a colon or a quote."""
    name = F.col("model")
    quoted = F.concat(F.lit('"note:'), F.replace(name, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return models.filter("n_notes > 0").select("model", "fields", F.when(name.rlike('[ :"]'), quoted).otherwise(F.concat(F.lit("note:"), name)).alias("query")).orderBy("model")


def term_formats(formats: DataFrame) -> DataFrame:
    """The card formats that are made of a term."""
    return formats.filter("kind = 'term'").drop("kind")


def sample_note(notes: DataFrame) -> DataFrame:
    """model, note_id, fields: of each model the note in the middle of its ids, the later of two."""
    n = notes.groupBy("model").agg(F.expr("count(*) div 2").alias("_half"))
    from pyspark.sql import Window

    nth = notes.select("model", "note_id", "fields", (F.row_number().over(Window.partitionBy("model").orderBy("note_id")) - 1).alias("_nth"))
    return nth.join(n.withColumnRenamed("model", "_m"), (F.col("model") == F.col("_m")) & (F.col("_nth") == F.col("_half"))).select("model", "note_id", "fields")
