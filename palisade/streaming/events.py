"""Structured Streaming: event metrics by window, and answers put together from their chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palisade.sources.storage import shared_path

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
ANSWERS = "stream_id bigint, answer_no bigint, answer string, n_chunks bigint, n_empty bigint"


def windowed_metrics(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Count, total and largest value of each event type and window; events later than `late` are dropped."""
    kept = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("most")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total", "most")


def assembled(chunks: DataFrame) -> DataFrame:
    """Answers of chunks(stream_id, seq, kind, text): `chunk` adds to the answer, `end` emits it, `error` drops it.

    Empty chunks are counted, not kept. Chunks of a stream must come in order of seq among micro-batches; inside one
    they are sorted. State is one unfinished answer for each stream.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, text, n, empty = state.get if state.exists else (0, "", 0, 0)
        out = []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            if row.kind == "chunk":
                n, empty, text = n + bool(row.text), empty + (not row.text), text + (row.text or "")
            else:
                if row.kind == "end":
                    out.append((key[0], number, text, n, empty))
                    number += 1
                text, n, empty = "", 0, 0
        state.update((number, text, n, empty))
        yield pd.DataFrame(out, columns=["stream_id", "answer_no", "answer", "n_chunks", "n_empty"])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, ANSWERS, "number bigint, text string, n bigint, empty bigint", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it has written. Files and offsets go to the shared folder."""
    spark = stream.sparkSession
    out, log = shared_path(spark, name), shared_path(spark, f"{name}-log")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", log).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def read_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chunk streams: an assistant's turn is a chunk, a user's turn ends the answer before it, a
    system turn breaks it off. Turns that a user opens have nothing to end and give an answer without chunks."""
    turns = spark.readStream.schema("conv_id bigint, turn bigint, role string, text string").option("recursiveFileLookup", True).parquet(f"{sf_dir}/conversations.parquet*")
    kind = F.when(F.col("role") == "assistant", "chunk").when(F.col("role") == "user", "end").otherwise("error")
    return turns.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), kind.alias("kind"), "text")
