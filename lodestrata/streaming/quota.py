"""Streaming twins: uses of a key per UTC day, and the latest state of each snapshot."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_uses(stream: DataFrame, key: str, limit: int, late: str = "2 days") -> DataFrame:
    """(key, day, uses, refused) in tumbling days; a day's state goes once the watermark passes it by `late`."""
    days = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), key).agg(F.count("*").alias("uses"))
    return days.select(key, F.to_date("window.start").alias("day"), "uses", F.greatest(F.col("uses") - limit, F.lit(0)).alias("refused"))


def latest_states(stream: DataFrame) -> DataFrame:
    """(snapshot_id, status, event_id) as updates: the latest event of each key, ties by event_id; kept as one row of state."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best: Any = state.get if state.exists else None
        for f in frames:
            row = f.sort_values(["ts", "event_id"]).iloc[-1]
            new = (int(row["ts"].value), int(row["event_id"]), str(row["status"]))
            best = new if best is None or new[:2] > tuple(best[:2]) else best
        state.update(tuple(best))
        yield pd.DataFrame({"snapshot_id": [key[0]], "status": [best[2]], "event_id": [best[1]]})

    return stream.groupBy("snapshot_id").applyInPandasWithState(update, "snapshot_id long, status string, event_id long", "ts long, event_id long, status string", "update", GroupStateTimeout.NoTimeout)


def run_once(spark: SparkSession, out: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, write it to path as Parquet, and read that."""
    if mode == "append":
        out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode).start().awaitTermination()
    else:
        out.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)
