"""Streaming forms of the recurrences: daily counts, absence spells, decayed sums, Hawkes intensities, ages and entropies."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wfspark.sources.files import work_folder


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events and their values of each user and day, with a watermark for late ones."""
    at = F.col("ts").cast("timestamp")
    return events.withColumn("at", at).withWatermark("at", late).groupBy("user_id", F.window("at", "1 day")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))


def absence_spells(absences: DataFrame, entity: str, date: str, late: str = "7 days") -> DataFrame:
    """Spells of consecutive days, as session windows that a day's gap ends."""
    at = F.col(date).cast("timestamp")
    days = absences.withColumn("at", at).withWatermark("at", late)
    return days.groupBy(entity, F.session_window("at", "25 hours")).agg(F.count("*").alias("days_absent"))


def decayed_sum(events: DataFrame, entity: str, time: str, value: str, half_life: float) -> DataFrame:
    """Exponentially decayed sum of each entity after every batch; state: the sum and its time. ``time`` is a number."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, last = state.get if state.exists else (0.0, float("-inf"))
        for batch in batches:
            for t, v in batch[[time, value]].sort_values(time).itertuples(index=False):
                if t >= last:
                    total = v + (total * 0.5 ** ((t - last) / half_life) if last > float("-inf") else 0.0)
                    last = t
                else:  # late: decays to the present
                    total += v * 0.5 ** ((last - t) / half_life)
        state.update((total, last))
        yield pd.DataFrame({entity: [key[0]], "at": [last], "total": [total]})

    kind = events.schema[entity].dataType.simpleString()
    rows = events.select(entity, F.col(time).cast("double").alias(time), F.col(value).cast("double").alias(value))
    return rows.groupBy(entity).applyInPandasWithState(step, f"{entity} {kind}, at double, total double", "total double, last double", "update", GroupStateTimeout.NoTimeout)


def hawkes_intensity(events: DataFrame, entity: str, time: str, mu: float, alpha: float, beta: float) -> DataFrame:
    """Intensity of a self-exciting process just before each event; state: the excitement and its time. A late event counts toward the present,
    and its own intensity is that of the present."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        excited, last = state.get if state.exists else (0.0, float("-inf"))
        rows = []
        for t in sorted(x for batch in batches for x in batch[time]):
            if t >= last:
                excited = excited * math.exp(-beta * (t - last)) if last > float("-inf") else 0.0
                rows.append((key[0], t, mu + alpha * excited))
                excited, last = excited + 1, t
            else:
                rows.append((key[0], t, mu + alpha * excited))
                excited += math.exp(-beta * (last - t))
        state.update((excited, last))
        yield pd.DataFrame(rows, columns=[entity, "at", "intensity"])

    kind = events.schema[entity].dataType.simpleString()
    rows = events.select(entity, F.col(time).cast("double").alias(time))
    return rows.groupBy(entity).applyInPandasWithState(step, f"{entity} {kind}, at double, intensity double", "excited double, last double", "append", GroupStateTimeout.NoTimeout)


def weighted_weeks(events: DataFrame, entity: str, time: str, weight: str) -> DataFrame:
    """Weighted mean age of each entity's events in weeks, as of its latest: sums of weights and of weighted times, kept by Spark's own state."""
    at, w = F.unix_timestamp(F.col(time).cast("timestamp")).cast("double") / (7 * 86400), F.col(weight).cast("double")
    sums = events.groupBy(entity).agg(F.sum(w).alias("w"), F.sum(w * at).alias("wt"), F.max(at).alias("latest"))
    return sums.select(entity, F.when(F.col("w") > 0, F.col("latest") - F.col("wt") / F.col("w")).alias("weeks"))


def sliding_entropy(events: DataFrame, entity: str, time: str, category: str, window: str = "14 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """Shannon entropy in bits of the categories in each sliding window of an entity: counts by category, then sums of n log n.
    Two aggregations follow one another, so windows come out in append mode, once the watermark has passed them."""
    at = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    counts = at.groupBy(entity, F.window("at", window, slide), F.col(category).alias("category")).agg(F.count("*").alias("n"))
    sums = counts.groupBy(entity, "window").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    return sums.select(entity, "window", "n", F.greatest(F.lit(0.0), F.log2("n") - F.col("nlogn") / F.col("n")).alias("entropy"))


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for the input that is there, as a table in the work folder: of complete results the last one, else all rows."""
    path = f"{work_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
    return found if mode == "complete" else found.select(*stream.columns)
