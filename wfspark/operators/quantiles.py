"""Exact percentiles of large tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 8192
FEW = 50_000


def percentiles(rows: DataFrame, wanted: dict[str, list[float]], weight: str | None = None, nearest: bool = False) -> dict[str, list[float | None]]:
    """Percentiles of finite columns, as ``F.percentile`` defines them (``weight``: times that a row counts; ``nearest``: the value at the nearest rank, not between two). A pass counts the rows in ranges of all columns and
    the next one cuts the ranges where the wanted ranks lie, until a range has few rows or one value: no task holds the values of a column, as in an
    exact percentile's map of all values."""
    w = F.col(weight) if weight else F.lit(1)
    names = list(wanted)
    ends = rows.agg(*[x for i, c in enumerate(names) for x in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.sum(F.when(F.col(c).isNotNull(), w)).alias(f"n{i}"))]).first()
    at: dict[tuple[str, int], tuple[float, float, int, int]] = {}  # column and rank: least and largest value of its range, rows below it, rows in it
    for i, c in enumerate(names):
        for p in wanted[c] if ends[f"n{i}"] else []:
            place = round(p * (ends[f"n{i}"] - 1)) if nearest else p * (ends[f"n{i}"] - 1)
            for rank in {math.floor(place), math.ceil(place)}:
                at[c, rank] = float(ends[f"lo{i}"]), float(ends[f"hi{i}"]), 0, int(ends[f"n{i}"])
    while spans := sorted({(c, *r) for (c, _), r in at.items() if r[0] < r[1]}):
        cells = []
        for i, (c, low, high, _, n) in enumerate(spans):
            x = F.col(c).cast("double")
            # a range of few rows is cut at every value
            bin_ = F.floor((x - F.lit(low)) / F.lit(high - low) * BINS).cast("int") if n > FEW else F.lit(0)
            cells.append(F.when(x.between(low, high), F.struct(F.lit(i).alias("i"), bin_.alias("b"), (F.lit(None) if n > FEW else x).cast("double").alias("v"), x.alias("x"), w.alias("w"))))
        found = rows.select(F.explode(F.array(*cells)).alias("s")).where("s is not null").groupBy("s.i", "s.b", "s.v").agg(F.min("s.x").alias("lo"), F.max("s.x").alias("hi"), F.sum("s.w").alias("n"))
        cut: dict[int, list] = {i: [] for i in range(len(spans))}
        for r in sorted(found.collect(), key=lambda r: (r["i"], r["lo"])):
            below = cut[r["i"]][-1][2] + cut[r["i"]][-1][3] if cut[r["i"]] else spans[r["i"]][3]
            cut[r["i"]].append((r["lo"], r["hi"], below, int(r["n"])))
        number = {s: i for i, s in enumerate(spans)}
        for (c, rank), r in at.items():
            if r[0] < r[1]:
                at[c, rank] = next(x for x in cut[number[c, *r]] if x[2] <= rank < x[2] + x[3])
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        out[c] = []
        for p in wanted[c]:
            if not ends[f"n{i}"]:
                out[c].append(None)
                continue
            place = round(p * (ends[f"n{i}"] - 1)) if nearest else p * (ends[f"n{i}"] - 1)
            low, high = math.floor(place), math.ceil(place)
            out[c].append(at[c, low][0] if low == high else (high - place) * at[c, low][0] + (place - low) * at[c, high][0])
    return out
