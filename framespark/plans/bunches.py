"""Overlapping runs of frames, like a sliding window over frame numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bunches(frames: DataFrame, n: int = 10, overlap: int = 2) -> DataFrame:
    """(stack_id, bunch_idx, frame_idx): bunches of n frames that share ``overlap`` with the next; the last may be short."""
    if overlap >= n:
        raise ValueError("the overlap must be smaller than the bunch")
    step = n - overlap
    sizes = frames.groupBy("stack_id").agg(F.count("*").alias("all"))
    i = F.col("frame_idx")
    first = F.greatest(F.lit(0), F.floor((i - n) / step) + 1)
    last = F.floor(i / step)
    spread = frames.join(sizes, "stack_id").withColumn("bunch_idx", F.explode(F.sequence(first, last)))
    begins = (F.col("bunch_idx") == 0) | (F.col("bunch_idx") * step < F.col("all") - overlap)
    return spread.filter(begins).select("stack_id", F.col("bunch_idx").cast("long"), "frame_idx")
