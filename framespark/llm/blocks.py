"""All pairs within cells, in blocks of bounded size: full cells are cut into stretches that meet two by two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def meet_in_blocks(rows: DataFrame, cell: list[str], size: int, worth: str = "rows > 1") -> DataFrame:
    """``rows`` (with a column ``id``) dealt out by ``cell`` and the columns ``first`` and ``second``.

    Every row has a stretch, ``piece``; a group holds all rows of the stretches ``first`` and ``second`` of a cell,
    about ``size`` rows each, so every two rows of a cell meet in exactly one group. ``worth`` is a condition on a
    cell's number of ``rows`` (and any ``home`` rows, ``homes``) without which it is left out.
    """
    homes = F.count_if("home") if "home" in rows.columns else F.count("*")
    full = (
        rows.groupBy(*cell)
        .agg(F.count("*").alias("rows"), homes.alias("homes"))
        .filter(worth)
        .select(*cell, F.ceil(F.col("rows") / size).cast("int").alias("pieces"))
    )
    full = materialize(full, "full")
    cut = rows.join(full, cell).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return met.withColumns({"first": F.least("piece", "other"), "second": F.greatest("piece", "other")}).drop(
        "other", "pieces"
    )
