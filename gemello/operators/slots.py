"""Manifest slots: which listed files have come, come twice or aren't listed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slot_states(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """(path, state) over manifest paths and record paths: loaded, pending, duplicate or unknown."""
    came = records.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    j = manifest.select("path", F.lit(True).alias("listed")).join(came, "path", "full_outer")
    state = F.when(F.col("listed").isNull(), "unknown").when(F.col("n").isNull(), "pending").when(F.col("n") > 1, "duplicate").otherwise("loaded")
    return j.select("path", state.alias("state"))
