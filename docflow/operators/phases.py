"""A preparation in named phases, each of which reads the table that the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..streaming.progress import PHASES


def run_phases(spark: SparkSession, steps: dict[str, Callable[[DataFrame | None], DataFrame]], phase: str, folder: str) -> DataFrame:
    """The table of the last phase run: ``all`` runs every phase in order, a single one takes up its predecessor's table.

    Tables are named after their phases below ``folder``; a phase that is run again replaces its own table.  They hold
    texts and vectors, whose values hardly ever come again: a dictionary of them costs time and saves nothing.
    """
    order = [p for p in PHASES if p in steps]
    if phase not in (*order, "all"):
        raise ValueError(f"unknown phase {phase}; there are {', '.join(order)} and all")
    for name in order if phase == "all" else [phase]:
        at = order.index(name)
        made = steps[name](spark.read.parquet(f"{folder}/{order[at - 1]}") if at else None)
        made.write.mode("overwrite").options(**{"compression": "zstd", "parquet.enable.dictionary": "false"}).parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")
