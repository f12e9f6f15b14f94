"""Calls of outside services over rows: bounded, in two passes, so that no answer's failure fails a task."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import bounded_batches, staged

Call = Callable[[Sequence[str]], list[str | None]]


def answers(call: Call, asked: list[str]) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each; a batch that fails is asked one by one, and an empty answer is a failure."""
    if not asked:
        return []
    try:
        return [(a, None) if a and a.strip() else (None, "empty answer") for a in _full(call, asked)]
    except Exception as e:
        if len(asked) == 1:
            return [(None, str(e) or type(e).__name__)]
        return [x for one in asked for x in answers(call, [one])]


def _full(call: Call, asked: list[str]) -> list[str | None]:
    found = call(asked)
    if len(found) != len(asked):
        raise ValueError(f"{len(found)} answers for {len(asked)} questions")
    return found


def asked_rows(df: DataFrame, column: str, call: Call, number: int, size: int, tasks: int | None, pause: float = 0.0) -> DataFrame:
    """All columns of df (which have no answer, error or pass), and these three; null questions have no answer and no error."""
    names = df.columns
    safe = [f"c{i}" for i in range(len(names))]
    question = safe[names.index(column)]
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if pause:
            time.sleep(pause)  # what failed a moment ago may work in another
        for whole in batches:
            for at in range(0, len(whole), size):
                part = whole.slice(at, size)
                texts = part.column(question).to_pylist()
                told = iter(answers(call, [t for t in texts if t is not None]))
                found = [(None, None) if t is None else next(told) for t in texts]
                passes = [None if t is None else number if a is not None else 0 for t, (a, _) in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([a for a, _ in found], pa.string()), pa.array([e for _, e in found], pa.string()), pa.array(passes, pa.int32())], names=[*safe, "answer", "error", "pass"])

    kinds = ", ".join(f"{s} {f.dataType.simpleString()}" for s, f in zip(safe, df.schema))
    rows = df.toDF(*safe)
    return (rows.coalesce(tasks) if tasks else rows).mapInArrow(run, f"{kinds}, answer string, error string, pass int").toDF(*names, "answer", "error", "pass")


def two_passes(df: DataFrame, column: str, call: Call, tasks: int | None = None, pause: float = 2.0, size: int = 5) -> DataFrame:
    """All columns of df, ``answer``, ``error`` and ``pass``: the pass that answered (1 or 2), 0 where both failed.

    Both passes are staged, so nothing is asked twice because a later step reads it twice, and the failures of the first
    are rows of their own that the second asks again, ``tasks`` at a time (4 where none is given) after a pause.
    """
    first = staged(asked_rows(df, column, call, 1, size, tasks), "first-pass")
    failed = first.where("pass = 0")
    again = failed.drop("answer", "error", "pass")
    second = staged(asked_rows(again, column, call, 2, size, tasks or 4, pause), "second-pass")
    return first.where("pass = 1 or pass is null").unionByName(second)


def pass_counts(told: DataFrame) -> DataFrame:
    """pass, n: how many answers each pass gave, and how many are missing (0)."""
    return told.where("pass is not null").groupBy("pass").agg(F.count("*").alias("n"))
