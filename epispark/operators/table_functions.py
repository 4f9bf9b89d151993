"""Table functions: user code over the ordered rows of a partition, called like a table.

``analyze`` names the output and asks for the rows of an episode together and in frame order, so the
caller only says ``TABLE(...)``. Rows are answered one by one: an episode is never held in memory, but
it is one task's work. The join form in :mod:`epispark.operators.joins` splits long episodes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

NAME = "promote_segments"
LEVELS = ("level_1", "level_2", "level_3")
NEEDED = ("episode", "frame", "task", "segments")


class PromoteSegments:
    """``episode, frame`` and three levels of every frame of ``episode, frame, task, segments``.

    ``segments`` is JSON text on an episode's first frame, or on later ones that replace it; a frame takes
    each level from the last segment that covers it and names the level. Without one, level 1 is the
    task and the others are empty. Text that is no list of segments counts as none.
    """

    def __init__(self) -> None:
        self.task, self.segments = "", []

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("promote_segments takes a table")
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        if missing := [c for c in NEEDED if c not in kinds]:
            raise ValueError(f"promote_segments needs the columns {missing}")
        schema = StructType().add("episode", kinds["episode"]).add("frame", kinds["frame"])
        for level in LEVELS:
            schema = schema.add(level, StringType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("episode")], orderBy=[OrderingColumn("frame")])

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["task"] is not None:
            self.task = row["task"]
        if row["segments"] is not None:
            try:
                found = json.loads(row["segments"])
                self.segments = [s for s in found if isinstance(s, dict) and "start" in s and "end" in s] if isinstance(found, list) else []
            except ValueError:
                self.segments = []
        on = [s for s in self.segments if max(s["start"], 0) <= row["frame"] < s["end"]]
        one, two, three = (next((s[c] for s in reversed(on) if s.get(c) is not None), None) for c in LEVELS)
        yield row["episode"], row["frame"], self.task if one is None else one, two or "", three or ""


def register(spark: SparkSession) -> None:
    spark.udtf.register(NAME, udtf(PromoteSegments))


def promote(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """:class:`PromoteSegments` over ``rows``, as SQL would call it."""
    register(spark)
    return spark.sql(f"SELECT * FROM {NAME}(TABLE({{rows}}))", rows=rows)
