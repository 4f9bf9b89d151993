"""Raw record files as a Spark data source, batch and stream.

A record file is one episode: a JSON object with ``episode_id`` and ``steps``. A source plug-in names the
files it wants and turns one record into rows; reading, partitioning, the episode filter, offsets and
commits are Spark's. Files that cannot be parsed come out as one row with ``error`` set.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition,
)

FORMAT = "episode_records"
SCHEMA = "episode_id long, frame_index int, action array<double>, file string, error string"
FILES_PER_PARTITION = 16
MAX_PARTITIONS = 128


@dataclass
class Files(InputPartition):
    paths: list[str]


def _open(path: str):
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def list_records(path: str, suffix: str = ".json") -> list[str]:
    """Record files of a folder in the order of their names."""
    import pyarrow.fs as pafs

    fs, root = _open(path)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(suffix))


def episode_of(path: str) -> int | None:
    """Episode number in the file's name, ``..._<number>.json``; it decides before a file is opened."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].rsplit("_", 1)[-1]
    return int(stem) if stem.isdigit() else None


def runs(files: list[str]) -> list[InputPartition]:
    """Runs of files, one a task: 16 files each, and more where that would be over ``MAX_PARTITIONS`` tasks."""
    per = max(FILES_PER_PARTITION, -(-len(files) // MAX_PARTITIONS))
    return [Files(files[i : i + per]) for i in range(0, len(files), per)]


def convert(text: bytes, file: str) -> Iterator[tuple]:
    """Rows of one record; a record without usable steps is one row with an error."""
    name = file.rsplit("/", 1)[-1]
    try:
        record = json.loads(text)
        episode = int(record["episode_id"])
        rows = [(episode, k, [float(x) for x in step["action"]], name, None) for k, step in enumerate(record["steps"])]
    except (ValueError, KeyError, TypeError) as err:
        yield None, None, None, name, f"{type(err).__name__}: {err}"[:200]
        return
    yield from rows


def _read(root: str, paths: Sequence[str]) -> Iterator[tuple]:
    fs, _ = _open(root)
    for path in paths:
        with fs.open_input_stream(path) as f:
            yield from convert(f.read(), path)


class RecordReader(DataSourceReader):
    """One partition per run of files, all of them or those of some episodes."""

    def __init__(self, root: str):
        self.root, self.episodes = root, None

    def partitions(self) -> list[InputPartition]:
        files = list_records(self.root)
        if self.episodes is not None:
            files = [f for f in files if (k := episode_of(f)) is None or k in self.episodes]
        return runs(files) or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _read(self.root, partition.paths)


class PushedRecordReader(RecordReader):
    """Takes Spark's episode filters, which leave the files of other episodes unopened.

    Spark plans such a reader once per loaded table and keeps its files for later queries over the same
    DataFrame, so it serves one query: see :func:`read_episodes`.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("episode_id",):
                self.episodes = values if self.episodes is None else self.episodes & values
            yield f  # names only choose files; Spark still filters the rows


class RecordStream(DataSourceStreamReader):
    """New files in the order of their names; an offset is the last name that was planned.

    A micro-batch takes all files that are new, a few to a task. Files that arrive later must have later
    names.
    """

    def __init__(self, root: str):
        self.root, self.planned = root, ""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        self.planned = max([self.planned, *list_records(self.root)[-1:]])
        return {"after": self.planned}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.planned = max(self.planned, end["after"])
        files = [f for f in list_records(self.root) if start["after"] < f <= end["after"]]
        return runs(files)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _read(self.root, partition.paths)

    def commit(self, end: dict) -> None:
        """Spark's checkpoint keeps the offset; files stay where they are."""


class RecordSource(DataSource):
    """``spark.read.format("episode_records").load(path)``, and ``spark.readStream`` alike."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        pushed = self.options.get("pushEpisodes", "false") == "true"
        return (PushedRecordReader if pushed else RecordReader)(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RecordStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(RecordSource)


def read_episodes(spark: SparkSession, path: str, episodes: Sequence[int]) -> DataFrame:
    """Rows of some episodes: Spark pushes the filter to the source, which opens their files only.

    The table is loaded for this query alone; filter the result of a plain load for anything else.
    """
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # asked for by readers with filters only
    rows = spark.read.format(FORMAT).option("pushEpisodes", "true").load(path)
    return rows.where(F.col("episode_id").isin(*episodes))
