"""Column expressions over whole texts that several operators share."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.session import materialise

SPACES = "\t\n\x0b\x0c\r"  # and all between the first and the last
TEXTS_PER_BATCH = 1000


def whole(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))


def between_spaces(text: Column) -> Column:
    """What stands before, between and after the characters ``[\\x20\\x09-\\x0D]`` of a non-null text, empty strings included."""
    return F.split(F.regexp_replace(text, f"[{SPACES[0]}-{SPACES[-1]}]", " "), " ")


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a non-null text."""
    return F.array_remove(between_spaces(text), "")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.size(word_array(whole(text))).cast("long")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each with as many underscores in front as it takes to differ from all columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_batches(spark: SparkSession) -> None:
    """Lets Arrow batches of this session hold ``TEXTS_PER_BATCH`` rows at most.

    Whole texts go to Python in these batches; Spark's default of 10,000 rows would keep several
    copies of tens of MB in every task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXTS_PER_BATCH:
        spark.conf.set(name, TEXTS_PER_BATCH)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a long column ``name`` that is another for every row and the same in every read.

    Rows of written files are named by file and place in it, so texts need not be copied; the driver
    holds the list of files. Other tables are written once with a number.
    """
    path, place = free_names(docs, "file_path", "file_place")
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
    except AnalysisException:  # not a plain file scan
        return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    files = sorted(r[0] for r in rows.select(path).distinct().collect())
    names = docs.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], "file string, number long")
    rows = rows.join(F.broadcast(names), F.col(path) == F.col("file"))
    return rows.withColumn(name, F.shiftleft("number", 40) + F.col(place)).drop(path, place, "file", "number")
