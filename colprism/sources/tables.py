"""Reading tables, writing results, cutting lineage, saving fitted pipelines."""

from __future__ import annotations

import math
import tempfile
import uuid
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colprism.fixed_values import STATS_25, TEXT_COLUMNS
from colprism.functions.cells import quoted

_FLAGS = {"has_delimiters", "has_url", "has_email", "has_date", "is_list", "is_long_sentence"}
_WHOLE = {"total_vals", "num_nans", "num_of_dist_val"}


def _stat_type(name: str) -> T.DataType:
    if name in _FLAGS:
        return T.BooleanType()
    return T.LongType() if name in _WHOLE else T.DoubleType()


LABELLED_SCHEMA = T.StructType(
    [
        T.StructField("Record_id", T.IntegerType()),
        T.StructField("Attribute_name", T.StringType()),
        T.StructField("y_act", T.StringType()),
        *[T.StructField(s, _stat_type(s)) for s in STATS_25],
        *[T.StructField(s, T.StringType()) for s in TEXT_COLUMNS if s.startswith("sample_")],
    ]
)


def read_csv(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None
) -> DataFrame:
    """A CSV file with a header.  Without a schema the file is read once more to infer it."""
    if schema is None:
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.schema(schema).csv(path, header=True)


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return spark.read.parquet(*paths)


RESCUED = "_corrupt_record"


def read_csv_rescued(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, multi_line: bool = False, header: bool = True, **options: str
) -> tuple[DataFrame, DataFrame]:
    """(rows, rescued) of CSV files, as a rule with a header: rows that fit the schema, and the lines that do not.

    ``rescued`` has ``file``, ``record`` (the line as it is) and ``cells_read``.  A line
    with another number of cells, or a cell that is not of its column's type, is rescued
    whole; every line is in one of the two.  Whole lines are parsed whatever columns are
    used later, so a line does not change lanes with the query.  A file is cut among
    tasks at its line ends; records with line ends inside need ``multi_line``, which
    makes each file one task.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*kind.fields, T.StructField(RESCUED, T.StringType())])
    reader = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RESCUED)
    reader = reader.option("columnPruning", "false").options(escape='"', **options)
    lines = reader.csv(path, header=header, multiLine=multi_line, enforceSchema=True)
    cells = F.size(F.array_compact(F.array(*[quoted(f.name).cast("string") for f in kind.fields])))
    # The tests look at every cell, so that no query can leave all columns but the record unread.
    bad = F.col(RESCUED).isNotNull() & (cells >= 0)
    fine = F.col(RESCUED).isNull() & (cells >= 0)
    rescued = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col(RESCUED).alias("record"), cells.alias("cells_read"), bad.alias("bad")
    )
    return lines.where(fine).drop(RESCUED), rescued.where("bad").drop("bad")


def rescued_counts(rescued: DataFrame) -> DataFrame:
    """(file, lines): how many lines of each file were rescued."""
    return rescued.groupBy("file").agg(F.count(F.lit(1)).alias("lines"))


def read_labelled(
    spark: SparkSession, path: str | list[str], format: str | None = None, multi_line: bool = False
) -> DataFrame:
    """A labelled table of column features; ``format`` is csv or parquet, else told by the file ending.

    Columns are taken by name: the header decides the order, the fixed schema the types.
    A cell that is not of its column's type is NULL.  Cells with line ends inside need
    ``multi_line``, which reads each file in one task.
    """
    first = path if isinstance(path, str) else path[0]
    if (format or ("csv" if first.endswith((".csv", ".csv.gz")) else "parquet")) != "csv":
        return read_parquet(spark, path)
    text = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    known = {f.name: f.dataType for f in LABELLED_SCHEMA.fields}
    # A count may be written as 12 or as 12.0.
    return text.select(
        *[
            text[f"`{c}`"].try_cast("double").try_cast(known[c]).alias(c)
            if isinstance(known.get(c), T.IntegralType)
            else text[f"`{c}`"].try_cast(known.get(c, T.StringType())).alias(c)
            for c in text.columns
        ]
    )


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def select_described(df: DataFrame, described: DataFrame, record: int) -> DataFrame:
    """The columns of ``df`` that a table of column descriptions lists under one ``Record_id``.

    They come in the order of ``df``; names that it does not have are ignored.
    """
    own = described.where((described["Record_id"] == record) & described["Attribute_name"].isin(df.columns))
    names = {r[0] for r in own.select("Attribute_name").distinct().collect()}
    return df.select(*["`" + c.replace("`", "``") + "`" for c in df.columns if c in names])


def scratch_folder(spark: SparkSession) -> str:
    """A new folder's name in the shared storage that ``spark.checkpoint.dir`` names.

    Only a local session may have none: its machine is its cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="scratch-")
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Write once, read back: the stored form of a result, shared by later jobs."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def checkpointed(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Cut the lineage through reliable storage.

    The folder is the session's ``spark.checkpoint.dir``; ``folder`` is used only
    where the session names none.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        chosen = spark.conf.get("spark.checkpoint.dir", None) or folder
        if not chosen:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(chosen)
    return df.checkpoint(eager=True)


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def doublings(step: int) -> int:
    """Copies of the table at a step of the scaling series: 1, 1, 2, 4, 8, ..."""
    return 1 if step < 1 else int(math.pow(2, step - 1))
