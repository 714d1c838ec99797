"""Tables written in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local master gets one for this process; a cluster is refused,
    since its executors would each write to a disk of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        path = _OWN["dir"]
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/palimpsest-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more: all that came of them is written."""
    for t in tables:
        spark = t.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """The tables that one operator writes for itself; they go once its result is written."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(materialise(df, label))
        return self.tables[-1]

    def result(self, df: DataFrame, label: str) -> DataFrame:
        out = materialise(df, label)
        discard(*self.tables)
        self.tables.clear()
        return out


def prefix(df: DataFrame, base: str) -> str:
    """`base`, longer by underscores until no column of df begins with it, in any case: names made of it clash with none."""
    while any(c.lower().startswith(base.lower()) for c in df.columns):
        base += "_"
    return base
