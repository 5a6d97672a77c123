"""What the corpus operators share: the word pattern, the shared folder, materialised tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of characters other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAPS = r"[\x20\x09-\x0D]+"

#: Rows of some 100 bytes up to which a side of a join may be broadcast.
FEW = 300_000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset and all run on one machine."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _own:
        folder = tempfile.TemporaryDirectory(prefix="corpus-")
        atexit.register(folder.cleanup)
        _own["dir"], _own["hold"] = f"file://{folder.name}", folder
    return _own["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and any executor can read it again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more: what was derived of them must be written itself."""
    for df in tables:
        remove(df.sparkSession, df.written_at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)  # false where nothing was written


def bounded(df: DataFrame) -> DataFrame:
    """The right side of a join: broadcast if it has few rows, never beyond, however few bytes its file has."""
    return F.broadcast(df) if df.count() <= FEW else df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def replacing(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns whose names (in any case) an operator is about to give; quoting keeps odd names safe."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
