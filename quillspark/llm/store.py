"""Tables that cut lineage, in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder.  Where it is unset, a session on this machine alone gets a
temporary folder; on a cluster its absence is an error, as executors do not share local folders.  A cut
table survives lost executors: its files are committed by Spark's writer and read back as any input.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if a count has shown that it has at most this many narrow rows.
BROADCAST_ROWS = 2_000_000
#: Most MB of rows that are handed to Python at once; the session's own limit stands if it is less.
BATCH_MB = 16
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; without one, a temporary folder if the session is local."""
    if not (path := spark.conf.get("spark.checkpoint.dir", "") or ""):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", size.lower()).groups()
    return int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[unit[:1]]


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes in an Arrow batch to BATCH_MB, so that batches stay small in the JVM and in Python."""
    if _bytes(spark.conf.get(_BATCH)) > BATCH_MB << 20:
        spark.conf.set(_BATCH, f"{BATCH_MB}m")


class Scratch:
    """Cut tables of one run of an operator, with small batches; what is left of the folder goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex[:12]}"
        self.count, self.held = 0, []
        small_batches(spark)
        atexit.register(self._forget)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read back."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quillspark_path = path
        self.held.append(path)
        return out

    def _delete(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete cut tables that nothing will read again."""
        for df in tables:
            if (path := getattr(df, "_quillspark_path", None)) in self.held:
                self.held.remove(path)
                self._delete(path)

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all cut tables but those that a result still reads."""
        kept = {getattr(df, "_quillspark_path", None) for df in tables}
        for path in [x for x in self.held if x not in kept]:
            self.held.remove(path)
            self._delete(path)

    def _forget(self) -> None:
        # a session that has been stopped, or a gateway that is gone, deletes nothing any more
        with contextlib.suppress(Exception):
            if self.spark._jsc.sc().isStopped() is False:
                self._delete(self.root)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a cut table of narrow rows, with a broadcast hint if a count shows it within the bound."""
    return F.broadcast(df) if df.count() <= rows else df


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no column of ``frames`` has it, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
