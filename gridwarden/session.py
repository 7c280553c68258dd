"""Session defaults and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_SCRATCH_KEY = "gridwarden.scratch.dir"


# HotSpot does not compile methods above 8000 bytes. Generated stages beyond that run interpreted, many
# times slower than the same operators generated one by one.
_METHOD_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def tune(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on, for sessions made elsewhere: UTC times, compilable stages."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(*_METHOD_LIMIT)
    return spark


def build_session(app: str = "gridwarden", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with UTC times and adaptive execution; sizes stay with the cluster's own defaults."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The folder is the one named in ``spark.checkpoint.dir``, or else in this library's own session key
    ``gridwarden.scratch.dir``. Only on a local master, where all tasks share one disk, may both be unset.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY, None) or spark.conf.get(_SCRATCH_KEY, None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"name a folder that all executors share in {_CHECKPOINT_KEY} or {_SCRATCH_KEY}")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_SCRATCH_KEY, root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextmanager
def file_by_file(spark: SparkSession) -> Iterator[None]:
    """Jobs inside read no two files in one task."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    # a file counts as a full task's share already when it is opened
    spark.conf.set(name, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Folders stored inside the innermost open ``temporary``; None outside any.
_STORED: ContextVar[list[str] | None] = ContextVar("stored", default=None)


def cut_lineage(df: DataFrame, purpose: str = "stage", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so a lost executor never recomputes it; ``options`` are the writer's."""
    path = shared_dir(df.sparkSession, purpose)
    if (stored := _STORED.get()) is not None:
        stored.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Remove what ``cut_lineage`` stores inside once the block ends; ``keep(df)`` stores ``df`` beyond it.

    What leaves the block must be kept: a frame that still reads a stored table of the block fails later.
    """
    outer = _STORED.get()
    inner: list[str] = []

    def keep(df: DataFrame, purpose: str = "kept") -> DataFrame:
        token = _STORED.set(outer)
        try:
            return cut_lineage(df, purpose)
        finally:
            _STORED.reset(token)

    token = _STORED.set(inner)
    try:
        yield keep
    finally:
        _STORED.reset(token)
        for path in inner:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
