"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import facetlake

# Runtime-settable SQL options every plan relies on. Shuffle parallelism and scan
# split size are left to the cluster: they depend on executors, not on the query.
SQL_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Many-to-one lookups may have a hot key on the many side; splitting that
    # partition is worth an extra shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": "10485760",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows with whole texts or images are large; small batches keep Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}

# Before a plan runs Spark knows only the compressed size of files, and takes an explode for one row a row: a view that
# makes 14 triangles of a part counts as less than 4 bytes a part. Of plans over such views only tables of next to nothing
# are broadcast by that size; others once their shuffle has been measured.
EXPANDING_OPTIONS = {
    "spark.sql.autoBroadcastJoinThreshold": "32768",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10485760",
}


_unset_dirs: dict[str, str] = {}


def tune(spark: SparkSession, expanding: bool = False) -> SparkSession:
    """Apply the runtime SQL options to an existing session; with ``expanding`` those for views that make many rows of one.

    Functions of this package travel to Python workers by value, so executors need not have it
    installed.
    """
    cloudpickle.register_pickle_by_value(facetlake)
    for key, value in (SQL_OPTIONS | (EXPANDING_OPTIONS if expanding else {})).items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "facetlake", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.openCostInBytes", "1048576")
    )
    for key, value in SQL_OPTIONS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A temporary folder stands in only on a local master; executors elsewhere would each write to
    their own disk, so there an unset folder is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not is_local(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _unset_dirs:
        _unset_dirs[app] = tempfile.mkdtemp(prefix="facetlake-")
        atexit.register(shutil.rmtree, _unset_dirs[app], ignore_errors=True)
    return _unset_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/facetlake/{name}-{uuid.uuid4().hex[:12]}"


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within this, tables that ``materialize`` writes are deleted at the end, but for those it is told to keep.

    What the block computes must be written before it ends. Scopes may be nested; a table kept by one belongs
    to the scope around it.
    """
    _scopes.append([])
    try:
        yield
    finally:
        discard(spark, _scopes.pop())


def drop_stored(table: DataFrame) -> None:
    """Delete a table that ``materialize`` has written, when nothing will read it again."""
    path = table._stored_at
    for scope in _scopes:
        if path in scope:
            scope.remove(path)
    discard(table.sparkSession, [path])


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch tables, and let Spark drop the shuffle files of plans that nothing refers to any more."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str = "cut", keep: bool = False) -> DataFrame:
    """Cut lineage by writing ``df`` as a table in the shared folder and reading it back.

    Unlike ``checkpoint()`` this computes the plan once, survives executor loss and
    gives the optimiser exact sizes for the next join. ``keep`` lets the table outlive the innermost scratch scope.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    holders = _scopes[:-1] if keep else _scopes
    if holders:
        holders[-1].append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table
