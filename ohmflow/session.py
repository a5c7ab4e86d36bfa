"""Session construction and the shared scratch folder.

Library functions never build their own session; they use the one they are
given.  ``build_session`` is for tests, the bench and command-line use.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

# Settings the library relies on when it owns the session.  On a cluster the
# operator decides.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "ohmflow",
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    It is the session's (``spark.checkpoint.dir``).  Where none is set, a session
    whose executors all live in the driver's process gets a folder of its own;
    any other session raises, since its executors would not share one.
    """
    try:
        sc = spark.sparkContext
    except Exception:            # sessions without a local context (e.g. Connect)
        sc = None
    cur = (sc.getCheckpointDir() if sc is not None else None) or spark.conf.get("spark.checkpoint.dir", None)
    if not cur:
        if sc is None or not is_single_process(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        cur = f"{sc.getConf().get('spark.local.dir', '/tmp')}/ohmflow-{uuid.uuid4().hex[:12]}"
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(cur)
        cur = sc.getCheckpointDir()
    return cur


def is_single_process(master: str) -> bool:
    """True for ``local`` and ``local[...]``, where driver and executors are one process."""
    return master == "local" or master.startswith("local[")


_scope: ContextVar[list[str] | None] = ContextVar("ohmflow_scratch", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never reused).

    The innermost ``scratch_scope`` of the caller owns it; outside of one it stays.
    """
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/ohmflow-{name}-{uuid.uuid4().hex[:12]}"
    owned = _scope.get()
    if owned is not None:
        owned.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Remove the scratch folders made inside the block when it ends, after an error too.

    Operators return lazy results that read these folders, so write the result
    (to a folder of your own) inside the block.  The block's value is the list of its
    folders; one taken off the list stays.  A block inside another removes its
    own folders only, and threads started inside own theirs.
    """
    owned: list[str] = []
    token = _scope.set(owned)
    try:
        yield owned
    finally:
        _scope.reset(token)
        for path in owned:
            remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system Spark reads it from; a missing one is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def enable_legacy_charsets(spark: SparkSession) -> None:
    """GBK and other non-standard charsets need these flags in Spark 4 (bytes that do
    not decode become replacement characters); raises where they cannot be set."""
    for name in ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction"):
        if spark.conf.get(name, "false") != "true":
            spark.conf.set(name, "true")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def local_path(uri: str) -> str:
    """Strip a ``file:`` scheme for local tooling (tests only)."""
    if uri.startswith("file:"):
        uri = uri[len("file:"):]
        while uri.startswith("//"):
            uri = uri[1:]
    return os.path.abspath(uri)


def materialize(df, name: str = "stage"):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads the files instead of
    recomputing the plan) and lets several branches of a plan share one
    columnar copy instead of recomputing their common input.  The schema is
    known, so no job reads it back from the files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
