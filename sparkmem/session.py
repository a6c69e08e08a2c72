"""Session helpers: one place for the configuration every job relies on.

Nothing here creates a cluster-specific path. Scratch output (lineage cuts,
streaming sinks, exports in the registered queries) goes under the shared
folder the session names in ``spark.checkpoint.dir``; a local temporary folder
is created only when that setting is unset, which happens in tests.
"""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are planned against. ``windowGroupLimitThreshold`` is
# raised so that ``row_number() <= budget`` filters with budgets in the
# thousands (working-memory characters) still get a partial WindowGroupLimit
# on the map side of the shuffle.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "sparkmem", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", "16g")
    conf = dict(SESSION_CONF)
    if shuffle_partitions is None and master and master.startswith("local"):
        shuffle_partitions = 8          # a cluster keeps its own setting
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_runtime_conf(spark)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def apply_runtime_conf(spark: SparkSession) -> None:
    """Set the runtime SQL settings the operators expect (idempotent)."""
    for k, v in SESSION_CONF.items():
        if k.startswith("spark.sql."):
            if spark.conf.isModifiable(k):      # a static setting stays as the session has it
                spark.conf.set(k, v)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sparkmem`` importable in the Python workers (once per application).

    The Arrow/pandas functions are pickled by reference to this package, so the
    executors need it. This zips the package on the driver and adds it with
    ``addPyFile`` (what ``--py-files`` does); a cluster that installs the
    package on its executors can skip it.
    """
    import zipfile
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    fd, zpath = tempfile.mkstemp(prefix="sparkmem-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    atexit.register(lambda: os.path.exists(zpath) and os.unlink(zpath))
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="sparkmem-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "sparkmem", f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back.

    Used between iterations of multi-cycle jobs, so a lost executor re-reads
    the written table instead of recomputing the whole history.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def free_disk(spark: SparkSession, *folders: str) -> None:
    """Delete written tables that no later step reads, and have Spark's cleaner delete the shuffle files of jobs whose plans are out of reach.

    For jobs of several rounds: else shuffle files stay until the driver happens to collect its garbage.
    """
    jvm = spark.sparkContext._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    time.sleep(0.5)                             # the listeners let go of a job's plan a moment after its end
    jvm.System.gc()


def clean_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; call it when no DataFrame built on them is needed any more."""
    base = os.path.join(ensure_checkpoint_dir(spark), "sparkmem")
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
