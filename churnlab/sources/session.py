"""Session factory.

Cluster sizing (executors, cores, memory, queue) belongs to ``spark-submit``;
this factory only sets what the library relies on and rejects unknown options
instead of swallowing them.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # let AQE size the partitions of cached tables too; this changes only partitioning
    "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(
    app: str = "churnlab",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
    **unknown,
) -> SparkSession:
    """Build or reuse a SparkSession.

    ``master`` is left unset by default so ``spark-submit`` decides.  Unknown
    keyword arguments raise ``TypeError`` (a mistyped ``memmory=`` must not be
    ignored silently).
    """
    if unknown:
        raise TypeError(f"unknown session options: {sorted(unknown)}")
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(_DEFAULTS)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(int(shuffle_partitions))
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared file system path and is used as
    is.  Only on a local master a scratch folder is created where it is unset;
    elsewhere that folder would be on one machine, so it is refused.
    """
    sc = spark.sparkContext
    active = sc.getCheckpointDir()
    if active:
        return active
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="churnlab-ckpt-")
    sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session used by tests, the bench and the driver entry points."""
    return get_session(
        app="churnlab-local",
        master=f"local[{cores}]",
        shuffle_partitions=shuffle_partitions,
        conf={"spark.driver.memory": os.environ.get("CHURNLAB_DRIVER_MEMORY", "8g")},
    )


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``churnlab`` importable on the executors' Python workers.

    The Arrow-batch functions (TreeSHAP, MLP, correlation) are pickled by
    module reference, so workers must import the package.  Like
    ``spark-submit --py-files``, the package is zipped once per SparkContext
    and distributed with ``addPyFile``.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="churnlab-pyfiles-"), "churnlab.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
