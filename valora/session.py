"""Session helpers: building a local session for tests/bench and finding the
shared checkpoint folder.

On a cluster the session is created by the platform and ``spark.checkpoint.dir``
names a shared folder; the library only reads it.  A private folder is created
only when the setting is unset *and* the master is local (tests, bench).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_CHECKPOINT_ROOT = "/tmp"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "valora") -> SparkSession:
    """A local session tuned like the target cluster (AQE on, UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, creating a private one only for
    local masters where none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) so lineage cuts survive executor loss")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="valora-ckpt-", dir=_LOCAL_CHECKPOINT_ROOT))
    return sc.getCheckpointDir()


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (never the
    executor-local variant: a lost executor would lose the data)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


_OWNED: dict[str, list[str]] = {}  # application id -> folders that this process wrote


def owned_path(spark: SparkSession, prefix: str) -> str:
    """A fresh folder below the shared checkpoint folder.  It belongs to this
    application: :func:`release` removes it, at the latest when the driver
    process ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
    own = _OWNED.setdefault(spark.sparkContext.applicationId, [])
    if not own:
        atexit.register(release, spark)
    own.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove the folders of :func:`owned_path`; frames that read them end."""
    sc = spark.sparkContext
    if sc._jsc is None:  # stopped: the folders went or stay with their cluster
        return
    for path in _OWNED.pop(sc.applicationId, []):
        drop_path(sc, path)


def drop_path(sc, path: str) -> None:
    """Remove a folder of the shared checkpoint folder that this process wrote."""
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def stage_table(df, prefix: str = "stage"):
    """Write ``df`` once as parquet under the shared checkpoint folder and read
    it back: later passes (quantiles, statistics, fits) scan only the columns
    they need instead of recomputing the upstream joins, and the data survive
    executor loss."""
    path = owned_path(df.sparkSession, prefix)
    df.write.mode("error").parquet(path)
    out = df.sparkSession.read.parquet(path)
    want = df.sparkSession.sparkContext.defaultParallelism
    if out.rdd.getNumPartitions() < want:
        # too few files/row groups to keep every core busy: write once more,
        # spread (small data only; large inputs already have many splits)
        wide = owned_path(df.sparkSession, prefix)
        out.repartition(want).write.mode("error").parquet(wide)
        out = df.sparkSession.read.parquet(wide)
    return out


def ensure_parallelism(df, factor: int = 1):
    """Round-robin ``df`` over at least ``factor * defaultParallelism``
    partitions when it has fewer (e.g. a scan of a file with one row group)
    before heavy per-row work.  A no-op for inputs that already have many
    splits, i.e. every large table."""
    want = factor * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


#: The JVM never compiles a method of more bytecode than this: it runs interpreted.
_COMPILED_METHOD = 8000


def bound_generated_code(spark: SparkSession) -> None:
    """Let stages whose generated method the JVM wouldn't compile (projections of
    many columns) run operator by operator, in methods that it does.  A limit that
    the user has lowered stays."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(limit)) > _COMPILED_METHOD:
        spark.conf.set(limit, str(_COMPILED_METHOD))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once an application, so
    that tasks find them whatever the workers' path and folder are.  A no-op
    for every further call."""
    import pathlib
    import zipfile
    bound_generated_code(spark)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent
    path = pathlib.Path(tempfile.mkdtemp(prefix="valora-package-")) / "valora.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)
