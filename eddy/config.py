"""Model parameters and session helpers.

The model is a frozen dataclass so it can be captured by executor closures
without surprises. Everything data-sized lives in DataFrames; the config only
carries scalars.
"""

from __future__ import annotations

import dataclasses
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


@dataclasses.dataclass(frozen=True)
class ModelConfig:
    """Parameters of the online micro-cluster model.

    q                   maximum number of micro-clusters kept by the model
    dims                point dimension (checked once against the data)
    min_init_points     0 = random init on the first batch, else buffer this
                        many points before a k-means (or streaming k-means) init
    m_last              m of the recency stamp (only used by the recency variant)
    delta               sliding-window length in ticks
    t_factor            in-lier boundary factor of the RMSD
    recursive_outliers  new clusters of this tick may absorb later outliers
    remove_expired      keep the model equal to the last `delta` ticks
    init_mode           "random" | "kmeans" | "streaming"
    scaling             "batch" (z-score per tick, as the reference) | "none"
    seed                seed of every random choice
    alpha, l            pyramidal snapshot schedule
    variant             "dynamic" (the live model) | "fixed" (fixed-q model with
                        recency-based slot reuse, a disabled variant)
    """

    q: int = 100
    dims: int = 2
    min_init_points: int = 0
    m_last: int = 500
    delta: int = 20
    t_factor: float = 2.0
    recursive_outliers: bool = True
    remove_expired: bool = True
    init_mode: str = "random"
    scaling: str = "batch"
    seed: int = 42
    alpha: int = 2
    l: int = 10
    variant: str = "dynamic"

    def __post_init__(self):
        if self.q < 2:
            raise ValueError("q must be at least 2 (a closest pair needs two clusters)")
        if self.dims < 1:
            raise ValueError("dims must be positive")
        if self.init_mode not in ("random", "kmeans", "streaming"):
            raise ValueError(f"unknown init_mode {self.init_mode!r}")
        if self.scaling not in ("batch", "none"):
            raise ValueError(f"unknown scaling {self.scaling!r}")
        if self.variant not in ("dynamic", "fixed"):
            raise ValueError(f"unknown variant {self.variant!r}")
        if self.alpha < 2 or self.l < 0:
            raise ValueError("pyramidal schedule needs alpha >= 2 and l >= 0")

    def replace(self, **kw) -> "ModelConfig":
        return dataclasses.replace(self, **kw)


# Upper bound on rows of one micro-cluster model (one tick / run group) that
# operators are allowed to hold in one task or broadcast. A bounded model holds
# at most 2q rows within a tick; this guard turns a misuse into an error instead of an
# out-of-memory task.
MAX_MODEL_ROWS = 200_000


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app: str = "eddy") -> SparkSession:
    """Session for tests and the bench. On a cluster, use the cluster's session."""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster's `spark.checkpoint.dir` wins; only when it is unset (tests)
    do we pick a folder of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = os.path.join("/tmp", "eddy-checkpoints")     # one machine, as in tests
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make `eddy` importable by the Python workers (what --py-files does).

    The package is zipped once per application and registered with
    addPyFile; Spark distributes it to every executor. Not needed when the
    package is installed on the cluster, harmless when it is.
    """
    import tempfile
    import zipfile
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(root)
    fd, path = tempfile.mkstemp(prefix="eddy-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _dirs, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(path)
    _SHIPPED.add(app)


def prepare(spark: SparkSession) -> str:
    """Ship the package to the workers and resolve the checkpoint folder."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location for written tables."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/eddy-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into spark.checkpoint.dir (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
