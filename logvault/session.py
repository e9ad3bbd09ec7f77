"""Session helpers.

Cluster jobs read the shared checkpoint folder from ``spark.checkpoint.dir``;
only local runs (tests, bench) set one, and only when it is unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every logvault job relies on (parity with the reference's JSON
# handling): last duplicate key wins like Python's json.loads, and variant
# fields are shredded into typed Parquet columns so filters can skip data.
ENGINE_CONF = {
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.variant.writeShredding.enabled": "true",
    "spark.sql.variant.pushVariantIntoScan": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def get_spark(master: str | None = None, partitions: int | None = None,
              app: str = "logvault", extra: dict | None = None) -> SparkSession:
    """Get or create a session configured for logvault.

    ``master``/``partitions`` are for local runs; on a cluster leave them None
    and let the submit configuration decide.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        b = b.config("spark.ui.enabled", "false")
        b = b.config("spark.ui.showConsoleProgress", "false")
        b = b.config("spark.driver.memory", "8g")
        b = b.config("spark.sql.session.timeZone", "UTC")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in {**ENGINE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings logvault needs to an existing session."""
    for k, v in ENGINE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a running session: already set at build
            pass
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``logvault`` importable in the Python workers (Arrow-batched
    operators run there): zip the package once per application and add it
    with ``addPyFile``, as ``--py-files`` would."""
    sc = _context(spark)
    app = sc.applicationId if sc is not None else spark.conf.get("spark.app.id", "connect")
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    ck = ensure_checkpoint_dir(spark)
    base = local_fs_path(ck) if is_local_path(ck) else tempfile.mkdtemp(prefix="logvault-pkg-")
    os.makedirs(base, exist_ok=True)
    target = os.path.join(base, f"logvault-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, dirs, files in os.walk(pkg):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("logvault", os.path.relpath(full, pkg)))
    if sc is not None:
        sc.addPyFile(target)
    else:  # Spark Connect ships Python files as session artifacts
        spark.addArtifacts(target, pyfile=True)
    _SHIPPED.add(app)


def _context(spark: SparkSession):
    """The SparkContext of a classic session; None under Spark Connect."""
    try:
        return spark.sparkContext
    except Exception:
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        sc = _context(spark)
        if sc is None or not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="logvault-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = _context(spark)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def is_local_path(p: str) -> bool:
    return "://" not in p or p.startswith("file:")


def local_fs_path(p: str) -> str:
    return p[len("file:"):] if p.startswith("file:") else p
