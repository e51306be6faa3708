"""Session settings every job relies on."""

from __future__ import annotations

import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that change results, not only speed: UTC wall clock for every timestamp.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Runtime re-planning: coalesce small shuffle partitions, split skewed join partitions,
# turn a sort-merge join into a broadcast join only when the runtime size is below the
# threshold (a measured size check, not a guess).
ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
}


# Bytes of input behind one shuffle partition; bytes of a shuffle and of a file that one task takes at most.
INPUT_A_PARTITION = 8 << 20
MOST_A_TASK = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20,
    "spark.sql.files.maxPartitionBytes": 32 << 20,
}
_UNITS = {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to an existing session (idempotent)."""
    for key, value in {**RESULT_CONF, **ADAPTIVE_CONF}.items():
        spark.conf.set(key, value)
    return spark


def conf_bytes(value: str) -> int:
    """Bytes of a size setting such as ``64MB``, ``128m`` or ``134217728b``."""
    number, unit = re.fullmatch(r"(\d+)\s*([bkmgt]?)b?", value.strip().lower()).groups()
    return int(number) << _UNITS[unit]


RELEASE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released_shuffles(spark: SparkSession):
    """Within it, the shuffle files of a query go when the query ends, not when the driver happens to collect its garbage.
    For steps that write their result; what is run a second time would be shuffled anew."""
    before = spark.conf.get(RELEASE_SHUFFLES, None)
    spark.conf.set(RELEASE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE_SHUFFLES, before) if before is not None else spark.conf.unset(RELEASE_SHUFFLES)


def size_partitions(spark: SparkSession, input_bytes: int) -> None:
    """Shuffle partitions grow in number with the input, not in size: what one task sorts or hashes stays the
    same on larger tables. Small shuffles are merged again at run time; a session that asks for more or
    smaller partitions keeps them."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // INPUT_A_PARTITION))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    for key, most in MOST_A_TASK.items():
        if conf_bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, f"{most}b")


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions a shuffle of this session starts with, as ``size_partitions`` set them."""
    return int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or spark.conf.get("spark.sql.shuffle.partitions"))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "croupier") -> SparkSession:
    """A local session for tests and the bench; clusters pass their own session to ``configure``."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CROUPIER_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**RESULT_CONF, **ADAPTIVE_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none (tests, the bench) gets a scratch folder of its own; a
    cluster session without the setting is an error, because a machine-local folder would be
    invisible to the other machines.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (client without a SparkContext: the server's setting applies)
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="croupier-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
