"""Session helpers shared by all operators: tables, materialisation, checked broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after it was counted and its estimated bytes stay below this bound.
BROADCAST_BYTES = 32 << 20

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir``. Where it is unset a local session (tests) gets a temporary one; on a cluster that is an error."""
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        path = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", path)
        _made.append((spark, path))
    return path.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkloom_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(df: DataFrame) -> None:
    """Remove a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_sparkloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone
            pass


def parts(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session; the cluster sets it in proportion to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def maybe_broadcast(small: DataFrame, row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the counted rows fit ``limit``; else leave the choice to the planner.

    ``small`` should be materialised: it is counted here.
    """
    return F.broadcast(small) if small.count() * row_bytes <= limit else small


def fixed_broadcast(small: DataFrame, rows: int, row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a side whose row count is bounded by construction to ``rows``, if so many fit ``limit``; else leave the choice to the planner."""
    return F.broadcast(small) if rows * row_bytes <= limit else small


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the Python workers, once for each Spark application."""
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).parent
        path = Path(tempfile.mkdtemp(prefix="sparkloom-src-")) / "sparkloom_src.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
    return spark
