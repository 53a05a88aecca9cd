"""Session builder and lineage cutting through the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, tuple[SparkSession, str]] = {}
_own_dir: list[str] = []


def build_session(app: str = "folioforge", cpus: int | str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC, adaptive execution, skew handling.

    The master is the one that spark-submit, the defaults file or `spark.master` in `conf` names; `cpus` asks for a local one with so many threads,
    which is also what is taken where none is named. `partitions` sets the shuffle partitions; leave it None on a cluster that sets its own.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if cpus is not None:
        b = b.master(f"local[{cpus}]")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. Where it is unset, a local master gets a folder of its own and any other master an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="folioforge-"))
    return _own_dir[0]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _forget() -> None:
    for spark, path in _written.values():
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            pass
    if _own_dir:
        shutil.rmtree(_own_dir[0], ignore_errors=True)


atexit.register(_forget)


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lineage ends there and survives lost executors.

    The files are deleted by `dropped`, or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioforge-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._folioforge_path = path
    _written[path] = (spark, path)
    return back


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that `written` returned, once all that was made of them is written itself."""
    for t in tables:
        spark, path = _written.pop(t._folioforge_path)
        _delete(spark, path)
