"""Session set-up and table loading shared by every plan."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import warnings
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Tables whose parquet layout the engine knows by name.
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC time; cluster settings win where given."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=base | conf).getOrCreate()


def load(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named parquet tables; only Spark's reader touches the path."""
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers the named tables as temporary views for SQL plans."""
    for n in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master a new one of this machine."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not given:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, own, True)
        sc.setCheckpointDir("file://" + own)
        given = sc.getCheckpointDir()
    return given.rstrip("/")


_roots: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one. Hadoop removes it when the driver's JVM ends, also after a stop or a crash of Python."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        path = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
        fs, p = _file_system(spark, path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _roots[app] = path
    return _roots[app]


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, which goes when the driver ends."""
    return f"{_folder(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str = "table") -> DataFrame:
    """Cuts the lineage: df written as Parquet in the shared folder and read back, so that lost executors lose nothing."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, for functions that run there."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="millrace-code-")
        atexit.register(shutil.rmtree, folder, True)
        with zipfile.ZipFile(f"{folder}/millrace.zip", "w") as z:
            for f in (root / "millrace").rglob("*.py"):
                z.write(f, f.relative_to(root))
        sc.addPyFile(f"{folder}/millrace.zip")


def _file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path that Spark can reach."""
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path; after the session's stop it goes with the application's folder."""
    if spark.sparkContext._jsc is None:
        return
    try:
        fs, p = _file_system(spark, path)
        fs.delete(p, True)
    except Exception as e:  # noqa: BLE001  a folder left behind is no reason to lose a job
        warnings.warn(f"{path} stays until the driver ends: {e}", stacklevel=2)
