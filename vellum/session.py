"""Session helpers: the shared folder for staged tables, and staging itself."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Where the setting is absent (a local
    session, as in tests) a temporary folder of this process stands in; elsewhere that is an error."""
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="vellum-")
    return _own_folder[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as parquet into the shared folder and reads it back: later plans start from files that
    survive the loss of an executor, and a retried stage reads the same rows again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: where they don't find it by PYTHONPATH or their working
    folder, it is sent to them once, as a zip file."""
    package = Path(__file__).resolve().parent
    root = str(package.parent)
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _shipped or root in {os.path.realpath(x) for x in known if x}:
        return
    target = Path(tempfile.mkdtemp(prefix="vellum-")) / "vellum.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("vellum").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
