"""Session settings and reliable checkpoints."""
from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings every job of this library relies on. A cluster sets the same ones in its defaults file.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # wide HTML rows: small Arrow batches keep a Python worker's memory flat
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a session window's rows meet before the shuffle, so a busy key is no hot spot
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # capturing a stack trace for every column operation costs more than planning a query does
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int | str = "*", app: str = "pagewright", shuffle: int = 8, folder: str | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine; ``folder`` becomes its shared folder."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle))
               .config("spark.driver.memory", "12g")
               .config("spark.ui.enabled", "false"))
    if folder is not None:
        builder = builder.config("spark.checkpoint.dir", folder)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Folders of single-machine sessions that name none, by application.
_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a single-machine session that names none gets a temporary folder; on a cluster a missing setting is an error,
    because a folder of one machine would not survive the loss of that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="pagewright-")
        folder = _own_folders[app]
    return folder.rstrip("/")


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` on storage that outlives an executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once as a table, with the writer's ``options``, and read back: what several branches read, each only the columns it needs."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package on a cluster that has not installed it: the source tree goes along as a zip file, once a session."""
    context = spark.sparkContext
    if getattr(context, "_pagewright_shipped", False):
        return
    root = Path(__file__).resolve().parent
    zipped = Path(tempfile.mkdtemp()) / "pagewright_workers.zip"
    with zipfile.ZipFile(zipped, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(Path("pagewright") / file.relative_to(root)))
    context.addPyFile(str(zipped))
    context._pagewright_shipped = True
