"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str = "annolake", cores: str = "*", partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(partitions))
               .config("spark.driver.memory", memory)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if cores != "*":
        builder = builder.config("spark.annolake.input.pieces", cores)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by ``spark.checkpoint.dir``.

    A machine-local folder is made only where the setting is missing, which is
    the case in local tests and never on a cluster; one for all calls.
    """
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        folder = _local_folder = _local_folder or tempfile.mkdtemp(prefix="annolake-")
    return folder.rstrip("/")


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-side list as a table whose size the optimizer knows.

    Rows that come as an Arrow table are planned as a local relation, so joins
    see how small it is; rows that come as a Python list are an RDD of unknown
    size, which makes Spark shuffle both sides.
    """
    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = [pa.array([list(v.items()) if isinstance(v, dict) else v for v in column], f.type)
              for column, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), fields)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under the shared folder and read again, for steps that read it several times."""
    folder = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


#: Tasks that list the folders of one level; Spark's own setting is one task a folder up to 10,000.
LISTING_TASKS = 64
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """While a table of very many folders is opened: a task lists many folders, not one."""
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(before), LISTING_TASKS)))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)
