"""Session helpers: table access, durable intermediate tables, sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that identify the stored state of a saved document.
TAB_KEY = "id"
TAB_VERSION = "updated_at"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so Python stages run where it is not installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    # The driver serves this file to the executors for as long as it lives.
    folder = tempfile.mkdtemp(prefix="veilspan-")
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of the data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files give fewer tasks than there are cores.

    Only small inputs are moved: a table that fills the cores by itself stays where it is, so
    CPU-bound stages gain and large scans pay no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    Only a local session without one gets a folder of its own, which goes with the process:
    on a cluster a machine-local folder would hold parts of a table on every machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    folder = tempfile.mkdtemp(prefix="veilspan-")
    atexit.register(shutil.rmtree, folder, True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def own_folder(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder that ``clear_durable`` will remove."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(clear_durable, spark)
    _written[app].append(path)
    return path


def durable(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage and keeps an expensive step (tokenising, Python detectors) from running
    twice; the files survive the loss of any executor. ``clear_durable`` removes what a session
    wrote, at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = own_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_durable(spark: SparkSession) -> int:
    """Remove what this session wrote to the shared folder and tell how many; results that still read them end with it."""
    sc = spark.sparkContext
    paths = _written.pop(sc.applicationId, []) if sc._jsc is not None else []
    for path in paths:
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def current_tabs(tabs: DataFrame, columns: list[str]) -> DataFrame:
    """The current row of each id: highest ``updated_at``; rows equal in both are identical.

    Only ``columns`` (plus ``id``) travel through the shuffle. ``max_by`` combines on the
    map side first, so an id with very many drafts sends one row per map task. A null
    ``updated_at`` loses to any value and is used only when no other row exists; rows with
    a null id form one document of their own.
    """
    rest = [c for c in columns if c != TAB_KEY]
    version = F.coalesce(F.col(TAB_VERSION), F.lit(-(2**62)))
    return (
        tabs.groupBy(TAB_KEY)
        .agg(F.max_by(F.struct(*rest) if rest else F.struct(F.lit(None).alias("_")), version).alias("_row"))
        # Always true; keeps what follows out of the aggregate, where no Arrow function may stand.
        .where(F.col("_row").isNotNull())
        .select(TAB_KEY, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def parsed_json(column, schema: str):
    """``column`` parsed by ``schema``; null where the text as a whole is not one valid JSON value.

    The text is read as the only element of an array, so that anything after the value shows.
    """
    wrapped = F.from_json(F.concat(F.lit("["), column, F.lit("]")), f"array<{schema}>")
    return F.when((F.size(wrapped) == 1) & (F.trim(column) != ""), wrapped[0])
