"""Results written out: payloads, texts, snapshots and upserts over plain tables."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.scalar import result_file_name, safe_segment
from veilspan.operators import scan
from veilspan.operators.report import latest
from veilspan.operators.spans import label, selected


def payload(spans: Column, selection: Column, index_format: Column) -> Column:
    """array<struct<id, kind, value, start, end, selected, replacement>> of all spans in stored order."""
    chosen = F.transform(selected(spans, selection), lambda s: s["match_id"])
    return F.transform(
        scan.ranked(spans, chosen),
        lambda s: F.struct(
            s["match_id"].alias("id"), s["kind"].alias("kind"), s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end"),
            (s["rank"] > 0).alias("selected"),
            F.when(s["rank"] > 0, label(s["kind"], s["rank"], index_format)).alias("replacement"),
        ),
    )


def write_results(results: DataFrame, folder: str) -> None:
    """One JSON file per result at ``tab_id/<time of completion>.json`` below a shared folder.

    ``results`` has tab_id, completed_at and payload columns. Rows whose tab id may not stand
    in a path, or without a time, are left out.
    """
    rest = [c for c in results.columns if c != "tab_id"]
    rows = results.where(safe_segment(F.col("tab_id")) & F.col("completed_at").isNotNull())
    named = rows.select(F.concat("tab_id", F.lit("/"), result_file_name(F.col("completed_at"))).alias("name"), F.to_json(F.struct("tab_id", *rest)).alias("text"))
    write_texts(named, folder, "name", "text")


def write_sidecars(reports: DataFrame, folder: str, name: str) -> None:
    """The verification report of each exported file beside it: ``<name>.verification.json``."""
    rest = [c for c in reports.columns if c != name]
    write_texts(reports.select(F.concat(F.col(name), F.lit(".verification.json")).alias("name"), F.to_json(F.struct(*rest)).alias("text")), folder, "name", "text")


def write_texts(df: DataFrame, folder: str, name: str, text: str) -> None:
    """One UTF-8 file per row in a folder all machines share, named by the row: a file name, or one below folders of safe names."""
    def put(rows) -> None:
        for r in rows:
            _write_file(folder, r[0], r[1].encode() if isinstance(r[1], str) else bytes(r[1]))

    df.where(F.col(text).isNotNull()).select(name, text).foreachPartition(put)


def _write_file(folder: str, name: str, data: bytes) -> None:
    *above, last = (name or "").split("/")
    if not last or re.search(r"[\\/]", last) or last in (".", "..") or not all(re.fullmatch("[A-Za-z0-9_-]+", a) for a in above):
        raise ValueError(f"not a bare file name: {name!r}")
    place = os.path.join(folder, *above)
    os.makedirs(place, exist_ok=True)
    part = os.path.join(place, f".{uuid.uuid4().hex}")
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, os.path.join(place, last))


def write_binary(df: DataFrame, folder: str, name: str, encoded: str) -> None:
    """The same for Base64 columns."""
    write_texts(df.withColumn(encoded, F.unbase64(encoded)), folder, name, encoded)


def snapshot(new: DataFrame, key: str, version: str) -> DataFrame:
    """The stored state after a save of all documents: the new rows, the last of each key; others are gone."""
    return latest(new, key, version)


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Old rows whose key is not saved anew, and the new rows: insert or replace."""
    fresh = latest(new, key, version)
    return old.join(fresh.select(key), key, "left_anti").select(*old.columns).unionByName(fresh)


def merge_delta(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, action): what a save does to each key - insert, update, keep or delete."""
    a = old.select(key).distinct().withColumn("_old", F.lit(True))
    b = new.select(key).distinct().withColumn("_new", F.lit(True))
    return a.join(b, key, "full").select(key, F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("update").alias("action"))


def deleted(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows but those of the given keys."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def write_table(df: DataFrame, path: str) -> None:
    """Replace a stored table by a result that may have been read from it.

    Written beside; then the old table is moved aside, the new one takes its place and the old
    one goes. If the second move fails the old one comes back; at no time is there neither.
    """
    spark = df.sparkSession
    tag = uuid.uuid4().hex
    beside, aside = f"{path.rstrip('/')}-{tag}", f"{path.rstrip('/')}-{tag}-old"
    df.write.parquet(beside)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = fs.exists(place(path))
    if there and not fs.rename(place(path), place(aside)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(place(beside), place(path)):
        if there:
            fs.rename(place(aside), place(path))
        raise OSError(f"cannot write {path}")
    if there:
        fs.delete(place(aside), True)


def write_rules(spark: SparkSession, rules: list, path: str) -> None:
    """The rule list as it is, the empty list included; that the table exists tells it was saved once."""
    rows = [(r.id, r.name, r.mode, r.pattern, i) for i, r in enumerate(rules)]
    write_table(spark.createDataFrame(rows, "id string, name string, mode string, pattern string, updated_at long").coalesce(1), path)


def seed_if_empty(spark: SparkSession, path: str, seed: DataFrame) -> bool:
    """Write the seed rows where no table was ever saved; tell whether it was done."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return False
    seed.write.parquet(path)
    return True


def file_count(spark: SparkSession, folder: str) -> int:
    """Files below a folder; 0 where there is none."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(place).getFileCount()) if fs.exists(place) else 0


def clear_folder(spark: SparkSession, folder: str) -> int:
    """Remove a folder of results; the number of files removed."""
    n = file_count(spark, folder)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return n
