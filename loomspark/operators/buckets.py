"""Keyed tables in hash buckets: a change rewrites the buckets that it touches and nothing else.

A folder holds any number of tables, each with a key. A table's rows are dealt by hash of the key into ``BUCKETS`` buckets; a bucket is one immutable folder, and
the manifest says which folder is a bucket's present one. ``change`` reads the buckets of changed keys, writes them anew, and commits a manifest that
names the new folders beside the old ones of all other buckets. Readers see one version or the next, all tables together; a writer that was
overtaken is refused with ``LostRace`` and has changed nothing. ``vacuum`` deletes what no kept version names.

Null keys are rows like others, and equal only to null. Of several new rows with one key all stay, as they came.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources import manifest
from loomspark.sources.scratch import written

BUCKETS = 64


@dataclass
class Change:
    """New rows of a table, each in place of the row of its key, and keys whose rows go."""

    key: str
    rows: DataFrame
    gone: DataFrame | None = None
    replace: bool = False


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def table(spark: SparkSession, path: str, name: str, version: int | None = None, schema: str | None = None) -> DataFrame:
    """The rows of a table, of the newest version or the one asked for. A table that was never written is empty, with ``schema``."""
    _, content = manifest.read(spark, path, version)
    return _read(spark, path, content, name, schema)


def _read(spark: SparkSession, path: str, content: dict, name: str, schema: str | None, only: set[int] | None = None) -> DataFrame:
    known = content.get("tables", {}).get(name)
    schema = known["schema"] if known else schema
    if schema is None:
        raise KeyError(f"{path} has no table {name}")
    folders = [f"{path}/{name}/{at}" for b, at in known["buckets"].items() if only is None or int(b) in only] if known else []
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def change(spark: SparkSession, path: str, changes: dict[str, Change], note: dict | None = None, version: int | None = None, buckets: int = BUCKETS) -> int:
    """Commits changes of tables, and ``note`` beside them, as the version after ``version`` (the newest); returns it."""
    if version is None:
        version, content = manifest.read(spark, path)
    else:
        _, content = manifest.read(spark, path, version)
    buckets = content.get("buckets", buckets)
    tables = dict(content.get("tables", {}))
    for name, c in changes.items():
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in c.rows.schema)
        known = tables.get(name, {"buckets": {}})
        rows = written(c.rows.withColumn("_b", _bucket(c.key, buckets)))
        keys = rows.select(c.key, "_b")
        if c.gone is not None:
            keys = keys.unionByName(c.gone.select(c.key).withColumn("_b", _bucket(c.key, buckets)))
        # at most BUCKETS numbers come to the driver
        touched = {r[0] for r in keys.select("_b").distinct().collect()}
        kept = {} if c.replace else {b: at for b, at in known["buckets"].items() if int(b) not in touched}
        new = rows
        if not c.replace and any(int(b) in touched for b in known["buckets"]):
            old = _read(spark, path, content, name, schema, touched)
            mine = keys.select(F.col(c.key).alias("_k")).distinct()
            old = old.join(mine, F.col(c.key).eqNullSafe(F.col("_k")), "left_anti").withColumn("_b", _bucket(c.key, buckets))
            new = old.unionByName(rows)
        if touched:
            folder = uuid.uuid4().hex
            new.repartition(len(touched), "_b").write.partitionBy("_b").parquet(f"{path}/{name}/{folder}")
            made = {n.removeprefix("_b="): f"{folder}/{n}" for n in manifest.children(spark, f"{path}/{name}/{folder}") if n.startswith("_b=")}
            kept = kept | made
        tables[name] = {"schema": schema, "key": c.key, "buckets": kept}
    manifest.commit(spark, path, version + 1, content | {"buckets": buckets, "tables": tables, "note": (note or {})})
    return version + 1


def note(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What was noted with a version: {} if there is none."""
    return manifest.read(spark, path, version)[1].get("note", {})


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes the manifests but the newest ``keep``, and folders that those don't name; returns how many folders. Not while a writer is at work."""
    found = manifest.versions(spark, path)
    for v in found[:-keep]:
        manifest.delete(spark, f"{path}/manifest/{v:012d}.json")
    named: dict[str, set[str]] = {}
    for v in found[-keep:]:
        for name, t in manifest.read(spark, path, v)[1].get("tables", {}).items():
            named.setdefault(name, set()).update(t["buckets"].values())
    gone = 0
    for name, live in named.items():
        for folder in manifest.children(spark, f"{path}/{name}"):
            for part in manifest.children(spark, f"{path}/{name}/{folder}"):
                if part.startswith("_b=") and f"{folder}/{part}" not in live:
                    gone += manifest.delete(spark, f"{path}/{name}/{folder}/{part}")
            if not any(at.startswith(f"{folder}/") for at in live):
                manifest.delete(spark, f"{path}/{name}/{folder}")
    return gone
