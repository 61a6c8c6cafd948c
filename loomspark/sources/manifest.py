"""Versions of a folder: one small JSON file for each, created only if it isn't there, so of two writers of one version one is refused."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class LostRace(RuntimeError):
    """Another writer has committed the version that this one wanted; read the new one and try again."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """All versions of the folder, oldest first. Its manifests are a handful of files."""
    at, fs = _fs(spark, f"{path}/manifest")
    if not fs.exists(at):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(at))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """(version, content) of the newest manifest, or of the one asked for; (0, {}) if there is none."""
    found = versions(spark, path)
    if version is None:
        version = found[-1] if found else 0
    if not version:
        return 0, {}
    at, fs = _fs(spark, f"{path}/manifest/{version:012d}.json")
    stream = fs.open(at)
    try:
        return version, json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """Makes ``content`` the given version. Raises ``LostRace`` if that version exists, or if what stands there afterwards is another writer's."""
    at, fs = _fs(spark, f"{path}/manifest/{version:012d}.json")
    writer = uuid.uuid4().hex
    try:
        stream = fs.create(at, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or fs.exists(at):
            raise LostRace(f"{path}: version {version} is there already") from e
        raise
    stream.write(bytearray(json.dumps(content | {"writer": writer}).encode()))
    stream.close()
    if read(spark, path, version)[1].get("writer") != writer:
        raise LostRace(f"{path}: version {version} was written by another")


def delete(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    at, fs = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []
