"""Guarded access: allow-lists, denied names, clamped reads, redaction."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.sources.scratch import written

FIND, FIND_MOST, AGGREGATE_MOST, ARRAY_MOST, TEXT_MOST = 20, 100, 200, 60, 60_000
SAMPLE, SAMPLE_MOST, DEPTH = 20, 50, 3


class QueryRefused(ValueError):
    """A query names something that is denied."""


@dataclass(frozen=True)
class TablePolicy:
    path: str
    description: str = ""
    columns: tuple[str, ...] | None = None
    joinable: bool | None = None


@dataclass(frozen=True)
class Policy:
    tables: dict[str, TablePolicy]
    denied: str = "password|token|secret"
    key: str = "id"
    _re: re.Pattern = field(init=False, repr=False, compare=False, default=None)

    def __post_init__(self) -> None:
        object.__setattr__(self, "_re", re.compile(self.denied, re.IGNORECASE))

    def check(self, *names: str) -> None:
        """Refuses if any segment of a dotted name is denied."""
        for name in names:
            if any(self._re.search(part) for part in name.lstrip("$").split(".")):
                raise QueryRefused(f"{name} is not readable")

    def table(self, spark: SparkSession, name: str, root: str) -> DataFrame:
        """The table without denied columns, and with allowed ones only where a list is given."""
        if name not in self.tables:
            raise QueryRefused(f"unknown table {name}")
        return self.redact(spark.read.parquet(f"{root}/{self.tables[name].path}"), name)

    def catalog(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, t.description) for k, t in sorted(self.tables.items())], "name string, description string")

    def project(self, df: DataFrame, table: str, wanted: list[str] | None = None) -> DataFrame:
        """Allowed ∩ wanted top-level columns; nothing left gives the key alone."""
        allowed = self.tables[table].columns
        names = [c for c in df.columns if (allowed is None or c in allowed) and (not wanted or c in {w.split(".")[0] for w in wanted})]
        return df.select(*(names or [self.key]))

    def visible(self, df: DataFrame) -> DataFrame:
        """``df`` without denied names at any depth; what filters, sorts, groups and joins may name."""

        def clean(col: Column, kind: T.DataType) -> Column:
            if isinstance(kind, T.StructType):
                return F.when(col.isNotNull(), F.struct(*(clean(col[f.name], f.dataType).alias(f.name) for f in kind if not self._re.search(f.name))))
            if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
                return F.transform(col, lambda x: clean(x, kind.elementType))
            return col

        kept = df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema if not self._re.search(f.name)))
        # without a name of its own, filters and sorts could still reach the columns below
        return kept.alias("visible")

    def _refused(self, made):
        """Names that are denied aren't there any more; a query that needs one is refused."""
        try:
            return made()
        except AnalysisException as e:
            raise QueryRefused(str(e).splitlines()[0]) from e

    def find(self, df: DataFrame, table: str, where: Column | None = None, wanted: list[str] | None = None, sort: list | None = None, limit: int = FIND, skip: int = 0) -> DataFrame:
        self.check(*(wanted or []))

        def made() -> DataFrame:
            rows = self.visible(df)
            rows = rows if where is None else rows.where(where)
            rows = rows.orderBy(*sort) if sort else rows
            return self.project(rows.offset(max(0, skip)).limit(min(max(1, limit), FIND_MOST)), table, wanted)

        return self._refused(made)

    def count(self, df: DataFrame, where: Column | None = None) -> DataFrame:
        """(n): rows of the table for which ``where`` holds."""
        rows = self.visible(df)
        return self._refused(lambda: (rows if where is None else rows.where(where)).agg(F.count("*").alias("n")))

    def aggregate(self, df: DataFrame, table: str, keys: list, aggs: list[Column]) -> DataFrame:
        """Allowed columns first, then the groups, 200 at most."""
        rows = self.project(self.visible(df), table)
        return self._refused(lambda: rows.groupBy(*keys).agg(*aggs).orderBy(*keys).limit(AGGREGATE_MOST))

    def sample(self, df: DataFrame, n: int = SAMPLE, seed: int | None = None) -> DataFrame:
        """``n`` random rows, 50 at most; each task hands on its own ``n``."""
        return self.visible(df).orderBy(F.rand(seed)).limit(min(max(1, n), SAMPLE_MOST))

    def _joinable(self, table: str) -> None:
        if table not in self.tables or self.tables[table].joinable is False:
            raise QueryRefused(f"{table} can't be joined")

    def union(self, left: DataFrame, right: DataFrame, table: str) -> DataFrame:
        """The rows of both; columns that one lacks are null there."""
        self._joinable(table)
        return left.unionByName(self.visible(right), allowMissingColumns=True)

    def normalize_ids(self, df: DataFrame) -> DataFrame:
        """Ids of 24 hex digits in one form, so that plain equality finds them whether they were stored as bytes or as text.

        Ids are ``_id`` and columns whose name ends in Id, at the top or in structs.
        """

        def clean(name: str, col: Column, kind: T.DataType) -> Column:
            if isinstance(kind, T.StructType):
                return F.when(col.isNotNull(), F.struct(*(clean(f.name, col[f.name], f.dataType).alias(f.name) for f in kind)))
            if name != "_id" and not name.endswith("Id"):
                return col
            if isinstance(kind, T.BinaryType):
                return F.lower(F.hex(col))
            return F.when(col.rlike("^[0-9a-fA-F]{24}$"), F.lower(col)).otherwise(col) if isinstance(kind, T.StringType) else col

        return df.select(*(clean(f.name, F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema))

    def join(self, left: DataFrame, right: DataFrame, table: str, on) -> DataFrame:
        """Refuses tables marked as not joinable; those without the mark may be joined."""
        self._joinable(table)
        return left.join(self.visible(right), on)

    def graph_lookup(
        self, left: DataFrame, right: DataFrame, table: str, start: str, connect_from: str, connect_to: str, key: str, max_depth: int | None = None, where: Column | None = None
    ) -> DataFrame:
        """Every row of ``right`` that ``left`` reaches, with its depth: (left's columns, depth, found), where ``found`` is a struct of right's visible columns.

        From ``start`` on, rows whose ``connect_to`` has the value are found, then those that have their ``connect_from`` value (or one of them, in an array), and
        so on, up to ``max_depth`` steps (0: the first rows only). A row, known by its ``key``, is found once for each start, at its least depth, so
        circles end; rows that ``where`` doesn't keep are neither found nor passed through; nulls lead nowhere. Tables that can't be joined are refused, and so are
        denied names, at whatever level: all levels see the visible columns alone.

        A level is one join of what the last one found, which is written, with the table: as many joins as levels. Starts that are asked
        more than once are walked once.
        """
        self._joinable(table)
        self.check(start, connect_from, connect_to, key)
        spark = left.sparkSession

        def made() -> DataFrame:
            rows = self.visible(right)
            rows = rows if where is None else rows.where(where)
            to = F.col(connect_from)
            if isinstance(rows.select(to.alias("c")).schema["c"].dataType, T.ArrayType):
                nexts = F.array_distinct(to)
            else:
                nexts = F.array(to)
            nodes = written(rows.select(F.col(connect_to).alias("_at"), F.col(key).alias("_key"), nexts.alias("_next"), F.struct("*").alias("found")).where("_at is not null"))
            asked = self.visible(left).select(F.col(start).alias("_start"))
            # (start, value): where to look next; (start, key, depth): what was found
            looks = written(asked.where("_start is not null").distinct().select("_start", F.col("_start").alias("_look")))
            seen, depth, levels = None, 0, []
            while (max_depth is None or depth <= max_depth) and looks.head(1):
                met = looks.join(nodes, F.col("_look") == F.col("_at")).select("_start", "_key", "_next")
                if seen is not None:
                    met = met.join(seen, ["_start", "_key"], "left_anti")
                found = written(met.dropDuplicates(["_start", "_key"]).withColumn("depth", F.lit(depth)))
                levels.append(found.select("_start", "_key", "depth"))
                seen = levels[0]
                for more in levels[1:]:
                    seen = seen.unionByName(more)
                seen = seen.select("_start", "_key")
                looks = written(found.select("_start", F.explode("_next").alias("_look")).where("_look is not null").distinct())
                depth += 1
            told = levels[0] if levels else spark.createDataFrame([], nodes.select(F.col("_at").alias("_start"), "_key", F.lit(0).alias("depth")).schema)
            for more in levels[1:]:
                told = told.unionByName(more)
            whole = told.join(nodes.select("_key", "found"), "_key").drop("_key")
            return self.visible(left).join(whole, F.col(start) == F.col("_start")).drop("_start")

        return self._refused(made)

    def redact(self, df: DataFrame, table: str | None = None) -> DataFrame:
        """Drops denied names at any depth and cuts arrays to 60, with the number cut in ``<column>_more``."""

        def clean(col: Column, kind: T.DataType) -> Column:
            if isinstance(kind, T.StructType):
                parts = []
                for f in kind:
                    if self._re.search(f.name):
                        continue
                    parts.append(clean(col[f.name], f.dataType).alias(f.name))
                    if isinstance(f.dataType, T.ArrayType):
                        parts.append(F.greatest(F.size(col[f.name]) - ARRAY_MOST, F.lit(0)).alias(f"{f.name}_more"))
                return F.when(col.isNotNull(), F.struct(*parts))
            if isinstance(kind, T.ArrayType):
                cut = F.slice(col, 1, ARRAY_MOST)
                return F.transform(cut, lambda x: clean(x, kind.elementType)) if isinstance(kind.elementType, (T.StructType, T.ArrayType)) else cut
            return col

        allowed = self.tables[table].columns if table in self.tables else None
        out = []
        for f in df.schema:
            if self._re.search(f.name) or (allowed is not None and f.name not in allowed):
                continue
            out.append(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name))
            if isinstance(f.dataType, T.ArrayType):
                out.append(F.greatest(F.size(f.name) - ARRAY_MOST, F.lit(0)).alias(f"{f.name}_more"))
        return df.select(*out)

    def fields(self, df: DataFrame, sample: int = SAMPLE, depth: int = DEPTH, seed: int | None = None) -> DataFrame:
        """(path, types): what a sample's fields hold, to a depth of three; arrays by their first element, as ``path[]``."""
        rows = self.sample(df, sample, seed)
        found: list[tuple[str, str, Column]] = []

        def walk(path: str, col: Column | None, kind: T.DataType, d: int) -> None:
            if path:
                found.append((path, "array" if isinstance(kind, T.ArrayType) else "object" if isinstance(kind, T.StructType) else kind.simpleString(), col))
            if d >= depth:
                return
            if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
                walk(f"{path}[]", F.get(col, F.lit(0)), kind.elementType, d + 1)
            elif isinstance(kind, T.StructType):
                for f in kind:
                    own = F.col(f"`{f.name}`") if col is None else col[f.name]
                    walk(f"{path}.{f.name}" if path else f.name, own, f.dataType, d + 1)

        walk("", None, rows.schema, 0)
        seen = [F.struct(F.lit(p).alias("path"), F.array_compact(F.array(F.max(F.when(c.isNotNull(), F.lit(kind))), F.max(F.when(c.isNull(), F.lit("null"))))).alias("types")) for p, kind, c in found]
        return rows.agg(F.array(*seen).alias("s")).select(F.explode("s").alias("s")).select("s.*")
