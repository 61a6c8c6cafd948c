"""Graph operators over edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.sources.scratch import written


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes reachable from ``seeds`` (node), seeds included. Each round joins the frontier and is written, so lineage stays short."""
    return _walk(edges, seeds.select("node"), ["node"])


def _walk(edges: DataFrame, seeds: DataFrame, key: list[str], together: int = 8) -> DataFrame:
    """Rounds of frontier joins. The edges are written once, and so is each new frontier; every few rounds what has been seen is put together in one table."""
    edges = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    seen = written(seeds.distinct())
    front, rounds = seen, 0
    while front.take(1):
        nxt = front.join(edges, front.node == edges.src).select(*key[:-1], F.col("dst").alias("node")).distinct()
        front = written(nxt.join(seen, key, "left_anti"))
        seen, rounds = seen.unionByName(front), rounds + 1
        if rounds % together == 0:
            seen = written(seen)
    return seen


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()


def pairs_reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): what each root reaches, itself included."""
    return _walk(edges, roots.select(F.col("node").alias("root"), "node"), ["root", "node"])


def roots_reaching(edges: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): the roots (node, layout) that reach each node; layouts only where nothing else does.

    The walk starts at the nodes and goes against the edges, so it costs what lies above them.
    """
    back = pairs_reachable(reverse(edges), nodes).select(F.col("root").alias("node"), F.col("node").alias("root"))
    found = back.join(roots.select(F.col("node").alias("root"), "layout"), "root")
    best = found.groupBy("node").agg(F.min("layout").alias("layout"))
    return found.join(best, ["node", "layout"]).select("node", "root")


def closure(edges: DataFrame, root: DataFrame, stops: DataFrame) -> DataFrame:
    """What a root reaches without entering other roots (``stops``)."""
    open_ = edges.join(stops.select(F.col("node").alias("dst")), "dst", "left_anti")
    return reachable(open_, root)


def usage_class(subjects: DataFrame, users: DataFrame, reached: DataFrame) -> DataFrame:
    """(subject, class): active if a reached node uses it, unreachable if only others do, unused if none."""
    marked = users.join(reached.select(F.col("node").alias("user"), F.lit(1).alias("hit")), "user", "left").groupBy("subject").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    out = subjects.join(marked, "subject", "left")
    return out.select("subject", F.when(F.col("hit") == 1, "active").when(F.col("hit") == 0, "unreachable").otherwise("unused").alias("class"))


def unreached(files: DataFrame, reached: DataFrame) -> DataFrame:
    """(folder, n) of files that are not reached; files: (node, folder)."""
    return files.join(reached, "node", "left_anti").groupBy("folder").agg(F.count("*").alias("n"))


def attribute_rollup(pairs: DataFrame, attrs: DataFrame) -> DataFrame:
    """(root, attrs): sorted distinct attributes over what each root reaches."""
    return pairs.join(attrs, "node").groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("attr")), ",").alias("attrs"))


def _passed_on(names: DataFrame, reexports: DataFrame, exports: DataFrame) -> DataFrame:
    """``names`` (file, name) with the (to_file, to_name) that re-exports hand each on to; a name that its file exports itself is not handed on."""
    open_ = names.join(exports.select("file", "name").distinct(), ["file", "name"], "left_anti").unionByName(names.where("name = '*'")).distinct()
    r = reexports.select("file", F.col("name").alias("as_name"), F.col("target").alias("to_file"), "source")
    taken = (F.col("name") == "*") | (F.col("as_name") == F.col("name")) | (F.col("as_name") == "*")
    kept = F.when((F.col("name") != "*") & (F.col("as_name") == "*") & (F.col("as_name") != F.col("name")), F.col("name")).otherwise(F.col("source"))
    return open_.join(r, "file").where(taken).select("file", "name", "to_file", kept.alias("to_name"))


def reachable_by_name(imports: DataFrame, reexports: DataFrame, exports: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): files that ``seeds`` (node) reach by imports, where a re-exporting file passes on only the names taken from it.

    ``imports``: (src, dst, name); ``reexports``: (file, name, target, source), ``*`` passing all; ``exports``: (file, name).
    Names that anyone takes are followed first, by rounds; then files and names are one graph that is walked once.
    """
    taken = written(imports.select(F.col("dst").alias("file"), "name").distinct())
    front, links = taken, None
    while front.take(1):
        step = written(_passed_on(front, reexports, exports).distinct())
        links = step if links is None else links.unionByName(step)
        front = written(step.select(F.col("to_file").alias("file"), F.col("to_name").alias("name")).distinct().join(taken, ["file", "name"], "left_anti"))
        taken = taken.unionByName(front)

    file = lambda c: F.struct(F.col(c).alias("file"), F.lit(None).cast("string").alias("name"))
    pair = lambda f, n: F.struct(F.col(f).alias("file"), F.col(n).alias("name"))
    key = lambda s: F.to_json(s)
    edges = imports.select(key(file("src")).alias("src"), key(file("dst")).alias("dst")).unionByName(imports.select(key(file("src")).alias("src"), key(pair("dst", "name")).alias("dst")))
    gives = taken.where("name = '*'").unionByName(taken.join(exports.select("file", "name").distinct(), ["file", "name"], "left_semi"))
    edges = edges.unionByName(gives.select(key(pair("file", "name")).alias("src"), key(file("file")).alias("dst")))
    if links is not None:
        edges = edges.unionByName(links.select(key(pair("file", "name")).alias("src"), key(pair("to_file", "to_name")).alias("dst")))
    found = reachable(written(edges.distinct()), seeds.select(key(file("node")).alias("node")))
    at = F.from_json("node", "file string, name string")
    return found.select(at.alias("at")).where("at.name is null").select(F.col("at.file").alias("node"))


def origin(reexports: DataFrame, defs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, name, at_file, at_name): where a wanted (file, name) is defined (``defs``: file, name), along re-exports (file, nth, name, target, source).

    Of several, the first in the order in which re-exports stand (``nth``), each followed to its end before the next.
    Names without a definition have no row. Rounds keep each pair's first way and go on while one gets better.
    """
    start = ["file", "name", "at_file", "at_name"]
    now = written(wanted.select("file", "name", F.col("file").alias("at_file"), F.col("name").alias("at_name"), F.array().cast("array<int>").alias("way")).distinct())
    known = defs.select(F.col("file").alias("at_file"), F.col("name").alias("at_name")).distinct()
    r = reexports.select(F.col("file").alias("at_file"), F.col("nth").cast("int").alias("nth"), F.col("name").alias("as_name"), "target", "source")
    front = now
    while front.take(1):
        steps = front.join(known, ["at_file", "at_name"], "left_anti").join(r, "at_file").where("as_name = at_name or as_name = '*'")
        to_name = F.when(F.col("as_name") == "*", F.col("at_name")).otherwise(F.col("source"))
        best = steps.select("file", "name", F.col("target").alias("at_file"), to_name.alias("at_name"), F.array_append("way", F.col("nth")).alias("way")).groupBy(*start).agg(F.min("way").alias("way"))
        better = best.join(now.withColumnRenamed("way", "old"), start, "left").where("old is null or way < old").select(*start, "way")
        front = written(better)
        now = written(now.join(front, start, "left_anti").unionByName(front))
    found = now.join(known, ["at_file", "at_name"]).groupBy("file", "name").agg(F.min_by(F.struct("at_file", "at_name"), "way").alias("at"))
    return found.select("file", "name", "at.at_file", "at.at_name")


def users_of(reads: DataFrame, calls: DataFrame, excluded: DataFrame) -> DataFrame:
    """(field, func, via): functions that use a field, directly (``via`` empty) or through the listed callees; excluded functions neither use nor pass on."""
    live = lambda df, c: df.join(excluded.select(F.col("func").alias(c)), c, "left_anti")
    direct = live(reads, "func").select("field", "func").distinct()
    own = live(live(calls, "func"), "callee")
    through = own.join(fields_of(live(reads, "func"), own, excluded).withColumnRenamed("func", "callee"), "callee").join(direct, ["field", "func"], "left_anti")
    listed = through.groupBy("field", "func").agg(F.array_sort(F.collect_set("callee")).alias("via"))
    return direct.select("field", "func", F.array().cast("array<string>").alias("via")).unionByName(listed)


def fields_of(reads: DataFrame, calls: DataFrame, excluded: DataFrame) -> DataFrame:
    """(func, field): fields that a function reads itself or through calls, excluded functions left out."""
    own = calls.join(excluded.select(F.col("func").alias("callee")), "callee", "left_anti").select(F.col("func").alias("src"), F.col("callee").alias("dst"))
    roots = reads.select(F.col("func").alias("node")).union(calls.select("func")).distinct()
    return pairs_reachable(own, roots).join(reads.withColumnRenamed("func", "node"), "node").select(F.col("root").alias("func"), "field").distinct()
