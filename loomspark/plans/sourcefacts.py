"""Facts of source files, over files that are made from the documents: a function, a call chain, routes and constants in each, by its number and length."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import facts
from loomspark.plans import relations as R
from loomspark.plans.registry import query


def go_files(spark, d):
    """(path, content): each document's number names a function that calls that of the number without its last digit, and a constant of its length."""
    n, up = F.col("doc_id").cast("string"), F.floor(F.col("doc_id") / 10).cast("string")
    lines = [
        F.lit("package p"),
        F.concat(F.lit("// of "), "source"),
        F.concat(F.lit("func F"), n, F.lit("(x int) int {")),
        F.concat(F.lit("\tif ok(x) { return F"), up, F.lit("(x) + F"), up, F.lit("(1) }")),
        F.lit("\treturn 0"),
        F.lit("}"),
        F.concat(F.lit("const Size"), n, F.lit(" = "), F.col("n_chars").cast("string"), F.lit(" // characters")),
    ]
    return R.table(spark, d, "documents").select(F.concat(F.lit("p/"), n, F.lit(".go")).alias("path"), F.concat_ws("\n", *lines).alias("content"))


def ts_files(spark, d):
    """(path, content): each document is a controller below its source with two methods; its language is an exported name and a target of navigation."""
    n = F.col("doc_id").cast("string")
    lines = [
        F.concat(F.lit("@Controller('/"), F.coalesce("source", F.lit("none")), F.lit("/')")),
        F.lit("export class Shop {"),
        F.concat(F.lit(" @Get('items/"), n, F.lit("') a() {}")),
        F.lit(" @Post({ path: '/buy/' }) b() {}"),
        F.lit("}"),
        F.concat(F.lit("export const lang_"), F.coalesce("lang", F.lit("none")), F.lit(" = 1; router.push('/"), F.coalesce("lang", F.lit("none")), F.lit("/home'); track('open_"), F.coalesce("lang", F.lit("none")), F.lit("')")),
    ]
    return R.table(spark, d, "documents").select(F.concat(F.lit("src/modules/"), n, F.lit("/shop.ts")).alias("path"), F.concat_ws("\n", *lines).alias("content"))


@query("SELECT 'p/' || doc_id || '.go' AS path, unnest([3, 4, 5, 6]) AS line, 'F' || doc_id AS func FROM documents")
def source_functions(spark, d):
    """The lines of each function."""
    return facts.functions(facts.source_lines(go_files(spark, d))).where("func is not null").select("path", "line", "func")


@query("SELECT 'p/' || doc_id || '.go' AS path, 4 AS line, 'F' || doc_id AS func, unnest(['ok', 'F' || doc_id // 10]) AS callee FROM documents")
def source_calls(spark, d):
    """Who calls whom, and in which line."""
    return facts.call_sites(facts.source_lines(go_files(spark, d))).select("path", "line", "func", "callee")


@query("SELECT 'p/' || doc_id || '.go' AS path, 'Size' || doc_id AS name, n_chars::DOUBLE AS value FROM documents")
def source_constants(spark, d):
    return facts.constants(facts.source_lines(go_files(spark, d)))


_SOURCE = "coalesce(source, 'none')"


@query(f"SELECT 'src/modules/' || doc_id || '/shop.ts' AS path, unnest(['GET', 'POST']) AS method, unnest(['/' || {_SOURCE} || '/items/' || doc_id, '/' || {_SOURCE} || '/buy']) AS route FROM documents")
def source_routes(spark, d):
    """Controllers' and methods' paths joined."""
    return facts.routes(ts_files(spark, d))


_LANG = "coalesce(lang, 'none')"


@query(f"SELECT 'src/modules/' || doc_id || '/shop.ts' AS path, '/' || {_LANG} || '/home' AS target, 'open_' || {_LANG} AS event, doc_id::VARCHAR AS module, 'Shop' AS first, 'lang_' || {_LANG} AS second FROM documents")
def source_navigation(spark, d):
    """Targets, events, modules and exported names of each file."""
    files = ts_files(spark, d)
    names = files.select("path", T.module_of(F.col("path")).alias("module"), T.exported_names(F.col("content")).alias("e"))
    found = facts.navigation(files).join(names, "path")
    return found.select("path", F.col("targets")[0].alias("target"), F.col("events")[0].alias("event"), "module", F.col("e")[0].alias("first"), F.col("e")[1].alias("second"))
