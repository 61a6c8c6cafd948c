"""Which documents a set of changed files affects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T

#: Rules are broadcast up to this number; beyond it, the join is left to Spark.
FEW_RULES = 10_000

#: Files that cannot change what is documented.
IRRELEVANT = r"(\.(spec|test)\.ts$)|(_test\.go$)|((?i)\.(png|jpe?g|gif|svg|ico|md)$)|(^test/)|(/test/)|(/__tests__/)|((^|/)(package-lock\.json|pnpm-lock\.yaml|yarn\.lock|npm-shrinkwrap\.json|go\.sum)$)|(^(\.gitlab-ci\.yml|\.circleci/|\.husky/|\.travis\.yml|azure-pipelines\.yml|bitbucket-pipelines\.yml))"


def relevant(changes: DataFrame) -> DataFrame:
    """Changes (status, path, old_path) of which one side at least is relevant."""
    dull = lambda c: F.col(c).rlike(IRRELEVANT)
    return changes.where(~(dull("path") & (F.col("old_path").isNull() | dull("old_path"))))


def sides(changes: DataFrame) -> DataFrame:
    return changes.select("status", F.explode(F.array_compact(F.array("path", "old_path"))).alias("path")).distinct()


def by_source(changes: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, reason, ord): documents that name a changed file, on either side of a rename, as a source."""
    named = docs.select(F.col("path").alias("doc"), F.explode("sources").alias("path"))
    return named.join(sides(changes), "path").select("doc", F.concat(F.lit("source changed: "), "path").alias("reason"), F.lit(0).alias("ord"))


def by_rule(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc, reason, ord) of rules (pattern, doc) that match a changed path."""
    few = rules.limit(FEW_RULES + 1).count() <= FEW_RULES
    hit = sides(changes).join(F.broadcast(rules) if few else rules, F.expr("path rlike pattern"))
    return hit.select("doc", F.concat(F.lit("rule: "), "pattern").alias("reason"), F.lit(1).alias("ord"))


def by_folder(changes: DataFrame, docs: DataFrame) -> DataFrame:
    """Added files that no document names: documents with a source in the same folder."""
    named = docs.select(F.col("path").alias("doc"), F.explode("sources").alias("src"))
    fresh = changes.where("status = 'A'").select("path").join(named.select(F.col("src").alias("path")), "path", "left_anti")
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    return fresh.withColumn("folder", folder("path")).join(named.select("doc", folder("src").alias("folder")).distinct(), "folder").select("doc", F.concat(F.lit("new in folder: "), "path").alias("reason"), F.lit(2).alias("ord"))


def by_name(names: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents whose words hold one of ``names`` (name): words are cut once and joined, not matched one by one."""
    words = docs.select(F.col("path").alias("doc"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(\w+)"), F.lit(1)))).alias("name"))
    return words.join(names.select("name").distinct(), "name").select("doc", F.concat(F.lit("name: "), "name").alias("reason"), F.lit(3).alias("ord"))


def collect(parts: list[DataFrame], docs: DataFrame) -> DataFrame:
    """(doc, reasons): distinct reasons of existing documents, in the order of the parts."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.join(docs.select(F.col("path").alias("doc")).distinct(), "doc", "left_semi")
    first = rows.groupBy("doc", "reason").agg(F.min("ord").alias("ord"))
    return first.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "reason"))), lambda x: x["reason"]).alias("reasons"))


def _reason(parts: DataFrame, doc: Column | str, *text: Column | str, ord: int) -> DataFrame:
    words = [F.lit(t) if isinstance(t, str) else t for t in text]
    return parts.select((F.col(doc) if isinstance(doc, str) else doc).alias("doc"), F.concat(*words).alias("reason"), F.lit(ord).alias("ord"))


def _moved() -> Column:
    """How a changed file is told: both names of a rename, else its status and name."""
    return F.when(F.col("status") == "R", F.concat(F.lit("moved: "), "old_path", F.lit(" → "), "changed")).otherwise(F.concat_ws(" ", "status", "path"))


def touched(changes: DataFrame) -> DataFrame:
    """(status, changed, old_path, path): each side of each change."""
    return changes.select("status", F.col("path").alias("changed"), "old_path", F.explode(F.array_compact(F.array("path", "old_path"))).alias("path")).distinct()


def by_endpoint(changes: DataFrame, docs: DataFrame) -> DataFrame:
    """A changed resolver or controller: its module's document and the flows of the module. ``docs``: (path, module)."""
    ends = touched(changes).where(F.col("path").rlike(r"\.(resolver|controller)\.ts$")).withColumn("module", T.module_of(F.col("path"))).where("module is not null").select("path", "module").distinct()
    own = ends.withColumn("doc", F.concat(F.lit("modules/"), "module", F.lit(".md")))
    flows = ends.join(docs.where("path like 'flows/%'").select(F.col("path").alias("doc"), "module"), "module")
    return _reason(own.select("doc", "path").unionByName(flows.select("doc", "path")), "doc", "endpoint changed: ", F.col("path"), ord=3)


def by_usecase(changes: DataFrame) -> DataFrame:
    """Cards of changed use-case files, with ``fresh`` for those that don't exist yet: removed, new, or made anew."""
    files = touched(changes).where(T.is_usecase(F.col("path")))
    gone = (F.col("status") == "D") | F.col("path").eqNullSafe(F.col("old_path"))
    fresh = ~gone & F.col("status").isin("A", "R")
    why = F.when(gone, "use case removed: mark it as removed").when(fresh, "new card: fill in what it does").otherwise("card made anew: check what it does")
    return files.select(T.card_path(F.col("path")).alias("doc"), why.alias("reason"), F.lit(4).alias("ord"), fresh.alias("fresh"))


def modules(changes: DataFrame, existing: DataFrame, docs: DataFrame) -> DataFrame:
    """(module, state) of touched modules: new (in the code, no document), removed (a document, no code) or known.

    ``existing``: (module) in the code; ``docs``: (path).
    """
    seen = touched(changes).select(T.module_of(F.col("path")).alias("module")).where("module is not null").distinct()
    written = docs.where(F.col("path").rlike(r"^modules/[^/]+\.md$")).select(T.basename(F.col("path"), ".md").alias("module"), F.lit(True).alias("told")).distinct()
    rows = seen.join(existing.select("module", F.lit(True).alias("there")).distinct(), "module", "left").join(written, "module", "left")
    state = F.when(F.col("there") & F.col("told").isNull(), "new").when(F.col("there").isNull() & F.col("told"), "removed").otherwise("known")
    return rows.select("module", state.alias("state"))


def card_modules(changes: DataFrame, existing: DataFrame) -> DataFrame:
    """(module) whose cards are to be made anew: those in the code of which a use-case file changed."""
    files = touched(changes).where(T.is_usecase(F.col("path"))).select(T.module_of(F.col("path")).alias("module")).distinct()
    return files.join(existing.select("module"), "module", "left_semi")


def by_list(generated: DataFrame, docs: DataFrame, column: str) -> DataFrame:
    """Documents that list a changed generated document (path) in ``column``."""
    named = docs.select(F.col("path").alias("doc"), F.explode(column).alias("path"))
    return _reason(named.join(generated.select("path"), "path"), "doc", "uses what changed: ", F.col("path"), ord=5)


def by_named_source(changes: DataFrame, docs: DataFrame, columns: tuple[str, ...] = ("sources",)) -> DataFrame:
    """Documents that name either side of a change in one of their list columns."""
    lists = F.flatten(F.array(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns)))
    named = docs.select(F.col("path").alias("doc"), F.explode(F.array_distinct(lists)).alias("path"))
    return _reason(named.join(touched(changes), "path"), "doc", "sources: ", _moved(), ord=0)


#: Rules of each corpus: pattern of changed paths, and the overview document that they concern. Fixed values.
RULES = {
    "server": (
        (r"\.schema\.ts$(?<!^src/bootstrap/config/env\.schema\.ts)", "genel/veri-haritasi.md"),
        (r"^(src/bootstrap/config/env\.schema\.ts|\.env\.example)$", "genel/altyapi.md"),
        (r"^k8s/.*\.ya?ml$|^\.github/workflows/", "genel/altyapi.md"),
        (r"^k8s/.*\.ya?ml$|^\.github/workflows/", "genel/operasyon/cron-isleri.md"),
        (r"^package\.json$|^scripts/", "genel/operasyon/elle-calistirilan-scriptler.md"),
        (r"(?i:webhook)|/infra/.*(adapter|client)[^/]*\.ts$", "genel/dis-sistemler.md"),
        (r"^src/(common|bootstrap)/", "genel/altyapi.md"),
    ),
    "app": (
        (r"^src/(lib/remoteConfig|atoms/updateNudgeAtoms|lib/pveMatchFlag)\.ts$", "genel/uzak-ayarlar.md"),
        (r"^src/lib/analytics/", "genel/analitik.md"),
        (r"^src/lib/apollo/|^(app/_layout\.tsx|app\.config\.js|eas\.json|package\.json|metro\.config\.js)$", "genel/mimari.md"),
    ),
    "engine": (
        (r"^analysis/[^/]+\.py$", "genel/veri-ve-modeller.md"),
        (r"^(k8s|terraform)/|^Dockerfile|^\.github/workflows/", "genel/altyapi.md"),
        (r"^internal/(ai/attr|ai/styles|lineup/attr_bridge)\.go$", "genel/metriklerin-etkisi.md"),
        (r"^(main\.go|go\.mod)$", "genel/mimari.md"),
    ),
}
#: Of each corpus: list columns that name sources, kinds of files that are worth a document, the column that lists generated documents, and their folders.
PROFILES = {
    "server": (("sources",), None, None, ()),
    "app": (("sources",), r"\.tsx?$", "api", ("api/", "ekranlar/")),
    "engine": (("sources", "models"), r"\.(go|json)$", "metrics", ("metrikler/",)),
}
#: Generated tables of the engine's corpus and the documents that explain them. Fixed values.
TABLES = (
    ("genel/metrik-haritasi.md", "genel/metriklerin-etkisi.md"),
    ("genel/oyun-stilleri.md", "genel/metriklerin-etkisi.md"),
    ("genel/oyun-stilleri.md", "flows/statlar/oyun-stilleri.md"),
)


def by_category(changes: DataFrame, profile: str) -> DataFrame:
    """Overview documents that the profile's rules name for a changed path (the new side)."""
    rules = changes.sparkSession.createDataFrame(RULES[profile], "pattern string, doc string")
    hit = changes.select("path", "status").distinct().join(F.broadcast(rules), F.expr("path rlike pattern"))  # a dozen rules
    if profile == "engine":
        models = changes.where(F.col("path").rlike(r"^analysis/out/[^/]+\.json$") & (F.col("status") != "M")).select("path", "status", F.lit("genel/veri-ve-modeller.md").alias("doc"))
        hit = hit.select("path", "status", "doc").unionByName(models)
    if profile == "server" and "content" in changes.columns:
        told = lambda p, doc: changes.where(F.col("content").rlike(p)).select("path", "status", F.lit(doc).alias("doc"))
        inside = told(r"@Controller\(\s*['\"`]/?(internal|webhooks?)\b", "genel/dis-sistemler.md")
        hit = hit.select("path", "status", "doc").unionByName(told(r"@Schema\(", "genel/veri-haritasi.md")).unionByName(inside)
    return _reason(hit, "doc", "category: ", F.col("path"), ord=1)


def by_new_file(changes: DataFrame, docs: DataFrame, columns: tuple[str, ...], kinds: str) -> DataFrame:
    """Added files of the given kinds that no document names: documents with a source in the same folder."""
    lists = F.flatten(F.array(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns)))
    named = docs.select(F.col("path").alias("doc"), F.explode(F.array_distinct(lists)).alias("path"))
    fresh = changes.where((F.col("status") == "A") & F.col("path").rlike(kinds)).select("path").distinct().join(named, "path", "left_anti")
    folders = named.select("doc", T.dirname(F.col("path")).alias("folder")).distinct()
    return _reason(fresh.withColumn("folder", T.dirname(F.col("path"))).join(folders, "folder"), "doc", "new file in a known folder: ", F.col("path"), ord=2)


def compute(changes: DataFrame, docs: DataFrame, profile: str = "server", generated: DataFrame | None = None, existing: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """(doc, reasons): what a set of changes (status, path, old_path) may affect in a corpus.

    ``docs``: (path, sources, module, ...); ``generated``: (path, fresh) generated documents that changed; ``existing``: (module) in the code;
    ``names``: (name) that changed constants files export. Only known documents are told, and generated ones that are new.
    """
    columns, kinds, listed, folders = PROFILES[profile]
    authors = docs if profile == "server" else docs.where(F.col("path").rlike("^(flows|genel)/"))
    parts = [by_named_source(changes, authors, columns), by_category(changes, profile)]
    fresh = docs.sparkSession.createDataFrame([], "path string")
    if kinds:
        parts.append(by_new_file(changes, authors, columns, kinds))
    if profile == "server":
        cards = by_usecase(changes)
        fresh = cards.where("fresh").select(F.col("doc").alias("path"))
        parts += [by_endpoint(changes, docs), cards.drop("fresh")]
        if existing is not None:
            states = modules(changes, existing, docs)
            parts.append(_reason(states.where("state = 'removed'"), F.concat(F.lit("modules/"), "module", F.lit(".md")), "module removed from the code", ord=6))
            # one row: the names of new modules
            new = states.where("state = 'new'").agg(F.array_join(F.array_sort(F.collect_set("module")), ", ").alias("all")).where("all <> ''")
            parts.append(_reason(new, F.lit("genel/genel-bakis.md"), "new modules: ", F.col("all"), ord=7))
        if names is not None:
            parts.append(by_name(names, docs.withColumn("body", F.when(F.col("path").startswith("usecases/"), T.manual_part(F.col("body"))).otherwise(F.col("body")))))
    if generated is not None and listed:
        own = generated.where(F.col("path").rlike("^(" + "|".join(folders) + ")"))
        fresh = fresh.unionByName(own.where("fresh").select("path"))
        parts += [_reason(own, "path", F.when(F.col("fresh"), "new card: fill in its paragraph").otherwise("card made anew: check its paragraph"), ord=4), by_list(own, docs, listed)]
        if profile == "engine":
            tables = docs.sparkSession.createDataFrame(TABLES, "path string, doc string")
            parts.append(_reason(generated.select("path").join(F.broadcast(tables), "path"), "doc", "generated table changed: ", F.col("path"), ord=6))
    return collect(parts, docs.select("path").unionByName(fresh))


def plan_groups(impact: DataFrame, most: int = 40) -> DataFrame:
    """(doc, group): documents packed in order into groups of at most ``most``; a part of the corpus is not split, 'genel' stands alone and last.

    A list that fits goes as one group, whatever it holds.
    """
    keyed = impact.select("doc", T.group_key(F.col("doc")).alias("k"))
    sizes = keyed.groupBy("k").agg(F.count("*").alias("n"), F.min("doc").alias("first"))
    # one row for each part of the corpus, a few hundred; the fold goes over this list
    listed = sizes.agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct((F.col("k") == "genel").alias("last"), "first", "k", F.col("n").cast("int").alias("n")))).alias("ks"))
    start = F.struct(F.lit(0).alias("g"), F.lit(0).alias("held"), F.array().cast("array<struct<k:string,g:int>>").alias("out"))

    def add(s, x):
        opens = (s["held"] > 0) & (x["last"] | (s["held"] + x["n"] > most))
        g = s["g"] + F.when(opens, 1).otherwise(0)
        return F.struct(g.alias("g"), F.when(opens, x["n"]).otherwise(s["held"] + x["n"]).alias("held"), F.array_append(s["out"], F.struct(x["k"].alias("k"), g.alias("g"))).alias("out"))

    placed = listed.select("all", F.explode(F.aggregate("ks", start, add)["out"]).alias("x")).select("x.k", F.when(F.col("all") <= most, 0).otherwise(F.col("x.g")).alias("g"))
    return keyed.join(placed, "k").select("doc", F.col("g").alias("group"))
