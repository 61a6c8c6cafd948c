"""Documents to sections and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import words


def frontmatter(df: DataFrame, text: str = "text") -> DataFrame:
    """``head`` (the YAML between the first two --- lines, or null) and ``body``."""
    head = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)
    has = F.col(text).rlike(r"(?s)\A---\r?\n.*?\r?\n---(?:\r?\n|\z)")
    return df.withColumn("head", F.when(has, head)).withColumn("body", F.when(has, F.regexp_replace(text, r"(?s)\A---\r?\n.*?\r?\n---(?:\r?\n|\z)", "")).otherwise(F.col(text)))


#: How the top folders and the areas are named in a chunk's breadcrumb. The default area has no name.
FOLDER_LABELS = {"flows": "Akış", "modules": "Modül", "usecases": "Use case kartı", "genel": "Genel", "api": "API işlemi", "ekranlar": "Ekran"}
AREA_LABELS = {"backend": None, "frontend": "Frontend", "mac-motoru": "Maç motoru"}
#: The one section of a use-case card that is embedded, and what stands for an empty heading path.
CARD_SECTION, NO_HEADING, ALIASES, GAP = "Ne yapar", "giriş", "Eş anlamlılar: ", " › "


def plain_head(head: str) -> object:
    """What simple heads say, where PyYAML is not installed: ``key: value`` lines, [a, b] lists and - item lists; a ValueError for others."""
    import json
    import re

    def value(text: str) -> object:
        text = text.strip()
        if text[:1] in "[{" and text[:1]:
            if not (text.startswith("[") and text.endswith("]")):
                raise ValueError(f"not understood: {text[:40]}")
            return [value(x) for x in text[1:-1].split(",") if x.strip()]
        if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
            return text[1:-1]
        if text in ("", "~", "null"):
            return None
        if text in ("true", "false") or re.fullmatch(r"-?\d+(\.\d+)?", text):
            return json.loads(text)
        return text

    found: dict[str, object] = {}
    items, last = [], None
    for line in head.split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if m := re.fullmatch(r"\s*-\s+(.*)", line):
            items.append(value(m[1]))
            if last is not None:
                found[last] = items
            continue
        m = re.fullmatch(r"([^\s:][^:]*):(?:\s+(.*))?", line)
        if not m:
            raise ValueError(f"not understood: {line[:40]}")
        last, items = m[1].strip(), []
        found[last] = value(m[2] or "")
    return found or items or None


def _safe_load(yaml, head: str) -> object:
    """PyYAML's ``safe_load``, by its C parser where it has one; what that refuses is left to the plain one."""
    if fast := getattr(yaml, "CSafeLoader", None):
        try:
            return yaml.load(head, Loader=fast)  # noqa: S506
        except yaml.YAMLError:
            pass
    return yaml.safe_load(head)


def front_json(heads: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """YAML heads as JSON objects; what is no YAML or no mapping gives an error text instead. By PyYAML where the workers have it, else by ``plain_head``."""
    import json

    try:
        import yaml
    except ImportError:
        load, wrong = plain_head, ValueError
    else:
        load, wrong = lambda head: _safe_load(yaml, head), yaml.YAMLError

    def one(head: str | None) -> tuple[str, str | None]:
        try:
            meta = load(head) if head else {}
        except wrong as e:
            return "{}", f"frontmatter: {str(e).splitlines()[0]}"
        if meta is None:
            return "{}", None
        if not isinstance(meta, dict):
            return "{}", "frontmatter: not a mapping"
        return json.dumps(meta, ensure_ascii=False, default=str), None

    for s in heads:
        yield pd.DataFrame([one(h) for h in s], columns=["meta", "error"])


def parsed(df: DataFrame, mode: str = "permissive", text: str = "text") -> DataFrame:
    """``df`` with ``meta`` (JSON), ``body`` and ``_error``.

    A document with a broken head keeps its whole text as body and has an empty ``meta``; with mode ``failfast`` it fails the job.
    """
    read = F.pandas_udf(front_json, "meta string, error string")
    rows = frontmatter(df, text).withColumn("_f", read("head"))
    rows = rows.withColumns({"meta": F.col("_f.meta"), "_error": F.col("_f.error"), "body": F.when(F.col("_f.error").isNull(), F.col("body")).otherwise(F.col(text))}).drop("_f", "head")
    if mode == "failfast":
        rows = rows.withColumn("meta", F.when(F.col("_error").isNotNull(), F.raise_error(F.col("_error"))).otherwise(F.col("meta")))
    return rows


def _field(name: str) -> Column:
    return F.get_json_object("meta", f"$.{name}")


def doc_columns(docs: DataFrame) -> DataFrame:
    """``docs`` (path, meta) with title, kind, aliases, module and status.

    The title is the head's, else its name, else the file's; the kind is 'usecase' below usecases, else the head's type, else the top folder.
    """
    top = F.substring_index("path", "/", 1)
    kind = F.when(top == "usecases", F.lit("usecase")).otherwise(F.coalesce(_field("type"), top))
    title = F.coalesce(_field("title"), _field("name"), T.basename(F.col("path"), ".md"))
    return docs.withColumns({"title": title, "kind": kind, "aliases": T.string_list(_field("aliases")), "module": _field("module"), "status": _field("status")})


def embed_text(piece: Column, label: str | None = None) -> Column:
    """Breadcrumb, aliases and the piece; parts that are empty are left out."""
    top = F.substring_index("path", "/", 1)
    folder = F.coalesce(F.create_map(*(F.lit(x) for kv in FOLDER_LABELS.items() for x in kv))[top], top)
    module = F.when(F.coalesce("module", F.lit("")) != "", F.concat(F.lit(" ("), F.col("module"), F.lit(")"))).otherwise("")
    place = F.concat(F.lit(f"{label} · " if label else ""), folder, module)
    crumb = F.concat_ws(GAP, place, F.nullif("title", F.lit("")), F.nullif("headings", F.lit("")))
    named = F.when(F.size("aliases") > 0, F.concat(F.lit(ALIASES), F.array_join("aliases", ", ")))
    return F.concat_ws("\n", crumb, named, piece)


def build_chunks(docs: DataFrame, label: str | None = None, most: int = T.MAX_PIECE) -> DataFrame:
    """(id, hash, path, kind, title, module, status, aliases, headings, part, text, embed_text) of documents (path, meta, body).

    The id is the path, the heading path and, where a section is split, the number of the piece. The text is the piece where a section
    is split, else the section as it is written. Of a use-case card, only the section that says what it does counts, in its written part.
    """
    rows = doc_columns(docs).withColumn("body", F.when(F.substring_index("path", "/", 1) == "usecases", F.btrim(T.manual_part(F.col("body")), F.lit(" \n\t\r"))).otherwise(F.col("body")))
    cut = sections(rows, carry=("kind", "title", "module", "status", "aliases")).where((F.col("kind") != "usecase") | (F.col("h2") == CARD_SECTION))
    own = cut.withColumns({"headings": F.concat_ws(GAP, F.nullif("h2", F.lit("")), F.nullif("h3", F.lit(""))), "plain": T.strip_blocks(F.col("text"))})
    plain = F.col("plain")
    pieces = F.when(F.length(plain) <= most, F.array(plain)).otherwise(F.transform(T.pack(plain, most, tables=True), lambda x: F.btrim(x, F.lit(" \n\t\r"))))
    split = own.withColumn("pieces", pieces).withColumn("n", F.size("pieces")).select("*", F.posexplode("pieces").alias("part", "piece")).where("piece <> ''")
    ident = F.concat("path", F.lit("#"), F.coalesce(F.nullif("headings", F.lit("")), F.lit(NO_HEADING)), F.when(F.col("n") > 1, F.concat(F.lit("#"), (F.col("part") + 1).cast("string"))).otherwise(""))
    made = split.withColumns({"id": ident, "embed_text": embed_text(F.col("piece"), label), "shown": F.when(F.col("n") > 1, F.col("piece")).otherwise(F.col("text"))})
    return made.select("id", T.sha(F.col("embed_text")).alias("hash"), "path", "kind", "title", "module", "status", "aliases", "headings", F.col("part").cast("int").alias("part"), F.col("shown").alias("text"), "embed_text")


#: Fixed value: what is white space behind a heading's #.
_SPACES = " \t\n\x0b\f\r"


def cut_sections(body: str) -> list[tuple[int, str, str, str]]:
    """(section, h2, h3, text) of one text, as in ``sections``."""
    found, held, fenced, section, h2, h3 = [], [], False, 0, "", ""

    def close() -> None:
        if text := "\n".join(held).strip(" \n\t\r"):
            found.append((section, h2, h3, text))
        held.clear()

    for line in body.split("\n"):
        if line.startswith("```"):
            fenced = not fenced
        rest = line.lstrip("#") if line.startswith("#") and not fenced else ""
        level = len(line) - len(rest)
        if not rest or rest[0] not in _SPACES or level > 3:
            held.append(line)
            continue
        close()
        section, title = section + 1, rest.lstrip(_SPACES).strip(" ")
        h2, h3 = ("", "") if level == 1 else (title, "") if level == 2 else (h2, title)
    close()
    return found


def sections(df: DataFrame, key: str = "path", body: str = "body", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, section, h2, h3, text): a heading of one to three # opens a section, not inside a fence; sections without text are dropped.

    Each row is cut by itself where it stands, and its ``carry`` columns go with every section.
    """
    own = df.select(key, *carry, body)
    schema = ", ".join([*(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in (key, *carry)), "section long, h2 string, h3 string, text string"])
    kinds = {"section": pa.int64(), "h2": pa.string(), "h3": pa.string(), "text": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in words.slices(batches, [body]):
            cut = [(i, *s) for i, text in enumerate(b.column(body).to_pylist()) if text is not None for s in cut_sections(text)]
            rows, *made = zip(*cut, strict=True) if cut else [()] * 5
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in (key, *carry)), *(pa.array(x, t) for x, t in zip(made, kinds.values(), strict=True))], names=[key, *carry, *kinds])

    return own.mapInArrow(run, schema).select(key, "section", "h2", "h3", "text", *carry)


def chunks(docs: DataFrame, most: int = T.MAX_PIECE, sep: str = "\n\n", pattern: str = "\n{2,}") -> DataFrame:
    """(id, hash, path, part, text, embed_text) of documents (path, title, text)."""
    pieces = docs.select("path", "title", T.pack(F.col("text"), most, sep, pattern, tables=True).alias("p")).withColumn("n", F.size("p"))
    rows = pieces.select("path", "title", "n", F.posexplode("p").alias("part", "text"))
    made = F.concat_ws("\n", "title", "text")
    chunk_id = F.concat(F.col("path"), F.lit("#giriş"), F.when(F.col("n") > 1, F.concat(F.lit("#"), (F.col("part") + 1).cast("string"))).otherwise(""))
    return rows.select(chunk_id.alias("id"), T.sha(made).alias("hash"), "path", F.col("part").cast("int").alias("part"), "text", made.alias("embed_text"))
