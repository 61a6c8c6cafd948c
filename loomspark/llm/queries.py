"""Queries over the test tables, one for each operator of this subpackage, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import ann, bpe, divergence, htmltree, langid, licenses, linededup, mixing, packing, quality, simhash, suffixes, vectorcodes
from loomspark.llm.common import table

_SPACES = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)))
    prototypes = langid.fit(docs, ~F.col("held_out"))
    return langid.predict(docs, prototypes, ["doc_id", "held_out"])


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array("source").alias("sources"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         CAST('0x' || substr(md5('0:' || doc_id), 1, 15) AS BIGINT) AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::DOUBLE AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, 1.5 * sum(source_size) OVER () AS total, sum(w) OVER () AS mass,
         coalesce(sum(2 * source_size) OVER before, 0) AS caps, coalesce(sum(w) OVER before, 0) AS closed
  FROM sources WINDOW before AS (ORDER BY 2 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (total - caps) / (mass - closed) AS level FROM ordered
), level AS (
  SELECT arg_min(level, 2 * source_size / w) FILTER (2 * source_size / w > level) AS level FROM levels
), targets AS (
  SELECT source, source_size, least(2 * source_size, coalesce(level.level * w, 2 * source_size)) AS target FROM levels, level
), want AS (
  SELECT *, CAST(round_even(target, 0) AS BIGINT) AS quota FROM targets
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN quota // source_size::BIGINT ELSE 0 END AS passes, CASE WHEN source_size > 0 THEN quota % source_size::BIGINT ELSE 0 END AS rest FROM want
), running AS (
  SELECT s.doc_id, s.size, s.h, p.source_size, p.target, p.passes, p.rest, p.source,
         sum(s.size) OVER (PARTITION BY p.source ORDER BY s.h) AS upto
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
), passing AS (
  SELECT source, min(upto) AS upto FROM running WHERE upto >= rest AND rest > 0 GROUP BY source
), cut AS (
  SELECT r.source, max(r.h) AS h, any_value(r.upto) AS upto, sum(r.size) AS size, any_value(r.rest) AS rest
  FROM running r JOIN passing p ON r.source IS NOT DISTINCT FROM p.source AND r.upto = p.upto AND r.size > 0 GROUP BY r.source
)
SELECT r.doc_id, r.size, CAST(r.source_size AS BIGINT) AS source_size, r.target,
       CAST(r.size * (r.passes + CASE WHEN r.h <= CASE WHEN c.rest - (c.upto - c.size) < abs(c.upto - c.rest) THEN c.h - 1 ELSE c.h END THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM running r LEFT JOIN cut c ON r.source IS NOT DISTINCT FROM c.source
"""


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: the digits of an id are its directories, so 1234 stands in 1/2/3, and 123 is that directory's licence file."""
    path = F.array_join(F.split(F.when(F.col("doc_id") >= 0, F.col("doc_id").cast("string")), ""), "/")
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")
    scanned = licenses.scan(files)
    directories = scanned.select(F.col("path").alias("directory"), F.col("own_license").alias("license"), F.col("own_score").alias("score"))
    return licenses.inherit(scanned, directories).withColumnRenamed("file_id", "doc_id")


_TEMPLATES = ", ".join(f"({i}, '{name}', {len(line.split())}, '{line}')" for i, (name, line) in enumerate(licenses.templates()))
_OPENINGS = ", ".join(f"'{o}'" for o in licenses.openings())
OP4_SQL = f"""
WITH files AS (
  SELECT doc_id, array_to_string(string_split(doc_id::VARCHAR, ''), '/') AS path, text FROM documents
), worded AS (
  SELECT doc_id, regexp_extract_all(lower(text), '{licenses.WORD}', 1) AS w FROM files
), begun AS (
  SELECT doc_id, w[i:] AS w FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM worded) WHERE w[i] || ' ' || w[i + 1] IN ({_OPENINGS})
), lines AS (
  SELECT doc_id, size, array_to_string(list_slice(w, 1, size), ' ') AS line FROM begun, (VALUES {", ".join(f"({n})" for n in licenses.lengths())}) AS sizes(size)
), distinct_lines AS (
  SELECT size, line, count(*) AS n FROM lines GROUP BY size, line
), templates(t, license, size, line) AS (VALUES {_TEMPLATES}
), term AS (
  SELECT size, line, n, term, count(*) AS tf FROM (SELECT size, line, n, unnest(string_split(line, ' ')) AS term FROM distinct_lines) GROUP BY ALL
), template_term AS (
  SELECT t, license, size, term, count(*) AS tf FROM (SELECT t, license, size, unnest(string_split(line, ' ')) AS term FROM templates) GROUP BY ALL
), df AS (
  SELECT term, sum(n) AS df FROM (SELECT term, n FROM term UNION ALL SELECT term, 1 FROM template_term) GROUP BY term
), idf AS (
  SELECT term, ln((1 + (SELECT coalesce(sum(n), 0) FROM distinct_lines) + {len(licenses.templates())}) / (1 + df)) + 1 AS idf FROM df
), w AS (
  SELECT size, line, term, tf * idf AS w FROM term JOIN idf USING (term)
), tw AS (
  SELECT t, license, size, term, tf * idf AS tw FROM template_term JOIN idf USING (term)
), cosine AS (
  SELECT size, line, license, round(sum(w * tw) / (any_value(norm) * any_value(tnorm)), 6) AS score
  FROM w JOIN tw USING (size, term) JOIN (SELECT size, line, sqrt(sum(w * w)) AS norm FROM w GROUP BY size, line) USING (size, line)
  JOIN (SELECT t, sqrt(sum(tw * tw)) AS tnorm FROM tw GROUP BY t) USING (t) GROUP BY size, line, t, license
), best AS (
  SELECT size, line, license, score FROM cosine WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY size, line ORDER BY score DESC, license) = 1
), own AS (
  SELECT doc_id, license, score FROM lines JOIN best USING (size, line) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, size DESC, license) = 1
), scanned AS (
  SELECT f.doc_id, f.path, own.license AS own_license, own.score AS own_score FROM files f LEFT JOIN own USING (doc_id)
), near AS (
  SELECT a.doc_id, arg_max(b.own_license, length(b.path)) AS found, arg_max(b.path, length(b.path)) AS directory
  FROM scanned a JOIN scanned b ON a.own_license IS NULL AND b.own_license IS NOT NULL AND starts_with(a.path, b.path || '/') GROUP BY a.doc_id
)
SELECT doc_id, path, own_license, own_score, coalesce(own_license, found) AS license, CASE WHEN own_license IS NULL THEN directory END AS inherited_from
FROM scanned LEFT JOIN near USING (doc_id)
"""


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltree.html_main_text(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), hot AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, hot.key IS NOT NULL AND k.doc_id <> hot.last_doc AS gone FROM keyed k LEFT JOIN hot ON k.key = hot.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup(table(spark, sf_dir, "documents"))


def op11_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.encode(table(spark, sf_dir, "embeddings"))


def _op12_sql(rounds: int = 4) -> str:
    """The rounds one after the other: assignment by all distances, then means."""
    assign = """assigned{r} AS (
  SELECT row, vec_id, label, part, any_value(x) AS x, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
    SELECT p.*, b.entry, list_sum(list_transform(list_zip(p.x, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts p JOIN books{r} b USING (part)) GROUP BY row, vec_id, label, part
)"""
    means = """sums{r} AS (
  SELECT part, entry, pos, sum(v)::BIGINT AS s, count(*) AS n
  FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM assigned{r}) GROUP BY ALL
), books{next} AS (
  SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM books{r} b LEFT JOIN (
    SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS e FROM sums{r} GROUP BY part, entry) m USING (part, entry)
)"""
    steps = [assign.format(r=r) + (", " + means.format(r=r, next=r + 1) if r < rounds else "") for r in range(rounds + 1)]
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT row, vec_id, label, part, x[part * len(x) // 4 + 1 : (part + 1) * len(x) // 4] AS x FROM kept, range(4) AS r(part)
), books0 AS (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS e FROM parts QUALIFY entry < 256
), {", ".join(steps)}, coded AS (
  SELECT row, vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM assigned{rounds} GROUP BY row, vec_id, label
), hashed AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, hashed
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH read AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM read
), counted AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM words GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n) AS n FROM counted GROUP BY ALL HAVING sum(docs) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS size FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM read
), full_counts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)
), sized AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source) AS size FROM full_counts
), p AS (
  SELECT s.lang, s.source, s.term, s.n, 1 + (1000000000::HUGEINT * (s.n + 5)) // (s.size + 5 * l.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (l.size + 5 * l.v)::HUGEINT AS q
  FROM sized s JOIN langs l USING (lang) JOIN kept k USING (lang, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), told AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM told)
WHERE part = 'pair' OR rank <= 50
"""


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2_SQL, "op4_license_scan": OP4_SQL, "op6_line_dedup": OP6_SQL, "op12_vector_codes": _op12_sql(), "op13_source_divergence": OP13_SQL}
