r"""Line dedup on DataFrame functions alone.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased, held as two 64-bit hashes.
All occurrences of long keys are range-partitioned by hash and salt and sorted by document and position inside; windows that run down
this order find each document's first occurrence, count the documents and name the largest. A hash met in a third of all documents is one stream for
each salt, whose last rows are combined. Hashes that enough documents hold go back to the streams under a salted join, and what comes out
is a keep bitmap per document, compressed: only its 64-bit words that drop a line are stored, with their place.
``apply_bitmaps`` cuts the lines out of the texts.

Defined results: a null or empty text is one empty line, which stays; a document without dropped lines has a null
bitmap; with ``doc_id`` null a document's lines stay and count for nothing; rows with the same ``doc_id`` and text
count as one document and get one bitmap, while rows with the same ``doc_id`` and other texts should not occur. Other
columns are not read, but for n_lines, n_dropped and kept, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import SPACES, materialize

MIN_CHARS, MIN_DOCS, SALTS = 40, 5, 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), _UPPER, _LOWER)


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h1, h2, places): where each document holds each key of at least ``min_chars`` code points."""
    lines = docs.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).where(F.col("doc_id").isNotNull() & (F.length("line") >= min_chars))
    keyed = lines.select("doc_id", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def sorted_stream(occ: DataFrame) -> DataFrame:
    """``occ`` with ``salt``, ``docs``, ``top`` and ``end``: each key's occurrences in one sorted stream for each salt.

    Ranges of (h1, h2, salt), sorted inside by document, the largest first, and position. Down the stream, a row whose document
    differs from the row before (``lag``) is that document's first occurrence; ``docs`` counts these, ``top`` is the stream's first document, and
    ``end`` marks its last row. The windows only look back and one row ahead, so nothing is buffered.
    """
    n = int(occ.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = occ.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    order = [F.desc("doc_id"), F.col("pos")]
    ranged = salted.repartitionByRange(n, "h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", *order)
    stream = Window.partitionBy("h1", "h2", "salt").orderBy(*order)
    first = ranged.withColumns({"before": F.lag("doc_id").over(stream), "end": F.lead("doc_id").over(stream).isNull(), "top": F.first("doc_id").over(stream.rowsBetween(Window.unboundedPreceding, 0))})
    new = F.when(F.col("before") == F.col("doc_id"), 0).otherwise(1)
    return first.withColumn("docs", F.sum(new).over(stream.rowsBetween(Window.unboundedPreceding, 0))).drop("before")


def common_keys(stream: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, last): keys that at least ``min_docs`` documents hold, with the largest of these documents; from the last rows of the streams."""
    ends = stream.where("end").select("h1", "h2", "docs", "top")
    return ends.groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.max("top").alias("last")).where(F.col("n") >= min_docs).drop("n")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_dropped, keep): the keep bitmap of each document that loses lines, compressed to the words that are not all ones.

    ``keep`` is an array of (word, bits) in order; line ``i`` stays if bit ``i % 64`` of word ``i div 64`` is set, or the word is left out.
    """
    stream = materialize(sorted_stream(materialize(occurrences(docs, min_chars))))
    hot = common_keys(stream, min_docs).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    gone = stream.select("h1", "h2", "salt", "doc_id", "pos").join(hot, ["h1", "h2", "salt"]).where("doc_id <> last")
    words = gone.groupBy("doc_id", F.expr("pos div 64").cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(F.expr("shiftleft(1L, pos % 64)"))).alias("bits"))
    return words.groupBy("doc_id").agg(
        F.sum(64 - F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("keep"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and the ``kept`` text."""
    joined = docs.join(bitmaps.select("doc_id", F.col("n_dropped").alias("_dropped"), F.col("keep").alias("_keep")), "doc_id", "left")
    spread = F.expr("flatten(transform(_keep, (w, i) -> concat(array_repeat(-1L, w.word - if(i = 0, 0, _keep[i - 1].word + 1)), array(w.bits))))")
    joined = joined.withColumn("_lines", lines_of(F.col("text"))).withColumn("_bits", spread)
    kept = F.expr("if(_keep is null, coalesce(text, ''), array_join(filter(_lines, (x, i) -> coalesce(getbit(get(_bits, cast(i div 64 as int)), i % 64), 1) = 1), '\\n'))")
    carried = [F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    return joined.select(*carried, F.size("_lines").cast("long").alias("n_lines"), F.coalesce("_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
