r"""How far the sources of a language differ in their words.

``bytes.translate`` lowers A-Z and blanks everything below 0x80 that isn't a letter in one pass, so ``bytes.split`` gives the terms
``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` of a text, and a ``Counter`` of each document its frequencies. A task adds them up by language and source in a table of
at most ``TERMS`` terms that it hands on when full; the rest is sparse aggregation by (lang, source, term): no absent term is ever a row.

A language keeps the V terms that at least ``min_docs`` of its documents hold. In a group of N occurrences of kept terms, a term that occurs n times has
p = 1 + floor(10^9 (n + 5) / (N + 5 V)), in decimals, so exact. Two groups' distance is the sum of \|p - q\| over all kept terms: terms that neither has
add one constant as often as there are such, terms that one has are told by each group's own rows, and only terms that both have meet, once for
each pair of groups (the work grows with pairs of sources, as the result does).

Defined results: null text, lang and source are ''; a repeated row is another document; a group without terms has all its pairs (and no term); an
empty table gives an empty result; equal values go by the item's UTF-8 bytes; other columns are not read. A very long text is cut at blanks
into stretches of ``STRETCH`` bytes, so its terms are never all in memory as objects.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import materialize

MIN_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms that a task holds before it hands its counts on, and bytes of a stretch.
TERMS, STRETCH = 200_000, 1 << 20

#: Bytes to terms: A-Z lowered, a-z and 0x80 up kept, all else blank.
BLANKED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(raw: bytes) -> Counter:
    """Frequencies of a text's terms."""
    blanked, at, found = raw.translate(BLANKED), 0, Counter()
    while len(blanked) - at > STRETCH:
        cut = blanked.rfind(b" ", at, at + STRETCH)
        cut = cut if cut >= at else blanked.find(b" ", at + STRETCH)
        if cut < 0:
            break
        found.update(blanked[at:cut].split())
        at = cut + 1
    found.update(blanked[at:].split())
    return found


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n) of documents (text, lang, source); each group also has a row whose term is null."""

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (df, tf) in held.items():
                terms = [None, *df]
                many, same = len(terms), lambda v: pa.array([v], pa.string()).dictionary_encode()  # noqa: B023, E731
                repeat = lambda v: pa.DictionaryArray.from_arrays(pa.array([0] * many, pa.int32()), same(v).dictionary).cast(pa.string())  # noqa: B023, E731
                numbers = (pa.array([0, *df.values()], pa.int64()), pa.array([0, *(tf[t] for t in df)], pa.int64()))
                yield pa.RecordBatch.from_arrays([repeat(lang), repeat(source), pa.array(terms, pa.binary()).cast(pa.string()), *numbers], names=["lang", "source", "term", "docs", "n"])
            held.clear()

        size = 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").cast(pa.binary())):
                df, tf = held.setdefault((lang, source), (Counter(), Counter()))
                own, before = term_counts(text.as_py()), len(df)
                df.update(own.keys())
                tf.update(own)
                size += len(df) - before
                if size >= TERMS:
                    yield from told()
                    size = 0
        yield from told()

    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = read.mapInArrow(audit, "lang string, source string, term string, docs long, n long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's distances to the other sources of its language, and the terms it has more often than the language."""
    found = materialize(counts(docs))
    groups = found.where("term is null").select("lang", "source")
    terms = found.where("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole")).where(F.col("docs") >= min_docs).drop("docs")
    rows = materialize(terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))

    long_ = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    # of kept terms; a language or group without any has 0
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("lang_n"))
    sizes = groups.join(rows.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("held")), ["lang", "source"], "left").join(langs, "lang", "left")
    sizes = materialize(sizes.select("lang", "source", *(long_(F.col(c)).alias(c) for c in ("size", "held", "v", "lang_n"))))

    def p(n, size):
        total = size.cast("decimal(20,0)") + SMOOTHING * F.col("v").cast("decimal(18,0)")
        share = (n.cast("decimal(20,0)") + SMOOTHING).cast("decimal(21,0)") * F.lit(SCALE).cast("decimal(10,0)")
        return F.lit(1) + F.call_function("div", share, total)

    # no kept term, no share
    none = F.when(F.col("v") > 0, p(F.lit(0), F.col("size"))).otherwise(0).cast("long")
    groups = sizes.select("lang", "source", "held", "v", "size", "lang_n", none.alias("p0"))
    each = rows.join(groups, ["lang", "source"]).select("lang", "source", "term", p(F.col("n"), F.col("size")).alias("p"), p(F.col("whole"), F.col("lang_n")).alias("q"), "p0")
    each = materialize(each)

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = each.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    pairs = groups.alias("a").join(groups.alias("b"), "lang").where("a.source <> b.source")
    pairs = pairs.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), "a.v", F.col("a.held").alias("held_a"), F.col("b.held").alias("held_b"), F.col("a.p0").alias("p0"), F.col("b.p0").alias("q0"))
    # |p - q0| over a group's own terms, for each p0 of its language
    alone = each.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    alone = alone.join(pairs.select("lang", "source", "item", "q0"), ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.col("times") * F.abs(F.col("p") - F.col("q0"))).alias("alone"))
    # terms of both: what was told for each alone comes out, what they differ by comes in
    a, b = each.alias("a"), each.alias("b")
    both = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    mend = F.abs(F.col("a.p") - F.col("b.p")) - F.abs(F.col("a.p") - F.col("b.p0")) - F.abs(F.col("b.p") - F.col("a.p0"))
    both = both.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item")).agg(F.count("*").alias("shared"), F.sum(mend).alias("mend"))
    both = both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "shared", "mend"))
    on = ["lang", "source", "item"]
    mirrored = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("other"))
    told = pairs.join(alone, on, "left").join(mirrored, on, "left").join(both, on, "left")
    absent = F.col("v") - F.col("held_a") - F.col("held_b") + long_(F.col("shared"))
    value = long_(F.col("alone")) + long_(F.col("other")) + long_(F.col("mend")) + absent * F.abs(F.col("p0") - F.col("q0"))
    other = told.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(ranked))
    return other.unionByName(more).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
