r"""Near copies by word shingles: SimHash fingerprints in a trie and minwise bands find candidates, the exact Jaccard similarity decides.

A text is the set of its 64-bit shingle hashes (``SHINGLE`` words, ASCII lower case). Equal sets are one node. The set's SimHash fingerprint goes
through the trie self-join of ``simhash.group_links``; nodes of a star within its budget are candidates. Pairs at 0.8 differ in ten
bits of 64 or so, and a trie over so wide a budget visits all pairs; so wider links come from ``BANDS`` keys of ``ROWS`` minwise values each:
nodes that share a key are candidates, and a pair at a similarity of 0.8 shares none with probability (1 - 0.8^5)^24 = 7e-5. Of these
candidates, pairs whose fingerprints differ in more than ``WIDE`` bits are left out at once (at 0.8, 10 of 64 bits are expected; over 28 is
out of reach). Candidates' connected groups are met by their texts: pairs that share a key and aren't linked yet are compared exactly, so a
group of many near copies takes about as many comparisons as it has texts. A group of more than ``PART`` texts is dealt to several tasks, each of which
has the group's first text too; only groups that stay apart then are met whole, and there only components that aren't linked are compared.

Defined results: components are those of all links (pairs of a similarity of at least ``SIMILARITY``). A text of fewer words than a
shingle is one shingle, and texts without words (null also) are equal; rows with the same ``doc_id`` are one node; with ``doc_id`` null a
row is left out of linking and has a null component. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import components, join_named, map_columns, materialize, release_old
from loomspark.llm.simhash import HOT, group_links, signed

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, WIDE = 24, 5, 28
PART = 512  # texts of a group of candidates that one task meets at first
AT_ONCE = 1024  # shingles whose minwise values are taken at once
_DRAWN = np.random.default_rng(11)
_WORD, _TIMES, _KEY = (_DRAWN.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (64, BANDS * ROWS, BANDS * ROWS))


def mixed(h: np.ndarray) -> np.ndarray:
    for shift, times in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(b" ".join(words), len(words))], np.uint64)
    each = np.array([h(w, 42) for w in words], np.uint64)
    n = len(each) - shingle + 1
    sums = np.zeros(n, np.uint64)
    for k in range(shingle):
        sums += mixed(each[k : k + n] * _WORD[k])
        sums *= _WORD[63 - k]
    return np.unique(mixed(sums))


def band_keys(values: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(values), AT_ONCE):
        # each row is another order of the values, as the product's high bits differ from one multiplier to the next
        np.minimum(least, (values[None, i : i + AT_ONCE] * _TIMES[:, None]).min(1), out=least)
    band = np.arange(BANDS, dtype=np.uint64)
    return mixed(mixed(least * _KEY).reshape(BANDS, ROWS).sum(1, dtype=np.uint64) + band * _WORD[0])


def bits(values: np.ndarray) -> int:
    """The set's SimHash: each bit that over half of the hashes have."""
    ones, n = np.zeros(64, np.int64), len(values)
    for at in range(0, n, 8192):
        ones += np.unpackbits(values[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Jaccard similarity of two sorted sets against the bound."""
    if min(len(a), len(b)) / max(len(a), len(b)) < similarity:
        return False
    both = np.concatenate([a, b])
    both.sort()
    met = int((both[1:] == both[:-1]).sum())
    return met / (len(both) - met) >= similarity


def links(sets: Iterator[tuple[int, np.ndarray, list[int], int]], similarity: float) -> list[tuple[int, int]]:
    """Links that join the nodes of a group of candidates into the components of all its links.

    ``sets``: node, its set, keys beside its bands', and the component that it is known to belong to (itself, if none is).
    """
    root: dict[int, int] = {}
    held: dict[int, dict[int, list[tuple[np.ndarray, int]]]] = {}  # key: {component: sets and fingerprints}
    out = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for node, values, more, known in sets:
        root.setdefault(known, known)
        root.setdefault(node, find(known))
        keys, tried, print_ = band_keys(values).tolist() + more, set(), bits(values)
        for key in keys:
            bucket = held.setdefault(key, {})
            for other in list(bucket):
                if find(other) == find(node):
                    continue
                for s, other_print in bucket[other]:
                    if id(s) in tried:
                        continue
                    tried.add(id(s))
                    if (print_ ^ other_print).bit_count() <= WIDE and alike(values, s, similarity):
                        out.append((other, node))
                        root[find(node)] = find(other)
                        break
        for key in keys:
            bucket = held[key]
            mine = find(node)
            own = bucket.pop(mine, [])
            for other in [x for x in bucket if find(x) == mine]:
                own += bucket.pop(other)
            bucket[mine] = [*own, (values, print_)]
    return out


def group_edges(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b): verified links in each group of ``texts`` (root, part, doc_id, text, more, known)."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.select("root", "part", "doc_id", "text", "more", "known").repartition(n, "root", "part").sortWithinPartitions("root", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_old()
        held, now = [], None

        def told() -> pa.RecordBatch:
            found = links(held, similarity)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            for root, part, node, text, more, known in zip(*(b.column(i).to_pylist() for i in range(6))):
                if (root, part) != now and held:
                    yield told()
                    held = []
                now = root, part
                held.append((node, shingles(text, shingle), more or [], known))
        if held:
            yield told()

    return dealt.mapInArrow(run, "a long, b long")


def near_components(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, digest, component_id) of each row."""

    def made(texts: list) -> list[list]:
        sets = [shingles(t, shingle) for t in texts]
        return [[xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], [signed(bits(s)) for s in sets], [band_keys(s).view(np.int64) for s in sets]]

    prints = materialize(map_columns(docs, ["doc_id"], ["text"], {"digest": "long", "fp": "long", "keys": "array<long>"}, made))
    known = prints.where("doc_id is not null")
    nodes = materialize(known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count("*").alias("n")))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key", "least")
    # the trie's stars, and nodes of equal fingerprints
    by_print = materialize(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    equal = nodes.select("fp", F.col("node").alias("a")).join(by_print.select("fp", F.col("node").alias("b")), "fp").where("a <> b").select("a", "b")
    stars = materialize(group_links(by_print).unionByName(equal))
    found = keyed.join(shared, "key").select(F.col("node").alias("a"), F.col("least").alias("b")).unionByName(stars)
    groups = materialize(components(found))
    more = stars.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("star")).groupBy("node").agg(F.collect_set("star").alias("more"))
    texts = docs.select("doc_id", "text").join(groups.join(more, "node", "left").select(F.col("node").alias("doc_id"), "root", "more"), "doc_id")
    # large groups go in parts, each with the group's first text, which links most of them; what is still apart meets in one task
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    texts = texts.join(sizes, "root").withColumn("known", F.col("doc_id"))
    all_parts = F.sequence(F.lit(0), F.col("parts") - 1)
    own = F.array(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    spread = texts.withColumn("part", F.explode(F.when(F.col("doc_id") == F.col("root"), all_parts).otherwise(own)))
    edges = materialize(group_edges(spread, shingle, similarity))
    if sizes.where("parts > 1").head(1):
        part_of = components(edges)
        placed = groups.join(sizes.where("parts > 1"), "root").join(part_of.select("node", F.col("root").alias("known")), "node", "left").withColumn("known", F.coalesce("known", "node"))
        apart = placed.groupBy("root").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).where("lo <> hi").select("root")
        again = texts.drop("known").join(apart, "root").join(placed.select(F.col("node").alias("doc_id"), "known"), "doc_id").withColumn("part", F.lit(0))
        edges = edges.unionByName(group_edges(again, shingle, similarity))
    # rows that share a doc_id but not a text tie their sets together
    twice = known.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    tied = known.join(twice, "doc_id").join(nodes.select("digest", "node"), "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    roots = components(edges.unionByName(tied))
    named = nodes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    joined = join_named(prints.select("doc_id", "digest"), named, "digest", nodes.where(F.col("n") > HOT).select("digest"), "doc_id")
    return joined.select("doc_id", "digest", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
