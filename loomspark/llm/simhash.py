r"""SimHash near-dedup: fingerprints, then a binary-trie self-join.

A text's fingerprint takes each bit that is set in over half of the XXH64 values of its word shingles. Distinct
fingerprints are cut into blocks: of 64 bits in three, one block must be equal for two fingerprints within two bits, and of
the other bits again in three, one part too; each of the nine pairs of equal parts is a group. Groups that share so many
bits stay small even where one block is common to a third of all fingerprints. In each group two nodes of the binary trie are
descended together, differing bits are added up, and a pair ends as soon as it is over the budget. A group returns
a spanning star of its links, not its pairs; the links' components follow by joins.

Defined results: texts without words (null also) have fingerprint zero and link like any other; rows with the same
``doc_id`` are one node, and if their texts differ, the node has several fingerprints and joins them; with ``doc_id`` null a row
is left out of linking and has a null component. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import components, join_named, map_columns, materialize, release_old

SHINGLE, BUDGET = 3, 2
HOT = 1024  # rows of one fingerprint from which its join is salted


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(first)
    for at in range(0, n, 8192):
        values = np.array([h(joined[a:b], 42) for a, b in zip(first[at : at + 8192], last[at : at + 8192])], ">u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 64 // 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    return map_columns(docs, ["doc_id"], ["text"], {"fp": "long"}, lambda texts: [[signed(fingerprint(t, shingle)) for t in texts]])


def trie_pairs(group: np.ndarray, fp: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within ``budget`` bits in equal groups; rows are sorted by (group, fp) and distinct.

    A trie node is a range of rows with a common prefix; all pairs of nodes of a level are split at once by the next
    bit: (0, 0) and (1, 1) cost nothing, (0, 1) and (1, 0) one bit. Pairs over the budget end there; pairs of
    single rows are counted out at once.
    """
    n = len(fp)
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    lo, hi = bounds[:-1], bounds[1:]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    a0, a1, b0, b1, used = lo, hi, lo, hi, np.zeros(len(lo), np.int8)
    left, right = [], []
    for bit in range(63, -1, -1):
        if not len(a0):
            break
        ones = np.concatenate([[0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        parts = [
            (a0, am, b0, bm, used),
            (am, a1, bm, b1, used),
            (a0, am, bm, b1, used + 1),
            (am[~same], a1[~same], b0[~same], bm[~same], used[~same] + 1),
        ]
        a0, a1, b0, b1, used = (np.concatenate([p[i] for p in parts]) for i in range(5))
        live = (used <= budget) & (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, used = a0[live], a1[live], b0[live], b1[live], used[live]
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        x, y = a0[single], b0[single]
        near = np.bitwise_count(fp[x] ^ fp[y]) <= budget
        left.append(x[near])
        right.append(y[near])
        a0, a1, b0, b1, used = a0[~single], a1[~single], b0[~single], b1[~single], used[~single]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def star(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component, from links between rows (pointer jumping)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def group_links(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b): links between ``node`` values whose ``fp`` differ in at most ``budget`` bits; a spanning star for each group."""
    if budget != 2:
        raise ValueError("blocks are laid out for a budget of two bits")
    cuts = [(0, 22), (22, 43), (43, 64)]
    keys = []
    for k, (a, b) in enumerate(cuts):
        rest = [i for i in range(64) if not a <= i < b]
        for j, part in enumerate((rest[:14], rest[14:28], rest[28:])):
            mask = sum(1 << i for i in [*range(a, b), *part])
            keys.append(F.struct(F.lit(3 * k + j).alias("block"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("part")))
    rows = nodes.select("node", "fp", F.explode(F.array(*keys)).alias("k")).select("node", "fp", F.col("k.block").alias("block"), F.col("k.part").alias("part"))
    # of groups, only those with several fingerprints can hold a link; a hash of the group deals them out
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "block", "part").sortWithinPartitions("block", "part")

    def run(batches):
        release_old()
        held = []
        for b in batches:
            pdf = b.to_pandas()
            held.append(pdf)
            # groups are contiguous; all but the last group of what is held can go
            if sum(map(len, held)) >= 200_000:
                pdf = pd.concat(held)
                tail = ((pdf.block == pdf.block.iloc[-1]) & (pdf.part == pdf.part.iloc[-1])).to_numpy()
                yield from links(pdf[~tail])
                held = [pdf[tail]]
        if held:
            yield from links(pd.concat(held))

    def links(pdf: pd.DataFrame):
        if not len(pdf):
            return
        fp = pdf.fp.to_numpy().astype(np.int64).view(np.uint64)
        key = pdf.groupby(["block", "part"], sort=False).ngroup().to_numpy()
        order = np.lexsort((fp, key))
        key, fp, node = key[order], fp[order], pdf.node.to_numpy()[order]
        x, y = trie_pairs(key, fp, budget)
        root = star(len(fp), x, y)
        own = np.flatnonzero(root != np.arange(len(fp)))
        yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id) of each row."""
    prints = materialize(fingerprints(docs, shingle))
    known = prints.where("doc_id is not null")
    nodes = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    edges = group_links(nodes, budget)
    # rows that share a doc_id but not a text tie their fingerprints together
    twice = known.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    tied = known.join(twice, "doc_id").join(nodes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    roots = components(edges.unionByName(tied))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    joined = join_named(prints, named, "fp", nodes.where(F.col("n") > HOT), "doc_id")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
