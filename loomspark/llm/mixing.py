r"""Mixing sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern: the set of sources that a document may be counted under. ``targets``
fills the sources' targets by weight up to twice what they hold. The flow routes words from patterns to sources: the
first use of a word is free and the second costs one, so words are repeated only where a target can't be met otherwise.
For each pattern the flow says how many words it gives. Documents are then chosen in the order of a seeded hash: all of a
pattern's documents at once for each full pass, and for the rest the documents up to a cut. The cut is found by summing
buckets of hash values, and again inside the bucket that holds it, so no group of a source's size is ever sorted.

What reaches the driver is one row for each pattern and source (metadata of the mix, not documents), and the flow is solved there: fit for up to
some hundred thousand patterns. A pattern's bucket sums, 4,096 at most, meet in one task. The document that passes the cut is taken if that
is at least as near to what is wanted as leaving it; documents of one hash are taken together.

Defined results: null texts have size 0 and are taken 0 times; a null source is a source of its own, ordered last; an empty table
gives an empty mix; repeated rows are told apart by nothing and are taken or left together. Other columns are carried.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.llm.common import materialize, n_words, small

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
HASH_BITS = 60
LEVELS = (48, 36)  # hash bits that are cut off at each narrowing


def targets(sizes: dict, weights: dict, total: float) -> dict:
    """``total`` shared by weight, none above ``MOST`` times its size; the excess goes to the others by weight."""
    out, rest = {}, total
    open_ = sorted((s for s in sizes), key=lambda s: MOST * sizes[s] / weights[s])
    mass = sum(weights.values())
    for i, s in enumerate(open_):
        if MOST * sizes[s] / weights[s] <= rest / mass:
            out[s] = float(MOST * sizes[s])
            rest -= out[s]
            mass -= weights[s]
        else:
            out |= {x: rest / mass * weights[x] for x in open_[i:]}
            break
    return out


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int]) -> list[dict[int, int]]:
    """Words that pattern ``i`` gives to each of its sources, by successive shortest paths.

    Pattern ``i`` gives ``capacity[i]`` words at cost 0 and as many again at cost 1; source ``j`` takes ``quota[j]``.
    """
    n, m = len(capacity), len(quota)
    start, end = n + m, n + m + 1
    to: list[int] = []
    left: list[int] = []
    cost: list[int] = []
    at: dict[int, list[int]] = defaultdict(list)

    def edge(a: int, b: int, cap: int, price: int) -> None:
        for x, y, c, p in ((a, b, cap, price), (b, a, 0, -price)):
            at[x].append(len(to))
            to.append(y)
            left.append(c)
            cost.append(p)

    first = {}
    for i, c in enumerate(capacity):
        for price in range(MOST):
            edge(start, i, c, price)
    for i, own in enumerate(members):
        for j in own:
            first[i, j] = len(to)
            edge(i, n + j, MOST * capacity[i], 0)
    for j, q in enumerate(quota):
        edge(n + j, end, q, 0)
    height = [0] * (n + m + 2)
    while True:
        dist, via, heap = {start: 0}, {}, [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in at[x]:
                if left[e] > 0 and d + cost[e] + height[x] - height[to[e]] < dist.get(to[e], 1 << 60):
                    dist[to[e]] = d + cost[e] + height[x] - height[to[e]]
                    via[to[e]] = e
                    heapq.heappush(heap, (dist[to[e]], to[e]))
        if end not in dist:
            break
        far = max(dist.values())
        height = [h + dist.get(x, far) for x, h in enumerate(height)]
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(left[e] for e in path)
        for e in path:
            left[e] -= push
            left[e ^ 1] += push
    out: list[dict[int, int]] = [{} for _ in capacity]
    for (i, j), e in first.items():
        if left[e ^ 1]:
            out[i][j] = left[e ^ 1]
    return out


def cuts(sized: DataFrame, wanted: DataFrame, patterns: int) -> DataFrame:
    """(pattern, cut): documents of the pattern with a hash up to ``cut`` hold about ``want`` words, as near as whole documents allow.

    Each step sums the words by bucket of the hash, and only the bucket in which the sum passes ``want`` is cut further.
    """
    from pyspark.sql import Window

    now, state = sized.join(small(wanted, patterns), "pattern"), []
    for bits in (*LEVELS, 0):
        key = F.shiftright("h", bits)
        sums = now.groupBy("pattern", "want", key.alias("bucket")).agg(F.sum("size").alias("words"))
        run = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket")))
        if bits:
            passed = materialize(run.where("upto >= want").groupBy("pattern").agg(F.min_by(F.struct("bucket", (F.col("want") - F.col("upto") + F.col("words")).alias("want")), "bucket").alias("x")))
            step = passed.select("pattern", F.col("x.bucket").alias("bucket"), F.col("x.want").alias("rest"))
            now = now.withColumn("bucket", key).join(small(step, patterns), ["pattern", "bucket"]).select("pattern", "h", "size", F.col("rest").alias("want"))
        else:
            # the last bucket's documents one by one: the cut is before or after the one that passes, whichever is nearer
            near = run.withColumn("off", F.least(F.abs(F.col("want") - F.col("upto")), F.lit((1 << 62)))).where("upto - words < want")
            best = near.groupBy("pattern").agg(F.max_by(F.struct("bucket", "words", "upto", "want"), "bucket").alias("x"))
            state.append(best.select("pattern", F.when(F.expr("x.want - (x.upto - x.words) < abs(x.upto - x.want)"), F.col("x.bucket") - 1).otherwise(F.col("x.bucket")).alias("cut")))
    return state[0]


def mix(docs: DataFrame, sources: str = "sources", weights=WEIGHTS, share: float = SHARE, seed: int = 0, keep_text: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, an array of the sources it belongs to) with size, source_size, target and taken.

    With ``keep_text`` the rows are those of ``docs``, with their texts; they are not moved, as the plan is one row for each pattern.

    Source size and target are those of the document's first source; sources come in code-point order, null last, and
    weigh ``weights`` in turn.
    """
    spark = docs.sparkSession
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 15), 16, 10).cast("long")
    carried = [c for c in docs.columns if c not in ("text", "size", "h", "pattern", "target", "taken", "source_size")]
    worked = [n_words(F.col("text")).alias("size"), key.alias("h"), F.to_json(F.struct(F.col(sources).alias("s")), {"ignoreNullFields": "false"}).alias("pattern")]
    sized = materialize(docs.select(*carried, *worked))
    rows = sized.groupBy("pattern").agg(F.first(sources).alias("s"), F.sum("size").alias("words")).orderBy("pattern").collect()
    members = [[*dict.fromkeys(r.s)] for r in rows]
    names = sorted({s for m in members for s in m}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    size = dict.fromkeys(names, 0)
    for r, m in zip(rows, members, strict=True):
        for s in m:
            size[s] += r.words
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    target = targets(size, weight, share * sum(r.words for r in rows)) if names else {}
    flow = min_cost_flow([r.words for r in rows], [[place[s] for s in m] for m in members], [round(target[s]) for s in names])
    given = [sum(f.values()) for f in flow]
    plan = [(r.pattern, g // r.words if r.words else 0, g % r.words if r.words else 0, size[m[0]], target[m[0]]) for r, g, m in zip(rows, given, members, strict=True)]
    schema = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("passes", T.LongType()), T.StructField("want", T.LongType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    told = spark.createDataFrame(plan, schema)
    cut = cuts(sized.select("pattern", "h", "size"), told.where("want > 0").select("pattern", "want"), len(plan))
    told = told.join(small(cut, len(plan)), "pattern", "left").drop("want")
    taken = F.col("size") * (F.col("passes") + F.when(F.col("h") <= F.col("cut"), 1).otherwise(0))
    # one row for each pattern: the plan has been on the driver already
    if keep_text:
        sized, carried = docs.select(*carried, "text", *worked), [*carried, "text"]
    return sized.join(small(told, len(plan)), "pattern", "left").select(*carried, "size", "source_size", "target", taken.cast("long").alias("taken"))
