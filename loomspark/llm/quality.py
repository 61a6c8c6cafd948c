r"""Quality rules: gradient-boosted trees over document statistics.

``statistics`` turns each whole text into counts; ``fit`` learns shallow boosted trees on a bounded sample of labelled
documents (``MAX_TRAIN`` rows) and flattens them into numpy node arrays; ``score`` walks all rows down all trees at
once. The features named in ``MONOTONE`` may only raise (1) or lower (-1) the verdict.

Defined results: a null text has no words and fails the base rule; an empty ``labels`` table, or one of a single class,
gives no model, and then the base rule alone decides; repeated rows are judged one by one; a document labelled more
than once counts with its lowest label. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import map_columns

#: At most about so many labelled documents are fitted on, whatever the size of the corpus.
MAX_TRAIN = 20_000
ROUNDS, DEPTH, RATE, BINS, LEAST = 40, 3, 0.25, 48, 8
SYMBOLS = b"#*$%&|<>"
FEATURES = ("log_words", "mean_word", "symbols", "dup_lines", "repeats", "letters", "capitals", "digits", "ends", "distinct", "short", "exclaims")
#: Direction in which a feature may move the score.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "exclaims": -1}
COUNTS = dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "long")


def counts(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """The five counts of a whole text and its features."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() splits at the six ASCII spaces only
    n, joined = len(words), b"".join(words)
    chars = len(text) - (len(raw) - len(joined))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 2:
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        m = len(ids)
        pair = code[:-1] * m + code[1:]
        if m < 2_000_000:
            key = pair[:-1] * m + code[2:]
        else:
            key = np.unique(pair, return_inverse=True)[1][:-1] * np.int64(m) + code[2:]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        in_window = np.zeros(n, bool)
        in_window[:-2] |= twice
        in_window[1:-1] |= twice
        in_window[2:] |= twice
        repeat, distinct = int(in_window.sum()), m
    else:
        distinct = len(set(words))
    w, c = max(n, 1), max(chars, 1)
    letters = len(joined) - len(joined.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    high = len(joined) - len(joined.translate(None, bytes(range(128, 256))))
    capitals = len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(joined) - len(joined.translate(None, b"0123456789"))
    features = [np.log1p(n), chars / w, symbols / w, dup / max(len(lines), 1), repeat / w, (letters + high) / max(len(joined), 1), capitals / c, digits / c, raw.count(b".") / w, distinct / w, sum(len(x) < 4 for x in words) / w, raw.count(b"!") / w]
    return (n, chars, symbols, dup, repeat), features


@dataclass
class Trees:
    """All trees' nodes in flat arrays; a leaf has feature -1. ``start`` holds the trees' first nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.tile(self.start, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            f = self.feature[at]
            down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(f < 0, at, down)
        return self.base + self.value[at].sum(1)


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray) -> Trees:
    """Boosted trees of the logistic loss on histograms of quantile bins.

    A split on a constrained feature is taken only where its two values are in the allowed order, and the values below
    it stay on their side of the middle.
    """
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(rate / (1 - rate)))
    out: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    margin, start = np.full(len(y), base), []

    def node(value: float) -> int:
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", 0), ("right", 0), ("value", value)):
            out[k].append(v)
        return len(out["value"]) - 1

    def grow(rows: np.ndarray, depth: int, low: float, high: float) -> int:
        g, h = grad[rows], hess[rows]
        G, H = g.sum(), h.sum()
        here = node(RATE * float(np.clip(-G / (H + 1), low, high)))
        best = (1e-6, 0, 0, 0.0, 0.0)
        if depth < DEPTH and len(rows) >= 2 * LEAST:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = bins[rows, j]
                sg, sh, sn = (np.cumsum(np.bincount(b, weights, len(c) + 1))[:-1] for weights in (g, h, np.ones(len(rows))))
                vl, vr = np.clip(-sg / (sh + 1), low, high), np.clip(-(G - sg) / (H - sh + 1), low, high)
                gain = sg**2 / (sh + 1) + (G - sg) ** 2 / (H - sh + 1) - G**2 / (H + 1)
                gain[(sn < LEAST) | (len(rows) - sn < LEAST) | (signs[j] * (vr - vl) < 0)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k, vl[k], vr[k])
        gain, j, k, vl, vr = best
        if gain <= 1e-6:
            return here
        left = bins[rows, j] <= k
        mid = (vl + vr) / 2
        bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[int(signs[j])]
        out["feature"][here], out["threshold"][here] = j, float(cuts[j][k])
        out["left"][here] = grow(rows[left], depth + 1, *bounds[0])
        out["right"][here] = grow(rows[~left], depth + 1, *bounds[1])
        return here

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        start.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        one = Trees(*(np.array(out[k]) for k in out), np.array(start[-1:]), 0.0)
        margin = margin + one.margin(x)
    return Trees(*(np.array(out[k]) for k in out), np.array(start), base)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees | None:
    """Trees for P(quality = 1), from at most about ``max_train`` labelled documents chosen by a hash of their id."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    if not n:
        return None
    if n > max_train:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_train / n))
    # the sample is bounded by max_train, and so is what is broadcast and what the driver gets
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").drop("doc_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"x": [counts(t)[1] for t in pdf.text], "quality": pdf.quality.astype(float)})

    got = rows.mapInPandas(features, "x array<double>, quality double").toPandas()
    if got.quality.nunique() < 2:
        return None
    # the order of collected rows is not fixed; sorting makes reruns agree
    data = np.array(sorted([*x, y] for x, y in zip(got.x, got.quality, strict=True)))
    return fit_trees(data[:, :-1], (data[:, -1] > 0).astype(float), np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def score(docs: DataFrame, trees: Trees | None, threshold: float = 0.5, keep_columns: bool = False) -> DataFrame:
    """Counts, ``base_failed``, ``quality_score`` and ``kept`` of each document; with ``keep_columns`` the document's five columns also."""
    carry = ["doc_id", "text", "lang", "source", "n_chars"] if keep_columns else ["doc_id"]

    def run(texts: list[str | None]) -> list[np.ndarray]:
        got = [counts(t) for t in texts]
        c = np.array([x[0] for x in got], dtype=np.int64).reshape(len(got), 5)
        failed = (c[:, 0] < 50) | (100 * c[:, 4] > 50 * c[:, 0])
        if trees is None:
            p = np.where(failed, 0.0, 1.0)
        else:
            p = 1 / (1 + np.exp(-trees.margin(np.array([x[1] for x in got]).reshape(len(got), len(FEATURES)))))
        return [*c.T, failed, p, ~failed & (p >= threshold)]

    return map_columns(docs, carry, ["text"], COUNTS | {"base_failed": "boolean", "quality_score": "double", "kept": "boolean"}, run)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, keep_columns: bool = False) -> DataFrame:
    return score(docs, fit(docs, labels), threshold, keep_columns)
