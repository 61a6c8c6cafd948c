"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is the product of its letters' vectors, permuted (rolled) by
place; a document is the weighted sum of its trigrams' vectors, and a language the sum of its documents' directions.
A document gets the language whose prototype has the largest cosine with it; that cosine is the score (never below 0).

``fit`` takes at most about ``MAX_PER_LANG`` documents of each language, chosen by a hash of their id: its cost and the
prototypes do not grow with the corpus. Their sums are made on the executors; the driver gets one vector for each
language and partition group.

Defined results: ``und`` with score 0 for a text that is null, empty or without letters, and for all texts if nothing
could be learned; equal cosines go to the language that comes first by code point. Long texts are read whole, in
pieces. Repeated rows are classified one by one; columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import map_columns

DIM, CODES, SEED = 1024, 64, 11
#: At most about so many documents of a language are learned from.
MAX_PER_LANG = 3_000
PIECE = 1 << 20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Code of each code point (0: no letter; a-z own codes, other letters by a hash), and letter vectors by place."""
    codes = np.zeros(0x110000, np.uint8)
    for cp in (*range(0x10000), *range(0x10000, 0x32400)):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            codes[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (CODES - 27)
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], np.int8), (CODES, DIM))
    return codes, tuple(np.roll(letters, k, axis=1) for k in (2, 1, 0))


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes of a text and their counts; runs of other characters are one boundary.

    Each piece begins with the last two codes of the one before, so a text has the same trigrams however it is cut.
    """
    table, total, tail = _tables()[0], np.zeros(CODES**3 if len(text) > PIECE else 0, np.int64), np.zeros(1, np.int32)
    for i in range(0, len(text), PIECE):
        piece = text[i : i + PIECE]
        c = table[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int32)
        c = np.concatenate([tail, c, np.zeros(int(i + PIECE >= len(text)), np.int32)])
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
        t = c[:-2] << 12 | c[1:-1] << 6 | c[2:]
        t = t[c[1:-1] != 0]  # the middle is a letter: one trigram for each letter
        if not len(total):
            return np.unique(t, return_counts=True)
        total += np.bincount(t, minlength=CODES**3)
        tail = c[-2:]
    codes = np.flatnonzero(total)
    return codes, total[codes]


def profile(text: str | None) -> np.ndarray | None:
    """Direction (unit length) of a document's vector; None without letters."""
    codes, counts = trigrams(text or "")
    if not len(codes):
        return None
    first, second, third = _tables()[1]
    weight, out = np.log1p(counts).astype(np.float32), np.zeros(DIM, np.float32)
    for i in range(0, len(codes), 2048):
        k = codes[i : i + 2048]
        bound = first[k >> 12] * second[k >> 6 & 63] * third[k & 63]
        out += weight[i : i + 2048] @ bound.astype(np.float32)
    norm = float(np.linalg.norm(out))
    return out / norm if norm else None


def fit(docs: DataFrame, usable: Column | None = None, max_per_lang: int = MAX_PER_LANG) -> dict[str, np.ndarray]:
    """Prototype of each language among ``usable`` rows with text and language."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.lit(True) if usable is None else usable))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # a language's share of rows: its bound over its count, by hash
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, max_per_lang / n))))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf.lang, pdf.text):
                p = profile(text)
                if p is not None:
                    total[lang] = total.get(lang, 0) + np.round(p * (1 << 20)).astype(np.int64)  # whole numbers: sums agree in any order
        if total:  # a frame without rows has no lists for Arrow to go by
            yield pd.DataFrame({"lang": list(total), "v": [v.tolist() for v in total.values()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]], "v": [np.sum(np.stack(pdf.v.to_list()), 0).tolist()]})

    made = chosen.mapInPandas(sums, "lang string, v array<long>").groupBy("lang").applyInPandas(add, "lang string, v array<long>").collect()
    out = {}
    for r in sorted(made, key=lambda r: r.lang):
        v = np.array(r.v, np.float64)
        if np.linalg.norm(v):
            out[r.lang] = v / np.linalg.norm(v)
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns with ``lang_pred`` and ``score``."""
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else None

    def run(texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for t in texts:
            p = profile(t) if matrix is not None else None
            if p is None:
                langs.append("und")
                scores.append(0.0)
            else:
                cos = matrix @ p
                k = int(cos.argmax())
                langs.append(names[k])
                scores.append(min(1.0, max(0.0, float(cos[k]))))
        return langs, scores

    return map_columns(docs, carry or ["doc_id"], ["text"], {"lang_pred": "string", "score": "double"}, run)
