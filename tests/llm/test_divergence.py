"""Source divergence against a dense plain computation."""

import random
import re
from collections import Counter

from loomspark.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(docs, min_docs, top):
    counts, df = {}, {}
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = Counter(TERM.findall(lowered))
        counts.setdefault((lang, source), Counter()).update(found)
        df.setdefault(lang, Counter()).update(found.keys())
    out = []
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        groups = {s: c for (g, s), c in counts.items() if g == lang}

        def p(count):
            total = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // total for t in kept}

        q = p(sum(groups.values(), Counter()))
        each = {s: p(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(-sum(abs(each[s][t] - each[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(q[t] - each[s][t], t.encode(), t) for t in kept if groups[s][t] and each[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = ["Haus", "maison", "été", "naïve", "日本", "x", "The", "the", "don't", "a1b", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    docs = []
    for i in range(n):
        lang, source = rng.choice(["de", "fr", None, ""]), rng.choice(["s1"] * 6 + ["s2", "s3", "é", None])
        docs.append((i, rng.choice(["", " ", "-"]).join(rng.choices(words, [1 + (k % 7) for k in range(len(words))], k=rng.randrange(0, 30))), lang, source))
    return [*docs, (None, None, "de", "s9"), (1, "", "xx", "s1"), (2, "...", "xx", "s2"), (3, "rare word", "yy", None), (3, "rare word", "yy", None)]


def test_equal_to_the_dense_computation(spark):
    docs = corpus(1)
    df = spark.createDataFrame(docs, SCHEMA).repartition(5).selectExpr("*", "'x' AS term", "1 AS n", "2 AS value", "'y' AS item")
    assert got(divergence.divergence(df, 20)) == plain(docs, 20, 50)
    assert got(divergence.divergence(df, 20, top=3)) == plain(docs, 20, 3)
    assert got(divergence.divergence(df, 10_000)) == plain(docs, 10_000, 50)


def test_counts_don_t_depend_on_the_table_s_size(spark, monkeypatch):
    docs = corpus(2)
    monkeypatch.setattr(divergence, "TERMS", 5)
    assert got(divergence.divergence(spark.createDataFrame(docs, SCHEMA), 20)) == plain(docs, 20, 50)


def test_long_texts_are_counted_in_stretches(monkeypatch):
    text = ("Ein Été, " * 300 + "y" * 200 + "!z ").encode()
    whole = divergence.term_counts(text)
    monkeypatch.setattr(divergence, "STRETCH", 16)
    assert divergence.term_counts(text) == whole == Counter({b"ein": 300, "Été".encode(): 300, b"y" * 200: 1, b"z": 1})


def test_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).collect() == []
