"""The style tree of deep pages, of blocks in inline elements, and of one text shown in two ways, against its definition."""

import math
import random
from collections import defaultdict

import pytest

from loomspark.llm import htmltree

SCHEMA = "page_id long, url string, html string"


def drawn(rng, deep):
    """A page as nested (name, text, inline element around it, children): a chain of blocks with a text here and there."""
    node = None
    for level in reversed(range(deep)):
        text = rng.choice(["", f"said on many {level % 3}", f"own {rng.random()}"])
        side = [("p.side", rng.choice(["a b", "c d", f"e {rng.random()}"]), rng.choice(["", "span"]), [])] * rng.randint(0, 1)
        node = (f"div.l{level % 4}", text, rng.choice(["", "b"]), side + ([node] if node else []))
    return node


def html_of(node):
    name, text, around, children = node
    tag, _, cls = name.partition(".")
    inner = f"<{tag} class={cls}>{text}" + "".join(map(html_of, children)) + f"</{tag}>"
    return f"<{around}>{inner}</{around}>" if around else inner


def shown(node, above=()):
    name, text, _, children = node
    here = (*above, name)
    yield here, tuple(c[0].partition(".")[0] for c in children), text
    for c in children:
        yield from shown(c, here)


def plain_tree(pages):
    """{path: (pages, importance)} and the importance of all text, each by its definition."""
    looks, items, on = defaultdict(list), defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for k, page in enumerate(pages):
        for path, row, text in shown(page):
            on[path].add(k)
            if row:
                looks[path].append(row)
            if text:
                items[path][text].add(k)
    worth = {}
    for path, its in items.items():
        m = len(on[path])
        worth[path] = (sum(map(len, its)), sum(len(t) * (1 - math.log(len(s)) / math.log(m) if m > 1 else 1) for t, s in its.items()))
    out = {}
    for path in on:
        under = [w for p, w in worth.items() if p[: len(path)] == path]
        if not under:
            continue
        below = sum(w for _, w in under) / sum(c for c, _ in under)
        if looks[path]:
            n = len(looks[path])
            entropy = -sum(looks[path].count(x) / n * math.log(looks[path].count(x) / n, n) for x in set(looks[path])) if n > 1 else 1
            below = (1 - htmltree.GAMMA) * entropy + htmltree.GAMMA * below
        out[path] = (len(on[path]), below)
    return out, sum(w for _, w in worth.values()) / sum(c for c, _ in worth.values())


def hashed(path):
    h = 0
    for name in path:
        h = htmltree.step(h, name)
    return h


@pytest.mark.parametrize("reach", [htmltree.REACH, 1])
def test_importance_counts_all_levels_below(spark, monkeypatch, reach):
    """Only eight levels below a node counted, and no block inside an inline element was part of its row."""
    monkeypatch.setattr(htmltree, "REACH", reach)
    rng = random.Random(4)
    hosts = {"deep.example": [drawn(rng, rng.randint(20, 45)) for _ in range(25)], "two.example": [drawn(rng, 17) for _ in range(2)], "flat.example": [drawn(rng, 2) for _ in range(9)]}
    rows = [(i, f"https://{h}/{i}", html_of(p)) for h, pages in hosts.items() for i, p in enumerate(pages)]
    d = spark.createDataFrame(rows + rows[:3], SCHEMA).repartition(5)  # repeated pages count once
    got = {(r.host, r.path): (r.pages, r.importance, r.usual) for r in htmltree.style_tree(d).collect()}
    want = {}
    for h, pages in hosts.items():
        tree, usual = plain_tree(pages)
        want |= {(h, hashed(path)): (n, x, usual) for path, (n, x) in tree.items()}
    assert got.keys() == want.keys()
    for key, (n, x, usual) in want.items():
        assert got[key][0] == n and abs(got[key][1] - x) < 1e-8 and abs(got[key][2] - usual) < 1e-8, key


def test_a_story_deep_below_a_common_line_stays(spark):
    page = lambda i: "<div class=q1>the same line</div><div class=q2>a line on all pages" + "<div>" * 12 + f"<p>story {i} of this page alone</p>" + "</div>" * 13
    d = spark.createDataFrame([(i, "https://h.example/", page(i)) for i in range(30)], SCHEMA)
    for r in htmltree.html_main_text(d).collect():
        assert f"story {r.page_id} of this page alone" in r.text and "the same line" not in r.text


def test_preformatted_raw_text_is_an_item(spark):
    d = spark.createDataFrame([(i, "https://h.example/", f"<div class=q1>a line on all pages <xmp>code {i} of this page alone</xmp></div><div class=q2>same</div>") for i in range(30)], SCHEMA)
    assert all(r.text == f"a line on all pages code {r.page_id} of this page alone" for r in htmltree.html_main_text(d).collect())


def test_one_text_in_two_ways_shows_both(spark):
    """Which of the two counted was left to chance."""
    one, two = "<div class=q>ab</div>", "<div class=q>a<p>b</p></div>"
    other = "<div class=q>ab<p>c</p></div>"
    for order in ([one, two, other], [two, other, one], [other, one, one, two]):
        d = spark.createDataFrame([(i, "https://h.example/", p) for i, p in enumerate(order)], SCHEMA).repartition(2)
        found = {r.path: r for r in htmltree.style_tree(d).collect()}
        top, inner = found[hashed(["div.q"])], found[hashed(["div.q", "p"])]
        # two texts: at the top 'ab' in both, 'a' in one; below 'b' and 'c' in one each; both rows of blocks are one p
        assert (top.pages, inner.pages, len(found)) == (2, 2, 2) and abs(inner.importance - 1) < 1e-9
        assert abs(top.importance - ((1 - htmltree.GAMMA) * 0 + htmltree.GAMMA * (0 * 2 + 1 + 1 + 1) / 5)) < 1e-8
