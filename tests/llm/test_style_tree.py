"""The style tree against a plain recomputation, and what it decides without any name list."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from loomspark.llm import htmltree

SCHEMA = "page_id long, url string, html string"


def drawn(rng):
    """A page as nested (name, text, children), of blocks only."""
    store = [f"link {i}" for i in range(5)]
    menu = ("ul.x", "", [("li", rng.choice(store), []) for _ in range(rng.randint(1, 4))])
    body = [("p", f"own words {rng.random()}", []) for _ in range(rng.randint(1, 3))] + [("p", "said on many pages", [])] * rng.randint(0, 2)
    return ("div.page", rng.choice(["", "loose"]), [menu, ("section.story", "", body), *[("div.foot", "the foot", [])] * rng.randint(0, 1)])


def html_of(node):
    name, text, children = node
    tag, _, cls = name.partition(".")
    return f"<{tag}" + (f" class={cls}" if cls else "") + f">{text}" + "".join(map(html_of, children)) + f"</{tag}>"


def shown(node, above=()):
    name, text, children = node
    here = (*above, name)
    yield here, tuple(c[0].partition(".")[0] for c in children), text
    for c in children:
        yield from shown(c, here)


def plain_tree(pages):
    """{path: (pages, importance)} and the importance of all text, each by its definition."""
    looks, items, on = defaultdict(list), defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for k, page in enumerate(pages):
        rows = defaultdict(list)
        for path, row, text in shown(page):
            on[path].add(k)
            if row:
                rows[path].append(row)
            if text:
                items[path][text].add(k)
        for path, r in rows.items():
            looks[path].append(tuple(r))
    worth = {}
    for path, its in items.items():
        m = len(on[path])
        worth[path] = (sum(map(len, its)), sum(len(t) * (1 - math.log(len(s)) / math.log(m) if m > 1 else 1) for t, s in its.items()))
    out = {}
    for path in on:
        under = [w for p, w in worth.items() if p[: len(path)] == path and len(p) - len(path) <= htmltree.REACH]
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


def test_importance_is_that_of_its_definition(spark):
    rng = random.Random(4)
    hosts = {"a.example": [drawn(rng) for _ in range(40)], "b.example": [drawn(rng) for _ in range(7)], "one.example": [drawn(rng)]}
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


def test_a_menu_chosen_from_a_store_goes_by_the_tree_alone(spark):
    """No element, role or name here is on a list; each page chooses its own links and its own line at the end."""
    rng = random.Random(5)
    links, lines = [f"place {i}" for i in range(12)], [f"closing line {i}" for i in range(8)]
    page = lambda i: f"<div class=q1><ul><li>{'<li>'.join(rng.sample(links, 6))}</ul></div><div class=q2><h2>heading {i}</h2><p>story {i} {rng.random()}</p><p>Is.</p></div><div class=q3>{rng.choice(lines)}</div>"
    d = spark.createDataFrame([(i, "https://h.example/", page(i)) for i in range(300)], SCHEMA)
    got = [r.text for r in htmltree.html_main_text(d).orderBy("page_id").collect()]
    assert all(t.startswith(f"heading {i}\nstory {i} ") and t.endswith("\nIs.") and t.count("\n") == 2 for i, t in enumerate(got))


def test_copies_do_not_make_an_article_a_template(spark):
    rng = random.Random(6)
    menu = lambda: "<div class=q1>" + rng.choice(["one", "two", "three"]) + " way</div>"
    third = [menu() + (f"<div class=q2><h1>copied title</h1><p>copied text of some length {i % 2}</p></div>" if i % 3 == 0 else f"<div class=q2><h1>title {i}</h1><p>own text of some length {i}</p></div>") + f"<i>{i}</i>" for i in range(240)]
    d = spark.createDataFrame([(i, "https://third.example/", p) for i, p in enumerate(third)], SCHEMA)
    got = {r.page_id: r.text for r in htmltree.html_main_text(d).collect()}
    for i in range(240):
        assert " way" not in got[i] and ("copied title\ncopied text" in got[i] if i % 3 == 0 else f"title {i}\nown text" in got[i])


def test_style_tree_of_nothing(spark):
    assert htmltree.style_tree(spark.createDataFrame([], SCHEMA)).count() == 0
    empty = spark.createDataFrame([(1, None, None), (2, "x", ""), (None, "x", "no block")], SCHEMA)
    assert htmltree.style_tree(empty).count() == 0 and htmltree.html_main_text(empty).where(F.col("n_chars") > 0).count() == 1
