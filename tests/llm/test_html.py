"""Wrapper induction: alignment against brute force, and pages whose content is known."""

import json
import random
from functools import lru_cache

import pytest

from rastertables.llm import html_text as H


def tree(nested):
    """(up, tag, name) of nested (tag, name, children)."""
    up, tag, name = [], [], []

    def add(node, parent):
        up.append(parent)
        tag.append(node[0])
        name.append(node[1])
        own = len(up) - 1
        for child in node[2]:
            add(child, own)

    add(nested, -1)
    return up, tag, name


def brute_match(a, b):
    """The best weight over all order-preserving mappings, by plain recursion."""

    @lru_cache(None)
    def pair(x, y):
        return 2 + (x[1] == y[1]) + rows(x[2], y[2]) if x[0] == y[0] else 0

    @lru_cache(None)
    def rows(left, right):
        if not left or not right:
            return 0
        both = pair(left[0], right[0])
        return max(rows(left[1:], right), rows(left, right[1:]), both + rows(left[1:], right[1:]) if both else 0)

    return pair(a, b)


def test_tree_matching_against_brute_force():
    rng = random.Random(3)

    def grown(depth):
        return (rng.choice("ab"), rng.choice(["", "x"]), tuple(grown(depth - 1) for _ in range(rng.randrange(4))) if depth else ())

    for _ in range(60):
        a, b = (("", "", tuple(grown(2) for _ in range(rng.randrange(4)))) for _ in range(2))
        weight, mapping = H.tree_match(tree(a), tree(b))
        (up_a, tag_a, _), (up_b, tag_b, _) = tree(a), tree(b)
        assert weight == brute_match(a, b)
        assert all(tag_a[x] == tag_b[y] and (x == 0 or mapping[up_a[x]] == up_b[y]) for x, y in mapping.items())
        assert sorted(mapping) == sorted(mapping, key=lambda x: mapping[x])


def test_pages_are_parsed_and_repaired():
    page = H.Page("<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a>Home</a></nav><article><h1>A &amp; B</h1><p><b>x<br>y<p>z <i>w</i></article><footer>f</footer>")
    assert [t for _, t, _ in page.blocks] == ["T", "Home", "A & B", "x y", "z w", "f"]
    assert page.links[page.tag.index("nav")] == 4 and page.times[page.tag.index("p")] == 2
    deep = H.Page("<div>" * 5000 + "in" + "</div>" * 5000 + "<b>" * 5000 + "out")
    assert [t for _, t, _ in deep.blocks] == ["in", "out"]
    ids = H.node_ids(deep.shape(), json.dumps([deep.shape()]), {})
    assert len(ids) == 5001 and "in" in H.content(deep, ids, {}, set())


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def made(rng, layout, i, names):
    """A page without telling names or tags, and its content."""
    x = lambda k: f" class='{names(k)}'"
    head, parts = words(rng, 5), [words(rng, rng.randrange(8, 60)) for _ in range(rng.randrange(1, 7))]
    links = "".join(f"<li><a href=#>{words(rng, 2)}</a></li>" for _ in range(6))
    body = f"<h2>{head}</h2>" + "".join(f"<p>{p}</p>" for p in parts)
    if layout == 0:
        page = f"<div{x(0)}><ul>{links}</ul></div><div{x(1)}>{words(rng, 9)}</div><div{x(2)}><div>Fixed words here</div>{body}</div><div{x(3)}>{words(rng, 7)}</div>"
    elif layout == 1:
        page = f"<table><tr><td><ul>{links}</ul></td><td><div>{body}</div></td></tr></table><div{x(1)}>{words(rng, 6)}</div>"
    else:
        side = f"<div{x(4)}><div>{words(rng, 4)}</div></div>" if i % 2 else ""
        page = f"<section><section>{side}<section>{body}<blockquote>Read on soon</blockquote></section></section><ul>{links}</ul></section>"
    return f"<html><head><title>{head}</title></head><body>{page}</body></html>", "\n\n".join([head, *parts])


@pytest.mark.parametrize("meaning", ["fixed", "random"])
def test_content_is_found_without_telling_names(spark, meaning):
    rng = random.Random(7)
    names = (lambda k: "zq"[k % 2] * (k + 1)) if meaning == "fixed" else lambda k: "".join(rng.choice("klmnopqrst") for _ in range(6))
    rows, want = [], {}
    for h in range(6):
        for i in range(30):
            source, want[len(rows)] = made(rng, h % 3 if h < 5 else i % 3, i, names)
            rows.append((len(rows), f"http://h{h}.example/{i}", source))
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wrong = [i for i in want if got[i] != want[i]]
    assert len(wrong) <= 0.02 * len(want), (wrong[:3], [got[i][:80] for i in wrong[:3]])


def test_template_and_odd_rows(spark):
    page = lambda i: f"<body><div>Welcome to us</div><div><p>text {i}</p></div>"
    rows = [(i, "http://h.example/x", page(i), 1, "k") for i in range(12)] + [(20, None, None, 1, "k"), (21, "::bad", "", 1, "k"), (22, "http://o.example/", "<p>lonely", 1, "k"), (3, "http://h.example/x", page(3), 1, "k"), (None, "u", "<p>x", 1, "k")]
    rows.append((30, "http://long.example/", "<article><p>" + "word " * 60000 + "</p><p>end</p></article><nav><a>off</a></nav>", 1, "k"))
    some = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, host string")
    found = H.extract(some).collect()
    got = {r.page_id: r for r in found}
    assert len(found) == len(rows) and sum(r.page_id == 3 for r in found) == 2
    assert got[3].text == "text 3" and got[3].n_chars == 6 and got[20].text == "" and got[21].text == "" and got[22].text == "lonely" and got[None].text == "x"
    assert got[30].text.endswith("word\n\nend") and got[30].n_chars == 5 * 60000 - 1 + 5
    assert H.extract(some.filter("false")).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    page = lambda i: f"<body><div>Welcome</div><p>text {i}</p><section><h2>{'Welcome' if i == 3 else i}</h2></section>"
    some = spark.createDataFrame([(i, "http://h.example/x", page(min(i, 6))) for i in range(100)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(some).collect()}
    assert got[50] == "text 6\n\n6" and got[3] == "text 3\n\nWelcome"


def test_a_template_text_elsewhere_stays(spark):
    page = lambda i: f"<body><div>Back</div><section>{'<h4>Back</h4>' if i == 5 else ''}<p>text {i} and more words</p></section>"
    some = spark.createDataFrame([(i, "http://h.example/x", page(i)) for i in range(12)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(some).collect()}
    assert got[5] == "Back\n\ntext 5 and more words" and got[4] == "text 4 and more words"


def test_templates_of_two_layouts(spark):
    one = lambda i: f"<body class='has-sidebar'><div class='a'>Top one</div><article class='post comments-open'><p>text {i}</p><div class='c'>End one</div></article>"
    two = lambda i: f"<body><table><tr><td>Top two</td></tr><tr><td><h2>title {i}</h2></td></tr></table><blockquote>End two</blockquote>"
    some = spark.createDataFrame([(i, "http://h.example/x", (one, two)[i % 2](i)) for i in range(40)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(some).collect()}
    assert got == {i: f"title {i}" if i % 2 else f"text {i}" for i in range(40)}


def brute_extract(rows):
    """The learning in plain Python: all pages of a host at once."""
    out, hosts = {}, {}
    for i, url, source in rows:
        hosts.setdefault(url.split("/")[2], {}).setdefault(source, []).append(i)
    for pages in hosts.values():
        parsed = {s: H.Page(s) for s in pages}
        forms = {}
        for p in parsed.values():
            forms.setdefault(H._digest(json.dumps([p.up, p.tag])), []).append(p.shape())
        ranked = sorted(forms, key=lambda f: (-len(forms[f]), -f))
        some = [f for f in ranked if len(forms[f]) >= H.COMMON * len(parsed) or f == ranked[0]][: H.REFERENCES]
        references = json.dumps([min(forms[f], key=str.encode) for f in some])
        ids = {s: H.node_ids(p.shape(), references, {}) for s, p in parsed.items()}
        facts, texts = {}, {}
        for s, p in parsed.items():
            for k, node in enumerate(ids[s]):
                facts.setdefault(node, []).append((p.chars[k], p.links[k], p.times[k]))
            for pair in {(ids[s][node], H._digest(text)) for node, text, _ in p.blocks}:
                texts[pair] = texts.get(pair, 0) + 1
        fixed = set()
        for (node, digest), k in texts.items():
            n = len(facts[node])
            q = k / n
            if k > 1 and (q + 1 / (2 * n) - (q * (1 - q) / n + 1 / (4 * n * n)) ** 0.5) / (1 + 1 / n) >= H.CONSTANT - 1e-9:
                fixed.add((node, digest))
        known = {n: tuple(sum(c) / len(f) for c in zip(*f)) for n, f in facts.items() if len(f) >= H.RARE * len(parsed)}
        for s, own in pages.items():
            text = "\n\n".join(H.content(parsed[s], ids[s], known, fixed))
            out |= dict.fromkeys(own, text)
    return out


def test_extraction_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    rng = random.Random(1)
    for i in range(60):
        rows.append((10**6 + i, f"http://made{i % 2}.example/", made(rng, i % 3, i, lambda k: "v" * k)[0]))
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == brute_extract(rows) and json.dumps(got)
