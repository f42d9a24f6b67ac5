"""Main text of pages: the table function on every case, trees against a climbing parser, time on hostile pages."""

import random
import re
import time
from html import unescape

import pytest

from cairn.llm import html_text as H

ARTICLE = "<article><h1>T</h1><p>One, two &amp; three.</p></article>"


def test_cases_of_pages(spark):
    pages = [(1, "u1", f"<body><nav>menu</nav>{ARTICLE}<footer>f</footer>"), (1, "u1", f"<body><nav>menu</nav>{ARTICLE}<footer>f</footer>"), (2, None, None), (3, "u3", ""), (4, "u4", "<div><script>x</script></div>"), (None, "u5", "plain  text"), (6, "u6", "<p>" + "word, " * 30000 + "end.</p>")]
    df = spark.createDataFrame([(*p, "other", 5) for p in pages], "page_id long, url string, html string, text string, n_chars int")
    out = H.main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.url if r.page_id is None else r.page_id: (r.url, r.text, r.n_chars) for r in out.collect()}
    assert got[1] == ("u1", "T\n\nOne, two & three.", 20) and got[2] == (None, "", 0) and got[3] == ("u3", "", 0) and got[4] == ("u4", "", 0)
    assert got["u5"] == ("u5", "plain text", 10) and got[6][1] == "word, " * 30000 + "end."
    assert out.count() == len(pages) and H.main_text(df.limit(0)).count() == 0


def test_code_points_are_counted(spark):
    df = spark.createDataFrame([(1, "u", "<p>\U0001f600 é&#x1F600;</p>")], "page_id long, url string, html string")
    assert H.main_text(df).first().n_chars == 4


PROSE = "A sentence of some length, with a comma, that a reader of the page would surely want to keep. "


def test_text_split_over_containers():
    """No article or main element: siblings stay by what they are, not by their tag."""
    paragraphs = "".join(f"<p>{PROSE * 3}{i}</p>" for i in range(5))
    page = f"<body><ul class=nav><li><a href=a>Home</a><li><a href=b>More</a></ul><div><div>{paragraphs}</div></div><div>{PROSE}</div><h3>Part</h3><section><p>{PROSE * 2}</p></section><ol><li>First step.<li>Second step.</ol><pre>code = 1.</pre><div><a href=x>{PROSE}</a></div><div>Short</div></body>"
    text = H.extract(page).split("\n\n")
    own = PROSE.strip()
    assert text == [*(f"{PROSE * 3}{i}" for i in range(5)), own, "Part", f"{PROSE * 2}".strip(), "First step.", "Second step.", "code = 1."]


def test_equal_points_go_to_the_earlier_element():
    one = f"<p>{PROSE}</p>"
    assert H.extract(f"<div><section>{one}</section></div><aside>{one}</aside>") == PROSE.strip()
    assert H.extract("<article><p>First, one.</p></article><article><p>First, one.</p></article>") == "First, one.\n\nFirst, one."[:11]


@pytest.mark.parametrize("html", ("<div>x " * 100000, "<i>x " * 100000 + "</b>" * 100000, "<ul><li><ul>" + "<div>" * 50000 + "<li>a</li>" * 50000, "<i>" * 50000 + "<div>a</div>" * 50000, "<p>a, b" * 100000, "<a b='>" * 50000))
def test_time_is_linear(html):
    began = time.perf_counter()
    H.extract(html)
    assert time.perf_counter() - began < 30


# --- a plain parser that climbs from the innermost element for every tag, and a scorer that adds up every ancestor ---------


class Plain:
    def __init__(self, tag, parent, dropped=False):
        self.tag, self.parent, self.dropped, self.children = tag, parent, dropped, []


def plain_tree(html):
    root = node = Plain("#root", None)

    def up(x):
        while x is not None:
            yield x
            x = x.parent

    for m in re.finditer(r"<(/?)([a-z0-9]+)>|([^<]+)", html):
        close, tag, text = m.groups()
        if text:
            if not any(x.dropped for x in up(node)):
                node.children.append(unescape(text))
            continue
        if close:
            barrier = next((x for x in up(node) if x.tag in ("td", "th", "table")), None) if tag == "p" else None
            for x in up(node):
                if x.tag == tag and x.parent is not None:
                    node = x.parent
                    break
                if x is barrier:
                    break
            continue
        if tag in H.BLOCK:
            for x in up(node):
                if x.tag == "p":
                    node = x.parent
                    break
                if x.tag in H.BLOCK and not (x.tag in H.HEADINGS and tag[0] == "h"):
                    break
        if tag in H.CLOSES:
            ends, barriers = H.CLOSES[tag]
            found = None
            for x in up(node):
                if x.tag in barriers:
                    break
                found = x if x.tag in ends else found
            node = found.parent if found is not None else node
        child = Plain(tag, node, H._unwanted(tag, "", any(x.tag in ("article", "main") for x in up(node))))
        if not any(x.dropped for x in up(node)):
            node.children.append(child)
        if tag not in H.VOID:
            node = child
    return root


def shape(node):
    return node.tag, [c if isinstance(c, str) else shape(c) for c in node.children]


def test_trees_and_sums_equal_a_plain_version():
    rng = random.Random(4)
    tags = "p div i b li ul td tr table h1 h2 a article span dl dt dd nav section main br hr option".split()
    for _ in range(4000):
        html = "".join(rng.choice((f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "text, here. ")) for _ in range(rng.randint(1, 40)))
        root, nodes = H.parse(html)
        assert shape(root) == shape(plain_tree(html)), html
        blocks = H._blocks(root)
        H.extract(html)
        for x in nodes:  # parents come before children, which the sums rely on
            assert x.parent is None or nodes.index(x.parent) < nodes.index(x)
        joined = "".join(c for c, _ in H._walk(root) if isinstance(c, str))
        assert "".join(t for _, t, _ in blocks).replace(" ", "") == re.sub(r"\s", "", joined)
