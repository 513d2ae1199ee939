"""Main text of pages: awkward markup by hand, and sites without declared articles against a tree built in plain Python."""

import math
import random
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from hirespan.llm import styletree
from hirespan.llm.queries import QUERIES
from hirespan.llm.styletree import DAMPING, FEW, LEAST, main_text, parsed

PAGES = [
    ("", ""),
    ("just text &amp; more", "just text & more"),
    ("<p>one<p>two<br>three\n\n four</p>", "one\ntwo three four"),
    ("<title>no</title><nav>no</nav><article><h1>A&ampB</h1><p><b>x<br><p>y &lt;z&gt;&nbsp;!</article><footer>no</footer>", "A&B\nx\ny <z> !"),
    ("<article><header><h1>H</h1></header><p>t</p><aside>no</aside><form>no</form><footer>no</footer></article><p>beside</p>", "H\nt"),
    ("<header>no</header><main><header>yes</header><p>in</p></main>out", "yes\nin"),
    ("<script>if (a</b/) '</p>'</script><style>p{}</style><p>t</p><!-- <p>no</p> --><!--><p>u</p><!-- no", "t\nu"),
    ("<p>a < b &am c<p title='>' class=\"x>y\">d</p><p", "a < b &am c\nd"),
    ("<div class='ad-box'>no</div><div class='story'>yes<section id='comments'>no</section></div>", "yes"),
    ("<div class='sidebar-left'><article>yes</article></div>", "yes"),
    ("<article>yes</article><article class='comment'>no</article>", "yes"),
    ("<ul><li><a href=/x>menu</a><li><a href=/y>items</a></ul><p>text with <a href=/z>a link</a></p>", "text with a link"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<form action=/><h1>Page in a form</h1><p>t</p></form>", "Page in a form\nt"),
    ("<p>text <span class='advert'>no</span> goes on</p>", "text\ngoes on"),
    ("<textarea><p>no</textarea><iframe>no</iframe><noscript>no</noscript><p>yes</p></article></div></p>", "yes"),
    ("<div>" * 3000 + "deep" + "</div>" * 10, "deep"),
    ("<nav>only a menu</nav>", ""),
    ("<p>&#233;&#x6f22;&eacute;&notanentity;&#0;</p>", "é漢é¬anentity;\ufffd"),
]


@pytest.mark.parametrize("number", range(len(PAGES)))
def test_single_pages(number):
    source, text = PAGES[number]
    assert main_text(parsed(source), {}) == text


def test_long_pages_take_time_in_proportion():
    for source in ["<a b='" * 30_000, "<p>" * 30_000 + "x", "<" * 100_000, "<!--" * 50_000, "</p>" * 100_000, "<i><p>" * 5_000]:
        parsed(source)
    assert main_text(parsed("<p>word &amp; </p>" * 50_000), {}) == "\n".join(["word &"] * 50_000)


class Tree(HTMLParser):
    """Nested lists [label, children]; a text is a string. For well-formed markup without inline elements but ``a``."""

    def __init__(self):
        super().__init__()
        self.stack, self.link = [["body", []]], False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
            return
        node = [" ".join([tag, *sorted(v for _, v in attrs)]), []]
        self.stack[-1][1].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        else:
            self.stack.pop()

    def handle_data(self, data):
        inner = self.stack[-1][1]
        if inner and isinstance(inner[-1], tuple):
            old = inner.pop()
            inner.append((old[0] + data, old[1] + len(data.replace(" ", "")) * self.link))
        else:
            inner.append((data, len(data.replace(" ", "")) * self.link))


def plain_trees(pages):
    """Kept runs of each distinct page of one host, by entropies over nested keys."""
    shown, trees = defaultdict(Counter), {}

    def label(c):
        return "#" if isinstance(c, tuple) else c[0]

    def walk(node, key, seen):
        if isinstance(node, tuple):
            seen.append((key, node, node[0]))
            return
        style = tuple(map(label, node[1]))
        if style != ("#",):
            seen.append((key, node, style))
        for k, c in enumerate(node[1]):
            walk(c, (key, style, k), seen)

    for page in set(pages):
        tree = Tree()
        tree.feed(page)
        tree.close()
        trees[page] = []
        walk(tree.stack[0], "host", trees[page])
        for key, _, value in trees[page]:
            shown[key][value] += 1

    def own(key):
        m = sum(shown[key].values())
        return 1.0 if m < FEW else -sum(c / m * math.log(c / m, m) for c in shown[key].values())

    out = {}
    for page, seen in trees.items():
        runs = [(key, node) for key, node, _ in seen if isinstance(node, tuple)]
        kept = [n[0] for key, n in runs if own(key) * (1 - n[1] / len(n[0].replace(" ", ""))) >= LEAST]
        out[page] = "\n".join(kept or [n[0] for _, n in runs])
    return out


def site(seed):
    """Pages of one layout: a line alike everywhere, one that changes seldom, links, and text of their own."""
    rng = random.Random(seed)
    pages = []
    for k in range(rng.choice([2, 3, 8, 15])):
        body = "".join(f"<p>own text {rng.randint(0, 10**6)} of {k}</p>" for _ in range(rng.randint(1, 4)))
        seldom = "now" if rng.random() < 0.1 else "then"
        pages.append(
            f"<div class='a'>Always the same line</div><ul><li><a>menu {k}</a></li><li>see <a>more</a></li></ul><div class='b'>{seldom}</div>"
            f"<div class='c'><div><h2>Title {rng.randint(0, 3)}</h2>{body}</div></div><div class='d'><div>all rights</div><div>of {seed}</div></div>"
        )
    return pages + pages[:1] * rng.randint(0, 5)


def table(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, found string, page int, text string")


def test_sites_against_plain_trees(spark):
    rows, expected = [], []
    for seed in range(12):
        pages = site(seed)
        kept = plain_trees(pages)
        for page in pages:
            rows.append((len(rows), f"http://Site{seed}.example/{len(rows)}", page, "f", 1, "t"))
            expected.append((rows[-1][0], rows[-1][1], kept[page], len(kept[page])))
    found = styletree.extracted(table(spark, rows)).orderBy("page_id").collect()
    assert [tuple(r) for r in found] == expected
    assert any("Always" in e[2] for e in expected) and any("Always" not in e[2] for e in expected)
    assert all("own text" in e[2] and "menu" not in e[2] for e in expected)


def test_composite_joins_a_node_with_what_is_inside():
    page = parsed("<div><p>a</p><p><a>b</a></p></div>")  # body, div, p, run, p, run
    found = {0: (0.0, 2), 1: (0.5, 1), 3: (0.4, 3)}
    values = styletree.composite(page, found)
    div = (1 - DAMPING) * 0.5 + DAMPING * (values[2] + values[4]) / 2
    assert values[3] == 0.4 and values[5] == 0 and values[1] == pytest.approx(div)
    assert values[0] == pytest.approx(DAMPING**2 * div)


def test_awkward_rows(spark, tmp_path):
    rows = [(None, None, None), (1, "no host", ""), (2, "x://H/", PAGES[3][0]), (2, "x://H/", PAGES[3][0]), (3, None, "<p>t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["op11_html_text"](spark, str(tmp_path)).collect()
    text = PAGES[3][1]
    expected = [(None, None, "", 0), (1, "no host", "", 0), (2, "x://H/", text, len(text)), (2, "x://H/", text, len(text)), (3, None, "t", 1)]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert styletree.extracted(table(spark, [])).collect() == []


def test_given_pages_give_their_articles(spark, sf_dir):
    """The given pages declare their article, which an HTML parser of Python's library can follow."""

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.lines = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag in ("p", "h1"):
                self.lines.append("")
            self.lines[-1] += " " * (tag == "br")

        def handle_endtag(self, tag):
            self.inside &= tag != "article"

        def handle_data(self, data):
            self.lines[-1] += data * self.inside

    for row, source in zip(
        QUERIES["op11_html_text"](spark, sf_dir).orderBy("page_id").collect(),
        spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").collect(), strict=True,
    ):
        article = Article()
        article.feed(source.html)
        article.close()
        lines = [" ".join(x.split()) for x in article.lines]
        assert row.text == "\n".join(x for x in lines if x) and row.n_chars == len(row.text)
