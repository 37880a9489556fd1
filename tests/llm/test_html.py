"""The renderer's open elements against a plain list, its bounds on work and output, and visibility."""

import random
import re
import time

import pytest

from lexforge.llm import html_render as hr

TAGS = "div p b i ul ol li table tr td th tbody thead span h1 h2 blockquote em section a button caption option select dl dt dd head body ruby rt".split()


class PlainOpen:
    """The same rules, each looked up from the innermost element outwards."""

    def __init__(self, root):
        self.nodes = [root]

    @property
    def top(self):
        return self.nodes[-1]

    def push(self, tag, attrs):
        node = hr.Node(tag, attrs)
        self.top.kids.append(node)
        self.nodes.append(node)
        return node

    def last(self, tags):
        return max((k for k, n in enumerate(self.nodes) if k and n.tag in tags), default=0)

    def pop(self):
        if len(self.nodes) > 1:
            self.nodes.pop()

    def close(self, names, stop):
        for k in range(len(self.nodes) - 1, 0, -1):
            if self.nodes[k].tag in names:
                del self.nodes[k:]
                return
            if self.nodes[k].tag in stop:
                return

    def end(self, name):
        wall = {"table"} if name in hr._TABLE_PARTS else {"td", "th", "table", "caption", "button"}
        for k in range(len(self.nodes) - 1, 0, -1):
            if self.nodes[k].tag == name:
                if name in hr.BLOCKS or not any(n.tag in hr.BLOCKS for n in self.nodes[k + 1 :]):
                    del self.nodes[k:]
                else:
                    del self.nodes[k]
                return
            if self.nodes[k].tag in wall:
                return


def page(rng):
    out = []
    for n in range(rng.randint(1, 80)):
        t = rng.choice(TAGS)
        out.append(rng.choice([f"<{t}>", f"<{t}>", f"</{t}>", f" w{n} ", f"<td rowspan={rng.randint(0, 3)} colspan={rng.randint(1, 3)}>x{n}"]))
    return "".join(out)


def shape(node):
    return node.tag, [k if isinstance(k, str) else shape(k) for k in node.kids]


def test_trees_are_those_of_a_plain_list(monkeypatch):
    rng = random.Random(3)
    pages = [page(rng) for _ in range(1500)]
    got = [shape(hr.build(h)) for h in pages]
    monkeypatch.setattr(hr, "Open", PlainOpen)
    assert got == [shape(hr.build(h)) for h in pages]


def test_spanned_tables_keep_all_text():
    rng = random.Random(4)
    for _ in range(400):
        h = "<table>" + "".join("<tr>" + "".join(f"<td rowspan={rng.randint(0, 4)} colspan={rng.choice([1, 1, 2, 900])}>c{r}x{c}" for c in range(rng.randint(0, 5))) for r in range(8)) + "</table>"
        assert re.findall(r"c\d+x\d+", hr.render(h) or "") == re.findall(r"c\d+x\d+", h)


@pytest.mark.parametrize("source", [
    "<div>" * 100_000 + "x" + "</i>" * 100_000, "<b>" + "<i><div>" * 50_000 + "</i>" * 50_000, "<p>" * 100_000, "<span>" * 100_000 + "</p>" * 50_000, "<li>" * 50_000,
    "<table><tr>" + "<td colspan=1000 rowspan=0>a" * 2000 + "<tr><td>b" * 2000 + "</table>", "<table><tr>" + "<td rowspan=0>a" * 4000 + "<tr><td>b" * 4000 + "</table>",
    "<table><tr>" + "".join(f"<td rowspan={k + 2}>a" for k in range(2000)) + "<tr><td>b" * 2000 + "</table>",
    "<table><tr>" + "<td>a" * 1000 + "<td>" + "x<br>" * 3000 + "</table>",
])
def test_work_and_output_are_bounded(source):
    began = time.process_time()
    text = hr.render(source)
    assert time.process_time() - began < 5 and len(text) <= 250 * len(source)


@pytest.mark.parametrize("source,text", [
    ("<div style='visibility:hidden'>a<b style='visibility: visible'>B</b>c</div>d", "B\nd"), ("<p style='visibility:collapse'>a<p>b", "b"),
    ("<div style='visibility:hidden'><div>x<p>y</div></div>z", "z"), ("<details>a<summary>s</summary>b</details>c", "s\nc"), ("<details open><summary>s</summary>b</details>", "s\nb"),
    ("<details>a</details>b", "b"), ("<div style='display:none'><b style='visibility:visible'>x</b></div>y", "y"), ("<ol><li style='visibility:hidden'>a<li>b</ol>", "2. b"),
    ("visibility:hidden <b>x</b>", "visibility:hidden x"),
])
def test_visibility(source, text):
    assert hr.render(source) == text
