"""The operators without SQL against slow versions of their rules: networks in plain loops and by numeric
gradients, the choice of a page's article by its definition."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import html_text, language, quality
from mnemospark.llm.byte_net import ByteNet


def chances(net: ByteNet, text: bytes) -> list[float]:
    """The classes' probabilities of one text, a number at a time."""
    byte = lambda i: text[i] if i < len(text) else 0
    blocks = []
    for k in range(max(-(-len(text) // net.block), 1)):
        row = []
        for w in net.widths:
            for f in range(net.filters):
                responses = [sum(float(net.p[f"t{w}"][j, byte(k * net.block + i + j), f]) for j in range(w)) for i in range(net.block)]
                row.append(max(responses) + float(net.p[f"b{w}"][f]))
        blocks.append(row)
    if net.chunk == 2 and len(blocks) > 1:
        blocks = [[max(a, b) for a, b in zip(x, y, strict=True)] for x, y in zip(blocks, blocks[1:], strict=False)]
    chunks = [[max(x, 0.0) for x in row] for row in blocks]
    features = [sum(c) / len(chunks) for c in zip(*chunks, strict=True)]
    if net.with_max:
        features += [max(c) for c in zip(*chunks, strict=True)]
    logits = [sum(u * float(net.p["head"][i, c]) for i, u in enumerate(features)) + float(net.p["bias"][c]) for c in range(len(net.classes))]
    e = [math.exp(x - max(logits)) for x in logits]
    return [x / sum(e) for x in e]


def texts(seed: int, sizes: list[int]) -> list[bytes]:
    r = random.Random(seed)
    return [bytes(r.choice(b"abcde \n.,\xc3\xa9") for _ in range(n)) for n in sizes]


SHAPES = [{"widths": (4,), "filters": 5, "block": 16, "chunk": 2, "with_max": True}, {"widths": (2, 3, 4), "filters": 3, "block": 16}, {"widths": (1, 5), "filters": 2, "block": 8, "chunk": 2}]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("paired", [False, True])
def test_forward_pass_in_plain_loops(shape, paired):
    net = ByteNet(["a", "b", "c"], **shape)
    some = texts(1, [0, 1, 3, 15, 16, 17, 31, 32, 33, 100, 260])
    at = np.concatenate([[0], np.cumsum([len(t) for t in some])]).astype(np.int64)
    got = net.probabilities(np.frombuffer(b"".join(some), dtype=np.uint8), at, {w: net._pairs(w) for w in net.widths} if paired else None)
    assert np.allclose(got, [chances(net, t) for t in some], atol=1e-5)


@pytest.mark.parametrize("shape", SHAPES)
def test_gradients_are_those_of_small_steps(shape):
    net = ByteNet([0, 1, 2], **shape)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    some, labels = texts(2, [40, 7, 70, 16]), np.array([0, 2, 1, 1])

    def loss() -> float:
        cross = -sum(math.log(chances(net, t)[y]) for t, y in zip(some, labels.tolist(), strict=True)) / len(some)
        return cross + 1e-4 / 2 * float((net.p["head"] ** 2).sum())

    r = random.Random(3)
    for name, g in net._gradients(some, labels).items():
        flat, strong = net.p[name].reshape(-1), np.flatnonzero(np.abs(g.reshape(-1)) > 1e-4).tolist()
        for i in r.sample(strong, min(6, len(strong))) + [r.randrange(flat.size)]:
            was, step = flat[i], 1e-6
            flat[i] = was + step
            up = loss()
            flat[i] = was - step
            down = loss()
            flat[i] = was
            assert (up - down) / (2 * step) == pytest.approx(float(g.reshape(-1)[i]), rel=5e-3, abs=2e-5), (name, i)


def test_scores_of_tables_in_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rare = docs.orderBy(F.length("text")).limit(3).unionByName(spark.createDataFrame([(-1, None, None), (-2, "", None), (-3, "été " * 200, None)], docs.schema))
    net = quality.train(docs, labels, per_label=40)
    rows = {r["doc_id"]: (r["text"] or "").encode() for r in rare.collect()}
    for r in quality.score(rare, net).collect():
        assert r["score"] == pytest.approx(chances(net, rows[r["doc_id"]])[1], abs=1e-4)
    net = language.train(docs, per_label=20)
    for r in language.identify(rare, net).collect():
        p = chances(net, rows[r["doc_id"]])
        best = (net.classes[int(np.argmax(p))], max(p)) if rows[r["doc_id"]] else ("und", 0.0)
        assert (r["lang_pred"], r["score"]) == (best[0], pytest.approx(best[1], abs=1e-4))


# -- pages ---------------------------------------------------------------------------------------------

CONTAINERS = ("article", "main", "section", "div", "td", "")


class Element:
    """An element of a made-up page: its children are elements and texts, (plain, linked, plain) each."""

    def __init__(self, tag: str, name: str, children: list):
        self.tag, self.name, self.children, self.parent = tag, name, children, None
        for c in children:
            if isinstance(c, Element):
                c.parent = self

    def html(self) -> str:
        inner = "".join(c.html() if isinstance(c, Element) else c[0] + (f'<a href="/x">{c[1]}</a>' if c[1] else "") + c[2] for c in self.children)
        return f'<{self.tag} class="{self.name}">{inner}</{self.tag}>' if self.tag else inner

    def out(self) -> bool:
        return self.tag in ("nav", "aside", "footer") or (self.name == "sidebar" and self.tag != "article") or (self.parent is not None and self.parent.out())

    def texts(self) -> list:
        """(element, place in it, text, linked characters) of each text under it, in page order."""
        found = []
        for i, c in enumerate(self.children):
            found += c.texts() if isinstance(c, Element) else [(self, i, " ".join("".join(c).split()), len(c[1].strip()))]
        return found

    def usable(self) -> list:
        return [t for t in self.texts() if t[2] and not t[0].out()]

    def share(self) -> tuple[int, int]:
        return sum(min(k, len(t)) for _, _, t, k in self.usable()), sum(len(t) for _, _, t, _ in self.usable())


def article(page: Element) -> str:
    """The main text of a page, by the definition of main_text."""
    order, points = [], {}
    for el, _, t, linked in page.usable():
        if len(t) < 25:
            continue
        worth = (1 + t.count(",") + min(len(t) // 100, 3)) * (1 - min(linked / len(t), 1))
        up = el if el.tag in CONTAINERS else el.parent
        for level in (1, 2, 3):
            if up is not None:
                if up not in points:
                    order.append(up)
                    points[up] = 25.0 if up.tag in ("article", "main") or up.name == "content" else 0.0
                points[up] += worth / level
                up = up.parent
    if not order:
        return "\n\n".join(t for _, _, t, _ in page.usable())
    final = lambda el: points[el] * (1 - el.share()[0] / max(el.share()[1], 1))
    best = max(order, key=final)
    kept = {(el, i) for el, i, _, _ in best.texts()}
    for i, c in enumerate(best.parent.children if best.parent else []):
        if not isinstance(c, Element):
            _, _, t, linked = next(x for x in best.parent.texts() if x[:2] == (best.parent, i))
            if len(t) >= 80 and linked < len(t) / 4:
                kept.add((best.parent, i))
        elif c is not best and not c.out():
            linked, chars = c.share()
            if (c.tag == "p" and chars >= 80 and linked < chars / 4) or (c.tag in ("h1", "h2") and chars) or (c in points and final(c) >= max(10.0, final(best) / 5)):
                kept |= {(el, j) for el, j, _, _ in c.texts()}
    return "\n\n".join(t for el, i, t, _ in page.usable() if (el, i) in kept)


def made_up(r: random.Random, depth: int) -> Element:
    def words(most: int) -> str:
        return "".join(r.choice(["word ", "comma, ", "longer word ", "and\n  so "]) for _ in range(r.randrange(most)))

    def text() -> tuple:
        return (r.choice(["", " ", words(30)]), r.choice(["", "", words(12)]), words(8))

    children, last = [], True
    for _ in range(r.randrange(1, 6)):
        kind = r.random()
        if kind < 0.2 and not last:
            children.append(text())
            last = True
            continue
        last = False
        if depth and kind < 0.6:
            children.append(made_up(r, depth - 1))
        else:
            children.append(Element(r.choice(["p", "p", "p", "h2"]), r.choice(["", "", "lead", "sidebar"]), [text()]))
    return Element(r.choice(["div", "div", "section", "article", "nav", "aside", "footer"]), r.choice(["", "", "x", "content", "sidebar"]), children)


def test_articles_by_their_definition():
    r, kept, empty = random.Random(6), 0, 0
    for _ in range(1500):
        page = Element("", "", [made_up(r, 3) for _ in range(r.randrange(1, 4))])
        want = article(page)
        assert html_text.main_text(page.html()) == want, page.html()
        kept += want.count("\n\n") + bool(want)
        empty += not want
    assert kept > 3000 and empty < 700
