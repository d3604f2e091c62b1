"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree; each is content or not.  A node has a unary potential (a
logistic model over its tag, the words of its attributes and its own text) and each
parent-child pair a 2 x 2 potential, which depends on whether the tags or attributes of the two name a
box (menu, header, advert, comments, ...).  Sum-product messages go up the tree and down again, which
gives exact marginals; the text of nodes with P(content) > 1/2 is the main text.

Training.  Labelled pages are (a) up to ``TRAIN_PAGES`` pages of the table that mark their article
(``article``, ``main``), the smallest hashes of the id with at most ``TRAIN_CHARS`` characters, and
(b) ``MADE_PAGES`` pages put together from named and unnamed containers with known labels, so that
pages without such marks are covered too.

Defined results: null and empty html give the empty text; text outside of any element belongs to
the root; unclosed and stray tags are repaired (see ``parse``); scripts, styles, templates and the
head have no text; repeated rows are rows of their own; an empty table gives an empty result.
"""
from __future__ import annotations

import math
import random
import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

TRAIN_PAGES, TRAIN_CHARS, MADE_PAGES, SEED = 1000, 50_000, 1500, 3

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr "
                   "math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom "
                   "mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
UNSEEN = frozenset("head script style template noscript svg iframe object canvas title textarea select option audio video".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                            "main menu nav ol p pre section table ul li dd dt td th tr".split()),
             "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
             "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
             "h1": frozenset(["p", "div"]), "h2": frozenset(["p", "div"]), "h3": frozenset(["p", "div"])}
SCOPE = frozenset("ul ol table body html div section article aside main nav header footer form td th blockquote dl".split())

# Groups of tags and of words in class, id and role that tell what a block is for.
TAGS = ("article main", "nav menu", "header", "footer", "aside", "form fieldset button dialog", "p blockquote pre", "h1 h2 h3 h4 h5 h6",
        "ul ol dl", "li dd dt", "table tbody thead tr td th", "div section", "figure figcaption")
WORDS = ("article post story entry content main body text prose maincontent",
         "nav navigation menu breadcrumb breadcrumbs toolbar tabs pagination pager skip",
         "header masthead banner topbar logo branding",
         "footer copyright legal colophon bottom credits",
         "sidebar aside widget related recommended rail trending popular tags",
         "ad ads advert advertisement adbox sponsor sponsored promo promotion",
         "cookie cookies notice consent gdpr alert popup modal overlay disclaimer warning",
         "form search login signup subscribe newsletter subscription contact",
         "comment comments reply replies discussion disqus respond feedback reviews",
         "share social sharing follow author byline meta toolbox")
_TAG_OF = {t: i for i, g in enumerate(TAGS) for t in g.split()}
_WORD_OF = {w: i for i, g in enumerate(WORDS) for w in g.split()}
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
N_KINDS = len(TAGS) + len(WORDS)
N_FEATURES = N_KINDS + 8
# Kinds that name a box: all but the tags of text and the words of articles.
BOXES = frozenset([_TAG_OF[t] for t in ("nav", "header", "footer", "aside", "form")] + [len(TAGS) + i for i in range(1, len(WORDS))])
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])


class _Tree(HTMLParser):
    """Block nodes in page order (a parent before its children) and the text runs of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.kinds = ["html"], [-1], [()]
        self.runs: list[list] = []                                # [node, text pieces, characters in links]
        self.stack: list[tuple[str, int]] = []                    # open elements and their nodes
        self.links = self.hidden = 0
        self.cut = False                                          # a block began or ended since the last text

    def _node(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def _pop_to(self, at: int) -> None:
        for tag, _ in self.stack[at:]:
            self.links -= tag == "a"
            self.hidden -= tag in UNSEEN
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD and self.stack and self.stack[-1][0] == "head":    # an unclosed head
            self._pop_to(len(self.stack) - 1)
        if tag in ("br", "hr"):
            self._text(" ")
        if tag in VOID:
            return
        if self.hidden and tag == "body":                         # an unclosed head
            self._pop_to(0)
        if tag not in INLINE:
            self.cut = True
            for i in range(len(self.stack) - 1, -1, -1):
                t = self.stack[i][0]
                if tag in CLOSED_BY.get(t, ()):
                    self._pop_to(i)
                    break
                if t in SCOPE:
                    break
        node = self._node()
        if tag not in INLINE and tag not in ("html", "body"):
            kinds = {_TAG_OF[tag]} if tag in _TAG_OF else set()
            for k, v in attrs:
                if v and k in ("class", "id", "role", "itemprop", "aria-label"):
                    kinds |= {len(TAGS) + _WORD_OF[w] for w in _SPLIT.split(_CAMEL.sub(" ", v).lower()) if w in _WORD_OF}
            self.tags.append(tag)
            self.parents.append(node)
            self.kinds.append(tuple(kinds))
            node = len(self.tags) - 1
        self.stack.append((tag, node))
        self.links += tag == "a"
        self.hidden += tag in UNSEEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br":
            self._text(" ")
        self.cut = self.cut or tag not in INLINE
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop_to(i)
                return

    def _text(self, data: str) -> None:
        if self.hidden:
            return
        node = self._node()
        if not self.runs or self.runs[-1][0] != node or self.cut:
            self.runs.append([node, [], 0])
        self.cut = False
        self.runs[-1][1].append(data)
        if self.links:
            self.runs[-1][2] += len(data)

    def handle_data(self, data):
        self._text(data)


def parse(html: str) -> _Tree:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree


def features(tree: _Tree) -> np.ndarray:
    """One row a node: the kinds of the node and measures of its own text.  What its ancestors are
    reaches it by the messages."""
    n = len(tree.tags)
    x = np.zeros((n, N_FEATURES))
    chars, links, words, ends, names = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for node, pieces, linked in tree.runs:
        text = "".join(pieces).strip()
        chars[node] += len(text)
        links[node] += linked
        words[node] += text.count(" ") + 1 if text else 0
        ends[node] += text[-1:] in ".!?…\"”»"
        if tree.tags[node] in _HEADINGS and text.count(" ") < 5:  # a heading that names a box
            names[node] = any(_WORD_OF.get(w, 0) > 0 for w in _SPLIT.split(text.lower()))
    for i in range(n):
        x[i, list(tree.kinds[i])] = 1
    c, w = np.array(chars, float), np.array(words, float)
    x[:, N_KINDS:] = np.stack([c == 0, np.minimum(1, np.array(links) / np.maximum(1, c)), np.log1p(w) / 5, (w > 0) & (w < 8),
                                   w > 25, np.array(ends) > 0, np.array(names) > 0, np.ones(n)], axis=1)
    return x


def article_labels(tree: _Tree) -> np.ndarray | None:
    """Labels of a page that marks its article: inside, and not in a block for something else."""
    if not {"article", "main"} & set(tree.tags):
        return None
    out = np.zeros(len(tree.tags))
    for i in range(1, len(out)):
        if BOXES & set(tree.kinds[i]):
            continue
        p = tree.parents[i]
        out[i] = tree.tags[i] in ("article", "main") or out[p]
    return out


def made_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page of known labels: (html, label of every block node in page order, the root first)."""
    syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    labels = [False]
    kinds = {"content": ["article", "main", "div class=content", "div id=main-content", "section class=post", "div class=entry-content",
                         "div class=article-body", "div", "section", "div class=story", "div class=x1", "td"],
             "links": ["nav", "div class=menu", "ul class=navigation", "div id=nav", "div class=breadcrumb", "div class=related", "aside",
                       "div class=sidebar", "div class=share", "div", "div class=pagination"],
             "short": ["header", "footer", "div class=header", "div id=footer", "div class=ad", "div class=advert", "div class=cookie-notice",
                       "div class=banner", "div class=copyright", "div role=alert", "div class=promo", "aside", "div class=sponsored"],
             "form": ["form", "div class=newsletter", "div class=search", "form class=login"],
             "comments": ["section id=comments", "section class=comments", "div class=comments", "div class=comment-list", "div class=comment",
                          "div class=replies", "div class=discussion", "div id=disqus_thread"]}
    names = {"comments": ["Comments", "Reader comments", "Replies", "Leave a reply", "Discussion"],
             "links": ["Related", "Related articles", "Share", "Popular", "Recommended"], "short": ["Advertisement", "Notice"], "form": ["Newsletter", "Subscribe"]}

    def p(label: bool, tag: str, a: int, b: int) -> str:
        labels.append(label)
        end = rng.choice(".....!?") if a > 4 else ""
        text = words(a, b).capitalize() + end
        r = rng.random()
        opened = f"{tag} class={rng.choice(['note', 'lead', 'intro', 'x2'])}" if label and r < 0.08 else tag
        if label and tag in ("p", "li") and r > 0.93:             # a paragraph that is one link
            text = f"<a href=#>{text}</a>"
        return f"<{opened}>{text}</{tag}>"

    def heading(kind: str) -> str:
        if rng.random() > 0.4:
            return ""
        tag = rng.choice(["h2", "h3", "h4"])
        labels.append(False)
        return f"<{tag}>{rng.choice(names[kind])}</{tag}>"

    def box(kind: str, inside: bool = False) -> str:
        before = heading(kind) if inside and rng.random() < 0.3 else ""      # next to its box
        opened = rng.choice(kinds[kind])
        labels.append(kind == "content")
        body = ""
        if kind == "content":
            if rng.random() < 0.8:
                body += p(True, rng.choice(["h1", "h2"]), 2, 10)
            for _ in range(rng.randint(1, 12)):
                r = rng.random()
                if r < 0.12:
                    body += box(rng.choice(["short", "links", "form", "comments"]), True)
                elif r < 0.18:
                    labels.append(True)
                    body += "<ul>" + "".join(p(True, "li", 3, 15) for _ in range(rng.randint(2, 4))) + "</ul>"
                elif r < 0.26:
                    body += p(True, rng.choice(["h2", "h3", "blockquote", "pre"]), 2, 12)
                else:
                    body += p(True, "p", *rng.choice([(1, 4), (2, 8), (1, 60), (5, 60), (15, 60)]))
        elif kind == "links":
            if rng.random() < 0.5:
                labels.append(False)
                body += "<ul>"
                for _ in range(rng.randint(2, 8)):
                    labels.append(False)
                    body += f"<li><a href=#>{words(1, 4)}</a></li>"
                body += "</ul>"
            else:
                body += " ".join(f"<a href=#>{words(1, 4)}</a>" for _ in range(rng.randint(2, 8)))
        elif kind == "form":
            body += p(False, "p", 2, 12) + "<input>" + p(False, "button", 1, 2)
        elif kind == "comments":
            body += heading(kind)
            if rng.random() < 0.4:                                # a list of comments
                labels.append(False)
                body += "<ul>"
                for _ in range(rng.randint(1, 4)):
                    labels.append(False)
                    body += "<li>" + (p(False, "p", 5, 50) if rng.random() < 0.6 else words(5, 50) + ".") + "</li>"
                body += "</ul>"
            else:
                for _ in range(rng.randint(1, 4)):
                    if rng.random() < 0.5:
                        labels.append(False)
                        body += "<div class=comment>" + p(False, "p", 5, 50) + "</div>"
                    else:
                        body += p(False, "p", 5, 50)
        else:
            body += p(False, "p", 3, 30) if rng.random() < 0.5 else words(3, 30) + "."
        return f"{before}<{opened}>{body}</{opened.split()[0]}>"

    bare = rng.random()
    if bare < 0.04:                                               # text without any element, or paragraphs alone
        return words(5, 80).capitalize() + ".", [True]
    if bare < 0.10:
        return "".join(p(True, "p", 5, 60) for _ in range(rng.randint(1, 6))), labels
    before = [box(rng.choice(["links", "short", "form"])) for _ in range(rng.randint(0, 4))]
    middle = [box("content")]
    after = [box(rng.choice(["links", "short", "comments", "form"])) for _ in range(rng.randint(0, 4))]
    return f"<html><body>{''.join(before + middle + after)}</body></html>", labels


class Model:
    """Unary weights and the log potentials of (parent label, child label)."""

    def __init__(self, pages: list[tuple[_Tree, np.ndarray]]):
        x = np.concatenate([features(t) for t, _ in pages])
        y = np.concatenate([y for _, y in pages])
        w = np.zeros(x.shape[1])
        for _ in range(25):                                       # Newton steps of the penalised logistic model
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (y - p) - 0.5 * w
            w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w)), grad)
        self.weights = w
        pairs = np.ones((2, 2, 2, 2))                             # parent and child name a box, their labels
        for t, lab in pages:
            box = [self.boxed(t, i) for i in range(len(lab))]
            for i in range(1, len(lab)):
                pairs[box[t.parents[i]], box[i], int(lab[t.parents[i]]), int(lab[i])] += 1
        # Against the children's own shares, which the unary potentials already hold.
        share = pairs.sum(axis=(0, 2)) / pairs.sum(axis=(0, 2, 3))[:, None]
        self.pair = (pairs / pairs.sum(axis=3, keepdims=True) / share[None, :, None, :]).tolist()

    @staticmethod
    def boxed(tree: _Tree, node: int) -> int:
        return int(not BOXES.isdisjoint(tree.kinds[node]))

    def marginals(self, tree: _Tree) -> list[float]:
        """P(content) of every node: messages from the leaves to the root, then back."""
        z = np.clip(features(tree) @ self.weights, -30, 30)
        unary = [(1.0, math.exp(v)) for v in z.tolist()]
        n, parents = len(unary), tree.parents
        box = [self.boxed(tree, i) for i in range(n)]
        pair = [self.pair[box[parents[i]]][box[i]] for i in range(n)]       # the root's is not used
        up, message = [list(u) for u in unary], [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            u0, u1 = up[i]
            (a, b), (c, d) = pair[i]
            m0, m1 = a * u0 + b * u1, c * u0 + d * u1             # sum over the child's label
            s = m0 + m1
            message[i] = (m0 / s, m1 / s)
            q = up[parents[i]]
            q[0], q[1] = q[0] * message[i][0], q[1] * message[i][1]
            s = q[0] + q[1]
            q[0], q[1] = q[0] / s, q[1] / s
        belief = [tuple(up[0])] + [(0.0, 0.0)] * (n - 1)
        for i in range(1, n):
            p0, p1 = belief[parents[i]]
            (a, b), (c, d) = pair[i]
            m0, m1 = message[i]
            p0, p1 = p0 / m0, p1 / m1                             # the parent without this child
            t0, t1 = a * p0 + c * p1, b * p0 + d * p1
            u0, u1 = up[i][0] * t0, up[i][1] * t1
            s = u0 + u1
            belief[i] = (u0 / s, u1 / s)
        return [q[1] / (q[0] + q[1]) for q in belief]

    def text(self, html: str) -> str:
        tree = parse(html)
        if not tree.runs:
            return ""
        keep = self.marginals(tree) if len(tree.tags) > 1 else [1.0]          # text without any block is the text
        blocks = (" ".join("".join(pieces).split()) for node, pieces, _ in tree.runs if keep[node] > 0.5)
        return " ".join(b for b in blocks if b)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Model:
    marked = pages.where(F.col(html_col).rlike("(?i)<(article|main)[ >]") & (F.length(html_col) <= TRAIN_CHARS)) \
        .select(F.col(id_col).cast("string").alias("id"), F.xxhash64(id_col).alias("h"))
    chosen = marked.orderBy("h", "id").limit(TRAIN_PAGES)         # at most TRAIN_PAGES ids
    rows = pages.join(F.broadcast(chosen.distinct()), (F.col(id_col).cast("string").eqNullSafe(F.col("id")))) \
        .where((F.length(html_col) <= TRAIN_CHARS)).select("h", F.col(html_col).alias("html")).orderBy("h", "html").limit(TRAIN_PAGES).collect()
    labelled = []
    for r in rows:
        tree = parse(r["html"])
        y = article_labels(tree)
        if y is not None:
            labelled.append((tree, y))
    rng = random.Random(SEED)
    for _ in range(MADE_PAGES):
        html, y = made_page(rng)
        labelled.append((parse(html), np.array(y, float)))
    return Model(labelled)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Id, ``keep`` columns, ``text`` and ``n_chars`` of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(train(pages, id_col, html_col))
    names = [id_col, *keep]

    def rows(batches):
        model = sent.value
        for b in batches:
            texts = [model.text(h) if h else "" for h in b["_html"]]
            yield {c: b[c] for c in names} | {"text": texts, "n_chars": [len(t) for t in texts]}

    d = pages.select(*names, F.col(html_col).cast("string").alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return map_rows(d, f"{schema}, text string, n_chars long", rows)
