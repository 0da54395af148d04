"""Main text of web pages by wrapper induction over pages of one host.

Each page becomes a tree of block elements; a run of like siblings (list items, paragraphs) is one
iterator node. A host has up to REFERENCES reference pages, one of each of its commonest shapes, so
that an error page or another layout doesn't stand for all. Every page is aligned by simple tree
matching with the reference that it matches best; what stands at each reference node is counted over
all different page trees of the host: copies of a page count once.

A node that nearly always has the same text is template. Of the varying slots the main one is found
by the varying text without links that stands in it over all pages: from the root down, as long as one child
holds most of it, no sibling holds a headline, and the child isn't plain text. A page's content is
what its tree has at the main slot, found by aligning it anew; menus, adverts and footers stand
beside that slot whatever their tags and words. Pages without it, and hosts of one page, rely on
evidence: tags that say what they are (menus, asides, ...) are never content; a class, id or role
that names such a part drops an element unless that holds most of the page's text, beside other words
only if the element is mostly links. Where such a page marks its article, content lies inside it,
unless that has little of the page's text.

A host's counts are sums over trees, so a host that holds a third of all pages is spread over all
tasks; a join with the hosts' wrappers is broadcast only if their written table is small.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, prepare

#: A template text stands on this many different page trees of its host at least, and on this share of those aligned there.
LEAST_PAGES = 5
LEAST_SHARE = 0.8
REFERENCES = 3
#: A main slot is told from so many different page trees at least.
SLOT_PAGES = 2
#: Shares of a page's text from which an element is kept whatever its class says; and of links in an element that count as proof.
MOST_TEXT = 0.5
MOST_COMMENTS = 0.8
LINKS = 0.5
#: Share of the text that evidence leaves from which a page's marked article is taken for its content.
LEAST_MARKED = 0.25
#: Cells of an alignment table that stand in memory at once; larger ones are split.
CELLS = 1 << 20

# Fixed word lists of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head script style noscript template iframe svg nav footer aside button select option textarea input title object embed canvas dialog menu".split())
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript template".split())
MAIN = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("td", "th", "tr", "thead"), "tfoot": ("td", "th", "tr", "tbody")}
SCOPE = frozenset("ul ol dl table article main body html section div nav footer aside".split())
# Words of class, id and role that name a part of a page which isn't its article.
NOISE = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|cookies?|disqus|footer|form|header|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|pagination|pager|popup|promo\w*|related|repl(?:y|ies)|search|share|sharing|sidebar|skip|social|sponsor\w*|subscribe|toolbar|widget",
    re.I,
)
COMMENTS = frozenset("comment comments disqus reply replies".split())
HEADERS = frozenset("banner header masthead".split())
# Words beside them that leave their meaning as it is.
BESIDE = frozenset("a an and area article articles bar block blog body bottom box button buttons col column container content fixed floating global google group icon icons inline inner item items left link links list main message outer page pane panel post posts primary reader right row secondary section site slot sticky stories story text the top unit user wrap wrapper".split())
# Words that say that a header is the article's own.
OWN_HEADER = frozenset("article entry post story content".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+))?)*+)>", re.S)
#: As HTML reads attributes: a quote inside an unquoted value is a character.
ATTR = re.compile(r"(?:^|[\s/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: What a class says: nothing; a noise word beside others; noise; readers' comments; a header; the article's own header.
PLAIN, WEAK, STRONG, TALK, HEADER, HEADLINE = range(6)


class Node:
    __slots__ = ("label", "tag", "noise", "kids", "texts", "chars", "links")

    def __init__(self, tag: str, label: str, noise: int):
        self.tag, self.label, self.noise = tag, label, noise
        self.kids: list[Node] = []
        self.texts: list[str] | None = None
        self.chars = self.links = 0


def evidence(value: str) -> int:
    """What the words of a class, id or role say; beside a token that means something else, noise is only weak.

    Tokens with digits mean nothing (they are mostly made by tools).
    """
    out = PLAIN
    tokens = [({w.lower() for w in WORDS.findall(t)}, t) for t in value.split() if not re.search(r"\d", t)]
    other = any(words and not words <= BESIDE and not any(NOISE.fullmatch(w) for w in words) and not words & OWN_HEADER for words, _ in tokens)
    for words, _ in tokens:
        noise = {w for w in words if NOISE.fullmatch(w)}
        if not noise:
            continue
        if not words - noise <= BESIDE and not (noise <= HEADERS and words & OWN_HEADER):
            got = WEAK
        elif noise & COMMENTS:
            got = TALK
        elif noise <= HEADERS:
            got = HEADLINE if words & OWN_HEADER else HEADER
        else:
            got = STRONG
        if other and got == STRONG:
            got = WEAK
        out = max(out, got, key=lambda e: (e in (STRONG, TALK), e))
    return out


def _attributes(text: str) -> tuple[str, int]:
    if "=" not in text:
        return "", PLAIN
    found = [(k.lower(), a or b or c) for k, a, b, c in ATTR.findall(text)]
    noise = max((evidence(v) for _, v in found), key=lambda e: (e in (STRONG, TALK), e), default=PLAIN)
    return "".join(f".{v}" for k, v in found if k == "class"), noise


def parse(html: str) -> Node:
    """The tree of block elements; text stands in leaf nodes `#`. Unclosed and crossed tags are mended.

    An element that closes itself (`/>`) is empty, in svg and math as elsewhere; what stands in svg is
    dropped by its tag later. A quote that isn't closed ends with its tag.
    """
    root = Node("#root", "#root", PLAIN)
    stack = [root]
    buffer: list[str] = []
    linked: list[str] = []
    in_link = False

    def flush() -> None:
        if not buffer:
            return
        text = " ".join(entities.unescape("".join(buffer)).split())
        links = sum(len(x) for x in linked)
        buffer.clear()
        linked.clear()
        if text:
            if stack[-1].tag == "head":  # text ends the head
                stack.pop()
            leaf = Node("#", "#", PLAIN)
            leaf.texts, leaf.chars, leaf.links = [text], len(text), min(links, len(text))
            stack[-1].kids.append(leaf)

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        end = n if m is None else m.start()
        if end > at:
            buffer.append(html[at:end])
            if in_link:
                linked.append(html[at:end].strip())
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                buffer.append(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                in_link = in_link and tag != "a"
                continue
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in INLINE:
            if tag == "br":
                buffer.append(" ")
            in_link = in_link or tag == "a"
            continue
        flush()
        in_link = False
        if tag not in IN_HEAD:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "head":  # any other tag ends the head
                    del stack[i:]
                    break
                if stack[i].tag == "body":
                    break
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = close.end() if close else n
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            stack.pop()
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE:
                    break
        label, noise = _attributes(m[3] or "")
        if tag in ("html", "body", "main") or (tag == "article" and noise != TALK):
            noise = PLAIN
        node = Node(tag, tag + label, noise)
        stack[-1].kids.append(node)
        if tag not in VOID and not (m[3] or "").endswith("/"):
            stack.append(node)
    flush()
    order = [root]
    for node in order:
        order += node.kids
    for node in reversed(order):
        for k in node.kids:
            if k.tag not in NEVER:
                node.chars += k.chars
                node.links += k.links
    return root


def groups(node: Node):
    """The kids of a node as (label, nodes): a run of like elements that hold nothing but text is one group."""
    label, run = "", []
    for k in node.kids:
        leaf = bool(k.kids) and k.tag not in MAIN and all(x.tag == "#" for x in k.kids)
        if run and not (leaf and k.label + "*" == label):
            yield label, run
            run = []
        if leaf:
            label = k.label + "*"
            run.append(k)
        else:
            yield k.label, [k]
    if run:
        yield label, run


def _strings(node: Node) -> list[str]:
    return [t for x in node.kids for t in x.texts or ()]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()[:8], "little", signed=True)


def _group_hash(label: str, nodes: list[Node]) -> int | None:
    if label.endswith("*"):
        return _hash("\n".join("".join(_strings(k)) for k in nodes))
    return _hash("".join(nodes[0].texts)) if nodes[0].texts else None


def skeleton(root: Node, members: list | None = None) -> list[list]:
    """[labels, parents, text hashes, characters outside links, evidence against it] of groups in document order.

    The first is the root. members takes the nodes of each group.
    """
    labels, parents, hashes, texts, against = [], [], [], [], []
    todo = [(-1, root.label, [root])]
    while todo:
        parent, label, nodes = todo.pop()
        at = len(labels)
        labels.append(label)
        parents.append(parent)
        hashes.append(_group_hash(label, nodes))
        texts.append(sum(k.chars - k.links for k in nodes))
        against.append(int(nodes[0].tag in NEVER or nodes[0].tag == "form" or nodes[0].noise in (STRONG, TALK)))
        if members is not None:
            members.append(nodes)
        if hashes[-1] is None:
            todo += [(at, *g) for g in reversed(list(groups(nodes[0])))]
    return [labels, parents, hashes, texts, against]


class Shapes:
    """Simple tree matching: the largest number of node pairs that keep order and ancestors.

    Subtrees of one shape share a class; a pair of classes is weighed once. Equal heads and tails of
    two child lists are matched at once; what is left is a table whose rows are numpy arrays, split
    in halves where it would hold more than CELLS.
    """

    def __init__(self):
        self.known: dict = {}
        self.labels: list[str] = []
        self.kids: list[tuple] = []
        self.sizes: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}

    def classes(self, tree: list) -> list[int]:
        """Class of each node of a skeleton."""
        labels, parents = tree[:2]
        kids: list[list[int]] = [[] for _ in labels]
        out = [0] * len(labels)
        for i in range(len(labels) - 1, -1, -1):
            key = labels[i], tuple(out[k] for k in reversed(kids[i]))
            if key not in self.known:
                self.known[key] = len(self.labels)
                self.labels.append(key[0])
                self.kids.append(key[1])
                self.sizes.append(1 + sum(self.sizes[k] for k in key[1]))
            out[i] = self.known[key]
            if parents[i] >= 0:
                kids[parents[i]].append(i)
        return out

    def _value(self, x: int, y: int) -> int:
        if x == y:
            return self.sizes[x]
        return self.weights[x, y] if self.labels[x] == self.labels[y] else 0

    def _row(self, xs, ys) -> np.ndarray:
        """The last row of the table of xs against ys."""
        return self._table(xs, ys, False)

    def _table(self, xs, ys, whole: bool) -> np.ndarray:
        different, inverse = np.unique(np.array(ys), return_inverse=True)
        row = np.zeros(len(ys) + 1, np.int64)
        rows, worth = [row], {}
        for x in xs:
            if x not in worth:
                worth[x] = np.array([self._value(x, y) for y in different.tolist()])[inverse]
            row = np.concatenate([[0], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + worth[x]))])
            if whole:
                rows.append(row)
        return np.stack(rows) if whole else row

    def weigh(self, x: int, y: int) -> int:
        """Matched nodes of two subtrees."""
        todo = [(x, y)]
        while todo:
            a, b = todo[-1]
            if a == b or self.labels[a] != self.labels[b] or (a, b) in self.weights:
                todo.pop()
                continue
            xs, ys, head, tail = _trim(self.kids[a], self.kids[b])
            missing = [(u, v) for u in set(xs) for v in set(ys) if u != v and self.labels[u] == self.labels[v] and (u, v) not in self.weights]
            if missing:
                todo += missing
                continue
            same = sum(self.sizes[k] for k in (*self.kids[a][:head], *self.kids[a][len(self.kids[a]) - tail :]))
            self.weights[a, b] = 1 + same + (int(self._row(xs, ys)[-1]) if xs and ys else 0)
            todo.pop()
        return self._value(x, y)

    def _match(self, xs, ys):
        """Places of matched members of two child lists."""
        todo = [(0, tuple(xs), 0, tuple(ys))]
        while todo:
            i, xs, j, ys = todo.pop()
            n, m = len(xs), len(ys)
            xs, ys, head, tail = _trim(xs, ys)
            yield from ((i + k, j + k) for k in range(head))
            yield from ((i + n - k, j + m - k) for k in range(1, tail + 1))
            i, j = i + head, j + head
            if not xs or not ys:
                continue
            if len(xs) > 1 and len(xs) * len(ys) > CELLS:
                half = len(xs) // 2
                front, back = self._row(xs[:half], ys), self._row(xs[: half - 1 : -1], ys[::-1])
                cut = int(np.argmax(front + back[::-1]))
                todo += [(i, xs[:half], j, ys[:cut]), (i + half, xs[half:], j + cut, ys[cut:])]
                continue
            table = self._table(xs, ys, True)
            a, b = len(xs), len(ys)
            while a and b:
                if table[a, b] == table[a - 1, b]:
                    a -= 1
                elif table[a, b] == table[a, b - 1]:
                    b -= 1
                else:
                    a, b = a - 1, b - 1
                    yield i + a, j + b

    def align(self, a: list, b: list) -> list[tuple[int, int]]:
        """Places of matched nodes of two skeletons."""
        xs, ys = self.classes(a), self.classes(b)
        if not self.weigh(xs[0], ys[0]):
            return []
        kids_a, kids_b = _kids(a), _kids(b)
        out, todo = [], [(0, 0)]
        while todo:
            i, j = todo.pop()
            if xs[i] == ys[j]:
                out += [(i + k, j + k) for k in range(self.sizes[xs[i]])]
                continue
            out.append((i, j))
            p, q = kids_a[i], kids_b[j]
            todo += [(p[u], q[v]) for u, v in self._match([xs[k] for k in p], [ys[k] for k in q]) if self._value(xs[p[u]], ys[q[v]])]
        return out


def _trim(xs, ys):
    """Two lists without their equal heads and tails, and how long these are."""
    least = min(len(xs), len(ys))
    head = next((k for k in range(least) if xs[k] != ys[k]), least)
    tail = next((k for k in range(least - head) if xs[-1 - k] != ys[-1 - k]), least - head)
    return xs[head : len(xs) - tail], ys[head : len(ys) - tail], head, tail


def _kids(tree: list) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in tree[0]]
    for i, p in enumerate(tree[1]):
        if p >= 0:
            out[p].append(i)
    return out


class Template:
    """What is known of a host: template texts, as places of label paths and (place, hash) pairs, and references with their main slots."""

    def __init__(self, paths=(), texts=(), refs=(), mains=()):
        self.paths = {(p, label): i for i, (p, label) in enumerate(paths)}
        self.texts = {tuple(t) for t in texts}
        self.refs, self.mains = list(refs), list(mains)

    def main(self, tree: list, shapes: Shapes) -> int:
        """The node of a page's skeleton at the main slot of the reference that it matches best, or -1."""
        if not any(m >= 0 for m in self.mains):
            return -1
        top = shapes.classes(tree)[0]
        weights = [shapes.weigh(shapes.classes(r)[0], top) for r in self.refs]
        best = weights.index(max(weights))
        if self.mains[best] < 0 or not max(weights):
            return -1
        return next((j for i, j in shapes.align(self.refs[best], tree) if i == self.mains[best]), -1)

    def place(self, tree: list, node: int) -> int:
        """The place of the label path to a node's parent."""
        chain, node = [], tree[1][node]
        while node >= 0:
            chain.append(tree[0][node])
            node = tree[1][node]
        out = -1
        for label in reversed(chain):
            out = self.paths.get((out, label), -2)
        return out


def main_slot(tree: list, texts: dict[int, int], pages: dict[int, int]) -> int:
    """The main slot of a reference: texts has the varying text that stood at its nodes over all pages, pages their number; -1 where there is none."""
    labels, parents, _, _, against = tree
    kids = _kids(tree)
    headed = [label.startswith("h1") for label in labels]
    for i in range(len(labels) - 1, 0, -1):
        headed[parents[i]] |= headed[i] and not against[i]
    node = 0
    while True:
        inner = [k for k in kids[node] if not against[k]]
        best = max(inner, key=lambda k: texts.get(k, 0), default=None)
        if best is None or labels[best] == "#" or labels[best].endswith("*"):
            break
        if texts.get(best, 0) <= 0 or texts[best] < MOST_TEXT * texts.get(node, 0) or any(headed[k] for k in inner if k != best):
            break
        node = best
    outer = labels[node].split(".")[0] in ("#root", "html", "body")
    return -1 if outer or pages.get(node, 0) < SLOT_PAGES else node


def template_of(refs: list, constants: list[tuple[int, int, int]]) -> list:
    """[paths, texts] of constants (reference, node, hash), as Template takes them."""
    paths: dict = {}
    texts = set()
    for ref, node, value in constants:
        labels, parents = refs[ref][:2]
        chain = []
        while node >= 0:
            chain.append(labels[node])
            node = parents[node]
        place = -1
        for label in reversed(chain):
            place = paths.setdefault((place, label), len(paths))
        texts.add((place, value))
    return [list(paths), sorted(texts)]


def _dropped(node: Node, inside: bool, total: int) -> bool:
    """Whether tag and class say that an element isn't part of the article."""
    if node.tag in NEVER or (node.tag == "header" and not inside):
        return True
    noise = STRONG if node.tag == "form" else node.noise
    if noise == PLAIN or noise == HEADLINE or (noise == HEADER and inside):
        return False
    if node.chars > (MOST_COMMENTS if noise == TALK else MOST_TEXT) * total:
        return False
    return noise != WEAK or node.links >= LINKS * node.chars


def blocks(root: Node, template: Template | None = None, shapes: Shapes | None = None) -> list[str]:
    """Texts of content blocks in page order."""
    template = template or Template()
    out: list[str] = []
    marked: list[str] = []
    todo = [(root.label, [root], -1, False)]
    main = -1
    if template.refs:
        members: list = []
        tree = skeleton(root, members)
        main = template.main(tree, shapes or Shapes())
        if main >= 0:
            todo = [(tree[0][main], members[main], template.place(tree, main), True)]
    start = todo[0][1][0]
    while todo:
        label, nodes, place, inside = todo.pop()
        place = template.paths.get((place, label), -2)
        value = _group_hash(label, nodes)
        if value is not None:
            if (place, value) in template.texts:
                continue
            for k in nodes:
                if k.tag == "#" or not _dropped(k, inside, root.chars):
                    text = " ".join(k.texts or _strings(k))
                    out.append(text)
                    if inside:
                        marked.append(text)
            continue
        node = nodes[0]
        if node is not start and _dropped(node, inside, root.chars):
            continue
        inside = inside or node.tag in MAIN
        todo += [(*g, place, inside) for g in reversed(list(groups(node)))]
    own, all_ = sum(map(len, marked)), sum(map(len, out))
    return marked if marked and (main >= 0 or own >= LEAST_MARKED * all_) else out


# --- the operator ----------------------------------------------------------------------------


def host_of(url: str = "url"):
    """Lower-case host without user and port; empty where there is none."""
    authority = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


def _skeletons(batches):
    for batch in batches:
        trees = [skeleton(parse(x or "")) for x in batch.column("html").to_pylist()]
        shapes = [_hash(json.dumps(t[:2])) for t in trees]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("pick"), pa.array(shapes, pa.int64()), pa.array([json.dumps(t, separators=(",", ":")) for t in trees], pa.string())], names=["host", "pick", "shape", "tree"])


def _aligned(batches):
    """(host, refs, tree) -> (host, ref, node, hash, text): what a page has at the nodes of the reference that it matches best."""
    refs: dict[str, list] = {}
    shapes = Shapes()
    for batch in batches:
        found = []
        for host, trees, tree in zip(*(batch.column(c).to_pylist() for c in ("host", "refs", "tree")), strict=True):
            if len(refs) > 1000 or len(shapes.labels) + len(shapes.weights) > 500_000:
                refs, shapes = {}, Shapes()
            if host not in refs:
                refs[host] = [json.loads(t) for t in trees]
            own = json.loads(tree)
            top = shapes.classes(own)[0]
            weights = [shapes.weigh(shapes.classes(r)[0], top) for r in refs[host]]
            best = weights.index(max(weights))
            found += [(host, best, i, own[2][j], own[3][j]) for i, j in shapes.align(refs[host][best], own)]
        columns = list(zip(*found, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["host", "ref", "node", "hash", "text"])


def _templates(batches):
    for batch in batches:
        out = []
        for refs, slots in zip(batch.column("refs").to_pylist(), batch.column("slots").to_pylist(), strict=True):
            trees = [json.loads(r) for r in refs]
            texts: list[dict] = [{} for _ in trees]
            pages: list[dict] = [{} for _ in trees]
            for x in slots:
                texts[x["ref"]][x["node"]], pages[x["ref"]][x["node"]] = x["text"], x["pages"]
            for x in slots:
                node = x["node"] if x["hash"] is not None else -1
                while node >= 0:  # what is the same on all pages is no content
                    texts[x["ref"]][node] -= x["text"]
                    node = trees[x["ref"]][1][node]
            mains = [main_slot(*t) for t in zip(trees, texts, pages, strict=True)]
            known = template_of(trees, [(x["ref"], x["node"], x["hash"]) for x in slots if x["hash"] is not None])
            out.append(json.dumps([*known, [t[:2] for t in trees], mains], separators=(",", ":")))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], names=["host", "template"])


def induce(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """pages(url, html) -> (host, template): label paths and text hashes of each host's template nodes, references and main slots.

    Null html is an empty page, null urls form one host without name; repeated rows and copies count
    once; every host gives a row, so an empty table gives none; other columns aren't read.
    """
    prepare(pages.sparkSession)
    named = pages.select(host_of().alias("host"), F.xxhash64("url", "html").alias("pick"), "html")
    shown = named.mapInArrow(_skeletons, "host string, pick long, shape long, tree string")
    # Copies of a page say nothing about which of its texts are template.
    once = shown.groupBy("host", F.md5("tree").alias("key")).agg(F.min(F.struct("pick", "shape", "tree")).alias("r"))
    trees = materialise(once.select("host", "r.pick", "r.shape", "r.tree"), "page-trees")
    common = trees.groupBy("host", "shape").agg(F.count("*").alias("n"), F.min(F.struct("pick", "tree")).alias("r"))
    # Each task keeps its own first rows of a host before they meet (a limit inside the window).
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "r.pick", "shape"))
    top = common.withColumn("rank", rank).where(F.col("rank") <= REFERENCES)
    refs = top.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "r.tree"))), lambda r: r["tree"]).alias("refs"))
    refs = materialise(refs, "host-references")
    aligned = trees.join(refs, "host").select("host", "refs", "tree").mapInArrow(_aligned, "host string, ref int, node int, hash long, text long")
    counts = aligned.groupBy("host", "ref", "node", "hash").agg(F.count("*").alias("n"), F.sum("text").alias("text"))
    top = F.max(F.when(F.col("hash").isNotNull(), F.struct("n", "hash"))).alias("top")
    nodes = counts.groupBy("host", "ref", "node").agg(top, F.sum("n").alias("pages"), F.sum("text").alias("text"))
    constant = (F.col("top.n") >= least_pages) & (F.col("top.n") >= least_share * F.col("pages"))
    slot = F.struct("ref", "node", F.when(constant, F.col("top.hash")).alias("hash"), "pages", "text")
    slots = nodes.groupBy("host").agg(F.sort_array(F.collect_list(slot)).alias("slots"))  # at most REFERENCES pages' nodes
    return materialise(refs.join(slots, "host").mapInArrow(_templates, "host string, template string"), "wrappers")


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """All columns of pages(url, html, ...) with main_text and main_chars.

    Null html gives an empty text, null urls form one host without name, hosts of one page and pages
    without their host's main slot rely on what tags and classes say; repeated rows give equal results; very long
    and deep pages are read whole; an empty table stays empty; columns named like the new ones, in
    any case, are replaced.
    """
    prepare(pages.sparkSession)
    names = [c for c in pages.columns if c.lower() not in ("main_text", "main_chars", "__host", "__template")]
    page = next(c for c in names if c.lower() == "html")
    kept = pages.select(*[F.col(f"`{c}`") for c in names], host_of().alias("__host"))
    joined = kept.join(wrappers.select(F.col("host").alias("__host"), F.col("template").alias("__template")), "__host", "left").select(*[f"`{c}`" for c in names], "__host", "__template")
    schema = T.StructType([*[joined.schema[c] for c in names], T.StructField("main_text", T.StringType()), T.StructField("main_chars", T.LongType())])

    def run(batches):
        known: dict[str, Template] = {}
        shapes = Shapes()
        for batch in batches:
            texts = []
            for html, host, template in zip(*(batch.column(c).to_pylist() for c in (page, "__host", "__template")), strict=True):
                if host not in known:
                    if len(known) > 1000:
                        known.clear()
                if len(shapes.labels) + len(shapes.weights) > 500_000:
                    shapes = Shapes()
                if host not in known:
                    known[host] = Template(*json.loads(template)) if template is not None else Template()
                texts.append("\n\n".join(blocks(parse(html or ""), known[host], shapes)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "main_text", "main_chars"])

    return joined.mapInArrow(run, schema)
