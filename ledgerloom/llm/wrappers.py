"""HTML main text by wrapper induction.

1. Every page is parsed to a tree of block elements; runs of alike siblings fold into one node. The
   folded tree, written as a string, is the page's skeleton.
2. Per host, the most common skeleton is the base. Every distinct skeleton of the host is aligned
   with it by simple tree matching.
3. A block whose text stands at the same base node on nearly all different pages of a host (all of
   three to nine) is template; varying slots are content. Copies of one article count once. A page
   over three quarters of which would be template is a near copy and keeps its blocks, as do hosts of
   fewer than three different pages, where nothing can be induced.
4. Menus, page headers, footers, sidebars and forms go by element, besides any container whose class,
   id or role has a name made of mark words and layout words only ("comments", "cookie-box", but not
   "with-sidebar" or "promotion-history"). Headings, inline elements and what holds most of the text
   together with its heading are never marked. The root is the innermost of article, main part,
   marked container and body that holds at least half of the varying text; what is left inside it is
   the text.

Parsing runs page by page and alignment skeleton by skeleton, dealt by skeleton and not by host; all
counting is grouped aggregation, so a host with a third of all pages is no task of its own.

Defined results: a null or empty html, or a page without content, gives an empty text; pages without
a host share the host ''; repeated rows give repeated results; extra columns are ignored; an empty
table gives an empty table. Nothing is capped, neither the depth nor the number of nodes.
"""

from __future__ import annotations

import html as html_lib
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

#: Share of a host's different pages that must have a block in common, and how many such pages.
TEMPLATE_SHARE = 0.9
TEMPLATE_PAGES = 3
#: Sizes of pairs of subtrees that are remembered during one alignment.
MEMORY = 1_000_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S
)
#: Any attribute, so that no value is read as a name.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
#: Their insides are no markup and no text of the page.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "svg", "object", "canvas", "audio", "video", "head"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split()
)
#: Elements with spaces around them but no block of their own.
SPACED = {"br", "td", "th", "img", "wbr", "input", "option", "hr"}
#: An opening tag that ends these open elements first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}}
DROP_TAGS = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "select", "label", "fieldset", "search"}
DROP_WORDS = set(
    "ad ads adv advert adverts advertisement advertising advertorial adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices popup modal overlay newsletter subscribe subscription signup signin login sidebar sidenav rail widget widgets menu menubar nav"
    " navbar navigation breadcrumb breadcrumbs pager pagination masthead topbar toolbar footer colophon copyright share sharing social related"
    " recommended recommendations trending comment comments commentlist disqus replies reply respond responses complementary contentinfo search"
    " hidden outbrain taboola".split()
)
HEADER_WORDS = {"header", "banner", "siteheader"}
ROOT_WORDS = {"content", "article", "post", "entry", "story", "main"}
#: They say where a marked container is, not what is in it.
LAYOUT_WORDS = ROOT_WORDS | set(
    "area bar block body bottom box container footer group header holder inner item items left link links list middle module outer page panel"
    " right row section site slot top unit user reader wrap wrapper zone".split()
)
#: Elements that can be a marked container; a paragraph is one for adverts only.
CONTAINERS = {"div", "section", "aside", "ul", "ol", "dl", "table", "tbody", "tr", "td", "li", "header", "figure", "details", "center", "address", "article", "main", "blockquote"}
ADVERT_WORDS = {"ad", "ads", "advert", "advertisement", "sponsored"}


class _Node:
    __slots__ = ("label", "kids", "sig", "index")

    def __init__(self, label: str):
        self.label, self.kids, self.sig, self.index = label, [], -1, 0


class _Mark:
    """A container marked by its names: the text in it, and whether a title or article is."""

    __slots__ = ("outer", "amount", "titled", "void", "dropped")

    def __init__(self, outer: _Mark | None):
        self.outer, self.amount, self.titled, self.void, self.dropped = outer, 0, False, False, False


def _names(attributes: str) -> tuple[str, list[set[str]], bool]:
    """Name of the element, the words of each of its names (class, id, role), whether its role is main."""
    values = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)]
    values = [(k, v) for k, v in values if k in ("class", "id", "role")]
    name = next((v for k, v in values if k == "class"), "") or next((v for k, v in values if k == "id"), "")
    names = [x for _, v in values for x in v.split()]
    # camelCase, dashes, underscores and digits part words
    parted = [set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", x).lower())) - {""} for x in names]
    return re.sub(r"[^a-z-]+", "", name.lower().split(" ")[0] if name else ""), parted, any(k == "role" and "main" in v.lower().split() for k, v in values)


def _marked(tag: str, names: list[set[str]]) -> bool:
    words = ADVERT_WORDS | {"comment", "comments", "related", "recommended", "promo"} if tag in ("article", "main") else ADVERT_WORDS if tag == "p" else DROP_WORDS
    return (tag in CONTAINERS or tag == "p") and any(x & words and x <= words | LAYOUT_WORDS for x in names)


def _root_level(blocks: list[tuple[int, str, int]]) -> int:
    """The highest level that holds at least half of the text."""
    total = sum(len(t) for _, t, level in blocks if level >= 0)
    return next((k for k in (3, 2, 1) if 2 * sum(len(t) for _, t, level in blocks if level >= k) >= total), 0)


def _fold(node: _Node) -> str:
    """Signatures of all nodes, with runs of alike siblings folded; the skeleton."""
    known: dict[tuple, int] = {}
    order, stack = [], [node]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += x.kids
    for x in reversed(order):
        runs: list[tuple[int, bool]] = []
        for k in x.kids:
            if runs and runs[-1][0] == k.sig:
                runs[-1] = (k.sig, True)
            else:
                runs.append((k.sig, False))
        x.sig = known.setdefault((x.label, tuple(runs)), len(known))
    out: list[str] = []
    todo: list[str | tuple[_Node, str]] = [(node, "")]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        x, star = item
        out.append(x.label)
        if not x.kids:
            out.append(star)
            continue
        parts: list[str | tuple[_Node, str]] = []
        for k, kid in enumerate(x.kids):
            if k and kid.sig == x.kids[k - 1].sig:
                continue
            many = k + 1 < len(x.kids) and x.kids[k + 1].sig == kid.sig
            parts += [",", (kid, "*" if many else "")]
        todo += [")" + star, *reversed(parts[1:]), "("]
    return "".join(out)


def _number(node: _Node) -> None:
    """Preorder numbers over the folded tree; folded siblings share theirs."""
    at = 0
    leaders: list[tuple[_Node, _Node]] = []  # a folded node and the first of its run
    stack = [node]
    while stack:
        x = stack.pop()
        x.index = at
        at += 1
        firsts, prev = [], None
        for k in x.kids:
            if prev is not None and prev.sig == k.sig:
                leaders.append((k, prev))
            else:
                firsts.append(k)
                prev = k
        stack += firsts[::-1]
    while leaders:
        x, twin = leaders.pop()
        x.index = twin.index
        runs: list[_Node] = []
        for k in twin.kids:
            if not runs or runs[-1].sig != k.sig:
                runs.append(k)
        i, last = -1, None
        for k in x.kids:
            i += k.sig != last
            last = k.sig
            leaders.append((k, runs[i]))


def parse_page(page: str | None) -> tuple[str, list[tuple[int, str, int]]]:
    """(skeleton, blocks) of a page; a block is (node number, text, level), its level the highest
    level of content root in which it is content: 3 article, 2 main part, 1 marked container, 0 body,
    -1 never."""
    page = page or ""
    root = _Node("#")
    # (tag, node, dropped by element, level of content root, innermost marked container)
    stack: list[tuple[str, _Node, bool, int, _Mark | None]] = [("#", root, False, 0, None)]
    texts: list[str] = []
    blocks: list[tuple[_Node, str, int, _Mark | None]] = []
    marks: list[_Mark] = []
    inline_drop = 0
    inline_tag = ""

    def flush() -> None:
        if texts:
            text = " ".join(html_lib.unescape("".join(texts)).split())
            texts.clear()
            if text:
                _, node, drop, level, mark = stack[-1]
                blocks.append((node, text, -1 if drop else level, mark))
                if mark and not drop:
                    mark.amount += len(text)

    at, n = 0, len(page)
    lower = None
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not inline_drop:
            texts.append(page[at:lt])
        if lt == n:
            break
        m = TOKEN.match(page, lt)
        if not m:
            if not inline_drop:
                texts.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if inline_drop:  # inside a dropped inline element: only its own end counts
            if tag == inline_tag:
                inline_drop += -1 if closing else 1
            if tag not in BLOCK:
                continue
            inline_drop = 0
        if tag in RAW:
            if closing or attributes.endswith("/"):
                continue
            if lower is None:
                lower = page.lower()
                if len(lower) != n:  # letters whose lower case is longer
                    lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in page)
            end = lower.find("</" + tag, at)
            if end < 0:
                if tag == "head":
                    continue
                at = n
            else:
                gt = page.find(">", end)
                at = n if gt < 0 else gt + 1
            texts.append(" ")
            continue
        if tag not in BLOCK:
            if tag in SPACED:
                texts.append(" ")
            if closing or attributes.endswith("/"):
                continue
            if tag in DROP_TAGS and tag not in SPACED:
                inline_drop, inline_tag = 1, tag
            continue
        flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        ends = CLOSES.get(tag)
        for k in range(len(stack) - 1, 0, -1):
            open_tag = stack[k][0]
            if open_tag == "p" or ends and open_tag in ends:
                del stack[k:]
                break
            if open_tag in ("ul", "ol", "dl", "table", "div", "article", "section", "main"):
                break
        name, names, is_main = _names(attributes) if attributes else ("", [], False)
        _, parent, drop, level, mark = stack[-1]
        if tag not in ("html", "body"):
            drop = drop or tag in DROP_TAGS or level < 2 and (tag == "header" or any(x & HEADER_WORDS and x <= HEADER_WORDS | LAYOUT_WORDS for x in names))
            if mark and not drop and (tag in ("h1", "article", "main") or is_main):
                mark.titled = True
            if _marked(tag, names):
                mark = _Mark(mark)
                marks.append(mark)
            level = max(level, 3 if tag == "article" else 2 if tag == "main" or is_main else 1 if any(x and x <= ROOT_WORDS for x in names) else 0)
        node = _Node(f"{tag}.{name}" if name else tag)
        parent.kids.append(node)
        if tag != "hr" and not attributes.endswith("/"):
            stack.append((tag, node, drop, level, mark))
    flush()
    total = sum(len(text) for _, text, level, _ in blocks if level >= 0)
    for m in reversed(marks):
        m.void = m.titled and 2 * m.amount >= total or 10 * m.amount >= 9 * total
        if m.outer:
            m.outer.amount += m.amount
            m.outer.titled = m.outer.titled or m.titled
    for m in marks:
        m.dropped = not m.void or m.outer is not None and m.outer.dropped
    skeleton = _fold(root)
    _number(root)
    return skeleton, [(node.index, text, -1 if mark and mark.dropped else level) for node, text, level, mark in blocks]


def read_skeleton(skeleton: str) -> tuple[list[str], list[int]]:
    """Labels and parents of a skeleton's nodes, in preorder."""
    labels, parents, open_nodes = [], [], [-1]
    last = -1
    for part in re.findall(r"[(),]|[^(),]+", skeleton):
        if part == "(":
            open_nodes.append(last)
        elif part == ")":
            open_nodes.pop()
        elif part != "," and part != "*":
            last = len(labels)
            labels.append(part.rstrip("*"))
            parents.append(open_nodes[-1])
    return labels, parents


def tree_match(a: str, b: str) -> list[int]:
    """For each node of skeleton ``a`` the node of ``b`` that it is matched with, or -1.

    Simple tree matching: roots of equal label match, and their children's forests are aligned in
    order for the most matched nodes. Alike subtrees are compared once, equal ends of child lists are
    matched at once, and other child lists are halved (Hirschberg), so memory grows with the nodes
    and not with their pairs.
    """
    (la, pa_), (lb, pb) = read_skeleton(a), read_skeleton(b)
    if a == b:
        return list(range(len(la)))
    ka, kb = [[] for _ in la], [[] for _ in lb]
    for kids_of, parents in ((ka, pa_), (kb, pb)):
        for k, p in enumerate(parents):
            if p >= 0:
                kids_of[p].append(k)
    known: dict[tuple[str, tuple[int, ...]], int] = {}
    label: list[str] = []
    kids: list[tuple[int, ...]] = []
    count: list[int] = []

    def subtrees(labels: list[str], children: list[list[int]]) -> list[int]:
        out = [0] * len(labels)
        for x in range(len(labels) - 1, -1, -1):
            key = labels[x], tuple(out[k] for k in children[x])
            if key not in known:
                known[key] = len(label)
                label.append(key[0])
                kids.append(key[1])
                count.append(1 + sum(count[k] for k in key[1]))
            out[x] = known[key]
        return out

    ta, tb = subtrees(la, ka), subtrees(lb, kb)
    deepest = 0
    depth = [0] * len(la)
    for k, p in enumerate(pa_):
        depth[k] = depth[p] + 1 if p >= 0 else 1
        deepest = max(deepest, depth[k])
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 3 * deepest + 1000))  # ``size`` goes as deep as the tree
    memo: dict[tuple[int, int], int] = {}

    def size(c: int, d: int) -> int:
        if label[c] != label[d]:
            return 0
        if c == d:
            return count[c]
        if not kids[c] or not kids[d]:
            return 1
        found = memo.get((c, d))
        if found is None:
            a, b = kids[c], kids[d]
            lo, hi = ends(a, b)
            found = 1 + sum(count[k] for k in a[:lo]) + sum(count[k] for k in a[len(a) - hi :]) + last_row(a[lo : len(a) - hi], b[lo : len(b) - hi])[-1]
            if len(memo) >= MEMORY:
                memo.clear()
            memo[c, d] = found
        return found

    def ends(a, b) -> tuple[int, int]:
        """Lengths of the equal start and, after it, the equal end."""
        most = min(len(a), len(b))
        lo = next((k for k in range(most) if a[k] != b[k]), most)
        hi = next((k for k in range(most - lo) if a[-1 - k] != b[-1 - k]), most - lo)
        return lo, hi

    def last_row(a, b) -> list[int]:
        row = [0] * (len(b) + 1)
        alike = set(b)
        for c in a:
            sizes = {d: size(c, d) for d in alike}
            corner = 0
            for j, d in enumerate(b, 1):
                above = row[j]
                best = above if above >= row[j - 1] else row[j - 1]
                s = sizes[d]
                if s and corner + s > best:
                    best = corner + s
                row[j] = best
                corner = above
        return row

    def pairs(a, b) -> list[tuple[int, int]]:
        """The matched positions of two lists of subtrees."""
        found, todo = [], [(0, len(a), 0, len(b))]
        while todo:
            i, n, j, m = todo.pop()
            lo, hi = ends(a[i:n], b[j:m])
            found += [(i + k, j + k) for k in range(lo)] + [(n - 1 - k, m - 1 - k) for k in range(hi)]
            i, n, j, m = i + lo, n - hi, j + lo, m - hi
            if n - i < 1 or m - j < 1:
                continue
            if n - i == 1:
                s, at = max((size(a[i], b[k]), -k) for k in range(j, m))
                if s:
                    found.append((i, -at))
                continue
            half = (i + n) // 2
            front, back = last_row(a[i:half], b[j:m]), last_row(a[half:n][::-1], b[j:m][::-1])
            cut = j + max(range(m - j + 1), key=lambda k: front[k] + back[m - j - k])
            todo += [(i, half, j, cut), (half, n, cut, m)]
        return found

    out = [-1] * len(la)
    todo = [(0, 0)] if la and lb and la[0] == lb[0] else []
    while todo:
        x, y = todo.pop()
        if ta[x] == tb[y]:
            out[x : x + count[ta[x]]] = range(y, y + count[ta[x]])
            continue
        out[x] = y
        todo += [(ka[x][i], kb[y][j]) for i, j in pairs([ta[k] for k in ka[x]], [tb[k] for k in kb[y]]) if label[ta[ka[x][i]]] == label[tb[kb[y][j]]]]
    return out


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; '' where there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, host, skeleton, shape (its digest), digest (of the content), blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        kind = pa.list_(pa.struct([("n", pa.int32()), ("h", pa.int64()), ("t", pa.string()), ("l", pa.int32())]))
        for b in batches:
            skeletons, shapes, digests, blocks = [], [], [], []
            for page in b.column(3).to_pylist():
                skeleton, found = parse_page(page)
                kept = [b for b in found if b[2] >= 0]
                least = _root_level(kept)
                skeletons.append(skeleton)
                shapes.append(xxhash.xxh3_128_hexdigest(skeleton))
                digests.append(xxhash.xxh3_128_hexdigest("\n".join(t for _, t, level in kept if level >= least)))
                blocks.append([{"n": n, "h": xxhash.xxh3_64_intdigest(t) - (1 << 63), "t": t, "l": level} for n, t, level in kept])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(skeletons), pa.array(shapes), pa.array(digests), pa.array(blocks, kind)],
                names=["id", "url", "host", "skeleton", "shape", "digest", "blocks"],
            )

    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    schema = f"id {dict(slim.dtypes)['id']}, url string, host string, skeleton string, shape string, digest string, blocks array<struct<n:int,h:bigint,t:string,l:int>>"
    return arrow_map(slim, run, schema)


def induce_wrappers(parsed: DataFrame, share: float = TEMPLATE_SHARE, least_pages: int = TEMPLATE_PAGES) -> DataFrame:
    """host, shape, places (base node of each node), template (the constant (node, text hash) pairs)."""
    shapes = parsed.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.min("skeleton").alias("skeleton"))
    shapes = materialize(shapes, "shapes")
    base = shapes.groupBy("host").agg(F.max_by("skeleton", F.struct("n", "shape")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [tree_match(s, t) for s, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places, pa.list_(pa.int32()))], names=["host", "shape", "places"])

    # Dealt by skeleton: the skeletons of one host are aligned by many tasks.
    pairs = shapes.join(base, "host").select("host", "shape", "skeleton", "base").repartition("host", "shape")
    aligned = arrow_map(pairs, run, "host string, shape string, places array<int>")
    aligned = materialize(aligned, "aligned")
    slots = (
        parsed.select("host", "shape", "digest", F.transform("blocks", lambda x: F.struct(x["n"].alias("n"), x["h"].alias("h"))).alias("blocks"))
        .join(aligned, ["host", "shape"])
        .select("host", "digest", "places", F.explode("blocks").alias("b"))
        .select("host", "digest", F.element_at("places", F.col("b.n") + 1).alias("node"), F.col("b.h").alias("h"))
        .filter("node >= 0")
        .distinct()
    )
    common = slots.groupBy("host", "node", "h").agg(F.count(F.lit(1)).alias("seen")).filter(F.col("seen") >= least_pages * share)
    hosts = parsed.select("host", "digest").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least_pages)
    template = (
        common.join(hosts, "host")
        .filter(F.col("seen") >= share * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_set(F.struct("node", "h")).alias("template"))  # no more than the blocks of a page
    )
    return aligned.join(template, "host", "left").select("host", "shape", "places", F.coalesce("template", F.array().cast("array<struct<node:int,h:bigint>>")).alias("template"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """id, url, text, n_chars for every page."""
    parsed = materialize(parse_pages(pages, id_col, url_col, html_col), "parsed")
    wrappers = materialize(induce_wrappers(parsed, **options), "wrappers")
    def once(df: DataFrame, name: str, value: Column) -> DataFrame:
        """``value`` as a column that later expressions read instead of repeating it: a generator is no projection to merge with."""
        return df.select("*", F.explode(F.array(value)).alias(name))

    def length(blocks: Column) -> Column:
        return F.aggregate(blocks, F.lit(0), lambda a, b: a + F.length(b["t"]))

    constant = F.coalesce("template", F.array().cast("array<struct<node:int,h:bigint>>"))
    joined = once(parsed.join(wrappers, ["host", "shape"], "left"), "constant", constant)
    varying = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("constant", F.struct(F.element_at("places", b["n"] + 1).alias("node"), b["h"].alias("h"))), F.lit(False)))
    varying = F.when(F.size("constant") == 0, F.col("blocks")).otherwise(varying)
    chosen = F.when(4 * length(F.col("varying")) >= length(F.col("blocks")), F.col("varying")).otherwise(F.col("blocks"))
    rooted = once(once(joined, "varying", varying), "chosen", chosen)
    # Text at each level of root and above, in one pass.
    none = F.struct(*[F.lit(0).alias(f"l{k}") for k in range(4)])
    amounts = F.aggregate("chosen", none, lambda a, b: F.struct(*[(a[f"l{k}"] + F.when(b["l"] >= k, F.length(b["t"])).otherwise(0)).alias(f"l{k}") for k in range(4)]))
    rooted = once(rooted, "amounts", amounts)
    half = [2 * F.col(f"amounts.l{k}") >= F.col("amounts.l0") for k in range(4)]
    rooted = once(rooted, "root", F.when(half[3], 3).when(half[2], 2).when(half[1], 1).otherwise(0))
    text = F.array_join(F.transform(F.filter("chosen", lambda b: b["l"] >= F.col("root")), lambda b: b["t"]), "\n")
    return once(rooted, "main_text", text).select(F.col("id").alias(id_col), "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))
