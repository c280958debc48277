"""Main-text extraction with site style trees.

Every page becomes a tree of elements named by tag, class and id.  The trees of a
host are merged: a style node is a path of names, with the pages that have it, the
sequences of children it shows (presentation) and the hashed texts directly in it
(content).  Following the published definition,

    presentation importance = entropy of the child sequences, base m (its pages)
    content importance      = 1 - mean entropy of its texts over the pages, base m
    importance = (1 - g^l) * presentation + g^l * content,   l kinds of children

and a single text that comes back on the pages of its node has the importance
1 - log(c) / log(m).  A block's importance is the smaller one of its node and of its
text; 1 while the host has too few pages to tell.

What a page declares is a prior that scales this importance, since menus that vary
from page to page have a high entropy and would stay:

* navigation, footer, aside, form, advert, notice and comment elements: 0;
* elements whose names only hint at such (``side-effects``, ``legal``), buttons: WEAK;
* text outside of ``article``/``main`` on a page that has them: (1 - s)^2, s being their
  share of the page's text (a teaser in ``main`` leaves the story beside it);
* text in ``article``/``main``: 1, and it takes more pages and a lower importance to go.

Blocks under ``LEAST`` (``LEAST_IN`` in ``article``/``main``) are removed.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, plus, table

GAMMA, LEAST, LEAST_PAGES, WEAK = 0.9, 0.2, 3, 0.5
#: in article and main: removed under this importance, told from so many pages
LEAST_IN, LEAST_PAGES_IN = 0.05, 8
#: paths longer than this go on as a digest of the path and the rest
LONG = 240
#: what may be removed (a path of at most 304 characters and 28 bytes of numbers) is sent to every executor up to this
#: counted number of hosts and of entries in all (under 170 MB), else joined by shuffle
FEW_HOSTS, FEW_ENTRIES = 50_000, 500_000
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
#: fixed values: HTML element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg title head select option object canvas audio video annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mover mroot mrow ms msqrt mstyle msub msubsup msup mtext munder munderover q rp rt ruby s samp semantics small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
STOP = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table", "tr")), "th": frozenset(("table", "tr")), "tbody": frozenset(("table",)), "thead": frozenset(("table",)), "tfoot": frozenset(("table",))}
NOISE_TAGS = frozenset("nav footer aside form dialog menu search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promoted nav navbar navigation menu submenu breadcrumb breadcrumbs topbar toolbar sidebar side aside "
    "footer foot header masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended "
    "recommendations comment comments commentlist reply replies respond disqus discussion form search searchbox pagination pager widget copyright legal skip".split()
)
#: of these, those that say enough inside of an article
NOISE_IN = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored promo promotion promoted nav navbar navigation submenu breadcrumb breadcrumbs sidebar cookie cookies "
    "gdpr popup newsletter subscribe signup share sharing related recommended recommendations comment comments commentlist reply replies respond disqus pagination pager".split()
)
#: fixed values: words that say where or how, not what
LAYOUT = frozenset(
    "inner outer wrapper wrap container box block bar list item items link links section area region panel slot unit top bottom left right primary secondary global site page web mobile desktop sticky fixed "
    "head body text title col column row grid group widget widgets module component btn button buttons icon icons js ui wp large small medium responsive placeholder label zone holder tabs toggle close open "
    "fluid full width mini lower upper sub post posts article articles story stories user reader readers google facebook twitter email content main first last one two three a b c".split()
)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_NUM = re.compile(r"\d+")
#: "has-sidebar" speaks of another element
_NOT_OWN = re.compile(r"\b(?:no|has|with|without)[-_]+[a-z]+")


def _h(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Node:
    __slots__ = ("tag", "path", "rank", "weak", "kids")

    def __init__(self, tag, path, rank, weak):
        self.tag, self.path, self.rank, self.weak, self.kids = tag, path, rank, weak, []


def _name(tag: str, attrs: str) -> tuple[str, set[str], bool]:
    """(node name, noise words of names that say nothing else, whether other names hold noise words)"""
    name, strong, weak = tag, set(), False
    for k, v in _ATTR.findall(attrs) if attrs else ():
        v = v.strip("\"'")
        if k.lower() == "role":
            if v.lower() in NOISE_ROLES:
                strong.add("role")
            continue
        name += ("." if k.lower() == "class" else "#") + _NUM.sub("", v)
        for token in _NOT_OWN.sub(" ", _CAMEL.sub(r"\1-\2", v).lower()).split():
            words = set(_WORDS.findall(token))
            noise = words & NOISE_WORDS
            if noise and words <= NOISE_WORDS | LAYOUT:
                strong |= noise
            elif noise:
                weak = True
    return name.replace(">", ""), strong, weak


def _under(path: str, name: str) -> str:
    """Path of a child; long ones become a digest, so that nodes stay apart at any depth."""
    path = f"{path}>{name}"
    return path if len(path) <= LONG else "~" + hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def parse(page: str | None) -> tuple[list[tuple[str, int, bool, str]], list[tuple[str, int, int]]]:
    """(blocks, nodes) of a page in document order: a block is (path, rank, weak, text), rank
    0 noise, 1 unknown, 2 in article or main; a node is (path, hash of its children, kinds of
    children), for all but noise.  Null: empty."""
    page = page or ""
    blocks: list[list] = []
    root = _Node("", "", 1, False)
    stack, nodes, fresh = [root], [], True
    at, end = 0, len(page)

    def add(text: str) -> None:
        nonlocal fresh
        if not text:
            return
        top = stack[-1]
        if fresh or not blocks or blocks[-1][1] != top.rank or blocks[-1][2] != top.weak:
            if not text.strip():
                return
            own = next(n for n in reversed(stack) if n.tag not in INLINE)
            blocks.append([own.path, top.rank, top.weak, [text]])
            fresh = False
        else:
            blocks[-1][3].append(text)

    def pop(upto: int) -> None:
        while len(stack) > upto:
            n = stack.pop()
            if n.rank and n.tag not in INLINE:
                nodes.append((n.path, _h("|".join(n.kids)), len(set(n.kids))))

    pos = 0
    while pos < end:
        lt = page.find("<", pos)
        if lt < 0:
            lt = end
        if lt > pos:
            add(page[pos:lt])
        if lt >= end:
            break
        m = _TOKEN.match(page, lt)
        if not m:
            add("<")
            pos = lt + 1
            continue
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in ("body", "html"):
                continue
            if tag not in INLINE:
                fresh = True
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                fresh = True
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, pos)
            if close:
                pos = close.end()
            elif tag in ("script", "style", "template", "noscript", "textarea", "iframe"):
                pos = end
            elif tag == "head":
                body = re.compile(r"<body\b", re.I).search(page, pos)
                pos = body.start() if body else pos
            if tag not in ("svg", "annotation", "annotation-xml"):
                fresh = True
            continue
        if tag in ("html", "body"):
            fresh = True
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    pop(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in SELF:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SELF[tag]:
                    pop(i)
                    break
                if stack[i].tag in STOP[tag]:
                    break
        top = stack[-1]
        name, strong, weak = _name(tag, m[3])
        inside = top.rank == 2
        noise = bool(strong & NOISE_IN or "role" in strong) if inside or tag in ("article", "main") else bool(strong)
        weak = top.weak or weak or bool(strong) and not noise or tag == "button"
        if tag in INLINE:
            stack.append(_Node(tag, top.path, 0 if noise else top.rank, weak))
            continue
        fresh = True
        rank = top.rank
        if noise or tag in NOISE_TAGS or tag == "header" and not inside and not any(n.tag in ("article", "main") for n in stack):
            rank = 0
        elif tag in ("article", "main") and rank == 1:
            rank, weak = 2, False
        top.kids.append(name)
        stack.append(_Node(tag, _under(top.path, name), rank, weak))
    pop(1)
    nodes.append(("", _h("|".join(root.kids)), len(set(root.kids))))
    out = []
    for path, rank, weak, parts in blocks:
        text = " ".join(htmllib.unescape("".join(parts)).split())
        if text:
            out.append((path, rank, weak, text))
    return out, nodes


def page_nodes(page: str | None) -> list[tuple[str, int, int, int]]:
    """Distinct (path, kind, hash, kinds of children) of a page: kind 0 a child sequence, 1 a text, 2 the node itself."""
    blocks, nodes = parse(page)
    rows = {(p, 0, h, k) for p, h, k in nodes} | {(p, 2, 0, 0) for p, _, _ in nodes}
    return sorted(rows | {(p, 1, _h(t), 0) for p, r, _, t in blocks if r})


def _scan(batches):
    nt = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.int32()), ("h", pa.int64()), ("kids", pa.int32())]))
    for rb in batches:
        nodes = [[dict(zip(("path", "kind", "h", "kids"), x)) for x in page_nodes(page.as_py())] for page in rb.column("html")]
        keep = [i for i, n in enumerate(rb.schema.names) if n != "html"]
        yield pa.RecordBatch.from_arrays([*[rb.column(i) for i in keep], pa.array(nodes, nt)], names=[*[rb.schema.names[i] for i in keep], "nodes"])


def main_text(page: str | None, low: dict) -> str:
    """Text of the blocks that stay.  low: (path, hash of a text, or None for the node) -> (importance, pages).

    Where the tree would take more than half of a page's article, the page is one of many copies and
    nothing in its article can be told from noise: the article stays."""
    blocks = [b for b in parse(page)[0] if b[1]]
    size = [sum(len(t) for _, r, _, t in blocks if r == k) for k in (0, 1, 2)]
    outside = (1 - size[2] / max(1, size[1] + size[2])) ** 2

    def importance(path: str, text: str, pages: int) -> float:
        found = [low.get((path, None)), low.get((path, _h(text)))] if low else []
        return min([x[0] for x in found if x and x[1] >= pages], default=1.0)

    keep = []
    for path, rank, weak, text in blocks:
        if rank == 2:
            v = importance(path, text, LEAST_PAGES_IN)
            keep.append(v >= LEAST_IN if not weak else WEAK * importance(path, text, LEAST_PAGES) >= LEAST)
        else:
            keep.append(importance(path, text, LEAST_PAGES) * outside * (WEAK if weak else 1.0) >= LEAST)
    if 2 * sum(len(b[3]) for b, k in zip(blocks, keep) if k and b[1] == 2) < size[2]:
        keep = [k or b[1] == 2 for b, k in zip(blocks, keep)]
    return " ".join(b[3] for b, k in zip(blocks, keep) if k)


def _extract(batches):
    host, low = None, {}
    for rb in batches:
        got = []
        for page, name, entries in zip(rb.column("html"), rb.column("host"), rb.column("low")):
            if name.as_py() != host:  # pages of one host come together: its entries are read once
                host, low = name.as_py(), {(x["path"], x["h"]): (x["importance"], x["pages"]) for x in entries.as_py() or ()}
            got.append(main_text(page.as_py(), low))
        yield pa.RecordBatch.from_arrays([rb.column("page_id"), rb.column("url"), pa.array(got, pa.string())], names=["page_id", "url", "text"])


def _counts(rows: DataFrame) -> DataFrame:
    n = rows.select("host", F.explode("nodes").alias("n")).select("host", "n.*")
    return n.groupBy("host", "path", "kind", "h").agg(F.count("*").alias("c"), F.max("kids").alias("kids"))


def _tree(each: DataFrame) -> DataFrame:
    n = each.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 1, F.log(F.col("c").cast("double")))).alias("spread"),
        F.sum((F.col("kind") == 1).cast("long")).alias("texts"),
        F.sum(F.when(F.col("kind") == 0, F.col("c") * F.log(F.col("c").cast("double")))).alias("clogc"),
        F.sum(F.when(F.col("kind") == 0, F.col("c"))).alias("shown"),
        F.sum(F.when(F.col("kind") == 2, F.col("c"))).alias("pages"),
        F.max("kids").alias("kids"),
    )
    m = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    show = F.greatest((F.log(F.col("shown").cast("double")) - F.col("clogc") / F.col("shown")) / m, F.lit(0.0))
    say = F.when(F.col("texts") > 0, 1 - F.col("spread") / F.col("texts") / m).otherwise(1.0)
    w = F.pow(F.lit(GAMMA), F.coalesce("kids", F.lit(0)).cast("double"))
    return n.select("host", "path", "pages", "texts", ((1 - w) * F.coalesce(show, F.lit(0.0)) + w * say).alias("importance"))


def site_tree(rows: DataFrame) -> DataFrame:
    """Importance of every style node of a host that isn't declared noise: (host, path, pages, texts, importance).

    rows: (host, nodes) of each page."""
    return _tree(_counts(rows))


def low_importance(rows: DataFrame, work: Work) -> DataFrame:
    """(host, low): what may be removed of a host, nodes (h null) and single texts, with importance and pages."""
    each = work.save(_counts(rows), "nodes")
    tree = work.save(_tree(each).where((F.col("pages") >= LEAST_PAGES) & (F.col("texts") > 0)), "tree")
    nodes = tree.where(F.col("importance") < LEAST / WEAK).select("host", "path", F.lit(None).cast("bigint").alias("h"), "importance", "pages")
    often = each.where((F.col("kind") == 1) & (F.col("c") >= LEAST_PAGES)).select("host", "path", "h", "c")
    said = 1 - F.log(F.col("c").cast("double")) / F.log(F.col("pages").cast("double"))
    texts = often.join(tree.select("host", "path", "pages"), ["host", "path"]).select("host", "path", "h", said.alias("importance"), "pages").where(F.col("importance") < LEAST)
    return nodes.union(texts).groupBy("host").agg(F.collect_list(F.struct("path", "h", "importance", "pages")).alias("low"))


def extract(spark: SparkSession, pages: DataFrame, work: Work | None = None) -> DataFrame:
    """page_id, url, text (the main text, "" if none), one row per input row.

    Null and empty html is empty; a null url counts as host ""; repeated pages count once each in the
    tree; very long or deep pages are read whole; a page whose article the tree can't tell from noise keeps
    it (see ``main_text``); equal importances need no tie rule; an empty table gives an empty one; other
    columns of ``pages`` are ignored."""
    work = work or Work(spark, "sitetree")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    src = pages.select("page_id", "url", "html", host.alias("host"))
    nodes = src.select("host", "html").mapInArrow(_scan, "host string, nodes array<struct<path:string,kind:int,h:bigint,kids:int>>")
    low = work.save(low_importance(nodes, work), "low")
    n = low.agg(F.count("*").alias("hosts"), F.coalesce(F.sum(F.size("low")), F.lit(0)).alias("entries")).first()
    if n.hosts <= FEW_HOSTS and n.entries <= FEW_ENTRIES:
        both = src.sortWithinPartitions("host").join(F.broadcast(low), "host", "left")  # the join keeps the order
    else:  # pages of one host are dealt over several tasks
        salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
        both = src.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(16)).cast("int")).join(salted, ["host", "salt"], "left")
    return both.select("page_id", "url", "html", "host", "low").mapInArrow(_extract, plus(pages.select("page_id", "url").schema, "text string"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
