"""Listing and ruling pages: a small tree over the standard HTML parser, applied in Arrow batches."""

from __future__ import annotations

import json
import os
import random
import re
import time
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ID = re.compile(r"/direktori/putusan/([0-9a-z]+)\.html")
_DATE = re.compile(r"(Register|Putus|Upload)\s*:?\s*(\d{1,2}-\d{1,2}-\d{4})", re.I)
#: fixed values: labels of the overview table
LABELS = {
    "nomor": "nomor", "tingkat proses": "tingkat_proses", "klasifikasi": "klasifikasi", "kata kunci": "kata_kunci", "tahun": "tahun", "tanggal register": "tanggal_register",
    "lembaga peradilan": "lembaga_peradilan", "jenis lembaga peradilan": "jenis_lembaga", "hakim ketua": "hakim_ketua", "hakim anggota": "hakim_anggota", "panitera": "panitera",
    "amar": "amar", "amar lainnya": "amar_lainnya", "catatan amar": "catatan_amar", "tanggal musyawarah": "tanggal_musyawarah", "tanggal dibacakan": "tanggal_dibacakan",
    "kaidah": "kaidah", "abstrak": "abstrak", "nama pihak": "nama_pihak",
}


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag, attrs, up):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up

    def walk(self):
        todo = [k for k in reversed(self.kids) if type(k) is Node]
        while todo:
            n = todo.pop()
            yield n
            todo += [k for k in reversed(n.kids) if type(k) is Node]

    def text(self) -> str:
        if len(self.kids) == 1 and type(self.kids[0]) is str:
            return " ".join(self.kids[0].split())
        return " ".join("".join([k if type(k) is str else f" {k.text()} " for k in self.kids if type(k) is str or k.tag not in ("script", "style")]).split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        n = Node(tag, dict(attrs), self.at)
        self.at.kids.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_endtag(self, tag):
        n = self.at
        while n.up is not None and n.tag != tag:
            n = n.up
        if n.up is not None:
            self.at = n.up

    def handle_data(self, data):
        self.at.kids.append(data)


#: what stands in a tag that reads the same to any parser: attributes quoted and without references, no slash at its end
_PLAIN = re.compile(r"""(/?[A-Za-z][A-Za-z0-9]*)((?:[ \t\n\r\f]+[A-Za-z][A-Za-z0-9-]*=(?:'[^'&]*'|"[^"&]*"))*)[ \t\n\r\f]*""")
_ATTR = re.compile(r"""([A-Za-z][A-Za-z0-9-]*)=(?:'([^']*)'|"([^"]*)")""")
#: elements whose content is not markup, or is not in every version of the parser
_RAW = frozenset("script style textarea title iframe noembed noframes noscript plaintext xmp".split())

#: the usual tags as they stand: what is not here is looked at
_OPEN = {t: t for t in "html head body table thead tbody tfoot tr td th div span p a b i u em strong small ul ol li dl dt dd h1 h2 h3 h4 h5 h6 center font nav header footer section article main form label button".split()}
_SHUT = {f"/{t}": t for t in _OPEN}


def _plain(html: str) -> list[Node] | None:
    """The root and all nodes in the order of the page, if all its tags are plain; else None.  A fraction of the parser's
    time, and the same tree."""
    first, *pieces = html.split("<")
    root = at = Node("", {}, None)
    nodes = [root]
    if first:
        root.kids.append(unescape(first))
    for piece in pieces:
        head, close, text = piece.partition(">")
        if not close:
            return None
        tag, end, attrs = _OPEN.get(head), None, {}
        if tag is None:
            end = _SHUT.get(head)
            if end is None:
                m = _PLAIN.fullmatch(head)
                if m is None:
                    return None
                if head[0] == "/":
                    end = m[1][1:].lower()
                    if m[2]:
                        return None
                else:
                    tag = m[1].lower()
                    if tag in _RAW:
                        return None
                    if m[2]:
                        attrs = {k.lower(): a or b for k, a, b in _ATTR.findall(m[2])}
        if end is None:
            n = Node(tag, attrs, at)
            nodes.append(n)
            at.kids.append(n)
            if tag not in _VOID:
                at = n
        elif at.tag == end and at is not root:
            at = at.up
        else:
            n = at
            while n.up is not None and n.tag != end:
                n = n.up
            if n.up is not None:
                at = n.up
        if text:
            at.kids.append(unescape(text) if "&" in text else text)
    return nodes


def _parsed(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def tree(html: str | None) -> Node:
    nodes = _plain(html or "")
    return nodes[0] if nodes else _parsed(html or "")


def _nodes(html: str | None) -> list[Node]:
    """All nodes but the root, in the order of the page."""
    nodes = _plain(html or "")
    return nodes[1:] if nodes else list(_parsed(html or "").walk())


def listing(html: str | None) -> list[dict]:
    """Entries of a listing page: one per ruling id, the longest title, dates of its block."""
    out: dict[str, dict] = {}
    for a in tree(html).walk():
        m = _ID.search(a.attrs.get("href") or "") if a.tag == "a" else None
        if not m:
            continue
        e = out.setdefault(m[1], {"id": m[1], "url": a.attrs["href"], "judul": "", "teks_entri": "", "tanggal_putus": None})
        if len(a.text()) > len(e["judul"]):
            e["judul"] = a.text()
        block = a
        while block.up is not None and block.tag not in ("li", "article", "tr") and "entry" not in (block.attrs.get("class") or ""):
            block = block.up
        if block.up is not None and len(block.text()) > len(e["teks_entri"]):
            e["teks_entri"] = block.text()
            e["tanggal_putus"] = next((d for k, d in _DATE.findall(block.text()) if k.lower() == "putus"), None)
    return list(out.values())


def last_page(html: str | None, url: str) -> int:
    """Largest page number linked under the listing's own prefix."""
    prefix = re.sub(r"(?:/page/\d+)?\.html.*$", "", url)
    found = [int(n) for n in re.findall(re.escape(prefix) + r"/page/(\d+)\.html", html or "")]
    return max([1, *found])


_TITLES = frozenset(("h1", "h2", "h3", "h4", "h5", "strong", "b"))
_RELATED = re.compile("putusan terkait", re.I)


def overview(html: str | None, url: str = "", fields: bool = True, related_too: bool = True) -> dict:
    """Label/value rows, attachments and related rulings of a ruling page; without ``fields`` no rows are told, without
    ``related_too`` no related rulings."""
    nodes, out, own = _nodes(html), {}, _ID.search(url or "")
    for tr in nodes if fields else ():
        if tr.tag == "tr":
            cells = [c for c in tr.kids if type(c) is Node and c.tag in ("td", "th")]
            label = cells[0].text() if len(cells) >= 2 else ""
            name = LABELS.get(label.strip(" :").lower()) if label and len(label) <= 40 else None
            if name and name not in out:
                out[name] = " ".join([c.text() for c in cells[1:]]).strip(" :")
    links = [a.attrs.get("href") or "" for a in nodes if a.tag == "a"]
    pdf = next((x for x in links if "/pdf/" in x), None)
    related = {}
    for h in nodes if related_too else ():
        if h.tag in _TITLES and _RELATED.search(h.text()):
            at = h
            for _ in range(6):
                found = [a for a in at.walk() if a.tag == "a" and _ID.search(a.attrs.get("href") or "")]
                if found or at.up is None or at.up.up is None:
                    break
                at = at.up
            for a in found:
                i = _ID.search(a.attrs["href"])[1]
                if not own or i != own[1]:
                    related.setdefault(i, a.text())
    return {"id": own[1] if own else None, "meta": out, "pdf_url": pdf, "zip_url": next((x for x in links if "/zip/" in x), None), "lampiran": "Ada" if pdf else "Tidak ada", "terkait": [{"id": k, "label": v} for k, v in related.items()]}


def _table(pages: DataFrame, fn, schema: str) -> DataFrame:
    ship(pages.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pdf[["url"]].assign(j=[json.dumps(fn(h, u), ensure_ascii=False) for h, u in zip(pdf["html"], pdf["url"])])

    return pages.select("url", "html").mapInPandas(run, "url string, j string").select("url", F.from_json("j", schema).alias("v"))


def listings(pages: DataFrame) -> DataFrame:
    """(halaman, id, url, judul, teks_entri, tanggal_putus) of listing pages."""
    one = "struct<id:string,url:string,judul:string,teks_entri:string,tanggal_putus:string>"
    return _table(pages, lambda h, u: listing(h), f"array<{one}>").select(F.col("url").alias("halaman"), F.explode("v").alias("e")).select("halaman", "e.*")


def overviews(pages: DataFrame) -> DataFrame:
    return _table(pages, overview, "struct<id:string,meta:map<string,string>,pdf_url:string,zip_url:string,lampiran:string,terkait:array<struct<id:string,label:string>>>").select("url", "v.*")


def edges(over: DataFrame) -> DataFrame:
    return over.select(F.col("id").alias("dari_id"), F.explode("terkait").alias("t")).select("dari_id", F.col("t.id").alias("ke_id"), "t.label").dropDuplicates()


def allowed(robots: str, path: str) -> bool:
    """robots.txt rule for every agent: the longest match wins, allow on ties."""
    active, naming, rules = False, False, []
    for line in robots.splitlines():
        k, _, v = line.partition("#")[0].partition(":")
        k, v = k.strip().lower(), v.strip()
        if k == "user-agent":
            # lines of agents that follow each other open one group
            active, naming = (active and naming) or v == "*", True
            continue
        naming = naming and not k
        if active and k in ("allow", "disallow") and v:
            pat = re.escape(v).replace(r"\*", ".*").replace(r"\$", "$")
            if re.match(pat, path):
                rules.append((len(v), k == "allow"))
    return max(rules)[1] if rules else True


def save_file(body: bytes, target: str, content_type: str = "", kind: bytes = b"%PDF-") -> str:
    """Write a download so that it is there whole or not at all; one that doesn't begin as its kind, or is a
    blocking page, raises ValueError.  A file that is there already stays."""
    if os.path.exists(target) and os.path.getsize(target) > 0:
        return target
    if not body.startswith(kind):
        blocked = "html" in content_type.lower() or b"captcha" in body[:200_000].lower()
        raise ValueError(f"{'blocked' if blocked else 'not ' + kind.decode()}: {target}")
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    part = target + ".part"
    with open(part, "wb") as f:
        f.write(body)
    os.replace(part, target)
    return target


def cached(url: str, folder: str, get, is_listing: bool = False, hours: float = 24.0, now: float | None = None) -> str:
    """Page of the disk cache, or fetched by ``get`` and kept; listings expire after some hours, blocked or
    unrecognised pages raise ValueError and are not kept."""
    name = re.sub("[^A-Za-z0-9]+", "_", re.sub(r"^https?://[^/]+/", "", url))
    name = (name if len(name) <= 180 else f"{name[:100]}__{name[-80:]}") + ".html"
    path = os.path.join(folder, name)
    if os.path.exists(path) and (not is_listing or (now or time.time()) - os.path.getmtime(path) < hours * 3600):
        with open(path, encoding="utf-8") as f:
            return f.read()
    html = get(url)
    low = html.lower()
    if "captcha" in low or "database error" in low or "a php error" in low:
        raise ValueError(f"not kept: {url}")
    os.makedirs(folder, exist_ok=True)
    with open(path + ".part", "w", encoding="utf-8") as f:
        f.write(html)
    os.replace(path + ".part", path)
    return html


def all_listings(*parts: DataFrame) -> DataFrame:
    """Entries of searches and categories under one another, by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def fetch(url: str, open_url, sleep, attempts: int = 5, delay: float = 3.0, jitter: float = 1.5) -> bytes:
    """Polite request through injected ``open_url`` -> (status, headers, body): 429, 5xx and network errors are
    retried with growing delays (Retry-After up to 300 s), other errors stop at once."""
    last = None
    for k in range(attempts):
        sleep(delay + random.uniform(0, jitter))
        try:
            status, headers, body = open_url(url)
        except OSError as e:
            last = e
            sleep(delay * 2**k)
            continue
        if status < 400:
            return body
        last = RuntimeError(f"HTTP {status}")
        if status != 429 and status < 500:
            break
        after = str(headers.get("Retry-After", ""))
        sleep(min(300, int(after)) if after.isdigit() else delay * 2**k)
    raise RuntimeError(f"{url}: {last}")
