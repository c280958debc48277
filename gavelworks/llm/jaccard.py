"""N-gram Jaccard join: a forest of count-vector R-trees.

A document is the set of its distinct k-word shingles, hashed to 64 bits.  The
shingles are dealt into groups by hash and the group counts are the document's
point.  Two facts bound the search, both exact:

* |A & B| <= sum over groups of min(a_g, b_g), so a tree node whose upper corner
  gives too small a sum holds no partner;
* a pair above the threshold differs in at most d = (1-t)/(1+t) (|A|+|B|)
  shingles, so of m > d blocks of groups at least m - d agree in every
  coordinate.  Blocks therefore route points to trees: points with an equal
  block share a *tile*, and a tile is one tree of the forest.

Blocks with at most one shingle say little and would make large tiles; they are
left out as long as a document has fewer than m - d of them (then they can't be
all that agrees).  Documents with more of them add keys over combinations.

Tiles with the same members are one tree.  Work order: equal sets collapse to one
representative first; in the tree of every tile (in blocks of bounded size) each
member descends to the nearest of the members before it, by the bound, which gives at
most one pair a member; in tiles that still hold more than one component the members
outside the largest one are searched for all partners in trees over the whole tile.
Every surviving pair is verified on the full sets.  No caps, no sampling.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, partitions, table
from .components import components

GROUPS = 256
#: most members of a tile that one tree takes; larger tiles are searched in blocks
TILE = 2048
#: ids (16 bytes each) up to this count may be sent to every executor
FEW = 1_000_000
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_R = _mix(np.arange(1, 65537, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased (multilinear hash of UTF-8 bytes)."""
    if not text:
        return np.empty(0, np.uint64)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    ink = ~((b == 32) | ((b >= 9) & (b <= 13)))
    pos = np.flatnonzero(ink)
    if not len(pos):
        return np.empty(0, np.uint64)
    first = np.flatnonzero(np.diff(pos, prepend=-2) != 1)
    size = np.diff(first, append=len(pos))
    rel = np.arange(len(pos)) - np.repeat(first, size)
    vals = (b[pos].astype(np.uint64) + U(1)) * _R[rel & 65535]
    return _mix(np.add.reduceat(vals, first) + size.astype(np.uint64) * U(0x9E3779B97F4A7C15))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; shorter texts are one shingle, empty ones none."""
    w = word_hashes(text)
    if not len(w):
        return w
    width = min(k, len(w))
    acc = np.full(len(w) - width + 1, U(width * 0xD6E8FEB86659FD93 % 2**64))
    for i in range(width):
        acc = acc + w[i : len(w) - width + 1 + i] * _R[100 + i]
    return np.unique(_mix(acc))


class Scheme:
    """Size classes and their numbers of blocks for a threshold num/den."""

    def __init__(self, num: int, den: int, ratio: float = 2.0):
        self.num, self.den, self.ratio = num, den, ratio
        self.cuts = [1]

    def diff(self, total: int) -> int:
        """Most differing shingles of a linked pair with |A| + |B| = total."""
        return (self.den - self.num) * total // (self.den + self.num)

    def partner(self, n: int) -> int:
        return n * self.den // self.num

    def cls(self, n: int) -> int:
        while self.cuts[-1] <= n:
            c, step = self.cuts[-1], 1
            while self.diff(2 * (c + step - 1)) == self.diff(2 * c):
                step += 1
            self.cuts.append(max(c + step, int(c * self.ratio)))
        lo = 0
        while self.cuts[lo + 1] <= n:
            lo += 1
        return lo

    @lru_cache(None)
    def blocks(self, c: int) -> tuple[int, int]:
        """(m, fewest agreeing blocks) of class c."""
        self.cls(self.cuts[c])
        d = self.diff(2 * (self.cuts[c + 1] - 1))
        m = d + 1 + -(-(d + 1) // 4)
        return m, m - d

    def keys(self, s: np.ndarray) -> np.ndarray:
        """Tile keys of a sorted set of hashes."""
        n, out = len(s), []
        if not n:
            return np.empty(0, np.uint64)
        top = self.partner(n)
        for c in range(self.cls(n), self.cls(top) + 1):
            if self.diff(2 * (self.cuts[c + 1] - 1)) == 0:
                continue  # only equal sets link here
            m, agree = self.blocks(c)
            most = min(top, self.cuts[c + 1] - 1)
            block = ((s >> U(32)) * U(m)) >> U(32)
            start = np.flatnonzero(np.diff(block.astype(np.int64), prepend=-1))
            at = block[start]
            size = np.diff(start, append=n)
            body = np.add.reduceat(_mix(s ^ U(0xA5A5A5A5DEADBEEF)), start)
            tag = _mix(at + U(c) * U(1 << 32) + U(77))
            big = size > 1
            out.append(_mix(body[big] ^ tag[big]))
            few = int(m - big.sum())
            if few >= m - self.diff(n + most):
                small = {int(a): int(v) for a, v in zip(at[~big], body[~big])}
                idx = [i for i in range(m) if i in small or i not in set(at.tolist())]
                sizes = agree if comb(m, agree) <= 64 else 1
                extra = [hash_ints((c, sizes, *(x for i in t for x in (i, small.get(i, 0))))) for t in combinations(idx, sizes)]
                out.append(np.array(extra, np.uint64))
        return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def hash_ints(xs) -> int:
    return int.from_bytes(hashlib.blake2b(b",".join(b"%d" % x for x in xs), digest_size=8).digest(), "little")


def _points(k: int, num: int, den: int):
    def run(batches):
        scheme = Scheme(num, den)
        for rb in batches:
            ids, n, fp, keys, off = [], [], [], [], [0]
            for text in rb.column("text"):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None)
                kk = scheme.keys(s)
                keys.append(kk)
                off.append(off[-1] + len(kk))
            flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp, pa.string()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat.view(np.int64)))],
                names=["doc_id", "n_shingles", "fp", "keys"],
            )

    return run


def _sets(k: int):
    def run(batches):
        for rb in batches:
            sets = [shingle_set(t.as_py(), k) for t in rb.column("text")]
            cv = [_packed(counts(s)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(cv, pa.binary())], names=["doc_id", "items", "cv"]
            )

    return run


def counts(s: np.ndarray) -> np.ndarray:
    """The document's point: shingles per group."""
    return np.bincount((s & U(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.uint32)


def _packed(c: np.ndarray) -> bytes:
    """Counts as 16-bit numbers, as 32-bit ones if one needs them."""
    return (c if c.max(initial=0) > 65535 else c.astype(np.uint16)).tobytes()


def _unpacked(cvs: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(c, np.uint16 if len(c) == 2 * GROUPS else np.uint32).astype(np.uint32) for c in cvs])


class RTree:
    """Packed R-tree over count vectors: rows sorted by size, ``FAN`` per node,
    each node with the upper corner of its box and its range of sizes."""

    FAN = 16

    def __init__(self, points: np.ndarray):
        self.size = points.sum(1).astype(np.int64)
        self.order = np.lexsort((*points.T[:4], self.size))
        self.points, self.size = points[self.order].astype(np.int64), self.size[self.order]
        self.levels = []
        hi, lo_n, hi_n = self.points, self.size, self.size
        while len(hi) > 1:
            cut = np.arange(0, len(hi), self.FAN)
            hi, lo_n, hi_n = np.maximum.reduceat(hi, cut), np.minimum.reduceat(lo_n, cut), np.maximum.reduceat(hi_n, cut)
            self.levels.append((hi, lo_n, hi_n))

    def search(self, q: np.ndarray, num: int, den: int) -> np.ndarray:
        """Rows that may reach num/den with q, by the bound of summed minima."""
        n = int(q.sum())
        q = q.astype(np.int64)

        def may(hi, lo_n, hi_n):
            near = np.minimum(hi, q).sum(1)
            # overlap needed with the smallest size in the node
            return (near * (den + num) >= num * (n + lo_n)) & (hi_n * den >= num * n) & (lo_n * num <= den * n)

        at = None
        for hi, lo_n, hi_n in reversed(self.levels):
            if at is None:
                at = np.arange(len(hi))
            else:
                at = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                at = at[at < len(hi)]
            at = at[may(hi[at], lo_n[at], hi_n[at])]
        at = np.arange(len(self.points)) if at is None else (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
        at = at[at < len(self.points)]
        return self.order[at[may(self.points[at], self.size[at], self.size[at])]]

    def nearest(self, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (i, j): for each member the one before it (by size) to which the best bounds lead down
        the tree, where that one's bound reaches num/den.  At most one pair a member."""
        if len(self.points) < 2:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        left, right = [], []
        for lo in range(1, len(self.points), 256):
            me = np.arange(lo, min(lo + 256, len(self.points)))
            q, n = self.points[me], self.size[me]
            at = np.zeros(len(me), np.int64)
            for level in range(len(self.levels) - 2, -2, -1):
                # the children of the chosen nodes that begin before the member; -1: the points
                hi, low = (self.levels[level][0], self.levels[level][1]) if level >= 0 else (self.points, self.size)
                kid = at[:, None] * self.FAN + np.arange(self.FAN)
                before = kid * self.FAN ** (level + 1) < me[:, None]
                kid = np.minimum(kid, len(hi) - 1)
                near = np.minimum(hi[kid], q[:, None]).sum(2)
                share = np.where(before, near / np.maximum(n[:, None] + low[kid] - near, 1), -1.0)
                best = np.argmax(share, 1)
                at, near = kid[np.arange(len(me)), best], near[np.arange(len(me)), best]
            ok = (near * (den + num) >= num * (n + self.size[at])) & (self.size[at] * den >= num * n)
            left.append(me[ok])
            right.append(at[ok])
        return self.order[np.concatenate(left)], self.order[np.concatenate(right)]


def _tile_nearest(num: int, den: int):
    """Members (doc, cv) of a block of a tile -> each one's nearest candidate pair."""

    def run(batches):
        for rb in batches:
            a, b = [], []
            for z in rb.column("z"):
                docs = z.values.field("doc").to_numpy()
                i, j = RTree(_unpacked(z.values.field("cv").to_pylist())).nearest(num, den)
                a.append(np.minimum(docs[i], docs[j]))
                b.append(np.maximum(docs[i], docs[j]))
            cat = lambda xs: np.concatenate(xs) if xs else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cat(a), pa.int64()), pa.array(cat(b), pa.int64())], names=["a", "b"])

    return run


def _tile_search(num: int, den: int):
    """Rows (own, doc, comp, cv) of a block of a tile -> candidate pairs of different
    components, one of them an own row."""

    def run(batches):
        for rb in batches:
            a, b = [], []
            for z in rb.column("z").to_pylist():
                pts = _unpacked([r["cv"] for r in z])
                comp = np.array([r["comp"] for r in z])
                tree = RTree(pts)
                for i, r in enumerate(z):
                    if r["own"]:
                        for j in tree.search(pts[i], num, den):
                            if comp[j] != comp[i]:
                                x, y = r["doc"], z[j]["doc"]
                                a.append(min(x, y))
                                b.append(max(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _few(ids: DataFrame) -> DataFrame:
    """Ids to send around if a count shows them to be few; else they are joined by shuffle."""
    return F.broadcast(ids) if ids.limit(FEW + 1).count() <= FEW else ids


def _verify(num: int, den: int):
    def run(batches):
        for rb in batches:
            keep, last, at = [], None, None
            for x, y in zip(rb.column("x"), rb.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((p, q))
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(inter * den >= num * (len(p) + len(q) - inter))
            yield pa.RecordBatch.from_arrays([rb.column("a"), rb.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def jaccard_components(
    spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, work: Work | None = None, steps: dict | None = None
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Links: 100 * |A & B| >= num/den * |A | B| over the distinct k-word shingles.
    Null, empty or white-space texts have no shingle and link with nothing; rows
    that repeat a doc_id count as versions of one document and stay together; a
    null doc_id links with nothing and has a null component.  Other columns of
    ``docs`` are ignored.  One row per input row; an empty table gives an empty one; very
    long texts are read whole.  ``steps``, if given, gets the verified links of each step.
    """
    work = work or Work(spark, "jaccard")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = work.save(rows.mapInArrow(_points(k, num, den), "doc_id long, n_shingles long, fp string, keys array<bigint>"), "keys")
    points = work.save(keyed.select("doc_id", "n_shingles", "fp"), "points")

    # equal sets: one representative each
    reps = work.save(points.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    cls = work.save(points.where("doc_id is not null").select("doc_id", "fp").join(reps, "fp").select("doc_id", "rep").distinct(), "classes")
    lead = _few(reps.select(F.col("rep").alias("doc_id")).distinct())
    rows_k = keyed.join(lead, "doc_id", "left_semi").select(F.explode("keys").alias("key"), "doc_id").repartition(partitions(spark), "key")
    mark = [F.bit_xor(F.xxhash64("doc_id", F.lit(i))).alias(f"m{i}") for i in (1, 2)]
    tiles = rows_k.groupBy("key").agg(F.count("*").alias("n"), *mark).where("n > 1")
    # tiles with the same members are searched once
    tiles = tiles.groupBy("n", "m1", "m2").agg(F.min("key").alias("key")).select("key", "n")
    multi = work.save(rows_k.join(tiles.hint("shuffle_hash"), "key").select("key", "doc_id", "n"), "tiles")

    work.drop(keyed)
    need = _few(work.save(multi.select("doc_id").distinct(), "need"))
    sets = work.save(rows.join(need, "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, items binary, cv binary"), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
        y = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(num, den), "a long, b long")

    # rows of one doc_id with unequal sets stay together through their representatives
    same = cls.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    def linked(pairs: DataFrame, step: str) -> DataFrame:
        out = work.save(verified(pairs.distinct()), "links")
        if steps is not None:
            steps[step] = out.count()
        return out

    cv = sets.select("doc_id", "cv")
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.ceil(F.col("n") / TILE)).cast("int")
    blocks = multi.select("key", "doc_id", part.alias("o")).join(cv, "doc_id").groupBy("key", "o").agg(F.collect_list(F.struct(F.col("doc_id").alias("doc"), "cv")).alias("z")).select("z")
    edges = linked(blocks.where(F.size("z") > 1).mapInArrow(_tile_nearest(num, den), "a long, b long"), "nearest")
    comp = components(work, edges)

    # tiles with more than one component left: members outside of the tile's largest
    # component are searched in R-trees of all its members, in blocks of bounded size
    t = multi.select("key", "doc_id").join(comp.toDF("doc_id", "comp"), "doc_id", "left").select("key", "doc_id", F.coalesce("comp", "doc_id").alias("comp"))
    size = t.groupBy("key", "comp").agg(F.count("*").alias("n"))
    tile = size.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most"), F.count("*").alias("comps")).where("comps > 1")
    tile = tile.select("key", "main", (F.col("n") - F.col("most")).alias("u"), "n")
    left = work.save(t.join(tile, "key"), "mixed")
    nb, nr = F.ceil(F.col("u") / (TILE / 4)).cast("int"), F.ceil(F.col("n") / TILE).cast("int")
    cut = F.sequence(F.lit(0), nb - 1)
    row = F.sequence(F.lit(0), nr - 1)
    h = F.xxhash64("doc_id", F.lit(3))
    keep = ["key", "doc_id", "comp"]
    own = left.where("comp <> main").select(*keep, F.lit(True).alias("own"), F.pmod(h, nb).cast("int").alias("o"), F.explode(row).alias("r"))
    rest = left.select(*keep, F.lit(False).alias("own"), F.explode(cut).alias("o"), F.pmod(h, nr).cast("int").alias("r"))
    blocks = own.union(rest).join(cv, "doc_id").groupBy("key", "o", "r").agg(F.collect_list(F.struct("own", F.col("doc_id").alias("doc"), "comp", "cv")).alias("z")).select("z")
    edges = edges.union(linked(blocks.mapInArrow(_tile_search(num, den), "a long, b long"), "all partners"))
    comp = components(work, edges.union(same))
    work.drop(multi, sets, left)
    ids = cls.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    ids = ids.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("component_id"))
    return points.select("doc_id", "n_shingles").join(ids, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group (five words, 0.8).

    Repeated rows of the kept id collapse to one row, that of the least text, then of the least other columns (written
    as JSON), so that the choice is the same on every run; rows with a null doc_id and texts without words
    stay; an empty table gives an empty one.  Only ids are joined: texts move for repeated ids alone, or
    where the ids are too many to be sent around."""
    work = Work(spark, "duplicates")
    comp = work.save(jaccard_components(spark, docs, k=5, num=80, den=100).select("doc_id", "component_id"), "components")
    gone = comp.where("doc_id <> component_id").select("doc_id").distinct()
    again = comp.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    kept = docs.join(_few(gone), "doc_id", "left_anti")
    if again.limit(1).count():
        again = _few(again)
        cols = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(cols, F.struct("text", F.to_json(cols))).alias("_row"))
        kept = kept.join(again, "doc_id", "left_anti").unionByName(one.select("_row.*"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(sh) AS h FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[][] WHEN len(ws) < 4 THEN [ws]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i:i+3]) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS c FROM e UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
