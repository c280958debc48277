"""Merkle manifest of a table: a sparse forest, merged associatively, with an inclusion proof for every row.

Every key (``lang``) is a tree whose leaves ascend by id; runs of ``ARITY`` consecutive siblings hash to their parent
(the last run of a level may be shorter) until one node, the subroot, is left.  The subroots, in the order of their
keys, are the leaves of one more tree, whose top is the root.

The monoid: a fragment is a set of unresolved nodes keyed by (level, index) of one tree.  ``merged`` unites fragments
and closes every run whose siblings are all there: how many a run has is known from the number of leaves.  It is
associative and commutative, so the leaves may be cut anywhere.  A partition of leaves leaves at most two open runs a
level, which a tree reduce merges, ``FAN`` neighbours at a time.  Its rounds are written tables, not ``RDD.treeReduce``:
that would take the last fragment to the driver and lose the runs closed on the way, which the proofs need.

Defined cases: null fields are hashed as ``-``; a null key is a tree of its own and comes first; a null id comes first,
equal ids are ordered by leaf hash, so repeated rows each get their leaf; an empty table gives no rows; other columns
are neither hashed nor returned; texts of any length are hashed by the JVM, Python sees digests only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Work, partitions, table

ARITY = 8
#: fragments merged at once; rows of a partition of leaves at most, and at least as long as there are fewer partitions than asked for
FAN, MOST, LEAST = 64, 250_000, 10_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS = "part long, kind int, tree string, a long, b long, n long, h string, x string, more array<string>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes on a level of a tree of n leaves."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


def merged(n: int, *fragments: dict[tuple[int, int], str], runs: dict | None = None) -> dict[tuple[int, int], str]:
    """The union of fragments of a tree of n leaves, every complete run closed; closed runs go into ``runs`` as
    (level, parent) -> hashes of the siblings."""
    levels: dict[int, dict[int, str]] = {}
    for f in fragments:
        for (level, i), h in f.items():
            levels.setdefault(level, {})[i] = h
    level = 0
    while levels and level <= max(levels):
        here, wide = levels.get(level, {}), width(n, level)
        if wide > 1:
            held: dict[int, int] = {}
            for i in here:
                held[i // ARITY] = held.get(i // ARITY, 0) + 1
            for parent, k in held.items():
                first = ARITY * parent
                if k == min(ARITY, wide - first):
                    run = [here.pop(i) for i in range(first, first + k)]
                    levels.setdefault(level + 1, {})[parent] = digest(*run)
                    if runs is not None:
                        runs[level, parent] = run
        level += 1
    return {(level, i): h for level, here in levels.items() for i, h in here.items()}


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root from a leaf and the siblings before and after it, level by level."""
    for before, after in path:
        leaf = digest(before, leaf, after)
    return leaf


# --- streams of partitions ------------------------------------------------------------------------------------------


def _shape(df: DataFrame, **cols) -> DataFrame:
    """Rows of the one schema that all streams have."""
    return df.select(*[F.lit(None).cast(t).alias(c) if c not in cols else F.expr(cols[c]).cast(t).alias(c) for c, t in (f.split(" ") for f in ROWS.split(", "))])


def _dealt(frames: list[DataFrame], parts: int) -> DataFrame:
    """All rows of a part in one task, in order of kind, tree and position; a task holds one part at a time."""
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    return df.repartition(parts, "part").sortWithinPartitions("part", "kind", "tree", "a")


def _parts(batches) -> Iterator[tuple[int, list[dict]]]:
    """(part, its rows) of a sorted stream."""
    now, rows = None, []
    for rb in batches:
        cols = [rb.column(f.split(" ")[0]).to_pylist() for f in ROWS.split(", ")]
        for row in zip(*cols):
            if row[0] != now:
                if rows:
                    yield now, rows
                now, rows = row[0], []
            rows.append(row)
    if rows:
        yield now, rows


def _trees(rows: list) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r[2], []).append(r)
    return out


def _leaf_rows(rows: list):
    """(span, leaf rows, other rows) of one tree in one part; a span is (first row, number of its first leaf, leaves)."""
    span = next(r for r in rows if r[1] == 0)
    return span, [r for r in rows if r[1] == 9], [r for r in rows if r[1] not in (0, 9)]


def _local(batches):
    """Leaves of a part -> its open nodes (kind 0), and the keys (kind 1) of the runs above its ends that it can't close."""
    for part, rows in _parts(batches):
        out = []
        for tree, mine in _trees(rows).items():
            (_, _, _, first, start, n, *_), leaves, _ = _leaf_rows(mine)
            nodes = {(0, r[3] - first + start): r[6] for r in leaves}
            low, high = start, start + len(leaves) - 1
            runs: dict = {}
            out += [(0, part, tree, level, i, n, h) for (level, i), h in merged(n, nodes, runs=runs).items()]
            level = 0
            while width(n, level) > 1:
                low, high = low // ARITY, high // ARITY
                out += [(1, part, tree, level, i, n, None) for i in {low, high} if (level, i) not in runs]
                level += 1
        cols = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _OPEN)], names=_OPEN_NAMES)


_OPEN = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
_OPEN_NAMES = ["kind", "part", "tree", "level", "idx", "n", "h"]
_OPEN_DDL = "kind int, part long, tree string, level int, idx long, n long, h string"


def _reduce(batches):
    """Open nodes of neighbouring parts -> what stays open (kind 0) and the runs closed (kind 2)."""
    for part, rows in _parts(batches):
        kind, level, idx, ns, hs, run_col, trees = [], [], [], [], [], [], []
        for tree, mine in _trees(rows).items():
            n, runs = mine[0][5], {}
            for (lv, i), h in merged(n, {(r[4], r[3]): r[6] for r in mine}, runs=runs).items():
                kind.append(0), trees.append(tree), level.append(lv), idx.append(i), ns.append(n), hs.append(h), run_col.append(None)
            for (lv, i), run in runs.items():
                kind.append(2), trees.append(tree), level.append(lv), idx.append(i), ns.append(n), hs.append(None), run_col.append(run)
        arrays = [pa.array(kind, pa.int32()), pa.array([part] * len(kind), pa.int64()), pa.array(trees, pa.string()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array(ns, pa.int64()), pa.array(hs, pa.string()), pa.array(run_col, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(arrays, names=[*_OPEN_NAMES, "run"])


def _paths(batches) -> Iterator[tuple[int, str, tuple, list]]:
    """(part, tree, its span, [(leaf row, siblings of level 0, path above)]) with the path from level 0 as pairs
    (before, after); what lies above a run is worked out once for all its leaves."""
    for part, rows in _parts(batches):
        for tree, mine in _trees(rows).items():
            span, leaves, context = _leaf_rows(mine)
            first, start, n = span[3:6]
            runs = {(r[4], r[3]): r[8] for r in context}
            merged(n, {(0, r[3] - first + start): r[6] for r in leaves}, runs=runs)
            last: dict[int, tuple[int, list]] = {}

            def above(level: int, i: int) -> list[tuple[str, str]]:
                if width(n, level) == 1:
                    return []
                if last.get(level, (-1,))[0] != i:
                    last[level] = (i, [_sides(runs[level, i // ARITY], i % ARITY), *above(level + 1, i // ARITY)])
                return last[level][1]

            def each():
                for r in leaves:
                    i = r[3] - first + start
                    yield r, ([] if n == 1 else [_sides(runs[0, i // ARITY], i % ARITY), *above(1, i // ARITY)])

            yield part, tree, span, each()


def _sides(run: list[str], at: int) -> tuple[str, str]:
    return "".join(run[:at]), "".join(run[at + 1 :])


# --- the forest ------------------------------------------------------------------------------------------------------


class Forest:
    """Trees over ``leaves`` (tree, leaf and the columns of ``order``), cut into parts by ranges of (tree, *order, leaf).

    ``subroots``: tree, h, n.  ``climb(task, ddl)`` runs a task over every leaf and its path."""

    def __init__(self, work: Work, leaves: DataFrame, order: list[str], carry: list[str] = ()):
        self.work = work
        leaves = work.save(leaves, "leaves")
        n = leaves.count()
        asked = max(1, min(partitions(work.spark), math.ceil(n / LEAST)), math.ceil(n / MOST))
        # equal rows are told apart by their place, so that a range can't hold them all
        at = F.monotonically_increasing_id()
        cut = leaves.withColumn("_at", at).repartitionByRange(asked, "tree", *order, "leaf", "_at").sortWithinPartitions("tree", *order, "leaf", "_at")
        mid = F.monotonically_increasing_id()
        cut = cut.withColumn("_at", mid).select("tree", "leaf", *order, *carry, F.shiftright("_at", 33).alias("part"), F.expr("_at & 8589934591").alias("row"))
        self.leaves = work.save(cut, "cut")
        by_tree = Window.partitionBy("tree")
        spans = self.leaves.groupBy("part", "tree").agg(F.min("row").alias("first"), F.count("*").alias("cnt"))
        spans = spans.withColumn("start", F.coalesce(F.sum("cnt").over(by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        self.spans = work.save(spans.withColumn("n", F.sum("cnt").over(by_tree)), "spans")
        #: as many as there came to be, which need not be as many as asked for
        self.parts = 1 + (self.spans.agg(F.max("part")).first()[0] or 0)
        self._merge()

    def _spans(self, more: DataFrame | None = None) -> DataFrame:
        spans = self.spans if more is None else self.spans.join(more, "tree")
        return _shape(spans, part="part", kind="0", tree="tree", a="first", b="start", n="n", **({} if more is None else {"h": "subroot", "x": "root", "more": "above"}))

    def _leaves(self, **cols) -> DataFrame:
        return _shape(self.leaves, part="part", kind="9", tree="tree", a="row", h="leaf", **cols)

    def _merge(self) -> None:
        work, parts = self.work, self.parts
        found = work.save(_dealt([self._spans(), self._leaves()], parts).mapInArrow(_local, _OPEN_DDL), "open")
        nodes, rounds = found.where("kind = 0"), []
        while True:
            parts = math.ceil(parts / FAN)
            stream = _shape(nodes, part=f"part div {FAN}", kind="0", tree="tree", a="idx", b="level", n="n", h="h")
            rounds.append(work.save(_dealt([stream], parts).mapInArrow(_reduce, _OPEN_DDL + ", run array<string>"), "reduced"))
            nodes = rounds[-1].where("kind = 0")
            if parts == 1:
                break
        self.subroots = nodes.select("tree", "h", "n")
        runs = rounds[0]
        for r in rounds[1:]:
            runs = runs.unionByName(r)
        needed = found.where("kind = 1").select("part", "tree", "level", "idx")
        self.context = needed.join(runs.where("kind = 2").select("tree", "level", "idx", "run"), ["tree", "level", "idx"])

    def climb(self, task: Callable, ddl: str | StructType, more: DataFrame | None = None, **cols) -> DataFrame:
        context = _shape(self.context, part="part", kind="1", tree="tree", a="idx", b="level", more="run")
        return _dealt([self._spans(more), context, self._leaves(**cols)], self.parts).mapInArrow(task, ddl)


def _top(batches):
    """Per subroot its path to the root as a flat list (before, after, ...)."""
    for _, _, _, each in _paths(batches):
        rows = [(r[7], r[6], fold(r[6], p), [s for pair in p for s in pair]) for r, p in each]
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 3 + [pa.list_(pa.string())])], names=["tree", "subroot", "root", "above"])


def _proofs(batches):
    """Per leaf its proof, and the root folded from what the row holds now."""
    for _, _, span, each in _paths(batches):
        subroot, root, flat = span[6], span[7], span[8]
        upper = list(zip(flat[::2], flat[1::2]))
        out: list[list] = [[], [], [], []]
        for r, path in each:
            path = [*path, *upper]
            got = fold(r[7] or r[6], path)
            for c, v in zip(out, (r[3], r[6], digest(*[s for pair in path for s in pair]), got)):
                c.append(v)
        k = len(out[0])
        arrays = [pa.array([span[0]] * k, pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array([subroot] * k, pa.string()), pa.array([root] * k, pa.string())]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(out[2], pa.string()), pa.array(out[3], pa.string()), pa.array([f == root for f in out[3]], pa.bool_())], names=_PROOF_NAMES)


_PROOF_NAMES = ["part", "row", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
_PROOF_DDL = "part long, row long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_of(fields: dict[str, F.Column] | None = None, names: tuple = FIELDS):
    """The leaf: sha256 of byte count, colon and value of each field, ``-`` for a null."""
    parts = []
    for name in names:
        c = (fields or {}).get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def manifest(spark: SparkSession, rows: DataFrame, id_col: str = "doc_id", key: str = "lang", names: tuple = FIELDS) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    ``rows`` may have a column ``_now``: the leaf of what the row holds today.  Where it is set, the root is folded from
    it, so that ``verified`` tells whether the row is still the one of the manifest."""
    work = Work(spark, "merkle")
    current = F.col("_now") if "_now" in rows.columns else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("1"), F.col(key).cast("string")), F.lit("0"))
    leaves = rows.select(tree.alias("tree"), F.col(id_col).alias("_id"), leaf_of(names=names).alias("leaf"), current.alias("_now"))
    forest = Forest(work, leaves, ["_id"], ["_now"])
    # the subroots are the leaves of one more tree; its leaves carry the key they stand for
    tops = forest.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("_key"), F.col("h").alias("leaf"))
    above = work.save(Forest(work, tops, ["_key"]).climb(_top, "tree string, subroot string, root string, above array<string>", x="_key"), "above")
    proofs = work.save(forest.climb(_proofs, _PROOF_DDL, above, x="_now"), "proofs")
    ids = forest.leaves.select("part", "row", F.col("_id").alias(id_col))
    return ids.join(proofs, ["part", "row"]).select(id_col, *_PROOF_NAMES[2:])


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    lowered = leaf_of({"text": F.translate("text", UPPER, LOWER)})
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(spark, docs.withColumn("_now", F.when(tampered, lowered)))


_H = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(_H.format(f"cast({c} as varchar)") for c in FIELDS[:4]) + " || {0})"
ORACLE = f"""
with recursive d as (
  select doc_id, coalesce('1' || lang, '0') as tree, {_LEAF.format(_H.format("text"))} as leaf, {_LEAF.format(_H.format(f"translate(text, '{UPPER}', '{LOWER}')"))} as low,
    list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(1, strlen(cast(doc_id as varchar)) + 1), lambda i: cast(ord(substr(cast(doc_id as varchar), i, 1)) as bigint))),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda t, i: case when t & 1 = 1 then xor(t >> 1, 3988292384) else t >> 1 end)) as crc
  from documents),
leaves as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by tree) as n from d),
nodes as (
  select tree, 0 as level, idx, leaf as h, n as w from leaves
  union all
  select tree, level + 1, idx // 8, sha256(string_agg(h, '' order by idx)), (w + 7) // 8 from nodes where w > 1 group by tree, level, idx // 8, w),
subs as (select tree, h, row_number() over (order by tree) - 1 as idx, count(*) over () as n from nodes where w = 1),
tops as (
  select 0 as level, idx, h, n as w from subs
  union all
  select level + 1, idx // 8, sha256(string_agg(h, '' order by idx)), (w + 7) // 8 from tops where w > 1 group by level, idx // 8, w),
every as (select tree, level, idx, h, w from nodes where w > 1 union all select 'top', level, idx, h, w from tops where w > 1),
sides as (
  select a.tree, a.level, a.idx, coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx < a.idx), '') as before, coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx > a.idx), '') as after
  from every a join every b on a.tree = b.tree and a.level = b.level and a.idx // 8 = b.idx // 8 group by a.tree, a.level, a.idx),
climb as (
  select tree as home, idx as place, tree, 0 as level, idx, case when xor(crc, 4294967295) % 3 = 0 then low else leaf end as h, '' as sibs from leaves
  union all
  select c.home, c.place, s.tree, c.level + 1, c.idx // 8, sha256(s.before || c.h || s.after), c.sibs || s.before || s.after from climb c join sides s on c.tree = s.tree and c.level = s.level and c.idx = s.idx),
mid as (select home, place, h, sibs from climb qualify row_number() over (partition by home, place order by level desc) = 1),
climb2 as (
  select m.home, m.place, 0 as level, s.idx, m.h, m.sibs from mid m join subs s on m.home = s.tree
  union all
  select c.home, c.place, c.level + 1, c.idx // 8, sha256(s.before || c.h || s.after), c.sibs || s.before || s.after from climb2 c join sides s on s.tree = 'top' and c.level = s.level and c.idx = s.idx),
done as (select home, place, h, sibs from climb2 qualify row_number() over (partition by home, place order by level desc) = 1),
root as (select h from tops where w = 1)
select l.doc_id, l.leaf, s.h as subroot, r.h as root, sha256(d.sibs) as proof_sha256, d.h as folded_root, d.h = r.h as verified
from leaves l join done d on l.tree = d.home and l.idx = d.place join subs s on s.tree = l.tree cross join root r
"""
