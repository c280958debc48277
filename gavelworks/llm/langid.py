"""Hierarchical language ID.

Byte trigrams of the lower-cased letters of the *whole* text, square-rooted and
scaled to unit length, feed two levels of linear support vector machines: one
versus the rest between language families, then one versus one between the
languages of a family.  The score is the family's logistic share times the
language's share of its pairwise duels.  The score says which of the learned languages
is nearest, not that it is one of them: texts in mixed languages score as low as gibberish.
Whether a text is in learned languages at all is told by the share of its trigrams
that no training row holds (its lower confidence bound, for the sake of short texts).

Training takes every row of the folds.  Their trigrams are written once, in a compact form, and each pass of the
optimiser (limited-memory BFGS on the sum over all rows, all machines side by side) reads them in as many tasks as there
are cores; a task gives back its part of the loss and of the gradient, so nothing that grows with the rows
leaves the workers.  Rows repeated in doc_id and text count once.  All languages are learned.  Everything is predicted, training rows included.

A letter is a character of Unicode category L: digits, number signs and symbols are none.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import records
from .common import Work, plus, ship, table

DIM = 8192
_MAYBE = re.compile(r"[^\W\d_]")
#: fixed values: families of ISO 639-1 codes; a code not listed is a family of its own
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky",
    "indic": "hi bn mr ne gu pa ur",
    "semitic": "ar he mt am",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "malayic": "id ms jv su",
}
_FAMILY = {code: fam for fam, codes in FAMILIES.items() for code in codes.split()}
_SPACE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether a character of category L is there; the pattern alone would take number signs such as \u00bd for letters."""
    return any(m[0].isalpha() for m in _MAYBE.finditer(text))


def features(text: str | None) -> np.ndarray | None:
    """Counts of hashed byte trigrams; None if the text has no letter."""
    if not text or not has_letter(text):
        return None
    raw = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_SPACE) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    tri = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    tri = tri[(tri & np.uint32(0xFFFF)) != 0x2020]
    return np.bincount((tri * np.uint32(2654435761)) >> np.uint32(19), minlength=DIM)


def unit(h: np.ndarray) -> np.ndarray:
    x = np.sqrt(h.astype(np.float32))
    return x / max(float(np.sqrt((x * x).sum())), 1e-9)


def machines(langs: list[str]) -> tuple[list[str], list[list[int]], list[tuple[int, int]]]:
    """Families, the languages of each, and the duels within them."""
    family = sorted({_FAMILY.get(a, a) for a in langs})
    members = [[i for i, a in enumerate(langs) if _FAMILY.get(a, a) == f] for f in family]
    return family, members, [d for m in members for d in combinations(m, 2)]


class Model:
    """Two-level linear model; ``langs`` sorted, empty if nothing was learned."""

    def __init__(self, langs: list[str], w: np.ndarray, seen: np.ndarray):
        self.langs, self.w, self.seen = langs, w, seen
        self.family, self.members, self.duels = machines(langs)
        self.top = len(self.family) if len(self.family) > 1 else 0

    def unseen(self, h: np.ndarray | None) -> float:
        """Share of the trigrams that are in no learned language; 1 without a letter."""
        return 1.0 if h is None else float(h[~self.seen].sum() / max(1, h.sum()))

    def strange(self, h: np.ndarray | None, most: float) -> bool:
        """Whether more than ``most`` of the trigrams are unseen for sure: the lower 99 % bound of their share is
        above it, so that one odd word doesn't speak for a short text."""
        u = self.unseen(h)
        return h is None or u - 2.33 * float(np.sqrt(u * (1 - u) / max(1, h.sum()))) > most

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.told(features(text))

    def told(self, h: np.ndarray | None) -> tuple[str, float]:
        if h is None or not self.langs:
            return "und", 0.0
        at = np.flatnonzero(h)
        m = self.w[:, at] @ unit(h[at]) + 0.3 * self.w[:, -1]
        p = 1 / (1 + np.exp(-4 * np.clip(m, -8, 8)))
        fam, score = 0, 1.0
        if self.top:
            fam = int(np.argmax(p[: self.top]))
            score = float(p[fam] / p[: self.top].sum())
        members = self.members[fam]
        if len(members) == 1:
            return self.langs[members[0]], score
        share = dict.fromkeys(members, 0.0)
        for (a, b), q in zip(self.duels, p[self.top :]):
            if a in share:
                share[a] += float(q)
                share[b] += 1 - float(q)
        best = max(members, key=lambda i: (share[i], -i))
        return self.langs[best], score * share[best] / (len(members) - 1)


#: a trigram is in a language that holds it in one of so many of its training rows at least: in a large corpus some row holds
#: almost every trigram
ONE_IN = 600
_ROWS = "lang string, h long, at binary, root binary"


def train(spark: SparkSession, docs: DataFrame, per_lang: int | None = None, most: int | None = None, seed: int = 7, least: int = 8, langs: int | None = None) -> Model:
    """Fit on all rows with text, lang and crc32(doc_id) mod 3 other than 1.

    Only for a caller who asks for a smaller model: ``langs``, the commonest so many languages; ``per_lang`` and ``most``,
    about so many rows a language and in all, but ``least`` a language."""
    work = Work(spark, "langid")
    rows = docs.where("text is not null and lang is not null and doc_id is not null").where(~held_out())
    rows = rows.select("lang", F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"), "text")
    kept = work.save(rows.mapInArrow(_trigrams, _ROWS).groupBy("lang", "h").agg(F.first(F.struct("at", "root")).alias("x")).select("lang", "h", "x.*"), "trigrams")
    n = kept.groupBy("lang").agg(F.count("*").alias("n"))
    n = n if langs is None else n.orderBy(F.desc("n"), "lang").limit(langs)
    n = {r["lang"]: r["n"] for r in n.collect()}
    if not n:
        return Model([], np.zeros((0, DIM + 1), np.float32), np.zeros(DIM, bool))
    kept = kept.where(F.col("lang").isin(*n)) if langs is not None else kept
    if per_lang is not None or most is not None:
        each = max(least, min(per_lang or max(n.values()), (most or sum(n.values())) // len(n)))
        kept = kept.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("_k") <= each).drop("_k")
        kept = work.save(kept, "fewer")
    names = sorted(n)
    # the file's parts are dealt to as many tasks as there are cores
    kept = kept.select("lang", "at", "root").coalesce(spark.sparkContext.defaultParallelism)
    held = _held(kept, names)
    count = held[:, -1]
    seen = (held[:, :-1] * ONE_IN >= np.maximum(count, 1)[:, None]).any(0)
    model = Model(names, _fit(kept, names, count), seen)
    return model


def _trigrams(batches):
    """The trigrams of every text with a letter: their places and the roots of their counts."""
    for rb in batches:
        at, root, keep = [], [], []
        for t in rb.column("text"):
            h = features(t.as_py())
            keep.append(h is not None)
            if h is not None:
                i = np.flatnonzero(h)
                at.append(i.astype(np.uint16).tobytes())
                root.append(np.sqrt(h[i]).astype(np.float16).tobytes())
        few = rb.select(["lang", "h"]).filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([*few.columns, pa.array(at, pa.binary()), pa.array(root, pa.binary())], names=["lang", "h", "at", "root"])


def _blocks(batches, names: list[str], rows: int = 500):
    """(language numbers, starts, places, unit values) of some rows at a time."""
    number = {a: i for i, a in enumerate(names)}
    for rb in batches:
        for k in range(0, rb.num_rows, rows):
            some = rb.slice(k, rows)
            at = [np.frombuffer(x.as_buffer(), np.uint16) for x in some.column(1)]
            root = np.concatenate([np.frombuffer(x.as_buffer(), np.float16) for x in some.column(2)]).astype(np.float32)
            size = np.array([len(x) for x in at])
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            norm = np.sqrt(np.add.reduceat(root * root, start))
            yield np.array([number[x] for x in some.column(0).to_pylist()]), start, np.concatenate(at).astype(np.int64), root / np.repeat(norm, size), size


def _summed(rows: DataFrame, shape: tuple, part) -> np.ndarray:
    """The sum of the arrays that ``part(batches)`` gives in each task."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([part(batches).astype(np.float64).tobytes()], pa.binary())], names=["x"])

    out = np.zeros(shape)
    for r in rows.mapInArrow(run, "x binary").collect():
        out += np.frombuffer(r["x"], np.float64).reshape(shape)
    return out


def _held(rows: DataFrame, names: list[str]) -> np.ndarray:
    """Rows of each language that hold each trigram; rows of the language last."""

    def part(batches):
        out = np.zeros((len(names), DIM + 1), np.int64)
        for y, _, at, _, size in _blocks(batches, names):
            out[:, :-1] += np.bincount(np.repeat(y, size) * DIM + at, minlength=len(names) * DIM).reshape(len(names), DIM)
            out[:, -1] += np.bincount(y, minlength=len(names))
        return out

    return _summed(rows, (len(names), DIM + 1), part)


def _fit(rows: DataFrame, names: list[str], count: np.ndarray, passes: int = 40, reg: float = 1e-4, near: float = 0.005) -> np.ndarray:
    """Linear support vector machines (squared hinge, both sides weighted alike, bias last) over all rows: families one
    versus the rest, then the duels.  It ends when every gradient is ``near`` of its first length, or after ``passes``."""
    family, members, duels = machines(names)
    sides = [np.array([1.0 if i in m else -1.0 for i in range(len(names))]) for m in members] if len(members) > 1 else []
    mirrored = len(sides) == 2  # the second of two families is the first one's negative
    sides = sides[:1] if mirrored else sides
    top = len(sides)
    for a, b in duels:
        sides.append(np.zeros(len(names)))
        sides[-1][[a, b]] = 1.0, -1.0
    if not sides:
        return np.zeros((0, DIM + 1), np.float32)
    side = np.stack(sides)
    share = np.where(side > 0, 0.5 / np.maximum(1, (count * (side > 0)).sum(1))[:, None], 0.5 / np.maximum(1, (count * (side < 0)).sum(1))[:, None]) * (side != 0)

    def loss(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = w.astype(np.float32)

        def part(batches):
            out = np.zeros((len(v), DIM + 2))
            for y, start, at, val, size in _blocks(batches, names):
                for k in range(len(v)):
                    s = side[k, y]
                    if not s.any():
                        continue
                    slack = np.maximum(0, 1 - s * (np.add.reduceat(v[k, at] * val, start) + 0.3 * v[k, -1])) * (s != 0)
                    c = share[k, y]
                    pull = -2 * c * s * slack
                    out[k, -1] += (c * slack * slack).sum()
                    out[k, -2] += 0.3 * pull.sum()
                    if pull.any():
                        out[k, :-2] += np.bincount(at, weights=val * np.repeat(pull, size), minlength=DIM)
            return out

        got = _summed(rows, (len(v), DIM + 2), part)
        return got[:, -1] + reg / 2 * (w * w).sum(1), got[:, :-1] + reg * w

    w = np.zeros((len(side), DIM + 1))
    f, g = loss(w)
    first = np.linalg.norm(g, axis=1)
    past: list[list] = [[] for _ in side]
    to, step = [-x for x in g], np.full(len(side), 0.45)
    for _ in range(passes - 1):
        open_ = [k for k in range(len(side)) if np.linalg.norm(g[k]) > near * first[k]]
        if not open_:
            break
        trial = w.copy()
        for k in open_:
            trial[k] += step[k] * to[k]
        f2, g2 = loss(trial)
        for k in open_:
            if f2[k] > f[k] + 1e-4 * step[k] * (g[k] @ to[k]):
                step[k] *= 0.4
                continue
            s, d = trial[k] - w[k], g2[k] - g[k]
            if s @ d > 1e-12:
                past[k] = [*past[k][-9:], (s, d)]
            w[k], f[k], g[k], step[k] = trial[k], f2[k], g2[k], 1.0
            to[k] = -_turned(g[k], past[k])
    w = np.concatenate([w[:1], -w[:1], w[1:]]) if mirrored else w
    return w.astype(np.float32)


def _turned(g: np.ndarray, past: list) -> np.ndarray:
    """The gradient times the inverse curvature that the last steps tell of."""
    q, told = g.copy(), []
    for s, d in reversed(past):
        a = (s @ q) / (s @ d)
        told.append(a)
        q -= a * d
    if past:
        s, d = past[-1]
        q *= (s @ d) / (d @ d)
    for (s, d), a in zip(past, reversed(told)):
        q += s * (a - (d @ q) / (s @ d))
    return q


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def identify(spark: SparkSession, docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs plus lang_pred and score (0 to 1); one row per input row.

    Null texts and texts without a letter are ``und`` with score 0, as is
    everything if no language was learned.  Very long texts are read whole.  Repeated rows
    get the same answer each; of equal scores the family or language first in the alphabet
    wins; an empty table gives an empty one.  Columns of docs already named so are replaced."""
    ship(spark)
    keep = [c for c in docs.columns if c.lower() not in names]
    df = docs.select(*[F.col(f"`{c}`") for c in keep])

    def run(batches):
        for rb in batches:
            got = [model.predict(t.as_py()) for t in rb.column("text")]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*rb.schema.names, *names])

    schema = plus(df.schema, f"{names[0]} string, {names[1]} double")
    return df.mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(spark, docs)
    return identify(spark, docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: a document passes language ID with at most this share of unseen trigrams; foreign scripts, random letters and an
#: unlearned language start at 0.27
MOST_UNSEEN = 0.2


def allowance(spark: SparkSession, docs: DataFrame, model: Model, most: int | None = None, seed: int = 7) -> float:
    """MOST_UNSEEN, or three times the exact 95 % quantile of all held-out rows where the training rows were too few to know
    their trigrams; repeated rows count once.  Only for a caller who asks for them, the ``most`` rows of least hash."""
    rows = docs.where("text is not null and lang is not null and doc_id is not null").where(held_out()).select("text", F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"))
    rows = rows if most is None else rows.dropDuplicates(["h"]).orderBy("h").limit(most)

    def run(batches):
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column("h"), pa.array([model.unseen(features(t.as_py())) for t in rb.column("text")], pa.float64())], names=["h", "u"])

    work = Work(spark, "allowance")
    told = work.save(rows.mapInArrow(run, "h long, u double").groupBy("h").agg(F.first("u").alias("u")).select(F.lit(0).alias("one"), "u"), "unseen")
    got = records.quantiles(told, ["one"], "u", {"q": 0.95}).collect()
    return max(MOST_UNSEEN, 3 * got[0]["q"]) if got else MOST_UNSEEN


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in learned languages, one or several; texts without letters, in unlearned languages and gibberish go.

    Kept rows whose lang is null get the predicted one, so that later stages can budget them by language;
    a lang that is there stays.  Repeated rows are judged alike; an empty table gives an empty one."""
    model = train(spark, docs)
    if not model.langs:
        return docs.where("false")
    most = allowance(spark, docs, model)
    at, to = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        for rb in batches:
            keep, lang = [], rb.column(to).to_pylist()
            for i, t in enumerate(rb.column(at)):
                # one text's counts at a time: those of a whole batch would take half a gigabyte
                h = features(t.as_py())
                said = model.told(h)[0]
                keep.append(said != "und" and not model.strange(h, most))
                lang[i] = said if lang[i] is None else lang[i]
            cols = [pa.array(lang, c.type) if i == to else c for i, c in enumerate(rb.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=rb.schema.names).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
