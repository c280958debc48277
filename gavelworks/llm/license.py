"""Licence scan: a trained paragraph classifier.

A paragraph is a run of lines without a blank one.  It is read in units: its lines, and windows of
``WINDOW`` words that step by half, so that hard-wrapped notices and notices inside long lines are
both seen.  A unit's sparse word 1-3-grams (those of a template or a counter-example) feed a
multinomial logistic regression over licence families, ``none`` and ``unknown``.  It is trained
here on windows and noisy renderings of the texts in ``license_texts``; a temperature fitted on
wordings left out of the training calibrates it.  ``unknown`` is a class of its own, learned from
licences of no listed family; what stays below ``SURE`` or unconfirmed is ``unknown`` too.

A family is confirmed when the span covers ``COVER`` of the 2-grams of one of its templates, each
weighed by how few families share it, and no template of another family is covered better.

Units without any word of the gate are ``none`` unread: the gate is a cover, chosen by the trained
weights, of all renderings that aren't ``none``.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plus, ship, table
from .license_texts import COUNTER, COUNTER_MORE, OTHER, TEMPLATES

SURE, COVER, WINDOW = 0.6, 0.6, 32
#: units with fewer known grams have less to say
FEW_GRAMS = 8
_TOK = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_CLOSE = re.compile(r"[.!?)\"']*")
_BLANK = re.compile(r"\n[^\S\n]*\n")


def tokens(text: str) -> list[str]:
    return _TOK.findall(text.lower())


def grams(toks: list[str]) -> set[str]:
    return {" ".join(toks[i : i + n]) for n in (1, 2, 3) for i in range(len(toks) - n + 1)}


def pairs(toks: list[str]) -> set[str]:
    return {" ".join(p) for p in zip(toks, toks[1:])}


class Classifier:
    """Weights, gate and templates; small enough to travel with the tasks."""

    def __init__(self, seed: int = 3):
        r = random.Random(seed)
        self.classes = ["none", "unknown", *sorted(TEMPLATES)]
        rows = [(c, tokens(t)) for c, ts in TEMPLATES.items() for t in ts]
        rows += [("unknown", tokens(t)) for t in OTHER] + [("none", tokens(t)) for t in COUNTER + COUNTER_MORE]
        self.vocab: dict[str, int] = {}
        for _, t in rows:
            for g in sorted(grams(t)):
                self.vocab.setdefault(g, len(self.vocab))
        common = sorted({w for _, t in rows for w in t})
        often = [w for _, t in rows for w in t]

        def renderings(part, copies):
            out = []
            for c, t in part:
                for k in range(copies):
                    u = [w for w in t if k < copies // 3 or r.random() > 0.05]
                    if k % 2 and len(u) > WINDOW // 2:  # what a window may see of a long text
                        n = r.randint(WINDOW // 2, min(WINDOW, len(u)))
                        a = r.randrange(len(u) - n + 1)
                        u = u[a : a + n]
                    if k % 4 == 3 and len(u) < WINDOW:  # among other prose
                        around = r.choices(common, k=r.randint(0, 8))
                        at = r.randint(0, len(around))
                        u = around[:at] + u + around[at:]
                    out.append((c, u))
            # words of notices in no order grant nothing, nor do single ones among unknown words
            loose = [[x for w in r.choices(often, k=r.randint(0, 14)) for x in (w, "~")] for _ in range(len(out) // 2)]
            return out + [("none", r.choices(common, k=r.randint(2, WINDOW))) for _ in range(len(out) // 4)] + [("none", x) for x in loose]

        # the temperature is fitted on one wording of each family that has three or more short ones
        left = {id(t) for c in self.classes for t in [t for f, t in rows if f == c and len(t) < 16][2::3]}
        held, kept = [x for x in rows if id(x[1]) in left], [x for x in rows if id(x[1]) not in left]
        self.w, self.sharp = self._fit(renderings(kept, 12)), 1.0
        x, y = self._matrix(renderings(held, 6))
        z = x @ self.w
        self.sharp = float(min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=lambda t: -np.log(_softmax(z * t)[np.arange(len(y)), y] + 1e-12).mean()))
        train = renderings(rows, 16)
        self.w = self._fit(train)
        self.gate = self._gate([set(t) for c, t in train if c != "none"])
        families: dict[str, set[str]] = {}
        for c, t in rows:
            for g in pairs(t):
                families.setdefault(g, set()).add(c)
        self.templates = {c: [{g: len(families[g]) ** -2.0 for g in pairs(tokens(t))} for t in ts] for c, ts in TEMPLATES.items()}

    def _matrix(self, data) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(data), len(self.vocab) + 1), np.float32)
        for i, (_, t) in enumerate(data):
            at = self.known(t)
            x[i, at] = 1 / np.sqrt(max(FEW_GRAMS, len(at)))
        x[:, -1] = 0.5
        return x, np.array([self.classes.index(c) for c, _ in data])

    def _fit(self, data, rounds: int = 400) -> np.ndarray:
        """Multinomial logistic regression, families weighted by the square root of their share (accelerated gradient)."""
        x, y = self._matrix(data)
        n = np.bincount(y, minlength=len(self.classes))
        weight = 1 / np.sqrt(np.maximum(n, 1))
        weight[0] = weight[1:].max()  # most text is none
        weight = weight[y]
        weight = (weight / weight.sum())[:, None].astype(np.float32)
        w = np.zeros((x.shape[1], len(self.classes)), np.float32)
        prev, hot = w.copy(), np.eye(len(self.classes), dtype=np.float32)[y]
        for step in range(rounds):
            look = w + np.float32(step / (step + 3)) * (w - prev)
            grad = x.T @ ((_softmax(x @ look) - hot) * weight) + np.float32(2e-5) * look
            prev, w = w, look - 1.6 * grad
        return w

    def _gate(self, texts: list[set[str]]) -> frozenset:
        """Words that cover all texts, those first that speak most against ``none``."""
        against = {g: float((self.w[i, 1:].max() - self.w[i, 0])) for g, i in self.vocab.items() if " " not in g}
        chosen: set[str] = set()
        for t in texts:
            if chosen.isdisjoint(t):
                best = max((w for w in t if w in against), key=lambda w: (against[w], w), default=None)
                if best:
                    chosen.add(best)
        return frozenset(chosen)

    def known(self, toks: list[str]) -> list[int]:
        """Numbers of the grams of a unit that the model knows."""
        return [i for i in map(self.vocab.get, grams(toks)) if i is not None]

    def probabilities(self, toks: list[str]) -> np.ndarray:
        at = self.known(toks)
        z = self.w[at].sum(0) / np.sqrt(max(FEW_GRAMS, len(at))) + 0.5 * self.w[-1]
        return _softmax(z[None] * self.sharp)[0]

    def covered(self, toks: list[str]) -> tuple[str, float, dict]:
        """(family, share, template) that the words cover best; of equal ones the family first in the alphabet."""
        have, best = pairs(toks), ("", 0.0, {})
        for c in sorted(self.templates):
            for t in self.templates[c]:
                share = sum(w for g, w in t.items() if g in have) / sum(t.values())
                if share > best[1] + 1e-9:
                    best = (c, share, t)
        return best

    def classify(self, paragraph: str) -> tuple[str, float, bool]:
        """(family, none or unknown; probability; confirmed by a template) of one unit."""
        return self.told(tokens(paragraph))

    def told(self, toks: list[str]) -> tuple[str, float, bool]:
        p = self.probabilities(toks)
        i = int(np.argmax(p))
        if i < 2 or p[i] < SURE:
            return ("none" if i == 0 else "unknown"), float(p[i]), False
        fam, share, _ = self.covered(toks)
        sure = fam == self.classes[i] and share >= COVER
        return (self.classes[i] if sure else "unknown"), float(p[i]), sure


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@lru_cache(1)
def classifier() -> Classifier:
    return Classifier()


def lowered(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def scan_text(text: str | None, model: Classifier) -> list[tuple[int, int, str, float, bool]]:
    """(start, end, family, probability, confirmed) of licence notices, by start, without overlaps.

    Confirmed spans come first, the best covered and then the shortest of overlapping ones; what is left of
    units that aren't ``none`` is merged to ``unknown`` spans."""
    if not text:
        return []
    low = lowered(text)
    words = [w for w in model.gate if w in low]
    if not words:
        return []
    toks = [(m.start(), m.end(), m[0]) for m in _TOK.finditer(low)]
    gate = set(words)
    hits = [i for i, t in enumerate(toks) if t[2] in gate]
    if not hits:
        return []
    starts = [t[0] for t in toks]
    said = [t[2] for t in toks]
    breaks = [0, *(m.end() for m in _BLANK.finditer(low)), len(low) + 1]
    out: list[tuple[int, int, str, float, bool]] = []
    at = 0
    while at < len(hits):
        # a stretch of hits that lie near each other within one paragraph, and the words around it
        k = bisect_right(breaks, starts[hits[at]]) - 1
        p_lo, p_hi = bisect_left(starts, breaks[k]), bisect_left(starts, breaks[k + 1])
        last = at
        while last + 1 < len(hits) and hits[last + 1] < p_hi and hits[last + 1] - hits[last] <= WINDOW:
            last += 1
        lo, hi = max(p_lo, hits[at] - WINDOW), min(p_hi, hits[last] + WINDOW + 1)
        units = {(a, min(a + WINDOW, hi)) for a in range(lo, max(lo + 1, hi - WINDOW // 2), WINDOW // 2)}
        for h in hits[at : last + 1]:
            line = low.rfind("\n", 0, starts[h]) + 1
            end = low.find("\n", starts[h])
            a, b = bisect_left(starts, line), bisect_left(starts, len(low) if end < 0 else end)
            if b - a <= 2 * WINDOW:
                units.add((a, b))
        out += _resolve(sorted(units), said, model)
        at = last + 1
    close = _CLOSE.match  # the sentence's end belongs to it
    return [(toks[a][0], close(text, toks[b - 1][1]).end(), fam, p, sure) for a, b, fam, p, sure in sorted(out)]


def _resolve(units: list[tuple[int, int]], said: list[str], model: Classifier) -> list[tuple[int, int, str, float, bool]]:
    """Spans (in words) of the units of one stretch."""
    seen = {}
    for a, b in units:
        p = model.probabilities(said[a:b])
        i = int(np.argmax(p))
        if i:
            seen[a, b] = (i, float(p[i]))
    found = dict(seen)
    # units of one family that touch may hold one longer template
    for i in sorted({i for i, _ in seen.values()} - {1}):
        run = None
        for (a, b), (j, p) in sorted(seen.items()):
            if j != i or b - a > WINDOW and run is None:
                continue
            if run and a <= run[1]:
                run = (run[0], max(run[1], b), max(run[2], p))
            else:
                run = (a, b, p)
            if (run[0], run[1]) not in found:
                found[run[0], run[1]] = (i, run[2])
    sure = []
    for (a, b), (i, p) in found.items():
        if i > 1 and p >= SURE:
            fam, share, template = model.covered(said[a:b])
            if fam == model.classes[i] and share >= COVER:
                # from the template's first words to its last ones
                at = [k for k in range(a, b - 1) if f"{said[k]} {said[k + 1]}" in template]
                a, b = at[0], at[-1] + 2
                sure.append((-share, b - a, a, b, fam, p))
    taken: list[tuple[int, int, str, float, bool]] = []
    for _, _, a, b, fam, p in sorted(sure):
        if all(b <= c or a >= d for c, d, *_ in taken):
            taken.append((a, b, fam, p, True))
    rest: list[list] = []
    for (a, b), (_, p) in sorted(seen.items()):
        if all(b <= c or a >= d for c, d, *_ in taken):
            if rest and a <= rest[-1][1]:
                rest[-1][1], rest[-1][2] = max(rest[-1][1], b), max(rest[-1][2], p)
            else:
                rest.append([a, b, p])
    return taken + [(a, b, "unknown", p, False) for a, b, p in rest]


_OUT = "licenses array<struct<start:bigint,end:bigint,family:string,probability:double,confirmed:boolean>>"


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id and licenses (spans in code points, by start); one row per input row.

    Null and empty texts have none; very long texts are read whole; repeated rows are scanned alike; an empty
    table gives an empty one; of equal scores the family first in the alphabet wins.  Other columns are not
    returned."""
    ship(spark)
    model = classifier()  # trained once, travels with the tasks
    src = docs.select("doc_id", "text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_())]))

    def run(batches):
        for rb in batches:
            got = [[dict(zip(("start", "end", "family", "probability", "confirmed"), x)) for x in scan_text(t.as_py(), model)] for t in rb.column("text")]
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array(got, kind)], names=["doc_id", "licenses"])

    return src.mapInArrow(run, plus(src.schema, _OUT, ("text",)))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(spark, table(spark, sf_dir, "documents"))
    known = F.array_sort(F.array_distinct(F.transform(F.filter("licenses", lambda x: x["confirmed"]), lambda x: x["family"])))
    return s.select("doc_id", F.size("licenses").cast("long").alias("n_paragraphs"), F.size(F.filter("licenses", lambda x: x["family"] == "unknown")).cast("long").alias("n_unknown"), F.array_join(known, ",").alias("families"), "licenses")
