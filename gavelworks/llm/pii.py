"""Personal data by bootstrapped contextual extraction.

Base patterns (email, ip, card, phone) give seed entities.  Every identifier-like
token of the corpus (a seed, or a word with digits that no base pattern covers)
yields lexical patterns from its left and right neighbours together with its
shape.  Spark scores the pattern-instance graph for ``ROUNDS`` rounds: a pattern
is as good as the share of its instances believed to be personal data, an unseen
instance as good as the mean of its patterns with ``SUPPORT`` distinct seeds (patterns
without say nothing; a pattern's weight is the number of its occurrences); an instance at ``ACCEPT`` or better is a seed of the next round.
Unseen tokens in a context of a pattern at ``ACCEPT`` or better, with ``SUPPORT`` distinct
seeds behind it, are added as kind ``id``; base spans always stay.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Work, plus, table

ROUNDS, ACCEPT, SUPPORT = 3, 0.8, 3
KINDS = ["email", "ip", "card", "phone", "id"]
#: fixed values: the base patterns
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]+")
_LETTER = re.compile(r"[^\W\d_]")
#: tokens of punctuation only are looked past
_WORDLIKE = re.compile(r"[^\W_]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_WORD_ANY = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, sorted; leftmost and non-overlapping within a kind."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        # the local part is the run of its characters that ends at this @
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if _DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def key(s: str) -> str:
    """The string itself, or, beyond 64 characters, its beginning and a digest of the whole: long strings stay apart."""
    return s if len(s) <= 64 else s[:32] + "~" + hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def shape(token: str) -> str:
    """Character classes with runs folded, and the length class."""
    s = re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "9", token)))
    return key(re.sub(r"(.)\1+", r"\1", s) + str(len(token).bit_length()))


def _words_before(text: str, at: int) -> list[str]:
    """The last two tokens with a letter or digit before a place; the stretch read grows until it holds them."""
    width = 96
    while True:
        lo = max(0, at - width)
        words = text[lo:at].split()
        if lo and words and not text[lo - 1].isspace() and not text[lo].isspace():
            del words[0]  # begins outside of the stretch
        words = [w for w in words if _WORDLIKE.search(w)][-2:]
        if len(words) == 2 or not lo:
            return [key(w.lower()) for w in words]
        width *= 4


def _word_after(text: str, at: int) -> str:
    """The first token with a letter or digit after a place."""
    for m in _WORD_ANY.finditer(text, at):
        if _WORDLIKE.search(m[0]):
            return key(m[0].lower())
    return ""


def patterns(text: str, start: int, end: int, token_shape: str) -> list[str]:
    """Lexical patterns of an occurrence: two words before; word before and after; word before with the shape."""
    before, after = _words_before(text, start), _word_after(text, end)
    if not before or not _LETTER.search(before[-1]):
        return []
    out = [f"1|{before[-1]}|{token_shape}"]
    if _LETTER.search(after):
        out.append(f"b|{before[-1]}|{after}")
    if len(before) > 1 and _LETTER.search(before[0]):
        out.append(f"2|{before[0]} {before[1]}")
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, bool, list[str]]]:
    """(start, end, instance, seed, patterns): base spans, and words of 6 or more
    characters with 4 or more digits that touch no base span."""
    out = [(s, e, key(text[s:e].lower()), True, patterns(text, s, e, shape(text[s:e]))) for s, k, e in base]
    covered, at, i = sorted((s, e) for s, _, e in base), 0, 0
    m = _DIGITS.search(text)
    while m:
        start, end = m.start(), m.end()
        while start > at and not ("\x09" <= text[start - 1] <= "\x0d" or text[start - 1] == " "):
            start -= 1
        w = _WORD.match(text, start)
        end = w.end()
        # without quotes and punctuation at the ends
        s, e = start, end
        while s < e and not text[s].isalnum():
            s += 1
        while e > s and not text[e - 1].isalnum():
            e -= 1
        while i < len(covered) and covered[i][1] <= s:
            i += 1
        free = all(covered[j][0] >= e or covered[j][1] <= s for j in range(i, len(covered)) if covered[j][0] < e)
        if e - s >= 6 and free and sum("0" <= c <= "9" for c in text[s:e]) >= 4:
            out.append((s, e, key(text[s:e].lower()), False, patterns(text, s, e, shape(text[s:e]))))
        at = end
        m = _DIGITS.search(text, end)
    return out


def _scan(batches):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
    cand = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("inst", pa.string()), ("seed", pa.bool_()), ("pats", pa.list_(pa.string()))])
    for rb in batches:
        base, cands = [], []
        for t in rb.column("text"):
            text = t.as_py() or ""
            b = base_spans(text)
            base.append([{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in b])
            cands.append([dict(zip(("start", "end", "inst", "seed", "pats"), c)) for c in candidates(text, b)] if b or _DIGITS.search(text) else [])
        yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(base, pa.list_(span)), pa.array(cands, pa.list_(cand))], names=[*rb.schema.names, "_gw_base", "_gw_cands"])


_SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


def find_pii(spark: SparkSession, docs: DataFrame, carry: list[str], work: Work | None = None) -> DataFrame:
    """The carried columns plus ``_gw_base`` and ``_gw_spans``: arrays of (start, end, kind)
    in code points, end exclusive, by start and then kind; one row per input row.

    Null and empty texts have no spans; very long texts and tokens are read whole (contexts are
    found by growing the stretch read, tokens beyond 64 characters are told apart by a digest).
    Repeated rows are scanned each, but an instance counts once for a pattern.  Equal beliefs need
    no tie rule: everything at ``ACCEPT`` or better is taken.  An empty table gives an empty one.
    ``docs`` needs a ``text`` column; carried columns may have any names that don't begin with _gw_."""
    work = work or Work(spark, "pii")
    carry = [c for c in carry if not c.startswith("_gw_")]
    src = docs.select(F.col("text").alias("text"), *[F.col(f"`{c}`") for c in carry if c != "text"])
    schema = plus(src.schema, f"_gw_base {_SPANS}, _gw_cands array<struct<start:bigint,end:bigint,inst:string,seed:boolean,pats:array<string>>>")
    scanned = src.mapInArrow(_scan, schema)
    if "text" not in carry:
        scanned = scanned.drop("text")
    rows = work.save(scanned.withColumn("_gw_uid", F.monotonically_increasing_id()), "scan")

    occ = rows.where("size(_gw_cands) > 0").select("_gw_uid", F.explode("_gw_cands").alias("c")).select("_gw_uid", "c.*")
    graph = work.save(
        occ.select("inst", "seed", F.explode("pats").alias("pat")).groupBy("pat", "inst").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "graph"
    )
    believed = None
    for _ in range(ROUNDS):
        g = graph.withColumn("b", F.lit(0.0)) if believed is None else graph.join(believed, "inst", "left")
        g = g.withColumn("sure", F.col("seed") | (F.coalesce("b", F.lit(0.0)) >= ACCEPT))
        pats = g.groupBy("pat").agg(F.avg(F.when(F.col("sure"), 1.0).otherwise(F.coalesce("b", F.lit(0.0)))).alias("conf"), F.sum(F.col("sure").cast("int")).alias("seeds"))
        pats = work.save(pats.where(F.col("seeds") >= SUPPORT).select("pat", "conf"), "patterns")
        new = graph.where("not seed").join(pats, "pat").groupBy("inst").agg((F.sum(F.col("conf") * F.col("n")) / F.sum("n")).alias("b"))
        believed = work.save(new, "beliefs")
    good = pats.where(F.col("conf") >= ACCEPT).select("pat")
    found = occ.where("not seed").select("_gw_uid", "start", "end", F.explode("pats").alias("pat")).join(good, "pat", "left_semi")
    found = found.groupBy("_gw_uid").agg(F.collect_set(F.struct("start", "end", F.lit("id").alias("kind"))).alias("more"))
    some = rows.where("size(_gw_cands) > 0").join(found, "_gw_uid", "left")
    rank = "transform(array_sort(transform(concat(_gw_base, coalesce(more, array())), x -> struct(x.start as start, array_position(array('email','ip','card','phone','id'), x.kind) as k, x.end as end, x.kind as kind))), x -> struct(x.start as start, x.end as end, x.kind as kind))"
    some = some.withColumn("_gw_spans", F.expr(rank).cast(_SPANS)).drop("more")
    none = rows.where("size(_gw_cands) = 0").withColumn("_gw_spans", F.col("_gw_base").cast(_SPANS))
    return some.unionByName(none).drop("_gw_uid", "_gw_cands")


def joined(c: str):
    return F.array_join(F.transform(F.col(c), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark, table(spark, sf_dir, "documents"), ["doc_id"])
    n = lambda k: F.size(F.filter("_gw_base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", n("email"), n("ip"), n("card"), n("phone"), F.sha2(joined("_gw_base"), 256).alias("base_sha256"), joined("_gw_spans").alias("spans"))


def redact(text: str | None, spans: list) -> str | None:
    """Spans replaced by <KIND>; of overlapping ones the union goes under the first's kind."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in spans:
        start, end = s["start"], s["end"]
        if start >= at:
            out += [text[at:start], f"<{s['kind'].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redact(batches):
    for rb in batches:
        spans, texts = rb.column("_gw_spans").to_pylist(), rb.column("text").to_pylist()
        new = pa.array([redact(t, s) for t, s in zip(texts, spans)], pa.string())
        names = [n for n in rb.schema.names if n not in ("_gw_base", "_gw_spans")]
        yield pa.RecordBatch.from_arrays([new if n == "text" else rb.column(n) for n in names], names=names)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every span replaced by its kind; n_chars (if there) follows the new text.

    One row per input row: null and empty texts stay as they are, repeated rows are redacted alike,
    columns may have any names (they are numbered on the way)."""
    cols = docs.columns
    inner = docs.select("text", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols) if c != "text"])
    found = find_pii(spark, inner, inner.columns)
    out = found.mapInArrow(_redact, T.StructType([f for f in found.schema.fields if f.name not in ("_gw_base", "_gw_spans")]))
    n_chars = F.length("text")
    return out.select(*[F.col("text") if c == "text" else (n_chars.cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"c{i}")).alias(c) for i, c in enumerate(cols)])
