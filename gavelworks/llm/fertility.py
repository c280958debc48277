"""Quality rules from tokeniser fertility.

Two public vocabularies measure every whole text: characters per token of a
multilingual byte-level vocabulary, and the share of byte-fallback tokens and the
entropy of the token ids of a piece vocabulary.  A text is rejected when a
measure leaves the band of its language and length (of its script where the
language is null or rare).  Bands lie around the median over all documents: ``WIDTH`` robust deviations
(0.7413 * the quartile distance) to either side, and ``FLOOR`` at least, so that a band of
near-equal texts doesn't cut ordinary ones.  The floor widens with the error of a mean over fewer
than ``SHORT`` tokens.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Work, table
from .jaccard import U, _mix, _R

VOCAB_DIR = "/opt/tokenizers"
WIDTH = 5.0
#: least half width of a band: characters per token (0.33 is the spread of clean texts of one language), byte share
#: (one emoji in fifty tokens), entropy excess (bits)
FLOOR = {"cpt": 0.35, "bytes": 0.08, "excess": 1.2}
SHORT = 128
#: a language needs so many documents for a band of its own
LEAST_DOCS = 30
#: words a process keeps, texts whose words are tokenised in one call
CACHE, PART = 500_000, 200
#: bands (a few hundred bytes each) are sent to every executor up to this counted number, else joined by shuffle
FEW_BANDS = 20_000
_SYMBOLS = "#*$%&|<>"
_TOKENIZERS: dict = {}


class Vocabularies:
    """Both vocabularies and the words seen by this process: word -> number, and per number its
    pieces (a slice of one flat array), its byte-level tokens and how often it was met."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        with open(f"{folder}/byte_bpe_multi_50k.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # words come one by one, so the split pattern only parts letters, digits and the rest
        pat = r" ?[\p{L}\p{M}]+| ?\p{N}{1,3}| ?[^\s\p{L}\p{M}\p{N}]+|\s+"
        self.enc = tiktoken.Encoding("multi", pat_str=pat, mergeable_ranks=ranks, special_tokens={})
        self.sp = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.vocab_size())])
        self.ids: dict[bytes, int] = {}
        self.flat = np.empty(0, np.uint16)
        self.start, self.size, self.multi, self.met = (np.empty(0, np.int64) for _ in range(4))

    def learn(self, words: set[bytes]) -> None:
        """Tokenise the words that are not known yet."""
        fresh = [w for w in words if w not in self.ids]
        if not fresh:
            return
        if self.ids and len(self.ids) + len(fresh) > CACHE:
            self.forget(words)
            fresh = [w for w in words if w not in self.ids]
        plain = [w.decode("utf-8", "replace") for w in fresh]
        pieces = self.sp.encode(plain, num_threads=1)
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter(chain.from_iterable(pieces), np.uint16, int(n.sum()))
        ordinary = self.enc.encode_ordinary
        multi = np.fromiter((len(ordinary(" " + p)) for p in plain), np.int64, len(plain))
        at = len(self.ids)
        self.ids.update(zip(fresh, range(at, at + len(fresh))))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(n) - n))
        self.flat = np.concatenate((self.flat, flat))
        self.size, self.multi = np.concatenate((self.size, n)), np.concatenate((self.multi, multi))
        self.met = np.concatenate((self.met, np.zeros(len(fresh), np.int64)))

    def forget(self, needed: set[bytes]) -> None:
        """Keep the needed words and, of the others, the half met most often."""
        order = np.argsort(-self.met, kind="stable")[: CACHE // 2]
        stays = np.zeros(len(self.met), bool)
        stays[order] = self.met[order] > 1
        self.ids = {w: i for w, i in self.ids.items() if stays[i] or w in needed}
        old = np.fromiter(self.ids.values(), np.int64, len(self.ids))
        self.flat = self.flat[_slices(self.start[old], self.size[old])]
        self.size, self.multi, self.met = self.size[old], self.multi[old], self.met[old] // 2
        self.start = np.cumsum(self.size) - self.size
        self.ids = dict(zip(self.ids, range(len(old))))


def _slices(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of the slices (start, size), one after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def tokenizers(folder: str) -> tuple:
    """(piece processor, byte-level encoding, which pieces are bytes, word table) of this process."""
    if folder not in _TOKENIZERS:
        v = Vocabularies(folder)
        _TOKENIZERS[folder] = (v.sp, v.enc, v.is_byte, v)
    return _TOKENIZERS[folder]


@lru_cache(1 << 16)
def _script_of(code: int) -> str | None:
    """Script of a letter, None for what is no letter."""
    c = chr(code)
    return unicodedata.name(c, "OTHER").split(" ")[0].lower() if c.isalpha() else None


def script(text: str) -> str:
    """Commonest script over all letters of the text."""
    n = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64))
    names: dict[str, int] = {}
    for code in np.flatnonzero(n).tolist():
        name = _script_of(code)
        if name:
            names[name] = names.get(name, 0) + int(n[code])
    return max(names, key=lambda k: (names[k], k)) if names else "none"


def repeated_words(ids: np.ndarray, width: int = 8) -> int:
    """Words, given by numbers, inside windows of ``width`` words that occur twice or more, the first included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    h = _mix(ids.astype(np.uint64) + U(1))
    acc = np.zeros(n, np.uint64)
    for i in range(width):
        acc += h[i : n + i] * _R[i]
    order = np.argsort(acc, kind="stable")
    s = acc[order]
    same = np.zeros(n, bool)
    eq = s[1:] == s[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    at = order[same]
    if not len(at):
        return 0
    step = np.bincount(at, minlength=len(ids) + 1) - np.bincount(at + width, minlength=len(ids) + 1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def measures(text: str | None, folder: str = VOCAB_DIR) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, tokens, cpt, byte share, entropy)."""
    return next(batch_measures([text], folder))


def batch_measures(texts: list[str | None], folder: str = VOCAB_DIR):
    """``measures`` of each text; the unknown words of all texts are tokenised in one call."""
    v = tokenizers(folder)[3]
    split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    v.learn(set(chain.from_iterable(split)))
    for text, words in zip(texts, split):
        symbols = sum(map(text.count, _SYMBOLS)) if text else 0
        if not words:
            yield 0, 0, symbols, 0, 0, 0, 0.0, 0.0, 0.0
            continue
        chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
        seen, dup = set(), 0
        for line in text.split("\n"):
            if line.strip("\x20\t\n\v\f\r"):
                dup += line in seen
                seen.add(line)
        ids = np.fromiter(map(v.ids.__getitem__, words), np.int64, len(words))
        once, n = np.unique(ids, return_counts=True)
        v.met[once] += n
        repeat = repeated_words(ids) if len(once) < len(ids) else 0
        size = v.size[once]
        pieces, each = v.flat[_slices(v.start[once], size)], np.repeat(n, size)
        c = np.bincount(pieces, each)
        total = int(size @ n)
        p = c[np.flatnonzero(c)] / max(1, total)
        multi = int(v.multi[once] @ n)
        yield len(words), chars, symbols, dup, repeat, total, chars / max(1, multi), float(each[v.is_byte[pieces]].sum() / max(1, total)), float(-(p * np.log2(p)).sum())


_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, cpt double, bytes double, entropy double, script string"


def measure(spark: SparkSession, docs: DataFrame, carry: list[str], folder: str = VOCAB_DIR) -> DataFrame:
    """Carried columns plus the measures of ``text``; carried names equal to a measure's are left out."""
    schema = T.StructType.fromDDL(_FIELDS)
    carry = [c for c in carry if c not in schema.fieldNames() and c != "text"]
    src = docs.select("text", *[F.col(f"`{c}`") for c in carry])

    def run(batches):
        for rb in batches:
            got = []
            for at in range(0, rb.num_rows, PART):
                texts = rb.column("text").slice(at, PART).to_pylist()
                got += [(*m, script(t or "")) for m, t in zip(batch_measures(texts, folder), texts)]
            cols = [pa.array(list(x), ty) for x, ty in zip(zip(*got), [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.string()])] if got else [pa.array([], ty) for ty in [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.string()]]
            yield pa.RecordBatch.from_arrays([*rb.columns[1:], *cols], names=[*rb.schema.names[1:], *schema.fieldNames()])

    return src.mapInArrow(run, T.StructType([*src.schema.fields[1:], *schema.fields]))


def verdicts(spark: SparkSession, docs: DataFrame, carry: list[str] = ("doc_id",), folder: str = VOCAB_DIR, work: Work | None = None) -> DataFrame:
    """Measures, ``base_failed``, ``kept`` and the bands' verdict per row of docs.

    Null, empty and white-space texts have no words: base_failed, not kept."""
    work = work or Work(spark, "fertility")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    m = measure(spark, docs.withColumn("_gw_lang", lang), [*carry, "_gw_lang"], folder)
    m = m.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    # entropy against the length: what is left after the slope shared by all texts of a language
    m = m.withColumn("excess", F.col("entropy") - F.log2(F.greatest(F.col("n_tokens"), F.lit(2)).cast("double")))
    m = work.save(m, "measures")
    good = m.where(~F.col("base_failed"))
    size = F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(2)).cast("double"))).cast("int")

    scopes = [("_gw_lang", "_gw_size"), ("_gw_lang",), ("script", "_gw_size"), ("script",)]
    sized = good.withColumn("_gw_size", size)
    quart = [F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"_gw_{c}") for c in FLOOR]
    all_keys = {"_gw_lang": "string", "script": "string", "_gw_size": "int"}
    parts = []
    for i, keys in enumerate(scopes):
        b = sized.groupBy(*keys).agg(F.count("*").alias("_gw_n"), *quart).where(F.col("_gw_n") >= LEAST_DOCS)
        parts.append(b.select(F.lit(i).alias("_gw_scope"), *[F.col(k) if k in keys else F.lit(None).cast(t).alias(k) for k, t in all_keys.items()], *[f"_gw_{c}" for c in FLOOR]))
    found = work.save(reduce(DataFrame.unionByName, parts), "bands")
    few = found.limit(FEW_BANDS + 1).count() <= FEW_BANDS

    def bands(i: int) -> DataFrame:
        b = found.where(F.col("_gw_scope") == i).select(*scopes[i], *[F.col(f"_gw_{c}").alias(f"_gw_{c}{i}") for c in FLOOR])
        return F.broadcast(b) if few else b

    def outside(c: str):
        q = F.col(f"_gw_{c}")
        short = F.lit(1.0) if c == "excess" else F.sqrt(F.greatest(SHORT / F.greatest(F.col("n_tokens"), F.lit(1)), F.lit(1.0)))
        half = F.greatest(WIDTH * 0.7413 * (q[2] - q[0]), FLOOR[c] * short)
        return F.coalesce(F.abs(F.col(c) - q[1]) > half, F.lit(False))

    m = m.withColumn("_gw_size", size)
    # texts of a rare length go by their whole language, rare languages by their script and length, then their script;
    # entropy is only held against texts of its length: of the language, or else of the script
    j = m
    for i, keys in enumerate(scopes):
        j = j.join(bands(i), list(keys), "left")
    for c in FLOOR:
        j = j.withColumn(f"_gw_{c}", F.coalesce(*[F.col(f"_gw_{c}{i}") for i, keys in enumerate(scopes) if c != "excess" or "_gw_size" in keys]))
    bad = outside("cpt") | outside("bytes") | outside("excess")
    j = j.withColumn("out_of_band", bad).withColumn("kept", ~F.col("base_failed") & ~bad)
    return j.drop("_gw_lang", "_gw_size", *[f"_gw_{c}{i}" for c in FLOOR for i in ["", *range(len(scopes))]], "excess")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(spark, table(spark, sf_dir, "documents"))
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "cpt", F.col("bytes").alias("byte_share"), "entropy")
