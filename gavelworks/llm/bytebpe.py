"""Byte-level BPE: overlapping chunks are pre-tokenised in parallel and stitched where their boundaries meet again.

A text is matched by a pattern from left to right, and each match (pre-token) is merged byte pair by byte pair, lowest
rank first.  A long text is cut into windows of ``STEP`` characters that go on for ``OVERLAP`` more; windows are dealt
to tasks and matched from their own first character, which may lie inside a pre-token.  A match depends on its start
and on what follows, so two windows that share one boundary agree from there on: the first boundary both have in
their common stretch is where one hands over to the next.  Boundaries within ``AHEAD`` characters of a window's end
are not trusted, as a match looks that far ahead (``'re``).  If two windows share no boundary (a run without any,
longer than the overlap), the text is put together again and matched in one piece, which gives the same ids.

Ids are packed as little-endian unsigned 32-bit integers.  Decoding concatenates the raw bytes of the ids.

Defined cases: null and empty texts have no ids; repeated rows each give a row; other columns are not returned; an
empty table gives an empty one.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Work, partitions, plus, ship, table

STEP, OVERLAP, AHEAD = 1 << 16, 1 << 12, 3
CACHE = 100_000
_LOADED: dict = {}


def _spans(points: list[int]) -> str:
    """Code points as the inside of a character class."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(rf"\U{points[i]:08X}-\U{points[j]:08X}")
        i = j + 1
    return "".join(out)


@cache
def spelt(pattern: str) -> tuple[str, bool]:
    """The pattern, with letters and numbers as the public BPE library knows them (a newer Unicode table has more), and
    whether it differs.  Asked once, on the driver: the library's matchers take 100 MB.

    The library doesn't show its matches, so code points newer than Python's own table are put to it behind a letter
    (a digit): with a token that spans both, one token less comes out if they are in one match."""
    import regex
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    drop = {}
    for kind, before in (("L", "a"), ("N", "1")):
        new = [c for c in regex.findall(rf"\p{{{kind}}}", every) if unicodedata.category(c)[0] != kind]
        leads = {c.encode()[0] for c in new}
        ranks = {bytes([b]): b for b in range(256)} | {before.encode() + bytes([b]): 256 + k for k, b in enumerate(sorted(leads))}
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        drop[kind] = [ord(c) for c in new if len(probe.encode_ordinary(before + c)) == 1 + len(c.encode())]
    if not any(drop.values()):
        return pattern, False
    sets = {k: rf"[\p{{{k}}}--[{_spans(v)}]]" if v else rf"\p{{{k}}}" for k, v in drop.items()}
    for k, s in sets.items():
        pattern = pattern.replace(rf"\p{{{k}}}", s)
    return pattern, True


def matcher(pattern: str, as_known: tuple[str, bool] | None = None):
    import regex

    text, differs = as_known or spelt(pattern)
    return regex.compile(text, regex.V1) if differs else regex.compile(text)


#: characters up to here (Latin and its extensions) are classified once, and texts of them matched by the standard library
LATIN = 0x250
_BEYOND = re.compile(f"[^\0-{chr(LATIN - 1)}]")


def latin_matcher(pattern: str) -> re.Pattern:
    """The pattern for texts of characters below ``LATIN``: its classes are spelt out, which is some four times as fast."""
    import regex

    few = "".join(map(chr, range(LATIN)))
    letters, numbers, spaces = ("".join(map(re.escape, regex.findall(c, few))) for c in (r"\p{L}", r"\p{N}", r"\s"))
    # inside a negated class first, where a class can't be nested
    for old, new in ((r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\s", f"[{spaces}]"), (r"\S", f"[^{spaces}]")):
        pattern = pattern.replace(old, new)
    return re.compile(pattern)


class ByteBpe:
    """Vocabulary of ranks (bytes -> id), which hold all single bytes; a rank is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, as_known: tuple[str, bool] | None = None):
        self.ranks, self.match = ranks, matcher(pattern, as_known)
        # only the public pattern is known to be spelt with these classes
        self.latin = latin_matcher(pattern) if r"[^\s\p{L}\p{N}]" in pattern and "[[" not in pattern else None
        self.vocab = vocabulary(ranks)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: the pair of least rank is merged, the leftmost of equals, until none has one."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1)) + [n]  # end[i]: where the part that begins at i ends; 0: no part begins there
        before = list(range(-1, n))
        heap = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != j:
                continue  # one of the two has grown or is gone
            end[i], end[mid] = j, 0
            if j < n:
                before[j] = i
                s = ranks.get(piece[i : end[j]])
                if s is not None:
                    heapq.heappush(heap, (s, i, end[j]))
            p = before[i]
            if p >= 0:
                s = ranks.get(piece[p:j])
                if s is not None:
                    heapq.heappush(heap, (s, p, j))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def packed(self, piece: str) -> bytes:
        """Packed ids of a pre-token.  Known ones are kept in two generations: a full one becomes the old one, and what
        is met again moves on."""
        got = self.known.get(piece)
        if got is None:
            got = self.old.get(piece)
            if got is None:
                ids = self.merge(piece.encode())
                got = struct.pack(f"<{len(ids)}I", *ids)
            if len(piece) < 64:
                if len(self.known) >= CACHE:
                    self.old, self.known = self.known, {}
                self.known[piece] = got
        return got

    def matcher_of(self, text: str):
        return self.match if self.latin is None or _BEYOND.search(text) else self.latin

    def encode(self, text: str) -> bytes:
        known, packed, out = self.known, self.packed, []
        for piece in self.matcher_of(text).findall(text):
            got = known.get(piece)
            if got is None:
                got = packed(piece)
                known = self.known
            out.append(got)
        return b"".join(out)

    def boundaries(self, window: str, low: int, high: int) -> list[int]:
        """Ends of matches of a window, matched from its start, that lie in [low, high]; its start is one."""
        ends = [0] if low <= 0 <= high else []
        for m in self.matcher_of(window).finditer(window):
            e = m.end()
            if e > high:
                break
            if e >= low:
                ends.append(e)
        return ends

    def decode(self, ids: bytes) -> bytes:
        return decoded(self.vocab, ids)


def vocabulary(ranks: dict[bytes, int]) -> list[bytes]:
    """The bytes of each id."""
    out = [b""] * (max(ranks.values()) + 1)
    for b, i in ranks.items():
        out[i] = b
    return out


def decoded(vocab: list[bytes], ids: bytes) -> bytes:
    return b"".join([vocab[i] for i in memoryview(ids).cast("I")])


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def load(path: str | None = None, pattern: str | None = None, as_known: tuple[str, bool] | None = None) -> ByteBpe:
    """The model of this process (read once); ``as_known``: the pattern as ``spelt`` gave it on the driver."""
    import public_tokenizers

    pattern = pattern or public_tokenizers.PATTERN
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(read_ranks(path), pattern, as_known)
    return _LOADED[path, pattern]


def _batch(names: list[str], types: list, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _whole(model: ByteBpe, rb: pa.RecordBatch, extra: list):
    ids = [model.encode(t) if t else b"" for t in rb.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([*extra, pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())], names=["doc_id", "ids", "n_tokens"])


def encode_table(spark: SparkSession, docs: DataFrame, path: str | None = None, pattern: str | None = None, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (packed), n_tokens of every row; texts of more than ``step`` characters go through chunks."""
    import public_tokenizers

    assert step >= overlap > AHEAD
    as_known = spelt(pattern or public_tokenizers.PATTERN)
    work, src = Work(spark, "bytebpe"), docs.select("doc_id", "text")
    one = src.schema["doc_id"]
    schema = plus(src.schema, "ids binary, n_tokens long", ("text",))

    def short(batches):
        model = load(path, pattern, as_known)
        for rb in batches:
            yield _whole(model, rb, [rb.column("doc_id")])

    def cut(batches):
        part, n = TaskContext.get().partitionId(), 0
        for rb in batches:
            for d, t in zip(rb.column("doc_id"), rb.column("text")):
                t, n = t.as_py(), n + 1
                starts = list(range(0, max(1, len(t) - overlap), step))
                for k, s in enumerate(starts):
                    last = k + 1 == len(starts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d], rb.schema.field("doc_id").type), pa.array([f"{part}:{n}"]), pa.array([k], pa.int64()), pa.array([last]), pa.array([t[s:] if last else t[s : s + step + overlap]], pa.string())],
                        names=["doc_id", "key", "k", "last", "window"],
                    )

    def meet(batches):
        model = load(path, pattern, as_known)
        for rb in batches:
            rows = []
            for key, k, last, w in zip(*(rb.column(c).to_pylist() for c in ("key", "k", "last", "window"))):
                head = model.boundaries(w, 0, overlap - AHEAD) if k else []
                tail = [] if last else [e - step for e in model.boundaries(w, step, step + overlap - AHEAD)]
                rows.append((key, k, last, head, tail))
            yield _batch(["key", "k", "last", "head", "tail"], [pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32())], rows)

    def pieces(batches):
        model = load(path, pattern, as_known)
        for rb in batches:
            rows = [(key, k, model.encode(w[a:b])) for key, k, w, a, b in zip(*(rb.column(c).to_pylist() for c in ("key", "k", "window", "since", "until")))]
            yield _batch(["key", "k", "ids"], [pa.string(), pa.int64(), pa.binary()], rows)

    parts = partitions(spark)
    long_ = src.where(F.length("text") > step)
    chunks = work.save(long_.mapInArrow(cut, plus(long_.select("doc_id").schema, "key string, k long, last boolean, window string")), "chunks")
    met = chunks.select("key", "k", "last", "window").repartition(parts, "key", "k").mapInArrow(meet, "key string, k long, last boolean, head array<int>, tail array<int>")
    # small rows from here: where each chunk hands over to the next, in characters from the next one's start
    by_key = Window.partitionBy("key")
    hand = F.array_min(F.array_intersect("tail", F.lead("head").over(by_key.orderBy("k"))))
    met = met.withColumn("hand", hand).withColumn("stitched", F.min(F.col("last") | F.col("hand").isNotNull()).over(by_key))
    met = met.withColumn("since", F.coalesce(F.lag("hand").over(by_key.orderBy("k")), F.lit(0)))
    seams = met.select("key", "k", "stitched", "since", (F.col("hand") + step).alias("until"))
    seamed = work.save(chunks.join(seams, ["key", "k"]), "seams")
    # a text without a common boundary in some overlap is put together again
    apart = F.transform(F.array_sort(F.collect_list(F.struct("k", F.when(F.col("last"), F.col("window")).otherwise(F.substring("window", 1, step)).alias("w")))), lambda x: x["w"])
    whole = seamed.where("not stitched").groupBy("key").agg(F.lit(0).cast("long").alias("k"), F.concat_ws("", apart).alias("window"), F.lit(0).alias("since"), F.lit(None).cast("int").alias("until"))
    todo = seamed.where("stitched").select("key", "k", "window", "since", "until").unionByName(whole)
    done = todo.repartition(parts, "key", "k").mapInArrow(pieces, "key string, k long, ids binary")
    hexed = F.transform(F.array_sort(F.collect_list(F.struct("k", F.hex("ids").alias("h")))), lambda x: x["h"])
    joined = done.groupBy("key").agg(F.unhex(F.concat_ws("", hexed)).alias("ids"))
    ids = chunks.where("k = 0").select("doc_id", "key").join(joined, "key").select(F.col("doc_id").cast(one.dataType), "ids", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"))
    return src.where(F.coalesce(F.length("text"), F.lit(0)) <= step).mapInArrow(short, schema).union(ids)


def decode_table(spark: SparkSession, rows: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows (doc_id, ids and n_tokens) with ``decoded``: the raw bytes of their ids; null ids give null."""
    ship(spark)
    src = rows.select("doc_id", "ids", "n_tokens")

    def run(batches):
        vocab = vocabulary(read_ranks(path))  # a process of its own beside the encoding one, so no more than that
        for rb in batches:
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array([None if i is None else decoded(vocab, i) for i in rb.column("ids").to_pylist()], pa.binary())], names=[*rb.schema.names, "decoded"])

    return src.mapInArrow(run, plus(src.schema, "decoded binary"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decode_table(spark, encode_table(spark, table(spark, sf_dir, "documents")))
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
