"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers cut the same bytes.  The transducer reads whichever side is behind; its state is the side that leads
and the suffix of that side's last token that the other hasn't matched yet.  A token that is read overlaps the leader's
last token, always and only that one, which makes a link.  It uses up part of the suffix, all of it (the state is
empty and a group closes), or more than that (the lead changes).  Transitions are memoised by state and token, so that
bytes are compared once per combination met.

Texts are cut into stretches where both tokenizers must have a boundary: before a space or a line feed that follows
anything but white space.  (A pre-token of the byte-level pattern holds no white space but a leading one, and no piece
goes on behind a space or holds a line feed; models with other pieces are not cut.)  Stretches are the words of a text
for the most part, so each is tokenised and aligned once while it is remembered.

Links are counted per id pair over the whole corpus.  Texts are taken in blocks of ``BLOCK`` characters, whose links
are stored as places in the block's own list of pairs; only those lists are aggregated, joined with the corpus counts
and sent back to the blocks, so a pair found everywhere is one row a block and no task holds more than a block and its
pairs.

Defined cases: null and empty texts, and texts whose tokens don't add up to a space and the text in bytes (a
tokenizer that changes the text), have no tokens: zeros and an empty digest; repeated rows count each; ties for a B
id's highest count are all best; other columns are not returned; an empty table gives an empty one.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Work, partitions, ship, table

BLOCK = 1 << 20
#: states and transitions of a process are dropped beyond this many and learned again
MEMO = 4_000_000
#: stretches remembered in each of two generations
CACHE = 300_000
#: white space as Python knows it covers that of the tokenizers, so a cut is never inside a run of theirs
WORD = re.compile(r" \S+")
STRETCH = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
UNSEEN = b"\xff\xff"  # bytes of tokens that stand for no text; no text in UTF-8 has them
_LOADED: dict = {}
_NEW = object()


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes with: a printable Latin-1 byte is itself, the
    others follow from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 32]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Ids and token bytes of a byte-level tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True
        alphabet, special = byte_alphabet(), set(self.t.get_added_tokens_decoder())
        self.bytes = [UNSEEN] * self.t.get_vocab_size()
        for token, i in self.t.get_vocab().items():
            if i not in special and all(c in alphabet for c in token):
                self.bytes[i] = bytes(alphabet[c] for c in token) or UNSEEN
        line = self.t.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text.  Those of a space and one word are encoded as the lines of one text: a line feed before a
        space is a token of its own and ends a pre-token as the end of a text does."""
        one = [self.line is not None and WORD.fullmatch(t) is not None for t in texts]
        words, others = [t for t, w in zip(texts, one) if w], [t for t, w in zip(texts, one) if not w]
        got = iter([e.ids for e in self.t.encode_batch_fast(others, add_special_tokens=False)])
        ids = self.t.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids
        ends = [*np.flatnonzero(np.array(ids, np.int64) == self.line).tolist(), len(ids)]
        parts = iter([ids[i:j] for i, j in zip([0, *(e + 1 for e in ends)], ends)])
        return [next(parts) if w else next(got) for w in one]


class Pieces:
    """Ids and token bytes of a piece model.  The model puts a space in front of a text; ``encode`` takes texts with
    theirs, and what doesn't begin with one is encoded behind a line feed, whose ids are taken off again."""

    def __init__(self, path: str):
        import sentencepiece

        self.t = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(sp.vocab_size()):
            p = sp.id_to_piece(i)
            none = sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
            self.bytes.append(UNSEEN if none else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() or UNSEEN)
        #: whether texts may be cut before spaces and line feeds
        self.apart = all("\n" not in p and "▁" not in p.lstrip("▁") for p in map(sp.id_to_piece, range(sp.vocab_size())))
        self.before = len(sp.encode("\n"))

    def encode(self, texts: list[str]) -> list[list[int]]:
        bare = [t[0] != " " or len(t) == 1 for t in texts]
        got = self.t.encode(["\n" + t if b else t[1:] for t, b in zip(texts, bare)], num_threads=1)
        return [ids[self.before :] if b else ids for ids, b in zip(got, bare)]


class Transducer:
    """States are numbered: 0 is empty, above it A leads, below it B leads; ``rest`` has the unmatched bytes by number."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.a, self.b, self.names = a, b, [str(i) for i in range(max(len(a), len(b)))]
        self.clear()

    def clear(self) -> None:
        self.number: dict[tuple[bool, bytes], int] = {}
        self.rest: dict[int, bytes] = {}
        self.moves: dict[int, dict[int, int]] = {}
        self.learnt = 0
        self.begin: dict[int, int] = {}

    def state(self, a_leads: bool, rest: bytes) -> int:
        if not rest:
            return 0
        got = self.number.get((a_leads, rest))
        if got is None:
            got = len(self.number) + 1
            got = self.number[a_leads, rest] = got if a_leads else -got
            self.rest[got], self.moves[got] = rest, {}
        return got

    def move(self, state: int, token: int) -> int:
        """The state after the side behind has read a token."""
        rest, a_leads = self.rest[state], state > 0
        new = (self.b if a_leads else self.a)[token]
        if rest.startswith(new):
            got = self.state(a_leads, rest[len(new) :])
        elif new.startswith(rest):
            got = self.state(not a_leads, new[len(rest) :])
        else:
            raise ValueError(f"tokens differ at {rest!r} and {new!r}")
        self.moves[state][token] = got
        self.learnt += 1
        return got

    def align(self, a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]]:
        """Links as (A id << 32) + B id in order, and where each group ends in a and in b.  Both sides must spell the
        same bytes."""
        if self.learnt > MEMO:
            self.clear()
        moves, begin = self.moves, self.begin
        links, ends_a, ends_b = [], [], []
        i = j = 0
        n = len(a)
        while i < n:
            x = a[i]
            i += 1
            s = begin.get(x)
            if s is None:
                s = begin[x] = self.state(True, self.a[x])
            while s:
                if s > 0:
                    t = y = b[j]
                    j += 1
                else:
                    t = x = a[i]
                    i += 1
                links.append(x << 32 | y)
                got = moves[s].get(t)
                s = self.move(s, t) if got is None else got
            ends_a.append(i)
            ends_b.append(j)
        return links, ends_a, ends_b

    def text(self, a: list[int], b: list[int], ends_a: list[int], ends_b: list[int]) -> str:
        """Groups as ``a1,a2|b1;a3|b2,b3``."""
        name, out, i, j = self.names, [], 0, 0
        for p, q in zip(ends_a, ends_b):
            left = name[a[i]] if p - i == 1 else ",".join([name[x] for x in a[i:p]])
            right = name[b[j]] if q - j == 1 else ",".join([name[x] for x in b[j:q]])
            out.append(left + "|" + right)
            i, j = p, q
        return ";".join(out)


class Aligner:
    """Both tokenizers, their transducer, and what is known of stretches: (links packed, n_a, n_b, groups, groups as
    text), None where the tokens don't spell the stretch."""

    def __init__(self, left: ByteLevel, right: Pieces):
        self.left, self.right, self.transducer = left, right, Transducer(left.bytes, right.bytes)
        self.known: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def cut(self, text: str) -> list[str]:
        return STRETCH.findall(text) if self.right.apart else [text]

    def tokens(self, stretches: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both sides, None where the bytes of either differ from the stretch."""
        of_a, of_b, out = self.left.bytes.__getitem__, self.right.bytes.__getitem__, []
        for s, a, b in zip(stretches, self.left.encode(stretches), self.right.encode(stretches)):
            out.append((a, b) if b"".join(map(of_a, a)) == s.encode() == b"".join(map(of_b, b)) else None)
        return out

    def learn(self, stretches: list[str]) -> list[tuple | None]:
        """What is known of each stretch (all different), tokenised and aligned now if it is new."""
        known, old = self.known, self.old
        out = [known.get(s, _NEW) for s in stretches]
        new = []
        for k, got in enumerate(out):
            if got is _NEW:
                s = stretches[k]
                if s in old:
                    out[k] = known[s] = old[s]
                else:
                    new.append(k)
        if new:
            align, spell = self.transducer.align, self.transducer.text
            for k, pair in zip(new, self.tokens([stretches[k] for k in new])):
                if pair is not None:
                    a, b = pair
                    links, ends_a, ends_b = align(a, b)
                    pair = (array("q", links).tobytes(), len(a), len(b), len(ends_a), spell(a, b, ends_a, ends_b))
                out[k] = pair
                if len(stretches[k]) < 64:
                    known[stretches[k]] = pair
        if len(known) > CACHE:
            self.old, self.known = known, {}
        return out


def load(a: str | None = None, b: str | None = None) -> Aligner:
    """The aligner of this process (read once)."""
    import public_tokenizers

    a, b = a or public_tokenizers.path("byte_bpe_50k.json"), b or public_tokenizers.path("piece_bpe_32k.model")
    if (a, b) not in _LOADED:
        _LOADED[a, b] = Aligner(ByteLevel(a), Pieces(b))
    return _LOADED[a, b]


def _blocks(texts: list[str | None]):
    """Ranges of rows of at most ``BLOCK`` characters, or of one row."""
    start = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > start and size + n > BLOCK:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def _aligned(aligner: Aligner, texts: list[str | None]):
    """A block: its id pairs, how many links each has, and per text the places of its links in that list (of two bytes
    each where they suffice, else four) and (n_a, n_b, n_groups, sha256 of the groups, the groups)."""
    number: dict[str, int] = {}
    at: list[list[int]] = []
    for t in texts:
        at.append([number.setdefault(s, len(number)) for s in aligner.cut(" " + t)] if t else [])
    known = aligner.learn(list(number))
    packed = [e[0] if e else b"" for e in known]
    place, met = pd.factorize(np.frombuffer(b"".join(packed), np.int64))
    size = np.array([len(p) // 8 for p in packed], np.int64)
    start = np.cumsum(size) - size
    numbers = np.array([e[1:4] if e else (0, 0, 0) for e in known], np.int64).reshape(-1, 3)
    bad = np.array([e is None for e in known], bool)
    links, rows, used = [], [], np.zeros(len(known), np.int64)
    for idx in at:
        i = np.array(idx, np.int64)
        if not idx or bad[i].any():
            links.append(place[:0])
            rows.append((0, 0, 0, "", ""))
            continue
        n = size[i]
        mine = place[np.repeat(start[i] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        np.add.at(used, i, 1)
        links.append(mine)
        spelt = ";".join([known[k][4] for k in idx])
        rows.append((*map(int, numbers[i].sum(0)), hashlib.sha256(spelt.encode()).hexdigest(), spelt))
    count = np.bincount(place, np.repeat(used, size), len(met)).astype(np.int64)
    keep = count > 0
    if not keep.all():  # pairs of texts that have no tokens after all
        new = np.cumsum(keep) - 1
        links = [new[x] for x in links]
        met, count = met[keep], count[keep]
    kind = np.uint16 if len(met) <= 1 << 16 else np.uint32
    return met, count, [x.astype(kind).tobytes() for x in links], rows


_ALIGNED = "block long, kind int, pos int, code long, cnt long, n_a long, n_b long, n_groups long, links binary, groups_sha256 string, groups string"
_RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def align_table(spark: SparkSession, docs: DataFrame, a: str | None = None, b: str | None = None, groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row, and with ``groups`` the
    groups themselves (``a1,a2|b1;...``)."""
    ship(spark)
    work, src = Work(spark, "align"), docs.select("doc_id", "text")
    id_ddl = src.schema["doc_id"].dataType.simpleString()

    def read(batches):
        base, n = TaskContext.get().partitionId() << 32, 0
        for rb in batches:
            ids, texts = rb.column("doc_id"), rb.column("text").to_pylist()
            for lo, hi in _blocks(texts):
                gc.disable()  # a million remembered tuples would be looked through again and again
                try:
                    met, count, links, rows = _aligned(load(a, b), texts[lo:hi])
                finally:
                    gc.enable()
                k, m = len(met), hi - lo
                yield _rows([base + n] * k, [0] * k, np.arange(k), met, count, *[pa.nulls(k)] * 6, pa.nulls(k, ids.type))
                na, nb, ng, sha, spelt = zip(*rows)
                yield _rows([base + n] * m, [1] * m, np.arange(m), pa.nulls(m), pa.nulls(m), na, nb, ng, links, sha, spelt if groups else pa.nulls(m), ids.slice(lo, m))
                n += 1

    found = work.save(src.mapInArrow(read, f"{_ALIGNED}, doc_id {id_ddl}"), "aligned")
    lists = found.where("kind = 0").select("block", "pos", "code", "cnt")
    pairs = lists.groupBy("code").agg(F.sum("cnt").alias("total"))
    # a B id has at most as many rows as there are A ids
    best = F.col("total") == F.max("total").over(Window.partitionBy(F.col("code").bitwiseAND(0xFFFFFFFF)))
    pairs = pairs.withColumn("best", best)
    counts = lists.select("block", "pos", "code").join(pairs, "code").select("block", F.lit(0).alias("kind"), "pos", "total", "best")
    stream = counts.unionByName(found.where("kind = 1").drop("code", "cnt"), allowMissingColumns=True)
    stream = stream.repartition(partitions(spark), "block").sortWithinPartitions("block", "kind", "pos")
    out = stream.mapInArrow(_count, f"doc_id {id_ddl}, {_RESULT}")
    return out if groups else out.drop("groups")


_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()]


def _rows(*cols) -> pa.RecordBatch:
    names = [f.split(" ")[0] for f in _ALIGNED.split(", ")]
    arrays = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, _TYPES)]
    return pa.RecordBatch.from_arrays([*arrays, cols[-1]], names=[*names, "doc_id"])


def _count(batches):
    """Per block its pairs with their counts, then its documents, whose links are looked up in them."""
    now, parts, total, best = None, [], None, None
    for rb in batches:
        block, kind = rb.column("block").to_numpy(), rb.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1), rb.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if block[lo] != now:
                now, parts, total = block[lo], [], None
            part = rb.slice(lo, hi - lo)
            if kind[lo] == 0:
                parts.append((part.column("total").to_numpy(zero_copy_only=False), part.column("best").to_numpy(zero_copy_only=False)))
                continue
            if total is None:
                total, best = (np.concatenate(x) for x in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, bool))
            place = np.uint16 if len(total) <= 1 << 16 else np.uint32
            links = [np.frombuffer(x, place) for x in part.column("links").to_pylist()]
            numbers = [[len(x) for x in links], [int(best[x].sum()) for x in links], [int(total[x].sum()) for x in links]]
            arrays = [part.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")] + [pa.array(x, pa.int64()) for x in numbers] + [part.column("groups_sha256"), part.column("groups")]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *(f.split(" ")[0] for f in _RESULT.split(", "))])


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_table(spark, table(spark, sf_dir, "documents"))
