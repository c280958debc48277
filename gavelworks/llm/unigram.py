"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

Pieces and log scores come from a public model file.  Where its scores are merge
ranks (a BPE model), piece r gets the Zipf log score -ln(r + 1) - ln(H).  Spaces
become the marker U+2581 and the text gets one in front.  A character no piece
covers is unknown (least score - 10) and written as its UTF-8 byte pieces; so is a
marker that stood in the text, which makes decoding exact for every text.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import plus, ship, table

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 200_000
_LOADED: dict = {}


class DoubleArray:
    """Trie of strings in two arrays: child of node s by code c is t = base[s] + c if check[t] == s."""

    def __init__(self, words: dict[str, int]):
        seen: dict[str, int] = {}
        for w in words:
            for c in w:
                seen[c] = seen.get(c, 0) + 1
        # frequent characters get small codes, so that most families are narrow
        self.code = {c: i + 1 for i, c in enumerate(sorted(seen, key=lambda c: (-seen[c], c)))}
        tree: dict = {}
        for w, v in words.items():
            node = tree
            for c in w:
                node = node.setdefault(self.code[c], {})
            node[0] = v  # code 0 ends a word
        self.base, self.check, self.value = [0], [-2], [-1]
        start, todo = 1, [(0, tree)]
        while todo:
            s, node = todo.pop()
            codes = sorted(k for k in node if k)
            if 0 in node:
                self.value[s] = node[0]
            if not codes:
                continue
            first, wide = codes[0], codes[-1] - codes[0]
            at = begun = max(start, first + 1)
            while True:
                self._grow(at + wide + 1)
                if self.check[at] == -1:
                    b = at - first
                    if all(self.check[b + c] == -1 for c in codes):
                        break
                at += 1
            if at - begun > 64:
                start = max(start, at - 32)  # the few holes before are left
            self.base[s] = b
            for c in codes:
                self.check[b + c] = s
                todo.append((b + c, node[c]))
        self._grow(len(self.check) + len(self.code) + 2)

    def _grow(self, n: int) -> None:
        more = n - len(self.check)
        if more > 0:
            more += 1024
            self.base += [0] * more
            self.check += [-1] * more
            self.value += [-1] * more


class Unigram:
    """pieces: (piece, log score) by id, with byte pieces at ``byte_ids`` (256 or none)."""

    def __init__(self, pieces: list[tuple[str, float]], usable: list[bool], byte_ids: list[int], unk: int):
        self.pieces, self.byte_ids, self.unk = [p for p, _ in pieces], byte_ids, unk
        self.score = [s for _, s in pieces]
        words: dict[str, int] = {}
        for i, (p, _) in enumerate(pieces):
            if usable[i] and p:
                words.setdefault(p, i)
        self.trie = DoubleArray(words)
        self.longest = max(map(len, words), default=1)
        self.unk_score = min((self.score[i] for i in words.values()), default=0.0) - 10.0
        # words part at markers if no piece goes on behind one, and at line ends if no piece has one
        apart = all("\n" not in w and MARK not in w.lstrip(MARK) for w in words)
        self.split = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n") if apart else re.compile(r"(?s).+")
        self.cache: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        byte_of = {i: b for b, i in enumerate(byte_ids)}
        self.byte_of = byte_of
        # what a piece alone decodes to; None for bytes that need their neighbours
        self.plain = [chr(byte_of[i]) if i in byte_of and byte_of[i] < 128 else None if i in byte_of else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]

    def viterbi(self, word: str) -> tuple[list[int], float]:
        """Best segmentation (ids with ``-1 - ord`` for an unknown character) and its score;
        of equal ones the longer last piece wins."""
        base, check, value, code, score = self.trie.base, self.trie.check, self.trie.value, self.trie.code, self.score
        n, reach = len(word), self.longest
        codes = [code.get(c, 0) for c in word]
        best, back, ids = [-math.inf] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            node, here, single, j = 0, best[i], False, i
            for c in codes[i : i + reach]:
                if not c:
                    break
                t = base[node] + c
                if check[t] != node:
                    break
                node = t
                j += 1
                v = value[t]
                if v >= 0:
                    s = here + score[v]
                    if s > best[j]:
                        best[j], back[j], ids[j] = s, i, v
                    if j == i + 1:
                        single = True
            if not single and here + self.unk_score > best[i + 1]:
                best[i + 1], back[i + 1], ids[i + 1] = here + self.unk_score, i, -1 - ord(word[i])
        out, at = [], n
        while at:
            out.append(ids[at])
            at = back[at]
        return out[::-1], best[n]

    def _bytes(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unk]

    def chunk(self, word: str) -> tuple[int, ...]:
        """Ids of a word.  Known words are kept in two generations: a full one becomes the old one, and what is met
        again moves on, so that common words are never worked out anew."""
        got = self.cache.get(word)
        if got is None:
            got = self.old.get(word)
            if got is None:
                out: list[int] = []
                for i in self.viterbi(word)[0]:
                    if i >= 0:
                        out.append(i)
                    else:
                        out += self._bytes(chr(-1 - i))
                got = tuple(out)
            if len(word) < 64:
                if len(self.cache) >= CACHE:
                    self.old, self.cache = self.cache, {}
                self.cache[word] = got
        return got

    def encode(self, text: str) -> list[int]:
        """Ids of a text; an empty text has none."""
        if not text:
            return []
        out: list[int] = []
        known = self.cache
        for k, part in enumerate(text.split(MARK)):
            if k:
                out += self._bytes(MARK)
            else:
                part = MARK + part
            for w in self.split.findall(part.replace(" ", MARK)):
                got = known.get(w)
                if got is None:
                    got = self.chunk(w)
                    known = self.cache
                out += got
        return out

    def decode(self, ids) -> str:
        plain = self.plain
        parts = [plain[i] for i in ids]
        if None in parts:
            out, run = [], bytearray()
            for i, p in zip(ids, parts):
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run = bytearray()
                out.append(p)
            parts = [*out, run.decode("utf-8", "replace")]
        text = "".join(parts)
        return text[1:] if text.startswith(" ") else text


def load(path: str = MODEL) -> Unigram:
    """The model of this process (read once)."""
    if path not in _LOADED:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        usable = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        raw = [sp.get_score(i) for i in range(n)]
        if all(float(s).is_integer() for s, u in zip(raw, usable) if u):  # merge ranks
            norm = math.log(sum(1 / (r + 1) for r in range(n)))
            raw = [-math.log(1 - s) - norm if s <= 0 else 0.0 for s in raw]
        bytes_ = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        bytes_ = bytes_ if all(sp.is_byte(i) for i in bytes_) else []
        _LOADED[path] = Unigram([(sp.id_to_piece(i), s) for i, s in enumerate(raw)], usable, bytes_, sp.unk_id())
    return _LOADED[path]


def encode_table(spark: SparkSession, docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, n_byte_tokens, round_trip (decoding gives back the text), one row per input row.

    Null text: null ids, 0 tokens, round_trip true.  Other columns are not returned."""
    ship(spark)
    src = docs.select("doc_id", "text")

    def run(batches):
        model = load(path)
        is_byte = np.zeros(len(model.pieces), bool)
        is_byte[list(model.byte_of)] = True
        for rb in batches:
            flat, off, n, nb, ok, null = [], [0], [], [], [], []
            for t in rb.column("text"):
                text = t.as_py()
                ids = model.encode(text) if text else []
                a = np.array(ids, np.int32)
                flat.append(a)
                off.append(off[-1] + len(ids))
                n.append(len(ids))
                nb.append(int(is_byte[a].sum()))
                ok.append(not text or model.decode(ids) == text)
                null.append(text is None)
            arr = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)), mask=pa.array(null, pa.bool_()))
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), arr, pa.array(n, pa.int64()), pa.array(nb, pa.int64()), pa.array(ok, pa.bool_())], names=["doc_id", "ids", "n_tokens", "n_byte_tokens", "round_trip"])

    return src.mapInArrow(run, plus(src.schema, "ids array<int>, n_tokens long, n_byte_tokens long, round_trip boolean", ("text",)))


def decode_table(spark: SparkSession, rows: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids give null."""
    ship(spark)

    def run(batches):
        model = load(path)
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), pa.array([None if x is None else model.decode(x) for x in rb.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, plus(rows.select("doc_id").schema, "text string"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_table(spark, table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_table(spark, docs)
