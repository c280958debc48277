"""Court places in whole texts: an Aho-Corasick automaton over the keys of a gazetteer.

The automaton is built once a process and reads the letters of a text once, so the cost is the text's length plus its
matches, whatever the number of places.  Keys are letters only, as in ``columns.court_key``: "Palangka Raya",
"PALANGKARAYA" and "Palangka-Raya" are one place.  A mention starts and ends at word ends, each of its words starts with
a capital, and only space, dots and hyphens lie between them; of overlapping mentions the leftmost counts, of those that
start together the longest ("Tanjung Balai Karimun", not "Tanjung Balai").

Defined cases: a null text has no mentions, null; a key of two provinces belongs to the one first in the alphabet; an
empty gazetteer finds nothing; other columns are kept, and a column named like the new one is replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship

#: places a gazetteer may have: it is sent to every task
MOST = 100_000
MENTION = "array<struct<start: int, end: int, name: string, key: string, provinsi: string, court: string>>"
_WORD = re.compile(r"[^\W_]+")
_GAP = re.compile(r"[\s.\-]*")
# fixed values: what stands before the place of a court
_COURT = [
    ("PN", re.compile(r"(?i:pengadilan\s+negeri|\bPN)[\s.]*\Z")),
    ("PT", re.compile(r"(?i:pengadilan\s+tinggi|\bPT)[\s.]*\Z")),
    ("DILMIL", re.compile(r"(?i:pengadilan\s+militer(?:\s+tinggi)?|\bdilmil)(?:\s+[IVX]+\s*-?\s*\d+)?[\s.]*\Z")),
]
_BEFORE = 48
_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("key", pa.string()), ("provinsi", pa.string()), ("court", pa.string())]))
_BUILT: dict = {}


class Places:
    """Finds the keys of ``provinces`` (key -> province) in texts."""

    def __init__(self, provinces: dict[str, str]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for key, province in provinces.items():
            self.machine.add_word(key, (key, province))
        self.any = len(provinces) > 0
        if self.any:
            self.machine.make_automaton()

    def find(self, text: str) -> list[dict]:
        if not self.any:
            return []
        letters, at, starts, ends = [], 0, {}, {}
        for m in _WORD.finditer(text):
            w = m.group()
            # a word with other than plain letters is no part of a name: a line feed stands for it
            w = w.upper() if w.isascii() and w.isalpha() else "\n"
            starts[at] = m
            at += len(w)
            ends[at] = m
            letters.append(w)
        found = []
        for last, (key, province) in self.machine.iter("".join(letters)):
            a, b = starts.get(last + 1 - len(key)), ends.get(last + 1)
            if a is not None and b is not None and self._name(text, a.start(), b.end()):
                found.append((a.start(), -b.end(), key, province))
        out, free = [], 0
        for start, end, key, province in sorted(found):
            if start >= free:
                free = -end
                before = text[max(0, start - _BEFORE) : start]
                court = next((kind for kind, p in _COURT if p.search(before)), None)
                out.append({"start": start, "end": free, "name": text[start:free], "key": key, "provinsi": province, "court": court})
        return out

    @staticmethod
    def _name(text: str, start: int, end: int) -> bool:
        """Whether every word is capitalised and nothing but space, dots and hyphens lies between them."""
        free = start
        for m in _WORD.finditer(text, start, end):
            if not m.group()[0].isupper() or not _GAP.fullmatch(text, free, m.start()):
                return False
            free = m.end()
        return True


def dictionary(gaz: DataFrame, most: int = MOST) -> dict[str, str]:
    """key -> province of a gazetteer (key, provinsi); ValueError if it has more than ``most`` rows."""
    rows = gaz.select("key", "provinsi").where("key <> ''").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a gazetteer of more than {most} places")
    out: dict[str, str] = {}
    for key, province in sorted((r for r in rows if r.provinsi is not None), reverse=True):
        out[key] = province
    return out


def find_places(df: DataFrame, text: str, gaz: DataFrame, out: str = "tempat") -> DataFrame:
    """The rows of df with ``out``: the mentions of places in ``text``, in order (``MENTION``)."""
    ship(df.sparkSession)
    known = dictionary(gaz)
    kept = [c for c in df.columns if c != out]
    src = df.withColumn("_places_text", F.col(text).cast("string")).select(*kept, "_places_text")
    token = tuple(sorted(known.items()))

    def run(batches):
        places = _BUILT.get(token)
        if places is None:
            _BUILT.clear()
            places = _BUILT[token] = Places(dict(token))
        for rb in batches:
            texts = rb.column(rb.num_columns - 1).to_pylist()
            found = pa.array([None if t is None else places.find(t) for t in texts], _TYPE)
            yield pa.RecordBatch.from_arrays([*rb.columns[:-1], found], names=[*rb.schema.names[:-1], out])

    schema = StructType([f for f in src.schema.fields if f.name != "_places_text"] + StructType.fromDDL(f"`{out}` {MENTION}").fields)
    return src.mapInArrow(run, schema)


def origin_courts(df: DataFrame, text: str, gaz: DataFrame, out: str = "pengadilan_asal_teks") -> DataFrame:
    """The rows of df with ``out``: the first court of first instance in the text whose place is known, as "PN PLACE";
    null if there is none ("Pengadilan Negeri Perpanjangan Oleh Ketua" is no court)."""
    found = find_places(df, text, gaz, "_places")
    first = F.get(F.filter("_places", lambda m: m["court"] == "PN"), F.lit(0))["name"]
    name = F.concat(F.lit("PN "), F.upper(F.regexp_replace(first, r"[\s.]+", " ")))
    return found.withColumn(out, name).drop("_places")
