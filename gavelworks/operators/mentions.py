"""Volumes and amounts of money in whole texts, found in one pass.

Numbers with their unit or currency are found once, and what stands before and after each is sliced by its position,
so the cost is the text's length plus its mentions.  The rows are those of ``rulings.volume_mentions`` and
``rulings.money_mentions``, which look behind at every character of a text.

Defined cases: a null text has null mentions; texts of any length are read whole; equal mentions are each listed; other
columns are kept, and columns named like the new ones are replaced.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..functions.lexicon import MONEY_KINDS
from ..functions.rulings import needed
from ..shipping import ship

# fixed values: the forms of numbers, volumes and amounts, as in ``rulings``, with the white space and digits of the JVM
_S = r"[ \t\n\x0b\f\r]"
_NUMBER = r"([0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?|[0-9]+(?:,[0-9]+)?)"
_VOLUME = re.compile(rf"{_NUMBER}(?:{_S}*\([^()]{{0,120}}\))?{_S}*(kilo{_S}*liter|kiloliter|k\.?l\b|liter|ltr\b|lt\b|l\b|ton\b|m3\b|m³)", re.I)
#: the last digit of a number with its unit: begins with a class of characters, so it is found without trying each place
_END = re.compile(rf"[0-9](?:{_S}*\([^()]{{0,120}}\))?{_S}*(?:kilo{_S}*liter|kiloliter|k\.?l\b|liter|ltr\b|lt\b|l\b|ton\b|m3\b|m³)", re.I)
_MONEY = re.compile(rf"[Rr][Pp]\.?{_S}*([0-9]{{1,3}}(?:{_S}?\.{_S}?[0-9]{{3}})+(?:,[0-9]{{1,2}})?|[0-9]+(?:,[0-9]{{1,2}})?)")
_CLAUSE, _SIZE = re.compile(r"[;,\n]|\bdan\b"), re.compile(rf"kapasitas|@|isi{_S}*\Z|ukuran|volume{_S}*\Z")
_PART = re.compile(r"[;\n]")
_LEAD = re.compile(rf"^(?:{_S}|[,.\-])*(?:\([^()]{{0,60}}\))?")
_PRICE = re.compile(rf"^{_S}*(?:,-|,00)?{_S}*(?:/{_S}*(?:liter|ltr|l\b)|per{_S}*liter|perliter|setiap{_S}*liter|tiap{_S}*liter)")
#: kinds with the words of which one must be there
_KINDS = [(k, needed(p), re.compile("(?s)(.*)(?:" + p.replace(r"\s", _S) + ")")) for k, p in MONEY_KINDS]

VOLUMES = "array<struct<value: double, unit: string, kind: string, context: string>>"
SIZES = "array<struct<value: double, unit: string, kind: string>>"
AMOUNTS = "array<struct<value: double, kind: string>>"
_TYPES = {
    "volume": (VOLUMES, pa.list_(pa.struct([("value", pa.float64()), ("unit", pa.string()), ("kind", pa.string()), ("context", pa.string())]))),
    "size": (SIZES, pa.list_(pa.struct([("value", pa.float64()), ("unit", pa.string()), ("kind", pa.string())]))),
    "money": (AMOUNTS, pa.list_(pa.struct([("value", pa.float64()), ("kind", pa.string())]))),
}


def _value(number: str) -> float:
    return float(number.replace(".", "").replace(",", "."))


def _volumes(text: str):
    """Matches of ``_VOLUME``: a number ends where its run of digits, dots and commas does, as neither may stand between
    it and its unit, so only runs with a unit behind them are looked at."""
    at = 0
    for end in _END.finditer(text):
        start = end.start()
        while start > at and text[start - 1] in "0123456789.,":
            start -= 1
        m = _VOLUME.search(text, max(start, at), end.end())
        if m:
            at = m.end()
            yield m


def sizes(text: str, context: bool = False) -> list[tuple]:
    out = []
    for m in _volumes(text):
        before, unit = text[max(0, m.start() - 80) : m.start()], m[2].lower().replace(" ", "")
        v, clause = _value(m[1]), _CLAUSE.split(before[-40:].lower())[-1]
        one = v * 1000 if unit[0] == "k" or unit in ("m3", "m³") else v, "ton" if unit == "ton" else "liter", "kapasitas" if _SIZE.search(clause) else "jumlah"
        out.append((*one, " ".join(f"{before}{m[1]} {m[2]}{text[m.end() : m.end() + 40]}".split())) if context else one)
    return out


def volumes(text: str) -> list[tuple]:
    return sizes(text, True)


def amounts(text: str) -> list[tuple]:
    out = []
    for m in _MONEY.finditer(text):
        clause = _PART.split(text[max(0, m.start() - 90) : m.start()].lower())[-1]
        kind = "lain"
        if _PRICE.match(_LEAD.sub("", text[m.end() : m.end() + 60].lower(), count=1)):
            kind = "harga_per_liter"
        else:
            spots = [(len(hit[1]), -i, k) for i, (k, words, p) in enumerate(_KINDS) if any([w in clause for w in words]) and (hit := p.match(clause))]
            if spots:
                kind = max(spots)[2]
        out.append((_value("".join(m[1].split())), kind))
    return out


_FIND = {"volume": volumes, "size": sizes, "money": amounts}


def _column(found: list[list[tuple] | None], kind: pa.DataType) -> pa.Array:
    """Lists of structs, built field by field."""
    flat, ends = [m for ms in found if ms for m in ms], [0]
    for ms in found:
        ends.append(ends[-1] + len(ms or ()))
    fields = list(kind.value_type)
    structs = pa.StructArray.from_arrays([pa.array([m[k] for m in flat], f.type) for k, f in enumerate(fields)], fields=fields)
    starts = [None if ms is None else at for at, ms in zip(ends, found)] + ends[-1:]
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), structs).cast(kind)


def with_mentions(df: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """df with the columns of ``wanted``: name -> ("volume", "size" (a volume without its
    context) or "money", column of the text)."""
    ship(df.sparkSession)
    kept = [c for c in df.columns if c not in wanted]
    src = df.select(*[f"`{c}`" for c in dict.fromkeys([*kept, *(c for _, c in wanted.values())])])

    def run(batches):
        for rb in batches:
            cols = [rb.column(c) for c in kept]
            texts = {c: rb.column(c).to_pylist() for _, c in wanted.values()}
            for kind, c in wanted.values():
                find = _FIND[kind]
                cols.append(_column([None if t is None else find(t) for t in texts[c]], _TYPES[kind][1]))
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *wanted])

    added = StructType.fromDDL(", ".join(f"`{n}` {_TYPES[kind][0]}" for n, (kind, _) in wanted.items()))
    return src.mapInArrow(run, StructType([f for f in src.schema.fields if f.name in kept] + added.fields))
