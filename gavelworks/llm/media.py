"""Copy detection on media columns with local image descriptors.

Corners (Harris, the strongest of each cell, on seven scales a sixth of an octave apart) get an
orientation from their weighted intensity centroid and 256 binary tests turned by it.  Six
tables of 40 tests each are joined on equality; a match must then be near in all 256 tests
(Hamming distance).  Matches of two images vote for a similarity transform, and the images
are copies if enough of them agree on one.  Crops, brightness and contrast changes keep
tests, the scales and orientations follow sizes from 0.7 to 1.4 and any rotation.

Images with equal bytes form one class first; only one of them is described.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg
from .common import Work, table

#: query keys (about 100 bytes each) up to this count are sent to every executor; more are joined by shuffle
BROADCAST_KEYS = 1_500_000
#: classes (hash and id, about 130 bytes each) up to this count are sent to every executor
FEW_CLASSES = 300_000
CELL, RADIUS, DISC, NEAR, INLIERS = 8, 16, 10, 24, 6
SCALES = tuple(2 ** (-k / 6) for k in range(7))
#: matches of a pair up to this count are all tried as hypotheses; of more, those of the fullest bins
ALL_VOTES, BEST_BINS = 600, 40
_RNG = np.random.default_rng(20)
#: the test pattern: 256 pairs of points within RADIUS
PATTERN = np.clip(_RNG.normal(0, RADIUS / 2.2, (256, 4)), -RADIUS + 1, RADIUS - 1).astype(np.float32)
_O = np.arange(-DISC, DISC + 1)
_WEIGHT = (((_O[:, None] ** 2 + _O[None] ** 2) <= DISC * DISC) * np.exp(-(_O[:, None] ** 2 + _O[None] ** 2) / (2 * (DISC / 1.8) ** 2))).astype(np.float32)


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey image of a PGM/PPM (P5, P6), a plain 8-bit PNG or a baseline JPEG; None for anything else."""
    try:
        if data is None:
            return None
        if data[:2] == b"\xff\xd8":
            return jpeg.decode(data)
        if data[:2] in (b"P5", b"P6"):
            head, at = [], 2
            while len(head) < 3:
                if at >= len(data):
                    return None
                while data[at : at + 1].isspace():
                    at += 1
                if data[at : at + 1] == b"#":
                    at = data.index(b"\n", at)
                    continue
                end = at
                while end < len(data) and not data[end : end + 1].isspace():
                    end += 1
                head.append(int(data[at:end]))
                at = end
            w, h, top = head
            deep = 3 if data[:2] == b"P6" else 1
            if top != 255:
                return None
            px = np.frombuffer(data, np.uint8, w * h * deep, at + 1).reshape(h, w, deep)
            return px.mean(2).astype(np.float32)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            at, body, w = 8, b"", 0
            while at < len(data):
                n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
                part = data[at + 8 : at + 8 + n]
                if kind == b"IHDR":
                    w, h, bits, color, lace = int.from_bytes(part[:4], "big"), int.from_bytes(part[4:8], "big"), part[8], part[9], part[12]
                    if bits != 8 or lace or color not in (0, 2, 4, 6):
                        return None
                    deep = {0: 1, 2: 3, 4: 2, 6: 4}[color]
                elif kind == b"IDAT":
                    body += part
                at += 12 + n
            raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w * deep + 1)
            out = np.zeros((h, w * deep), np.uint8)
            for y in range(h):
                line, up, f = raw[y, 1:].astype(int), out[y - 1].astype(int) if y else np.zeros(w * deep, int), raw[y, 0]
                if f == 0:
                    out[y] = line
                elif f == 2:
                    out[y] = line + up & 255
                else:
                    left = np.zeros(deep, int)
                    corner = np.zeros(deep, int)
                    for x in range(0, w * deep, deep):
                        u = up[x : x + deep]
                        if f == 1:
                            p = left
                        elif f == 3:
                            p = (left + u) // 2
                        else:
                            a, b, c = abs(u - corner), abs(left - corner), abs(left + u - 2 * corner)
                            p = np.where((a <= b) & (a <= c), left, np.where(b <= c, u, corner))
                        left = line[x : x + deep] + p & 255
                        corner = u
                        out[y, x : x + deep] = left
            px = out.reshape(h, w, deep).astype(np.float32)
            return px[..., : 3 if deep > 2 else 1].mean(2)
    except (ValueError, IndexError, zlib.error, UnboundLocalError):
        pass
    return None


def encode(img: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (img.shape[1], img.shape[0]) + np.clip(np.rint(img), 0, 255).astype(np.uint8).tobytes()


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2 r + 1, of the last two axes; the border is repeated outwards."""
    h, w = a.shape[-2:]
    n = 2 * r + 1
    p = a[..., np.clip(np.arange(-r, h + r), 0, h - 1)[:, None], np.clip(np.arange(-r, w + r), 0, w - 1)]
    c = np.zeros((*a.shape[:-2], h + n, w + n))
    inner = c[..., 1:, 1:]
    np.cumsum(p, -2, out=inner)
    np.cumsum(inner, -1, out=inner)
    return (c[..., n:, n:] - c[..., :-n, n:] - c[..., n:, :-n] + c[..., :-n, :-n]) / (n * n)


def resize(img: np.ndarray, f: float) -> np.ndarray:
    h, w = max(1, round(img.shape[0] * f)), max(1, round(img.shape[1] * f))
    y = np.clip((np.arange(h) + 0.5) / f - 0.5, 0, img.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) / f - 0.5, 0, img.shape[1] - 1)
    y0, x0 = np.minimum(y.astype(int), img.shape[0] - 2 if img.shape[0] > 1 else 0), np.minimum(x.astype(int), img.shape[1] - 2 if img.shape[1] > 1 else 0)
    y1, x1 = np.minimum(y0 + 1, img.shape[0] - 1), np.minimum(x0 + 1, img.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    return (img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx) * (1 - fy) + (img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx) * fy


def _offset(before, at, after):
    """Where between -0.5 and 0.5 the parabola through three values has its top."""
    bend = before - 2 * at + after
    flat = np.abs(bend) < 1e-9
    return np.where(flat, 0.0, np.clip(0.5 * (before - after) / np.where(flat, 1.0, bend), -0.5, 0.5))


def describe(img: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(keypoints: x, y, scale, angle in the image's own pixels; 32-byte descriptors).

    The number of keypoints grows with the picture; flat or small pictures have none."""
    pts, desc = [], []
    for f in SCALES if img is not None else ():
        a = _box(_box(resize(img, f) if f != 1 else img, 1), 1).astype(np.float32)
        h, w = a.shape
        if min(h, w) < 2 * RADIUS + 4:
            continue
        gy, gx = np.gradient(a)
        xx, yy, xy = _box(np.stack((gx * gx, gy * gy, gx * gy)), 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        edge = RADIUS + 1
        inner = np.full(r.shape, -np.inf, np.float32)
        inner[edge : h - edge, edge : w - edge] = r[edge : h - edge, edge : w - edge]
        # local maxima only, so that a crop moves cells but not corners
        peak = inner[1:-1, 1:-1]
        top = np.ones(peak.shape, bool)
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                if dy != 1 or dx != 1:
                    top &= peak >= inner[dy : dy + h - 2, dx : dx + w - 2]
        y, x = np.nonzero(top & (peak > max(1e-3, 0.002 * float(r.max()))))
        if not len(y):
            continue
        y, x = y + 1, x + 1
        order = np.argsort(-inner[y, x], kind="stable")
        cell = (y[order] // CELL) * (w // CELL + 1) + x[order] // CELL
        order = order[np.unique(cell, return_index=True)[1]]
        y, x = y[order], x[order]
        for at in range(0, len(y), 4096):  # memory stays bounded on very large pictures
            p, d = _tests(a, r, y[at : at + 4096], x[at : at + 4096])
            pts.append(np.stack([(p[0] + 0.5) / f - 0.5, (p[1] + 0.5) / f - 0.5, np.full(len(d), 1 / f), p[2]], 1))
            desc.append(d)
    return (np.concatenate(pts), np.concatenate(desc)) if pts else (np.zeros((0, 4)), np.zeros((0, 32), np.uint8))


def _tests(a: np.ndarray, r: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[tuple, np.ndarray]:
    """((x, y, angle), packed tests) of corners; r is the corner strength."""
    h, w = a.shape
    fy, fx = y + _offset(r[y - 1, x], r[y, x], r[y + 1, x]), x + _offset(r[y, x - 1], r[y, x], r[y, x + 1])
    flat = a.ravel()
    rows, cols = np.clip(y[:, None] + _O, 0, h - 1), np.clip(x[:, None] + _O, 0, w - 1)
    patch = flat[rows[:, :, None] * w + cols[:, None, :]] * _WEIGHT
    angle = np.arctan2(patch.sum(2) @ _O, patch.sum(1) @ _O)
    c, s = np.cos(angle).astype(np.float32)[:, None], np.sin(angle).astype(np.float32)[:, None]
    cx, cy = fx.astype(np.float32)[:, None], fy.astype(np.float32)[:, None]

    def value(px, py):
        # the pattern's corners may leave the picture by some pixels
        qx, qy = np.clip(cx + c * px - s * py, 0, w - 1.01), np.clip(cy + s * px + c * py, 0, h - 1.01)
        x0, y0 = qx.astype(np.int32), qy.astype(np.int32)
        dx, dy = qx - x0, qy - y0
        at = y0 * w + x0
        upper, lower = flat[at], flat[at + w]
        upper += (flat[at + 1] - upper) * dx
        lower += (flat[at + w + 1] - lower) * dx
        return upper + (lower - upper) * dy

    bits = value(PATTERN[:, 0], PATTERN[:, 1]) < value(PATTERN[:, 2], PATTERN[:, 3])
    return (fx, fy, angle), np.packbits(bits, axis=1)


_PTS = "id long, h string, pts array<struct<p:bigint,d0:bigint,d1:bigint,d2:bigint,d3:bigint>>"
_D = ("d0", "d1", "d2", "d3")


def pack(p: np.ndarray) -> np.ndarray:
    """Keypoints (x, y, scale, angle) as integers: quarter pixels up to 16383, scales in 1/256, angles in 1/4096 turns."""
    q = np.stack([np.clip(np.rint(p[:, 0] * 4), 0, 65535), np.clip(np.rint(p[:, 1] * 4), 0, 65535), np.clip(np.rint(p[:, 2] * 256), 1, 65535), np.rint(p[:, 3] / (2 * np.pi) * 4096) % 4096], 1).astype(np.int64)
    return q[:, 0] << 44 | q[:, 1] << 28 | q[:, 2] << 12 | q[:, 3]


def unpack(v) -> np.ndarray:
    v = np.asarray(v, np.int64)
    return np.stack([(v >> 44) / 4, (v >> 28 & 65535) / 4, (v >> 12 & 65535) / 256, (v & 4095) * (2 * np.pi / 4096)], 1)


def words(d: np.ndarray) -> np.ndarray:
    """The 256 tests as four 64-bit numbers."""
    return d.copy().view(">i8").astype(np.int64).reshape(-1, 4)


def table_keys() -> Column:
    """Keys of the six tables over d0..d3: 40 tests each, with the table's number in front."""
    cols = [F.col(c) for c in _D]
    low = [c.bitwiseAND(F.lit((1 << 40) - 1)) for c in cols]
    for a, b in ((0, 1), (2, 3)):
        low.append(F.shiftleft(F.shiftrightunsigned(cols[a], 40), 16).bitwiseOR(F.shiftrightunsigned(cols[b], 48)))
    return F.array(*[c.bitwiseOR(F.lit(i << 56)) for i, c in enumerate(low)])


def distance(a: str, b: str) -> Column:
    """Number of tests in which two descriptors differ."""
    return sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in _D), F.lit(0))


def _describe(batches):
    kind = pa.struct([("p", pa.int64()), *[(c, pa.int64()) for c in _D]])
    for rb in batches:
        off, pts, tests = [0], [np.zeros(0, np.int64)], [np.zeros((0, 4), np.int64)]
        for m in rb.column("media"):
            p, d = describe(decode(m.as_py()))
            off.append(off[-1] + len(p))
            pts.append(pack(p))
            tests.append(words(d))
        t = np.concatenate(tests)
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(pts)), *[pa.array(np.ascontiguousarray(t[:, i])) for i in range(4)]], fields=list(kind))
        yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("h"), pa.ListArray.from_arrays(pa.array(off, pa.int32()), flat)], names=["id", "h", "pts"])


def consensus(m: np.ndarray) -> int:
    """Most matches that agree on one similarity transform; rows are (x, y, scale, angle) of the query, then of the other.

    Every match is a hypothesis while there are few; of many (periodic pictures) those of the
    fullest bins of scale, turn and shift are tried, which keeps the work linear in the matches."""
    k = m[:, 6] / m[:, 2]
    turn = m[:, 7] - m[:, 3]
    c, s = k * np.cos(turn), k * np.sin(turn)
    tx, ty = m[:, 4] - (c * m[:, 0] - s * m[:, 1]), m[:, 5] - (s * m[:, 0] + c * m[:, 1])
    tried = range(len(m))
    if len(m) > ALL_VOTES:
        bins = np.stack([np.rint(np.log2(k) * 2), np.rint(turn % (2 * np.pi) / 0.4), np.rint(tx / 24), np.rint(ty / 24)], 1)
        _, first, count = np.unique(bins, axis=0, return_index=True, return_counts=True)
        tried = first[np.argsort(-count, kind="stable")[:BEST_BINS]]
    best = 0
    for i in tried:
        px = c[i] * m[:, 0] - s[i] * m[:, 1] + tx[i]
        py = s[i] * m[:, 0] + c[i] * m[:, 1] + ty[i]
        ok = (np.hypot(px - m[:, 4], py - m[:, 5]) < 4) & (np.abs(np.log(k / k[i])) < 0.5) & (np.cos(turn - turn[i]) > 0.85)
        if ok.sum() > best:
            # one vote for each place of the query image
            best = max(best, len(np.unique((m[ok, 0] // 3) * 4096 + m[ok, 1] // 3)))
    return best


def _agree(least: int):
    def run(batches):
        for rb in batches:
            n = []
            for z in rb.column("z"):
                flat = z.values
                n.append(consensus(np.hstack([unpack(flat.field("p").to_numpy()), unpack(flat.field("p2").to_numpy())])))
            t = pa.RecordBatch.from_arrays([rb.column("query"), rb.column("match"), pa.array(n, pa.int64())], names=["query", "match", "inliers"])
            yield t.filter(pa.array([v >= least for v in n], pa.bool_()))

    return run


def described(media: DataFrame, work: Work, tag: str) -> tuple[DataFrame, DataFrame]:
    """((id, cls), (cls, p, d0..d3)): classes of equal bytes by their smallest id, and keypoints of each class."""
    rows = media.select(F.col("id").cast("long").alias("id"), F.sha2("media", 256).alias("h"), "media").where("id is not null")
    d = work.save(rows.mapInArrow(_describe, _PTS), tag)
    n = d.where("h is not null").groupBy("h", "id").agg(F.count("*").alias("n"))
    first = work.save(n.groupBy("h").agg(F.min(F.struct("id", "n")).alias("m")).select("h", F.col("m.id").alias("cls"), "m.n"), f"{tag}-first")
    ids = d.select("id", "h").join(first.select("h", "cls"), "h", "left").select("id", F.coalesce("cls", "id").alias("cls"))
    lead = first.select("h", F.col("cls").alias("id"), "n")
    few = first.limit(FEW_CLASSES + 1).count() <= FEW_CLASSES

    def of(some: str) -> DataFrame:
        k = lead.where(some).select("h", "id")
        return d.join(F.broadcast(k) if few else k, ["h", "id"], "left_semi")

    pts = of("n = 1")
    if lead.where("n > 1").limit(1).count():
        pts = pts.union(of("n > 1").dropDuplicates(["h", "id"]))  # rows that come back as a whole
    return ids, pts.select(F.col("id").alias("cls"), F.explode("pts").alias("k")).select("cls", "k.*")


def find_copies(spark: SparkSession, queries: DataFrame, media: DataFrame, least: int = INLIERS, work: Work | None = None) -> DataFrame:
    """(kind, a, b, inliers): ``member`` rows give the class b of every media row a, ``copy``
    rows pairs of a query class a and a media class b that show the same picture.

    Both inputs have (id, media binary); other columns are ignored.  Null or unreadable media are
    classes of their own without copies; null ids are left out; rows that repeat an id and its
    media count once, an id with several media is one class that holds the keypoints of all of
    them.  The class of equal media is their smallest id.  Empty tables give no rows.  Pictures are
    described whole at any size."""
    work = work or Work(spark, "media")
    _, q = described(queries, work, "queries")
    ids, m = described(media, work, "media")
    a = q.select(F.col("cls").alias("query"), "p", *[F.col(c).alias(f"q{c}") for c in _D], F.explode(table_keys()).alias("key"))
    a = work.save(a, "query-keys")
    if a.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        a = F.broadcast(a)  # counted to be small: the tables of all media stay where they are
    b = m.select(F.col("cls").alias("match"), F.col("p").alias("p2"), *[F.col(c).alias(f"m{c}") for c in _D], F.explode(table_keys()).alias("key"))
    hit = b.join(a, "key").where(distance("q", "m") <= NEAR)
    got = hit.groupBy("query", "match").agg(F.collect_set(F.struct("p", "p2")).alias("z")).where(F.size("z") >= least)
    copies = got.mapInArrow(_agree(least), "query long, match long, inliers long")
    members = ids.select(F.lit("member").alias("kind"), F.col("id").alias("a"), F.col("cls").alias("b"), F.lit(None).cast("long").alias("inliers"))
    return members.union(copies.select(F.lit("copy"), "query", "match", "inliers"))


# -- the query's media: no table has any, so vectors are painted -------------------------------


def paint(v, size: int = 96) -> np.ndarray:
    """A picture of a vector: a seeded texture of its rounded values under a few broad waves."""
    q = np.rint(np.nan_to_num(np.array(v, np.float64)) * 1000).astype(np.int64)
    r = np.random.default_rng([zlib.crc32(q.tobytes()), len(q)])
    img = resize(r.uniform(0, 255, (-(-size // 6),) * 2).astype(np.float32), 6.0)[:size, :size]
    y, x = np.mgrid[0:size, 0:size] / size
    return 0.75 * img + 32 + 28 * np.sin(6 * x + q[:1].sum() / 40) * np.cos(5 * y)


def rotated(img: np.ndarray, degrees: float, size: float = 1.0) -> np.ndarray:
    """Turned about the centre of a canvas scaled alike; what comes from outside is grey."""
    h, w = img.shape
    t, (y, x) = math.radians(degrees), np.mgrid[0 : round(h * size), 0 : round(w * size)]
    x, y = (x - (round(w * size) - 1) / 2) / size, (y - (round(h * size) - 1) / 2) / size
    sx, sy = math.cos(t) * x + math.sin(t) * y + (w - 1) / 2, math.cos(t) * y - math.sin(t) * x + (h - 1) / 2
    inside = (sx >= 0) & (sx <= w - 1) & (sy >= 0) & (sy <= h - 1)
    sx, sy = np.clip(sx, 0, w - 1.001), np.clip(sy, 0, h - 1.001)
    x0, y0 = sx.astype(int), sy.astype(int)
    fx, fy = sx - x0, sy - y0
    v = (img[y0, x0] * (1 - fx) + img[y0, x0 + 1] * fx) * (1 - fy) + (img[y0 + 1, x0] * (1 - fx) + img[y0 + 1, x0 + 1] * fx) * fy
    return np.where(inside, v, 128.0)


def edited(img: np.ndarray) -> np.ndarray:
    """About two thirds, brighter and with less contrast."""
    h, w = img.shape
    return img[h // 8 : h - h // 12, w // 10 : w - w // 8] * 0.85 + 25


#: edits of the query media, dealt by id
EDITS = (
    edited,
    lambda img: resize(img, 0.7),
    lambda img: resize(img, 1.3),
    lambda img: rotated(img, 15),
    lambda img: rotated(img, 160, 1.2),
    lambda img: img + np.random.default_rng(img.size).normal(0, 6, img.shape),
    lambda img: resize(edited(img), 0.9),
    lambda img: resize(img, 1.4),
)


def _paint(change: bool):
    def run(batches):
        for rb in batches:
            for at in range(0, rb.num_rows, 200):
                part, out = rb.slice(at, 200), []
                for i, v in zip(part.column("id").to_pylist(), part.column("embedding").to_pylist()):
                    img = None if v is None else paint([x or 0.0 for x in v])
                    out.append(None if img is None else encode(EDITS[(i or 0) // 50 % len(EDITS)](img) if change else img))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, pa.binary())], names=["id", "media"])

    return run


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` is painted; the queries are edited copies of the rows whose id is divisible by 50
    (crops, sizes from 0.7 to 1.4, rotations, noise)."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    media = v.mapInArrow(_paint(False), "id long, media binary")
    queries = v.where("id % 50 = 0").mapInArrow(_paint(True), "id long, media binary")
    return find_copies(spark, queries, media)
