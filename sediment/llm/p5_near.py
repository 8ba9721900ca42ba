"""Problem 5: near-duplicate function chunks.

A chunk's fingerprint is the set of 64-bit names of its runs of three tokens.  The space of names is cut into segments, and
a fingerprint is embedded as its bit count in each: the Manhattan distance of two embeddings is a lower bound of the size d
of the fingerprints' symmetric difference.  A Jaccard coefficient of t or more means d <= c (a + b), where a and b are the
numbers of bits and c = (1 - t) / (1 + t).

Candidates come from a range join on a grid over the embedding.  The space of names is halved again and again.  Since both
sides of d <= c (a + b) are sums over the halves, a pair that satisfies it satisfies it in one half that is not empty, and so
on down: there is a path of regions in which the pair is within the bound.  K is the largest count at which the bound allows
a distance of less than 2 (5 bits at 0.7).  In the first region of the path where neither has more than K bits, the pair's
bit counts of the region's 2**FINE segments are equal or, if the counts are large enough for that, differ by one bit.  So a
fingerprint is filed, in every region that can be such a first one, under the cell of its segment counts there and under the
cells at Manhattan distance 1 below it; of two that meet one is in its own cell.  (A region can be the first one if it has at
most K bits and the region around it at least t (K + 1), since within the bound counts differ by the factor t at most.)
A region with a single bit would make poor cells.  The pair is within the bound in the region around it too, so it shares
a known number of bits of the other half, hence one of the first few of them: the cell is that of the bit and one of those.

Pairs of one cell are held at once against the Manhattan bound on the bit counts of SEGMENTS segments of the whole space,
which travel with the cells, and what is left is verified exactly on the sets themselves.  No pair is lost by any of this, at any size.

Cells travel in blobs by bucket, and a task pairs the members of the cells of its bucket; the members of a cell with more than
BLOCK of them are paired in blocks, and each pair of blocks goes to another task.

Fingerprints that are equal form one class, and the join sees classes only; a task files a class once.  ``found`` expands classes to pairs of chunks; of more than ``expand`` chunks of one
class with equal text behind the first line the one with the least number stands for them in pairs with others, they are
paired with it, and ``classes`` has every member; expand=None gives all pairs.

Defined results: null chunk_no or content is no chunk; a chunk with fewer than three tokens has no fingerprint and no
pair; repeated rows count once; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SEGMENTS = 32
FINE = 10
EXPAND = 256
#: Cells with more members are paired in blocks of this size, each pair of blocks by whichever task.
BLOCK = 512
#: Chunks for one bucket of cells.
BUCKET_CHUNKS = 20_000
#: Pairs up to which the numbers of their chunks (16 bytes a pair at most) are broadcast to the texts.
FEW = 500_000
_TOKEN = re.compile(r"[a-z0-9_]+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Fingerprints of texts; token names are remembered per worker."""

    LIMIT = 1_000_000

    def __init__(self):
        self.names: dict[str, int] = {}

    def fingerprints(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints' bits, sorted within each text, and the number of bits of each text."""
        names, flat, sizes = self.names, [], []
        if len(names) > self.LIMIT:
            names.clear()
        for t in texts:
            at = t.find("\n")
            toks = _TOKEN.findall(t[at + 1 :].lower()) if at >= 0 else []
            for w in toks:
                n = names.get(w)
                if n is None:
                    n = names[w] = xxhash.xxh3_64_intdigest(w)
                flat.append(n)
            sizes.append(len(toks))
        n = np.asarray(sizes, np.int64)
        x = np.asarray(flat, np.uint64)
        if len(x) < 3:
            return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
        bits = _mix(_mix(_mix(x[:-2]) * _M1 + x[1:-1]) * _M2 + x[2:] * _M3)
        owner = np.repeat(np.arange(len(texts)), n)
        keep = owner[:-2] == owner[2:]
        bits, owner = bits[keep], owner[:-2][keep]
        order = np.lexsort((bits, owner))
        bits, owner = bits[order], owner[order]
        new = np.ones(len(bits), bool)
        new[1:] = (bits[1:] != bits[:-1]) | (owner[1:] != owner[:-1])
        bits, owner = bits[new], owner[new]
        return bits, np.bincount(owner, minlength=len(texts)).astype(np.int64)


#: A fingerprint as the cells carry it: a class's short name (with the role in a cell as lowest bit), bits, embedding.
POINT = np.dtype([("tag", np.int64), ("n", np.int32), ("v", np.uint8, SEGMENTS // 2)])


def embed(bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bit counts per segment, half a byte each; counts of 15 and more are 15, which keeps the bound a lower one."""
    at = np.repeat(np.arange(len(sizes)), sizes) * SEGMENTS + (bits >> np.uint64(64 - 5)).astype(np.int64)
    n = np.minimum(np.bincount(at, minlength=SEGMENTS * len(sizes)), 15).astype(np.uint8).reshape(-1, SEGMENTS)
    return n[:, 0::2] | n[:, 1::2] << 4


def within(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which points are within the Manhattan bound of each other and in the range of each other's number of bits."""
    na, nb = x["n"].astype(np.int64), y["n"].astype(np.int64)
    distance = np.zeros(len(x), np.int32)
    for half in (lambda v: v & 15, lambda v: v >> 4):
        distance += np.abs(half(x["v"]).astype(np.int8) - half(y["v"]).astype(np.int8)).sum(1, dtype=np.int32)
    return (distance <= (1 - threshold) / (1 + threshold) * (na + nb) + 1e-9) & (na >= threshold * nb - 1e-9) & (nb >= threshold * na - 1e-9)


def function_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where("symbol_type = 'function' AND chunk_no IS NOT NULL AND content IS NOT NULL").select("chunk_no", "content")


class Grid:
    """Cells of fingerprints for similarity t."""

    def __init__(self, t: float):
        self.t, self.c = t, (1 - t) / (1 + t)
        #: most bits of a region, so that the bound allows a distance below 2
        self.most = max(1, math.ceil(1 / self.c - 1e-9) - 1) if self.c else 64
        #: least bits of the region around it
        self.around = math.ceil(t * (self.most + 1) - 1e-9)
        #: bits from which a fingerprint with one bit less can be within the bound
        self.one_less = math.ceil((1 / self.c + 1) / 2 - 1e-9) if self.c else 65
        #: whether the other half always shares bits with a single one's
        self.refine = t * self.around - 1 > 1e-9

    def cells(self, bits: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell, owner and role (0: own cell, 1: cell below) of fingerprints whose bits are sorted within each."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        n = len(bits)
        around, around_start = np.full(n, 1 << 60), np.zeros(n, np.int64)
        cell, whose, role = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def add(x: np.ndarray, o: np.ndarray, r: int) -> None:
            cell.append(x)
            whose.append(o)
            role.append(np.full(len(x), r))

        for depth in range(65):
            region = bits >> np.uint64(64 - depth) if depth else np.zeros(n, np.uint64)
            new = np.ones(n, bool)
            new[1:] = (region[1:] != region[:-1]) | (owner[1:] != owner[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, n))
            per, start = np.repeat(count, count), np.repeat(first, count)
            filed = (count <= self.most) & (around[first] >= self.around)
            salt = np.uint64(0xC2B2AE3D27D4EB4F * (depth + 1) & 0xFFFFFFFFFFFFFFFF)
            name = lambda i: _mix((bits[i] >> np.uint64(max(0, 64 - depth - FINE))) * _M1 + salt)  # noqa: B023, E731
            alone = (count == 1) & (depth > 0) & self.refine
            at = np.flatnonzero(np.repeat(filed & ~alone, count))
            if len(at):
                h, k, head = name(at), per[at], start[at] == at
                total = np.add.reduceat(h, np.flatnonzero(head))
                add(_mix(total), owner[at[head]], 0)
                more = k >= self.one_less
                add(_mix((np.repeat(total, k[head]) - h)[more]), owner[at[more]], 1)
            one = first[filed & alone]
            if len(one):
                a = around[one]
                need = np.minimum(a - np.ceil(self.t * a - 1 - 1e-9).astype(np.int64), a - 1)
                i = np.repeat(one, need)
                k = np.arange(len(i)) - np.repeat(np.cumsum(need) - need, need)
                other = np.where(around_start[i] == i, i + 1, around_start[i]) + k
                add(_mix(name(i) + _mix(name(other) + _M3)), owner[i], 0)
            if not (per >= self.around).any():
                break
            around, around_start = per, start
        return np.concatenate(cell), np.concatenate(whose), np.concatenate(role)


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def _name(key: bytes) -> int:
    """A class's short name: two classes may share one, which makes no more than candidates."""
    return int.from_bytes(key[:8], "little", signed=True) & ~1


def embedded(rows: DataFrame) -> DataFrame:
    """chunk_no, class key and short name, text key of each chunk with a fingerprint."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingler()
        for whole in it:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                texts = b.column("content").to_pylist()
                bits, sizes = sh.fingerprints(texts)
                out, at = [], 0
                for no, n, text in zip(b.column("chunk_no").to_pylist(), sizes.tolist(), texts):
                    if n:
                        key = _digest(bits[at : at + n].tobytes())
                        out.append((no, key, _name(key), _digest(text.partition("\n")[2].encode("utf-8", "surrogatepass"))))
                    at += n
                if out:
                    cols = zip(zip(*out), [pa.int64(), pa.binary(), pa.int64(), pa.binary()])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["chunk_no", "class_key", "name", "text_key"])

    return rows.mapInArrow(run, "chunk_no bigint, class_key binary, name bigint, text_key binary")


def filed(rows: DataFrame, threshold: float, buckets: int) -> DataFrame:
    """Cells of every class, once per task, in blobs by bucket: points, numbers of own cells and of those below, cells."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh, grid, done = Shingler(), Grid(threshold), set()
        names, bits_, sizes_ = [], [], []

        def flush() -> pa.RecordBatch:
            bits, sizes = np.concatenate(bits_), np.concatenate(sizes_)
            point = np.empty(len(names), POINT)
            point["tag"], point["n"], point["v"] = names, sizes, embed(bits, sizes)
            cell, owner, role = grid.cells(bits, sizes)
            bucket = (cell % np.uint64(buckets)).astype(np.int64)
            line = (bucket * len(names) + owner) * 2 + role
            order = np.argsort(line, kind="stable")
            cell, line = cell[order], line[order]
            # one entry for each bucket and owner in it
            entry = line // 2
            first = np.flatnonzero(np.append(True, entry[1:] != entry[:-1]))
            n = np.diff(np.append(first, len(cell)))
            below = np.add.reduceat(line & 1, first)
            of, whose = entry[first] // len(names), point[entry[first] % len(names)]
            head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            out = []
            for i, j in zip(head, np.append(head[1:], len(of))):
                lo, hi = first[i], first[j] if j < len(of) else len(cell)
                out.append((int(of[i]), whose[i:j].tobytes(), (n[i:j] - below[i:j]).astype(np.int32).tobytes(), below[i:j].astype(np.int32).tobytes(), cell[lo:hi].tobytes()))
            names.clear(), bits_.clear(), sizes_.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32(), *[pa.binary()] * 4])], names=["bucket", "points", "own", "below", "cells"])

        for whole in it:
            for start in range(0, whole.num_rows, 1000):
                bits, sizes = sh.fingerprints(whole.slice(start, 1000).column("content").to_pylist())
                if len(done) > Shingler.LIMIT:
                    done.clear()
                keep, at = np.zeros(len(sizes), bool), 0
                for i, n in enumerate(sizes.tolist()):
                    key = _digest(bits[at : at + n].tobytes()) if n else b""
                    if key and key not in done:
                        done.add(key)
                        keep[i] = True
                        names.append(_name(key))
                    at += n
                if keep.any():
                    bits_.append(bits[np.repeat(keep, sizes)])
                    sizes_.append(sizes[keep])
                if sum(map(len, bits_)) > 500_000:
                    yield flush()
        if names:
            yield flush()

    return rows.select("content").mapInArrow(run, "bucket int, points binary, own binary, below binary, cells binary")


def _met(it: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of names within the bound that meet in a cell, one of them in its own; for cells of many members, pairs of blocks of them."""
    points, owners, cells, n_points = [np.empty(0, POINT)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    for b in it:
        for point, own, below, cell in zip(*[b.column(c).to_pylist() for c in ("points", "own", "below", "cells")]):
            point, own, below = np.frombuffer(point, POINT), np.frombuffer(own, np.int32), np.frombuffer(below, np.int32)
            at = 2 * np.arange(n_points, n_points + len(point))
            owners.append(np.repeat(np.stack([at, at | 1], 1).ravel(), np.stack([own, below], 1).ravel()))
            points.append(point)
            cells.append(np.frombuffer(cell, np.uint64))
            n_points += len(point)
    point, owner, cell = np.concatenate(points), np.concatenate(owners), np.concatenate(cells)
    del points, owners, cells
    order = np.argsort(cell, kind="stable")
    owner, cell = owner[order], cell[order]
    new = np.append(True, cell[1:] != cell[:-1]) if len(cell) else np.empty(0, bool)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(cell)))
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("xs", pa.binary()), ("ys", pa.binary())])

    def member(i: np.ndarray) -> np.ndarray:
        out = point[owner[i] >> 1]
        out["tag"] |= owner[i] & 1
        return out

    for lo, n in zip(first[count > BLOCK].tolist(), count[count > BLOCK].tolist()):
        blocks = [member(np.arange(i, min(i + BLOCK, lo + n))) for i in range(lo, lo + n, BLOCK)]
        for i, x in enumerate(blocks):
            many = blocks[i:]
            spread = pa.array([hash((lo, i, j)) for j in range(len(many))], pa.int64())
            yield pa.RecordBatch.from_arrays([spread, pa.nulls(len(many), pa.int64()), pa.array([x.tobytes()] * len(many), pa.binary()), pa.array([y.tobytes() for y in many], pa.binary())], schema=schema)
    live = np.flatnonzero(np.repeat(count <= BLOCK, count) & ~new)
    step, pairs = 1, [np.empty((0, 2), np.int64)]
    # members one place apart in a cell, then two, and so on
    while len(live):
        for i in range(0, len(live), 500_000):
            part = live[i : i + 500_000]
            pairs.append(_pairs(member(part - step), member(part), threshold))
        step += 1
        live = live[live >= step]
        live = live[cell[live - step] == cell[live]]
    found = np.unique(np.concatenate(pairs), axis=0)
    for i in range(0, len(found), 100_000):
        part = found[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([*_columns(part), pa.nulls(len(part), pa.binary()), pa.nulls(len(part), pa.binary())], schema=schema)


def _pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    ok = ((x["tag"] & y["tag"] & 1) == 0) & ((x["tag"] ^ y["tag"]) & ~1 != 0)
    x, y = x[ok], y[ok]
    ok = within(x, y, threshold)
    x, y = x["tag"][ok] & ~1, y["tag"][ok] & ~1
    return np.stack([np.minimum(x, y), np.maximum(x, y)], 1)


def _columns(pairs: np.ndarray) -> list[pa.Array]:
    return [pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())]


def _of_blocks(it: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for b in it:
        plain = b.filter(b.column("y").is_valid())
        yield plain.select(["x", "y"])
        blocks = b.filter(b.column("xs").is_valid())
        for xs, ys in zip(blocks.column("xs").to_pylist(), blocks.column("ys").to_pylist()):
            x, y = np.frombuffer(xs, POINT), np.frombuffer(ys, POINT)
            yield pa.RecordBatch.from_arrays(_columns(np.unique(_pairs(np.repeat(x, len(y)), np.tile(y, len(x)), threshold), axis=0)), names=["x", "y"])


def class_links(rows: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """a < b: representatives of classes whose fingerprints are at least that similar, verified on the sets."""
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), points.count() // BUCKET_CHUNKS)
    cells = filed(rows, threshold, buckets).repartition(buckets, "bucket")
    met = cells.mapInArrow(lambda it: _met(it, threshold), "x bigint, y bigint, xs binary, ys binary").repartition("x").mapInArrow(lambda it: _of_blocks(it, threshold), "x bigint, y bigint").distinct()
    reps = points.groupBy("class_key").agg(F.min("chunk_no").alias("rep"), F.first("name").alias("name"))
    end = lambda s, c: reps.select(F.col("name").alias(s), F.col("rep").alias(c))
    near = met.join(end("x", "a"), "x").join(end("y", "b"), "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return verified(rows, written(near, "pairs"), threshold)


def verified(rows: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose texts' sets are at least that similar; only texts of candidates move."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("chunk_no"), F.col("a"), F.col("b")), F.struct(F.col("b").alias("chunk_no"), F.col("a"), F.col("b")))).alias("e")).select("e.*")
    ids = ends.select("chunk_no").distinct()
    if pairs.count() <= FEW:
        ids = F.broadcast(ids)
    texts = rows.join(ids, "chunk_no", "left_semi").dropDuplicates(["chunk_no"]).join(ends, "chunk_no")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingler()
        for b in it:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                ta, tb = part.column("ta").to_pylist(), part.column("tb").to_pylist()
                bits, sizes = sh.fingerprints(ta + tb)
                ends_ = np.cumsum(sizes)
                cut = [bits[e - n : e] for e, n in zip(ends_.tolist(), sizes.tolist())]
                sims = []
                for x, y in zip(cut[: len(ta)], cut[len(ta) :]):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    sims.append(both / max(1, len(x) + len(y) - both))
                sim = np.asarray(sims)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(sim)], names=["a", "b", "similarity"]).filter(pa.array(sim >= threshold - 1e-12))

    both = texts.groupBy("a", "b").agg(F.max(F.when(F.col("chunk_no") == F.col("a"), F.col("content"))).alias("ta"), F.max(F.when(F.col("chunk_no") == F.col("b"), F.col("content"))).alias("tb"))
    return both.mapInArrow(run, "a bigint, b bigint, similarity double")


def _linked(chunks: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Links between representatives, and members of classes with their text keys."""
    rows = function_chunks(chunks)
    points = written(embedded(rows), "points")
    links = class_links(rows, points, threshold)
    return links, _members(points)


def _members(points: DataFrame) -> DataFrame:
    sizes = points.groupBy("class_key").agg(F.min("chunk_no").alias("class_id"), F.count_distinct("chunk_no").alias("copies"))
    return points.select("class_key", "text_key", "chunk_no").distinct().join(sizes, "class_key").drop("class_key")


def links(chunks: DataFrame, threshold: float = 0.7) -> DataFrame:
    """a, b, similarity of representatives of classes."""
    return _linked(chunks, threshold)[0]


def classes(chunks: DataFrame) -> DataFrame:
    """chunk_no, class_id (the least chunk_no of equal fingerprints), copies, of all chunks with a fingerprint."""
    return _members(embedded(function_chunks(chunks))).select("chunk_no", "class_id", "copies").distinct()


def found(chunks: DataFrame, threshold: float = 0.7, expand: int | None = EXPAND) -> DataFrame:
    """chunk_no_a < chunk_no_b of similar chunks: links of classes expanded by their members, and pairs of copies."""
    linked, members = _linked(chunks, threshold)
    # what stands for a class in links: all its members, but of many exact copies one
    alike = Window.partitionBy("class_id", "text_key")
    many_copies = F.col("copies") > (expand if expand is not None else (1 << 62))
    members = members.withColumn("n_alike", F.when(many_copies, F.count("*").over(alike)).otherwise(0)).withColumn("first_alike", F.when(many_copies, F.min("chunk_no").over(alike)))
    starred = many_copies & (F.col("n_alike") > (expand or 0))
    shown = members.where(~starred | (F.col("chunk_no") == F.col("first_alike")))
    many = shown.where("copies > 1").select("class_id", "chunk_no")
    side = lambda name: many.select(F.col("class_id").alias(name), F.col("chunk_no").alias(f"{name}_no"))
    wide = linked.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_no", "a").alias("x"), F.coalesce("b_no", "b").alias("y"))
    copies = many.select("class_id", F.col("chunk_no").alias("x")).join(many.select("class_id", F.col("chunk_no").alias("y")), "class_id").where("x < y").select("x", "y")
    star = members.where(starred & (F.col("chunk_no") != F.col("first_alike"))).select(F.col("first_alike").alias("x"), F.col("chunk_no").alias("y"))
    every = wide.unionByName(copies).unionByName(star).where("x <> y")
    return every.select(F.least("x", "y").alias("chunk_no_a"), F.greatest("x", "y").alias("chunk_no_b")).distinct()
