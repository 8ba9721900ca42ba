"""Problem 9: long verbatim spans shared between documents.

Anchors are winnowed by character: every character with COVER characters behind it (itself included) has a name, the hash of
those; every stretch of LENGTH characters holds LENGTH - COVER + 1 of them, of which the one with the least hash, and of
equal ones the last, is an anchor.  That choice depends on the stretch alone, so documents that share a stretch of any kind
of text have an anchor with the same name at the same place of it: no pair is lost.  (Recompression, which names symbols
by their neighbourhood, gives no such bound: an end of a stretch can spoil symbols longer than the stretch.)

Where a text repeats itself, equal names follow one another, one for each repetition.  Of stretches with equal text there
only the first and the last give anchors; equal stretches have equal anchors, so no pair of documents is lost by that either.

Anchors whose name occurs in more than one document come with the text to their left and right, and each pair of them is
verified character by character.
Names with more than HOT occurrences are split first: an occurrence is filed under the texts of STEP * k characters to its
left and LENGTH - STEP * (k + 1) to its right, for all k, of which any true pair has one in common.  A passage in very many
different documents has all of them under one such text, and all their pairs are results; the occurrences of a name with more
than SPLIT are therefore spread over groups, and each pair of groups is a key of its own, so that no task has to pair more
than about 2 * SPLIT occurrences.

Equal texts form classes, and only the document with the least id of a class is paired; ``found`` expands classes to pairs
of documents.  A class of more than ``expand`` documents is not expanded: its members are paired with its representative, which
stands for it in other pairs, and ``members`` names them all; expand=None expands every class.

Defined results: null texts and texts below LENGTH share nothing; a document is not compared with itself; repeated rows count
once; equal texts of at least LENGTH characters share everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 400
COVER = 110
BLOCK = 500_000
HOT = 24
STEP = 50
SPLIT = 1000
EXPAND = 256
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOW = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(b: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, b, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: list[str], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and name of the anchors of texts."""
    empty = np.empty(0, np.int64)
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if not len(sizes) or sizes.max() < length:
        return empty, empty, empty.astype(np.uint64)
    codes = np.concatenate(raw)
    cover = min(COVER, length)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * _powers(_B, len(codes)), dtype=np.uint64)])
    back = _powers(_B_INV, len(codes))
    name = _mix((total[cover:] - total[:-cover]) * back[: len(codes) - cover + 1])
    # the least hash, and of equal ones the last, as one number
    order = (name & ~_LOW) | (_LOW - np.arange(len(name), dtype=np.uint64))
    chosen = (_LOW - (_least(order, length - cover + 1) & _LOW)).astype(np.int64)
    # stretches (by their first character) that lie in one text
    stretch = np.flatnonzero(np.arange(len(chosen)) + length <= np.repeat(ends, sizes)[: len(chosen)])
    chosen = chosen[stretch]
    first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    place = chosen[first]
    d = np.searchsorted(ends, place, "right")
    key = name[place]
    again = (key[1:] == key[:-1]) & (d[1:] == d[:-1])
    if again.any():
        repeats = np.append(again, False) | np.append(False, again)
        anchor = np.repeat(np.arange(len(place)), np.diff(np.append(first, len(chosen))))
        look = np.flatnonzero(repeats[anchor])
        at = stretch[look]
        text = _mix((total[at + length] - total[at]) * back[at])
        by = np.lexsort((at, text, d[anchor[look]]))
        other = (text[by][1:] != text[by][:-1]) | (d[anchor[look[by]]][1:] != d[anchor[look[by]]][:-1])
        keep = ~repeats
        keep[anchor[look[by[np.append(True, other) | np.append(other, True)]]]] = True
        d, place, key = d[keep], place[keep], key[keep]
    return d, place - starts[d], key


def common_length(a: tuple[str, str], b: tuple[str, str]) -> tuple[int, int]:
    """How far two occurrences agree to the left and to the right."""

    def agree(x: str, y: str, back: bool) -> int:
        n = min(len(x), len(y))
        if back:
            x, y = x[len(x) - n :], y[len(y) - n :]
        if x == y:
            return n
        lo, hi = 0, n
        while lo < hi:
            mid = (lo + hi + 1) // 2
            same = x[n - mid :] == y[n - mid :] if back else x[:mid] == y[:mid]
            lo, hi = (mid, hi) if same else (lo, mid - 1)
        return lo

    return agree(a[0], b[0], True), agree(a[1], b[1], False)


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """name, doc_id, place of all anchors."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, texts = np.asarray(b.column(0).to_pylist(), np.int64), b.column(1).to_pylist()
            block = np.cumsum([len(t) for t in texts]) // BLOCK
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(block)) + 1):
                if len(part):
                    d, place, key = anchors(texts[part[0] : part[-1] + 1], length)
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(ids[part][d]), pa.array(place.astype(np.int32))], names=["name", "doc_id", "place"])

    return docs.mapInArrow(run, "name bigint, doc_id bigint, place int")


def filed(rows: DataFrame, length: int, split: int = SPLIT) -> DataFrame:
    """file, part, doc_id, place, left, right: occurrences with their surroundings, hot names split; two of one part do not meet."""

    def batch(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["file", "part", "doc_id", "place", "left", "right"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for start in range(0, b.num_rows, 200):
                part = b.slice(start, 200)
                out = []
                for doc, text, marks in zip(*[c.to_pylist() for c in part.columns]):
                    for m in marks:
                        p = m["place"]
                        left, right = text[max(0, p - length) : p], text[p : p + length]
                        if len(left) + len(right) < length:
                            continue
                        if m["n"] <= HOT:
                            out.append((m["name"], None, doc, p, left, right))
                            continue
                        parts = -(-m["n"] // split)
                        own = xxhash.xxh3_64_intdigest(f"{doc} {p}") % parts
                        for k in range(length // STEP):
                            ll, rr = STEP * k, length - STEP * (k + 1)
                            if len(left) >= ll and len(right) >= rr:
                                h = xxhash.xxh3_64_intdigest(f"{m['name']}\0{k}\0" + left[len(left) - ll :] + "\0" + right[:rr])
                                for other in range(parts):
                                    key = xxhash.xxh3_64_intdigest(f"{h} {min(own, other)} {max(own, other)}")
                                    out.append((key - (1 << 63), None if own == other else own, doc, p, left, right))
                                    if len(out) >= 1000:
                                        yield batch(out)
                                        out = []
                if out:
                    yield batch(out)

    return rows.mapInArrow(run, "file bigint, part int, doc_id bigint, place int, left string, right string")


def long_texts(documents: DataFrame, length: int) -> DataFrame:
    return documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") >= length)).select("doc_id", "text")


def members(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, class_id (the least doc_id with an equal text), copies, of texts that have copies."""
    keyed = long_texts(documents, length).select("doc_id", F.unhex(F.sha2("text", 256)).alias("key")).distinct()
    sizes = keyed.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies")).where("copies > 1")
    return keyed.join(sizes, "key").select("doc_id", "class_id", "copies")


def shared_spans(documents: DataFrame, length: int = LENGTH, same: DataFrame | None = None, split: int = SPLIT) -> DataFrame:
    """a, b, a_start, b_start, n_chars: verified stretches of at least ``length`` equal characters of representatives a < b (within ``length`` around an anchor)."""
    docs = long_texts(documents, length)
    same = members(documents, length) if same is None else same
    # both uses of the marks take all columns of one exchange, so that it is made once and reused
    marks = occurrences(docs, length).where("name IS NOT NULL AND doc_id IS NOT NULL").repartition("name")
    shared = marks.groupBy("name").agg(F.count("place").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("name", "n")
    wanted = marks.join(shared, "name").groupBy("doc_id").agg(F.collect_set(F.struct("name", "place", "n")).alias("marks"))
    wanted = wanted.join(same.where("doc_id <> class_id").select("doc_id"), "doc_id", "left_anti")
    rows = filed(docs.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "marks"), length, split)
    side = lambda s: rows.select("file", *[F.col(c).alias(f"{c}_{s}") for c in ("part", "doc_id", "place", "left", "right")])
    pairs = side("a").join(side("b"), "file").where("doc_id_a < doc_id_b AND coalesce(part_a <> part_b, true)").drop("file", "part_a", "part_b")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for da, pa_, la, ra, db, pb, lb, rb in zip(*[b.column(c).to_pylist() for c in ("doc_id_a", "place_a", "left_a", "right_a", "doc_id_b", "place_b", "left_b", "right_b")]):
                x, y = common_length((la, ra), (lb, rb))
                if x + y >= length:
                    out.append((da, db, pa_ - x, pb - x, x + y))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()])], names=["a", "b", "a_start", "b_start", "n_chars"])

    return pairs.mapInArrow(run, "a bigint, b bigint, a_start int, b_start int, n_chars int")


def found(documents: DataFrame, length: int = LENGTH, expand: int | None = EXPAND, split: int = SPLIT) -> DataFrame:
    """doc_id_a < doc_id_b: the texts have a common substring of at least ``length`` characters."""
    same = members(documents, length)
    pairs = shared_spans(documents, length, same, split).select("a", "b").distinct()
    starred = F.col("copies") > (expand if expand is not None else 1 << 62)
    many = same.where(~starred | (F.col("doc_id") == F.col("class_id"))).select("class_id", "doc_id")
    side = lambda name: many.select(F.col("class_id").alias(name), F.col("doc_id").alias(f"{name}_id"))
    wide = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("a_id", "a").alias("x"), F.coalesce("b_id", "b").alias("y"))
    copies = many.select("class_id", F.col("doc_id").alias("x")).join(many.select("class_id", F.col("doc_id").alias("y")), "class_id").where("x < y").select("x", "y")
    star = same.where(starred & (F.col("doc_id") != F.col("class_id")))
    every = wide.unionByName(copies).unionByName(star.select(F.col("class_id").alias("x"), F.col("doc_id").alias("y")))
    return every.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def covered(text: str, spans: list[tuple[int, int]], length: int) -> int:
    """Characters of a text in stretches of ``length`` that stand in one of its verified spans, wherever in the text they stand.

    Where a text repeats itself only the ends of the repetition have anchors; what stands between them has the same stretches.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) < length:
        return 0
    total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * _powers(_B, len(codes)), dtype=np.uint64)])
    name = _mix((total[length:] - total[:-length]) * _powers(_B_INV, len(codes))[: len(codes) - length + 1])
    known = np.zeros(len(name), bool)
    for s, e in spans:
        known[s : e - length + 1] = True
    ends = np.zeros(len(codes) + 1, np.int64)
    at = np.flatnonzero(np.isin(name, np.unique(name[known])))
    ends[at] += 1
    ends[at + length] -= 1
    return int(np.count_nonzero(np.cumsum(ends)))


def shares(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_chars, n_shared, share, n_partners of every document with a text: how much of it lies in stretches of ``length`` characters that stand elsewhere too."""
    same = members(documents, length)
    spans = shared_spans(documents, length, same)
    ends = spans.select(F.col("a").alias("doc_id"), F.col("b").alias("other"), F.col("a_start").alias("s"), (F.col("a_start") + F.col("n_chars")).alias("e")).unionByName(
        spans.select(F.col("b").alias("doc_id"), F.col("a").alias("other"), F.col("b_start").alias("s"), (F.col("b_start") + F.col("n_chars")).alias("e"))
    )
    size = same.where("doc_id = class_id").select(F.col("class_id").alias("other"), "copies")
    partners = ends.select("doc_id", "other").distinct().join(size, "other", "left").groupBy("doc_id").agg(F.sum(F.coalesce("copies", F.lit(1))).alias("n_partners"))
    spots = ends.groupBy("doc_id", "s").agg(F.max("e").alias("e"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = [covered(text, [(x["s"], x["e"]) for x in spans], length) for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_shared"])

    marked = spots.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    shared = long_texts(documents, length).dropDuplicates(["doc_id"]).join(marked.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, n_shared bigint")
    every = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars"))
    rows = every.join(same, "doc_id", "left").withColumn("rep", F.coalesce("class_id", "doc_id"))
    rows = rows.join(shared.withColumnRenamed("doc_id", "rep"), "rep", "left").join(partners.withColumnRenamed("doc_id", "rep"), "rep", "left")
    n = F.when(F.col("copies").isNotNull(), F.col("n_chars")).otherwise(F.coalesce("n_shared", F.lit(0))).cast("bigint")
    return rows.select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), n.alias("n_shared"), F.round(F.coalesce(F.try_divide(n, "n_chars"), F.lit(0.0)), 6).alias("share"), (F.coalesce("n_partners", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("bigint").alias("n_partners"))
