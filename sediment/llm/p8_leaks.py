"""Problem 8: evaluation texts leaking into documents.

Windows of WINDOW words of items and documents are embedded by a random walk that maps edit distance to Hamming distance
(the walk repeats or passes on a symbol by random bits of step and symbol, so two texts with an edit fall into step again).
Each of TABLES hash tables samples SAMPLE positions of the embedding by one of WALKS walks, the same in all windows; windows
with equal samples in any table are candidates, and the edit distance of every candidate is computed.  Equal windows have
equal embeddings, so they are found with certainty; a window within MAX_EDITS word edits is found with the recall that
TABLES gives (tested: 0.95 or more for one and two substitutions, insertions and deletions).  A document window that has more
than MAX_EDITS words that no item uses cannot be within that distance and is not embedded; this loses nothing.

``exact`` and ``leaks`` are one operator: the first keeps the pairs whose least distance is 0.

The items are a stated query set: they are read in blocks of BLOCK items, and each block is sent to all documents.  A window
of WINDOW words is the size at which a passage counts as leaked, so items of any length are covered by windows of that size.

Defined results: null or short texts (fewer than WINDOW words) leak nothing; equal items are each reported; repeated rows
give one result; an empty table on either side gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 12
MAX_EDITS = 2
TABLES = 32
SAMPLE = 4
WALKS = 8
WALK = 3 * WINDOW
BLOCK = 5000
_WORD = re.compile(r"[^\W_]+")
_M = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def walk(windows: np.ndarray, number: int = 0) -> np.ndarray:
    """Embeddings of rows of word names: at each step the symbol is written, and a bit of step and symbol says whether to pass on."""
    n, width = windows.shape
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
    at, rows = np.zeros(n, np.int64), np.arange(n)
    out = np.empty((n, WALK), np.uint64)
    for step in range(WALK):
        symbol = padded[rows, at]
        out[:, step] = symbol
        bit = (_mix(symbol + np.uint64(0x9E3779B97F4A7C15 * (1000 * number + step + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(40)) & np.uint64(1)
        at = np.minimum(at + bit.astype(np.int64), width)
    return out


def positions(tables: int = TABLES, sample: int = SAMPLE, seed: int = 17) -> np.ndarray:
    """Sampled positions of each table; early ones, where the walks have not yet run out of words."""
    rng = np.random.default_rng(seed)
    return np.stack([np.sort(rng.choice(2 * WINDOW, sample, replace=False)) for _ in range(tables)])


def keys(windows: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """One key per window and table; the tables take turns with independent walks."""
    walks = [walk(windows, i) for i in range(min(WALKS, len(tables)))]
    out = np.empty((len(windows), len(tables)), np.uint64)
    for t, pos in enumerate(tables):
        k = np.full(len(windows), np.uint64(t + 1))
        e = walks[t % len(walks)]
        for p in pos:
            k = _mix(k * _M + e[:, p])
        out[:, t] = k
    return out


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distance of each row of words of a to the row of b."""
    n, width = a.shape
    row = np.tile(np.arange(width + 1, dtype=np.int8)[:, None], (1, n))
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for i in range(width):
        diagonal = row[0].copy()
        row[0] = i + 1
        for j in range(width):
            best = np.minimum(np.minimum(row[j + 1], row[j]) + 1, diagonal + (a[i] != b[j]))
            diagonal = row[j + 1].copy()
            row[j + 1] = best
    return row[-1]


class Names(dict):
    """Words to 64-bit names."""

    LIMIT = 2_000_000

    def __missing__(self, w: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        n = self[w] = xxhash.xxh3_64_intdigest(w)
        return n


class Items:
    """Index of a block of items: windows, their keys in all tables, the words they use."""

    def __init__(self, items: list[tuple[int, str]], tables: np.ndarray):
        names, windows, owner = Names(), [], []
        for item, text in items:
            w = [names[x] for x in words_of(text)]
            for k in range(len(w) - WINDOW + 1):
                windows.append(w[k : k + WINDOW])
                owner.append(item)
        self.tables = tables
        self.windows = np.asarray(windows, np.uint64).reshape(-1, WINDOW)
        self.owner = np.asarray(owner, np.int64)
        self.known = np.unique(self.windows)
        k = keys(self.windows, tables)
        flat = k.T.reshape(-1)
        order = np.argsort(flat, kind="stable")
        self.sorted = flat[order]
        self.window_of = np.tile(np.arange(len(self.windows)), len(tables))[order]


def scan(items: Items, docs: list[tuple[int, str]], names: Names, edits: int) -> Iterator[tuple[int, int, int]]:
    """Document, item and smallest number of edits between a window of each."""
    flat, sizes, ids = [], [], []
    for doc, text in docs:
        w = words_of(text)
        if len(w) >= WINDOW:
            flat.extend(map(names.__getitem__, w))
            sizes.append(len(w))
            ids.append(doc)
    if not flat or not len(items.windows):
        return
    x = np.asarray(flat, np.uint64)
    at = np.searchsorted(items.known, x)
    at[at == len(items.known)] = 0
    known = np.concatenate([[0], np.cumsum(items.known[at] == x)])
    count = known[WINDOW:] - known[:-WINDOW]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.flatnonzero((count >= WINDOW - edits) & (owner[: len(count)] == owner[WINDOW - 1 :]))
    if not len(start):
        return
    windows = x[start[:, None] + np.arange(WINDOW)]
    k = keys(windows, items.tables)
    code = [np.empty(0, np.int64)]
    for t in range(k.shape[1]):
        lo = np.searchsorted(items.sorted, k[:, t], "left")
        n = np.searchsorted(items.sorted, k[:, t], "right") - lo
        i = np.repeat(np.arange(len(n)), n)
        j = items.window_of[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        code.append(np.unique(i * len(items.windows) + j))
    met = np.unique(np.concatenate(code))
    best: dict[tuple[int, int], int] = {}
    for at in range(0, len(met), 100_000):
        i, j = np.divmod(met[at : at + 100_000], len(items.windows))
        d = edit_distances(windows[i], items.windows[j])
        ok = d <= edits
        for pair, e in zip(zip(owner[start[i[ok]]].tolist(), items.owner[j[ok]].tolist()), d[ok].tolist()):
            if e < best.get(pair, edits + 1):
                best[pair] = e
    for (doc, item), e in best.items():
        yield ids[doc], item, e


def leaks(documents: DataFrame, eval_items: DataFrame, edits: int = MAX_EDITS, tables: int = TABLES) -> DataFrame:
    """doc_id, item_id, edits: windows of WINDOW words of the two within that many word edits."""
    spark = documents.sparkSession
    held = eval_items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().toLocalIterator()
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    pos = positions(tables)
    parts = []
    while (block := [(r[0], r[1]) for r in islice(held, BLOCK)]) or not parts:
        index = spark.sparkContext.broadcast(Items(block, pos))

        def run(it: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            names = Names()
            for b in it:
                for start in range(0, b.num_rows, 500):
                    part = b.slice(start, 500)
                    found = list(scan(index.value, list(zip(part.column(0).to_pylist(), part.column(1).to_pylist())), names, edits))
                    if found:
                        d, i, e = zip(*found)
                        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(e, pa.int32())], names=["doc_id", "item_id", "edits"])

        parts.append(docs.mapInArrow(run, "doc_id bigint, item_id bigint, edits int"))
    return reduce(DataFrame.unionAll, parts).groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def exact(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """doc_id, item_id: at least WINDOW consecutive words are shared."""
    return leaks(documents, eval_items).where("edits = 0").select("doc_id", "item_id")
