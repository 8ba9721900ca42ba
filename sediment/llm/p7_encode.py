"""Problem 7: the corpus as token ids of a public byte-level BPE.

The lexicon is a minimal acyclic automaton of byte strings with shared suffixes.  Each transition knows how many words
come before those behind it, so the walk over a word gives its number and the number gives its ids.  It is compiled once,
written as arrays of fixed layout, sent with the job's files and memory-mapped by the workers.  Its words are the corpus's
FREQUENT most frequent pieces (counted over all texts), each with the ids that exact merging gives it, and the vocabulary's
own entries.  Texts are cut into pieces by the tokenizer's own pattern, and all pieces of a batch walk the automaton in step; a
piece that it lacks is merged exactly by the ranks.  Which words are compiled changes speed only.

Defined results: null and empty texts give an empty list; strings that look like special tokens are plain text; repeated
rows give repeated results; texts of any length are read whole.
"""

from __future__ import annotations

import base64
import io
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

#: Most frequent pieces that are compiled; they and their counts are all that comes to the driver.
FREQUENT = 50_000
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts texts into pieces for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECES = regex.compile(PATTERN)
#: The same for texts of ASCII alone, without the four separators on which engines differ.
_ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
_ODD = re.compile("[\x1c-\x1f]")


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def pieces(text: str) -> list[str]:
    return _ASCII.findall(text) if text.isascii() and not _ODD.search(text) else _PIECES.findall(text)


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact merges: the lowest rank first, the leftmost of equal ones."""
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 200:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap, for long pieces."""
    import heapq

    n = len(parts)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if j >= n or parts[i] != a or parts[j] != b or not a:
            continue
        parts[i], parts[j] = a + b, b""
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := ranks.get(parts[i] + parts[nxt[i]])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[nxt[i]]))
        if prv[i] >= 0 and (r := ranks.get(parts[prv[i]] + parts[i])) is not None:
            heapq.heappush(heap, (r, prv[i], parts[prv[i]], parts[i]))
    return [ranks[p] for p in parts if p]


class Lexicon:
    """A minimal acyclic automaton over bytes; ``find`` walks many words in step."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.keys, self.to, self.before = arrays["keys"], arrays["to"], arrays["before"]
        self.final, self.offsets, self.ids = arrays["final"], arrays["offsets"], arrays["ids"]

    FIELDS = ("keys", "to", "before", "final", "offsets", "ids")

    @staticmethod
    def build(words: dict[bytes, Iterable[int]]) -> dict[str, np.ndarray]:
        """Compile words in sorted order; equal suffixes become one state as soon as no word can change them."""
        order = sorted(w for w in words if w)
        register: dict[tuple, int] = {}
        done: list[tuple] = []
        stack: list[list] = [[False, []]]
        last = b""

        def close(depth: int) -> None:
            while len(stack) - 1 > depth:
                final, arcs = stack.pop()
                key = (final, tuple(arcs))
                state = register.get(key)
                if state is None:
                    state = register[key] = len(done)
                    done.append(key)
                stack[-1][1][-1] = (stack[-1][1][-1][0], state)

        for w in order:
            common = next((i for i, (x, y) in enumerate(zip(last, w)) if x != y), min(len(last), len(w)))
            close(common)
            for c in w[common:]:
                stack[-1][1].append((c, -1))
                stack.append([False, []])
            stack[-1][0] = True
            last = w
        close(0)
        done.append((stack[0][0], tuple(stack[0][1])))
        n = len(done)
        below = np.zeros(n, np.int64)
        keys, to, before = [], [], []
        for s, (final, arcs) in enumerate(done):
            k = int(final)
            for c, t in arcs:
                keys.append((n - 1 - s) * 256 + c)
                to.append(n - 1 - t)
                before.append(k)
                k += int(below[t])
            below[s] = k
        at = np.argsort(np.asarray(keys, np.int64))
        ids = [list(words[w]) for w in order]
        return {
            "keys": np.asarray(keys, np.int64)[at],
            "to": np.asarray(to, np.int32)[at],
            "before": np.asarray(before, np.int32)[at],
            "final": np.asarray([f for f, _ in reversed(done)], bool),
            "offsets": np.cumsum([0, *map(len, ids)]).astype(np.int32),
            "ids": np.asarray([i for x in ids for i in x], np.int32),
        }

    @classmethod
    def dump(cls, arrays: dict[str, np.ndarray]) -> bytes:
        f = io.BytesIO()
        for k in cls.FIELDS:
            np.lib.format.write_array(f, arrays[k], version=(1, 0), allow_pickle=False)
        return f.getvalue()

    @classmethod
    def load(cls, path: str) -> Lexicon:
        """Memory-mapped: workers of one machine share the pages."""
        out, at = {}, 0
        with open(path, "rb") as f:
            for k in cls.FIELDS:
                f.seek(at)
                np.lib.format.read_magic(f)
                shape, _, dtype = np.lib.format.read_array_header_1_0(f)
                start = f.tell()
                out[k] = np.memmap(path, dtype, "r", start, shape) if shape[0] else np.empty(shape, dtype)
                at = start + dtype.itemsize * shape[0]
        return cls(out)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 for those it lacks."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        state, number = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero(sizes > 0)
        bad = sizes == 0
        step = 0
        while len(live):
            key = state[live] * 256 + flat[starts[live] + step]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            ok = self.keys[at] == key
            bad[live[~ok]] = True
            live, at = live[ok], at[ok]
            state[live] = self.to[at]
            number[live] += self.before[at]
            step += 1
            live = live[sizes[live] > step]
        bad |= ~self.final[state]
        return np.where(bad, -1, number)


class Encoder:
    """Pieces to ids: by the lexicon, and by exact merging for those it lacks, which this worker remembers."""

    LIMIT = 500_000

    def __init__(self, lexicon: Lexicon, ranks: dict[bytes, int]):
        self.lexicon, self.ranks = lexicon, ranks
        self.merged: dict[str, list[int]] = {}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts."""
        cut = [pieces(t) if t else [] for t in texts]
        index = {p: i for i, p in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
        if not index:
            return np.zeros(len(texts) + 1, np.int32), np.empty(0, np.int32)
        raw = [p.encode("utf-8", "replace") for p in index]
        number = self.lexicon.find(raw)
        known = np.maximum(number, 0)
        start = self.lexicon.offsets[known].astype(np.int64)
        size = self.lexicon.offsets[known + 1] - start
        if len(self.merged) > self.LIMIT:
            self.merged.clear()
        more, at, names = [], len(self.lexicon.ids), list(index)
        for i in np.flatnonzero(number < 0).tolist():
            ids = self.merged.get(names[i])
            if ids is None:
                ids = self.merged[names[i]] = merge(raw[i], self.ranks)
            start[i], size[i] = at + len(more), len(ids)
            more += ids
        ids = np.concatenate([self.lexicon.ids, np.asarray(more, np.int32)])
        seen = np.fromiter(map(index.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        n = size[seen]
        ends = np.cumsum(n)
        out = ids[np.repeat(start[seen] - ends + n, n) + np.arange(ends[-1])]
        pieces_before = np.cumsum([0, *map(len, cut)])
        return np.append(0, ends)[pieces_before].astype(np.int32), out


def frequent(documents: DataFrame, text: str, most: int = FREQUENT) -> list[str]:
    """The pieces that occur most often in all texts, and at least twice; each task counts its own first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()

        def counted() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([p.encode("utf-8", "replace") for p in count], pa.binary()), pa.array(list(count.values()), pa.int64())], names=["piece", "n"])
            count.clear()
            return batch

        for b in it:
            for t in b.column(0).to_pylist():
                if t:
                    count.update(pieces(t))
            if len(count) > 500_000:
                yield counted()
        if count:
            yield counted()

    counts = documents.where(F.col(text).isNotNull()).select(text).mapInArrow(run, "piece binary, n bigint").groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1")
    return [bytes(r[0]).decode("utf-8") for r in counts.orderBy(F.desc("n"), "piece").limit(most).collect()]


def own_words(ranks: dict[bytes, int]) -> dict[bytes, list[int]]:
    """The vocabulary's entries that its pattern leaves whole, with their ids by exact merging."""
    words = {}
    for w, r in ranks.items():
        try:
            if pieces(t := w.decode("utf-8")) == [t] and merge(w, ranks) == [r]:
                words[w] = [r]
        except UnicodeDecodeError:
            continue
    return words


def published(spark: SparkSession, data: bytes, stem: str) -> str:
    """Write a file to the shared folder and hand it to the job's files, which executors fetch; returns its name there."""
    name = f"{stem}-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark, stem)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, most: int = FREQUENT) -> DataFrame:
    """key, ids of each row."""
    spark = documents.sparkSession
    ranks = ranks_of(os.path.join(tokenizers, vocabulary))
    words = own_words(ranks)
    for p in frequent(documents, text, most):
        words.setdefault(p.encode("utf-8"), merge(p.encode("utf-8"), ranks))
    name = published(spark, Lexicon.dump(Lexicon.build(words)), "lexicon")
    shared = spark.sparkContext.broadcast(ranks)
    kind = documents.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(Lexicon.load(SparkFiles.get(name)), shared.value)
        for b in it:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                offsets, ids = enc.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[key, "ids"])

    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")
