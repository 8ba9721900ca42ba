"""Problem 4: natural language inside code, its language and its share of each file.

A hidden Markov model over the characters of a file has one state for code and one for each language; a state emits the
trigram that ends at a character, and changing the state costs a fixed penalty.  Outside comments and literals the state is
held at code.  A path that is held there is entered and left at code, so the best path of the whole file is made of the best
paths of its comments and literals, between code on both sides; these are found for many of them in step, on the file's own
characters.  Comments and literals of fewer words than count are held at code too.  A passage (a docstring, adjacent line
comments, a block comment, adjacent parts of a literal) counts in a language if enough of its words lie on that language's
state; words of tags, parameter lists, statements and encoded data are no words.

The emissions are trained on labelled ``documents`` (at most ``SAMPLE_ROWS`` rows of each language), on the code outside
comments and literals of at most ``SAMPLE_FILES`` files, and on NOTICES.  Both samples are those with the least hash of their
key, so they do not depend on the order of rows.  Every file is segmented in full.

Defined results: null content gives nothing; files that do not parse (problem 1) give nothing; repeated rows give one
result; without documents to train on only the languages of NOTICES have a state that says anything; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import code_files, confirmed, language_of, over
from .p1_syntax import syntax_error
from .prose import CJK, blanked, prose_lines, strip_noise

LANGS = ("en", "de", "fr", "es", "pt", "pl", "ru", "zh")
SAMPLE_ROWS = 400
SAMPLE_FILES = 300
BUCKETS = 1 << 15
SWITCH = 10.0
MIN_WORDS = 6
MIN_CHINESE = 12

#: Wording of licence and tool notices, which the documents lack; each is seen NOTICE_WEIGHT times in training.
NOTICES = {
    "en": [
        "This source may be used under the terms of the licence that accompanies it. Copyright the team and its contributors. All rights reserved.",
        "Code generated by a tool. DO NOT EDIT. This file was automatically generated from the schema by a compiler; changes will be lost.",
        "auto-generated, written by the tool on every build. Autogenerated file, do not modify by hand, run the generator instead.",
        "Bundled copy, taken from upstream without local changes. Imported verbatim from release; please send patches upstream instead.",
        "Third party source, see the notices file of that project. It is third-party code, its licence is kept at the address, distributed under a permissive licence.",
    ],
    "fr": ["Fichier produit à partir du schéma par un outil, ne pas modifier à la main."],
    "de": ["Diese Datei wurde von einem Werkzeug erzeugt und wird bei jedem Lauf überschrieben. Nicht von Hand ändern."],
    "es": ["Este archivo fue generado automáticamente, no lo modifique a mano."],
    "pt": ["Este ficheiro foi gerado automaticamente, não o altere à mão."],
}
NOTICE_WEIGHT = 25

_STR = r'"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\''
_SLASH = r"(?:(?<![:\w])//[^\n]*(?:\n[ \t]*//[^\n]*)*|/\*[\s\S]*?\*/)"
_JOIN = r"(?:\s*\+?\s*(?:\\\n\s*)?(?:%s))*"
_PY_STR = r'[A-Za-z]{0,2}(?:"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\')'
_TPL = r"`(?:[^`\\]|\\[\s\S])*`"
_RUST = r'(?:b?r(?P<h>#*)"[\s\S]*?"(?P=h)|b?"(?:[^"\\]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\.[^\']*)\')'
#: Comments and literals by language; adjacent line comments and adjacent parts of a literal are one match.
_SPANS = {
    "Python": re.compile(rf"#[^\n]*(?:\n[ \t]*#[^\n]*)*|{_PY_STR}{_JOIN % _PY_STR}"),
    "JavaScript": re.compile(rf"{_SLASH}|(?:{_TPL}|{_STR}){_JOIN % (_TPL + '|' + _STR)}"),
    "Go": re.compile(rf"{_SLASH}|(?:`[^`]*`|{_STR}){_JOIN % ('`[^`]*`|' + _STR)}"),
    "Java": re.compile(rf'{_SLASH}|(?:"""[\s\S]*?"""|{_STR}){_JOIN % _STR}'),
    "Rust": re.compile(rf"{_SLASH}|{_RUST}"),
    "C": re.compile(rf"{_SLASH}|(?:{_STR}){_JOIN % _STR}"),
}
_SPANS["TypeScript"], _SPANS["C++"] = _SPANS["JavaScript"], _SPANS["C"]
_MARK = re.compile(r"^[ \t]*(?:/\*+!?|\*+/|\*(?!/)|///?!?|//!|#+!?)[ \t]?|[ \t]*\*+/[ \t\r]*$", re.M)
_PARTS = {"Python": re.compile(_PY_STR), "Rust": re.compile(_RUST)}
_PART = re.compile(rf'"""[\s\S]*?"""|{_TPL}|{_STR}')
_QUOTES = re.compile(r"^[A-Za-z]{0,2}(?:r?#*)?(\"\"\"|'''|[\"'`])|(?:\"\"\"|'''|[\"'`])#*$")
_SIX = re.compile(r"(?:[^\W\d_]+[^\w\n]*\s+\W*(?:\w+\W+){0,3}?){3}|[㐀-鿿][^\n]{3}")
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def passages(language: str, text: str) -> Iterator[tuple[int, str, str]]:
    """Start and text of the comments and literals of a file that may hold prose, and the text with marks, seams and escapes blanked."""
    for m in _SPANS[language].finditer(text):
        s = m[0]
        if len(s) < 14 or not _SIX.search(s):
            continue
        if s[0] in "#/":
            body = _MARK.sub(_blank, s)
        else:
            at, out = 0, []
            for p in _PARTS.get(language, _PART).finditer(s):
                out += [re.sub(r"\S", " ", s[at : p.start()]), _QUOTES.sub(_blank, p[0])]
                at = p.end()
            body = "".join([*out, re.sub(r"\S", " ", s[at:])])
            if "\\" in body:
                body = body.replace("\\n", " \n").replace("\\t", "  ").replace('\\"', ' "').replace("\\'", " '")
        yield m.start(), s, body


def trigram_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that ends at each character of all texts, and the texts' lengths."""
    low = [x if len(x := t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    c = np.frombuffer(" \0".join(["", *low]).encode("utf-32-le", "surrogatepass"), np.uint32)[2:] if low else np.empty(0, np.uint32)
    c = np.where((c >= 48) & (c <= 57), 48, c).astype(np.uint64)
    p1, p2 = np.concatenate(([32], c[:-1])).astype(np.uint64), np.concatenate(([32, 32], c[:-2])).astype(np.uint64)[: len(c)]
    ids = ((c * np.uint64(0x9E3779B97F4A7C15) ^ p1 * np.uint64(0xC2B2AE3D27D4EB4F) ^ p2 * np.uint64(0x165667B19E3779F9)) >> np.uint64(40)) & np.uint64(BUCKETS - 1)
    keep = np.ones(len(c), bool)
    ends = np.cumsum(sizes + 2)[:-1]
    keep[ends - 2] = keep[ends - 1] = False
    return ids[keep].astype(np.int64), sizes


def emissions(samples: dict[str, list[str]]) -> np.ndarray:
    """Log probability of each trigram bucket in each state (code first)."""
    table = np.zeros((1 + len(LANGS), BUCKETS))
    for k, name in enumerate(("code", *LANGS)):
        ids, _ = trigram_ids([*(samples.get(name) or []), *NOTICES.get(name, []) * NOTICE_WEIGHT])
        table[k] = np.bincount(ids, minlength=BUCKETS) + 0.05
    return np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def train(contents: DataFrame, documents: DataFrame) -> np.ndarray:
    """Emissions from bounded samples of labelled rows; only the sampled rows' texts come to the driver."""
    labelled = documents.where("doc_id IS NOT NULL AND kind <> 'code'").select("doc_id", F.lower(F.substring("lang", 1, 2)).alias("name"), F.xxhash64("doc_id").alias("h"))
    least = Window.partitionBy("name").orderBy("h", "doc_id")
    names = dict(labelled.where(F.col("name").isin(*LANGS)).withColumn("k", F.row_number().over(least)).where(F.col("k") <= SAMPLE_ROWS).select("doc_id", "name").collect())
    texts = documents.where(F.col("doc_id").isin(*names) & F.col("text").isNotNull()).select("doc_id", "text").collect() if names else []
    paths = contents.where(language_of(F.col("path")).isNotNull() & F.col("file_id").isNotNull()).select("file_id")
    files = [r[0] for r in paths.orderBy(F.xxhash64("file_id"), "file_id").limit(SAMPLE_FILES).collect()]
    code = code_files(contents).where(F.col("file_id").isin(files)).select("file_id", "language", "content").distinct().collect() if files else []
    samples: dict[str, list[str]] = {"code": [_SPANS[language].sub("\n", text) for _, language, text in sorted(code)]}
    for doc, text in sorted(texts):
        samples.setdefault(names[doc], []).append(strip_noise("\n".join(prose_lines(text))))
    return emissions(samples)


def decode(table: np.ndarray, texts: list[str], width: int = 512) -> list[np.ndarray]:
    """Best state of each character of each text, for many texts in step."""
    out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    for at in range(0, len(order), width):
        part = order[at : at + width]
        ids, sizes = trigram_ids([texts[i] for i in part])
        n, steps = len(part), int(sizes.max(initial=0))
        if not steps:
            for i in part:
                out[i] = np.empty(0, np.int8)
            continue
        grid = np.zeros((steps, n), np.int64)
        col = np.repeat(np.arange(n), sizes)
        row = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        grid[row, col] = ids
        live = np.arange(steps)[:, None] < sizes[None, :]
        table_t = np.ascontiguousarray(table.T)
        states = table.shape[0]
        back = np.empty((steps, n, states), np.int8)
        own = np.arange(states, dtype=np.int8)[None, :]
        v = table_t[grid[0]]
        v = v - SWITCH * (np.arange(states) != 0)[None, :]
        for t in range(1, steps):
            best = v.argmax(1)
            top = v[np.arange(n), best][:, None] - SWITCH
            stay = v >= top
            back[t] = np.where(stay, own, best[:, None].astype(np.int8))
            step = np.where(stay, v, top) + table_t[grid[t]]
            v = np.where(live[t][:, None], step, v)
        # behind the passage stands code again
        state = (v - SWITCH * (own != 0)).argmax(1).astype(np.int8)
        path = np.zeros((steps, n), np.int8)
        r = np.arange(n)
        for t in range(steps - 1, -1, -1):
            path[t] = state
            if t:
                state = np.where(live[t], back[t, r, state], state)
        for k, i in enumerate(part):
            out[i] = path[: sizes[k], k]
    return out


def prose_of(table: np.ndarray, found: list[tuple[str, str]]) -> list[dict[str, tuple[int, int]]]:
    """For each passage (text, and text with marks blanked) the languages it holds enough words of, with the number of words or characters and of characters of text."""
    out = []
    for (_, body), states in zip(found, decode(table, [s for s, _ in found])):
        counts: dict[int, int] = {}
        for m in re.finditer(r"(?<![\w./\\@:#$-])[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w/\\@(\[=])", blanked(body)):
            w = m[0]
            if CJK.search(w):
                for i, ch in enumerate(w, m.start()):
                    if CJK.match(ch):
                        counts[int(states[i])] = counts.get(int(states[i]), 0) + 1
            elif not re.search(r"[a-z][A-Z]", w):
                k = int(states[(m.start() + m.end()) // 2])
                counts[k] = counts.get(k, 0) + 1
        chars = np.bincount(states, minlength=table.shape[0])
        out.append({LANGS[k - 1]: (c, int(chars[k])) for k, c in counts.items() if k and c >= (MIN_CHINESE if LANGS[k - 1] == "zh" else MIN_WORDS)})
    return out


def _scan(rows: Iterable[tuple], model) -> Iterable[tuple]:
    table = model.value if hasattr(model, "value") else model
    pending: list[tuple] = []

    def flush():
        found = iter(prose_of(table, [p for *_, ps in pending for p in ps]))
        for file_id, language, content, jsx, ps in pending:
            total: dict[str, list[int]] = {}
            for _ in ps:
                for lang, (_, chars) in next(found).items():
                    t = total.setdefault(lang, [0, 0])
                    t[0] += 1
                    t[1] += chars
            if total and syntax_error(language, content, jsx) is None:
                for lang, (n, chars) in total.items():
                    yield file_id, language, lang, n, chars, chars / len(content)
        pending.clear()

    size = 0
    for file_id, language, content, jsx in rows:
        ps = [(s, b) for _, s, b in passages(language, content)]
        if ps:
            pending.append((file_id, language, content, jsx, ps))
            size += sum(len(s) for s, _ in ps)
        if size > 400_000:
            yield from flush()
            size = 0
    yield from flush()


def prose(contents: DataFrame, files: DataFrame, documents: DataFrame) -> DataFrame:
    """file_id, lang, passages, characters of prose and their share of the file, per code file and language."""
    table = train(contents, documents)
    model = contents.sparkSession.sparkContext.broadcast(table)
    found = over(
        code_files(contents),
        lambda it: _scan(it, model),
        "file_id bigint, language string, lang string, n_passages int, n_chars int, share double",
        ["file_id", "language", "lang", "n_passages", "n_chars", "share"],
        [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64()],
    )
    return confirmed(found, files).drop("language").dropDuplicates(["file_id", "lang"])
