"""Problem 6: credentials embedded in source code and configuration.

A keyword automaton picks the lines on which a credential can begin; there, formats of issuers and assignments to telling
names are tried, with literals joined from parts read as one; candidates are then validated by structure (lengths and
alphabets of the issuer, decodable basic-auth values, bodies of private keys) and by what placeholders, references, names
of fields, digests and revision ids look like.  Values are masked with placeholders of the same length and alphabet, so
the code around them stays as it is.

Where the format has a checksum or an inner structure (the CRC-32 at the end of tokens of two issuers, the header of a signed
web token, the encoded frame of a private key), ``checked`` says whether it holds.  It is a grade, not a condition: older tokens of
the same issuers have no checksum, and a token with one mistyped character is still to be masked.

Defined results: null content gives no finding and stays null; repeated rows give one result; overlapping findings count
once, from the first; texts of any length are read whole.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from bisect import bisect_left as bisect
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over

#: What the automaton looks for, lower case.
KEYWORDS = (
    "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "xoxa-", "xoxs-", "xapp-", "eyj", "tok-", "npm_", "hf_", "sg.", "aiza", "ya29.",
    "password", "passwd", "pwd", "passphrase", "passwort", "_pass", "pass=", "pass:", "secret", "apikey", "api_key", "api-key", "key", "token", "credential", "basic ", "bearer", "://", "private key-----",
)
#: Value formats of issuers.
ISSUERS = re.compile(
    r"(?<![\w-])(?:A(?:KIA|SIA)[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{40,}|glpat-[\w-]{20,}|[sr]k_live_[A-Za-z0-9]{20,}|xox[abps]-\d{8,}-[\w-]{16,}|xapp-\d-[\w-]{20,}|tok-[0-9a-f]{8}\.[A-Za-z0-9]{24,}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{34}|SG\.[\w-]{16,}\.[\w-]{32,}|AIza[\w-]{35}|ya29\.[\w-]{40,}|eyJ[\w-]{10,}\.eyJ[\w-]{10,}\.[\w-]{10,})(?![\w-])"
)
_LITERAL = r"(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"
#: What may stand between the parts of a joined literal.
_SEAM = re.compile(r"\s*+[+.,]?\s*+(?:\\\n\s*+)?+")
_PART = re.compile(_LITERAL)
_NAMES = r"pass(?:word|wd|phrase|wort)?|pwd|secret|api[_-]?key|(?:access|auth|private|signing|encryption|hmac|master|session|cookie|client|service|account|storage|license|shared|secret)[_-]?key|key|token|credentials?"
_ASSIGN = re.compile(rf"(?<![\w$])(?P<name>[A-Za-z_$][\w$.-]*)[\"'`]?\]?\s*(?::\s*(?:&\s*)?(?:'static\s+)?[A-Za-z_][\w<>\[\], ]*?\s*)?(?:=>|:=|[:=])\s*(?P<open>[A-Za-z]{{0,2}}(?=[\"'`]))?(?P<value>{_LITERAL}|[^\s\"'`,;#]\S*)")
_TELLING = re.compile(rf"(?:^|[_.-]|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))(?:{_NAMES})(?=$|[_.-]?(?:value|old|new|prod|live|test|dev|\d+)?$)", re.I)
_SQUASHED = re.compile(r"(?:password|passwd|passphrase|secret|apikey|secretkey|accesstoken|authtoken|clientsecret)$", re.I)
_PUBLIC = re.compile(r"public|(?:^|_)(?:name|field|header|prefix|id|path|file|url|type|label|hint|policy|length|count)$|foreign|primary|sort|cache_?key|partition", re.I)
_IN_COMMENT = re.compile(r"(?:^|[^\w:])(?:#|//|/\*|\*|--)\s?.*?\b(?:password|passwd|pwd|passphrase|secret|token|key|credentials?)\b[^\"'\n:=]{0,40}[:=]\s*(?P<value>[^\s\"'`,;]{8,})", re.I)
_URL = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]{1,20}://(?P<user>[^\s/:@\"'`<>]*):(?P<value>[^\s/@\"'`]+)@[\w\[]")
_BASIC = re.compile(r"\bbasic\s+(?P<value>[A-Za-z0-9+/_-]{8,}={0,2})(?![\w+/=])", re.I)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?P<body>(?:[A-Za-z0-9+/=\s,:]++|\\[nr]|[\"'`]\s*(?:\+|\\\n|,)?\s*[\"'`]|[*#/]{1,2}\s|Proc-Type|DEK-Info)*+)")
#: How values of issuers begin.
_HEAD = re.compile(r"A(?:KIA|SIA)|gh[pousr]_|github_pat_|glpat-|[sr]k_live_|xox[abps]-|xapp-|tok-|npm_|hf_|SG\.|AIza|ya29\.|eyJ")
#: Placeholders and references.
_PLACEHOLDER = re.compile(
    r"^(?:x+|\*+|\.+|-+|_+|0+|(?:123)+\d*|abc\w{0,6}|change[_-]?(?:me|it)\W*|changeme\w*|example\w*|placeholder\w*|replace[_-]?(?:me|this)\w*|your[_-].*|my[_-]?(?:password|secret|key|token)|dummy\w*|sample\w*|test(?:ing|123)?|todo|tbd|none|null|nil|undefined|true|false|redacted|removed|hidden|secret|password|passwd|token|insert.*|fill.*|enter.*|default|foo\w*|bar|baz|n/?a|empty)$"
    r"|^<.*>$|^\[.*\]$|^\$|^%|^\{\{|\$\{|\{\{|^env[:.(]|^vault[:.]|^secret(?:s|manager)?[:./]|^ref[:+]|^arn:|^file:|^keyring:|^ssm:|^op://|process\.env|os\.(?:environ|getenv)|getenv|^@|_HERE$|^#\{|^\(|^\w+(?:\.\w+)*\(",
    re.I,
)
_REFERENCE = re.compile(r"^[A-Za-z_][\w]*(?:(?:\.|::|->)[A-Za-z_]\w*)*(?:\[.*\]|\(.*\)?)?[,;)]?$")
_DIGEST = re.compile(r"^(?:(?:sha|md5|sha\d+|blake\w*)[-:$]|data:|ssh-(?:rsa|ed25519|dss) |https?://|\d{4}-\d\d-\d\d|[\da-f]{8}-[\da-f]{4}-[\da-f]{4}-[\da-f]{4}-[\da-f]{12}$)", re.I)


@cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k in KEYWORDS:
        a.add_word(k, len(k))
    a.make_automaton()
    return a


def candidate_lines(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each line on which a keyword stands."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    end = -1
    for at, _ in _automaton().iter(low):
        if at <= end:
            continue
        start = low.rfind("\n", 0, at) + 1
        end = low.find("\n", at)
        end = len(low) if end < 0 else end
        yield start, end


def classes(value: str) -> int:
    return bool(re.search("[a-z]", value)) + bool(re.search("[A-Z]", value)) + bool(re.search(r"\d", value)) + bool(re.search(r"[^A-Za-z\d]", value))


def random_looking(value: str, least: int = 16) -> bool:
    """Long, of one solid alphabet, with letters and digits interleaved as in no word or name."""
    if len(value) < least or not re.fullmatch(r"[A-Za-z0-9+/=_.~-]+", value) or not re.search(r"\d", value) or not re.search("[A-Za-z]", value):
        return False
    if re.fullmatch(r"[a-z_]+\d{0,4}|[A-Z_]+\d{0,4}|(?:[A-Za-z]+[-_./])*[A-Za-z]+\d{0,4}", value):
        return False
    runs = re.findall(r"\d+|[a-z]+|[A-Z]+", value)
    return len(runs) >= len(value) / 6 and len(set(value)) >= 8


def live(name: str, value: str) -> bool:
    """Whether a value given to a telling name is a credential and no placeholder, reference, name or digest."""
    if len(value) < 6 or _PLACEHOLDER.search(value) or _DIGEST.search(value) or re.search(r"\s", value) or len(set(value)) < 4:
        return False
    if re.search(r"pass(?:word|wd|phrase|wort)?$|pwd$|(?:^|_)pass(?:_|$)", name, re.I):
        return classes(value) >= 2 and bool(re.search(r"\d|[^\w\s/.:-]", value)) and not re.fullmatch(r"[a-z]+(?:[-_/.][a-z]+)*|[A-Z][A-Za-z]*(?:-[A-Z][A-Za-z]*)*|[A-Z_]+", value)
    return random_looking(value)


def basic(value: str) -> bool:
    """A basic-auth value decodes to a user and a password."""
    try:
        text = base64.b64decode(value.rstrip("=").translate({45: 43, 95: 47}) + "=" * (-len(value.rstrip("=")) % 4), validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    user, colon, password = text.partition(":")
    return bool(colon and password and text.isprintable()) and not _PLACEHOLDER.search(password)


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_holds(token: str) -> bool:
    """Whether the last six digits (base 62) of what stands behind the prefix are the CRC-32 of the digits before them."""
    body = token.partition("_")[2]
    n, digits = zlib.crc32(body[:-6].encode()), ""
    while n:
        n, d = divmod(n, 62)
        digits = _BASE62[d] + digits
    return len(body) > 6 and body[-6:] == digits.rjust(6, "0")


def _decoded(value: str) -> bytes:
    plain = value.translate({45: 43, 95: 47}).rstrip("=")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def checked(kind: str, value: str) -> bool | None:
    """Whether checksum or inner structure of a credential hold; None for formats without either."""
    if kind == "basic":
        return True
    if kind == "private_key":
        body = re.sub(r"-----[^-]*-----|\\[nr]|[^A-Za-z0-9+/]", "", value)
        return _decoded(body).startswith((b"\x30", b"openssh-key-v1\0"))
    if kind != "issuer":
        return None
    value = "".join(re.findall(r"[\w.=-]+", value))
    if re.match(r"gh[pousr]_[A-Za-z0-9]{36}$|npm_", value):
        return crc_holds(value)
    if value.startswith("eyJ"):
        try:
            return "alg" in json.loads(_decoded(value.partition(".")[0]))
        except (ValueError, TypeError):
            return False
    return None


class Joined:
    """Literals joined from parts, of one text; a line inside such a literal continues the parts that are known, so long lists are read once."""

    def __init__(self, text: str) -> None:
        self.text, self.parts, self.stop = text, [], -1

    def line(self, start: int, end: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
        """Parts (begin and end of each with quotes) and the number of the first, of the literals that begin on a line."""
        at = start
        while at < end and (p := _PART.search(self.text, at, end)):
            i = bisect(self.parts, (p.start(), 0)) if p.start() < self.stop else len(self.parts)
            if i == len(self.parts) or self.parts[i] != p.span():
                self.parts, i = [p.span()], 0
                while m := _PART.match(self.text, _SEAM.match(self.text, self.parts[-1][1]).end()):
                    self.parts.append(m.span())
                self.stop = self.parts[-1][1]
            if len(self.parts) - i > 1:
                yield self.parts, i
                at = self.stop
            else:
                at = p.start() + 1

    def value(self, parts: list[tuple[int, int]], i: int) -> str:
        return "".join([self.text[a + 1 : b - 1] for a, b in parts[i:]])

    def issuer(self, parts: list[tuple[int, int]], i: int) -> str | None:
        """The value, if an issuer gives such."""
        head = ""
        for a, b in parts[i:]:
            head += self.text[a + 1 : b - 1][:16]
            if len(head) >= 11:
                break
        return value if _HEAD.match(head) and ISSUERS.fullmatch(value := self.value(parts, i)) else None


def _candidates(text: str, start: int, end: int, config: bool, chains: Joined) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, kind and value of what stands on a line; a literal joined from parts may end on a later one."""
    line = text[start:end]
    for m in ISSUERS.finditer(line):
        yield start + m.start(), start + m.end(), "issuer", m[0]
    joined = {}
    if any(q in line for q in "\"'`"):
        for parts, i in chains.line(start, end):
            joined[parts[i][0]] = (parts, i)
            if value := chains.issuer(parts, i):
                yield parts[i][0] + 1, parts[-1][1] - 1, "issuer", value
    for m in _URL.finditer(line):
        v = m["value"]
        if not _PLACEHOLDER.search(v) and not re.fullmatch(r"[A-Z_]+|\d{1,5}", v) and "{" not in v:
            yield start + m.start("value"), start + m.end("value"), "url", v
    for m in _BASIC.finditer(line):
        if basic(m["value"]):
            yield start + m.start("value"), start + m.end("value"), "basic", m["value"]
    for begin in re.finditer("-----BEGIN ", line):
        m = _PEM.match(text, start + begin.start())
        if not m:
            continue
        body = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", m["body"])
        if len(body) >= 40:
            yield m.start(), m.end(), "private_key", m[0]
    for m in _ASSIGN.finditer(line):
        name, raw = m["name"], m["value"]
        if not (_TELLING.search(name) or _SQUASHED.search(name)) or _PUBLIC.search(name):
            continue
        at = start + m.start("value")
        if raw[0] in "\"'`":
            a, b, value = at + 1, start + m.end("value") - 1, raw[1:-1]
            if at in joined:
                b, value = joined[at][0][-1][1] - 1, chains.value(*joined[at])
        else:
            if not config or _REFERENCE.match(raw) and not re.search(r"\d", raw):
                continue
            value = raw
            a, b = at, at + len(value)
        if live(name, value):
            yield a, b, "assigned", value
    for m in _IN_COMMENT.finditer(line):
        if random_looking(m["value"], 20) and not _PLACEHOLDER.search(m["value"]) and not _DIGEST.search(m["value"]):
            yield start + m.start("value"), start + m.end("value"), "comment", m["value"]


def find(text: str, config: bool = False) -> list[tuple[int, int, str]]:
    """Places of credentials: start, end, kind; without overlaps, in order.  config: values need no quotes."""
    chains = Joined(text)
    found = sorted({(a, b, kind) for s, e in candidate_lines(text) for a, b, kind, _ in _candidates(text, s, e, config, chains)}, key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for f in found:
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


_HOLD = re.compile(r"\\[nr\"'\\]|-----(?:BEGIN|END)[A-Z0-9 ]*-----|[\"'`]\s*[+.,]?\s*(?:\\\n\s*)?[\"'`]")
_CLASS = str.maketrans({**{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "123456789"}})


def placeholder(value: str) -> str:
    """Same length, each character of the same class; escapes, markers and the seams of joined literals stay."""
    out, at = [], 0
    for m in _HOLD.finditer(value):
        out += [value[at : m.start()].translate(_CLASS), m[0]]
        at = m.end()
    return "".join([*out, value[at:].translate(_CLASS)])


def redact(text: str, config: bool = False) -> str:
    out, at = [], 0
    for a, b, _ in find(text, config):
        out += [text[at:a], placeholder(text[a:b])]
        at = b
    return "".join([*out, text[at:]])


_CONFIG = re.compile(r"\.(?:ya?ml|toml|ini|cfg|conf|env|properties|md|txt)$", re.I)


def _scan(rows: Iterable[tuple]) -> Iterable[tuple]:
    for file_id, path, content in rows:
        if content and file_id is not None:
            for a, b, kind in find(content, bool(_CONFIG.search(path or ""))):
                yield file_id, content.count("\n", 0, a) + 1, kind, b - a, checked(kind, content[a:b])


def credentials(contents: DataFrame) -> DataFrame:
    """file_id, line_no, kind, length of each credential, and whether its checksum or structure holds."""
    rows = contents.select("file_id", "path", "content").where("content IS NOT NULL")
    found = over(rows, _scan, "file_id bigint, line_no bigint, kind string, length int, checked boolean", ["file_id", "line_no", "kind", "length", "checked"], [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_()])
    return found.distinct()


#: Keys up to which those delivered more than once are broadcast, 8 bytes each.
FEW = 1_000_000


def redacted(df: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """key, text with credentials masked and the number of them, one row for each key; null texts stay null.

    Only rows whose key was delivered more than once are moved; rows without a key come out as one.
    """

    def run(rows: Iterable[tuple]) -> Iterable[tuple]:
        for k, p, t in rows:
            config = bool(_CONFIG.search(p or ""))
            n = len(find(t, config)) if t else 0
            yield k, redact(t, config) if n else t, n

    kind = dict(df.dtypes)[key]
    types = [pa.int64() if kind == "bigint" else pa.string(), pa.string(), pa.int32()]
    rows = df.select(key, path, text)
    again = df.groupBy(key).count().where(f"count > 1 AND {key} IS NOT NULL").select(key)
    if again.count() <= FEW:
        again = F.broadcast(again)
    once = rows.join(again, key, "left_anti").where(F.col(key).isNotNull())
    more = rows.join(again, key, "left_semi").unionByName(rows.where(F.col(key).isNull())).dropDuplicates([key])
    return over(once.unionByName(more), run, f"{key} {kind}, {text} string, n_masked int", [key, text, "n_masked"], types, rows=500)
