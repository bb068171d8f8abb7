"""Secret scans: fixed patterns, and literals by the names that they are given to.

Three patterns are always reported: ``assign``, ``access`` and ``hex``, leftmost matches
without overlap for each kind. A span is the whole match, in code points.

Beside them the text is read as source or configuration, whatever its language: wherever
something is bound to a name (``name = ..``, ``"name": ..``, ``name := ..``, ``d["name"] = ..``,
keyword arguments, ``export NAME=..``, YAML and INI lines, ``f("name", ..)``,
``--name value``, ``<name>value</name>``, ``scheme://user:..@host``) the expression behind
it is parsed into literals and names: concatenations, adjacent literals, parentheses over
several lines, calls and defaults. Names are replaced by what they are bound to before (or
else anywhere) in the text, also inside ``${name}`` and ``{name}``, so that a literal takes
part under the name that it ends up in. It is reported as ``literal`` if the name is
sensitive and the value neither a placeholder nor too plain: ``score``, the product of
both, is at least ``threshold``. Literals that lie within one span of a pattern are not
reported again. Reading is linear in the text; chains of names are followed up to
``MOST_PARTS`` literals.

Null texts count as empty; texts of any length are read whole and on their own; repeated
rows give repeated results; an empty table gives none; a column named ``findings`` is replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import in_batches, without

KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# a run that is too short as a whole has no long enough part, so the least length may stand in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: How much a name's word, or two words in a row, speak for a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "pwd": 0.9, "pass": 0.8, "pw": 0.7, "secret": 1.0, "secrets": 0.9, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "creds": 0.9, "authorization": 0.9, "auth": 0.8, "bearer": 0.9, "jwt": 0.9, "privatekey": 1.0, "secretkey": 1.0, "accesskey": 1.0, "authtoken": 1.0, "api key": 1.0,
    "access key": 1.0, "private key": 1.0, "signing key": 1.0, "encryption key": 1.0, "master key": 1.0, "account key": 0.9, "session key": 0.9, "shared key": 0.9, "storage key": 0.9, "webhook": 0.6,
}
#: Words that say the value is about a secret and not one.
ABOUT = frozenset([
    "length", "len", "min", "max", "count", "size", "limit", "type", "kind", "name", "url", "uri", "path", "file", "dir", "folder", "field", "column",
    "prompt", "label", "hint", "message", "error", "policy", "pattern", "regex", "format", "prefix", "suffix", "expiry", "expires",
    "expiration", "ttl", "timeout", "version", "env", "variable", "var", "class", "id", "ids", "algorithm", "alg", "enabled", "required", "valid",
    "public", "example", "test",
])
#: Values that stand for a value.
_PLACEHOLDER = re.compile(
    r"(?:change|replace|insert|enter|put|your|my|the)[\W_]?(?:me|this|it|here|own)?(?:[\W_].*)?|.*(?:example|placeholder|redacted|removed|dummy|sample|todo|fixme|lorem).*|(.)\1*|(?:[*x.\-_#]+)|<.*>|\{\{?.*\}?\}|\$\{?[\w.]*\}?|%[\w.]*%?|"
    r"null|none|nil|undefined|true|false|default|password\d*|passwd|secret|token|unknown|string|str|bytes|optional|required|empty|abc\d*|abcdef\w*|qwerty\w*|0?123456\d*|test\w*",
    re.I | re.S,
)
MOST_PARTS = 64
_MOST_TERMS = 64

_BIND = re.compile(r"(?<![=!<>~+\-*/%&|^:])(?::=|=>|=(?![=~>])|:(?![:/=]))")
_TARGET = re.compile(r"""([A-Za-z_$@][\w$.\-]*)["'`]?\]?[ \t]*$""", re.A)
_ANNOTATED = re.compile(r"""([A-Za-z_$][\w$]*)\??[ \t]*:[ \t]*[A-Za-z_][\w.\[\], |?]*$""", re.A)
_TARGET_CHARS = 160
_CALL = re.compile(r"""\(\s*(["'])([A-Za-z_][\w.\- ]{0,63})\1\s*,\s*""", re.A)
_FLAG = re.compile(r"(?<![\w-])--([A-Za-z][\w-]{0,63})[ \t]+(?![-\s])", re.A)
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]{0,63})>\s{0,8}([^<\s]{1,4096})\s{0,8}</", re.A)
_USERINFO = re.compile(r"://[^\s:/@]{0,256}:([^\s@/]{1,256})@")
_BODY = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*", re.S) for q in "\"'`"}
_NAME = re.compile(r"\$?[A-Za-z_][\w$]*(?:(?:\.|->|::)[A-Za-z_][\w$]*)*|\$\{[A-Za-z_][\w.]*\}", re.A)
_PREFIX = re.compile(r"[rbfuRBFU]{1,2}(?=[\"'])")
_SPACE, _ALL_SPACE = re.compile(r"(?:[ \t]|\\\n)*"), re.compile(r"(?:\s|\\\n)*")
_JOIN = re.compile(r"\+=?|\.\.|\.(?=\s)|~|&(?!&)|<<")
_OTHERWISE = re.compile(r"\|\||\?\?|\bor\b|,")
_BARE = re.compile(r"(?:(?:Bearer|Basic|Token)[ \t]+)?[^\s\"'`,;<>(){}\[\]|&\\]{1,1024}")
_SCHEME = re.compile(r"(?:Bearer|Basic|Token)\s+(?=\S+$)", re.I)
_NOTHING = re.compile(r"\s*(?:(?:Bearer|Basic|Token)\s*)?", re.I)
_HOLE = re.compile(r"\$\{([A-Za-z_][\w.]{0,63})\}|\{([A-Za-z_][\w.]{0,63})\}|\$([A-Za-z_]\w{0,63})|%\(([A-Za-z_]\w{0,63})\)s", re.A)
_SUBWORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_GETTERS = frozenset(["getenv", "get", "environ.get", "env", "getproperty", "getoption", "fetch", "config"])

Part = tuple[int, int]


@dataclass
class Binding:
    """One value of the names ``targets``; ``terms`` are literals (start, end) and names, in their order."""

    at: int
    targets: list[str]
    terms: list[Part | str]
    bare: bool = False


class Reader:
    """Finds the bindings of one text."""

    def __init__(self, text: str):
        self.text, self.bindings = text, []
        #: An open quote before this place is known to have no end.
        self.open_until = dict.fromkeys(_BODY, 0)

    def read(self) -> list[Binding]:
        text = self.text
        for m in _BIND.finditer(text):
            before = text[max(0, m.start() - _TARGET_CHARS) : m.start()]
            if target := _TARGET.search(before):
                names = [_plain(target[1])]
                if m[0] == "=" and (annotated := _ANNOTATED.search(before)):
                    names.append(annotated[1])
                self._expressions(m.end(), names, m[0])
        for m in _CALL.finditer(text):
            self._expressions(m.end(), [m[2]], "(")
        for m in _FLAG.finditer(text):
            self._expressions(m.end(), [m[1]], "--")
        for m in _ELEMENT.finditer(text):
            self.bindings.append(Binding(m.start(), [m[1]], [m.span(2)], True))
        for m in _USERINFO.finditer(text):
            self.bindings.append(Binding(m.start(), ["password"], [m.span(1)], True))
        self.bindings.sort(key=lambda b: b.at)
        return self.bindings

    def _string(self, i: int) -> tuple[Part, int] | None:
        """The inside of the string that opens at i, and the place behind it."""
        text, q = self.text, self.text[i]
        if i < self.open_until[q]:
            return None
        if text.startswith(q * 3, i):
            end = text.find(q * 3, i + 3)
            if end >= 0:
                return (i + 3, end), end + 3
            self.open_until[q] = len(text)
            return None
        end = _BODY[q].match(text, i + 1).end()
        if end < len(text) and text[end] == q:
            return (i + 1, end), end + 1
        self.open_until[q] = end
        return None

    def _expressions(self, i: int, targets: list[str], kind: str) -> None:
        """Parses what is bound from i on: joined terms, and further ones as defaults."""
        text, at, depth, terms, found = self.text, i, 0, [], False
        i = _SPACE.match(text, i).end()
        start, skip_first = i, False
        for _ in range(_MOST_TERMS):
            i = (_ALL_SPACE if depth else _SPACE).match(text, i).end()
            while text.startswith("(", i):
                depth += 1
                i = _ALL_SPACE.match(text, i + 1).end()
            if prefix := _PREFIX.match(text, i):
                i = prefix.end()
            c = text[i : i + 1]
            if c and c in _BODY:
                if (s := self._string(i)) is None:
                    break
                found = True
                if not skip_first:
                    terms.append(s[0])
                skip_first, i = False, s[1]
            elif name := _NAME.match(text, i):
                i = name.end()
                if text.startswith("(", i):  # a call: its literals are the value, but for the key of a getter
                    depth += 1
                    i += 1
                    skip_first = name[0].lower().rpartition("getenv")[1] == "getenv" or re.split(r"\.|->|::", name[0].lower())[-1] in _GETTERS
                    found = True
                    continue
                terms.append(_plain(name[0]))
            else:
                break
            i = (_ALL_SPACE if depth else _SPACE).match(text, i).end()
            while depth and text.startswith(")", i):
                depth -= 1
                i = (_ALL_SPACE if depth else _SPACE).match(text, i + 1).end()
            if join := _JOIN.match(text, i):
                i = _ALL_SPACE.match(text, join.end()).end()
            elif (other := _OTHERWISE.match(text, i)) and (other[0] != "," or depth):
                self._bind(at, targets, terms)
                terms, i = [], _ALL_SPACE.match(text, other.end()).end()
            elif not (text[i : i + 1] in _BODY and text[i : i + 1]):
                break
        if found or any(isinstance(t, tuple) for t in terms):
            self._bind(at, targets, terms)
        elif kind != "(" and len(terms) < 2 and (bare := _BARE.match(text, start)):
            # a word without quotes: a constant's name, or the value itself
            whole = bare.end() == len(text) or text[bare.end()] in "\n\r,;" or kind == "--" or start == at
            self._bind(at, targets, terms, bare=True)
            if whole and not text.startswith("(", bare.end()):
                self.bindings.append(Binding(at, targets, [bare.span()], True))
        elif terms:
            self._bind(at, targets, terms)

    def _bind(self, at: int, targets: list[str], terms: list[Part | str], bare: bool = False) -> None:
        if terms:
            self.bindings.append(Binding(at, targets, terms, bare))


def _plain(name: str) -> str:
    """A name without the signs that mark it as one: $name, ${name}, @name."""
    return name.lstrip("$@{").rstrip("}")


def subwords(name: str) -> list[str]:
    return [w.lower() for w in _SUBWORD.findall(name)]


def name_score(name: str) -> float:
    """How sensitive a name is, from 0 to 1."""
    words = subwords(name)
    both = [f"{a} {b}" for a, b in zip(words, words[1:])] + [a + b for a, b in zip(words, words[1:])]
    most = max((SENSITIVE.get(w, 0.0) for w in words + both), default=0.0)
    return most * (0.3 if words and words[-1] in ABOUT else 1.0)


def value_score(value: str, bare: bool) -> float:
    """How much a value looks like one that somebody keeps secret, from 0 to 1."""
    n = len(value)
    if n < 6 or _PLACEHOLDER.fullmatch(value):
        return 0.0
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values()) * n
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    score = 0.6 + 0.4 * min(1.0, bits / 48)
    if bare and not mixed:
        score *= 0.4
    if re.search(r"[ \t]", value):
        score *= 0.5
    if re.search(r"://|^[./~]|^\w+\.\w+$|\.(?:py|js|json|ya?ml|txt|pem|html?)$", value):
        score *= 0.5
    return score


def literals(text: str, threshold: float = 0.55) -> list[tuple[int, int, str, float]]:
    """(start, end, name, score) of the literals that end up in a sensitive name; of several names, the most sensitive."""
    bindings = Reader(text).read()
    if not bindings:
        return []
    last: dict[str, Binding] = {}
    for b in bindings:
        if not b.bare:
            for name in b.targets:
                last[name] = b
    seen: dict[str, tuple[str, list[Part]]] = {}
    best: dict[Part, tuple[str, float]] = {}

    def named(name: str, busy: frozenset) -> tuple[str, list[Part]]:
        if name in seen:
            return seen[name]
        if name in busy or name not in last:
            return "", []
        return valued(last[name].terms, busy | {name})

    def valued(terms: list[Part | str], busy: frozenset) -> tuple[str, list[Part]]:
        said, parts = "", []
        for t in terms:
            if isinstance(t, tuple):
                own, more = text[t[0] : t[1]], [t]
                rest = own
                if len(busy) < 16 and ("{" in own or "$" in own or "%" in own):
                    for hole in list(_HOLE.finditer(own))[:MOST_PARTS]:
                        value, inner = named(next(g for g in hole.groups() if g), busy)
                        if value:
                            own, rest, more = own.replace(hole[0], value), rest.replace(hole[0], ""), more + inner
                    if len(more) > 1 and _NOTHING.fullmatch(rest):
                        more = more[1:]  # nothing of its own
            else:
                own, more = named(t, busy) if len(busy) < 16 else ("", [])
            said, parts = said + own, parts + more
            if len(parts) > MOST_PARTS or len(said) > 1 << 16:
                return text[terms[0][0] : terms[0][1]] if isinstance(terms[0], tuple) else "", parts[:1]
        return said, parts

    for b in bindings:
        said, parts = valued(b.terms, frozenset(b.targets))
        if parts and not (b.bare and isinstance(b.terms[0], tuple) and text[b.terms[0][0] : b.terms[0][1]] in last):
            name, much = max(((n, name_score(n)) for n in b.targets), key=lambda x: x[1])
            if much:
                if scheme := _SCHEME.match(said):
                    said = said[scheme.end() :]
                    parts = [(parts[0][0] + scheme.end(), parts[0][1])] if len(parts) == 1 and _SCHEME.match(text[parts[0][0] : parts[0][1]]) else parts
                score = much * value_score(said, b.bare)
                if score >= threshold:
                    for p in parts:
                        if p[0] < p[1] and best.get(p, ("", 0.0))[1] < score:
                            best[p] = (name, round(score, 4))
        if not b.bare or isinstance(b.terms[0], tuple):
            for name in b.targets:
                seen[name] = (said, parts)
    return [(*p, *best[p]) for p in sorted(best)]


def find(text: str, threshold: float = 0.55) -> list[tuple[str, int, int, str | None, float]]:
    """All findings of a text by start, then kind: (kind, start, end, name or None, score)."""
    base = [("assign", *m.span(), m[1], 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [("access", *m.span(), None, 1.0) for m in _ACCESS.finditer(text)]
    base += [("hex", *m.span(), None, 1.0) for m in _HEX.finditer(text)]
    base.sort(key=lambda f: f[1])
    more, k, reach = [], 0, -1
    for start, end, name, score in literals(text, threshold):
        while k < len(base) and base[k][1] <= start:
            reach = max(reach, base[k][2])
            k += 1
        if end > reach:
            more.append(("literal", start, end, name, score))
    return sorted(base + more, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


_FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])
_FIELDS = [f.name for f in _FINDING]
FINDINGS = "array<struct<kind:string,start:bigint,end:bigint,name:string,score:double>>"


def scan(docs: DataFrame, *, keep: list[str] | None = None, threshold: float = 0.55) -> DataFrame:
    """docs: text. Adds ``findings`` to the columns of ``keep``."""
    keep = without(keep if keep is not None else [c for c in docs.columns if c != "text"], ("findings",))
    schema = T.StructType([docs.schema[c] for c in keep] + [*T.StructType.fromDDL(f"findings {FINDINGS}")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows = [[dict(zip(_FIELDS, f, strict=True)) for f in find(t or "", threshold)] for t in rb.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(c) for c in keep] + [pa.array(rows, pa.list_(_FINDING))], names=[*keep, "findings"])

    return in_batches(docs).select(*[docs[c] for c in keep], docs["text"].alias("__text")).mapInArrow(run, schema)


def joined(findings: Column) -> Column:
    """kind:start:end of all, with commas."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda f: f["kind"] == kind


def digests(found: DataFrame, keep: list[str]) -> DataFrame:
    base = F.filter("findings", lambda f: f["kind"] != "literal")
    counts = [F.size(F.filter("findings", _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    return found.select(*keep, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
