"""Secret scans: fixed patterns, and literals judged by the names they are assigned to.

A text that mentions a sensitive name is lexed into assignments of source code and
configuration files (``name = "literal"``, ``name: literal``, ``"name" => 'literal'``,
``name: type = "literal"``, ``x["name"] = "literal"``, chained targets, concatenations).
Names stand for their last literal, or one that comes later, so ``k = "..."; password = k`` gives the literal
to ``password``. A literal is scored by the most sensitive name that it reaches and
by the entropy of its characters.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import struct_column
from lodestone.llm.text import free_name

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Parts of sensitive names, with their weight. A name is compared in lower case without - and _.
SENSITIVE = {
    "password": 0.95,
    "passwd": 0.95,
    "passphrase": 0.95,
    "pwd": 0.85,
    "secret": 0.95,
    "privatekey": 0.95,
    "apikey": 0.9,
    "accesskey": 0.9,
    "clientkey": 0.8,
    "signingkey": 0.9,
    "encryptionkey": 0.9,
    "token": 0.85,
    "credential": 0.85,
    "authkey": 0.85,
    "bearer": 0.8,
}
NAME_GATE = (
    b"passw", b"passphrase", b"pwd", b"secret", b"private_key", b"privatekey", b"private-key", b"apikey", b"api_key",
    b"api-key", b"access_key", b"accesskey", b"access-key", b"client_key", b"clientkey", b"signing_key", b"signingkey",
    b"encryption_key", b"encryptionkey", b"token", b"credential", b"auth_key", b"authkey", b"bearer",
)
PLACEHOLDER = re.compile(
    r"(?i)^(?:change_?me|example.*|your[_-].*|x{3,}|\*+|none|null|true|false|test|dummy|placeholder|redacted|\.{3,})$"
)
#: An optionally quoted or subscripted name, perhaps with a type, and an operator of assignment.
TARGET = re.compile(
    r"""(?:(?P<sub>\[)[ \t]*)?(?P<q>["'`]?)(?P<name>[A-Za-z_$][A-Za-z0-9_.\-]{0,127}(?<!-))(?P=q)(?(sub)[ \t]*\])
        (?:[ \t]*\??:[ \t]*(?P<type>[A-Za-z_][A-Za-z0-9_.]*(?:[\[<][A-Za-z0-9_., \t|\[\]<>]{0,128}[\]>])?(?:[ \t]*[|&][ \t]*[A-Za-z_][A-Za-z0-9_.\[\]]*)*)[ \t]*(?==(?![=~>])))?
        [ \t]*(?P<op>:=|=>|\+=|\?\?=|\|\|=|=(?![=~>])|:(?![:=]))[ \t]*""",
    re.VERBOSE | re.ASCII,
)
#: A quoted literal with an optional prefix.
QUOTED = re.compile(
    r"""(?:[A-Za-z]{1,2}(?=["']))?(?:"""
    r"""\"\"\"(?P<triple>(?:[^"\\]|\\.|"(?!""))*)\"\"\"|\'\'\'(?P<three>(?:[^'\\]|\\.|'(?!''))*)\'\'\'|"""
    r""""(?P<double>(?:[^"\\\n]|\\.)*)"|'(?P<single>(?:[^'\\\n]|\\.)*)'|`(?P<back>[^`\n]*)`)""",
    re.ASCII | re.DOTALL,
)
GROUPS = ("triple", "three", "double", "single", "back")
#: A bare literal: a name up to a plus, or else all up to a space, quote, bracket or mark of punctuation.
BARE = re.compile(
    r"""\$?[A-Za-z_][A-Za-z0-9_.]*(?=[+\s"'`,;(){}\[\]<>#]|\Z)|[^\s"'`,;(){}\[\]<>#]+""",
    re.ASCII,
)
#: Another operand behind a literal: the whole text is what the name holds.
PLUS = re.compile(r"[ \t]*(?:\\?\n[ \t]*)?(?:\+(?!=)|\.\.|\.(?=[ \t\"'$]))[ \t]*(?:\\?\n[ \t]*)?")
IDENTIFIER = re.compile(r"\$?\{?([A-Za-z_][A-Za-z0-9_.]*)\}?$", re.ASCII)
_HEX_AS_X = bytes(0x78 if c in b"0123456789abcdef" else 0x20 for c in range(256))


@dataclass(frozen=True)
class SecretRules:
    min_literal: int = 8
    min_score: float = 0.7


def entropy(literal: str) -> float:
    """Bits for each character."""
    n = len(literal)
    return -sum(c / n * math.log2(c / n) for c in Counter(literal).values()) if n else 0.0


def sensitivity(name: str) -> float:
    plain = name.lower().replace("_", "").replace("-", "")
    return max((weight for part, weight in SENSITIVE.items() if part in plain), default=0.0)


def literal_score(name_weight: float, literal: str) -> float:
    """Between 0 and 1: the name's weight, lessened for literals of few different characters."""
    return name_weight * min(1.0, 0.4 + 0.6 * entropy(literal) / 3.5)


@dataclass
class Operand:
    """A literal, or a bare token that may be another name."""

    start: int
    end: int
    literal: str
    quoted: bool


def assigns(text: str, target: re.Match) -> bool:
    """Whether the operator behind a bare token makes it a name: something follows, behind a space if it is a colon."""
    behind = text[target.end() : target.end() + 1]
    if not behind or behind in "\r\n":
        return False
    return target["op"] != ":" or target.end() > target.end("op") or behind in "\"'`"


def operands(text: str, at: int) -> tuple[list[Operand], int]:
    """The operands of a concatenation that starts at ``at``, and where scanning goes on."""
    found: list[Operand] = []
    while True:
        if (value := QUOTED.match(text, at)) is not None:
            group = next(g for g in GROUPS if value[g] is not None)
            found.append(Operand(*value.span(group), value[group], True))
        else:
            # Before the bare token is read: in a chain of names without spaces it reaches to the end of the chain.
            target = TARGET.match(text, at)
            if target is not None and assigns(text, target):
                return found, at  # a name with a value of its own
            if (value := BARE.match(text, at)) is None:
                return found, at
            literal = value[0].rstrip(".:!?")
            found.append(Operand(at, at + len(literal), literal, False))
        at = value.end()
        joined_on = PLUS.match(text, at)
        if joined_on is None:
            return found, at
        at = joined_on.end()


def assignments(text: str) -> list[tuple[str, list[Operand]]]:
    """(name, operands) of every assignment in order; chained targets share the operands."""
    made: list[tuple[str, list[Operand]]] = []
    waiting: list[str] = []
    at = 0
    while (target := TARGET.search(text, at)) is not None:
        if target.start() != at:
            waiting = []
        waiting.append(target["name"])
        if target["type"] and sensitivity(target["type"]):
            waiting.append(target["type"])  # ``config: db_password="..."`` looks like a type
        found, at = operands(text, target.end())
        if found:
            made += [(name, found) for name in waiting]
            waiting = []
        elif target["op"] == ":":
            waiting = []
        at = max(at, target.end())
    return made


def assigned_literals(text: str, rules: SecretRules) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that a sensitive name holds, directly or through other names.

    A name stands for what it was given last before its use, else for what it is given
    first behind it. All operands of a concatenation reach the name.
    """
    made = assignments(text)
    places: dict[str, list[int]] = {}
    for k, (name, _) in enumerate(made):
        places.setdefault(name, []).append(k)
    found: dict[tuple[int, int], float] = {}
    for k, (name, held) in enumerate(made):
        weight = sensitivity(name)
        if not weight:
            continue
        open_, seen = [(k, o) for o in held], {k}
        while open_:
            at, operand = open_.pop()
            reference = None if operand.quoted else IDENTIFIER.match(operand.literal)
            where = places.get(reference[1]) if reference else None
            if where:
                before = bisect_left(where, at)
                source = where[before - 1] if before else next((w for w in where if w != at), None)
                if source is not None and source not in seen:
                    seen.add(source)
                    open_ += [(source, o) for o in made[source][1]]
                continue
            literal = operand.literal
            if len(literal) < rules.min_literal or PLACEHOLDER.match(literal) or any(c.isspace() for c in literal):
                continue
            if not operand.quoted and not any(c.isdigit() for c in literal):
                continue  # an unquoted word without digits is prose or another name
            score = literal_score(weight, literal)
            if score >= rules.min_score:
                span = operand.start, operand.end
                found[span] = max(score, found.get(span, 0.0))
    return [(a, b, s) for (a, b), s in sorted(found.items())]


def secret_spans(raw: bytes, rules: SecretRules) -> list[tuple[int, int, int, float]]:
    """(start, end, kind number, score) in code points, by start, then kind."""
    low = raw.lower()
    has_assign = any(w in low for w in ASSIGN_WORDS)
    has_access = b"AKIA" in raw
    has_hex = b"x" * 24 in raw.translate(_HEX_AS_X)
    has_name = any(w in low for w in NAME_GATE)
    if not (has_assign or has_access or has_hex or has_name):
        return []
    text = raw.decode()
    spans: list[tuple[int, int, int, float]] = []
    if has_assign:
        spans += [(m.start(), m.end(), 0, 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if has_access:
        spans += [(m.start(), m.end(), 1, 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if has_hex:
        spans += [(m.start(), m.end(), 2, 1.0) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    if has_name:
        base = sorted(spans)
        starts = [s[0] for s in base]
        reach = list(accumulate((s[1] for s in base), max))  # the farthest end of this span and those before
        for a, b, score in assigned_literals(text, rules):
            before = bisect_right(starts, a)
            if not before or reach[before - 1] < b:
                spans.append((a, b, 3, score))
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def joined(spans: list[tuple[int, int, int, float]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, b, kind, _ in spans)


def scanned(texts: list[bytes], rules: SecretRules) -> list:
    columns: list[list] = [[] for _ in range(6)]
    for raw in texts:
        spans = secret_spans(raw, rules)
        counts = Counter(s[2] for s in spans)
        base = joined([s for s in spans if s[2] < 3]) if spans else ""
        for column, value in zip(
            columns,
            (counts[0], counts[1], counts[2], hashlib.sha256(base.encode()).hexdigest(), joined(spans),
             max((s[3] for s in spans), default=0.0)),
        ):
            column.append(value)
    return columns


FOUND = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, score double"


def with_secrets(docs: DataFrame, text: str = "text", rules: SecretRules | None = None) -> DataFrame:
    """Add counts by kind, the digest of the pattern spans, all spans and the highest score; no shuffle.

    Spans are ``kind:start:end`` in code points, end exclusive. Null texts are
    empty and have none. Columns named like a result are replaced; repeated rows
    are judged alike. Any text length works.
    """
    rules = rules or SecretRules()
    scan = struct_column(FOUND, lambda texts: scanned(texts, rules))
    names = [part.split()[0] for part in FOUND.split(", ")]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    made = free_name(docs, "found")
    return docs.select(*kept, scan(F.col(text)).alias(made)).select(*kept, *(F.col(made)[n].alias(n) for n in names))


def masked(texts: list[bytes], rules: SecretRules, mask: str) -> list:
    out = []
    for raw in texts:
        spans = secret_spans(raw, rules)
        if not spans:
            out.append(None)
            continue
        text, parts, at = raw.decode(), [], 0
        for a, b, _, _ in spans:
            if a >= at:
                parts += [text[at:a], mask]
            at = max(at, b)
        out.append("".join([*parts, text[at:]]))
    return [out]


def mask_secrets(
    docs: DataFrame, text: str = "text", n_chars: str = "n_chars", mask: str = "[SECRET]", rules: SecretRules | None = None
) -> DataFrame:
    """``docs`` with every secret replaced by ``mask``, and ``n_chars`` (if there) by the new length.

    Overlapping spans become one mask. Texts without secrets, and nulls, stay as they are.
    """
    rules = rules or SecretRules()
    change = struct_column("changed string", lambda texts: masked(texts, rules, mask))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    made = free_name(docs, "masked")
    changed = F.col(made)["changed"]
    new = docs.select(*columns, change(F.col(text)).alias(made))
    out = []
    for name in docs.columns:
        if name == text:
            out.append(F.coalesce(changed, F.col(text)).alias(text))
        elif name == n_chars:
            kind = docs.schema[n_chars].dataType
            out.append(F.when(changed.isNotNull(), F.length(changed).cast(kind)).otherwise(F.col(n_chars)).alias(n_chars))
        else:
            out.append(F.col(f"`{name}`"))
    return new.select(*out)
