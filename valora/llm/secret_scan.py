"""Secret scan by assignment-aware lexing.

Three base patterns find what looks like a secret wherever it stands.  Beside
them a lexer reads the text as source or configuration: it takes
``name = literal`` pairs (``=``, ``:=``, ``:``, ``=>``; quoted or bare; JSON,
YAML, INI, shell, code), keeps constants (``name`` to its literal) and follows
them (``password = NAME``, ``"a" + "b"``, ``${NAME}``).  A literal scores by how
sensitive the names are that it reaches and by how random it looks; one at or
above the threshold is a span of its own, where the literal stands, unless a
base span holds it already.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal")

#: The base patterns.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")

#: How sensitive a target name is, by the words in it (the highest counts).
_NAMES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 0.9, "authkey": 0.9, "signingkey": 0.9,
    "encryptionkey": 0.9, "connectionstring": 0.8, "bearer": 0.8, "auth": 0.7, "authorization": 0.8,
}
_SENSITIVE = re.compile("|".join(sorted(_NAMES, key=len, reverse=True)))
#: Literals that stand for a value.
_PLACEHOLDER = re.compile(
    r"(?i)^(?:changeme|change_me|example|sample|dummy|placeholder|redacted|none|null|undefined|true|false|"
    r"your[-_ ].*|<.*>|x+|\*+|\.+|-+|_+|0+)$")

#: Target name, operator and the right side up to the end of its line.
_PAIR = re.compile(
    r"""(?<![\w$.-])["']?([A-Za-z_][\w.-]*+)["']?[ \t]*(?:=>|:=|[:=](?![=:]))[ \t]*(?=["'$\w+/-])""", re.A)
_PART = re.compile(
    r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|\$\{?([A-Za-z_]\w*)\}?|([A-Za-z0-9+/_.=-]+))""", re.A)
_PLUS = re.compile(r"[ \t]*\+(?=[ \t]*[\"'$A-Za-z_])")
_NAME = re.compile(r"[A-Za-z_]\w*\Z", re.A)


def name_weight(name: str) -> float:
    """The sensitivity of a target name: 0 to 1."""
    flat = re.sub(r"[^a-z0-9]", "", name.lower())
    return max((_NAMES[m] for m in _SENSITIVE.findall(flat)), default=0.0)


def literal_weight(value: str) -> float:
    """How much a literal looks like a secret: 0 to 1, by length, variety and
    kinds of characters; placeholders and plain words are low."""
    if len(value) < 8 or _PLACEHOLDER.match(value) or value.count(" ") > 2:
        return 0.0
    counts = Counter(value)
    n = sum(counts.values())
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9 ]"))
    return min(1.0, bits / 4) * (0.5, 0.5, 0.8, 1.0, 1.0)[kinds]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping in
    each kind; matches that are too short are dropped after they matched."""
    spans = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(spans)


#: A run of 32 or more is the same match as a run of any length that has 32.
_LONG_HEX = re.compile(_HEX.pattern[:-1] + "{32,}")


def assignments(text: str) -> list[tuple[str, list[tuple[int, int]], list[str]]]:
    """(name, literals as (start, end), names used) of each assignment in turn."""
    out = []
    for m in _PAIR.finditer(text):
        literals: list[tuple[int, int]] = []
        names: list[str] = []
        at = m.end()
        while part := _PART.match(text, at):
            for g in (1, 2):
                if part[g] is not None:
                    literals.append(part.span(g))
            if part[3]:
                names.append(part[3])
            elif part[4]:
                if _NAME.match(part[4]):
                    names.append(part[4])
                literals.append(part.span(4))
            at = part.end()
            plus = _PLUS.match(text, at)
            if not plus:
                break
            at = plus.end()
        if literals or names:
            out.append((m[1], literals, names))
    return out


def literal_spans(text: str, threshold: float) -> list[tuple[int, int]]:
    """Literals that reach a sensitive name, itself or through constants.

    Each assignment is a node with its own literals and the nodes of the
    constants that it uses, so memory grows with the text; literals are gathered
    from sensitive names alone, each node once a walk."""
    if not may_score(text):
        return []
    constants: dict[str, int] = {}  # name: its latest node
    own: list[list[tuple[int, int]]] = []
    uses: list[list[int]] = []
    found: set[tuple[int, int]] = set()
    for node, (name, literals, names) in enumerate(assignments(text)):
        own.append([x for x in literals if text[x[0]:x[1]] not in constants])
        uses.append(list(dict.fromkeys(constants[n] for n in names if n in constants)))
        weight = name_weight(name)
        if weight:
            reach = _reach(node, own, uses)
            # the parts of a joined value score as the whole
            if weight * literal_weight("".join(text[b:e] for b, e in reach)) >= threshold:
                found.update(reach)
        constants[name] = node
    return sorted(found)


def _reach(node: int, own: list[list[tuple[int, int]]], uses: list[list[int]]) -> list[tuple[int, int]]:
    """The literals of a node and of all it uses, each once, in reading order."""
    out: dict[tuple[int, int], None] = {}
    seen: set[int] = set()
    todo = [node]
    while todo:
        at = todo.pop()
        if at not in seen:
            seen.add(at)
            out.update(dict.fromkeys(own[at]))
            todo += reversed(uses[at])
    return list(out)


_SENSITIVE_BYTES = re.compile(_SENSITIVE.pattern.encode())
_SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())


def may_score(text: str) -> bool:
    """False only where no name weighs anything: names are ASCII and weigh
    without separators, so a sensitive one stands in the text without them too."""
    return bool(_SENSITIVE_BYTES.search(text.encode("ascii", "ignore").lower().translate(None, _SEPARATORS)))


def scan(text: str | None, threshold: float = 0.45) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted: base spans and the literals beside them."""
    if not text:
        return []
    base = base_spans(text)
    spans = list(base)
    for b, e in literal_spans(text, threshold):
        if not any(x <= b and e <= y for x, _, y in base):
            spans.append((b, 3, e))
    return sorted(spans)


SPANS = "array<struct<start:long,kind:string,end:long>>"
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))


def scan_udf(threshold: float = 0.45):
    """Column function: text to its spans (code points, end exclusive)."""
    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[{"start": b, "kind": KINDS[k], "end": e} for b, k, e in scan(t.as_py(), threshold)]
                         for t in texts], _ARROW)
    return spans


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.45) -> DataFrame:
    """``id_col`` and ``spans`` of each row, by start and kind.  Null and blank
    texts have none; repeated rows keep one row each; a null id stays null; other
    columns aren't read; an empty table gives no rows."""
    return docs.select(F.col(f"`{id_col}`"), scan_udf(threshold)(F.col(f"`{text_col}`")).alias("spans"))


def mask(text: str | None, mark: str = "<SECRET>", threshold: float = 0.45) -> str | None:
    """``text`` with each secret replaced; overlapping spans become one."""
    spans = scan(text, threshold)
    if not spans:
        return text
    out: list[str] = []
    at = 0
    for b, _, e in spans:
        if b >= at:
            out += [text[at:b], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text", count_col: str | None = "n_chars",
                 threshold: float = 0.45) -> DataFrame:
    """``docs``, all columns and rows, with secrets in ``text_col`` replaced by
    ``<SECRET>`` and ``count_col``, if there is one, counted anew where a text
    changed."""
    @F.arrow_udf("struct<text:string,changed:boolean>")
    def masked(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            own = t.as_py()
            new = mask(own, threshold=threshold)
            rows.append({"text": new, "changed": new is not own and new != own})
        return pa.array(rows, pa.struct([("text", pa.string()), ("changed", pa.bool_())]))

    new = "__masked"
    while new in docs.columns:
        new += "_"
    out = docs.withColumn(new, masked(F.col(f"`{text_col}`")))
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col(f"{new}.text").alias(c))
        elif c == count_col:
            cols.append(F.when(F.col(f"{new}.changed"), F.length(f"{new}.text")).otherwise(F.col(f"`{c}`"))
                        .cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return out.select(*cols)
