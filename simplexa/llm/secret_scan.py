"""Secrets by assignment-aware lexing.

A lexer reads source and configuration syntax out of free text.  Three rules yield
the base kinds: ``assign`` (a sensitive target name, an assignment sign, a value),
``access`` and ``hex`` (token shapes).  A fourth rule reads every assignment
(``name = "literal"``, ``"name": 'literal'``, ``name: Type = "literal"``, ``NAME=literal``, ``a = b``,
``name = f("literal")``, ``set name "literal"``, ``<name>literal</name>``, the first line of a block scalar; literals with
prefixes, in triple quotes or backticks, or joined by plus) into name-literal and name-name pairs.  Names bound to names are resolved to the literals
bound to them there (constant propagation in the order of the text), and every literal is scored by how sensitive the
names that reach it are and by its own randomness.  Literals that score at least
``threshold`` and overlap no base span are added as ``literal``, or as ``constant``
where only propagation makes them sensitive.

Base rules keep leftmost non-overlapping matches per kind; matches that are too short
are dropped after matching, so that they still use up their text.  A span is the whole
match (of an added kind: the literal), in code points, end exclusive.

Cases: a null text counts as empty and has no spans; texts are read whole; repeated
rows give repeated results; a null doc_id is kept; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplexa.llm.common import small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "literal", "constant")

NAME = r"[A-Za-z_][A-Za-z0-9_.-]*+"
#: A string literal of up to two prefix letters; the innermost matched group is its content.
QUOTED = r"""(?:[bfruBFRU]{0,2}+(?:\"{3}((?:[^"\\]|\\.|"(?!""))*+)\"{3}|'{3}((?:[^'\\]|\\.|'(?!''))*+)'{3}|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)')|`((?:[^`\\\n]|\\.)*+)`)"""
ANNOTATION = r"(?:[ \t]*+:[ \t]*+[A-Za-z_][A-Za-z0-9_.<>\[\]?|]*+(?=[ \t]*+=))?"
ARGUMENTS = r"[^()\n]*+(?:\([^()\n]*+\)[^()\n]*+)*+"
#: An assignment (a name, perhaps in parentheses or with a type; a sign; then literals joined by plus, a call, the first
#: line of a block scalar, or a bare token that is not the beginning of an expression), a setting without a sign, or an
#: element around a literal.  Names and blanks are of any length and possessive, so that the search stays linear.
PAIR = re.compile(
    rf"""(?<![A-Za-z0-9_.-])(?P<name>{NAME})["'`]?\)?{ANNOTATION}[ \t]*+(?::=|=>|[:=])[ \t]*+(?:(?P<quoted>{QUOTED}(?:[ \t]*+[+][ \t]*+{QUOTED})*+)|(?:new[ \t]++)?(?P<call>{NAME})\((?P<args>{ARGUMENTS})\)|[|>][+-]?[ \t]*+\n[ \t]++(?P<block>[^\s]++)|(?P<bare>[A-Za-z0-9+/_.=!@#%^&*~$-]++)(?![(\[{{]))"""
    rf"""|(?<![A-Za-z0-9_.-])set[ \t]++(?P<setting>{NAME})[ \t]++(?P<value>{QUOTED})"""
    rf"""|<(?P<element>{NAME})(?:[ \t][^<>\n]*+)?>[ \t]*+(?P<inner>[^<>\s]++)[ \t]*+</""",
    re.ASCII | re.DOTALL,
)
STRING = re.compile(QUOTED, re.ASCII | re.DOTALL)
#: What lies between two joined literals.
JOINT = re.compile(r"""["'`][ \t]*[+][ \t]*[bfruBFRU]{0,2}["'`]""")
#: Calls that fetch a value under the name they are given.
LOOKUP = re.compile(r"(?i)(?:env|get|lookup|read|input|prompt|fetch)[A-Za-z0-9_]*\Z", re.ASCII)
IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*\Z", re.ASCII)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: How strongly a word of a target name tells of a secret.
SENSITIVE = {"password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "pass": 2.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5, "private": 1.5, "auth": 1.5, "bearer": 2.0, "signing": 1.0, "encryption": 1.0, "access": 1.0, "api": 1.0, "key": 1.5}
PLACEHOLDER = re.compile(r"(?i)\A(?:x+|\*+|\.+|change_?me|example|placeholder|your[_-].*|none|null|true|false|todo|test)\Z")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def name_score(name: str) -> float:
    return sum(SENSITIVE.get(w.lower(), 0.0) for w in WORDS.findall(name))


def literal_score(value: str) -> float:
    """Bits a character, more for mixed classes, nothing for placeholders and phrases."""
    n = len(value)
    if n < 8 or PLACEHOLDER.match(value) or " " in value or value.startswith("$"):
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return bits * min(1.0, n / 16) + 0.5 * (classes - 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _content(text: str, start: int, end: int) -> tuple[int, int]:
    """From the first to the last character inside the literals that a value is made of."""
    found = list(STRING.finditer(text, start, end))
    return found[0].start(found[0].lastindex), found[-1].end(found[-1].lastindex)


def lexed(text: str) -> list[tuple[str, int, int, bool]]:
    """(name, start and end of the value, literal for certain) of every assignment, call argument and element."""
    pairs = []
    for m in PAIR.finditer(text):
        if m["element"] is not None:
            pairs.append((m["element"], *m.span("inner"), True))
        elif m["setting"] is not None:
            pairs.append((m["setting"], *_content(text, *m.span("value")), True))
        elif m["quoted"] is not None:
            pairs.append((m["name"], *_content(text, *m.span("quoted")), True))
        elif m["call"] is not None:
            own = not LOOKUP.search(m["call"])  # what is looked up by a name is no secret
            pairs += [(m["name"], *q.span(q.lastindex), True) for q in STRING.finditer(text, *m.span("args")) if own]
        else:
            which = "block" if m["block"] is not None else "bare"
            pairs.append((m["name"], *m.span(which), which == "block"))
    return pairs


def reached(text: str, pairs: list[tuple[str, int, int, bool]]) -> dict[int, float]:
    """The greatest sensitivity that reaches each binding through names bound to its name.

    A name stands for its latest binding before, or, where there is none, its first behind.
    """
    bound: dict[str, list[int]] = {}
    for i, (name, *_) in enumerate(pairs):
        bound.setdefault(name, []).append(i)

    def target(i: int) -> int | None:
        name, a, b, literal = pairs[i]
        if literal or not IDENT.match(value := text[a:b]) or value == name or not (at := bound.get(value)):
            return None
        k = bisect_left(at, i)
        return at[k - 1] if k else at[0]

    best: dict[int, float] = {}
    follow = [(score, i) for i, (name, *_) in enumerate(pairs) if (score := name_score(name)) > 0]
    for score, i in follow:  # grows while names lead on
        t = target(i)
        if t is not None and score > best.get(t, 0.0):
            best[t] = score
            follow.append((score, t))
    return best


def added_spans(text: str, base: list[tuple[int, int, int]], threshold: float) -> list[tuple[int, int, int]]:
    if "=" not in text and ":" not in text and "</" not in text and "set" not in text:
        return []
    pairs = lexed(text)
    if not pairs:
        return []
    reach = reached(text, pairs)
    spans: dict[tuple[int, int], tuple[float, float]] = {}
    for i, (name, a, b, _) in enumerate(pairs):
        own, far = spans.get((a, b), (0.0, 0.0))
        spans[a, b] = max(own, name_score(name)), max(far, reach.get(i, 0.0))
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    found = []
    for (a, b), (own, far) in sorted(spans.items()):
        if max(own, far) <= 0 or (value := literal_score(JOINT.sub("", text[a:b]))) <= 0 or max(own, far) + value < threshold:
            continue
        before = bisect_left(starts, b)  # base spans that start before the end
        if before and ends[before - 1] > a:
            continue
        found.append((a, 3 if own >= far else 4, b))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, *, threshold: float = 5.0) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                counts = Counter(k for _, k, _ in base)
                every = sorted(base + added_spans(text, base, threshold))
                for column, value in zip(out, (counts[0], counts[1], counts[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
