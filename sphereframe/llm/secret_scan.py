"""Secret scans: fixed credential patterns, and a guess-cost dynamic program for values in credential context."""
from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, map_rows
from .long_words import LONG_WORDS

KINDS = ("assign", "access", "hex", "guess")
MIN_LOG10_GUESSES = 10.0
RESULT = ("doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, "
          "found array<struct<kind:string,start:bigint,end:bigint,log10_guesses:double>>")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
# Wider than ASSIGN: more names of credentials, and values with any printable characters.  The names of ASSIGN may end any
# word, as there; the others begin a word or a camel-case part (dbPwd, but not spin).  A quoted value reaches to its closing
# quote: as far as it goes without a blank, as a phrase within one line and PHRASE characters (longer quotations are prose).
# After a quote that doesn't close so, and without one, the value ends at white space.
PHRASE = 256
CONTEXT = re.compile(r"""(?:password|passwd|secret|token|api_?key|"""
                     r"""(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])))"""
                     r"""(?:pass(?:phrase|code)?|pwd|pin|credentials?|bearer|auth|(?:api|access|private|secret|auth)[_-]?key))"""
                     r"""["']?(?:\x20*[:=]\x20*|\x20+is\x20+)"""
                     r"""(?:"([^"\s]{6,})"|'([^'\s]{6,})'|"([^"\r\n]{6,%d})"|'([^'\r\n]{6,%d})'|"""
                     r"""["']([^\s"']{6,})|([^\s"']\S{5,}))""" % (PHRASE, PHRASE), re.ASCII | re.IGNORECASE)
NAME_SPAN = 32  # longer than any name with its separator, so a context that a value's end begins is found
HINTS = ("pass", "pwd", "pin", "secret", "token", "cred", "bearer", "auth", "key")

# Words that attackers try first, from most to least used.
COMMON_WORDS = ("password admin user root guest welcome login master secret letmein changeme default test demo example "
                "sample dummy placeholder dragon monkey shadow sunshine princess football baseball superman batman "
                "iloveyou trustno hello freedom whatever ninja access system server service database public private "
                "manager office home work summer winter spring autumn monday friday january october love pass word "
                "your my the this that is not none null true false token key api value string here insert replace "
                "redacted hidden unknown").split()
KEYBOARD_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@83!10$57+", "aabeiiosstt")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:0?[1-9]|[12]\d|3[01])|"
                  r"(?:0?[1-9]|[12]\d|3[01])[-/.]?(?:0?[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d", re.ASCII)
REPEAT, PIECE = 64, 0.3  # longest repeated block; log10 of the choice of a kind of piece
LOG_DATE, LOG_YEAR = math.log10(365 * 120), math.log10(120)

_RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys(COMMON_WORDS + LONG_WORDS))}
_LONGEST = max(map(len, _RANK))
_NEXT = {(a, b) for row in KEYBOARD_ROWS for a, b in [*zip(row, row[1:]), *zip(row[1:], row)]}
_NEXT |= {(a, b) for up, low in zip(KEYBOARD_ROWS, KEYBOARD_ROWS[1:]) for a, b in [*zip(up[1:], low), *zip(low, up[1:])]}


def _alphabet(c: str) -> float:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100


def _segments(value: str) -> list[tuple[int, int, float]]:
    """Spans with a cheaper description than brute force: (start, end, log10 of the guesses)."""
    low, n, out = value.lower(), len(value), []
    plain = low.translate(LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            for text, extra in ((low[i:j], 0.0), (plain[i:j], math.log10(4))):
                if text in _RANK:
                    upper = 0.0 if value[i:j] == low[i:j] else math.log10(2 if value[i].isupper() else 4)
                    out.append((i, j, math.log10(_RANK[text]) + upper + extra))
                    break
        m = DATE.match(value, i)
        if m:
            out.append((i, m.end(), LOG_YEAR if m.end() - i == 4 else LOG_DATE))
    walk = 0
    for i in range(1, n + 1):  # maximal runs of neighbouring keys
        if i == n or (low[i - 1], low[i]) not in _NEXT:
            if i - walk >= 3:
                out.append((walk, i, math.log10(len("".join(KEYBOARD_ROWS)) * 4.0) + 0.3 * (i - walk)))
            walk = i
    return out


def log10_guesses(value: str) -> float:
    """Least log10 number of guesses over all segmentations of ``value``.

    Pieces are words, dates, keyboard walks, repeats of a piece of up to ``REPEAT`` characters, and brute-force spans.
    """
    n = len(value)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, cost in _segments(value):
        ends[j].append((i, cost))
    best = [0.0] * (n + 1)
    same = [0] * (REPEAT + 1)  # by distance: how many characters up to here equal those so far before
    for j in range(1, n + 1):
        best[j] = best[j - 1] + math.log10(_alphabet(value[j - 1]))  # one more brute-force character
        for i, cost in ends[j]:
            best[j] = min(best[j], best[i] + cost + PIECE)
        for size in range(1, min(j - 1, REPEAT) + 1):
            same[size] = same[size] + 1 if value[j - 1] == value[j - 1 - size] else 0
            if same[size] >= size:  # the block repeats: only the number of copies is to be guessed
                copies = same[size] // size + 1
                best[j] = min(best[j], best[j - (copies - 1) * size] + math.log10(copies) + PIECE)
    return best[n]


def _values(text: str) -> Iterator[tuple[int, str]]:
    """Start and text of every value in credential context; none begins inside another one."""
    at = done = 0
    while m := CONTEXT.search(text, at):
        k = m.lastindex
        start, end = m.span(k)
        if start >= done:
            yield start, m[k].rstrip(".,;:!?)") if k > 4 else m[k]
            done = end
        at = max(m.start() + 1, start, end - NAME_SPAN)  # a value may itself be the name of the next: "password: secret: x"


def find(text: str, least: float = MIN_LOG10_GUESSES) -> list[tuple[int, int, int, float | None]]:
    """(start, kind number, end, log10 guesses) in ascending order; no guess span lies inside a fixed one."""
    found = []
    low = text.lower()
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    if (":" in text or "=" in text or " is " in low) and any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end(), log10_guesses(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        taken = sorted((s, e) for s, _, e, _ in found)
        for start, value in _values(text):
            end = start + len(value)
            if len(value) < 6 or any(s <= start and end <= e for s, e in taken):
                continue
            if (cost := log10_guesses(value)) >= least:
                found.append((start, 3, end, cost))
    return sorted(found, key=lambda x: x[:3])


def _row(least):
    def row(doc_id, text):
        got = find(text, least)
        n = [sum(k == i for _, k, _, _ in got) for i in range(3)]
        return doc_id, *n, [{"kind": KINDS[k], "start": s, "end": e, "log10_guesses": c} for s, k, e, c in got]
    return row


def scan(docs: DataFrame, least: float = MIN_LOG10_GUESSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in whole texts: one row for each row of ``docs``, one narrow pass.

    ``found`` lists spans by start, then kind: ``assign``, ``access`` and ``hex`` by their fixed patterns (leftmost,
    non-overlapping within a kind), and ``guess``: values in credential context whose cheapest segmentation takes at
    least ``10^least`` guesses and that reach beyond every fixed span.  Offsets are code points.  A null or empty text has no
    span; repeated rows each give a row; other columns are not read.
    """
    return map_rows(id_and_text(docs, id_col, text_col), lambda: _row(least), RESULT)


def digests(found: DataFrame) -> DataFrame:
    """The digest columns of ``scan``: base spans hashed, all spans as text."""
    def make():
        def row(doc_id, a, b, c, spans):
            text = [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans or []]
            base = ",".join(t for t in text if not t.startswith("guess"))
            return doc_id, a, b, c, hashlib.sha256(base.encode()).hexdigest(), ",".join(text)
        return row
    return map_rows(found, make, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
                                 "spans string")


def mask(text: str | None, least: float = MIN_LOG10_GUESSES, by: str = "[SECRET]") -> str | None:
    """The text with every found span replaced; overlapping spans become one."""
    got = find(text, least) if text else []
    if not got:
        return text
    out, at = [], 0
    for start, _, end, _ in got:
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, least: float = MIN_LOG10_GUESSES, text_col: str = "text",
           length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs`` with the secrets of the text masked; ``length_col`` follows a changed text."""
    names = docs.columns

    def run(batches):
        for batch in batches:
            k = names.index(text_col)
            old = batch.column(k)
            new = [mask(old[i].as_py(), least) for i in range(batch.num_rows)]
            columns = list(batch.columns)
            if length_col in names:
                j = names.index(length_col)
                size = columns[j]
                columns[j] = pa.array([size[i].as_py() if t is None or t == old[i].as_py() else len(t)
                                       for i, t in enumerate(new)], type=size.type)
            columns[k] = pa.array(new, type=old.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
    return docs.mapInArrow(run, docs.schema)
