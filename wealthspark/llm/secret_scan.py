"""Secrets in texts: three written forms, and strings of high sliding-window entropy."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices

KINDS = ("assign", "access", "hex", "entropy")
#: The written forms.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Every hex or access form lies inside one of these runs.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Least bits per character in some window, by the characters that the candidate uses.
LEAST_BITS = {"hex": 3.0, "alphanumeric": 3.7, "base64": 3.7, "letters": 4.0}
#: What looks random but is known to be harmless: identifiers, numbers, paths, words joined by marks. No part can match one text in two
#: ways, so each takes time in proportion to the candidate.
ALLOWED = re.compile(
    r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"
    r"|[0-9+/_=-]+"
    r"|[A-Za-z]+(?:[-_/=+]+[A-Za-z]+)*[0-9]{0,4}"
    r"|(?:[A-Za-z]{1,15}[0-9]{0,2}[-_/=+]+){2,}[A-Za-z]{0,15}[0-9]{0,4}"
)
#: Strings whose presence marks a placeholder.
PLACEHOLDERS = ("example", "placeholder", "xxxxxx", "000000", "123456789", "abcdefgh")
_PART = [0.0] + [n / WINDOW * math.log2(WINDOW / n) for n in range(1, WINDOW + 1)]


def character_class(text: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        return "hex"
    if text.isalpha():
        return "letters"
    return "alphanumeric" if text.isalnum() else "base64"


def most_entropy(text: str, window: int = WINDOW) -> float:
    """The largest Shannon entropy of ``window`` neighbouring characters; counts change by one character a step."""
    counts: dict[str, int] = {}
    bits = most = 0.0
    for k, c in enumerate(text):
        if k >= window:
            n = counts[text[k - window]]
            counts[text[k - window]] = n - 1
            bits += _PART[n - 1] - _PART[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        bits += _PART[n + 1] - _PART[n]
        if k >= window - 1 and bits > most:
            most = bits
    return most


def looks_random(text: str) -> bool:
    """Mixed digits and letters (or often changing case), not on the allow-list, one window above its class's bits."""
    kind = character_class(text)
    if kind == "letters":
        if text.isupper() or text.islower() or sum(a.islower() and b.isupper() for a, b in zip(text, text[1:])) < 4:
            return False
    elif not (re.search("[0-9]", text) and re.search("[A-Za-z]", text)) or ALLOWED.fullmatch(text):
        return False
    low = text.lower()
    if any(p in low for p in PLACEHOLDERS):
        return False
    return most_entropy(text) >= LEAST_BITS[kind]


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in order; offsets in code points. Entropy judges every candidate, also those in or around a written form."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    runs = [(m.start(), m.end()) for m in CANDIDATE.finditer(text)]
    for start, end in runs:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, start, end)]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, start, end)]
    for start, end in runs:
        if looks_random(text[start:end]):
            out.append((start, 3, end))
    return sorted(out)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every stretch of spans that touch or overlap becomes one mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id and ``spans``, an array of (kind, start, end) by start, then kind; offsets in code points, end exclusive.

    Null text counts as empty; empty texts have no spans; texts of any length are scanned whole. A null id
    is kept; repeated rows give repeated rows; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            for ids, texts in slices(batch.column(0), batch.column(1)):
                spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t)] for t in texts]
                yield pa.record_batch([ids, pa.array(spans, pa.list_(span))], ["id", "spans"])

    kind = docs.schema[id].dataType.simpleString()
    out = docs.select(F.col(id), F.col(text).cast("string")).mapInArrow(work, f"id {kind}, spans array<struct<kind:string,start:int,end:int>>")
    return out.withColumnRenamed("id", id)


def written_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with all its columns; each secret in ``text`` replaced by ``[SECRET]`` and ``n_chars`` (if there) counted anew.

    Rows without a secret, null texts among them, stay as they are.
    """
    at = docs.columns.index(text)
    counted = docs.columns.index(n_chars) if n_chars in docs.columns else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, at):
                texts = part.column(at).to_pylist()
                new = [redact(t, spans) if t and (spans := find(t)) else t for t in texts]
                columns = list(part.columns)
                columns[at] = pa.array(new, pa.string())
                if counted is not None:
                    same = part.column(counted).to_pylist()
                    columns[counted] = pa.array([len(b) if a is not b else n for a, b, n in zip(texts, new, same)], part.schema.field(counted).type)
                yield pa.record_batch(columns, names=part.schema.names)

    names = [f"c{k}" for k in range(len(docs.columns))]  # clashing names do not matter inside
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))
    return docs.toDF(*names).mapInArrow(work, schema).toDF(*docs.columns)


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    start = 0
    for ids, _ in slices(batch.column(at), batch.column(at)):
        yield batch.slice(start, len(ids))
        start += len(ids)
