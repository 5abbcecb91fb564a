"""Personal data: exact base patterns, and weak supervision for what they miss.

Base spans (email, ip, card, phone) are fixed patterns and always stay.  Beside
them, wider candidates are voted on by labelers of three kinds: regex (shape),
gazetteer (cue words) and context (surroundings, composition).
A vote pattern is one of few, so all documents are counted into a small table
of patterns; expectation-maximisation over that table estimates, for each kind,
how common true spans are and how reliable each labeler is when it speaks.
Its posteriors train the final span classifier, a logistic model over votes,
which decides on each candidate.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import textkit
from orrery.llm.shared import small_batches, whole_row

Span = tuple[int, int]

# The contract's patterns, in its order.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Further kinds, listed after the base kinds.
WIDE = {
    "secret": re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{12,}(?![A-Za-z0-9_/+-])"),
    "number": re.compile(r"(?<![\w+.@-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![\w@])"),
}
CUES = {
    "secret": re.compile(r"(?:password|passwd|pwd|token|secret|api[ _-]?key|credential|bearer|private[ _-]?key)\W{0,6}$", re.I),
    "number": re.compile(r"(?:phone|tel|telephone|mobile|fax|call|card|visa|account|iban|ssn|passport|nummer|teléfono|téléphone)\W{0,6}$", re.I),
}
_ASSIGNED = re.compile(r"[=:]\s*[\"']?$")
_HEX = re.compile(r"[0-9a-fA-F]+")
_DIGITS = frozenset("0123456789")
KINDS = [*BASE, *WIDE]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _valid(kind: str, found: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(p) <= 255 if len(p) < 5 else int(p.lstrip("0")[:4] or "0") <= 255 for p in found.split("."))
    digits = "".join(c for c in found if c in _DIGITS)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(rf"(?<![0-9]){BASE['ip'].pattern}")


def _emails(text: str) -> Iterator[Span]:
    """The matches of the email pattern, found from each at sign to both sides, so that long words without one cost nothing.

    The part before an at sign can't contain another one, so the leftmost start
    is the farthest one that the match before leaves.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> dict[str, list[Span]]:
    """Valid leftmost non-overlapping matches of each kind; a match that fails is dropped and not tried again.

    An ip can only start where a run of digits does: from further on in the
    run, the same characters follow.  So no kind reads a character more than a few times.
    """
    every = {"email": _emails(text), "ip": (m.span() for m in _QUAD.finditer(text)) if "." in text else ()}
    every |= {"card": (m.span() for m in BASE["card"].finditer(text)), "phone": (m.span() for m in BASE["phone"].finditer(text)) if "+" in text else ()}
    return {kind: [(s, e) for s, e in every[kind] if _valid(kind, text[s:e])] for kind in BASE}


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """1 for, -1 against, 0 silent: shape, cue word (gazetteer), assignment or brackets (context), composition."""
    found, before = text[start:end], text[max(0, start - 32) : start]
    digits = sum(c in _DIGITS for c in found)
    cue = 1 if CUES[kind].search(before) or (kind == "secret" and CUES[kind].search(_ASSIGNED.sub("", before).rstrip() + " ")) else 0
    if kind == "secret":
        shape = 1 if _HEX.fullmatch(found) else 0
        context = 1 if _ASSIGNED.search(before) else -1
        inside = 1 if digits and digits < len(found) and len(set(found)) >= 8 else -1
    else:
        shape = 1 if re.search(r"[\x20().-]", found) else 0
        context = 1 if before.endswith("\n") or text[end : end + 1] in ("\n", "") else 0
        inside = 1 if 7 <= digits <= 15 else -1
    return shape, cue, context, inside


def candidates(text: str, taken: list[Span]) -> Iterator[tuple[str, int, int]]:
    """Wide matches that touch no base span and no candidate of an earlier kind."""
    used = bytearray(len(text))
    for a, b in taken:
        used[a:b] = b"\1" * (b - a)
    for kind, pattern in WIDE.items():
        for m in pattern.finditer(text):
            s, e = m.span()
            if used.find(1, s, e) < 0:
                used[s:e] = b"\1" * (e - s)
                yield kind, s, e


def _rows_of_interest(column: pa.Array) -> np.ndarray:
    """Rows with a digit, an at sign, = or :; a candidate without digit and assignment has too many votes against it, so no other row can hold a span."""
    body, offsets = textkit.text_bytes(column)
    hit = np.concatenate([[0], np.cumsum(((body >= 0x30) & (body <= 0x3A)) | (body == 0x3D) | (body == 0x40))])
    return np.flatnonzero(np.diff(hit[offsets]))


def _count_votes(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            column = batch.column(text)
            for value in column:
                t = value.as_py() or ""
                for kind, s, e in candidates(t, [x for v in base_spans(t).values() for x in v]):
                    seen[kind, votes(kind, t, s, e)] += 1
        kinds, patterns = zip(*seen, strict=True) if seen else ((), ())
        yield pa.record_batch({"kind": pa.array(kinds, pa.string()), "votes": pa.array(patterns, pa.list_(pa.int32())), "n": pa.array(list(seen.values()), pa.int64())})

    return run


def estimate(patterns: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns: prior, P(vote | class) as classes x labelers x votes, posteriors of the patterns.

    The start takes the sum of votes for truth; a Beta-like smoothing of one
    vote keeps labelers that never speak neutral.
    """
    post = 1 / (1 + np.exp(-(patterns.sum(axis=1) - 1.5)))
    prior, given = 0.5, np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        for c, weight in ((1, post * n), (0, (1 - post) * n)):
            for v in range(3):
                given[c, :, v] = (weight[:, None] * (patterns == v - 1)).sum(axis=0) + 1
        given /= given.sum(axis=2, keepdims=True)
        prior = (float((post * n).sum()) + 1) / (float(n.sum()) + 2)
        at = np.arange(patterns.shape[1])
        like = [np.log(given[c][at, patterns + 1]).sum(axis=1) + np.log(p) for c, p in ((0, 1 - prior), (1, prior))]
        post = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
    return prior, given, post


def train(patterns: np.ndarray, n: np.ndarray, post: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic model over one-hot votes (and a constant), fitted to the posteriors by bounded Newton steps, so that rare patterns are fitted too."""
    x = _features(patterns)
    w, ridge = np.zeros(x.shape[1]), 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x.T * (p * (1 - p) * n)) @ x + ridge * np.eye(len(w)), x.T @ ((post - p) * n) - ridge * w)
        w += step * min(1, 2 / max(np.abs(step).max(), 1e-12))
    return w


def _features(patterns: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(patterns), 1)), *[(patterns == v).astype(float) for v in (-1, 1)]], axis=1)


def accepted(counted: list[tuple[str, list[int], int]]) -> frozenset[tuple[str, tuple[int, ...]]]:
    """The vote patterns that the classifier takes for personal data."""
    out = set()
    for kind in WIDE:
        rows = [(tuple(v), n) for k, v, n in counted if k == kind]
        if rows:
            patterns, n = np.array([v for v, _ in rows]), np.array([n for _, n in rows], float)
            _, _, post = estimate(patterns, n)
            good = _features(patterns) @ train(patterns, n, post) >= 0
            out |= {(kind, v) for (v, _), ok in zip(rows, good.tolist(), strict=True) if ok and sum(v) > 0}
    return frozenset(out)


def _find(good: frozenset, text: str, redact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            clean = {}
            for r in _rows_of_interest(column).tolist():
                t = column[r].as_py()
                base = base_spans(t)
                spans = [(kind, s, e, True) for kind, v in base.items() for s, e in v]
                spans += sorted((kind, s, e, False) for kind, s, e in candidates(t, [x for v in base.values() for x in v]) if (kind, votes(kind, t, s, e)) in good)
                spans.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
                found[r] = [{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in spans]
                if spans and redact:
                    clean[r] = masked(t, [x[:3] for x in spans])
            out = {c: batch.column(c) for c in batch.schema.names}
            if redact and clean:
                texts = column.to_pylist()
                for r, t in clean.items():
                    texts[r] = t
                out[text] = pa.array(texts, column.type)
            out["spans"] = pa.array(found, _SPANS)
            yield pa.record_batch(out)

    return run


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
_SPANS_SQL = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", redact: bool = False, carry: bool = False) -> DataFrame:
    """Per document: doc_id, text (masked with ``redact``), spans (kind, start, end, base), in code points, end exclusive.

    A null text has no spans and stays null.  Without any candidate there are
    base spans only.  Repeated rows each get a row, an empty table none.
    Columns beside the named ones are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*([whole_row(docs)] if carry else []), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    counted = rows.select("text").mapInArrow(_count_votes("text"), "kind string, votes array<int>, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").collect()
    good = accepted([tuple(r) for r in counted])
    return rows.mapInArrow(_find(good, "text", redact), rows.withColumn("spans", F.lit(None).cast(_SPANS_SQL)).schema)


def span_string(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
