"""Toxicity as a weighted finite-state pattern grammar.

A lexicon maps the words of a clause to classes.  Five small transducers read
these in series: negation marks insults and threats that follow a negation
within SCOPE words, reported speech those after a verb of saying, target those
in a clause that has addressed someone; insult and threat write an output by
the marks.  They are composed into one table (state, class) -> (state, output),
and a clause's outputs, not its single words, are what is scored.

The lexicon of insults is learned: words and word beginnings that stand in
many different surroundings in toxic training texts and in (nearly) none of
the others; an entry then has to hold up in all training texts.  Output weights
are a logistic regression on the same sample.
Training rows are a bounded sample, about SAMPLE_ROWS of each class and
SAMPLE_BYTES in all, chosen by a hash of their id; everything else reads all rows.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm import textkit
from orrery.llm.shared import settled, small_batches, whole_row

SAMPLE_ROWS, SAMPLE_BYTES = 1200, 32 << 20
SCOPE = 3
STEMS = (4, 5, 6)
#: Different surroundings in toxic sample texts that a lexicon entry needs.
SUPPORT = 4
#: Least share of an entry's surroundings that are toxic.
PURITY = 0.97
#: Pull of the output weights to their centre, and the highest log-odds of a text without any clause.
RIDGE, MOST_BIAS = 1e-3, -0.25

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
CLAIMS = (INSULT, THREAT)

# Closed-class words of the four languages.
CLOSED = {
    THREAT: "kill hurt beat destroy burn shoot töten schlagen vernichten tuer frapper brûler matar golpear quemar",
    TARGET: "you your he she they them du dich dir ihr euch tu te toi vous il elle tú ti usted vosotros él ella",
    NEGATION: "not no never nor without nicht kein keine nie niemals ohne ne pas jamais sans nunca jamás ni sin",
    REPORT: "said says told wrote claimed called quoted sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó",
}


class Symbol(NamedTuple):
    """What travels from one transducer to the next: a word's class and the marks that it has got."""

    kind: int
    mode: str = "asserted"
    targeted: bool = False


class Transducer(NamedTuple):
    """A finite-state machine: start state, and (state, symbol) -> (state, symbol or output name); states are tuples, () if there is but one."""

    start: tuple
    step: Callable[[tuple, Symbol], tuple[tuple, Symbol | str]]


def _negation(state: tuple, s: Symbol) -> tuple[tuple, Symbol]:
    """Marks what follows a negation within SCOPE words."""
    (left,) = state
    return ((SCOPE,) if s.kind == NEGATION else (max(left - 1, 0),)), (s._replace(mode="negated") if left and s.kind in CLAIMS else s)


def _reported_speech(state: tuple, s: Symbol) -> tuple[tuple, Symbol]:
    """Marks what follows a verb of saying, unless it is negated."""
    (open_,) = state
    return (open_ or s.kind == REPORT,), (s._replace(mode="reported") if open_ and s.kind in CLAIMS and s.mode == "asserted" else s)


def _target(state: tuple, s: Symbol) -> tuple[tuple, Symbol]:
    """Marks what follows someone who is addressed or spoken of."""
    (met,) = state
    return (met or s.kind == TARGET,), (s._replace(targeted=True) if met and s.kind in CLAIMS else s)


def _writer(kind: int, name: str) -> Transducer:
    """Writes an output for each symbol of a kind, by its marks, and lets others through."""
    return Transducer((), lambda state, s: (state, f"{name}_{'targeted' if s.targeted else 'plain'}_{s.mode}" if s.kind == kind else s))


CASCADE = (Transducer((0,), _negation), Transducer((False,), _reported_speech), Transducer((False,), _target), _writer(INSULT, "insult"), _writer(THREAT, "threat"))


def compose(machines: tuple[Transducer, ...] = CASCADE) -> tuple[dict[tuple, dict[int, tuple]], list[str]]:
    """The product of transducers that read each other's symbols: reachable state -> class -> (state, output number or None), and the outputs."""
    outputs = [f"{kind}_{to}_{mode}" for kind in ("insult", "threat") for to in ("plain", "targeted") for mode in ("asserted", "negated", "reported")]
    number = {n: i for i, n in enumerate(outputs)}
    flat = lambda states: tuple(itertools.chain.from_iterable(states))
    start = tuple(m.start for m in machines)
    table: dict[tuple, dict[int, tuple]] = {}
    waiting = [start]
    while waiting:
        states = waiting.pop()
        if flat(states) in table:
            continue
        row = table[flat(states)] = {}
        for kind in range(OTHER + 1):
            symbol, to = Symbol(kind), []
            for machine, state in zip(machines, states, strict=True):
                if isinstance(symbol, str):  # an output has been written: nothing is left to read
                    to.append(state)
                    continue
                after, symbol = machine.step(state, symbol)
                to.append(after)
            row[kind] = (flat(to), number[symbol] if isinstance(symbol, str) else None)
            waiting.append(tuple(to))
    return table, outputs


class Grammar:
    """Lexicon, machine and weights; small, so that it can be broadcast."""

    def __init__(self, words: set[bytes], stems: set[bytes]):
        self.table, self.outputs = compose()
        self.words, self.stems = words, stems
        self.closed = {w.encode(): c for c, line in CLOSED.items() for w in line.split()}
        threats = {w for w, c in self.closed.items() if c == THREAT}
        self.known = self._hashes(words | threats)
        self.known_stems = {n: self._hashes({s for s in stems if len(s) == n}) for n in STEMS}
        self.weights, self.bias = np.zeros(len(self.outputs)), -1.0

    @staticmethod
    def _hashes(words: set[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        # Whole words are hashed as the scan does it; spans make no difference to a hash.
        parts = sorted(words)
        body = np.frombuffer(b" ".join(parts), np.uint8)
        kit = textkit.Words(body, np.array([0, len(body)]), np.arange(256) != 0x20, False)
        return np.sort(kit.hashes())

    def symbol(self, word: bytes) -> int:
        if word in self.words or any(word[:n] in self.stems for n in STEMS if len(word) > n):
            return INSULT
        return self.closed.get(word, OTHER)

    def entries(self, word: bytes) -> list[bytes]:
        """The insult entries that a word matches."""
        return [e for e in (word, *(word[:n] for n in STEMS if len(word) > n)) if e in (self.words if e is word else self.stems)]

    def candidates(self, kit: textkit.Words) -> np.ndarray:
        """Numbers of the words that are an insult or a threat."""
        hit = _among(kit.hashes(), self.known)
        for n, known in self.known_stems.items():
            if len(known):
                long = np.flatnonzero(kit.end - kit.start > n)
                hit[long[_among(kit.hashes_of(kit.start[long], kit.start[long] + n), known)]] = True
        return np.flatnonzero(hit)

    def counts(self, kit: textkit.Words) -> np.ndarray:
        """Rows x outputs: in how many clauses of a row the machine wrote the output."""
        rows = len(kit.counts)
        out = np.zeros((rows, len(self.outputs)))
        hits = self.candidates(kit)
        if not len(hits):
            return out
        breaks = np.flatnonzero(_CLAUSE_END[kit.data])
        clause = np.searchsorted(breaks, kit.start)
        first = {}
        for h in hits.tolist():
            first.setdefault((int(kit.row[h]), int(clause[h])), h)
        for (row, c), h in first.items():
            lo, hi = h, h
            while lo > kit.first[row] and clause[lo - 1] == c:
                lo -= 1
            while hi + 1 < kit.first[row + 1] and clause[hi + 1] == c:
                hi += 1
            state, seen = (0, False, False), set()
            for i in range(lo, hi + 1):
                state, wrote = self.table[state][self.symbol(kit.word(i))]
                if wrote is not None:
                    seen.add(wrote)
            out[row, list(seen)] += 1
        return out

    def score(self, counts: np.ndarray) -> np.ndarray:
        z = np.log1p(counts) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


_CLAUSE_END = np.zeros(256, bool)
_CLAUSE_END[list(b".!?;\n")] = True


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), bool)
    at = np.searchsorted(known, hashes)
    at[at == len(known)] = 0
    return known[at] == hashes


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def _kits(column: pa.Array) -> Iterator[textkit.Words]:
    body, offsets = textkit.text_bytes(_lower(column))
    for lo, hi in textkit.row_chunks(offsets):
        yield textkit.Words(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], textkit.ALNUM, False)


def learn_lexicon(texts: pa.Array, toxic: np.ndarray, support: int = SUPPORT, purity: float = PURITY) -> tuple[set[bytes], set[bytes]]:
    """Words and word beginnings with enough different surroundings in toxic texts and hardly any in others.

    Surroundings (the words before and after) are counted once, so that a
    group of copies counts as one text.
    """
    parts, spelled, row = [], {}, 0
    for kit in _kits(texts):
        hashes = kit.hashes()
        around = textkit.mix(np.append(np.uint64(0), hashes[:-1]) * np.uint64(3) + np.append(hashes[1:], np.uint64(0)))
        bad = toxic[row + kit.row] > 0
        stems = [np.where(kit.end - kit.start > n, kit.hashes_of(kit.start, np.minimum(kit.start + n, kit.end)), 0) for n in STEMS]
        parts.append(np.stack([hashes, around, bad.astype(np.uint64), *stems]))
        for i in np.flatnonzero(bad).tolist():
            spelled.setdefault(int(hashes[i]), kit.word(i))
        row += len(kit.counts)
    if not parts:
        return set(), set()
    word, around, bad, *stems = np.concatenate(parts, axis=1)
    _, once = np.unique(textkit.mix(word + textkit.mix(around)) * np.uint64(2) + bad, return_index=True)
    bad = bad[once].astype(bool)

    def pure(keys: np.ndarray, least: int) -> dict[int, tuple[int, int]]:
        """Toxic and clean surroundings of the keys that pass."""
        known, at = np.unique(keys, return_inverse=True)
        n_bad, n_all = np.bincount(at, bad, len(known)), np.bincount(at, minlength=len(known))
        good = (n_bad >= least) & (n_bad >= purity * n_all) & (known != 0)
        return {int(k): (int(b), int(a - b)) for k, b, a in zip(known[good], n_bad[good], n_all[good], strict=True)}

    words = {spelled[h] for h in pure(word[once], support)}
    kinds: dict[bytes, int] = defaultdict(int)
    for w in spelled.values():
        for n in STEMS:
            if len(w) > n:
                kinds[w[:n]] += 1
    ordered = sorted(kinds)
    body = np.frombuffer(b" ".join(ordered), np.uint8)
    by_hash = dict(zip(textkit.Words(body, np.array([0, len(body)]), np.arange(256) != 0x20, False).hashes().tolist(), ordered, strict=True))
    found = set()
    for hashes in stems:
        for h, (_, clean) in pure(hashes[once], 4 * support).items():
            stem = by_hash[h]
            if clean <= 2 and kinds[stem] >= 3:
                found.add(stem)
    return words, found


def fit_weights(grammar: Grammar, counts: np.ndarray, toxic: np.ndarray, ridge: float = RIDGE, tolerance: float = 1e-8, most_rounds: int = 200) -> None:
    """Logistic regression on log1p counts, both classes of equal weight, by Newton's method with a halved step.

    The ridge pulls weights to where a single asserted clause is enough and a
    negated or reported one is not, which holds for outputs that the sample
    doesn't have.  A text without any clause scores under 0.5, whatever the sample.
    """
    x, y = np.log1p(counts), (toxic > 0).astype(float)
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    centre = np.array([2.0 if n.endswith("asserted") else 0.3 for n in grammar.outputs] + [-1.0])

    def solve(free: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The minimum over the free coordinates: a strictly convex function, so the step always goes down until it is reached."""

        def loss(v: np.ndarray) -> float:
            z = x @ v
            return float(share @ (np.logaddexp(0, z) - y * z) + ridge / 2 * ((v - centre) ** 2).sum())

        for _ in range(most_rounds):
            p = 0.5 * (1 + np.tanh(0.5 * (x @ w)))
            slope = (x.T @ ((p - y) * share) + ridge * (w - centre))[free]
            if np.abs(slope).max(initial=0) <= tolerance:
                return w
            curve = ((x.T * (p * (1 - p) * share)) @ x + ridge * np.eye(len(w)))[np.ix_(free, free)]
            step = np.zeros(len(w))
            step[free] = np.linalg.solve(curve, slope)
            size, now = 1.0, loss(w)
            while loss(w - size * step) > now - 1e-4 * size * float(slope @ step[free]) and size > 1e-9:
                size /= 2
            w = w - size * step
        raise ArithmeticError("the grammar's weights did not converge")

    every = np.arange(len(centre))
    w = solve(every, centre.copy())
    if w[-1] > MOST_BIAS:
        w[-1] = MOST_BIAS
        w = solve(every[:-1], w)
    grammar.weights, grammar.bias = w[:-1], float(w[-1])


def _sample(docs: DataFrame, known: DataFrame, text: str, toxic: str, sample_rows: int, sample_bytes: int) -> list:
    """(text, label) of about ``sample_rows`` rows of each class by a hash of doc_id, one a doc_id, of ``sample_bytes`` in all at most."""
    sizes = {r[toxic]: r["count"] for r in known.where(~held_out(F.col("id"))).groupBy(toxic).count().collect()}  # two rows
    if len(sizes) < 2:
        return []
    limit = F.when(F.col(toxic) == 1, float(sample_rows) / sizes[1]).otherwise(float(sample_rows) / sizes[0])
    drawn = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30))
    chosen = known.where(drawn < limit * float(1 << 30)).select("id", toxic, drawn.alias("drawn"))
    # Texts that alone are over the bound can't be in the sample; of a repeated doc_id one text is.
    rows = docs.where(F.octet_length(text) <= sample_bytes).join(F.broadcast(chosen), docs["doc_id"] == chosen["id"])  # about two samples of ids
    rows = settled(rows.groupBy("id", toxic, "drawn").agg(F.min(text).alias(text)), True)
    upto = F.sum(F.octet_length(text)).over(Window.orderBy("drawn", "id"))  # over the sample's rows
    return rows.withColumn("upto", upto).where(F.col("upto") <= sample_bytes).select(text, toxic).collect()


def train(docs: DataFrame, known: DataFrame, text: str, toxic: str, sample_rows: int, sample_bytes: int = SAMPLE_BYTES) -> Grammar:
    """A grammar from a bounded sample of both classes; without one its lexicon is empty and its base score low."""
    rows = _sample(docs, known, text, toxic, sample_rows, sample_bytes)
    texts = pa.array([r[0] for r in rows], pa.large_string())
    y = np.array([r[1] for r in rows], np.int64)
    del rows
    if len(set(y.tolist())) < 2:
        return Grammar(set(), set())
    grammar = Grammar(*pure_entries(docs, known, text, toxic, Grammar(*learn_lexicon(texts, y))))
    fit_weights(grammar, np.concatenate([grammar.counts(kit) for kit in _kits(texts)]), y)
    return grammar


def _entries(shared, text: str):
    """(doc_id, entry) of the lexicon entries in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shared.value
        for batch in batches:
            ids, found, at = [], [], 0
            column = batch.column("doc_id")
            for kit in _kits(batch.column(text)):
                hits = {(int(kit.row[h]), e) for h in grammar.candidates(kit).tolist() for e in grammar.entries(kit.word(h))}
                for r, e in sorted(hits):
                    ids.append(column[at + r].as_py())
                    found.append(e)
                at += len(kit.counts)
            yield pa.record_batch({"doc_id": pa.array(ids, column.type), "entry": pa.array(found, pa.binary())})

    return run


def pure_entries(docs: DataFrame, known: DataFrame, text: str, toxic: str, grammar: Grammar, purity: float = PURITY) -> tuple[set[bytes], set[bytes]]:
    """The entries that hold up in all training texts, not the sample only: hardly any of the texts with one is clean."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    schema = docs.select("doc_id", F.lit(b"").alias("entry")).schema
    found = docs.select("doc_id", text).mapInArrow(_entries(shared, text), schema)
    counts = found.join(known, found["doc_id"] == known["id"]).groupBy("entry").agg(F.sum(toxic).alias("bad"), F.count(F.lit(1)).alias("n")).collect()  # a row an entry
    good = {bytes(r["entry"]) for r in counts if r["bad"] >= purity * r["n"]}
    return grammar.words & good, grammar.stems & good


def _score(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = shared.value
        for batch in batches:
            scores = [grammar.score(grammar.counts(kit)) for kit in _kits(batch.column(text))]
            out = {c: batch.column(c) for c in batch.schema.names if c != text}
            out["score"] = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.record_batch(out)

    return run


def held_out(doc_id):
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", toxic: str = "toxic", sample_rows: int = SAMPLE_ROWS, carry: bool = False
) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    A null or empty text matches no clause and gets the grammar's base score.
    Without training rows of both classes no clause matches and every score is
    the same, under 0.5.  A document that is labelled more than once counts as
    toxic if one label says so.  Repeated rows each get a row, an empty table
    none.  Columns beside the named ones are ignored.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(f"`{label_id}`").alias("id"), (F.col(f"`{toxic}`").cast("int") > 0).cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(*([whole_row(docs)] if carry else []), F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    seen = rows.where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    grammar = train(seen, known, "text", "toxic", sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # lexicon of a bounded sample
    kept = rows.drop("text")
    out = rows.mapInArrow(_score(shared, "text"), kept.withColumn("score", F.lit(0.0)).schema)
    return out.select(
        *(["document"] if carry else []), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
