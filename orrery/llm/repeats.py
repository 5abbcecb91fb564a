"""Exact removal of long repeated passages with merged Burrows-Wheeler transforms.

A byte goes if a string of SPAN bytes that covers it also starts elsewhere.
The same pass tells which bytes shorter strings, of PASSAGE bytes (about fifty
words), cover that also start elsewhere; these are counted, not removed.

1. Anchors.  Among the GRAM-byte strings in a window of PASSAGE bytes, the one
   with the least hash is the window's anchor; equal windows have equal
   anchors.  There is an anchor about every (PASSAGE - GRAM) / 2 bytes, and only
   windows whose anchor occurs twice can repeat.
2. Snippets.  Consecutive windows of one anchor, with SPAN bytes from the last
   of them on, are a snippet (in pieces of at most PIECE windows, so that periodic
   text, whose anchors are all alike, makes few and bounded ones).  Snippets
   that occur twice as a whole are resolved by counting.
3. Transforms.  The distinct snippets of an anchor are dealt to shards.  Over
   an alphabet of BLOCK-byte blocks a window is a few symbols, and the
   suffixes at distance BLOCK form chains.  Each shard has its own
   Burrows-Wheeler transform; the shards' transforms are merged by refining
   their interleave one symbol at a time, reading the transforms only.  A
   position that becomes a boundary in round t has a common prefix of t - 1
   symbols; what is no boundary after SPAN / BLOCK rounds (PASSAGE / BLOCK) is a
   repeated interval, and its suffixes are the repeated windows.
4. Anchors with more distinct snippets than a task's transforms hold (a passage
   that very many texts share, each with other surroundings): their windows are
   counted by hash, packed and dealt by hash.  The result is the same.

Equal texts are one text from the start: copies of SPAN bytes or more go as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import textkit
from orrery.llm.shared import forget, parallel, release, settled, small_batches

SPAN, PASSAGE, GRAM, BLOCK = 400, 300, 100, 50
#: Distinct snippets of an anchor that are merged in one task: about 2 MB, which take some 200 MB while they are merged.
MOST_VARIANTS = 4096
SHARDS = 4
#: Windows of a snippet at most.
PIECE = 1 << 15
#: Snippet bytes merged at once, text bytes searched for anchors at once, and crowded snippets dealt at once.
BATCH_BYTES, CHUNK_BYTES, DEAL_ROWS = 1 << 20, 1 << 20, 500


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each position on."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(textkit._BYTE_CODE[data] * textkit._power_table(textkit._BASE, len(data)), out=sums[1:])
    return textkit.mix((sums[width:] - sums[:n]) * textkit._power_table(textkit._BASE_INVERSE, n))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, from block-wise running minima."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, span: int, gram: int, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """Row, hash, first and last window and number of anchor places of each run of windows with equal anchors; windows within their row.

    Runs are cut after ``piece`` windows.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < span:
        return empty, np.zeros(0, np.uint64), empty, empty, empty
    keys = rolling(data, gram)
    bits = np.uint64(max(1, int(len(data)).bit_length()))
    at = sliding_least((keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64), span - gram + 1)
    anchor = (at & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    window = np.flatnonzero(np.arange(len(anchor)) + span <= offsets[row + 1])
    if not len(window):
        return empty, np.zeros(0, np.uint64), empty, empty, empty
    anchor, row = anchor[window], row[window]
    key = keys[anchor]
    fresh = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))
    run = np.flatnonzero(fresh)
    begin = np.repeat(run, np.diff(np.append(run, len(key))))
    fresh |= (np.arange(len(key)) - begin) % piece == 0
    fresh = np.flatnonzero(fresh)
    last = np.append(fresh[1:], len(anchor)) - 1
    moved = np.append(0, np.cumsum(anchor[1:] != anchor[:-1]))
    base = offsets[row[fresh]]
    return row[fresh], key[fresh], window[fresh] - base, window[last] - base, moved[last] - moved[fresh] + 1


def _find_anchors(span: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = textkit.text_bytes(batch.column("text"))
            for lo, hi in textkit.row_chunks(offsets, CHUNK_BYTES):
                row, key, _, _, places = anchors(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], span, gram)
                yield pa.record_batch({"key": pa.array(key.view(np.int64)), "row": batch.column("row").take(pa.array(row + lo)), "places": pa.array(np.minimum(places, 2).astype(np.int8))})

    return run


def _cut_snippets(span: int, tail: int, gram: int):
    """The snippets of a text's repeated anchors, as far as the text goes; ``inner`` ones have several places of their anchor."""
    names = ("key", "hash", "row", "first", "windows", "inner", "bytes")
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = textkit.text_bytes(batch.column("text"))
            text, keys = batch.column("row").to_pylist(), batch.column("keys")
            for lo, hi in textkit.row_chunks(offsets, CHUNK_BYTES):
                start = offsets[lo]
                row, key, first, last, places = anchors(body[start : offsets[hi]], offsets[lo : hi + 1] - start, span, gram)
                key = key.view(np.int64)
                bounds = np.searchsorted(row, np.arange(hi - lo + 1))
                out: list[list] = [[] for _ in names]
                for r in range(hi - lo):
                    a, b = bounds[r], bounds[r + 1]
                    known = np.isin(key[a:b], np.asarray(keys[lo + r].values))
                    for i in (np.flatnonzero(known) + a).tolist():
                        at = int(offsets[lo + r]) + int(first[i])
                        found = body[at : min(at + int(last[i] - first[i]) + tail, int(offsets[lo + r + 1]))].tobytes()
                        for column, v in zip(out, (int(key[i]), hashlib.blake2b(found, digest_size=16).digest(), text[lo + r], int(first[i]), int(last[i] - first[i]) + 1, int(places[i] > 1), found), strict=True):
                            column.append(v)
                yield pa.record_batch([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)

    return run


class Shard:
    """The Burrows-Wheeler transform of the block chains of some strings.

    ``symbol`` has, for each position of the strings laid end to end, the code
    of the block there, or 0 where a string ends before: those positions are
    the chains' ends, kept apart by place.
    """

    def __init__(self, symbol: np.ndarray, starts: np.ndarray, block: int):
        n = len(symbol)
        ends = symbol == 0
        rank = np.where(ends, np.cumsum(ends), symbol + int(ends.sum())).astype(np.int64)
        step, place = block, np.arange(n)
        while True:  # ranks of 1, 2, 4, ... symbols, until every suffix is told apart
            _, rank = np.unique(rank, return_inverse=True)
            if rank.max(initial=-1) == n - 1:
                break
            reach = place + step
            # A suffix that ends sooner is already alone; only whole ones look further.
            ahead = np.where(reach < n, rank[np.minimum(reach, n - 1)] + 1, 0)
            rank = rank * (n + 2) + ahead
            step *= 2
        self.order = np.argsort(rank, kind="stable")
        self.ends = int(ends.sum())
        within = place - np.repeat(starts[:-1], np.diff(starts))
        before = np.where(within >= block, symbol[np.maximum(place - block, 0)], 0)
        self.transform = before[self.order].astype(np.int32)


def _stable_order(codes: np.ndarray) -> np.ndarray:
    """argsort, stable, of codes under 2**32: two passes over 16 bits, which numpy sorts by radix."""
    low = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    high = (codes >> 16).astype(np.uint16)
    return low[np.argsort(high[low], kind="stable")] if high.any() else low


def merge(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each merged suffix, and its common prefix with the one before, in symbols, up to ``rounds``.

    Only the transforms are read: in each round the suffixes in their order so
    far are dealt by the symbol before them, stably, which orders the suffixes
    that start with those symbols by one symbol more.
    """
    size = sum(len(s.transform) for s in shards)
    shard = np.arange(len(shards), dtype=np.uint16)
    ends = np.repeat(shard, [s.ends for s in shards])
    source = np.repeat(shard, [len(s.transform) for s in shards])
    symbols = np.concatenate([s.transform for s in shards])
    group = np.zeros(size, np.int32)
    common = np.full(size, rounds, np.int32)
    known = np.zeros(size, bool)
    for t in range(rounds):
        merged = np.empty(size, symbols.dtype)
        merged[np.argsort(source, kind="stable")] = symbols
        deal = _stable_order(merged)[len(ends) :]
        source = np.concatenate([ends, source[deal]])
        c, g = merged[deal], group[deal]
        fresh = np.concatenate([np.ones(len(ends), bool), np.append(True, (c[1:] != c[:-1]) | (g[1:] != g[:-1]))[: len(deal)]])
        common[fresh & ~known] = t
        known |= fresh
        group = np.cumsum(fresh, dtype=np.int32)
    return source, common


def repeated_starts(strings: list[bytes], spans: list[int], block: int = BLOCK, shards: int = SHARDS, windows: list[int] | None = None) -> list[list[np.ndarray]]:
    """For each span and string the starts of the string's windows of that many bytes that occur more than once in all strings.

    Only the first ``windows`` starts of a string count, if given: what follows is in another string too.
    """
    m = max(1, min(shards, len(strings)))
    hashes = []
    for s in strings:
        data = np.frombuffer(s, np.uint8)
        codes = np.zeros(len(data) + 1, np.uint64)  # one place more, for a chain that ends with the string
        codes[: max(len(data) - block + 1, 0)] = rolling(data, block) | np.uint64(1)
        hashes.append(codes)
    _, code = np.unique(np.concatenate(hashes), return_inverse=True)  # ends have the code 0: every string has some
    bounds = np.cumsum([0, *(len(s) + 1 for s in strings)])
    built, places = [], []
    for k in range(m):
        mine = range(k, len(strings), m)
        starts = np.cumsum([0, *(len(strings[i]) + 1 for i in mine)])
        built.append(Shard(np.concatenate([code[bounds[i] : bounds[i + 1]] for i in mine]), starts, block))
        places.append(np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in mine])[built[-1].order])
    source, common = merge(built, max(spans) // block)
    place = np.empty(len(source), np.int64)
    place[np.argsort(source, kind="stable")] = np.concatenate(places)
    counts = np.ones(int(bounds[-1]), bool)
    if windows is not None:
        counts = np.arange(int(bounds[-1])) < np.repeat(bounds[:-1] + np.array(windows), np.diff(bounds))
    counts = counts[place]
    out = []
    for span in spans:
        inside = common >= span // block
        inside[0] = False
        interval = np.cumsum(~inside) - 1
        again = counts & (np.bincount(interval, counts)[interval] > 1)
        hit = np.zeros(int(bounds[-1]), bool)
        hit[place[again]] = True
        out.append([np.flatnonzero(hit[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    return out


def repeated_windows(strings: list[bytes], span: int = SPAN, block: int = BLOCK, shards: int = SHARDS) -> list[np.ndarray]:
    """For each string the starts of its windows of ``span`` bytes that occur more than once in all strings."""
    return repeated_starts(strings, [span], block, shards)[0]


def _runs(starts: np.ndarray, span: int) -> bytes:
    """Consecutive window starts as pairs (first byte, end)."""
    if not len(starts):
        return b""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + span], axis=1).astype("<i8").tobytes()


_RUNS = pa.schema([("row", pa.binary()), ("long", pa.bool_()), ("runs", pa.binary())])
_RUNS_SQL = "row binary, long boolean, runs binary"


def _merge_snippets(spans: list[int], block: int):
    """Repeated windows of each span of the snippets that stand alone; the rows are sorted by key, and a key's rows are together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "row", "first", "windows", "alone", "bytes")), strict=True):
                if size >= BATCH_BYTES and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush(held)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        found = []
        for span, by_string in zip(spans, repeated_starts([h[5] for h in held], spans, block, windows=[h[3] for h in held]), strict=True):
            found += [(row, span == spans[0], _runs(starts + first, span)) for (_, row, first, _, alone, _), starts in zip(held, by_string, strict=True) if alone and len(starts)]
        return pa.record_batch([pa.array(v, t.type) for v, t in zip(zip(*found, strict=True) if found else ((), (), ()), _RUNS, strict=True)], schema=_RUNS)

    return run


_WINDOW = np.dtype([("hash", "<u8"), ("row", "<u8", 2), ("at", "<i8"), ("alone", "u1"), ("long", "u1")])


def _deal_windows(spans: list[int], parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, DEAL_ROWS) for b in batches for at in range(0, b.num_rows, DEAL_ROWS)):
            made = [np.empty(0, _WINDOW)]
            for row, first, count, alone, piece in zip(*(batch.column(c).to_pylist() for c in ("row", "first", "windows", "alone", "bytes")), strict=True):
                for span in spans:
                    h = rolling(np.frombuffer(piece, np.uint8), span)[:count]
                    w = np.empty(len(h), _WINDOW)
                    w["hash"], w["row"], w["at"], w["alone"], w["long"] = h, np.frombuffer(row, "<u8"), first + np.arange(len(h)), alone, span == spans[0]
                    made.append(w)
            windows = np.concatenate(made)
            part = windows["hash"] % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            windows, part = windows[order], part[order]
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            blobs = [x.tobytes() for x in np.split(windows, cuts[1:])] if len(part) else []
            yield pa.record_batch({"part": pa.array(part[cuts].astype(np.int32), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def _count_windows(spans: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                by_part.setdefault(part, []).append(blob)
        for part in sorted(by_part):
            every = np.frombuffer(b"".join(by_part.pop(part)), _WINDOW)
            found = []
            for span in spans:
                w = every[every["long"] == (span == spans[0])]
                w = w[np.argsort(w["hash"], kind="stable")]
                same = w["hash"][1:] == w["hash"][:-1]
                again = w[(np.append(False, same) | np.append(same, False))[: len(w)] & (w["alone"] == 1)]
                again = again[np.lexsort((again["at"], again["row"][:, 0], again["row"][:, 1]))]
                cut = np.flatnonzero(np.append(True, (again["row"][1:] != again["row"][:-1]).any(axis=1))) if len(again) else np.zeros(0, np.int64)
                found += [(p["row"][0].tobytes(), span == spans[0], _runs(np.unique(p["at"].astype(np.int64)), span)) for p in (np.split(again, cut[1:]) if len(again) else [])]
            yield pa.record_batch([pa.array(v, t.type) for v, t in zip(zip(*found, strict=True) if found else ((), (), ()), _RUNS, strict=True)], schema=_RUNS)

    return run


def _covered(runs: list[bytes]) -> int:
    """Bytes that the spans cover."""
    spans = np.frombuffer(b"".join(runs), "<i8").reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.append(0, np.maximum.accumulate(spans[:, 1])[:-1]) if len(spans) else spans[:, 1]
    return int(np.maximum(spans[:, 1] - np.maximum(spans[:, 0], reach), 0).sum())


def _remove(text: bytes, runs: list[bytes]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and the bytes that stay."""
    spans = np.frombuffer(b"".join(runs), "<i8").reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    removed, count, at, kept = 0, 0, 0, []
    end = -1
    for a, b in spans.tolist():
        if a > end:
            if end > 0:
                at = end
            kept.append(text[max(at, 0) : a])
            count += 1
            end = b
            removed += b - a
        elif b > end:
            removed += b - end
            end = b
    kept.append(text[max(end, 0) :])
    return removed, count, b"".join(kept)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, runs, short = batch.column("text"), batch.column("runs"), batch.column("short")
        out = [(*_remove(texts[i].as_py().encode(), runs[i].as_py()), _covered(runs[i].as_py() + short[i].as_py())) for i in range(batch.num_rows)]
        yield pa.record_batch({
            "row": batch.column("row"), "n_removed": pa.array([o[0] for o in out], pa.int64()), "n_spans": pa.array([o[1] for o in out], pa.int64()),
            "kept": pa.array([o[2] for o in out], pa.binary()), "n_passage": pa.array([o[3] for o in out], pa.int64()),
        })


def _pack_spans(span: int):
    """Snippets that occur several times, as runs: of strings of ``span`` bytes if they are that long, else of shorter ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            flat = np.stack([a, b], axis=1).astype("<i8").tobytes()
            yield pa.record_batch([batch.column("row"), pa.array(b - a >= span, pa.bool_()), pa.array([flat[i : i + 16] for i in range(0, len(flat), 16)], pa.binary())], schema=_RUNS)

    return run


def remove_repeats(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, passage: int | None = None, gram: int = GRAM, block: int = BLOCK, most_variants: int = MOST_VARIANTS,
    keep_bytes: bool = False,
) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage; with ``keep_bytes`` also ``kept`` (binary, null if nothing went).

    ``n_passage`` counts the bytes that strings of ``passage`` bytes (three
    quarters of ``span``, if not given) cover that also start elsewhere; what is
    removed is among them.  ``span`` and ``passage`` are multiples of ``block``.
    A null text is empty; texts shorter than ``span`` lose nothing.  Cuts may
    fall inside a UTF-8 character, so what is kept is bytes.  Repeated rows are
    copies of each other.  An empty table gives no rows.  Columns beside the
    named ones are ignored.  Texts are told apart by 128 bits of their SHA-256,
    strings by 64-bit hashes: equal hashes count as equal.
    """
    passage = passage or span * PASSAGE // SPAN // block * block
    if span % block or passage % block or not gram < passage <= span:
        raise ValueError("span and passage must be multiples of block, the passage between gram and span")
    spark = docs.sparkSession
    small_batches(spark)
    spans, some = [span, passage], F.count(F.lit(1))
    body = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    body = body.withColumn("sha", F.sha2("text", 256)).withColumn("row", F.unhex(F.substring("sha", 1, 32)))
    small = settled(body.select("doc_id", "row", "sha", F.octet_length("text").cast("long").alias("n_bytes")))
    long = body.where(F.octet_length("text") >= passage)
    found = settled(long.select("row", "text").mapInArrow(_find_anchors(passage, gram), "key long, row binary, places byte"))
    repeated = settled(found.groupBy("key").agg(F.sum("places").alias("n")).where("n > 1").select("key"))
    per_row = found.join(repeated, "key").groupBy("row").agg(F.collect_set("key").alias("keys"))  # bounded by a text's length
    texts = settled(small.groupBy("row").agg(some.alias("copies"), F.min("doc_id").alias("first_id")))
    wanted = settled(per_row.join(texts, "row"))
    forget(found, repeated)
    chosen = long.select("doc_id", "row", "text").alias("d").join(wanted.alias("w"), (F.col("d.row") == F.col("w.row")) & F.col("d.doc_id").eqNullSafe(F.col("w.first_id")))
    chosen = settled(chosen.select("d.row", "d.text", "w.keys", "w.copies"))
    forget(wanted)
    release(spark)
    snippets = settled(chosen.select("row", "text", "keys").mapInArrow(_cut_snippets(passage, span, gram), "key long, hash binary, row binary, first int, windows int, inner int, bytes binary"))
    kinds = snippets.groupBy("key", "hash").agg(some.alias("n"), F.max("inner").alias("inner"), F.min(F.struct("row", "first")).alias("one"))
    kinds = settled(kinds.select("key", "hash", "n", "inner", F.col("one.row").alias("one_row"), F.col("one.first").alias("one_first")))
    many = settled(kinds.where("n > 1").select("key", "hash"))
    whole = snippets.select("key", "hash", "row", "first", F.octet_length("bytes").alias("size")).join(many, ["key", "hash"])
    packed = settled(whole.select("row", F.col("first").cast("long").alias("a"), (F.col("first") + F.col("size")).cast("long").alias("b")).mapInArrow(_pack_spans(span), _RUNS_SQL))
    several = settled(kinds.groupBy("key").agg(some.alias("variants"), F.max("inner").alias("inner")).where("variants > 1 or inner > 0").select("key", "variants"))
    asked = settled(kinds.join(several, "key").select("key", "hash", "one_row", "one_first", (F.col("n") == 1).cast("int").alias("alone"), "variants"))
    variants = snippets.join(asked, ["key", "hash"]).where("row = one_row and first = one_first").select("key", "row", "first", "windows", "alone", "bytes", "variants")
    variants = settled(variants)
    forget(snippets, kinds, many, several, asked)
    release(spark)
    few = variants.where(F.col("variants") <= most_variants).drop("variants").repartition(parallel(spark), "key").sortWithinPartitions("key")
    runs = few.mapInArrow(_merge_snippets(spans, block), _RUNS_SQL)
    parts = parallel(spark)
    dealt = variants.where(F.col("variants") > most_variants).drop("variants", "key").mapInArrow(_deal_windows(spans, parts), "part int, blob binary")
    runs = settled(runs.union(dealt.repartition(parts, "part").mapInArrow(_count_windows(spans), _RUNS_SQL)))
    forget(variants)
    release(spark)
    here = lambda flag: F.collect_list(F.when(flag, F.col("runs")))
    by_row = settled(runs.union(packed).groupBy("row").agg(here(F.col("long")).alias("runs"), here(~F.col("long")).alias("short")))  # bounded by a text's length
    cut = chosen.where("copies = 1").select("row", "text").join(by_row, "row").mapInArrow(_finish, "row binary, n_removed long, n_spans long, kept binary, n_passage long")
    cut = settled(cut.withColumn("kept_sha", F.sha2("kept", 256)).select("row", "n_removed", "n_spans", "n_passage", "kept_sha", *(["kept"] if keep_bytes else [])))
    forget(runs, packed, by_row, chosen)
    # Only texts that have copies or lose bytes meet the rows again.
    changed = settled(texts.where("copies > 1").select("row", "copies").join(cut, "row", "full_outer"))
    forget(texts, cut)
    out = small.join(changed, "row", "left")
    copied = lambda least: (F.col("copies") > 1) & (F.col("n_bytes") >= least)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes", F.when(copied(span), F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(copied(span), F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(copied(span), nothing).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(copied(passage), F.col("n_bytes")).otherwise(F.coalesce("n_passage", zero)).alias("n_passage"),
        *([F.when(copied(span), F.lit(b"")).otherwise(F.when(F.col("n_removed") > 0, F.col("kept"))).alias("kept")] if keep_bytes else []),
    )
