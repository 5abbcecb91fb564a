"""Benchmark decontamination as a prefix-filtered set join.

A window of an item must be contained in a document as a whole.  Its tokens
are its word 3-grams (shorter windows: one gram of all words), ordered by how
often they occur in all documents.  At full containment the necessary prefix
is one token, the rarest; a document that lacks it can't hold the window.
Documents are joined on that token only, at the offset it has in the window
(positional bound), if the window fits into the document there (length bound),
and what is left is verified word by word.

The benchmark is a query set that is taken in blocks of bounded size: each
block is indexed and broadcast, and all documents stream past it in a map
without a shuffle.  The size is measured first (a byte of item text makes about
30 bytes of index); one block more costs one pass more, whose results are
written before the next, so nothing that is broadcast or held grows with either table.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import textkit
from orrery.llm.shared import settled, small_batches, whole_row

GRAM = 3


class WindowIndex:
    """Windows of a block of items, found through their rarest gram."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        lists: dict[bytes, set[str]] = defaultdict(set)
        texts = pa.array([t.decode("utf-8") for _, t in items], pa.large_string())
        body, offsets = textkit.text_bytes(texts)
        for lo, hi in textkit.row_chunks(offsets):
            words = textkit.Words(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], textkit.ALNUM, True)
            for row in range(hi - lo):
                first, count = int(words.first[row]), int(words.counts[row])
                for i in range(first, first + max(count - window, 0) + 1 if count else first):
                    found = lists[words.phrase(i, min(window, count))]
                    if items[lo + row][0] is not None:
                        found.add(items[lo + row][0])
        self.phrase = sorted(lists)
        self.items = [sorted(lists[p]) for p in self.phrase]
        self.length = np.array([p.count(b" ") + 1 for p in self.phrase], np.int64)
        grid = textkit.Words(*textkit.text_bytes(pa.array([p.decode("utf-8") for p in self.phrase], pa.large_string())), textkit.ALNUM, False)
        hashes = grid.hashes()
        self.width = np.minimum(self.length, GRAM)
        window_of, offset_of, gram_of, width_of = [], [], [], []
        for g in range(1, GRAM + 1):
            grams, fits = textkit.grams(hashes, g), textkit.inside_row(grid, g)
            at = np.flatnonzero(fits & (self.width[grid.row[: len(fits)]] == g))
            window_of.append(grid.row[at])
            offset_of.append(at - grid.first[grid.row[at]])
            gram_of.append(grams[at])
            width_of.append(np.full(len(at), g))
        # An entry is 19 bytes: it is on every worker until the windows have been ranked.
        self.entry_window = np.concatenate(window_of).astype(np.int32)
        self.entry_offset = np.concatenate(offset_of).astype(np.int32 if window > 30000 else np.int16)
        self.entry_gram = np.concatenate(gram_of)
        self.entry_width = np.concatenate(width_of).astype(np.int8)
        self.gram, self.entry_id = np.unique(self.entry_gram, return_inverse=True)
        self.entry_id = self.entry_id.astype(np.int32)
        self.widths = sorted(set(self.entry_width.tolist()))
        self.bits = self._filter(self.gram)

    @staticmethod
    def _filter(grams: np.ndarray) -> np.ndarray:
        size = 1 << max(16, int(np.ceil(np.log2(max(len(grams), 1)))) + 6)
        bits = np.zeros(size, bool)
        bits[(grams & np.uint64(size - 1)).astype(np.int64)] = True
        return bits

    def rank(self, counts: np.ndarray) -> None:
        """Keeps, for each window, the gram with the fewest occurrences."""
        order = np.lexsort((self.entry_offset, self.entry_gram, counts[self.entry_id], self.entry_window))
        _, first = np.unique(self.entry_window[order], return_index=True)
        kept = order[first]
        kept = kept[np.argsort(self.entry_gram[kept], kind="stable")]
        self.entry_window, self.entry_offset, self.entry_width = self.entry_window[kept], self.entry_offset[kept], self.entry_width[kept]
        self.entry_gram = self.entry_gram[kept]
        self.gram, self.begin = np.unique(self.entry_gram, return_index=True)
        self.begin = np.append(self.begin, len(kept))
        self.widths = sorted(set(self.entry_width.tolist()))
        self.bits = self._filter(self.gram)

    def lookup(self, grams: np.ndarray, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose gram is known, and its number."""
        at = np.flatnonzero(self.bits[(grams & np.uint64(len(self.bits) - 1)).astype(np.int64)] & fits)
        number = np.searchsorted(self.gram, grams[at])
        number[number == len(self.gram)] = 0
        same = self.gram[number] == grams[at]
        return at[same], number[same]

    def occurrences(self, words: textkit.Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of each verified occurrence."""
        hashes = words.hashes()
        starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for g in self.widths:
            at, number = self.lookup(textkit.grams(hashes, g), textkit.inside_row(words, g))
            each = self.begin[number + 1] - self.begin[number]
            entry = np.repeat(self.begin[number] - np.cumsum(each) + each, each) + np.arange(each.sum())
            at = np.repeat(at, each)
            right = self.entry_width[entry] == g
            at, entry = at[right], entry[right]
            window, start, row = self.entry_window[entry], at - self.entry_offset[entry], words.row[at]
            fits = (start >= words.first[row]) & (start + self.length[window] <= words.first[row + 1])
            start, window = start[fits], window[fits]
            same = np.fromiter((words.phrase(s, self.length[w]) == self.phrase[w] for s, w in zip(start.tolist(), window.tolist(), strict=True)), bool, len(start))
            starts.append(start[same])
            windows.append(window[same])
        return np.concatenate(starts), np.concatenate(windows)


def _count_grams(index, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = index.value
        total = np.zeros(len(table.gram), np.int64)
        for _, words in textkit.text_chunks(batches, text, textkit.ALNUM, True):
            hashes = words.hashes()
            for g in table.widths:
                _, number = table.lookup(textkit.grams(hashes, g), textkit.inside_row(words, g))
                total += np.bincount(number, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.record_batch({"gram": pa.array(seen), "n": pa.array(total[seen])})

    return run


def _merge_spans(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    spans = np.concatenate([old.reshape(-1, 2), new.reshape(-1, 2)])
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    if not len(spans):
        return spans
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.append(True, spans[1:, 0] > reach[:-1])
    first = np.flatnonzero(fresh)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def _scan(index, text: str):
    """Adds a block's hits to what each row has from the blocks before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = index.value
        for batch, words in textkit.text_chunks(batches, text, textkit.ALNUM, True):
            start, window = table.occurrences(words)
            row = words.row[start] if len(start) else start
            spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            order = np.argsort(row, kind="stable")
            cuts = np.flatnonzero(np.diff(row[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                r = int(row[part[0]])
                begin = start[part] - words.first[r]
                new = np.stack([begin, begin + table.length[window[part]]], axis=1)
                spans[r] = _merge_spans(np.frombuffer(spans[r], np.int64), new).tobytes()
                items[r] = sorted(set(items[r]).union(*(table.items[w] for w in np.unique(window[part]))))
            out = {c: batch.column(c) for c in batch.schema.names}
            out["n_words"] = pa.array(words.counts, pa.int64())
            out["n_hit"] = pa.array([int(np.diff(np.frombuffer(s, np.int64).reshape(-1, 2), axis=1).sum()) for s in spans], pa.int64())
            out["spans"] = pa.array(spans, pa.binary())
            out["items"] = pa.array(items, pa.list_(pa.string()))
            yield pa.record_batch(out)

    return run


def decontaminate(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, block_bytes: int = 2 << 20, carry: bool = False,
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated; ``document`` with ``carry``.

    Null or wordless texts have no words and no hits.  Wordless items have no
    window.  Items without an id hit words, but aren't listed.  Repeated rows
    of documents each get a row, repeated items count once.  Without items or
    documents the result has no hits or no rows.  Columns beside the named
    ones are ignored, whatever they are called.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bench = items.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.coalesce(F.col(f"`{item_text}`").cast("binary"), F.lit(b"")).alias("body"))
    bench = bench.withColumn("place", F.xxhash64("body", "id"))
    n_bytes = bench.agg(F.coalesce(F.sum(F.octet_length("body") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-n_bytes // block_bytes))
    state = docs.select(
        *([whole_row(docs)] if carry else []), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"),
        F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(b"").alias("spans"), F.array().cast("array<string>").alias("items"),
    )
    for b in range(blocks):
        state = settled(state) if b else state
        rows = bench.where(F.pmod("place", F.lit(blocks)) == b).select("id", "body").collect()
        index = WindowIndex([(r["id"], bytes(r["body"])) for r in rows], window)
        if len(index.gram):
            shared = spark.sparkContext.broadcast(index)
            texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
            counted = texts.mapInArrow(_count_grams(shared, "text"), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
            counts = np.zeros(len(index.gram), np.int64)
            for r in counted:
                counts[r["gram"]] = r["n"]
            index.rank(counts)
        else:
            index.begin = np.zeros(1, np.int64)
        state = state.mapInArrow(_scan(spark.sparkContext.broadcast(index), "text"), state.schema)
    return state.select(
        *(["document"] if carry else []), "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated")
    )
