"""Test passages inside training texts: shared runs of words, the documents and items, and the texts without them.

The normalised n-grams of the test items go out as one sorted array of hashes; each document's word windows are hashed
in one sweep and looked up in it. Hits are verified against the items' words, so that a collision cannot report a leak.
The arrays are broadcast only while their bytes are within a bound. Beyond it documents and items meet by hash in a join,
to which a document brings only windows that pass a bitmap of the items' hashes, so that the corpus itself is not moved.
"""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Most bytes of items' arrays that are broadcast, and most bits of the bitmap (128 MB).
BROADCAST_BYTES = 64 << 20
BITMAP_BITS = 30
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[tuple[str, int, int]]:
    """(word, start, end) of maximal runs of letters and digits after canonical composition, case folded."""
    if not text:
        return []
    return [(m.group().casefold(), m.start(), m.end()) for m in WORD.finditer(unicodedata.normalize("NFC", text))]


def plain_words(text: str | None) -> list[str]:
    """The words alone; quicker, as most texts share nothing and need no places."""
    return [w.casefold() for w in WORD.findall(unicodedata.normalize("NFC", text))] if text else []


class _Hashes(dict):
    """Hashes of words, kept for the words to come; forgotten when they are a million, so that memory is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def window_hashes(tokens: list[str], n: int, known: _Hashes | None = None) -> np.ndarray:
    """A 64-bit hash of every run of ``n`` words, by one polynomial over the words' hashes."""
    m = len(tokens) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    known = _Hashes() if known is None else known
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _BASE + h[k : k + m]
    return out


class Passages:
    """The items' n-grams as arrays: sorted hashes, and beside each its item and first word; the items' words as one text each."""

    def __init__(self, items: list[tuple[int, str | None]], n: int) -> None:
        self.n = n
        self.known = _Hashes()
        self.ids = np.array([i for i, _ in items], np.int64)
        self.texts: list[bytes] = []
        self.starts: list[np.ndarray] = []
        hashes, item, first = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for at, (_, t) in enumerate(items):
            tokens = [w for w, _, _ in words(t)]
            encoded = [w.encode() for w in tokens]
            self.texts.append(b" ".join(encoded))
            self.starts.append(np.cumsum([0, *(len(w) + 1 for w in encoded)]).astype(np.int32))
            h = window_hashes(tokens, n)
            hashes.append(h)
            item.append(np.full(len(h), at, np.int32))
            first.append(np.arange(len(h), dtype=np.int32))
        self.hashes = np.concatenate(hashes)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.item, self.first = self.hashes[order], np.concatenate(item)[order], np.concatenate(first)[order]

    def parts(self) -> tuple:
        """The arrays alone: what is broadcast must not need this package on the executors."""
        return self.n, self.ids, self.texts, self.starts, self.hashes, self.item, self.first

    @classmethod
    def of(cls, parts: tuple) -> Passages:
        made = cls.__new__(cls)
        made.n, made.ids, made.texts, made.starts, made.hashes, made.item, made.first = parts
        made.known = _Hashes()
        return made

    def hits(self, tokens: list[str]) -> list[tuple[int, int]]:
        """(item, first word) of every verified window of a document."""
        h = window_hashes(tokens, self.n, self.known)
        if not len(h) or not len(self.hashes):
            return []
        at = np.searchsorted(self.hashes, h)
        found = []
        for k in np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == h).tolist():
            run = " ".join(tokens[k : k + self.n]).encode()
            i = int(at[k])
            while i < len(self.hashes) and self.hashes[i] == h[k]:
                item, p = int(self.item[i]), int(self.first[i])
                starts = self.starts[item]
                if self.texts[item][starts[p] : starts[p + self.n] - 1] == run:
                    found.append((int(self.ids[item]), k))
                i += 1
        return found


def _spans(first: list[int], n: int) -> list[tuple[int, int]]:
    """Runs of words (from, to) that windows starting at ``first`` cover, joined where they touch."""
    out: list[list[int]] = []
    for k in sorted(set(first)):
        if out and k <= out[-1][1]:
            out[-1][1] = max(out[-1][1], k + n)
        else:
            out.append([k, k + n])
    return [(a, b) for a, b in out]


_SPANS = "id bigint, item_id bigint, from_char int, to_char int, n_words int"


def leaked_spans(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per document, item and shared run of ``n`` words or more: (``doc_id``, ``item_id``, ``from_char``,
    ``to_char``, ``n_words``), characters of the canonically composed text.

    Words are maximal runs of letters and digits after canonical composition, case ignored. Null and empty texts share
    nothing; items with fewer than ``n`` words cannot be found. Copies of a document all come out. The whole text is read.
    """
    item_rows = items.select(F.col(item_id).cast("bigint"), F.col(item_text)).distinct()
    docs = documents.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    # A word and what parts it are two characters; per word 16 bytes of arrays and 4 of offsets, per character up to 4 of text.
    letters = item_rows.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0)).alias("n")).first()["n"]
    if letters * 14 <= broadcast_bytes:
        shared = documents.sparkSession.sparkContext.broadcast(Passages([tuple(r) for r in item_rows.collect()], n).parts())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            passages = Passages.of(shared.value)
            for b in batches:
                rows = []
                for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                    found = passages.hits(plain_words(t))
                    if not found:
                        continue
                    w = words(t)
                    by_item: dict[int, list[int]] = defaultdict(list)
                    for item, k in found:
                        by_item[item].append(k)
                    rows += [(i, item, w[a][1], w[z - 1][2], z - a) for item, ks in by_item.items() for a, z in _spans(ks, n)]
                yield _batch(rows)

        spans = docs.mapInArrow(scan, _SPANS)
    else:
        spans = _joined(docs, item_rows.toDF("id", "text"), n)
    return spans.select(F.col("id").alias(doc_id), F.col("item_id").alias("item_id"), "from_char", "to_char", "n_words")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    names = ("id", "item_id", "from_char", "to_char", "n_words")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=list(names))


def _bitmap(items: DataFrame, n: int, bits: int = BITMAP_BITS) -> tuple[bytes, int]:
    """Which hashes the items have, as a bitmap over the hashes' first bits, and how many bits; 16 per n-gram, at most 2^bits.

    Pages of 64 KB are made apart and put together by the driver, whatever the items' number.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.concatenate([np.zeros(0, np.uint64), *(window_hashes([w for w, _, _ in words(t)], n) for t in b["text"].to_pylist())])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    hashes = items.select("text").mapInArrow(places, "h bigint").distinct()
    count = hashes.count()
    size = min(bits, max(20, math.ceil(math.log2(16 * count + 1))))
    at = F.shiftrightunsigned("h", 64 - size)
    pages = hashes.select(F.shiftright(at, 19).cast("int").alias("page"), at.bitwiseAND(F.lit((1 << 19) - 1)).cast("int").alias("bit")).distinct()

    def page(t: pa.Table) -> pa.Table:
        on = np.zeros(1 << 19, bool)
        on[t["bit"].to_numpy()] = True
        return pa.table({"page": t["page"].slice(0, 1), "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    out = bytearray(1 << size - 3)
    for r in pages.groupBy("page").applyInArrow(page, "page int, bits binary").toLocalIterator():
        out[r["page"] << 16 : (r["page"] + 1) << 16] = r["bits"]
    return bytes(out), size


def _joined(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The same where the items are too many to broadcast: windows meet by hash, runs are verified by their words."""
    schema = "id bigint, h bigint, run string, k int, from_char int, to_char int"
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(items, n))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, size = shared.value
        bitmap, known = np.frombuffer(raw, np.uint8), _Hashes()
        for b in batches:
            rows = []
            for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                tokens = plain_words(t)
                h = window_hashes(tokens, n, known)
                at = (h >> np.uint64(64 - size)).astype(np.int64)
                passed = np.flatnonzero(bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist()
                w = words(t) if passed else []
                for k in passed:
                    rows.append((i, int(h[k : k + 1].view(np.int64)[0]), " ".join(tokens[k : k + n]), k, w[k][1], w[k + n - 1][2]))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["id", "h", "run", "k", "from_char", "to_char"])

    d = docs.mapInArrow(windows, schema)
    q = items.mapInArrow(windows, schema).select("h", "run", F.col("id").alias("item_id")).distinct()
    hits = d.join(q, ["h", "run"]).select("id", "item_id", "k", "from_char", "to_char").distinct()

    def islands(t: pa.Table) -> pa.Table:
        at = {r["k"]: r for r in t.to_pylist()}
        i, item = t["id"][0].as_py(), t["item_id"][0].as_py()
        rows = [(i, item, at[a]["from_char"], at[z - n]["to_char"], z - a) for a, z in _spans(list(at), n)]
        return pa.Table.from_batches([_batch(rows)])

    return hits.groupBy("id", "item_id").applyInArrow(islands, _SPANS)


def without_leaks(documents: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text", mask: str = "[removed]", drop_share: float = 0.5) -> DataFrame:
    """(``doc_id``, ``clean_text``, ``removed_chars``, ``dropped``): leaked spans masked; a document of which more than
    ``drop_share`` leaked is dropped as a whole (null text). Documents without a leak keep their text as it is."""

    def cut(t: str | None, at: list) -> tuple[str | None, int, bool]:
        if t is None or not at:
            return t, 0, False
        t = unicodedata.normalize("NFC", t)
        merged: list[list[int]] = []
        for a, z in sorted((s["from_char"], s["to_char"]) for s in at):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], z)
            else:
                merged.append([a, z])
        gone = sum(z - a for a, z in merged)
        if gone > drop_share * len(t):
            return None, gone, True
        out, last = [], 0
        for a, z in merged:
            out += [t[last:a], mask]
            last = z
        return "".join([*out, t[last:]]), gone, False

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [cut(t, s) for t, s in zip(b["text"].to_pylist(), b["at"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b["id"], pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int32()), pa.array([x[2] for x in done], pa.bool_())],
                names=[doc_id, "clean_text", "removed_chars", "dropped"],
            )

    at = spans.groupBy(F.col(doc_id).alias("id")).agg(F.collect_set(F.struct("from_char", "to_char")).alias("at"))
    both = documents.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")).join(at, "id", "left")
    return both.mapInArrow(work, f"`{doc_id}` bigint, clean_text string, removed_chars int, dropped boolean")
