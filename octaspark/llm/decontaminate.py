"""Benchmark decontamination: Wu-Manber search for the benchmark's word windows.

Patterns are the windows of ``width`` words of every benchmark item; an item of
fewer words is one pattern of all its words. The alphabet is words, not bytes:
a block is two words (one for patterns of one word), the shift table says how
far a search may jump from a block, suffix-hash buckets list the patterns that
end with the block, and every candidate is compared word by word.

The benchmark is sent to the executors in parts of about ``part_bytes`` of
text. Documents are scanned once, whatever the benchmark's size: each batch is
searched for one part after another, and a worker holds the tables of one part
only.

Nulls: a null text has no words, a null item no windows. Repeated items count
once by ``item_id``; repeated documents give repeated rows, ties don't occur.
Columns of any name come back as they were from :func:`clean`; from
:func:`search` the results take the place of columns of the same names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, hide, show, slices, strings, text_bytes
from .words import mix, words

WIDTH = 8
PART_BYTES = 4 << 20
#: Words that one lane of a search walks over; a text is cut into lanes that overlap by a pattern.
LANE = 512
_TABLE_BITS = 16


class Patterns:
    """Wu-Manber tables of patterns that have ``m`` words each."""

    def __init__(self, m: int, found: dict[bytes, set[str]]):
        self.m, self.block = m, min(2, m)
        self.text = list(found)
        self.items = [sorted(found[t]) for t in self.text]
        buf = np.frombuffer(b"\n".join(self.text), np.uint8)
        at = np.cumsum([0] + [len(t) + 1 for t in self.text])
        at[-1] -= 1
        w = words(buf, at)
        table = w.hash.reshape(len(self.text), m)
        size = 1 << min(24, max(_TABLE_BITS, int(4 * table.size).bit_length()))
        self.mask = np.uint64(size - 1)
        self.shift = np.full(size, m - self.block + 1, np.uint8 if m < 250 else np.int32)
        for end in range(self.block - 1, m):  # a block that ends at word ``end`` lets the search jump to the pattern's end
            np.minimum.at(self.shift, self.slot(table, end), m - 1 - end)
        tail = self.key(table, m - 1)
        order = np.argsort(tail, kind="stable")
        self.tail, self.which = tail[order], order
        self.table = table

    def key(self, table: np.ndarray, end: int) -> np.ndarray:
        return table[:, end] if self.block == 1 else mix(table[:, end - 1] * np.uint64(3) + table[:, end])

    def slot(self, table: np.ndarray, end: int) -> np.ndarray:
        return (self.key(table, end) & self.mask).astype(np.int64)

    def search(self, w) -> tuple[np.ndarray, np.ndarray]:
        """Last word and pattern of every occurrence whose word hashes agree."""
        h, m = w.hash, self.m
        if len(h) < m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = h if self.block == 1 else np.concatenate([h[:1], mix(h[:-1] * np.uint64(3) + h[1:])])
        count = w.count
        long = np.flatnonzero(count >= m)
        lanes = -(-(count[long] - m + 1) // LANE)
        text = np.repeat(long, lanes)
        k = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        pos = w.first[text] + k * LANE + m - 1  # a lane owns the occurrences that end at its words
        stop = np.minimum(pos + LANE, w.first[text + 1])
        hits = []
        while len(pos):
            slot = (key[pos] & self.mask).astype(np.int64)
            step = self.shift[slot]
            if (zero := step == 0).any():
                hits.append(pos[zero])
            pos = pos + np.maximum(step, 1)
            if not (live := pos < stop).all():
                pos, stop = pos[live], stop[live]
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(hits)
        lo, hi = np.searchsorted(self.tail, key[at], "left"), np.searchsorted(self.tail, key[at], "right")
        n = hi - lo
        end = np.repeat(at, n)
        which = self.which[np.repeat(lo, n) + np.arange(len(end)) - np.repeat(np.cumsum(n) - n, n)]
        same = np.ones(len(end), bool)
        for j in range(m):
            same &= h[end - m + 1 + j] == self.table[which, j]
        return end[same], which[same]


def patterns(items: list[tuple[str, str | None]], width: int = WIDTH) -> list[Patterns]:
    """The windows of (item_id, text) pairs as one search table for each number of words."""
    by: dict[int, dict[bytes, set[str]]] = {}
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        w = words(raw, np.array([0, len(raw)]), True)
        own = [raw[s:e].tobytes().lower() for s, e in zip(w.start, w.end)]
        m = min(width, len(own))
        for i in range(len(own) - m + 1 if m else 0):
            by.setdefault(m, {}).setdefault(b" ".join(own[i : i + m]), set()).add(str(item))
    return [Patterns(m, found) for m, found in sorted(by.items())]


_RESULT = pa.schema([("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def _tables(sent: list):
    """The tables of each part; of several, a worker keeps none once it is done with it."""
    for part in sent:
        yield from part.value
        if len(sent) > 1:
            part.__dict__.pop("_value", None)  # is read again from the executor's copy when it is needed


def _search(sent: list, keep_text: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = strings(part.column(part.schema.get_field_index("text")))
                buf, at = text_bytes(texts)
                w = words(buf, at, True)
                n = len(texts)
                spans: list[list[int]] = [[] for _ in range(n)]
                items: list[set[str]] = [set() for _ in range(n)]
                for t in _tables(sent):
                    end, which = t.search(w)
                    text = np.searchsorted(w.first, end, "right") - 1
                    for e, p, i in zip(end.tolist(), which.tolist(), text.tolist()):
                        lo = e - t.m + 1
                        if b" ".join(buf[w.start[k] : w.end[k]].tobytes().lower() for k in range(lo, e + 1)) == t.text[p]:
                            spans[i] += (lo - int(w.first[i]), t.m)
                            items[i].update(t.items[p])
                keep = [c for c in part.schema.names if keep_text or c != "text"]
                arrays = [part.column(part.schema.get_field_index(c)) for c in keep]
                arrays += [pa.array(w.count, pa.int64()), pa.array(spans, _RESULT.field(1).type), pa.array([sorted(x) for x in items], _RESULT.field(2).type)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *_RESULT.names])

    return run


def _parts(benchmark: DataFrame, part_bytes: int):
    """The benchmark's rows in lists of about ``part_bytes`` of text at most, one list at a time on the driver."""
    own, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        own.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= part_bytes:
            yield own
            own, size = [], 0
    if own:
        yield own


def _occurrences(docs: DataFrame, benchmark: DataFrame, width: int, part_bytes: int, keep_text: bool) -> DataFrame:
    """doc_id (or all columns, hidden), n_words, hits (first word and number of words of each occurrence) and items."""
    have = hide(docs, "doc_id", "text") if keep_text else docs.select("doc_id", "text")
    sc = docs.sparkSession.sparkContext
    kept = have.schema if keep_text else have.drop("text").schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_words long", "hits array<long>", "items array<string>"])
    sent = [sc.broadcast(patterns(part, width)) for part in _parts(benchmark, part_bytes)]
    return arrow_map(have, lambda batches: _search(sent, keep_text)(batches), schema)


def search(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, part_bytes: int = PART_BYTES, keep_text: bool = False) -> DataFrame:
    """For each document: doc_id, n_words, n_hit (words in an occurrence) and the sorted ids of the items found.

    ``keep_text`` keeps all columns of ``docs`` instead of doc_id alone.
    """
    docs = docs.drop("n_words", "n_hit", "items") if keep_text else docs.select("doc_id", "text")
    found = _occurrences(docs, benchmark, width, part_bytes, keep_text).withColumn("n_hit", _union("hits")).drop("hits")
    return show(found, docs, "doc_id", "text") if keep_text else found


def _union(spans: str):
    """Words covered by [first, count, first, count, ...]."""
    pairs = F.expr(f"array_sort(transform(sequence(0, size({spans}) div 2 - 1), i -> struct({spans}[2 * i] AS lo, {spans}[2 * i] + {spans}[2 * i + 1] AS hi)))")
    total = F.aggregate(
        pairs,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(a["to"], x["lo"]))).alias("n"), F.greatest(a["to"], x["hi"]).alias("to")),
        lambda a: a["n"],
    )
    return F.when(F.size(spans) == 0, F.lit(0).cast("long")).otherwise(total)


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_items: int = 2, part_bytes: int = PART_BYTES) -> DataFrame:
    """:func:`search` as digest columns; contaminated: ``min_items`` items or more have windows in the text."""
    found = search(docs, benchmark, width, part_bytes)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_items: int = 2, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents that leak nothing, with the columns they came with.

    One occurrence of a whole window of ``width`` words is a leak. Items that
    are shorter than a window may be common phrases: these condemn a document
    only if it holds ``min_items`` items or more.
    """
    found = _occurrences(docs, benchmark, width, part_bytes, True)
    leak = F.exists(F.sequence(F.lit(0), F.greatest(F.size("hits") / 2 - 1, F.lit(0)).cast("int")), lambda i: F.coalesce(F.get("hits", 2 * i + 1) >= width, F.lit(False)))
    return show(found.filter(~leak & (F.size("items") < min_items)).drop("n_words", "hits", "items"), docs, "doc_id", "text")
