"""Substring dedup by compact windows: near-duplicate passages of ``min_words`` words or more.

A document is its sequence of shingles of five words. For each of ``FUNCTIONS``
hash functions, all passages of at least ``min_words`` words whose least
shingle hash is the one at ``c`` form one compact window (left, c, right): the
node of a Cartesian tree over the hashes, cut off below that width. There are
about 2 n / width of them, and where text repeats with a short period, such as
one word many times, one for each repeat: of those the first, the last and one
in every DRIFT places stay (see ``_thin``). Two passages share a min-hash exactly if they lie in
windows of the same value, so equal passages always meet in every function,
and passages of Jaccard similarity 0.8 in one of three with probability 0.992.

* Windows meet through the least document of each value (a row for each window,
  not for each pair). A window carries eight bytes of context: hashes of the
  runs of shingles around ``c``. Windows that agree with the hub's first one in
  fewer than two runs meet again through value and the two runs on either side.
* A window whose centre no verified passage shared with its hub covers is open.
  Open windows meet again through value and two runs on a side: with all
  windows that the hub has there, so a hub that holds pieces of a passage beside
  the passage doesn't hide it; and with each other, without the hub, which may
  hold a piece only. Those that are still open, and the windows of their value that share
  three runs with them, meet again through hashes of every stretch of
  ``min_words`` words around the centre, so what later documents repeat exactly
  is found whatever the hub holds. Windows that share their value and two runs on a
  side with a window still open are compared with each other by what is around
  them, pair by pair in blocks, unless passages cover and connect both already, so
  near repeats of third documents are found too.
* Interval join: aligned windows overlap in an interval around ``c``; the
  intervals of two documents are merged by offset.
* Verification: both documents' shingles are fetched, and the longest passages
  of the intervals with exact Jaccard similarity 0.8 or more are kept, along
  one offset, or over neighbouring offsets where words were inserted or deleted:
  there the longest stretches of matched places that qualify are searched.

Result: a row for each passage with doc_id, first word and number of words,
the document and first word it was matched with (source_id, source_start),
similarity, and class_id, the least doc_id of the documents connected by such
passages. Sources have rows of their own, matched with themselves. Repeats
within one document are left out. Null texts and texts below ``min_words``
words have no passages; rows without doc_id (an integer) can't be named and are
left out. Rows that share a doc_id are one document. Only doc_id and text are
read, whatever the other columns are. An empty table has no passages.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .ngram_join import common
from .shared import BROADCAST_ROWS, arrow_map, drop, release, save, slices, small, strings, text_bytes
from .words import mix, shingles, words

SIZE, MIN_WORDS, FUNCTIONS = 5, 50, 3
#: Shingles in a run of context; there are four runs before and four after the centre.
RUN = 6
#: Offsets this far apart belong to one passage with inserted or deleted words.
DRIFT = 16
#: Places of a shingle, on average, from which on a chain is searched by array instead of one by one.
MANY = 8
#: Pairs of windows that a Python worker makes at a time.
PAIRS = 1_000_000
#: The windows of a value that has so many are dealt to SALTS groups; values are counted in one document of SAMPLE.
HOT, SAMPLE, SALTS = 16_384, 64, 32
#: Windows of a value in a block; blocks are compared two by two.
GROUP = 1024
_SALT = np.random.default_rng(41).integers(1, 2**63, 16, dtype=np.uint64)


def compact_windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, left and right ends (inclusive) of the compact windows of ``width`` places or more of each text.

    The centres are the places of sliding minima. A smaller neighbour of a
    centre is a centre itself, so a stack over the centres alone finds how far
    each reaches. Of equal hashes the earlier one counts as smaller.
    """
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none
    bits = np.uint64(max(1, int(n).bit_length()))
    value = ((h >> bits) << bits) | np.arange(n, dtype=np.uint64)
    # sliding minima by prefix and suffix minima of blocks of ``width``
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = value
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    low = np.minimum(back[: n - width + 1], ahead[width - 1 : n])
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = owner[: n - width + 1] == owner[width - 1 : n]
    where = (low[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if not len(where):
        return none, none, none
    centre = np.unique(where)
    doc = owner[centre]
    begin, end = first[doc], first[doc + 1] - 1
    key = value[centre]
    left, right = begin.copy(), end.copy()
    stack: list[int] = []
    keys, docs, places = key.tolist(), doc.tolist(), centre.tolist()
    for i in range(len(keys)):
        if stack and docs[stack[-1]] != docs[i]:
            stack = []
        while stack and keys[stack[-1]] > keys[i]:
            right[stack.pop()] = places[i] - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    return centre, left, right


def _thin(sh: np.ndarray, h: np.ndarray, first: np.ndarray, centre: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows without most of those that differ by a period of repeated text only, such as one word many times.

    Each place where such text repeats has a window of the same value: n of
    them in n places, n * n pairs in two documents. The first and the last one
    stay, since passages that go on before or after align there, and of the
    others one every DRIFT places at most, which is as far as verification
    looks for passages around an offset. Those that stay reach back as far as the first, so they
    hold all passages of those that go.
    """
    n = len(centre)
    if n < 3:
        return centre, left, right
    total = np.concatenate([[np.uint64(0)], np.cumsum(sh, dtype=np.uint64)])
    doc = np.searchsorted(first, centre, "right")
    period, text, value = np.diff(centre), np.diff(total[centre]), h[centre]
    tied = (value[1:] == value[:-1]) & (doc[1:] == doc[:-1]) & (period <= DRIFT)
    inner = np.zeros(n, bool)
    inner[1:-1] = tied[:-1] & tied[1:] & (period[:-1] == period[1:]) & (text[:-1] == text[1:])
    at = np.arange(n)
    # what an inner window, or the one after it, goes back to: the last window before that isn't inner
    begin = at.copy()
    begin[1:] = np.where(inner[1:] | inner[:-1], np.maximum.accumulate(np.where(inner, 0, at))[np.where(inner[1:], at[1:], at[:-1])], at[1:])
    step = np.zeros(n, np.int64)
    step[1:] = (centre[1:] - centre[begin[1:]]) // np.maximum(1, DRIFT + 1 - period)
    keep = ~inner
    keep[1:] |= step[1:] != step[:-1]
    return centre[keep], left[begin[keep]], right[keep]


def _context(sh: np.ndarray, first: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Eight bytes for each centre: runs of RUN shingles before it (nearest first), then after it; 0 where the text ends."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(sh, dtype=np.uint64)])
    doc = np.searchsorted(first, centre, "right") - 1
    begin, end = first[doc], first[doc + 1]
    out = np.zeros(len(centre), np.uint64)
    for k in range(8):
        lo = centre - RUN * (k + 1) if k < 4 else centre + 1 + RUN * (k - 4)
        hi = lo + RUN
        ok = (lo >= begin) & (hi <= end)
        part = total[np.where(ok, hi, 0)] - total[np.where(ok, lo, 0)]
        byte = (mix(part) >> np.uint64(40)) % np.uint64(255) + np.uint64(1)
        out |= np.where(ok, byte, np.uint64(0)) << np.uint64(8 * k)
    return out


def _windows(size: int, width: int, functions: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sh, first = shingles(words(*text_bytes(strings(part.column(part.schema.get_field_index("text"))))), size)
                ids = part.column(part.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
                cols = [[] for _ in range(6)]
                for f in range(functions):
                    h = mix(sh ^ _SALT[f])
                    c, lo, hi = _thin(sh, h, first, *compact_windows(h, first, width))
                    doc = np.searchsorted(first, c, "right") - 1
                    at = first[doc]
                    for col, v in zip(cols, (h[c].view(np.int64), _context(sh, first, c).view(np.int64), ids[doc].astype(np.int64), (c - at).astype(np.int32), (c - lo).astype(np.int32), (hi - c).astype(np.int32))):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["key", "context", "doc", "c", "before", "after"])

    return run


_MET = "key long, context long, doc long, c int, before int, after int, hub long, shift int, lo int, hi int, same int"
_WINDOW = ["key", "context", "doc", "c", "before", "after"]


def _first(batches):
    """All windows of values that several documents have, with how they overlap with the first window of the least document (the hub).

    Input is sorted by (key, salt, doc, c), a window that was sent first; of a
    value that goes on in the next batch only the hub's windows are held.
    """
    held, told = None, False  # windows of the hub of the last value, and whether they went out already
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in [*_WINDOW, "salt", "sent"]]
        old = 0
        if held is not None:
            old, cols = len(held[0]), [np.concatenate([x, y]) for x, y in zip(held, cols)]
        key, context, doc, c, before, after, salt, sent = cols
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        start = np.flatnonzero(new)
        at = np.cumsum(new) - 1
        h = start[at]
        own = doc == doc[h]
        several = (np.bincount(at[~own], minlength=len(start)) > 0) | sent[start]  # a window that was sent stands for others elsewhere
        several[0] |= told
        go = several[at] & ~sent
        if told:
            go[:old] = False
        last = int(start[-1])
        end = last + int(own[last:].sum())
        told = bool(several[-1])
        held = [x[last : last + 1 if told else end].copy() for x in cols]
        i = np.flatnonzero(go)
        if not len(i):
            continue
        h = h[i]
        runs, other = (context[k].view(np.uint8).reshape(-1, 8) for k in (i, h))
        same = ((runs == other) & (runs != 0)).sum(1).astype(np.int32)
        found = [*(x[i] for x in cols[:6]), doc[h], c[i] - c[h], c[i] - np.minimum(before[i], before[h]), c[i] + np.minimum(after[i], after[h]), same]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=[f.split()[0] for f in _MET.split(", ")])


def _met(win: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """All windows of values that several documents have, with the first window of the least document (the hub).

    Windows of ``hot`` values are dealt to SALTS groups, to each of which the hub's window is sent.
    """
    if hot is None:
        rows = win.select(*_WINDOW, F.lit(0).alias("salt"), F.lit(False).alias("sent"))
    else:
        many, rest = (win.join(F.broadcast(hot), "key", how) for how in ("left_semi", "left_anti"))  # see _hot for the bound
        own = many.groupBy("key").agg(F.min(F.struct("doc", "c", "context", "before", "after")).alias("h"), F.max("doc").alias("last")).filter("h.doc < last")
        sent = own.select("key", "h.context", "h.doc", "h.c", "h.before", "h.after", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("sent"))
        salt = F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt")
        rows = rest.select(*_WINDOW, F.lit(0).alias("salt"), F.lit(False).alias("sent")).unionByName(many.select(*_WINDOW, salt, F.lit(False).alias("sent"))).unionByName(sent)
    return arrow_map(rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "doc", "c", F.desc("sent")), _first, _MET)


def _every(batches):
    """(hub, doc, shift, lo, hi): open windows with all windows that the least document has there, and, if those aren't open, with all windows of the least open document.

    Input is sorted by (key, doc, c), and all windows are open but the
    least document's; of a value that goes on in the next batch only the
    windows of these two documents are held.
    """
    names = ["key", "doc", "c", "before", "after", "open"]
    held = None
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
        old = 0
        if held is not None:
            old, cols = len(held[0]), [np.concatenate([x, y]) for x, y in zip(held, cols)]
        key, doc, c, before, after, is_open = cols
        n = len(key)
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        # runs of one document; the first of a value is the hub's, the second the least open document's
        run = new.copy()
        run[1:] |= doc[1:] != doc[:-1]
        begin = np.flatnonzero(run)
        end = np.append(begin[1:], n)
        of = np.cumsum(run) - 1
        first = of[np.flatnonzero(new)][np.cumsum(new) - 1]
        second = np.minimum(first + 1, len(begin) - 1)
        last = int(np.flatnonzero(new)[-1])
        upto = int(end[second[-1]]) if not is_open[last] else int(end[first[-1]])
        fresh = np.arange(n) >= old
        for hub, go in ((first, of > first), (second, (of > first + 1) & ~is_open[begin[first]])):
            q = np.flatnonzero(go & fresh)
            size = end[hub[q]] - begin[hub[q]]
            total = np.cumsum(size)
            a = 0
            while a < len(q):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
                i = np.repeat(q[a:b], size[a:b])
                h = np.arange(len(i)) - np.repeat(total[a:b] - size[a:b] - (total[a - 1] if a else 0), size[a:b]) + begin[hub[i]]
                yield _spans(doc[h], doc[i], c[i] - c[h], c[i] - np.minimum(before[i], before[h]), c[i] + np.minimum(after[i], after[h]))
                a = b
        held = [x[last:upto].copy() for x in cols]


def _spans(hub: np.ndarray, doc: np.ndarray, shift: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Overlaps merged by documents and offset."""
    order = np.lexsort((shift, doc, hub))
    hub, doc, shift, lo, hi = (x[order] for x in (hub, doc, shift, lo, hi))
    new = np.ones(len(hub), bool)
    new[1:] = (hub[1:] != hub[:-1]) | (doc[1:] != doc[:-1]) | (shift[1:] != shift[:-1])
    at = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (hub[at], doc[at], shift[at], np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at))], names=["hub", "doc", "shift", "lo", "hi"])


def _near_hub(left: DataFrame) -> DataFrame:
    """(hub, doc, shift, lo, hi): open windows and all windows of the least document of their value, and of the least open one.

    ``left`` has windows (key, doc, c, before, after, open).
    """
    return arrow_map(left.repartition("key").sortWithinPartitions("key", "doc", "c"), _every, "hub long, doc long, shift int, lo int, hi int")


def _hot(win: DataFrame) -> DataFrame | None:
    """Values that are likely to have HOT windows or more, by one document in SAMPLE; None without any.

    Which values are found here changes no result, only how their windows meet.
    There are at most as many as the windows of the sample divided by
    HOT / SAMPLE, and the set is cut there where a broadcast would end: the
    most frequent stay.
    """
    some = win.filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT // SAMPLE)
    hot, _ = save(some.orderBy(F.desc("n"), "key").limit(BROADCAST_ROWS).select("key"))
    return None if hot.isEmpty() else hot


def _sides(df: DataFrame, runs: int, shown: int = 0) -> DataFrame:
    """A row for each side of a window that has so many runs of context, with them, or with as many as are ``shown``."""
    side = lambda shift: F.shiftrightunsigned("context", shift).bitwiseAND((1 << 8 * max(runs, shown)) - 1)
    return df.withColumn("side", F.explode(F.array(F.struct(F.lit(0).alias("k"), side(0).alias("v")), F.struct(F.lit(1).alias("k"), side(32).alias("v"))))).filter(F.col("side.v") >= 1 << 8 * (runs - 1))


def _merged(spans: DataFrame) -> DataFrame:
    """(hub, doc, offsets): offsets holds (shift, lo, hi) of the merged overlaps, in places of doc."""
    spans = spans.groupBy("hub", "doc", "shift").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return spans.groupBy("hub", "doc").agg(F.sort_array(F.collect_list(F.struct("shift", "lo", "hi"))).alias("offsets"))


def _candidates(met: DataFrame) -> DataFrame:
    """Documents to compare: windows with their hub, and with a second one where they differ from it."""
    other = met.filter("doc <> hub")
    rest = _sides(other.filter("same < 2").select("key", "context", "doc", "c", "before", "after"), 2)
    again = _met(rest.withColumn("key", F.xxhash64("key", "side")).drop("side")).filter("doc <> hub")
    spans = [df.filter("same >= 2").select("hub", "doc", "shift", "lo", "hi") for df in (other, again)]
    return _merged(spans[0].unionByName(spans[1]))


def _exact(size: int, need: int):
    """Hashes of the stretches of ``need`` shingles around given centres, inside their windows."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sh, first = shingles(words(*text_bytes(strings(part.column(part.schema.get_field_index("text"))))), size)
                spots = part.column(part.schema.get_field_index("spots"))
                ends = spots.offsets.to_numpy()
                flat = spots.flatten()
                doc = np.repeat(np.arange(len(part)), np.diff(ends))
                c, lo, hi = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("c", "lo", "hi"))
                begin = first[doc] + np.maximum(np.maximum(lo, c - need + 1), 0)
                end = np.minimum(first[doc] + np.minimum(c, hi - need + 1), first[doc + 1] - need)
                ok = begin <= end
                step = np.zeros(len(sh) + 1, np.int64)
                np.add.at(step, begin[ok], 1)
                np.add.at(step, end[ok] + 1, -1)
                at = np.flatnonzero(np.cumsum(step)[: len(sh)] > 0)
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(sh), dtype=np.uint64)])
                own = np.searchsorted(first, at, "right") - 1
                ids = part.column(part.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(mix(total[at + need] - total[at]).view(np.int64)), pa.array(ids[own]), pa.array((at - first[own]).astype(np.int32))], names=["key", "doc", "lo"])

    return run


def _covered(links: DataFrame, size: int) -> DataFrame:
    """(d, s, from, to): places of d that verified passages shared with s cover."""
    return links.select(F.col("doc_id").alias("d"), F.col("source_id").alias("s"), F.col("start").alias("from"), (F.col("start") + F.col("n_words") - size).alias("to")).distinct()


def _still_open(met: DataFrame, links: DataFrame, size: int) -> tuple[DataFrame, str]:
    """The windows of ``met`` whose centre no verified passage shared with their hub covers, saved."""
    seen, seen_at = save(_covered(links, size))
    covered = (F.col("doc") == F.col("d")) & (F.col("hub") == F.col("s")) & F.col("c").between(F.col("from"), F.col("to"))
    still, still_at = save(met.filter("doc <> hub").select(*_WINDOW, "hub").join(small(seen), covered, "left_anti"))
    drop(met.sparkSession, seen_at)
    return still, still_at


def _again(met: DataFrame, still: DataFrame) -> DataFrame:
    """Documents to compare since an open window shares two runs on a side with another window of its value.

    Open windows meet all windows of their hub, of which only the first was
    tried, and then each other without it.
    """
    left = still.drop("hub").withColumn("open", F.lit(True)).unionByName(met.filter("doc = hub").select(*_WINDOW, F.lit(False).alias("open")))
    left = _sides(left, 2).withColumn("key", F.xxhash64("key", "side")).drop("side", "context")
    return save(_merged(_near_hub(left)))[0]


def _around(size: int, reach: int):
    """The shingles, 16 bits each, up to ``reach`` places before and after each of given centres."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sh, first = shingles(words(*text_bytes(strings(part.column(part.schema.get_field_index("text"))))), size)
                short = (sh >> np.uint64(48)).astype(np.uint16)
                spots = part.column(part.schema.get_field_index("spots"))
                flat = spots.flatten()
                doc = np.repeat(np.arange(len(part)), np.diff(spots.offsets.to_numpy()))
                c = flat.field("c").to_numpy(zero_copy_only=False).astype(np.int64)
                lo, hi = first[doc] + np.maximum(c - reach, 0), np.minimum(first[doc] + c + reach + 1, first[doc + 1])
                near = pa.array([short[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist())], pa.binary())
                own = part.column(part.schema.get_field_index("doc_id")).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([own, near, *(flat.field(k) for k in ("key", "c", "before", "after", "cls"))], names=["doc", "near", "key", "c", "before", "after", "cls"])

    return run


def _alike_around(least: int):
    """(hub, doc, shift, lo, hi): windows of different documents and classes, with ``least`` places or more around each centre whose shingles are around the other.

    Input is sorted by (key, bi, bj), blocks of the windows of a value; no more
    than two are held. A window without a class is one of its own.
    """

    def group(rows: list[tuple], same: bool) -> list[np.ndarray]:
        cut = len(rows) if same else sum(r[0] == rows[0][0] for r in rows)
        _, doc, c, before, after, cls, near = zip(*rows)
        cls = np.array([k if x is None else x for k, x in enumerate(cls)]), np.array([x is None for x in cls])
        doc, c, before, after = map(np.array, (doc, c, before, after))
        near = [np.frombuffer(x, np.uint16) for x in near]
        ok = common(near[:cut], None if same else near[cut:], True) >= least
        ok &= (ok if same else common(near[cut:], near[:cut], True) >= least).T
        i, j = np.nonzero(np.triu(ok, 1) if same else ok)
        j += 0 if same else cut
        go = (doc[i] != doc[j]) & ((cls[0][i] != cls[0][j]) | cls[1][i] | cls[1][j])
        i, j = i[go], j[go]
        i, j = np.where(doc[i] < doc[j], i, j), np.where(doc[i] < doc[j], j, i)
        return [doc[i], doc[j], c[j] - c[i], c[j] - np.minimum(before[i], before[j]), c[j] + np.minimum(after[i], after[j])]

    def run(batches):
        key, own = None, []

        def out():
            if len(own) > 1 and (key[1] == key[2] or own[0][0] != own[-1][0]):
                spans = group(own, key[1] == key[2])
                if len(spans[0]):
                    yield _spans(*(x.astype(t) for x, t in zip(spans, (np.int64, np.int64, np.int32, np.int32, np.int32))))

        for batch in batches:
            for k, bi, bj, *row in zip(*(x.to_pylist() for x in batch.columns)):
                if (k, bi, bj) != key:
                    yield from out()
                    key, own = (k, bi, bj), []
                own.append(row)
        yield from out()

    return run


def _third(docs: DataFrame, every: DataFrame, links: DataFrame, size: int, need: int) -> DataFrame:
    """Spans of windows that share their value and two runs on a side, if what is around both is much alike.

    A window that a verified passage covers has the class of its document, and
    two of a class aren't compared: both are in the result, and connected. Only
    values that three documents have are of use: two met each other. Windows
    with the same text around them count once. What a value has in windows is
    dealt to blocks of GROUP, and each pair of blocks is compared.
    """
    spark = docs.sparkSession
    many = every.select("key", "doc").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").select("key")
    part, part_at = save(_classes(links))
    end = lambda start, n: F.struct(F.col(start).alias("from"), (F.col(start) + F.col(n) - size).alias("to"))
    found = links.select("doc_id", end("start", "n_words").alias("x")).unionByName(links.select(F.col("source_id").alias("doc_id"), end("source_start", "source_words").alias("x")))
    found, found_at = save(found.groupBy("doc_id").agg(F.collect_set("x").alias("xs")).join(part, "doc_id").select(F.col("doc_id").alias("d"), "class_id", "xs"))
    rows = every.join(small(many), "key", "left_semi").groupBy("key", "doc", "c").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    rows = rows.join(small(found, held=F.size("xs")), F.col("doc") == F.col("d"), "left")
    covered = F.exists("xs", lambda x: F.col("c").between(x["from"], x["to"]))
    rows, rows_at = save(rows.select("key", "doc", "c", "before", "after", F.when(covered, F.col("class_id")).alias("cls")))
    apart = rows.groupBy("key").agg(F.min("cls").alias("x"), F.max("cls").alias("y"), F.count_if(F.isnull("cls")).alias("own"), F.min("doc").alias("a"), F.max("doc").alias("b"))
    apart = apart.filter("a < b AND (own > 0 OR x < y)").select("key")
    spots, spots_at = save(rows.join(small(apart), "key", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("key", "c", "before", "after", "cls")).alias("spots")))
    texts = docs.join(small(spots, held=F.size("spots")), docs["doc_id"] == spots["doc"]).select("doc_id", "text", "spots")
    texts = arrow_map(texts, _around(size, need - 1), "doc long, near binary, key long, c int, before int, after int, cls long")
    near, near_at = save(texts.groupBy("key", "near").agg(F.min(F.struct("doc", "c", "before", "after")).alias("w"), F.min("cls").alias("cls")).select("key", "w.*", "cls", "near"))
    blocks = near.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("blocks"), F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("key", "blocks")
    sent = near.join(small(blocks), "key").withColumn("block", F.pmod(F.xxhash64("near"), F.col("blocks")).cast("int"))
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("key", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "doc", "c", "before", "after", "cls", "near")
    sent = sent.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "block", "doc", "c")
    spans, _ = save(arrow_map(sent, _alike_around(need - need // 9), "hub long, doc long, shift int, lo int, hi int"))
    drop(spark, part_at, found_at, rows_at, spots_at, near_at)
    return spans


def _classes(links: DataFrame) -> DataFrame:
    """(doc_id, class_id): the least of the documents that verified passages connect."""
    part = components(links.select(F.col("doc_id").alias("a"), F.col("source_id").alias("b")))
    name = part.groupBy("component").agg(F.min("node").alias("class_id"))
    return part.join(name, "component").select(F.col("node").alias("doc_id"), "class_id")


def _missed(docs: DataFrame, met: DataFrame, still: DataFrame, links: DataFrame, size: int, need: int) -> DataFrame:
    """Documents to compare since an open window is much like another one, or holds an equal stretch of ``need`` shingles around its centre.

    Windows that share two runs of context with an open window on one side take
    part; for stretches three, since half of an equal stretch or more lies on
    one side of the centre.
    """
    third = F.shiftrightunsigned("side.v", 16).alias("third")
    hashed = lambda some: _sides(some, 2, 3).select(F.xxhash64("key", F.struct("side.k", F.col("side.v").bitwiseAND(0xFFFF))).alias("key"), third, "doc", "c", "before", "after")
    left, left_at = save(hashed(still).withColumn("open", F.lit(True)))
    others = hashed(met).join(small(left.select("key").distinct()), "key", "left_semi").withColumn("open", F.lit(False))
    every, every_at = save(left.unionByName(others))
    near = _third(docs, every, links, size, need)
    own = Window.partitionBy("key", "third")
    some = every.filter("third > 0").withColumn("least", F.min("doc").over(own)).withColumn("last", F.max("doc").over(own)).withColumn("alive", F.max("open").over(own)).filter("least < last AND alive")
    spot = F.struct("c", (F.col("c") - F.col("before")).alias("lo"), (F.col("c") + F.col("after")).alias("hi"))
    spots, spots_at = save(some.groupBy("doc").agg(F.collect_set(spot).alias("spots")))
    rows = docs.join(small(spots, held=F.size("spots")), docs["doc_id"] == spots["doc"]).select("doc_id", "text", "spots")
    keys, keys_at = save(arrow_map(rows, _exact(size, need), "key long, doc long, lo int"))
    hubs = keys.groupBy("key").agg(F.min(F.struct("doc", "lo")).alias("hub"), F.max("doc").alias("last")).filter("hub.doc < last").select("key", "hub")
    spans = keys.join(hubs, "key").filter("doc <> hub.doc").select(F.col("hub.doc").alias("hub"), "doc", (F.col("lo") - F.col("hub.lo")).alias("shift"), "lo", (F.col("lo") + need - 1).alias("hi"))
    seen, seen_at = save(_covered(links, size))
    known = (F.col("doc") == F.col("d")) & (F.col("hub") == F.col("s")) & (F.col("lo") >= F.col("from")) & (F.col("hi") <= F.col("to"))
    pairs, _ = save(_merged(spans.unionByName(near).join(small(seen), known, "left_anti")))
    drop(docs.sparkSession, seen_at, left_at, every_at, spots_at, keys_at)
    release(docs.sparkSession)
    return pairs


def _fetch(size: int):
    """The shingles, 32 bits each, of every document of a batch."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sh, first = shingles(words(*text_bytes(strings(part.column(part.schema.get_field_index("text"))))), size)
                short = (sh >> np.uint64(32)).astype(np.uint32)
                own = [short[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(own, pa.binary())], names=["doc", "shingles"])

    return run


def _longest(e: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Disjoint longest stretches of ``need`` places or more with at least eight ninths matches (Jaccard 0.8 when aligned)."""
    if 9 * np.count_nonzero(e) < 8 * need:
        return []
    out, todo = [], [(0, len(e))]
    while todo:
        a, b = todo.pop()
        while a < b and not e[a]:
            a += 1
        while b > a and not e[b - 1]:
            b -= 1
        if b - a < need:
            continue
        own = e[a:b]
        if 9 * int(own.sum()) >= 8 * (b - a):
            out.append((a, b))
            continue
        s = np.concatenate([[0], np.cumsum(np.where(own, 1, -8))])
        # for each end, the first start with a prefix sum not above it
        low = np.minimum.accumulate(s)
        start = np.searchsorted(-low, -s, "left")
        width = np.arange(len(s)) - start
        k = int(width.argmax())
        if width[k] < need:
            continue
        i, j = a + int(start[k]), a + k
        while not e[i]:
            i += 1
        while not e[j - 1]:
            j -= 1
        if j - i >= need:
            out.append((i, j))
        todo += [(a, i), (j, b)]
    return out


def _rising(x: np.ndarray, at: np.ndarray) -> list[int]:
    """Places of a longest rising chain of ``x``, last first; ``x`` falls where ``at``, which rises, is the same."""
    turn = np.flatnonzero(np.diff(at)) + 1
    if len(x) > MANY * (len(turn) + 1):  # the places of one ``at`` at once: a smaller one doesn't see what larger ones changed
        ends, used = np.full(len(turn) + 2, np.iinfo(np.int64).max), 0
        level = np.empty(len(x), np.int64)
        cuts = [0, *turn.tolist(), len(x)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            own = x[lo:hi]
            level[lo:hi] = k = ends[: used + 1].searchsorted(own)
            ends[k] = own  # of one level the last, the least, stays
            used = max(used, int(k[0]) + 1)
        levels = level.tolist()
    else:
        tops: list[int] = []
        levels = []
        for v in x.tolist():
            k = bisect_left(tops, v)
            levels.append(k)
            if k == len(tops):
                tops.append(v)
            else:
                tops[k] = v
        used = len(tops)
    # before a place of one level, the chain has the latest place of the level below
    levels.reverse()
    out, k = [], -1
    for want in range(used - 1, -1, -1):
        k = levels.index(want, k + 1)
        out.append(len(levels) - 1 - k)
    return out


def _matched(a: np.ndarray, b: np.ndarray, low: int, high: int, need: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal shingles, rising in both, as many as possible, at offsets (place in b less place in a) from low to high; none if no stretch of ``need`` can come of them."""
    order = np.argsort(a, kind="stable")
    ranked = a[order]
    left, right = np.searchsorted(ranked, b, "left"), np.searchsorted(ranked, b, "right")
    many = right - left
    if not _dense(np.flatnonzero(many), need):
        return order[:0], order[:0]
    if many.sum() <= 8 * (len(a) + len(b)):
        j = np.repeat(np.arange(len(b)), many)
        i = order[np.arange(len(j)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(left, many)]
        fit = (j - i >= low) & (j - i <= high)
        i, j = i[fit], j[fit]
    else:  # shingles that occur again and again: one offset after another
        found = []
        for shift in range(max(low, -len(a)), min(high, len(b)) + 1):
            x, y = max(shift, 0), min(len(b), len(a) + shift)
            if x < y:
                at = x + np.flatnonzero(a[x - shift : y - shift] == b[x:y])
                found.append((at - shift, at))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    if not (_dense(j, need) and _dense(i, need)):
        return i[:0], j[:0]
    order = np.lexsort((-i, j))
    i, j = i[order], j[order]
    if len(i) > 1 and not ((np.diff(i) > 0) & (np.diff(j) > 0)).all():
        # what lies above all before it and below all after it is in the longest chain; in between it is searched
        sure = np.ones(len(i), bool)
        sure[1:] = i[1:] > np.maximum.accumulate(i)[:-1]
        sure[:-1] &= i[:-1] < np.minimum.accumulate(i[::-1])[::-1][1:]
        loose = np.flatnonzero(~sure)
        keep = sure.copy()
        for part in np.split(loose, np.flatnonzero(np.diff(loose) > 1) + 1):
            keep[part[_rising(i[part], j[part])]] = True
        i, j = i[keep], j[keep]
    return i, j


def _dense(x: np.ndarray, need: int) -> bool:
    """Whether some stretch of ``need`` places or more has four fifths of its places among ``x``: any that :func:`_stretches` finds has, on both sides."""
    if len(x) < max(1, 0.8 * need):
        return False
    e = np.zeros(int(x.max() - x.min()) + 1, np.int64)
    e[x - x.min()] = 1
    s = np.concatenate([[0], np.cumsum(5 * e - 4)])
    return len(s) > need and bool((s[need:] >= np.minimum.accumulate(s)[: len(s) - need]).any())


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of the shingles of two stretches."""
    if len(a) == len(b) and (a == b).all():
        return (n := len(set(a.tolist()))), n
    u, v = set(a.tolist()), set(b.tolist())
    both = len(u & v)
    return both, len(u) + len(v) - both


def _stretches(i: np.ndarray, j: np.ndarray, need: int) -> list[tuple[int, int, int, int]]:
    """Disjoint longest stretches (a from, a to, b from, b to) of matched places, ``need`` wide in both, in which matches are four ninths of both widths or more (Jaccard 0.8)."""
    out, todo = [], [(0, len(i))]
    score = 9 * np.arange(len(i)) - 4 * (i + j)
    while todo:
        x, y = todo.pop()
        if y - x < 2 or min(i[y - 1] - i[x], j[y - 1] - j[x]) + 1 < need:
            continue
        # a stretch from k to e has 9 (e - k + 1) >= 4 (both widths) if the score at e, and one, is not below that at k
        own = score[x:y]
        first = np.minimum(np.searchsorted(-np.minimum.accumulate(own), -(own + 1), "left"), np.arange(y - x))
        width = np.minimum(i[x:y] - i[x + first], j[x:y] - j[x + first]) + 1
        e = int(width.argmax())
        if width[e] < need:
            continue
        k = x + int(first[e])
        e += x
        out.append((int(i[k]), int(i[e]) + 1, int(j[k]), int(j[e]) + 1))
        todo += [(x, k), (e + 1, y)]
    return out


def passages(a: np.ndarray, b: np.ndarray, offsets: list[tuple[int, int, int]], need: int) -> list[tuple[int, int, int, int, float]]:
    """Verified passages (a from, a to, b from, b to, similarity) within merged overlaps (shift, lo, hi) in places of b."""
    found, known = [], {}

    def alike(p: tuple[int, int, int, int]) -> tuple[int, int]:
        if p not in known:
            known[p] = _alike(a[p[0] : p[1]], b[p[2] : p[3]])
        return known[p]

    for shift, lo, hi in offsets:
        lo, hi = max(lo, shift, 0), min(hi + 1, len(b), len(a) + shift)
        if hi - lo >= need:
            for i, j in _longest(a[lo - shift : hi - shift] == b[lo:hi], need):
                found.append((lo - shift + i, lo - shift + j, lo + i, lo + j))
    # neighbouring offsets: words were inserted or deleted in between
    k = 0
    while k < len(offsets):
        end = k
        while end + 1 < len(offsets) and offsets[end + 1][0] - offsets[end][0] <= DRIFT:
            end += 1
        if end > k:
            own = offsets[k : end + 1]
            lo, hi = max(0, min(o[1] for o in own)), min(len(b), max(o[2] for o in own) + 1)
            alo, ahi = max(0, min(o[1] - o[0] for o in own)), min(len(a), max(o[2] - o[0] for o in own) + 1)
            x, y = a[alo:ahi].tolist(), b[lo:hi].tolist()
            if shared := set(x).intersection(y):
                ends = lambda z, at: (at + next(k for k, s in enumerate(z) if s in shared), at + len(z) - next(k for k, s in enumerate(reversed(z)) if s in shared))  # noqa: B023, E731
                one = (*ends(x, alo), *ends(y, lo))
                if min(one[1] - one[0], one[3] - one[2]) >= need:
                    both, union = alike(one)
                    if 5 * both >= 4 * union:
                        found.append(one)
        # parts of the chain: what lies between two passages must not spoil both
        own = offsets[k : end + 1]
        lo, hi = max(0, min(o[1] for o in own)), min(len(b), max(o[2] for o in own) + 1)
        if hi - lo >= need and not any(p[2] <= lo and hi <= p[3] for p in found):
            low, high = own[0][0] - DRIFT, own[-1][0] + DRIFT
            alo, ahi = max(0, lo - high), min(len(a), hi - low)
            i, j = _matched(a[alo:ahi], b[lo:hi], low + alo - lo, high + alo - lo, need)
            for one in _stretches(i + alo, j + lo, need):
                both, union = alike(one)
                if one not in found and 5 * both >= 4 * union:
                    found.append(one)
        k = end + 1
    # merge what overlaps in b along nearly the same offset
    out = []
    for p in sorted(found, key=lambda p: (p[2] - p[0], p[2])):
        if out and p[2] <= out[-1][3] and p[0] <= out[-1][1] and abs((p[2] - p[0]) - (out[-1][2] - out[-1][0])) <= DRIFT:
            q = out[-1]
            out[-1] = (min(q[0], p[0]), max(q[1], p[1]), min(q[2], p[2]), max(q[3], p[3]))
        else:
            out.append(p)
    rows = {}
    each = np.array(found, np.int64).reshape(-1, 4)
    for p in out:
        both, union = alike(p)
        if 5 * both >= 4 * union:
            rows[p] = both / union
        else:
            for k in np.flatnonzero((each[:, 0] >= p[0]) & (each[:, 1] <= p[1]) & (each[:, 2] >= p[2]) & (each[:, 3] <= p[3])).tolist():
                if found[k] not in rows:
                    x = found[k]
                    both, union = alike(x)
                    rows[x] = both / max(1, union)
    return [(*p, share) for p, share in rows.items()]


def _verify(need: int, size: int):
    def run(batches):
        for batch in batches:
            rows = []
            hubs, docs, spans, own, other = batch.columns
            flat = list(zip(*(spans.flatten().field(k).to_pylist() for k in ("shift", "lo", "hi"))))
            ends = (spans.offsets.to_numpy() - spans.offsets[0].as_py()).tolist()
            for hub, doc, x, y, b, a in zip(hubs.to_pylist(), docs.to_pylist(), ends[:-1], ends[1:], own.to_pylist(), other.to_pylist()):
                a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                for p in passages(a, b, flat[x:y], need):
                    rows.append((doc, p[2], p[3] - p[2] + size - 1, hub, p[0], p[1] - p[0] + size - 1, p[4]))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.float64())], names=["doc_id", "start", "n_words", "source_id", "source_start", "source_words", "similarity"])

    return run


def _links(docs: DataFrame, pairs: DataFrame, size: int, need: int) -> DataFrame:
    """Verified passages of the pairs of documents."""
    ids = pairs.select("doc").union(pairs.select("hub")).distinct()
    wanted = docs.join(small(ids), docs["doc_id"] == ids["doc"], "left_semi")
    own, own_at = save(arrow_map(wanted, _fetch(size), "doc long, shingles binary"))
    sides = pairs.join(own, "doc").join(own.select(F.col("doc").alias("hub"), F.col("shingles").alias("hub_shingles")), "hub")
    sides = sides.select("hub", "doc", "offsets", "shingles", "hub_shingles")
    links, _ = save(arrow_map(sides, _verify(need, size), "doc_id long, start long, n_words long, source_id long, source_start long, source_words long, similarity double"))
    drop(docs.sparkSession, own_at)
    release(docs.sparkSession)
    return links


def find(docs: DataFrame, min_words: int = MIN_WORDS, size: int = SIZE, functions: int = FUNCTIONS) -> DataFrame:
    """Repeated passages of all documents; see the module's text."""
    spark = docs.sparkSession
    need = min_words - size + 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    win, win_at = save(arrow_map(docs, _windows(size, need, functions), "key long, context long, doc long, c int, before int, after int"))
    met, met_at = save(_met(win, _hot(win)))
    drop(spark, win_at)
    release(spark)
    pairs, pairs_at = save(_candidates(met))
    links = _links(docs, pairs, size, need)
    still, still_at = _still_open(met, links, size)
    more = _links(docs, _again(met, still), size, need)
    links = links.unionByName(more)
    rest, rest_at = _still_open(still, more, size)
    missed = _missed(docs, met, rest, links, size, need)
    drop(spark, met_at, pairs_at, still_at, rest_at)
    links = links.unionByName(_links(docs, missed, size, need))
    part = _classes(links)
    rows = links.select("doc_id", "start", "n_words", "source_id", "source_start", "similarity")
    heads = links.select(F.col("source_id").alias("doc_id"), F.col("source_start").alias("start"), F.col("source_words").alias("n_words"), "source_id", "source_start", F.lit(1.0).alias("similarity")).distinct()
    return rows.distinct().unionByName(heads).join(part, "doc_id")
