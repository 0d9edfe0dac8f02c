"""Best-fit packing: a grouping genetic algorithm over bins of ``capacity`` tokens.

Documents are tokenized, closed by ``end_id`` and cut into pieces of
``capacity`` tokens only if they are longer; full pieces are sequences already.
The others are dealt to cells of about ``CELL`` pieces by hash, so that no cell
depends on any key. Each cell is solved by ``ISLANDS`` islands, each with a
population of its own that begins with best-fit groupings of the pieces in
random orders. A generation breeds one child: crossover injects whole
well-filled bins of one parent into the other, bins that hold a piece twice are
dissolved, poorly filled ones are emptied now and then, and displaced pieces
are put back best-fit, the largest first. The child takes the place of the
worst. An island stops where it reaches the lower bound (all tokens over the
capacity). Between epochs the populations stay, and the elite of every island
migrates to the next one, where it takes the place of the worst. In the last
epoch a best-fit decreasing grouping takes the place of the worst but the guest,
so that no cell has more sequences than that.

Of each cell's best grouping, bins that are filled to ``FULL`` are final. The
emptiest others, up to half of the cell's pieces, are dealt anew to fewer
cells, level by level, until one cell is left; the number of levels is
logarithmic.

Nulls: a null text is an empty one, a piece of one token. Repeated rows are
pieces of their own. Pieces are named by the row they came from, not by doc_id,
so null and repeated doc_ids and ties do no harm; only doc_id and text of the
input are read, whatever its other columns are. An empty table has no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import ship
from .shared import arrow_map, drop, save, slices, strings

CAPACITY, END_ID, VOCABULARY = 4096, 1, "word_bpe_49k.json"
CELL, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4096, 2, 2, 16, 6
#: A bin this full is final.
FULL = 0.999
#: Bytes of text whose distinct chunks are encoded together, and chunks in one call.
SLICE, JOINED = 6 << 20, 2_000
#: Stands between chunks that are encoded as one text; white space around it makes it a word of one token.
MARK = "\x01"
_loaded: dict[str, tuple] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoder(path: str):
    if path not in _loaded:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _loaded[path] = (tokenizer, tokenizer.encode(MARK, add_special_tokens=False).ids)
    return _loaded[path]


def _encode(chunks: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks, one after another, and how many each has."""
    tokenizer, mark = _encoder(path)
    size = np.zeros(len(chunks), np.int64)
    pools = []
    for k in range(0, len(chunks), JOINED):
        own = chunks[k : k + JOINED]
        joined = f" {MARK} ".join(own)
        ids = np.array(tokenizer.encode(joined, add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(ids == mark[0]) if len(mark) == 1 else []
        if len(ends) == len(own) - 1:
            pools.append(np.delete(ids, ends))
            size[k : k + len(own)] = np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
        else:  # a chunk holds the mark itself
            each = [e.ids for e in tokenizer.encode_batch(own, add_special_tokens=False)]
            pools += [np.array(x, np.uint32) for x in each]
            size[k : k + len(own)] = [len(x) for x in each]
    return np.concatenate(pools) if pools else np.zeros(0, np.uint32), size


#: A Latin word and signs behind it, no apostrophe and no part of a special token: two words of the
#: vocabulary's own splitting rule, already in composed form, with plain lower case.
_SIMPLE = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-&(-/:;=?-@\[-`{}~]*)$"


def _bytes_as_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(odd)}


_LETTERS = _bytes_as_letters()


def chunk_ids(chunks: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct chunks, one after another, and how many each has.

    Each distinct word of simple chunks, and each distinct run of signs, goes
    through the vocabulary's merges once; all other chunks are encoded as they are.
    """
    model = _encoder(path)[0].model
    parts = pc.extract_regex(chunks, _SIMPLE)
    simple = parts.is_valid().to_numpy(zero_copy_only=False)
    word = pc.dictionary_encode(pc.utf8_lower(pc.struct_field(parts, "word").filter(parts.is_valid())))
    signs = pc.dictionary_encode(pc.struct_field(parts, "signs").filter(parts.is_valid()))
    texts = [*word.dictionary.to_pylist(), *signs.dictionary.to_pylist()]
    own = [[t.id for t in model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_LETTERS))] if w else [] for w in texts]
    other, other_size = _encode(chunks.filter(pa.array(~simple)).to_pylist(), path)
    size = np.array([len(x) for x in own] or [0], np.int64)
    pool = np.concatenate([np.fromiter((i for x in own for i in x), np.uint32), other])
    begin = np.cumsum(size) - size
    # each chunk is at most two stretches of the pool
    first = np.zeros((len(chunks), 2), np.int64)
    n = np.zeros((len(chunks), 2), np.int64)
    for k, col in enumerate((word.indices.to_numpy(zero_copy_only=False), signs.indices.to_numpy(zero_copy_only=False) + len(word.dictionary))):
        first[simple, k], n[simple, k] = begin[col], size[col]
    first[~simple, 0], n[~simple, 0] = int(size.sum()) + np.cumsum(other_size) - other_size, other_size
    flat, at = n.reshape(-1), first.reshape(-1)
    return pool[np.repeat(at - (np.cumsum(flat) - flat), flat) + np.arange(int(flat.sum()))], n.sum(1)


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and where each text's begin.

    The vocabulary drops white space and splits at it, so a text's ids are
    those of its chunks between ASCII white space; each distinct chunk of a
    slice is encoded once. The ``tokenizers`` library makes all ids.
    """
    lists = pc.ascii_split_whitespace(texts)
    coded = pc.dictionary_encode(lists.flatten())
    pool, size = chunk_ids(coded.dictionary, path)
    begin = np.cumsum(size) - size
    which = coded.indices.to_numpy(zero_copy_only=False)
    n = size[which]
    total = int(n.sum())
    ids = pool[np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(total)]
    ends = np.concatenate([[0], np.cumsum(n)])
    at = lists.offsets.to_numpy().astype(np.int64)
    return ids, ends[at - at[0]]


def _cut(path: str, capacity: int, end_id: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, at = token_ids(strings(part.column(part.schema.get_field_index("text"))), path)
                rows = []
                docs = part.column(part.schema.get_field_index("doc_id")).to_pylist()
                for doc, lo, hi in zip(docs, at[:-1].tolist(), at[1:].tolist()):
                    own = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        some = own[start : start + capacity]
                        rows.append((doc, piece, start, len(some), zlib.crc32(some.tobytes())))
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], part.schema.field("doc_id").type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(sizes: np.ndarray, order: np.ndarray, number: np.ndarray, room: list[int], capacity: int) -> None:
    """Put each item, in this order, where the least room is left; opens bins as needed. ``number`` and ``room`` are changed."""
    free = sorted((r, k) for k, r in enumerate(room) if r)
    for i, need in zip(order.tolist(), sizes[order].tolist()):
        j = bisect_left(free, (need, -1))
        if j < len(free):
            left, k = free.pop(j)
            left -= need
        else:
            k, left = len(room), capacity - need
            room.append(left)
        number[i], room[k] = k, left
        if left:
            insort(free, (left, k))


class Grouping:
    """The bin of each item and the room left in each bin."""

    def __init__(self, number: np.ndarray, room: np.ndarray, capacity: int):
        self.number, self.room = number, room
        #: Fewer bins first, then fuller ones (mean of squared fill, as usual for grouping).
        self.fitness = (-len(room), float((((capacity - room) / capacity) ** 2).mean()) if len(room) else 0.0)

    @classmethod
    def of(cls, sizes: np.ndarray, order: np.ndarray, capacity: int) -> Grouping:
        number, room = np.empty(len(sizes), np.int64), []
        best_fit(sizes, order, number, room, capacity)
        return cls(number, np.array(room, np.int64), capacity)

    @classmethod
    def given(cls, sizes: np.ndarray, number: np.ndarray, capacity: int) -> Grouping:
        return cls(number, capacity - np.bincount(number, sizes, int(number.max(initial=-1)) + 1).astype(np.int64), capacity)


def crossover(sizes: np.ndarray, a: Grouping, b: Grouping, rng: np.random.Generator, capacity: int) -> Grouping:
    """Inject about half of the better-filled half of ``a``'s bins into ``b``, then put back what is displaced."""
    half = np.argsort(a.room, kind="stable")[: max(1, len(a.room) // 2)]
    taken = np.zeros(len(a.room), bool)
    taken[half[rng.random(len(half)) < 0.5]] = True
    used = taken[a.number]
    # bins of b that hold an injected item are dissolved; some poorly filled ones are emptied (mutation)
    gone = (b.room > capacity // 64) & (rng.random(len(b.room)) < 0.5)
    gone[b.number[used]] = True
    stay = ~gone[b.number] & ~used
    number = np.full(len(sizes), -1, np.int64)
    number[used] = (np.cumsum(taken) - 1)[a.number[used]]
    number[stay] = int(taken.sum()) + (np.cumsum(~gone) - 1)[b.number[stay]]
    room = [*a.room[taken].tolist(), *b.room[~gone].tolist()]
    loose = np.flatnonzero(number < 0)
    best_fit(sizes, loose[np.argsort(-sizes[loose], kind="stable")], number, room, capacity)
    return Grouping(number, np.array(room, np.int64), capacity)


def evolve(sizes: np.ndarray, people: list[Grouping], rng: np.random.Generator, capacity: int, generations: int = GENERATIONS, population: int = POPULATION) -> tuple[list[Grouping], int]:
    """The population, best first, after some generations, and how many there were; it is filled up with random groupings first."""
    bound = -(-int(sizes.sum()) // capacity)
    people = people + [Grouping.of(sizes, rng.permutation(len(sizes)), capacity) for _ in range(population - len(people))]
    people.sort(key=lambda p: p.fitness, reverse=True)
    born = 0
    while born < generations and len(people[0].room) > bound and len(people) > 1:
        i, j = sorted(rng.choice(len(people), 2, replace=False).tolist())
        people[-1] = crossover(sizes, people[i], people[j], rng, capacity)
        people.sort(key=lambda p: p.fitness, reverse=True)
        born += 1
    return people, born


def _island(capacity: int, epoch: int, last: bool, generations: int = GENERATIONS, population: int = POPULATION):
    """One island of one cell: its pieces with their bins in every grouping of the population, best first."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item", kind="stable")
        sizes = frame["length"].to_numpy(np.int64)
        rng = np.random.default_rng([int(key[0]), int(key[1]), epoch])
        people = []
        if epoch:
            people = [Grouping.given(sizes, n, capacity) for n in np.stack(frame["people"].to_list()).T.astype(np.int64)]
            people[-1] = Grouping.given(sizes, frame["guest"].to_numpy(np.int64), capacity)
        if last:  # the guest, which came last, stays: the worst of the others makes room
            native = people[: max(0, population - 2)] if epoch else []
            people = native + people[-1:] + [Grouping.of(sizes, np.argsort(-sizes, kind="stable"), capacity)]
        people, born = evolve(sizes, people, rng, capacity, generations, max(population, len(people)))
        best = people[0]
        # what is dealt anew: the emptiest bins that aren't full, up to half of the pieces
        held = np.bincount(best.number, minlength=len(best.room))
        empty = np.argsort(-best.room, kind="stable")
        empty = empty[best.room[empty] > capacity * (1 - FULL)]
        again = np.zeros(len(best.room), bool)
        again[empty[np.cumsum(held[empty]) <= len(sizes) // 2]] = True
        return frame.assign(
            people=list(np.stack([p.number for p in people[:population]], 1).astype(np.int32)), guest=best.number.astype(np.int32), again=again[best.number],
            bins=len(best.room), fill=best.fitness[1], born=born,
        )

    return run


_STATE = "item long, length long, cell long, people array<int>, guest int, island int"


def solve(items: DataFrame, capacity: int = CAPACITY, cell: int = CELL, generations: int = GENERATIONS, population: int = POPULATION, log: list | None = None) -> DataFrame:
    """items (item long, length long) with a bin for each: level, cell and bin name it.

    ``log`` takes a dict for each level: cells, generations bred, bins of all
    cells' elites after the first epoch and in the end.
    """
    spark = ship(items.sparkSession)
    todo, n = items.select("item", "length"), items.count()
    done, level = None, 0
    while n:
        cells = -(-n // cell)
        crowd = todo.withColumn("cell", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(cells))).withColumn("people", F.lit(None).cast("array<int>")).withColumn("guest", F.lit(0))
        crowd = crowd.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
        note: dict = {"level": level, "cells": cells, "generations": 0}
        for epoch in range(EPOCHS):
            last = epoch + 1 == EPOCHS
            found = crowd.groupBy("cell", "island").applyInPandas(_island(capacity, epoch, last, generations, population), _STATE + ", again boolean, bins long, fill double, born long")
            found, found_at = save(found)
            each = found.groupBy("cell", "island").agg(*[F.first(c).alias(c) for c in ("bins", "fill", "born")])
            # the elite: each cell's best island, the first among equals
            best = each.groupBy("cell").agg(F.min_by("island", F.struct("bins", -F.col("fill"), "island")).alias("island"), F.min("bins").alias("bins"), F.sum("born").alias("born"))
            if log is not None:
                total = best.agg(F.sum("bins"), F.sum("born")).first()
                note |= {"generations": note["generations"] + total[1], f"bins_{epoch}": total[0]}
            if last:
                elite = found.join(best.select("cell", "island"), ["cell", "island"])
                break
            guests = found.select("cell", "item", ((F.col("island") + 1) % ISLANDS).alias("island"), "guest")
            crowd, crowd_at = save(found.select("cell", "item", "island", "length", "people").join(guests, ["cell", "item", "island"]).select("item", "length", "cell", "people", "guest", "island"))
            drop(spark, found_at)
        if log is not None:
            log.append(note)
        final = F.lit(True) if cells == 1 else ~F.col("again")
        own = elite.filter(final).select("item", F.lit(level).alias("level"), "cell", F.col("guest").cast("long").alias("bin"))
        done = own if done is None else done.unionByName(own)
        if cells == 1:
            break
        todo, _ = save(elite.filter(~final).select("item", "length"))
        n, level = todo.count(), level + 1
    return done if done is not None else items.select("item", F.lit(0).alias("level"), F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("bin"))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, cell: int = CELL, log: list | None = None) -> DataFrame:
    """Pieces of all documents with the sequence that holds each and its place there."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = arrow_map(docs.select("doc_id", "text"), _cut(path or vocabulary_path(), capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    pieces, _ = save(cut.withColumn("item", F.monotonically_increasing_id()))
    packed = solve(pieces.filter(F.col("length") < capacity), capacity, cell, log=log)
    placed = pieces.join(packed, "item", "left")
    # sequence numbers: 7 bits for the level, 24 for the bin (a cell has at most as many as it has pieces, about CELL) and 32 for the cell; full pieces are sequences of their own
    number = F.when(F.col("bin").isNull(), -1 - F.col("item")).otherwise(F.shiftleft(F.shiftleft(F.col("cell"), 24) + F.col("bin"), 7) + F.col("level"))
    placed = placed.withColumn("sequence_id", number.cast("long"))
    own = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(own), F.lit(0)).cast("long"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
