"""N-gram Jaccard join: a MinHash LSH forest over word shingles, then exact verification.

A document is the set of its shingles of ``size`` words (all its words, if they
are fewer); two documents are linked if the Jaccard similarity of their sets is
``threshold`` or more. Texts with equal word sequences are one *text*.

1. Each distinct text has a label in each of ``trees`` prefix tries: a sequence
   of ``depth`` MinHashes of 16 bits. A node of a trie is a prefix that several
   texts share; rows without such a neighbour at the shortest length are left
   out at once.
2. The tries are read from the longest prefixes on. Texts that share a prefix
   are candidates; they are linked through the least text of each node, a row
   for each text and tree rather than for each pair, and connected into groups.
   Groups are verified (3). Each link found is weighed by one over its chance
   to have been found at this length, 1 - (1 - s ** length) ** trees for its
   exact similarity s, which estimates how many links there are. While the
   share found is below ``recall``, the prefixes are shortened by one MinHash,
   and groups that grew are verified anew. The shortest length is the one with
   which even a pair right at the threshold is found with that chance.
3. A group is verified pair by pair, exactly. One above ``block`` texts is split
   into blocks of texts with common neighbours, and only pairs of blocks that
   share a node are compared; no task holds more than two blocks. Only degrees
   and a spanning forest leave a task, never pairs.

Result: one row for each document with doc_id, class_id (the smallest doc_id
that it is connected with by links), n_links (other documents linked to it,
copies included) and keep (the first row of its class). Null and empty texts
have no shingles: they have no links and are a class of their own. A null
doc_id is kept; its class_id is null if no other document is in its class.
Repeated rows are documents of their own. Only doc_id, text and the row id are
read, whatever the other columns are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import arrow_map, drop, save, slices, small, strings, text_bytes
from .words import mix, sequence_hash, shingles, words

SIZE, THRESHOLD, TREES, DEPTH, RECALL, BLOCK = 5, 0.8, 24, 6, 0.9999, 1024
#: Shingles in a block, and cells of a block's incidence matrix, at most.
BLOCK_SHINGLES, CELLS = 2_000_000, 8_000_000
#: A value of so many sets at most is counted pair by pair.
FEW = 12
_RNG = np.random.default_rng(77)
_MULTIPLY = _RNG.integers(1, 2**31, 64 * 16, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, 64 * 16, dtype=np.uint32)


def prefix_length(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix, ``depth`` at most, with which a pair at the threshold is found with this chance."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def labels(sh: np.ndarray, first: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """The label in each tree: ``depth`` MinHashes of 16 bits, four to a word; one row for each text that has shingles."""
    some = np.flatnonzero(np.diff(first))
    begin = first[:-1][some]
    x = (sh >> np.uint64(32)).astype(np.uint32)
    words_ = -(-depth // 4)
    out = np.zeros((len(some), trees * words_), np.uint64)
    for t in range(trees):
        for d in range(depth):
            k = t * 16 + d
            least = np.minimum.reduceat(x * _MULTIPLY[k] + _ADD[k], begin).astype(np.uint64)
            out[:, t * words_ + d // 4] |= (mix(least + np.uint64(k + 1)) >> np.uint64(48)) << np.uint64(16 * (3 - d % 4))
    return out


def _node(length: int):
    """The first ``length`` MinHashes of a label, as columns to group by."""
    out = []
    for w in range(-(-length // 4)):
        here = min(4, length - 4 * w)
        out.append(F.shiftrightunsigned(F.get("label", w), 16 * (4 - here)).alias(f"p{w}"))
    return [F.col("tree"), *out]


def _sign(size: int, trees: int, depth: int, carried: list[str]):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(*text_bytes(strings(part.column(part.schema.get_field_index("text")))))
                hi, lo = sequence_hash(w)
                sh, first = shingles(w, size)
                n = np.diff(first)
                wide = trees * -(-depth // 4)
                own = labels(sh, first, trees, depth).view(np.int64) if len(sh) else np.zeros((0, wide), np.int64)
                ends = np.concatenate([[0], np.cumsum((n > 0) * wide)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in carried), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(own.reshape(-1)))],
                    names=[*carried, "hi", "lo", "n", "labels"],
                )

    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(*text_bytes(strings(part.column(part.schema.get_field_index("text")))))
                hi, lo = sequence_hash(w)
                sh, first = shingles(w, size)
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                order = np.lexsort((sh, text))
                sh, text = sh[order], text[order]
                new = np.ones(len(sh), bool)
                new[1:] = (sh[1:] != sh[:-1]) | (text[1:] != text[:-1])
                sh, ends = sh[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(first) - 1))])
                sets = [sh[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(sets, pa.binary())], names=["hi", "lo", "shingles"])

    return run


def common(sets: list[np.ndarray], others: list[np.ndarray] | None, repeats: bool = False) -> np.ndarray:
    """How many values of each of ``sets`` are in each of ``others`` (None: of their own), as a matrix; the diagonal has no meaning. With ``repeats`` a value may stand in a set several times."""
    every = sets + (others or [])
    n, rows = len(every), len(sets)
    value, which = np.unique(np.concatenate(every), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in every])
    times = np.ones(len(row), np.int64)
    if repeats:
        entry, times = np.unique(which * n + row, return_counts=True)
        which, row = np.divmod(entry, n)
    shared = np.bincount(which, minlength=len(value))
    both = np.zeros((rows, n - rows if others else n), np.int64)
    # values of few sets: pair by pair
    few = np.flatnonzero((shared[which] > 1) & (shared[which] <= FEW))
    few = few[np.lexsort((row[few], which[few]))]
    for lag in range(1, FEW):
        if lag >= len(few):
            break
        same = which[few[lag:]] == which[few[:-lag]]
        a, b = few[:-lag][same], few[lag:][same]
        if others:
            across = (row[a] < rows) & (row[b] >= rows)
            np.add.at(both, (row[a[across]], row[b[across]] - rows), times[a[across]])
        else:
            np.add.at(both, (row[a], row[b]), times[a])
            np.add.at(both, (row[b], row[a]), times[b])
    # of many: by matrix
    often = shared > FEW
    keep = np.flatnonzero(often[which])
    number = np.cumsum(often) - 1
    keep = keep[np.argsort(number[which[keep]], kind="stable")]
    row, col, times = row[keep], number[which[keep]], times[keep]
    first = slice(0, rows)
    second = slice(rows, n) if others else first
    wide = max(1, CELLS // n)
    cuts = np.searchsorted(col, np.arange(0, int(often.sum()) + wide, wide))
    for k in range(len(cuts) - 1):
        r, c = row[cuts[k] : cuts[k + 1]], col[cuts[k] : cuts[k + 1]] - k * wide
        if len(r):
            m = np.zeros((n, int(c.max()) + 1), np.float32)
            m[r, c] = times[cuts[k] : cuts[k + 1]]
            both += (m[first] @ (m[second] > 0).astype(np.float32).T).astype(np.int64)
    return both


def linked(sets: list[np.ndarray], others: list[np.ndarray] | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``sets`` have Jaccard similarity num / den or more with which of ``others`` (None: of their own), and all similarities, as matrices."""
    both = common(sets, others)
    union = np.array([len(s) for s in sets])[:, None] + np.array([len(s) for s in others or sets])[None, :] - both
    out = den * both >= num * union
    if not others:
        np.fill_diagonal(out, False)
    return out, both / np.maximum(union, 1)


def _forest(link: np.ndarray) -> np.ndarray:
    """For each of these, the first one that it is connected with."""
    root = np.arange(len(link))
    for i in range(len(link)):
        if root[i] != i or not link[i].any():
            continue
        seen, todo = np.zeros(len(link), bool), np.array([i])
        seen[i] = True
        while len(todo):
            todo = np.flatnonzero(link[todo].any(0) & ~seen)
            seen[todo] = True
        root[seen] = i
    return root


def _compare(num: int, den: int, trees: int, lengths: range):
    """Input is sorted by (grp, bi, bj); a group of one block has bi = bj.

    Of each text: the first text of its block pair that it is connected with,
    its links, and how many links these stand for, as estimated for each of the
    prefix lengths.
    """

    def group(own: dict) -> list[tuple]:
        rep = np.array(list(own))
        block, copies = (np.array([own[r][k] for r in own]) for k in (0, 1))
        order = np.lexsort((rep, block))  # so the first of a tree is the least text of its block
        rep, block, copies = rep[order], block[order], copies[order]
        sets = [np.frombuffer(own[r][2], np.uint64) for r in rep.tolist()]
        if (cut := int((block == block[0]).sum())) == len(rep):
            link, alike = linked(sets, None, num, den)
        else:
            link, alike = np.zeros((len(rep), len(rep)), bool), np.zeros((len(rep), len(rep)))
            link[:cut, cut:], alike[:cut, cut:] = linked(sets[:cut], sets[cut:], num, den)
            link[cut:, :cut], alike[cut:, :cut] = link[:cut, cut:].T, alike[:cut, cut:].T
        root = _forest(link)
        own, other = np.nonzero(link)
        sure = [np.bincount(own, 1 / (1 - (1 - alike[own, other] ** n) ** trees), len(rep)) for n in lengths]
        return [(int(r), int(rep[t]), int(k), int(m), list(map(float, e))) for r, t, k, m, e in zip(rep, root, link @ copies, link.sum(1), zip(*sure))]

    def fit(key, own) -> bool:
        return len(own) > 1 and (key[1] == key[2] or len({x[0] for x in own.values()}) > 1)

    def run(batches):
        key, own = None, {}

        def out(found):
            cols = list(zip(*found)) or [()] * 5
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.list_(pa.float64()))], names=["rep", "root", "links", "found", "stand"])

        for batch in batches:
            found = []
            for grp, bi, bj, rep, block, copies, sh in zip(*(c.to_pylist() for c in batch.columns)):
                if (grp, bi, bj) != key:
                    if fit(key, own):
                        found += group(own)
                    key, own = (grp, bi, bj), {}
                own[rep] = (block, copies, sh)
            if found:
                yield out(found)
        if fit(key, own):
            yield out(group(own))

    return run


def _groups(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): texts and the least texts of their nodes at this prefix length; and (node, component) of the texts in nodes of several."""
    node = _node(length)
    own = rows.select("rep", *node)
    by = ["tree", *[f"p{w}" for w in range(len(node) - 1)]]
    hubs = own.groupBy(*by).agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last").drop("last")
    edges, _ = save(own.join(hubs, by).filter("rep > hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct())
    return edges, components(edges, clean=True)


def _blocks(rows: DataFrame, edges: DataFrame, member: DataFrame, length: int, block: int) -> tuple[DataFrame, DataFrame | None]:
    """Each text's block (0 if its group is one block), and the pairs of blocks to compare (component, bi, bj; None: all groups are one block).

    Texts with the same least neighbour are kept together as long as they don't
    fill half a block; pairs of blocks are those that a node has texts of.
    """
    per = member.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    per, _ = save(per.filter("blocks > 1"))
    if per.isEmpty():
        return member.withColumn("block", F.lit(0)), None
    member = member.join(small(per), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    large = member.filter("blocks > 1")
    near = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("key"))
    large = large.join(small(near), "node", "left").withColumn("key", F.coalesce("key", "node"))
    crowd = large.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > block // 2)
    large = large.join(small(crowd), "key", "left").withColumn("key", F.when(F.col("many").isNull(), F.col("key")).otherwise(F.col("node")))
    large, _ = save(large.select("node", "component", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block")))
    node = _node(length)
    own = rows.select(F.col("rep").alias("node"), *node).join(small(large), "node")
    per_node = own.groupBy("component", "tree", *[f"p{w}" for w in range(len(node) - 1)]).agg(F.collect_set("block").alias("bs"))
    pairs = per_node.select("component", F.explode("bs").alias("bi"), "bs").select("component", "bi", F.explode("bs").alias("bj")).filter("bi <= bj").distinct()
    pairs, _ = save(pairs)
    member = member.join(small(large.select("node", "block")), "node", "left").withColumn("block", F.coalesce("block", F.lit(0)))
    return member, pairs


def join(docs: DataFrame, size: int = SIZE, num: int = 4, den: int = 5, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK, row_id: str | None = None, log: list | None = None) -> DataFrame:
    """Classes and numbers of links of all documents; see the module's text. The threshold is num / den.

    ``row_id`` names a column that comes back with each row: doc_id needn't be
    unique. ``log`` takes a dict for each prefix length that was read.
    """
    spark = docs.sparkSession
    carried = ["doc_id"] + ([row_id] if row_id else [])
    docs = docs.select(*carried, "text")
    shortest = prefix_length(trees, depth, num / den, recall)
    wide = -(-depth // 4)
    signed = arrow_map(docs, _sign(size, trees, depth, carried), ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried) + ", hi long, lo long, n long, labels array<long>")
    texts, texts_at = save(signed.withColumn("row", F.monotonically_increasing_id()))
    rep = texts.groupBy("hi", "lo").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("kept"))
    rep, rep_at = save(rep)
    # a row for each text and tree; only those that share the shortest prefix with another text go on
    one = texts.filter("n > 0").join(small(rep.select(F.col("rep").alias("row"))), "row", "left_semi")
    rows = one.select(F.col("row").alias("rep"), "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    rows = rows.select("rep", "tree", F.slice("labels", F.col("tree") * wide + 1, F.lit(wide)).alias("label"))
    node = _node(shortest)
    by = ["tree", *[f"p{w}" for w in range(len(node) - 1)]]
    short = rows.select("rep", "label", *node)
    alive = short.groupBy(*by).agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x < y").select(*by)
    rows, rows_at = save(short.join(alive, by, "left_semi").select("rep", "tree", "label"))
    seen, settled, lengths = None, None, range(depth, shortest - 1, -1)
    for length in lengths:
        edges, group = _groups(rows, length)
        member = group.join(texts.select(F.col("row").alias("node"), "n", "hi", "lo", "doc_id"), "node").join(rep.select(F.col("rep").alias("node"), "copies"), "node")
        if len(lengths) > 1:
            sign = group.groupBy("component").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.count(F.lit(1)).alias("many"), F.min("node").alias("first"))
            sign, _ = save(sign)
        if seen is not None:  # groups that are as they were keep what was found
            todo = sign.join(settled.select("sum", "many", "first"), ["sum", "many", "first"], "left_anti")
            member = member.join(small(todo.select("component")), "component", "left_semi")
        member, _ = save(member)
        fresh, _ = save(_verify(docs, rows, edges, member, length, lengths, size, num, den, trees, block))
        if seen is not None:
            fresh, _ = save(seen.join(small(member.select(F.col("node").alias("rep"))), "rep", "left_anti").unionByName(fresh))
        seen, settled = fresh, sign if len(lengths) > 1 else None
        if length == shortest and log is None:
            break
        found, stand = seen.agg(F.sum("found"), F.sum(F.get("stand", depth - length))).first()
        share = (found or 0) / stand if stand else 1.0
        if log is not None:
            log.append({"length": length, "links": (found or 0) // 2, "recall": share})
        if share >= recall:
            break
    cls = components(seen.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = seen.groupBy(F.col("rep").alias("node")).agg(F.sum("links").alias("links"))
    named = (
        rep.join(cls.withColumnRenamed("node", "rep"), "rep", "left").join(links.withColumnRenamed("node", "rep"), "rep", "left")
        .select("hi", "lo", "rep", "least", "kept", "copies", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    head = named.groupBy("component").agg(F.min("least").alias("class_id"), F.min_by("rep", F.struct(F.col("least").isNull(), "least", "rep")).alias("first"))
    named = named.join(head, "component")
    empty = F.col("n") == 0
    out = texts.join(named.select("hi", "lo", "rep", "class_id", "links", "copies", "first", "kept"), ["hi", "lo"])
    out = out.select(
        *carried,
        F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(empty, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        (empty | ((F.col("rep") == F.col("first")) & (F.col("row") == F.col("kept")))).alias("keep"),
    )
    out, _ = save(out)
    drop(spark, texts_at, rep_at, rows_at)
    return out


def _sides(pairs: DataFrame) -> DataFrame:
    """A row for each block of a pair of blocks; one for a block with itself."""
    return pairs.select("component", F.col("bi").alias("block"), "bi", "bj").unionByName(pairs.filter("bi < bj").select("component", F.col("bj").alias("block"), "bi", "bj"))


def _verify(docs: DataFrame, rows: DataFrame, edges: DataFrame, member: DataFrame, length: int, lengths: range, size: int, num: int, den: int, trees: int, block: int) -> DataFrame:
    """Roots, links and their estimates (rep, root, links, found, stand) of the texts of the given groups."""
    member, pairs = _blocks(rows, edges, member, length, block)
    ids = member.select("doc_id").distinct()
    wanted = docs.join(small(ids), docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
    sets = arrow_map(wanted, _sets(size), "hi long, lo long, shingles binary")
    sets = sets.join(small(member.select("hi", "lo", "node", "component", "block", "copies")), ["hi", "lo"])
    if pairs is None:
        sets = sets.withColumns({"bi": F.lit(0), "bj": F.lit(0)})
    else:
        sets = sets.join(small(_sides(pairs)), ["component", "block"], "left")
    sent = sets.select("component", F.coalesce("bi", F.lit(0)).alias("bi"), F.coalesce("bj", F.lit(0)).alias("bj"), F.col("node").alias("rep"), "block", "copies", "shingles")
    sent = sent.repartition("component", "bi", "bj").sortWithinPartitions("component", "bi", "bj")
    return arrow_map(sent, _compare(num, den, trees, lengths), "rep long, root long, links long, found long, stand array<double>")
