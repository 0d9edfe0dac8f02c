"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel of two words sums, over all letter subsequences of length ``ORDER``
that both hold, ``DECAY`` to the power of the letters that each spans, and is
normalized to 1 for equal words: "stupxid" and "stu.p.id" stay close to
"stupid". A text is a bag of word windows: white-space separated chunks reduced
to lower-case letters (common digit and sign look-alikes read as letters), runs
of four or more single letters read as one word, words above ``LONGEST``
letters cut into overlapping windows. A text's decision value is the largest
of its windows (multiple-instance learning: one insult is enough).

Training takes at most ``TRAIN_DOCS`` labelled documents, those with the least
hashes of doc_id; everything else covers all rows. Equal texts count once:

1. Landmarks. For every word and word beginning the texts of either label that
   hold it are counted. Candidates are those that label 1 holds more often than
   label 0, and more often than chance explains (a binomial test, corrected for
   the number of words tried), whether they also occur under label 0 or not; at
   most ``FORMS`` for a beginning and ``POOL`` in all, those with the most
   evidence. Up to ``POSITIVE_LANDMARKS`` are chosen one by one, those with the
   most evidence times the distance to the chosen ones in the kernel's metric. Every training text is then reduced to the ``BAG`` windows
   that are nearest to one of these; the ``NEGATIVE_LANDMARKS`` nearest windows
   that are no more frequent under label 1 complete the landmarks. Features of a window are its kernel values times the
   inverse square root of the landmarks' own matrix.
2. The SVM (squared hinge) learns from the labelled texts: a text of label 0 has
   all its windows on the lower side, a text of label 1 at least one, its
   witness, on the upper side. Witnesses are chosen anew by each classifier
   until they stay (MI-SVM). Versions of the witnesses with an inserted letter
   take part. Every text weighs the same within its label, so wrong labels cost
   a margin, not a word.
3. The decision threshold is put where it splits the training texts best.

A window without enough of some positive landmark's letter pairs in order (a
share below ``REACH``) takes the value of a kernel of 0 without further work.

Nulls: a null text is an empty one; it takes the base score. Labels that are
null are ignored; of repeated labels the largest counts. Repeated rows get
equal scores. Without candidates (no labels, one class) every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_map, drop, hide, save, show, slices, strings

TRAIN_DOCS, POOL = 6_000, 400
ORDER, DECAY, LONGEST = 3, 0.7, 20
POSITIVE_LANDMARKS, NEGATIVE_LANDMARKS, REACH = 32, 16, 0.34
#: Candidates with one strong beginning, and windows that a training text is reduced to.
FORMS, BAG = 12, 12
#: Words whose values a worker remembers; when there are more, it begins anew.
KNOWN = 200_000
#: Rounds of choosing witnesses.
ROUNDS = 10
_LOOKS = str.maketrans("013457@$!", "oieastasi")
#: Bytes of text whose distinct chunks are scored together.
_SLICE = 8 << 20


def kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of rows of letters: s (n, 1, length), t (1 or n, m, length); 0 pads s, -1 pads t."""
    shape = np.broadcast_shapes(s.shape[:2], t.shape[:2])
    lt = t.shape[2]
    # prefix[i][b]: common subsequences of i letters of s so far and t[:b], weighted down to both ends
    prefix = np.zeros((order, lt + 1, *shape), np.float32)
    prefix[0] = 1
    total = np.zeros(shape, np.float32)
    for a in range(s.shape[2]):
        same = [(s[:, :, a] == t[:, :, b]).astype(np.float32) * np.float32(decay * decay) for b in range(lt)]
        for b in range(lt):
            total += same[b] * prefix[order - 1, b]
        for i in range(order - 1, 0, -1):
            run = np.zeros(shape, np.float32)
            for b in range(1, lt + 1):
                run *= np.float32(decay)
                run += same[b - 1] * prefix[i - 1, b - 1]
                prefix[i, b] *= np.float32(decay)
                prefix[i, b] += run
    return total


def letters(words: list[str], pad: int) -> np.ndarray:
    """Words as rows of code points."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), max(ORDER, int(size.max(initial=0)))), pad, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    return out


def normalized(words: list[str], marks: np.ndarray, marks_self: np.ndarray) -> np.ndarray:
    """Kernel values of words and landmarks, 1 for equal ones; words of fewer than ORDER letters get 0."""
    out = np.zeros((len(words), len(marks)), np.float32)
    order = np.argsort([len(w) for w in words], kind="stable")
    for k in range(0, len(order), 256):
        some = order[k : k + 256]
        s = letters([words[i] for i in some], 0)
        own = kernel(s[:, None, :], np.where(s == 0, -1, s)[:, None, :])
        out[some] = kernel(s[:, None, :], marks[None]) / np.sqrt(np.maximum(own, 1e-12) * marks_self[None, :])
    return out


def _pair(x, y):
    return ((x & 63) << 6) | (y & 63)


class Model:
    """Landmarks and weights; small enough to be sent to every executor."""

    def __init__(self, positive: list[str], negative: list[str], weights: np.ndarray, bias: float, threshold: float, slope: float):
        self.words, self.weights, self.bias, self.threshold, self.slope = positive + negative, weights, bias, threshold, slope
        self.known: dict[str, float] = {}  # what a worker has computed already
        self.marks = letters(self.words, -1) if self.words else np.zeros((0, ORDER), np.int32)
        self.self = _selfs(self.words)
        # bits: the adjacent letter pairs of the positive landmarks
        bits: dict[int, int] = {}
        own = []
        for w in positive:
            c = [ord(x) for x in w]
            own.append({bits.setdefault(_pair(x, y), len(bits)) for x, y in zip(c, c[1:])})
        self.lanes = max(1, -(-len(bits) // 64))
        self.table = np.zeros((4096, self.lanes), np.uint64)
        for p, b in bits.items():
            self.table[p, b // 64] |= np.uint64(1) << np.uint64(b % 64)
        self.need = np.zeros((len(own), self.lanes), np.uint64)
        for i, o in enumerate(own):
            for b in o:
                self.need[i, b // 64] |= np.uint64(1) << np.uint64(b % 64)
        self.least = np.array([max(1, int(np.ceil(REACH * len(o)))) for o in own])

    def near(self, words: list[str]) -> np.ndarray:
        """Which words hold enough letter pairs, at most three letters apart, of a positive landmark."""
        out = np.zeros(len(words), bool)
        if not len(self.need):
            return out
        for k in range(0, len(words), 16_384):
            c = letters(words[k : k + 16_384], 0)
            mask = np.zeros((len(c), self.lanes), np.uint64)
            for gap in (1, 2, 3, 4):
                for i in range(c.shape[1] - gap):
                    live = c[:, i + gap] != 0  # words are padded at the end only
                    mask[live] |= self.table[_pair(c[live, i], c[live, i + gap])]
            for need, least in zip(self.need, self.least):
                out[k : k + len(c)] |= np.bitwise_count(mask & need).sum(1) >= least
        return out

    def values(self, words: list[str]) -> np.ndarray:
        """Decision values of words."""
        out = np.full(len(words), self.bias, np.float64)
        if some := np.flatnonzero(self.near(words)).tolist():
            fresh = [words[i] for i in some if words[i] not in self.known]
            if len(self.known) + len(fresh) > KNOWN:
                self.known, fresh = {}, [words[i] for i in some]
            if fresh:
                self.known.update(zip(fresh, (normalized(fresh, self.marks, self.self) @ self.weights).tolist()))
            out[some] += np.fromiter((self.known[words[i]] for i in some), np.float64, len(some))
        return out

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def score(self, value: np.ndarray) -> np.ndarray:
        if not self.words:
            return np.zeros(len(value))
        return 1 / (1 + np.exp(-np.clip(self.slope * (value - self.threshold), -40, 40)))


def _selfs(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.float32)
    s = letters(words, 0)
    return np.maximum(kernel(s[:, None, :], np.where(s == 0, -1, s)[:, None, :])[:, 0], 1e-12)


def windows(chunk: str) -> list[str]:
    """The word windows of a white-space separated chunk."""
    word = "".join(c for c in chunk.lower().translate(_LOOKS) if c.isalpha())
    if len(word) <= LONGEST:
        return [word] if len(word) >= ORDER else []
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def chunk_values(chunks: pa.Array, model: Model) -> np.ndarray:
    """The largest decision value of the windows of each chunk."""
    plain = pc.replace_substring_regex(pc.utf8_lower(chunks), r"[\x00-\x2F\x3A-\x3F\x5B-\x60\x7B-\x7F]+", "")
    odd = pc.or_(pc.match_substring_regex(chunks, "[0-9@$!]"), pc.greater(pc.utf8_length(plain), LONGEST))
    coded = pc.dictionary_encode(pc.if_else(odd, pa.scalar(""), plain))
    words = coded.dictionary.to_pylist()
    fit = [i for i, w in enumerate(words) if len(w) >= ORDER]
    value = np.full(len(words), model.bias, np.float64)
    value[fit] = model.values([words[i] for i in fit])
    out = value[coded.indices.to_numpy(zero_copy_only=False)] if len(chunks) else np.zeros(0)
    # chunks with look-alikes, and long ones, which are cut into windows
    which = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
    for k in range(0, len(which), 16_384):
        some = which[k : k + 16_384]
        parts = [windows(chunks[i].as_py()) for i in some]
        own = sorted({w for p in parts for w in p})
        found = dict(zip(own, model.values(own)))
        out[some] = [max((found[w] for w in p), default=model.bias) for p in parts]
    return out


def text_values(texts: pa.Array, model: Model) -> np.ndarray:
    """The largest decision value of the windows of each text."""
    lists = pc.ascii_split_whitespace(texts)
    coded = pc.dictionary_encode(lists.flatten())
    chunks = coded.dictionary
    which = coded.indices.to_numpy(zero_copy_only=False)
    at = lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    out = np.full(len(texts), model.bias, np.float64)
    if not len(chunks):
        return out
    value = chunk_values(chunks, model)[which]
    some = np.flatnonzero(np.diff(at))
    out[some] = np.maximum.reduceat(value, at[:-1][some])
    # words spelled letter by letter: runs of four or more chunks of one letter
    short = np.flatnonzero(pc.less_equal(pc.utf8_length(chunks), 2).to_numpy(zero_copy_only=False))
    flag = np.zeros(len(chunks), bool)
    flag[short] = [sum(x.isalnum() for x in chunks[int(i)].as_py()) == 1 for i in short]
    single = flag[which]
    if single.any():
        edge = np.zeros(len(single) + 1, bool)
        edge[at] = True
        begin = np.flatnonzero(single & (edge[:-1] | ~np.concatenate([[False], single[:-1]])))
        end = np.flatnonzero(single & (edge[1:] | ~np.concatenate([single[1:], [False]]))) + 1
        for b, e in zip(begin[end - begin >= 4].tolist(), end[end - begin >= 4].tolist()):
            own = windows("".join(chunks[int(k)].as_py() for k in which[b:e]))
            i = int(np.searchsorted(at, b, "right")) - 1
            out[i] = max([out[i], *model.values(own)])
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Minimize ridge / 2 |w|^2 + sum of weighted squared hinges by Newton steps over the active set."""
    w, active = np.zeros(x.shape[1]), np.ones(len(y), bool)
    for _ in range(50):
        a = x[active] * weight[active, None]
        w = np.linalg.solve(ridge * np.eye(x.shape[1]) + a.T @ x[active], a.T @ y[active])
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def training_rows(docs: DataFrame, labels: DataFrame, target: str = "toxic", most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, text and label of the labelled documents to learn from: crc32 of doc_id not divisible by 5, least hashes first."""
    own = labels.select("doc_id", F.col(target).alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    own = own.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")  # at most ``most`` rows are broadcast


def _terms(rows: DataFrame) -> DataFrame:
    """Words and beginnings with the numbers of texts of label 1 (a) and 0 (b) that hold them."""
    words = F.filter(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")), lambda w: F.length(w).between(ORDER, LONGEST))
    # distinct beginnings of each length; the length tells them from words
    begin = [F.transform(F.array_distinct(F.transform(words, lambda w, n=n: F.substring(w, 1, n))), lambda t, n=n: F.struct(t.alias("term"), F.lit(n).alias("cut"))) for n in (4, 5)]
    whole = F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(0).alias("cut")))
    own = rows.select("label", F.explode(F.concat(whole, *begin)).alias("f"))
    own = own.groupBy("f.term", "f.cut").agg(F.sum("label").cast("long").alias("a"), F.sum(1 - F.col("label")).cast("long").alias("b"))
    return own.withColumn("whole", F.col("cut") == 0).filter((F.col("cut") == 0) | (F.length("term") == F.col("cut")))


def _candidates(rows: DataFrame, terms: DataFrame, pool: int = POOL) -> list[tuple[str, float]]:
    """Words, and their evidence, that texts of label 1 hold more often than chance explains, themselves or by their beginnings, most evidence first."""
    up, n = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    if not up or up == n:
        return []
    share = up / n
    rate = F.col("a") / (F.col("a") + F.col("b"))
    miss = F.when(F.col("b") > 0, F.col("b") * F.log((1 - rate) / (1 - share))).otherwise(F.lit(0.0))
    evidence = F.when(rate > share, F.col("a") * F.log(rate / share) + miss).otherwise(F.lit(0.0))
    strong = terms.withColumn("e", evidence).filter((F.col("e") > float(np.log(terms.count() + 1) + 3)) & (rate > 0.5))
    whole = strong.filter("whole").select(F.col("term").alias("word"), "e")
    # words under label 1 that begin as a strong beginning does, the most frequent of each
    begun = terms.filter("whole AND a > b").select(F.col("term").alias("word"), "a", F.explode(F.array(*[F.substring("term", 1, n) for n in (4, 5)])).alias("term"))
    begun = begun.join(strong.filter("NOT whole").select("term", "e"), "term")
    begun = begun.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("a"), "word"))).filter(F.col("k") <= FORMS).select("word", "e")
    found = whole.unionByName(begun).groupBy("word").agg(F.max("e").alias("e")).orderBy(F.desc("e"), "word").limit(pool)
    return [(r.word, r.e) for r in found.collect()]


def _nearest(marks: list[str], most: int):
    """The ``most`` windows of each text that are nearest to a landmark."""

    def run(batches):
        near = Model(marks, [], np.zeros(len(marks)), 0.0, 0.0, 1.0)
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                texts = strings(part.column(part.schema.get_field_index("text"))).to_pylist()
                known: dict[str, list[str]] = {}
                own = []
                for t in texts:
                    chunks = t.split()
                    found = set(_spelled(chunks))
                    for c in set(chunks):
                        if c not in known:
                            known[c] = windows(c)
                        found.update(known[c])
                    own.append(found)
                flat = sorted({w for o in own for w in o})
                flat = [w for w, k in zip(flat, near.near(flat)) if k]
                value = dict(zip(flat, normalized(flat, near.marks, near.self).max(1).tolist() if flat else []))
                out = [sorted((w for w in o if w in value), key=lambda w: (-value[w], w))[:most] for o in own]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("label")), pa.array(out, pa.list_(pa.string()))], names=["label", "words"])

    return run


def _spelled(chunks: list[str]) -> list[str]:
    """Windows of words that are spelled letter by letter."""
    out, run = [], []
    for c in [*chunks, "--"]:
        if len(c) <= 2 and sum(x.isalnum() for x in c) == 1:
            run.append(c)
        else:
            if len(run) >= 4:
                out += windows("".join(run))
            run = []
    return out


def _learn(bags: list[tuple[int, list[str]]], positive: list[str]) -> Model | None:
    """The SVM of labelled bags of windows; see the module's text."""
    bags = [(y, w) for y, w in bags if w]
    words = sorted({x for _, w in bags for x in w})
    place = {w: i for i, w in enumerate(words)}
    label = np.array([y for y, _ in bags])
    owner = np.repeat(np.arange(len(bags)), [len(w) for _, w in bags])
    member = np.array([place[x] for _, w in bags for x in w], np.int64)
    if not len(bags) or label.min() == label.max():
        return None
    up, down = int(label.sum()), int((1 - label).sum())
    seen = [np.bincount(member[label[owner] == y], minlength=len(words)) for y in (0, 1)]
    odds = np.log((seen[1] + 0.5) / (up + 1)) - np.log((seen[0] + 0.5) / (down + 1))
    close = normalized(words, letters(positive, -1), _selfs(positive)).max(1)
    plain = np.flatnonzero((odds <= 0) & (seen[0] > 1))
    negative = [words[i] for i in plain[np.argsort(-close[plain], kind="stable")][:NEGATIVE_LANDMARKS]]
    marks = positive + negative
    own = normalized(marks, letters(marks, -1), _selfs(marks)).astype(np.float64)
    val, vec = np.linalg.eigh((own + own.T) / 2)
    root = vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-3))) @ vec.T
    features = lambda some: np.hstack([normalized(some, letters(marks, -1), _selfs(marks)) @ root, np.ones((len(some), 1))])
    x = features(words)
    rng = np.random.default_rng(11)
    low = np.bincount(member[label[owner] == 0], 1 / down / np.bincount(owner)[owner][label[owner] == 0], len(words))
    value, before, w = odds, None, None
    bag = np.flatnonzero(label == 1)
    first = np.searchsorted(owner, np.arange(len(bags) + 1))
    for _ in range(ROUNDS):
        witness = np.array([member[first[b] : first[b + 1]][value[member[first[b] : first[b + 1]]].argmax()] for b in bag.tolist()])
        if before is not None and (witness == before).all():
            break
        before = witness
        high = np.bincount(witness, minlength=len(words)) / up
        top = np.flatnonzero(high)
        inserted = [(words[i][:k] + chr(97 + int(rng.integers(26))) + words[i][k:], high[i]) for i in top for k in rng.integers(1, max(2, len(words[i])), 2)]
        rows = np.vstack([x[top], features([t for t, _ in inserted]), x[low > 0]])
        y = np.r_[np.ones(len(top) + len(inserted)), -np.ones(int((low > 0).sum()))]
        cost = np.r_[high[top] / 2, np.array([c for _, c in inserted]) / 4, low[low > 0]]
        w = _svm(rows, y, cost * len(bags) / 2)
        value = x @ w
    return Model(positive, negative, root @ w[:-1], float(w[-1]), 0.0, 8.0)


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", most: int = TRAIN_DOCS, pool: int = POOL) -> Model:
    """Train on the labelled documents; see the module's text.

    The driver gets ``pool`` words at most, and of each of at most ``most``
    texts ``BAG`` windows.
    """
    spark = docs.sparkSession
    rows, rows_at = save(training_rows(docs, labels, target, most).groupBy("text").agg(F.max("label").cast("int").alias("label")))
    terms, terms_at = save(_terms(rows))
    found = _candidates(rows, terms, pool)
    words, weight = [w for w, _ in found], np.array([e for _, e in found])
    empty = Model([], [], np.zeros(0), -1.0, 0.0, 8.0)
    model = None
    if words:
        # landmarks: the most evidence times the distance to those chosen
        gram = normalized(words, letters(words, -1), _selfs(words))
        chosen, far = [0], 1 - gram[:, 0]
        while len(chosen) < min(POSITIVE_LANDMARKS, len(words)) and far.max() > 0.05:
            chosen.append(int((far * weight).argmax()))
            far = np.minimum(far, 1 - gram[:, chosen[-1]])
        positive = [words[i] for i in chosen]
        bags = arrow_map(rows.select("label", "text"), _nearest(positive, BAG), "label int, words array<string>").collect()
        model = _learn([(int(r.label > 0), r.words) for r in bags], positive)
    if model is None:
        drop(spark, rows_at, terms_at)
        return empty
    seen = score(rows, model, keep=["label"]).select("label", "value").toPandas()
    drop(spark, rows_at, terms_at)
    value, label = seen["value"].to_numpy(), seen["label"].to_numpy() > 0
    order = np.argsort(-value, kind="stable")
    value, label = value[order], label[order]
    last = np.append(value[1:] < value[:-1], True)
    right = np.cumsum(label)
    f1 = np.where(last, 2 * right / (np.arange(1, len(value) + 1) + max(1, label.sum())), 0)
    k = int(f1.argmax())
    model.threshold = float((value[k] + value[k + 1]) / 2) if k + 1 < len(value) else float(value[k] - 0.1)
    return model


def _score(model: Model, column: str = "text"):
    def run(batches):
        for batch in batches:
            for part in slices(batch, column, _SLICE):
                value = text_values(strings(part.column(part.schema.get_field_index(column))), model)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value), pa.array(model.score(value))], names=[*part.schema.names, "value", "score"])

    return run


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (doc_id by default), the decision value and the score, 0 to 1, of every text."""
    keep = ["doc_id"] if keep is None else keep
    have = docs.select(*keep, *(["text"] if "text" not in keep else []))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in have.schema)
    out = arrow_map(have, lambda batches: _score(sent.value)(batches), f"{kinds}, value double, score double")
    return out.select(*keep, "value", "score")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with the columns they came with, whatever their names."""
    plain = hide(docs, "doc_id", "text")
    return show(score(plain, fit(docs, labels), keep=plain.columns).filter("score < 0.5").drop("value", "score"), docs, "doc_id", "text")
