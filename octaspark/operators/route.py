"""Route models: small dense linear models for each byte route, and the rules and gates that move one candidate to the front.

Every step looks at one object's scores and moves at most one label to the
first place (:func:`promote`): rules, calibrator, triad gate, pair gates, and on
route RL a specialist. Where two stacks are given and the first one's lead is
narrow, the second decides. All of it runs in one Arrow stage over the bytes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship, stream
from ..schemas import PREFIX
from . import codecs as c

# These define what results mean.
ROUTES = ("U", "N", "RL", "RH")
TRIAD = ("utf-8", "cp1251", "gb18030")
SIGNATURE_PAIR, CHINESE_PAIR = ("utf-8", "utf-8-sig"), ("utf-8", "gb18030")
SPECIALIST = ("utf-8", "big5", "euc-kr", "cp1251", "iso-8859-1")
OTHER = "__other__"
TOP, MISSING_SCORE, MISSING_RANK = 3, -20.0, 99.0
HIGH_SHARE, REPLACED_SHARE, SURE = 0.02, 0.02, 0.65
EVIDENCE_CODECS = ("utf-8", "shift_jis", "euc_jp", "big5", "gb18030")


def family(label: str) -> str:
    """As :func:`octaspark.functions.bytesql.family`, for one label."""
    v = label.lower().replace("_", "-")
    for name, fronts in (
        ("utf", ("utf",)), ("singlebyte-win", ("cp125", "windows-125", "cp874")), ("singlebyte-iso", ("iso8859", "iso-8859", "latin")),
        ("cjk", ("gb", "big5", "euc", "shift", "cp932", "cp949", "johab", "iso2022", "hz", "cp950")), ("koi8", ("koi8",)),
    ):
        if v.startswith(fronts):
            return name
    return "ascii" if v == "ascii" else "other"


@dataclass
class Signals:
    """What the first 4096 bytes show at a glance."""

    route: str
    bom: bool
    strict: bool
    ascii: bool
    high: float
    nul: float
    n: int

    @classmethod
    def of(cls, raw: bytes) -> Signals:
        p = np.frombuffer(raw[:PREFIX], np.uint8)
        n = len(p)
        high, nul = int((p > 127).sum()), int((p == 0).sum())
        strict = c.strict(raw[:PREFIX], "utf-8") is not None
        route = "U" if strict else "N" if nul else "RL" if high <= HIGH_SHARE * n else "RH"
        return cls(route, raw.startswith(b"\xef\xbb\xbf"), strict, high == 0, high / max(1, n), nul / max(1, n), n)

    def flags(self) -> list[float]:
        return [float(self.strict), float(self.bom), float(self.ascii)]

    def one_hot(self) -> list[float]:
        return [float(self.route == r) for r in ROUTES]


def sample(raw: bytes) -> np.ndarray:
    """Head, middle and tail: 768 bytes at most."""
    if len(raw) > 768:
        m = len(raw) // 2 - 128
        raw = raw[:256] + raw[m : m + 256] + raw[-256:]
    return np.frombuffer(raw, np.uint8).astype(np.int64)


def _shares(values: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(values, minlength=size) / max(1, len(values))


def base_vector(b: np.ndarray) -> np.ndarray:
    """518 features of a sample: byte shares, shares of sums of neighbours modulo 256, length and five shares of bytes."""
    inside = lambda low, high: float(((b >= low) & (b <= high)).sum()) / max(1, len(b))
    rest = [math.log2(max(1, len(b)) + 1) / 16, inside(128, 255), inside(0, 0), inside(32, 126), inside(10, 10), inside(13, 13)]
    return np.concatenate([_shares(b, 256), _shares((b[:-1] + b[1:]) & 255, 256), rest])


def extra_vector(b: np.ndarray, route: str) -> np.ndarray:
    """368 more for routes U and RH: differences and exclusive ors of neighbours, and where high bytes lie in each third; zeros elsewhere."""
    if route not in ("U", "RH"):
        return np.zeros(368)
    high = [_shares((part[part > 127] - 128) >> 3, 16) for part in (b[:256], b[256:512], b[512:768])]
    return np.concatenate([_shares((b[1:] - b[:-1]) & 255, 256), _shares((b[:-1] ^ b[1:]) >> 2, 64), *high])


def evidence_vector(raw: bytes) -> np.ndarray:
    """Ten features: which codecs read the prefix (up to three last bytes off), shares of kana, Cyrillic and Arabic letters."""
    head = raw[:PREFIX]
    texts = {x: next((t for k in range(4) if len(head) > k and (t := c.strict(head[: len(head) - k], x)) is not None), None) for x in EVIDENCE_CODECS}

    def share(t: str | None, low: str, high: str) -> float:
        ch = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.count_nonzero((ch >= ord(low)) & (ch <= ord(high))) / len(ch) if len(ch) else 0.0

    kana = [share(texts[x], "぀", "ヿ") for x in ("shift_jis", "euc_jp")]
    scripts = [share(head.decode(x, "replace"), low, high) for x, low, high in (("cp1251", "Ѐ", "ӿ"), ("cp1256", "؀", "ۿ"))]
    return np.array([*(float(texts[x] is not None) for x in EVIDENCE_CODECS), *kana, kana[0] - kana[1], *scripts])


def ordered_vector(b: np.ndarray) -> np.ndarray:
    """512 shares of hashed ordered pairs of neighbours."""
    return _shares(((b[:-1] * 131) ^ (b[1:] * 17)) & 511, 512)


VARIANTS = ("base", "base_logic", "base_ordered", "combined")


def variants(raw: bytes) -> dict[str, np.ndarray]:
    """The feature sets that models were compared on, by the names of VARIANTS."""
    b = sample(raw)
    base, logic, pairs = base_vector(b), evidence_vector(raw), ordered_vector(b)
    return {"base": base, "base_logic": np.r_[base, logic], "base_ordered": np.r_[base, pairs], "combined": np.r_[base, logic, pairs]}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(np.asarray(z, np.float64) - np.max(z))
    return e / e.sum()


@dataclass
class Head:
    """A dense linear model; one row of weights for two classes."""

    classes: list[str]
    weight: np.ndarray
    bias: np.ndarray

    def scores(self, x) -> np.ndarray:
        z = np.asarray(self.weight, np.float64) @ np.asarray(x, np.float64) + self.bias
        return np.array([-z[0], z[0]]) if len(self.classes) == 2 and len(z) == 1 else z


@dataclass
class Stack:
    """A model for each route, and the optional heads that correct their order."""

    routes: dict[str, Head]
    calibrator: Head | None = None
    triad: Head | None = None
    signature: Head | None = None
    chinese: Head | None = None

    def __post_init__(self):
        if lacking := sorted(set(ROUTES) - set(self.routes)):
            raise ValueError(f"routes without a model: {lacking}")


@dataclass
class RouteModel:
    base: Stack
    full: Stack | None = None
    specialist: Head | None = None
    margins: dict[str, float] = field(default_factory=dict)
    classes: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    sure: float = SURE


@dataclass
class Case:
    """One object: its bytes, signals, and the labels by score, best first."""

    raw: bytes
    signals: Signals
    scores: dict[str, float]
    order: list[str]

    @classmethod
    def of(cls, raw: bytes, signals: Signals, head: Head, x: np.ndarray) -> Case:
        z = head.scores(x)
        at = np.argsort(z)[::-1]
        return cls(raw, signals, dict(zip(head.classes, z.tolist())), [head.classes[i] for i in at])

    def score(self, label: str) -> float:
        return self.scores.get(label, MISSING_SCORE)

    @property
    def top(self) -> list[str]:
        return self.order[:TOP]


def promote(order: list[str], label: str | None) -> list[str]:
    """The label in front; nothing changes if it isn't among them."""
    return [label, *(x for x in order if x != label)] if label in order else order


def by_rules(case: Case) -> str | None:
    """The label that byte facts put in front: signature, strict UTF-8, ASCII, and Latin-1 over its neighbours."""
    s, order = case.signals, case.order
    if s.bom and "utf-8-sig" in order:
        return "utf-8-sig"
    if s.strict and "utf-8" in order:
        return "utf-8" if family(order[0]) in ("utf", "cjk", "singlebyte-win", "singlebyte-iso", "ascii") else order[0]
    if s.ascii and "ascii" in order:
        return "ascii"
    return "iso-8859-1" if order and order[0] in ("iso-8859-9", "cp1257") and "iso-8859-1" in case.top else None


def calibrated(case: Case, head: Head | None, classes: list[str], families: list[str]) -> str | None:
    """Of the best three the one with the highest calibrated score, the first among equals."""
    if head is None or len(case.order) < TOP:
        return None
    lead = [case.score(x) for x in case.top]
    rows = [
        [s, s - lead[0], s - lead[1], k, float(case.signals.bom), float(case.signals.strict), float(case.signals.ascii), *case.signals.one_hot(),
         *(float(x == y) for y in classes), *(float(family(x) == f) for f in families)]
        for k, (x, s) in enumerate(zip(case.top, lead))
    ]
    z = np.array(rows) @ np.asarray(head.weight[0], np.float64) + float(head.bias[0])
    return case.top[int(np.argmax(z))]


def triad(case: Case, head: Head | None, first: str | None) -> str | None:
    """The triad's likeliest label if it has half of the probability or more; only where the order leads with one and holds two."""
    if head is None or first not in TRIAD or len(set(case.top) & set(TRIAD)) < 2:
        return None
    v = [case.score(x) for x in TRIAD]
    s = case.signals
    x = [*v, v[0] - v[1], v[0] - v[2], v[1] - v[2], max(v) - sorted(v)[1], *s.flags(), s.high, s.nul, float(s.n), *s.one_hot()]
    p = softmax(head.scores(x))
    best = int(np.argmax(p))
    return head.classes[best] if 2 * p[best] >= 1 and head.classes[best] in case.top else None


def pair(case: Case, head: Head | None, labels: tuple[str, str], first: str | None) -> str | None:
    """Which of two labels, where one leads and both are among the best three."""
    if head is None or first not in labels or not set(labels) <= set(case.top):
        return None
    a, b = (case.score(x) for x in labels)
    s = case.signals
    z = float(np.asarray(head.weight[0], np.float64) @ np.array([a, b, a - b, abs(a - b), *s.flags(), s.high, s.nul, float(s.n), *s.one_hot()]) + head.bias[0])
    return head.classes[int(z > 0)]


def replacement_rate(raw: bytes) -> float:
    """The share of replacement characters in a lossy reading of all bytes as UTF-8."""
    text = raw.decode("utf-8", "replace")
    return text.count("�") / max(1, len(text))


def specialist_vector(case: Case) -> np.ndarray:
    """19 features for route RL: scores, ranks, lead, and how three codecs read the prefix."""
    v = [case.score(x) for x in SPECIALIST]
    place = [float(case.order.index(x) + 1) if x in case.order else MISSING_RANK for x in SPECIALIST]
    best = sorted(v, reverse=True)
    read = [m for x in ("utf-8", "big5", "euc-kr") for m in c.replacements(case.raw, x)]
    return np.array([*v, *place, best[0] - best[1], *read, case.signals.high, float(case.signals.n)])


def _ordered(case: Case, stack: Stack, model: RouteModel) -> list[str]:
    ruled = promote(case.order, by_rules(case))
    order = ruled if ruled[:1] != case.order[:1] else promote(case.order, calibrated(case, stack.calibrator, model.classes, model.families))
    order = promote(order, triad(case, stack.triad, order[0] if order else None))
    order = promote(order, pair(case, stack.signature, SIGNATURE_PAIR, order[0] if order else None))
    last = promote(order, pair(case, stack.chinese, CHINESE_PAIR, order[0] if order else None))
    turned = order[:1] == ["gb18030"] and last[:1] == ["utf-8"]
    return order if turned and replacement_rate(case.raw) > REPLACED_SHARE else last


def rank(raw: bytes, model: RouteModel) -> list[str]:
    """All labels, best first."""
    s, b = Signals.of(raw), sample(raw)
    x = base_vector(b)
    case = Case.of(raw, s, model.base.routes[s.route], x)
    lead = sorted(case.scores.values(), reverse=True)
    limit = model.margins.get(s.route)
    if model.full and limit is not None and s.route in ("U", "RH") and len(lead) > 1 and lead[0] - lead[1] <= limit:
        return _ordered(Case.of(raw, s, model.full.routes[s.route], np.r_[x, extra_vector(b, s.route)]), model.full, model)
    order = _ordered(case, model.base, model)
    if model.specialist is not None and s.route == "RL":
        p = softmax(model.specialist.scores(specialist_vector(case)))
        best = int(np.argmax(p))
        if model.specialist.classes[best] != OTHER and p[best] >= model.sure:
            order = promote(order, model.specialist.classes[best])
    return order


FEATURES = {
    "base": lambda raw: base_vector(sample(raw)),
    "extra": lambda raw: extra_vector(sample(raw), Signals.of(raw).route),
    "evidence": evidence_vector,
    "ordered": lambda raw: ordered_vector(sample(raw)),
} | {f"variant_{k}": (lambda raw, k=k: variants(raw)[k]) for k in VARIANTS}


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))


def vectors(df: DataFrame, key: str, kind: str, column: str = "raw") -> DataFrame:
    """(key, vector) of every row, by one of FEATURES."""
    own = df.select(key, column)

    def run(batches):
        for batch in batches:
            out = [FEATURES[kind](x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(out)], names=[key, "vector"])

    return stream(own, run, f"`{key}` {df.schema[key].dataType.simpleString()}, vector array<double>")


def variant_vectors(df: DataFrame, key: str, column: str = "raw") -> DataFrame:
    """(key, and a vector for each of VARIANTS) of every row: what they share is made once."""

    def run(batches):
        for batch in batches:
            out = [variants(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(_lists([x[k] for x in out]) for k in VARIANTS)], names=[key, *VARIANTS])

    return stream(df.select(key, column), run, f"`{key}` {df.schema[key].dataType.simpleString()}, " + ", ".join(f"{k} array<double>" for k in VARIANTS))


def metrics(df: DataFrame, key: str, labels: list[str], column: str = "raw") -> DataFrame:
    """(key, codec, valid, replaced) of the first 4096 bytes of every row under each codec."""
    own = df.select(key, column)

    def run(batches):
        for batch in batches:
            found = [(k, x, *c.replacements(r or b"", x)) for k, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in labels]
            cols = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.string()), *(pa.array(v, pa.float64()) for v in cols[2:])], names=[key, "codec", "valid", "replaced"])

    return stream(own, run, f"`{key}` {df.schema[key].dataType.simpleString()}, codec string, valid double, replaced double")


def logistic(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 1.0, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by accelerated gradient steps; the bias isn't penalized."""
    a = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    target = np.eye(classes)[y]
    step = 1 / (0.5 * float(np.linalg.norm(a, 2)) ** 2 + ridge)
    w, seen = np.zeros((a.shape[1], classes)), np.zeros((a.shape[1], classes))
    for k in range(rounds):
        z = a @ seen
        p = np.exp(z - z.max(1, keepdims=True))
        grad = a.T @ (p / p.sum(1, keepdims=True) - target)
        grad[:-1] += ridge * seen[:-1]
        new = seen - step * grad
        seen, w = new + k / (k + 3) * (new - w), new
    return w[:-1].T, w[-1]


def fit(samples: DataFrame, most: int = 4000, full: bool = True) -> tuple[RouteModel, DataFrame]:
    """A model of (raw, encoding) and a report (route, label, n, hits) on the rows it learned from.

    At most ``most`` rows, those with the least hashes, come to the driver, and
    of each only what the features need. A route with one label always says it;
    a route with none takes the model of all rows. ``full`` fits the second
    stack, which decides where the first leads by less than the median margin.
    """
    spark = ship(samples.sparkSession)
    least = samples.select(F.xxhash64("raw", "encoding").alias("h"), "raw", "encoding").orderBy("h", "encoding").limit(most)
    rows = [(bytes(r.raw), r.encoding) for r in least.collect()]
    labels = sorted({e for _, e in rows})
    if len(labels) < 2:
        raise ValueError("training needs two labels or more")
    y = np.array([labels.index(e) for _, e in rows])
    signals = [Signals.of(r) for r, _ in rows]
    route = np.array([s.route for s in signals])
    base = np.array([base_vector(sample(r)) for r, _ in rows])
    more = np.array([extra_vector(sample(r), s.route) for (r, _), s in zip(rows, signals)])

    def heads(x: np.ndarray) -> dict[str, Head]:
        out = {}
        for r in ROUTES:
            at = np.flatnonzero(route == r) if (route == r).any() else np.arange(len(y))
            own = sorted(set(y[at].tolist()))
            if len(own) == 1:
                bias = np.full(len(labels), -1.0)
                bias[own[0]] = 1.0
                out[r] = Head(labels, np.zeros((len(labels), x.shape[1])), bias)
            else:
                w, b = logistic(x[at], np.searchsorted(own, y[at]), len(own))
                out[r] = Head([labels[k] for k in own], w, b)
        return out

    model = RouteModel(Stack(heads(base)), classes=labels, families=sorted({family(x) for x in labels}))
    if full:
        model.full = Stack(heads(np.hstack([base, more])))
        for r in ("U", "RH"):
            lead = [np.sort(model.base.routes[r].scores(x))[::-1][:2] for x in base[route == r]]
            if lead and len(model.base.routes[r].classes) > 1:
                model.margins[r] = float(np.median([a - b for a, b in lead]))
    hits: dict[tuple[str, str], list[int]] = {}
    for (raw, e), s in zip(rows, signals):
        n = hits.setdefault((s.route, e), [0, 0])
        n[0] += 1
        n[1] += rank(raw, model)[0] == e
    report = spark.createDataFrame([(r, e, n, h) for (r, e), (n, h) in sorted(hits.items())], "route string, label string, n long, hits long")
    return model, report


def detect(df: DataFrame, model: RouteModel, column: str = "raw", top: int = TOP) -> DataFrame:
    """``df`` without the bytes, with route and the best labels."""
    keep = [x for x in df.columns if x != column]
    own = df.select(*keep, column)
    sent = ship(df.sparkSession).sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches):
        for batch in batches:
            raws = [x or b"" for x in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [pa.array([Signals.of(r).route for r in raws]), pa.array([rank(r, sent.value)[:top] for r in raws], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*keep, "route", "labels"])

    return stream(own, run, f"{kinds}, route string, labels array<string>")
