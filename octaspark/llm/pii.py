"""Personal data by weak supervision, in DataFrame and SQL functions only.

Base spans are the strict patterns of e-mail addresses, IP addresses, payment
cards (Luhn) and telephone numbers; they always stay. The method adds spans of
looser candidates: obfuscated e-mail addresses, telephone numbers without a
country code, and secrets behind a key word. Each candidate, and each base
span, gets votes (1 yes, 0 no, 2 none) of labelers:

* ``shape``: a regex on the span alone;  * ``gazetteer``: known words in it or as its key;
* ``context``: a telling word shortly before;  * ``border``: white space or punctuation on both sides;
* ``variety``: its characters are neither all alike nor only a few.

Expectation-maximization over the counts of vote patterns (a bounded table,
whatever the corpus) estimates, for each kind by itself, each labeler's
reliability and each pattern's probability. A logistic classifier over kinds
and their votes is then trained on these probabilities, and candidates it gives
0.5 or more become spans, unless they overlap a base span.

Positions count code points, from 0, end exclusive. Nulls count as empty texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, save

#: Strict patterns. Possessive quantifiers and look-behinds match what plain leftmost greedy search
#: matches, in linear time: a match can only begin where a run begins or the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be worth a search.
HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]++(?: ?[\[({](?:dot|DOT)[\])}] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?i)(?<![a-z])(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key)\"? ?[=:] ?\"?[^\s\",;]{4,}+",
}
LOOSE_HINT = {"email": r"[\[({](?:at|AT)[\])}]", "phone": r"[0-9]{3}[ .-][0-9]{4}", "secret": r"(?i)(?:pass|pwd|secret|token|key)[a-z]*+\"? ?[=:]"}
KINDS = ("email", "ip", "card", "phone", "secret")
VOTES = ("shape", "gazetteer", "context", "border", "variety")
SHAPE = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*+[^A-Za-z0-9._%+-].*[A-Za-z]{2,}$",
    "ip": r"^(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}$",
    "card": r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4,7}$",
    "phone": r"^(?:\+[0-9]{1,3}[ -]?)?[(]?[0-9]{2,4}[)]?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}$",
    "secret": r"^.*[=:] ?\"?(?=.*[0-9])[A-Za-z0-9+/_.!@#$%^&*-]{8,}$",
}
GAZETTEER = {
    "email": r"(?i)(?:example|mail|gmail|outlook|yahoo|post|web)",
    "ip": r"^(?:10|127|172|192|203|198|8|1)\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+|^\(?(?:555|800|212|415|900)|555",
    "secret": r"(?i)^(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key)",
}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|reply|send|to|from)\W*$",
    "ip": r"(?i)(?:ip|host|server|address|addr|from|login)\W*$",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|pay|no)\W*$",
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|dial)\W*$",
    "secret": r"(?i)(?:user|login|account|with|and|credentials|auth)\W*$",
}
#: Characters before a span that the context labeler sees.
BEFORE = 24
#: Share of the candidates of a kind that must get another vote of a labeler than the rest for it to count in the estimation.
TELLING = 0.01


def scan(values: Column, join) -> Column:
    """What ``join`` (associative) makes of each beginning of an array, in as many steps as its length has binary digits."""

    def run(own: Column) -> Column:
        digits = F.ceil(F.log2(F.greatest(F.size(own), F.lit(2)).cast("double"))).cast("int")
        apart = F.transform(F.sequence(F.lit(0), digits - 1), lambda k: F.pow(F.lit(2), k).cast("int"))
        step = lambda a, d: F.transform(a, lambda x, i: F.when(i >= d, join(F.get(a, i - d), x)).otherwise(x))
        return F.when(F.size(own) <= 1, own).otherwise(F.aggregate(apart, own, step))

    return let(values, run)


def spans(text: Column, pattern: str, hint: str) -> Column:
    """All matches as array<struct<start, stop, s, before, after>>, from the pieces between them.

    ``before`` holds up to BEFORE characters, not from further back than the
    match before. The time is linear in the text, but for a factor of the
    logarithm of the number of matches.
    """
    none = F.array().cast("array<struct<start:bigint,stop:bigint,s:string,before:string,after:string>>")

    def build(found: Column, pieces: Column) -> Column:
        ends = scan(F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: (F.char_length(p) + F.char_length(m)).cast("long")), lambda a, b: a + b)
        follow = F.transform(found, lambda m, i: F.left(F.concat(F.get(pieces, i + 1), F.coalesce(F.get(found, i + 1), F.lit(""))), F.lit(1)))
        lead = F.transform(found, lambda m, i: F.right(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(pieces, i)), F.lit(BEFORE)))
        zipped = F.arrays_zip(ends.alias("stop"), found.alias("s"), lead.alias("before"), follow.alias("after"))
        return F.transform(
            zipped,
            lambda z: F.struct((z["stop"] - F.char_length(z["s"])).alias("start"), z["stop"].alias("stop"), z["s"].alias("s"), z["before"].alias("before"), z["after"].alias("after")),
        )

    walked = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(F.split(text, pattern, -1), lambda pieces: build(found, pieces)))
    return F.when(text.rlike(hint), walked).otherwise(none)


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether a text's digits pass the Luhn check."""
    d = F.reverse(digits(s))
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substr(d, i, F.lit(1)).cast("int") + 1)),
    )
    return total % 10 == 0


def valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]?)(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits(s)).between(16, 19), luhn(s)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(s)).between(8, 15)
    return F.lit(True)


def _valid(kind: str):
    return lambda x: valid(kind, x["s"])


def _is(kind: str):
    return lambda x: x["kind"] == kind


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, each kind's base spans and the looser candidates; one scan of the texts, and short rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    for kind in KINDS:
        if kind in BASE:
            rows = rows.withColumn(f"b_{kind}", F.filter(spans(F.col("text"), BASE[kind], HINT[kind]), _valid(kind)))
    named = lambda k, strict: lambda x: F.struct(F.lit(k).alias("kind"), F.lit(strict).alias("base"), x.alias("at"))
    base = [F.transform(f"b_{k}", named(k, True)) for k in BASE]
    loose = [F.transform(spans(F.col("text"), LOOSE[k], LOOSE_HINT[k]), named(k, False)) for k in LOOSE]
    return rows.select("doc_id", F.concat(*base, *loose).alias("found"))


def _case(table: dict[str, str], kind: Column, value: Column) -> Column:
    out = F.lit(False)
    for k, pattern in table.items():
        out = F.when(kind == k, value.rlike(pattern)).otherwise(out)
    return out


def vote(x: Column) -> Column:
    """The labelers' votes on a candidate."""
    kind, at = x["kind"], x["at"]
    s, before, after = at["s"], at["before"], at["after"]
    kinds = F.size(F.array_distinct(F.split(s, ""))) / F.greatest(F.length(s), F.lit(1))
    edge = r"[\s\p{Punct}]"
    return F.struct(
        _case(SHAPE, kind, s).cast("int").alias("shape"),
        F.when(_case(GAZETTEER, kind, s), 1).otherwise(2).alias("gazetteer"),
        F.when(_case(CONTEXT, kind, before), 1).otherwise(2).alias("context"),
        (((before == "") | before.rlike(edge + "$")) & ((after == "") | after.rlike("^" + edge))).cast("int").alias("border"),
        F.when(kinds < 0.2, 0).when(F.size(F.array_distinct(F.split(s, ""))) > 4, 1).otherwise(2).alias("variety"),
    )


def reliabilities(counts: list[tuple[tuple[int, ...], float]], sure: list[tuple[tuple[int, ...], float]] = (), rounds: int = 50) -> tuple[float, list[dict], list[float]]:
    """EM over (votes, count): the share of true candidates, each labeler's vote chances by truth, each pattern's probability.

    ``sure`` are patterns of spans that are true: they count for the vote chances, at most as much as all others, not for the share.
    """
    total = sum(n for _, n in counts)
    share = lambda k, v: sum(n for p, n in counts if p[k] == v) >= TELLING * total
    # a labeler that votes the same on nearly all tells nothing; to begin with, those that say both yes and no decide
    active = [k for k in range(len(VOTES)) if sum(share(k, v) for v in (0, 1, 2)) > 1] or list(range(len(VOTES)))
    told = [k for k in active if share(k, 0) and share(k, 1)] or range(len(VOTES))
    post = [sum(p[k] == 1 for k in told) / max(1, sum(p[k] != 2 for k in told)) for p, _ in counts]
    scale = min(1.0, total / max(1.0, sum(n for _, n in sure)))
    prior, tables = 0.5, []
    for _ in range(rounds):
        yes = sum(n * q for (_, n), q in zip(counts, post))
        no = total - yes
        prior = (yes + 1) / (yes + no + 2)
        given = scale * sum(n for _, n in sure)
        tables = []
        for k in range(len(VOTES)):
            own = {v: [1.0, 1.0] for v in (0, 1, 2)}
            own[1][1] += 1.0  # a labeler is taken to be better than chance
            own[0][0] += 1.0
            for (p, n), q in zip(counts, post):
                own[p[k]][1] += n * q
                own[p[k]][0] += n * (1 - q)
            for p, n in sure:
                own[p[k]][1] += n * scale
            tables.append({v: (a / (no + 4), b / (yes + given + 4)) for v, (a, b) in own.items()})
        new = []
        for p, _ in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(tables[k][p[k]][1] / tables[k][p[k]][0]) for k in active)
            new.append(1 / (1 + math.exp(-max(-30, min(30, odds)))))
        if max((abs(a - b) for a, b in zip(post, new)), default=0) < 1e-6:
            break
        post = new
    return prior, tables, post


def _features(kind: str, votes: tuple[int, ...]) -> list[float]:
    """One, the kind, and for each kind its votes: a labeler counts for each kind by itself."""
    return [1.0, *(float(kind == k) for k in KINDS), *(float(kind == k) * x for k in KINDS for v in votes for x in (float(v == 1), float(v == 0)))]


def classifier(rows: list[tuple[str, tuple[int, ...], float, float]], rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Logistic weights from (kind, votes, count, probability), by gradient steps on the bounded table."""
    feats = [_features(k, v) for k, v, _, _ in rows]
    total = sum(math.log1p(n) for _, _, n, _ in rows) or 1.0
    w = [0.0] * len(_features("", (2,) * len(VOTES)))
    for _ in range(rounds):
        grad = [ridge * x for x in w]
        for f, (_, _, n, q) in zip(feats, rows):
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, f))))))
            e = math.log1p(n) / total * (p - q)
            for i, x in enumerate(f):
                if x:
                    grad[i] += e * x
        w = [a - rate * 4 * g for a, g in zip(w, grad)]
    return w


def free(found: Column) -> Column:
    """The candidates that overlap no base span: all spans in the order of their starts, with what base spans reach from the left and from the right."""
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["at"]["start"].alias("start"), x["at"]["stop"].alias("stop"), x.alias("x"))))

    def sift(own: Column) -> Column:
        left = scan(F.transform(own, lambda o: F.when(o["x"]["base"], o["stop"]).otherwise(F.lit(-1).cast("long"))), lambda a, b: F.greatest(a, b))
        right = scan(F.reverse(F.transform(own, lambda o: F.when(o["x"]["base"], o["start"]).otherwise(F.lit(1 << 62)))), lambda a, b: F.least(a, b))
        both = F.arrays_zip(own.alias("o"), left.alias("l"), F.reverse(right).alias("r"))
        kept = F.filter(both, lambda z: ~z["o"]["x"]["base"] & (z["l"] <= z["o"]["start"]) & (z["r"] >= z["o"]["stop"]))
        return F.transform(kept, lambda z: z["o"]["x"])

    return let(ordered, sift)


def learn(counts: list[tuple[str, bool, tuple[int, ...], float]]) -> list[float]:
    """Weights of the span classifier from (kind, base, votes, count); reliabilities are estimated for each kind by itself.

    Base spans are certain, so their votes tell how the labelers see true
    spans; what the loose candidates are is estimated.
    """
    rows = []
    for kind in sorted({k for k, _, _, _ in counts}):
        sure = [(v, n) for k, b, v, n in counts if k == kind and b]
        own = [(v, n) for k, b, v, n in counts if k == kind and not b]
        _, _, post = reliabilities(own, sure)
        rows += [(kind, v, n, 1.0) for v, n in sure] + [(kind, v, n, q) for (v, n), q in zip(own, post)]
    return classifier(rows)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: arrays of struct<kind, start, stop, s> in the order of kinds and starts."""
    found, _ = save(extract(docs))
    seen = found.select(F.explode("found").alias("x")).select(F.col("x.kind").alias("kind"), F.col("x.base").alias("base"), vote(F.col("x")).alias("v"))
    table = seen.groupBy("kind", "base", "v").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 times 5 kinds times 3 ** 5 patterns
    w = learn(sorted((r["kind"], r["base"], tuple(r["v"]), float(r["n"])) for r in table))
    size = len(KINDS) * (1 + 2 * len(VOTES))

    def margin(x: Column) -> Column:
        v = vote(x)
        own = F.lit(w[0])
        for k, kind in enumerate(KINDS):
            part = F.lit(w[1 + k])
            for i, name in enumerate(VOTES):
                at = 1 + len(KINDS) + 2 * (k * len(VOTES) + i)
                part = part + F.when(v[name] == 1, F.lit(w[at])).when(v[name] == 0, F.lit(w[at + 1])).otherwise(F.lit(0.0))
            own = own + F.when(x["kind"] == kind, part).otherwise(F.lit(0.0))
        return own

    assert len(w) == 1 + size
    rows = found.withColumn("base", F.filter("found", lambda x: x["base"])).withColumn("loose", F.when(F.size("found") > 0, free(F.col("found"))).otherwise(F.col("found")))
    rows = rows.withColumn("added", F.filter("loose", lambda x: margin(x) >= 0))
    flat = lambda c: F.transform(c, lambda x: F.struct(x["kind"].alias("kind"), x["at"]["start"].alias("start"), x["at"]["stop"].alias("stop"), x["at"]["s"].alias("s")))
    return rows.select("doc_id", flat("base").alias("base"), flat("added").alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """Numbers and a digest of the base spans, all spans as text, and the numbers of added spans by kind."""
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    line = lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(place[x["kind"]].alias("k"), x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    return find(docs).select(
        "doc_id",
        *[F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform("base", line), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(every, line), ",").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        *[F.size(F.filter("added", _is(k))).cast("long").alias(f"n_added_{k}") for k in LOOSE],
    )
