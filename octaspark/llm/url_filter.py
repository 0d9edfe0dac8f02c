"""URL filters: all glob rules at once by a bit-parallel wildcard automaton (Shift-And).

Every rule becomes a row of symbols, a bit each, packed one after another into
64-bit words. A canonical URL is read character by character (code points, not
bytes); per character, one shift,
one AND with the symbol's mask and one OR of the bits that may stay (wildcards)
move every rule forward. URLs of a batch are simulated side by side.

Canonical form: ``.`` + host, then a mark that no URL holds, then the path. A
host rule such as ``example.net/en/`` is the glob ``*.example.net`` + mark +
``/en/*``, so it fits the host, its subdomains and paths that start so. A plain
glob has ``*`` for any run of characters and ``?`` for one, and is matched against
``host/path``, whole.

Of the host rules that fit, the longest decides (of equally long ones, the one
with the longer host, then the first); without any, a URL is blocked if a plain
glob fits, else allowed. A null URL, or one without ``://``, has an empty host
and path, so no host rule fits. Repeated rows and null page_ids come back as they
are, each with its own verdict; only page_id and url are read, whatever the other
columns are. An empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, slices, strings

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: What is blocked where no rule fits.
GLOBS = ("*/ads/*", "*/track?/*", "*.exe")
#: Symbols: code points, then the mark between host and path.
MARK, ANY, ONE = 0x110000, -1, -2


def _glob(pattern: str) -> list[int]:
    return [{"*": ANY, "?": ONE}.get(c, ord(c)) for c in pattern]


def _host_glob(rule: str) -> list[int]:
    host, _, path = rule.partition("/")
    return [ANY, *map(ord, f".{host.lower()}"), MARK, *map(ord, f"/{path}"), ANY]


class Automaton:
    """Bit j of a pattern is set while its first j symbols (wildcards apart) are read."""

    def __init__(self, patterns: list[list[int]]):
        places, self.last = 0, []
        start, stay, steps = [], [], []
        for p in patterns:
            start.append(places)
            for c in p:
                if c == ANY:
                    stay.append(places)  # any symbol leaves this bit set
                else:
                    places += 1
                    steps.append((places, c))
            self.last.append(places)
            places += 1
        self.words = max(1, -(-places // 64))
        # a row of masks for each symbol that a pattern names, one for all others and one for the mark
        self.named = np.array(sorted({c for _, c in steps if c not in (ONE, MARK)}), np.int64)
        self.mask = np.zeros((len(self.named) + 2, self.words), np.uint64)
        for bit, c in steps:
            rows = slice(0, -1) if c == ONE else -1 if c == MARK else int(np.searchsorted(self.named, c))
            self.mask[rows, bit // 64] |= np.uint64(1) << np.uint64(bit % 64)
        self.start, self.stay = self._bits(start), self._bits(stay)

    def _bits(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for b in places:
            out[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return out

    def rows(self, symbols: np.ndarray) -> np.ndarray:
        """The row of masks of each symbol."""
        other = len(self.named)
        at = np.searchsorted(self.named, symbols)
        out = np.where((at < other) & (np.append(self.named, -1)[at] == symbols), at, other)
        out[symbols == MARK] = other + 1
        return out

    def run(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which patterns match which rows whole; row i has symbols at[i] up to at[i + 1]."""
        size = np.diff(at)
        symbols = self.rows(symbols)
        state = np.tile(self.start, (len(size), 1))
        order = np.argsort(-size, kind="stable")
        size, begin = size[order], at[:-1][order]
        for i in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -i, "left"))  # the rows that have a symbol here
            s = state[:live]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            moved &= self.mask[symbols[begin[:live] + i]]
            moved |= s & self.stay
            state[:live] = moved
        out = np.empty((len(size), len(self.last)), bool)
        for k, b in enumerate(self.last):
            out[order, k] = (state[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)
        return out


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    return host.translate(_LOWER), rest[:cut]


_LOWER = {c: c + 32 for c in range(65, 91)}


def _judge(rules, globs):
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1]), -len(rules[k][1].partition("/")[0]), k))
    rules = [rules[k] for k in order]
    names = pa.array([r for _, r in rules], pa.string())
    hosts, plain = Automaton([_host_glob(r) for _, r in rules]), Automaton([_glob(g) for g in globs])
    blocks = np.array([v == "block" for v, _ in rules], bool)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "url"):
                split = [parts(u) for u in strings(part.column(part.schema.get_field_index("url"))).to_pylist()]
                found = []
                for machine, form in ((hosts, lambda h, p: (f".{h}", p)), (plain, lambda h, p: (h, p))):
                    marked = machine is hosts
                    texts = [form(h, p) for h, p in split]
                    joined = [f"{h}\0{p}" if marked else h + p for h, p in texts]
                    at = np.cumsum([0, *map(len, joined)])
                    symbols = np.frombuffer("".join(joined).encode("utf-32-le"), "<u4").astype(np.int64)
                    if marked:
                        symbols[at[:-1] + np.array([len(h) for h, _ in texts], np.int64)] = MARK
                    found.append(machine.run(symbols, at))
                fits, other = found
                ruled = fits.any(1)
                first = fits.argmax(1) if len(rules) else np.zeros(len(split), np.int64)
                block = np.where(ruled, blocks[first] if len(rules) else False, other.any(1))
                rule = names.take(pa.array(first, pa.int64(), mask=~ruled))
                keep = [c for c in part.schema.names if c != "url"]
                arrays = [part.column(part.schema.get_field_index(c)) for c in keep]
                arrays += [pa.array([h for h, _ in split]), pa.array([p for _, p in split]), rule, pa.array(np.where(block, "block", "allow").tolist(), pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules=RULES, globs=GLOBS) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return arrow_map(pages.select("page_id", "url"), _judge(tuple(rules), tuple(globs)), f"page_id {kind}, host string, path string, rule string, verdict string")


ORACLE = """
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM split
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN (host || path) LIKE '%/ads/%' OR (host || path) LIKE '%/track_/%' OR (host || path) LIKE '%.exe' THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
