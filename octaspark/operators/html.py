"""HTML charset resolution: declarations, precedence, strict then lossy decoding."""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import stream
from . import codecs as c

SCAN = 1 << 20
FALLBACK = "windows-1252"
#: What a declared or assumed encoding is worth: only a signature, an override or a header is authoritative.
CAVEAT = "prototype_only_not_whatwg_conformant"

# Encodings of the public Encoding Standard with their labels, in its order. Labels that
# follow from a name by rule (iso-8859-N, windows-N) are made below.
_STANDARD = {
    "utf-8": "unicode-1-1-utf-8 unicode11utf8 unicode20utf8 utf-8 utf8 x-unicode20utf8",
    "ibm866": "866 cp866 csibm866 ibm866",
    "iso-8859-2": "csisolatin2 iso-ir-101 iso_8859-2:1987 l2 latin2",
    "iso-8859-3": "csisolatin3 iso-ir-109 iso_8859-3:1988 l3 latin3",
    "iso-8859-4": "csisolatin4 iso-ir-110 iso_8859-4:1988 l4 latin4",
    "iso-8859-5": "csisolatincyrillic cyrillic iso-ir-144 iso_8859-5:1988",
    "iso-8859-6": "arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6-e iso-8859-6-i iso-ir-127 iso_8859-6:1987",
    "iso-8859-7": "csisolatingreek ecma-118 elot_928 greek greek8 iso-ir-126 iso_8859-7:1987 sun_eu_greek",
    "iso-8859-8": "csiso88598e csisolatinhebrew hebrew iso-8859-8-e iso-ir-138 iso_8859-8:1988 visual",
    "iso-8859-8-i": "csiso88598i iso-8859-8-i logical",
    "iso-8859-10": "csisolatin6 iso-ir-157 l6 latin6",
    "iso-8859-13": "",
    "iso-8859-14": "",
    "iso-8859-15": "csisolatin9 l9",
    "iso-8859-16": "",
    "koi8-r": "cskoi8r koi koi8 koi8-r koi8_r",
    "koi8-u": "koi8-ru koi8-u",
    "macintosh": "csmacintosh mac macintosh x-mac-roman",
    "windows-874": "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620",
    "windows-1250": "",
    "windows-1251": "",
    "windows-1252": "ansi_x3.4-1968 ascii cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii",
    "windows-1253": "",
    "windows-1254": "csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5",
    "windows-1255": "",
    "windows-1256": "",
    "windows-1257": "",
    "windows-1258": "",
    "x-mac-cyrillic": "x-mac-cyrillic x-mac-ukrainian",
    "gbk": "chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk",
    "gb18030": "gb18030",
    "big5": "big5 big5-hkscs cn-big5 csbig5 x-x-big5",
    "euc-jp": "cseucpkdfmtjapanese euc-jp x-euc-jp",
    "iso-2022-jp": "csiso2022jp iso-2022-jp",
    "shift_jis": "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis",
    "euc-kr": "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949",
    "utf-16be": "utf-16be",
    "utf-16le": "utf-16 utf-16le",
}
#: Python codecs whose names don't follow from the standard's.
_CODEC = {"iso-8859-8-i": "iso8859-8", "windows-874": "cp874", "x-mac-cyrillic": "mac_cyrillic", "big5": "big5hkscs", "shift_jis": "cp932", "euc-kr": "cp949", "utf-16be": "utf-16-be", "utf-16le": "utf-16-le"}


def _labels() -> dict[str, str]:
    out = {}
    for name, own in _STANDARD.items():
        family, _, n = name.rpartition("-")
        by_rule = []
        if family == "iso-8859" and n.isdigit():
            by_rule = [name, f"iso8859-{n}", f"iso8859{n}"] if n in ("10", "13", "14") else [name] if n == "16" else [name, f"iso8859-{n}", f"iso8859{n}", f"iso_8859-{n}"]
        elif family == "windows":
            by_rule = [name] if n == "874" else [name, f"cp{n}", f"x-cp{n}"]
        out |= dict.fromkeys([*by_rule, *own.split()], name)
    return out


WEB = _labels()


def web_label(label: str | None) -> str | None:
    """The standard's name of the encoding that a label stands for."""
    return WEB.get((label or "").strip(" \t\r\n\f").lower())


def codec_of(name: str) -> str:
    """The Python codec that reads an encoding of the standard."""
    return _CODEC.get(name, name.replace("windows-", "cp"))


def _declared(label: str | None) -> str | None:
    """A label that was read as ASCII, or sent beside the bytes, can't mean UTF-16."""
    name = web_label(label)
    return "utf-8" if name in ("utf-16le", "utf-16be") else name


def http_charset(header: str | None) -> str | None:
    """The one charset parameter of an HTML content type."""
    if header is None:
        return None
    if len(header) > 2048 or "\r" in header or "\n" in header:
        raise ValueError("unsafe content_type length or line break")
    kind, *params = header.split(";")
    if kind.strip().lower() not in ("text/html", "application/xhtml+xml"):
        return None
    own = [v.strip().strip("\"'") for k, _, v in (p.partition("=") for p in params) if k.strip().lower() == "charset"]
    return _declared(own[0]) if len(own) == 1 else None


class _Meta(HTMLParser):
    """Stops at the first meta tag with a known label; comments and scripts are not tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag != "meta" or self.found:
            return
        own = dict(reversed(attrs))
        label = own.get("charset")
        if label is None and (own.get("http-equiv") or "").strip().lower() == "content-type":
            m = re.search(r"charset\s*=\s*[\"']?\s*([^\s;\"'>]+)", own.get("content") or "", re.I)
            label = m and m[1]
        self.found = _declared(label)


def meta_label(raw: bytes) -> str | None:
    parser = _Meta()
    parser.feed(raw[:SCAN].decode("latin-1"))
    return parser.found


def whatwg(raw: bytes, label: str) -> tuple[bool, str | None, str | None]:
    """(valid, encoding, text) of a fatal decoding under a label of the standard; of an unknown label no encoding."""
    name = web_label(label)
    if name is None:
        return False, None, None
    for sign, own in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if name == own:
            raw = raw.removeprefix(sign)
    try:
        return True, name, raw.decode(codec_of(name))
    except UnicodeError:
        return False, name, None


def resolve(raw: bytes, transport: str | None = None, override: str | None = None, fallback: str = FALLBACK) -> dict:
    """Signature, then override, transport, meta tag, and the fallback last; strictly decoded if possible, else with replacements.

    The meta tag is looked for only where nothing before it decides. An unknown
    override or fallback, and a malformed header, raise ValueError.
    """
    if override is not None and web_label(override) is None:
        raise ValueError("unknown explicit encoding override")
    if web_label(fallback) is None:
        raise ValueError("unknown fallback encoding")
    if c.too_large(raw):
        raise ValueError("HTML input exceeds byte limit")
    head, meta = http_charset(transport), None
    sign = next(((s, n) for s, n in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")) if raw.startswith(s)), None)
    if sign:
        name, source, raw = sign[1], "bom", raw[len(sign[0]) :]
    elif override is not None:
        name, source = web_label(override), "override"
    elif head:
        name, source = head, "transport"
    else:
        meta = meta_label(raw)
        name, source = (meta, "meta") if meta else (web_label(fallback), "fallback")
    try:
        text, replaced = raw.decode(codec_of(name)), False
    except UnicodeError:
        text, replaced = raw.decode(codec_of(name), "replace"), True
    return {"text": text, "encoding": name, "source": source, "used_replacement": replaced, "meta": meta, "transport": head, "warning": CAVEAT if source in ("meta", "fallback") else None, "error": None}


RESULT = "text string, encoding string, source string, used_replacement boolean, meta string, transport string, warning string, error string"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _resolved(raw: bytes, transport: str | None, override: str | None) -> dict:
    try:
        return resolve(raw, transport, override)
    except ValueError as e:
        return dict.fromkeys(_NAMES) | {"error": str(e)}


def decode_html(df: DataFrame, column: str = "raw", transport: str | None = None, override: str | None = None) -> DataFrame:
    """``df`` without the bytes, with the resolved text and where its encoding came from, in one Arrow stage.

    A row that can't be resolved (malformed header, unknown override, too large) says why in ``error``; the others go on.
    """
    keep = [x for x in df.columns if x != column]
    extra = [F.col(x) if x else F.lit(None).cast("string") for x in (transport, override)]
    own = df.select(*keep, extra[0].alias("octa_t"), extra[1].alias("octa_o"), column)

    def run(batches):
        for batch in batches:
            t, o, r = (batch.column(batch.num_columns - k).to_pylist() for k in (3, 2, 1))
            rows = [_resolved(x or b"", a, b) for x, a, b in zip(r, t, o)]
            cols = [pa.array([x[n] for x in rows], pa.bool_() if n == "used_replacement" else pa.string()) for n in _NAMES]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=[*keep, *_NAMES])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return stream(own, run, f"{kinds}, {RESULT}")


def decode_whatwg(df: DataFrame, column: str = "raw", label: str = "label") -> DataFrame:
    """``df`` without the bytes, with encoding, valid and text_sha256 of a fatal decoding under each row's label."""
    keep = [x for x in df.columns if x != column]
    own = df.select(*keep, column)
    at = keep.index(label)

    def run(batches):
        for batch in batches:
            found = [whatwg(r or b"", x or "") for x, r in zip(batch.column(at).to_pylist(), batch.column(len(keep)).to_pylist())]
            digest = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() if t is not None else None for _, _, t in found]
            cols = [pa.array([n for _, n, _ in found], pa.string()), pa.array([v for v, _, _ in found], pa.bool_()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cols], names=[*keep, "encoding", "valid", "text_sha256"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return stream(own, run, f"{kinds}, encoding string, valid boolean, text_sha256 string")


def mask_tags(text):
    """struct<masked, tags>: every ASCII tag made one space, and how many there were."""
    return F.struct(F.regexp_replace(text, r"<[A-Za-z/!?][^<>]*>", " ").alias("masked"), F.regexp_count(text, F.lit(r"<[A-Za-z/!?][^<>]*>")).cast("long").alias("tags"))
