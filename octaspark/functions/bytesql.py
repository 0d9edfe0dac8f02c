"""Byte predicates as Catalyst expressions over BINARY columns; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PREFIX, RESCUE, SIGNATURES, UTF16, UTF32

#: What Python's regular expressions take for white space within Latin-1; Java's own class is smaller.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0]"


def literal(hexed: str) -> Column:
    return F.expr(f"X'{hexed}'")


def latin1(raw: Column) -> Column:
    """One character for each byte."""
    return F.decode(raw, "ISO-8859-1")


def prefix(raw: Column, n: int = PREFIX) -> Column:
    return F.substring(raw, 1, n)


def bom_encoding(raw: Column) -> Column:
    """The signature's label, longest signature first; null without one."""
    out = F.lit(None).cast("string")
    for hexed, label in reversed(SIGNATURES):
        out = F.when(F.startswith(raw, literal(hexed)), F.lit(label)).otherwise(out)
    return out


def bom_incomplete(raw: Column, final: Column) -> Column:
    """Whether more bytes could still make this a (longer) signature."""
    some = F.lit(False)
    for hexed, _ in SIGNATURES:
        for n in range(2, len(hexed), 2):
            some = some | (raw == literal(hexed[:n]))
    return ~final & some


def inspect_bom(raw: Column, final: Column) -> Column:
    """struct<encoding, incomplete>; nothing is told while more bytes could change it."""
    wait = bom_incomplete(raw, final)
    return F.struct(F.when(~wait, bom_encoding(raw)).alias("encoding"), wait.alias("incomplete"))


def is_utf8(raw: Column) -> Column:
    return F.is_valid_utf8(raw.cast("string"))


def count_bytes(raw: Column, regex: str) -> Column:
    return F.regexp_count(latin1(raw), F.lit(regex))


def high_count(raw: Column) -> Column:
    return count_bytes(raw, r"[\x80-\xFF]")


def signals(raw: Column) -> Column:
    """struct<strict, nul, high, n, route> of the first 4096 bytes; the cut may split a character, which counts as invalid."""
    p = prefix(raw)
    high, n = high_count(p), F.length(p)
    strict, nul = is_utf8(p), count_bytes(p, r"\x00") > 0
    route = F.when(strict, "U").when(nul, "N").when(high.cast("double") <= F.lit(0.02) * F.greatest(n, F.lit(1)), "RL").otherwise("RH")
    return F.struct(strict.alias("strict"), nul.alias("nul"), high.cast("long").alias("high"), n.cast("long").alias("n"), route.alias("route"))


def utf8_evidence(raw: Column) -> Column:
    """struct<valid, non_ascii, controls>: what the UTF-8 rescue weighs."""
    valid = is_utf8(raw)
    text = raw.cast("string")
    return F.struct(
        valid.alias("valid"),
        F.when(valid, F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))).otherwise(0).cast("long").alias("non_ascii"),
        (valid & text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]")).alias("controls"),
    )


def strong_utf8(raw: Column, least: int = RESCUE["non_ascii"]) -> Column:
    e = utf8_evidence(raw)
    return (F.length(raw) >= RESCUE["bytes"]) & bom_encoding(raw).isNull() & e["valid"] & ~e["controls"] & (e["non_ascii"] >= least)


def printable_ascii(raw: Column) -> Column:
    return (F.length(raw).between(1, PREFIX)) & bom_encoding(raw).isNull() & latin1(raw).rlike(r"^[\t\n\r -~]+\z")


def c1_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[\u0080-\u009f]"))


def lanes(raw: Column, step: int, offset: int) -> Column:
    """NUL bytes at every ``step``-th place from ``offset`` of the first 4096 bytes (a whole number of steps)."""
    skip, hit = (f"{'.' * offset}{x}{'.' * (step - offset - 1)}" for x in (r"[^\x00]", r"\x00"))
    return F.regexp_count(latin1(prefix(raw)), F.lit(rf"(?s)\G(?:{skip})*+{hit}"))  # each match begins where the one before ends, so at a whole step


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def utf16_parity(raw: Column) -> Column:
    """utf-16-le or utf-16-be by where NUL bytes lie; null without clear evidence."""
    n = F.least(F.length(raw), F.lit(PREFIX))
    pairs = F.floor(n / 2)

    def told(nul: Column) -> Column:
        even, odd = nul["even"], nul["odd"]
        most, least = F.greatest(even, odd), F.least(even, odd)
        clear = (most >= F.greatest(F.lit(UTF16["least"]), F.floor(pairs.cast("double") * F.lit(UTF16["share"])))) & (most >= UTF16["factor"] * F.greatest(least, F.lit(1)))
        return F.when(clear, F.when(odd > even, "utf-16-le").otherwise("utf-16-be"))

    return F.when(n >= UTF16["bytes"], once(F.struct(lanes(raw, 2, 0).alias("even"), lanes(raw, 2, 1).alias("odd")), told))


def utf32_lanes(raw: Column) -> Column:
    """utf-32-le or utf-32-be by NUL lanes; null if neither, or both, qualify."""
    n = F.floor(F.least(F.length(raw), F.lit(PREFIX)) / 4)

    def told(nul: Column) -> Column:
        def fits(primary: int, empty: tuple[int, int]) -> Column:
            return (nul[f"n{primary}"] <= F.floor(n / 4)) & (nul[f"n{empty[0]}"] >= F.floor(n * 9 / 10)) & (nul[f"n{empty[1]}"] >= F.floor(n * 9 / 10))

        le, be = fits(0, (2, 3)), fits(3, (0, 1))
        return F.when(le & ~be, "utf-32-le").when(be & ~le, "utf-32-be")

    ok = (F.length(prefix(raw)) >= UTF32["bytes"]) & (n >= UTF32["units"])
    return F.when(ok, once(F.struct(*[lanes(raw, 4, k).alias(f"n{k}") for k in range(4)]), told))


def hmt768(raw: Column) -> Column:
    """Up to 768 bytes: all, or 256 each from the head, around the middle and the tail."""
    n = F.length(raw)
    middle = F.floor(n / 2) - 128
    return F.when(n <= 768, raw).otherwise(F.concat(F.substring(raw, 1, 256), F.substr(raw, (middle + 1).cast("int"), F.lit(256)), F.substr(raw, (n - 255).cast("int"), F.lit(256))))


def family(label: Column) -> Column:
    """The codec family of a label."""
    v = F.regexp_replace(F.lower(label), "_", "-")
    return (
        F.when(v.startswith("utf"), "utf").when(v.rlike("^(cp125|windows-125|cp874)"), "singlebyte-win").when(v.rlike("^(iso8859|iso-8859|latin)"), "singlebyte-iso")
        .when(v.rlike("^(gb|big5|euc|shift|cp932|cp949|johab|iso2022|hz|cp950)"), "cjk").when(v.startswith("koi8"), "koi8").when(v == "ascii", "ascii").otherwise("other")
    )


def fold3(group: Column) -> Column:
    """Fold 0 to 2 of a group from 48 bits of its SHA-256."""
    return (F.conv(F.substring(F.sha2(group.cast("binary"), 256), 1, 12), 16, 10).cast("long") % 3).cast("int")


def fold5(group: Column) -> Column:
    """Fold 0 to 4 from the whole 256-bit number: as 256 is 1 modulo 5, its bytes' sum decides."""
    digest = F.sha2(group.cast("binary"), 256)
    total = F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda a, i: a + F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    return (total % 5).cast("int")


def blocks(raw: Column, block: int = 128, step: int = 64) -> Column:
    """Distinct hashes of ``block``-byte spans each ``step`` bytes; none for shorter inputs."""
    n = F.length(raw)
    spans = F.transform(F.sequence(F.lit(0), F.floor((n - block) / step).cast("int")), lambda k: F.xxhash64(F.substr(raw, k * step + 1, F.lit(block))))
    return F.when(n >= block, F.array_distinct(spans)).otherwise(F.array().cast("array<bigint>"))


def mask_charset(text: Column) -> Column:
    """Every token after charset= replaced by as many question marks."""
    return F.regexp_replace(text, r"(?i)(?<=charset\s{0,8}=\s{0,8}[\"']?[A-Za-z0-9_.:-]{0,63})[A-Za-z0-9_.:-]", "?")


#: Byte machines of multi-byte encodings as patterns over the Latin-1 view: a whole character, and the beginnings of one.
MACHINES = {
    "utf-8": (
        r"[\x{00}-\x{7F}]|[\x{C2}-\x{DF}][\x{80}-\x{BF}]|\x{E0}[\x{A0}-\x{BF}][\x{80}-\x{BF}]|[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]{2}|\x{ED}[\x{80}-\x{9F}][\x{80}-\x{BF}]"
        r"|\x{F0}[\x{90}-\x{BF}][\x{80}-\x{BF}]{2}|[\x{F1}-\x{F3}][\x{80}-\x{BF}]{3}|\x{F4}[\x{80}-\x{8F}][\x{80}-\x{BF}]{2}",
        r"\x{F0}[\x{90}-\x{BF}][\x{80}-\x{BF}]?|[\x{F1}-\x{F3}][\x{80}-\x{BF}]{1,2}|\x{F4}[\x{80}-\x{8F}][\x{80}-\x{BF}]?|\x{E0}[\x{A0}-\x{BF}]|[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]|\x{ED}[\x{80}-\x{9F}]|[\x{C2}-\x{F4}]",
    ),
    "shift-jis": (r"[\x{00}-\x{7F}\x{A1}-\x{DF}]|[\x{81}-\x{9F}\x{E0}-\x{FC}][\x{40}-\x{7E}\x{80}-\x{FC}]", r"[\x{81}-\x{9F}\x{E0}-\x{FC}]"),
    "euc-jp": (r"[\x{00}-\x{7F}]|\x{8E}[\x{A1}-\x{DF}]|\x{8F}[\x{A1}-\x{FE}]{2}|[\x{A1}-\x{FE}]{2}", r"\x{8F}[\x{A1}-\x{FE}]?|\x{8E}|[\x{A1}-\x{FE}]"),
    "big5": (r"[\x{00}-\x{7F}]|[\x{81}-\x{FE}][\x{40}-\x{7E}\x{A1}-\x{FE}]", r"[\x{81}-\x{FE}]"),
    "gb18030": (r"[\x{00}-\x{7F}]|[\x{81}-\x{FE}](?:[\x{40}-\x{7E}\x{80}-\x{FE}]|[\x{30}-\x{39}][\x{81}-\x{FE}][\x{30}-\x{39}])", r"[\x{81}-\x{FE}](?:[\x{30}-\x{39}][\x{81}-\x{FE}]?)?"),
}


def machine(raw: Column, encoding: str) -> Column:
    """struct<status, consumed>: valid, invalid or incomplete, and the bytes read until that was clear (for UTF-8, up to the character at fault)."""
    unit, part = MACHINES[encoding]
    view = latin1(raw)
    whole = F.length(F.regexp_extract(view, f"^(?:{unit})*+", 0))
    rest = F.length(F.regexp_extract(F.substr(view, whole + 1, F.length(view)), f"^(?:{part})", 0))
    n = F.length(view)
    status = F.when(whole + rest < n, "invalid").when(rest > 0, "incomplete").otherwise("valid")
    return F.struct(status.alias("status"), (whole if encoding == "utf-8" else whole + rest).cast("long").alias("consumed"))


def lossy_utf8(raw: Column) -> Column:
    """struct<replaced, chars>: replacement characters, and all, of a lossy reading as UTF-8 (the longest beginning of a character counts once)."""
    unit, part = MACHINES["utf-8"]
    view = latin1(raw)
    marked = F.regexp_replace(view, unit, "V")
    wrong = F.regexp_count(marked, F.lit(rf"{part}|[\x{{80}}-\x{{FF}}]"))
    right = F.length(marked) - F.length(F.replace(marked, F.lit("V"), F.lit("")))
    given = F.regexp_count(view, F.lit("\u00ef\u00bf\u00bd"))
    return F.struct((wrong + given).cast("long").alias("replaced"), (wrong + right).cast("long").alias("chars"))


def trimmed(raw: Column) -> Column:
    """The bytes without a UTF-8 character cut off at the end (three bytes at most); null if that doesn't help."""
    out = F.lit(None).cast("binary")
    for k in reversed(range(4)):
        own = F.substr(raw, F.lit(1), F.greatest(F.length(raw) - k, F.lit(0)))
        out = F.when(is_utf8(own), own).otherwise(out)
    return out


def source_group(stem: Column) -> Column:
    """The group of a file stem: lower case, two collections under one name."""
    return F.replace(F.replace(F.lower(stem), F.lit("culturax_mc4_"), F.lit("culturax_")), F.lit("culturax_oscar-2301_"), F.lit("culturax_"))


def han_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[㐀-鿿]"))


def meta_charset(raw: Column) -> Column:
    """The label that a meta tag in the first 1024 bytes declares; empty without one."""
    return F.lower(F.regexp_extract(latin1(F.substring(raw, 1, 1024)), r"(?i)<meta\b[^>]{0,256}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", 1))


def normalized_view(raw: Column) -> Column:
    """The Latin-1 view of the prefix, lower-cased, runs of two or more white spaces made one space."""
    return F.regexp_replace(F.lower(latin1(prefix(raw))), SPACE + "{2,}", " ")
