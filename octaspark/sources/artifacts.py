"""Model files: the binary form of linear models, the JSON form of language models, and sidecars that tell what a file was trained on."""

from __future__ import annotations

import hashlib
import json
import math
import os
import struct

import numpy as np

from ..functions.features import gram, ngram_codes
from ..operators.model import Language, Linear
from ..schemas import LANGUAGE

# Fixed values of the formats.
MAGIC = {"f8": b"CCM1", "f4": b"CCM2"}
LANGUAGE_SCHEMA = "vnext-l3-unicode-trigram-v1"
MOST = {"bytes": 256 << 20, "features": 200_000, "classes": 256, "language_bytes": 8_000_000}
_HEAD = struct.Struct("<4sIIBBBB")


class Damaged(ValueError):
    """A model file that can't be trusted."""


def _text(s: str) -> bytes:
    raw = s.encode()
    if not 0 < len(raw) <= 256:
        raise Damaged("text of a model must have 1 to 256 bytes")
    return struct.pack("<H", len(raw)) + raw


def pack(model: Linear, precision: str = "f8") -> bytes:
    """Header, labels, vocabulary, weights and a digest of all that."""
    if precision not in MAGIC:
        raise ValueError("precision must be f8 or f4")
    width, rows = len(model.codes), 1 if len(model.labels) == 2 else len(model.labels)
    if model.weights.shape != (rows, width) or len(model.idf) != width or len(model.intercept) != rows:
        raise Damaged("sizes of the model's parts differ")
    if width > MOST["features"] or len(model.labels) > MOST["classes"]:
        raise Damaged("model above its bounds")
    flags = {"binary": 1, "sublinear": 2, "plain": 0}[model.weighting]
    parts = [_HEAD.pack(MAGIC[precision], width, len(model.labels), *model.ngrams, flags, 0), *map(_text, model.labels)]
    parts += [struct.pack("<I", i) + _text(gram(int(code))) for i, code in enumerate(model.codes)]
    parts += [np.asarray(x, "<f8").tobytes() for x in (model.idf, model.intercept)]
    parts.append(np.ascontiguousarray(model.weights, "<" + precision).tobytes())
    body = b"".join(parts)
    return body + hashlib.sha256(body).digest()


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Damaged("model file ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> int:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def text(self) -> str:
        n = self.number("<H")
        if not 0 < n <= 256:
            raise Damaged("text of a model must have 1 to 256 bytes")
        try:
            return self.take(n).decode()
        except UnicodeDecodeError as e:
            raise Damaged("text of a model is not UTF-8") from e

    def floats(self, n: int, form: str = "<f8") -> np.ndarray:
        out = np.frombuffer(self.take(n * int(form[-1])), form).astype(np.float64)
        if not np.isfinite(out).all():
            raise Damaged("a weight is not a finite number")
        return out


def unpack(data: bytes) -> Linear:
    """The model of :func:`pack`'s bytes; anything out of order is an error."""
    if not _HEAD.size + 32 < len(data) <= MOST["bytes"]:
        raise Damaged("model file of an impossible size")
    if hashlib.sha256(data[:-32]).digest() != data[-32:]:
        raise Damaged("the digest doesn't fit the model file")
    c = _Cursor(data[:-32])
    magic, width, classes, low, high, flags, spare = _HEAD.unpack(c.take(_HEAD.size))
    form = next((f for f, m in MAGIC.items() if m == magic), None)
    if form is None:
        raise Damaged("unknown kind of model file")
    if not (0 < width <= MOST["features"] and 2 <= classes <= MOST["classes"] and 0 < low <= high <= 3 and flags < 4 and spare == 0):
        raise Damaged("header out of bounds")
    labels = [c.text() for _ in range(classes)]
    grams: list[str | None] = [None] * width
    for _ in range(width):
        i, g = c.number("<I"), c.text()
        if i >= width or grams[i] is not None or not low <= len(g) <= high or max(g) > "￿":
            raise Damaged("vocabulary entry out of order")
        grams[i] = g
    if len(set(grams)) < width:
        raise Damaged("an n-gram occurs twice")
    rows = 1 if classes == 2 else classes
    idf, intercept, weights = c.floats(width), c.floats(rows), c.floats(rows * width, "<" + form).reshape(rows, width)
    if c.at != len(c.data):
        raise Damaged("more bytes than the model needs")
    codes = np.array([ngram_codes(g, len(g), len(g))[0] for g in grams], np.int64)
    order = np.argsort(codes)
    kept = weights[:, order].astype(np.float32) if form == "f4" else weights[:, order]
    return Linear(labels, codes[order], idf[order], kept, intercept, (low, high), "binary" if flags & 1 else "sublinear" if flags & 2 else "plain")


def write_linear(model: Linear, path: str, precision: str = "f8", fingerprint: str | None = None) -> tuple[str, int]:
    """The file's digest and size; with the training data's ``fingerprint`` a sidecar is written beside it."""
    data = pack(model, precision)
    with open(path, "wb") as out:
        out.write(data)
    digest = hashlib.sha256(data).hexdigest()
    if fingerprint:
        with open(path + ".meta.json", "w", encoding="utf-8") as out:
            json.dump({"model_sha256": digest, "training_fingerprint": fingerprint}, out, sort_keys=True)
    return digest, len(data)


def read_linear(path: str) -> tuple[Linear, str]:
    """The model and its fingerprint: the training data's if a sidecar tells it for this very file, else the file's digest."""
    with open(path, "rb") as f:
        data = f.read(MOST["bytes"] + 1)
    digest = hashlib.sha256(data).hexdigest()
    if os.path.exists(path + ".meta.json"):
        with open(path + ".meta.json", encoding="utf-8") as f:
            told = json.load(f)
        own = told.get("training_fingerprint")
        if told.get("model_sha256") != digest or not isinstance(own, str) or len(own) != 64 or not set(own) <= set("0123456789abcdef"):
            raise Damaged("the sidecar doesn't belong to the model file")
        return unpack(data), own
    return unpack(data), digest


def write_language(model: Language, path: str, fingerprint: str) -> None:
    own = {"schema": LANGUAGE_SCHEMA, "grams": model.grams, "total": sum(model.grams.values()), "fingerprint": fingerprint, "alpha": model.alpha}
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write(json.dumps(own, sort_keys=True, ensure_ascii=False))


def read_language(path: str) -> tuple[Language, str]:
    if os.path.getsize(path) > MOST["language_bytes"]:
        raise Damaged("language model too large")
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    grams, alpha, fp = told.get("grams"), told.get("alpha"), told.get("fingerprint")
    sound = {
        "schema": told.get("schema") == LANGUAGE_SCHEMA,
        "vocabulary": isinstance(grams, dict) and 0 < len(grams) <= LANGUAGE["grams"] and all(len(k) == 3 and type(v) is int and v > 0 for k, v in grams.items()),
        "smoothing": type(alpha) in (int, float) and math.isfinite(alpha) and alpha > 0,
        "fingerprint": isinstance(fp, str) and len(fp) == 64,
    }
    sound["total"] = sound["vocabulary"] and told.get("total") == sum(grams.values())
    if wrong := [k for k, ok in sound.items() if not ok]:
        raise Damaged(f"language model with a wrong {wrong[0]}")
    return Language(grams, float(alpha)), fp
