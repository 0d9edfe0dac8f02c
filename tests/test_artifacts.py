"""Model files, manifests, folders, archives, streams, the command line and SQL functions."""

import io
import json
import os
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from octaspark import __main__ as cli
from octaspark import default
from octaspark.operators import detect as d
from octaspark.operators.model import Language, fit_objects
from octaspark.sources import artifacts, manifest
from octaspark.streaming import files as streams

ROWS = [(f"heißt übung größe {i} ".encode(e) * 20, e) for i in range(8) for e in ("utf-8", "cp1252", "cp437")]


@pytest.fixture(scope="module")
def model():
    return fit_objects(sorted(ROWS))


@pytest.mark.parametrize("precision", ["f8", "f4"])
def test_linear_file(model, tmp_path, precision):
    path = str(tmp_path / "m")
    artifacts.write_linear(model, path, precision, "ab" * 32)
    got, fingerprint = artifacts.read_linear(path)
    assert fingerprint == "ab" * 32 and got.labels == model.labels and np.allclose(got.scores(ROWS[0][0]), model.scores(ROWS[0][0]), atol=1e-6)
    data = open(path, "rb").read()
    for bad in (data[:-1], data + b"x", b"XXXX" + data[4:], data[:100] + b"\x00" + data[101:], b""):
        with pytest.raises(artifacts.Damaged):
            artifacts.unpack(bad)
    os.remove(path + ".meta.json")
    assert len(artifacts.read_linear(path)[1]) == 64
    with open(path + ".meta.json", "w") as f:
        json.dump({"model_sha256": "0" * 64, "training_fingerprint": "0" * 64}, f)
    with pytest.raises(artifacts.Damaged):
        artifacts.read_linear(path)


def test_header_bounds(model):
    import hashlib

    body = artifacts.pack(model)[:-32]
    for at, form, value in ((4, "<I", 0), (8, "<I", 1), (12, "B", 0), (13, "B", 4), (14, "B", 4), (15, "B", 1)):
        own = bytearray(body)
        struct.pack_into(form, own, at, value)
        with pytest.raises(artifacts.Damaged):
            artifacts.unpack(bytes(own) + hashlib.sha256(bytes(own)).digest())


def test_language_file(tmp_path):
    path = str(tmp_path / "l.json")
    artifacts.write_language(Language({"the": 3, " th": 2}), path, "c" * 64)
    got, fp = artifacts.read_language(path)
    assert got.grams == {"the": 3, " th": 2} and fp == "c" * 64 and not open(path).read().endswith("\n")
    own = json.load(open(path))
    for k, v in (("schema", "x"), ("total", 6), ("alpha", 0), ("alpha", float("inf")), ("fingerprint", "c"), ("grams", {"ab": 5}), ("grams", {})):
        with open(path, "w") as f:
            json.dump(own | {k: v}, f)
        with pytest.raises(artifacts.Damaged):
            artifacts.read_language(path)


def write_manifest(folder, rows, kind="training"):
    os.makedirs(folder / "c", exist_ok=True)
    for name, raw, _, _, _ in rows:
        if raw is not None:
            (folder / "c" / name).write_bytes(raw)
    path = folder / "manifest.jsonl"
    path.write_text("\n".join(["", *(json.dumps({"path": f"c/{n}", "encoding": e, "group": g, "split": s}) for n, _, e, g, s in rows)]))
    return str(path)


GOOD = [("a", "grün".encode(), "utf-8", "g1", "train"), ("b", "grün".encode("cp1252"), "cp1252", "g2", "train"), ("v", "später".encode(), "utf-8", "g3", "validation")]


@pytest.mark.parametrize("kind, extra, rule", [
    ("training", [], None), ("legacy", [], None), ("evaluation", [], None),
    ("training", [("a2", "grün".encode(), "utf-8", "g9", "train")], None),
    ("training", [("w", b"\xff", "utf-8", "g9", "train")], "label does not decode bytes"),
    ("training", [("w", b"x", "no-codec", "g9", "train")], "unknown codec"),
    ("training", [("w", b"x", "utf-8", "g1", "validation")], "source-group leakage"),
    ("training", [("w", "grün".encode(), "utf-8", "g9", "validation")], "duplicate bytes cross labels/splits"),
    ("training", [("w", b"", "utf-8", "g9", "train")], "missing or empty input"),
    ("training", [("w", None, "utf-8", "g9", "train")], "missing or empty input"),
    ("training", [("w", b"x", "utf-8", "", "train")], "missing group"),
    ("training", [("w", b"x", "utf-8", "g9", "test")], "unsupported split"),
    ("evaluation", [("w", "grün".encode(), "utf-8", "g9", "test")], "duplicated bytes across splits"),
    ("evaluation", [("w", "grün".encode(), "utf_8", "g9", "train")], "duplicated evaluation content"),
    ("evaluation", [("w", "grün".encode(), "cp437", "g9", "train")], "conflicting labels for identical bytes"),
])
def test_manifest(spark, tmp_path, kind, extra, rule):
    path = write_manifest(tmp_path, GOOD + extra)
    if rule:
        with pytest.raises(ValueError, match=f"line 5: {rule}"):
            manifest.read(spark, path, kind)
    else:
        got = manifest.read(spark, path, kind).collect()
        assert len(got) == 3 and {r.path for r in got} == {"c/a", "c/b", "c/v"}


def test_manifest_escape_json_and_digests(spark, tmp_path):
    path = write_manifest(tmp_path, GOOD)
    lines = open(path).read()
    for line, rule in (('{"path": "../x", "encoding": "utf-8", "group": "g", "split": "train"}', "path escapes"), ("{oops", "invalid JSON"),
                       ('{"path": "c/a", "encoding": "utf-8", "group": "g1", "split": "train", "sha256": "00"}', "sha256 mismatch")):
        with open(path, "w") as f:
            f.write(lines + "\n" + line)
        with pytest.raises(ValueError, match=rule):
            manifest.read(spark, path)


def test_directory_and_archives(spark, tmp_path):
    for folder, name, raw in (("utf-8-german", "A_culturax_mC4_1.txt", "grün".encode()), ("cp1252-de", "b.txt", "grün".encode("cp1252")), ("utf-8", "same.txt", "grün".encode()), ("utf-8", "bad.txt", b"\xff"), ("utf-8", "none.txt", b""), ("klingon", "k.txt", b"x")):
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / name).write_bytes(raw)
    got = {r.path: r for r in manifest.directory(spark, str(tmp_path)).collect()}
    assert set(got) == {"utf-8/same.txt", "cp1252-de/b.txt"} or set(got) == {"utf-8-german/A_culturax_mC4_1.txt", "cp1252-de/b.txt"}
    assert got["cp1252-de/b.txt"].encoding == "cp1252"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, raw in (("corpus/g1/a", b"one"), ("corpus/g2/b", b"one"), ("corpus/g2/c", b""), ("other/x", b"y"), ("corpus/g3/d", b"two")):
            z.writestr(name, raw)
    rows = manifest.zipped(spark.createDataFrame([("z", out.getvalue()), ("y", b"no archive")], "path string, raw binary")).collect()
    assert {(r.name, r.reason) for r in rows} == {("corpus/g1/a", None), ("corpus/g2/b", "duplicate"), ("corpus/g2/c", "size"), ("other/x", "unexpected_path"), ("corpus/g3/d", None), (None, "not_an_archive")}
    manifest.write(spark.createDataFrame([(2, "b"), (1, "a")], "n int, path string"), str(tmp_path / "out"))
    assert [r.path for r in spark.read.json(str(tmp_path / "out")).collect()] == ["a", "b"]
    assert json.loads(manifest.report(spark.createDataFrame([(1, "a")], "n int, path string"), str(tmp_path / "r.json"))) == [{"n": 1, "path": "a"}]


def test_default_model_and_command_line(tmp_path, capsysbinary):
    texts = {"cp1251": "Завтра утром мы поедем в город за хлебом", "shift_jis": "駅はどこですか。ありがとうございます", "utf-16-le": "plain words, many of them, on one line"}
    for label, text in texts.items():
        found = default.detect(text.encode(label))
        assert (found.encoding, found.text) == (label, text)
    assert default.decode("Grüße".encode("utf-8-sig")) == "Grüße"
    with pytest.raises(TypeError):
        default.detect("text")
    path = str(tmp_path / "f")
    with open(path, "wb") as f:
        f.write(texts["cp1251"].encode("cp1251"))
    assert cli.main([path]) == 0 and capsysbinary.readouterr().out == b"cp1251\n"
    assert cli.main([path, "--decode"]) == 0 and capsysbinary.readouterr().out.decode() == texts["cp1251"]
    assert cli.main([path, "--json"]) == 0 and set(json.loads(capsysbinary.readouterr().out)) == {"encoding", "accepted", "ambiguous", "candidates", "bom_present", "reason"}
    assert cli.main([str(tmp_path / "missing")]) == 2
    with pytest.raises(SystemExit):
        cli.main([path, "--json", "--decode"])


def test_fit_job(spark, tmp_path):
    rows = [(f"t{i}", raw, e, f"g{i}", "train" if i % 4 else "validation") for i, (raw, e) in enumerate(ROWS)]
    report = cli.fit(spark, write_manifest(tmp_path, rows), str(tmp_path / "model"))
    assert report["train_rows"] == sum(r[4] == "train" for r in rows) and report["validation_label_accuracy"] == 1.0 and os.path.getsize(tmp_path / "model") == report["model_bytes"]


def test_abstention_is_ambiguous_and_large_inputs_get_a_reason(spark, model, monkeypatch):
    assert d.detect_bytes(b"a" * 5000 + b"\xff", fit_objects([(b"ab" * 9, "utf-8"), (b"cd" * 9, "ascii")])).ambiguous
    monkeypatch.setattr(d.c, "too_large", lambda raw: raw is not None and len(raw) > 10)
    df = spark.createDataFrame([(1, b"x" * 20), (2, b"x")], "id int, raw binary")
    monkeypatch.undo()
    got = {r.id: r.detection for r in d.detect(df, model).collect()}
    assert got[2].reason != "input_too_large"


def test_sql_functions(spark, model):
    d.register(spark, model)
    spark.createDataFrame([(1, "Größe".encode("cp1252")), (2, b"\xff\xfea\x00")], "id int, raw binary").createOrReplaceTempView("octa_t")
    got = spark.sql("SELECT id, bom_encoding(raw) AS bom, strict_decode(raw, 'cp1252') AS text, decodable_codecs(raw, array('utf-8', 'cp1252')) AS ok, detect_encoding(raw) AS e FROM octa_t ORDER BY id").collect()
    assert (got[0].bom, got[0].text, got[0].ok) == (None, "Größe", ["cp1252"]) and got[1].bom == "utf-16-le"
    assert spark.sql("SELECT n FROM ngrams(X'616161', 2, 3) ORDER BY n").collect()[1].n == 2
    assert spark.sql("SELECT count(*) AS n FROM byte_blocks(unhex(repeat('61', 256)))").first().n == 3
    assert spark.sql("SELECT p95(v) AS p FROM (SELECT CAST(id AS DOUBLE) AS v FROM range(1, 11))").first().p == 9.0
    assert len(spark.sql("SELECT fingerprint(v) AS f FROM (SELECT explode(array('a', 'b')) AS v)").first().f) == 64


def test_stream_of_files(spark, model, tmp_path):
    os.makedirs(tmp_path / "in")
    for i, (raw, _) in enumerate(ROWS[:6]):
        (tmp_path / "in" / f"f{i}").write_bytes(raw)
    stream = d.detect(streams.stream_files(spark, str(tmp_path / "in")), model).select("path", "detection.encoding")
    query = stream.writeStream.format("memory").queryName("octa_stream").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {os.path.basename(r.path): r.encoding for r in spark.table("octa_stream").collect()}
    assert got == {f"f{i}": e for i, (_, e) in enumerate(ROWS[:6])}
    streams.detect_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp2"), model).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_chunks_are_put_together(spark, tmp_path):
    parts = [("a", 1, True, b"\x00b\x00"), ("a", 0, False, b"\xff\xfea"), ("b", 0, False, b"\xef\xbb")]
    for k, part in enumerate(parts):
        spark.createDataFrame([part], "key string, number int, last boolean, part binary").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("key string, number int, last boolean, part binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = streams.reassemble(stream).writeStream.format("memory").queryName("octa_chunks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [(r.key, r.raw and bytes(r.raw), r.state, r.bom_encoding) for r in spark.table("octa_chunks").collect()]
    assert ("a", b"\xff\xfea\x00b\x00", "whole", "utf-16-le") in got and ("b", None, "incomplete", None) in got and len(got) == 3
