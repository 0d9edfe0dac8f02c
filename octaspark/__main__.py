"""Detect the encoding of a file, or of many with Spark, or fit a model.

    python -m octaspark FILE [--json | --decode] [--bom-policy strip|preserve] [--model MODEL] [--language MODEL]
    python -m octaspark scan FOLDER OUT      every file of a folder, as a Parquet table
    python -m octaspark fit MANIFEST MODEL   a model and a report of a manifest's training rows
"""

from __future__ import annotations

import argparse
import json
import sys

from .operators.detect import detect_bytes
from .schemas import INPUT_CAP


def _one(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="octaspark", description="Detect the encoding of a file")
    p.add_argument("file", nargs="?", default="-", help="a file, or - for standard input")
    mode = p.add_mutually_exclusive_group()
    mode.add_argument("--json", action="store_true", help="write what was found as JSON")
    mode.add_argument("--decode", action="store_true", help="write the text as UTF-8")
    p.add_argument("--bom-policy", choices=("strip", "preserve"), default="strip")
    p.add_argument("--model")
    p.add_argument("--language")
    a = p.parse_args(argv)
    try:
        with sys.stdin.buffer if a.file == "-" else open(a.file, "rb") as f:
            raw = f.read(INPUT_CAP + 1)
        if len(raw) > INPUT_CAP:
            raise ValueError(f"input above {INPUT_CAP} bytes")
        from .default import default_model
        from .sources.artifacts import read_language, read_linear

        found = detect_bytes(raw, read_linear(a.model)[0] if a.model else default_model(), read_language(a.language)[0] if a.language else None, a.bom_policy)
    except (OSError, ValueError) as e:
        print(f"octaspark: {e}", file=sys.stderr)
        return 2
    if a.json:
        print(json.dumps({k: getattr(found, k) for k in ("encoding", "accepted", "ambiguous", "candidates", "bom_present", "reason")}, ensure_ascii=False))
        return 0
    if not found.accepted:
        print("octaspark: no strict reading" if a.decode else "unknown", file=sys.stderr if a.decode else sys.stdout)
        return 2
    if a.decode:
        sys.stdout.buffer.write(found.text.encode())
    else:
        print(found.encoding)
        if found.ambiguous:
            print("octaspark: the label is ambiguous", file=sys.stderr)
    return 0


def fit(spark, manifest: str, path: str, residual: bool = False) -> dict:
    """Train on a manifest's training rows, measure on its validation rows, write the model; returns the report."""
    from pyspark.sql import functions as F

    from .operators import corpus, detect, model
    from .sources import artifacts
    from .sources import manifest as m

    rows = m.read(spark, manifest)
    train, held = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    some = corpus.residual(train.withColumn("guess", corpus.structural_guess(F.col("raw"))), "encoding", "guess", "line_no") if residual else train
    linear = model.fit_linear(some.select("raw", "encoding"))
    digests = train.withColumn("prefix_sha256", F.sha2(F.substring("raw", 1, 4096), 256))
    prints = [corpus.canonical_fingerprint(train, "line_no").first().fingerprint, corpus.historical_fingerprint(digests, "line_no").first().fingerprint]
    digest, size = artifacts.write_linear(linear, path, fingerprint=prints[0])
    found = detect.detect(held.select("encoding", "raw"), linear)
    n, label, accepted = found.agg(F.count(F.lit(1)), F.count_if(F.col("detection.encoding") == F.col("encoding")), F.count_if("detection.accepted")).first()
    per = {r.encoding: r.n for r in train.groupBy("encoding").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each label
    return {
        "train_rows": sum(per.values()), "fitted_rows": some.count(), "train_by_label": dict(sorted(per.items())), "labels": linear.labels, "features": len(linear.codes), "ngrams": list(linear.ngrams),
        "validation_rows": n, "validation_label_accuracy": label / n if n else None, "validation_accepted": accepted, "content_fingerprint": prints[0], "prefix_fingerprint": prints[1], "model_sha256": digest, "model_bytes": size, "residual": residual,
    }


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["scan"] and len(argv) == 3:
        from pyspark.sql import SparkSession

        from .default import default_model
        from .operators.detect import detect
        from .sources.variants import binary_files

        detect(binary_files(SparkSession.builder.getOrCreate(), argv[1]), default_model()).select("path", "detection.*").write.parquet(argv[2])
        return 0
    if argv[:1] == ["fit"] and len(argv) == 3:
        from pyspark.sql import SparkSession

        print(json.dumps(fit(SparkSession.builder.getOrCreate(), *argv[1:]), indent=2, sort_keys=True))
        return 0
    return _one(argv)


if __name__ == "__main__":
    sys.exit(main())
