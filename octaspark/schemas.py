"""Fixed values and result schemas of the encoding engine."""

from __future__ import annotations

from pyspark.sql import types as T

# These define what results mean.
PREFIX = 4096
CANDIDATES = 3
STABLE = {"ngrams": (2, 3), "min_df": 2, "max_features": 45_000}
WIDE = {"ngrams": (1, 3), "min_df": 1, "max_features": 90_000}
FIT = {"alpha": 1e-4, "rounds": 1500, "seed": 20261015}
RESCUE = {"bytes": 64, "non_ascii": 3}
UTF16 = {"bytes": 32, "least": 12, "share": 0.30, "factor": 4}
UTF32 = {"bytes": 64, "units": 16}
LANGUAGE = {"margin": 0.20, "advantage": 0.15, "trigrams": 12, "alpha": 0.5, "grams": 30_000}
RESIDUAL = {"anchors": 2, "drop": 0.35}
OVERLAP = {"block": 128, "step": 64, "shared": 3}
INPUT_CAP = 16 * 1024 * 1024
#: Longest first.
SIGNATURES = (("0000FEFF", "utf-32-be"), ("FFFE0000", "utf-32-le"), ("EFBBBF", "utf-8-sig"), ("FEFF", "utf-16-be"), ("FFFE", "utf-16-le"))

DETECTION = T.StructType(
    [
        T.StructField("encoding", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("candidates", T.ArrayType(T.StringType(), False), False),
        T.StructField("bom_encoding", T.StringType()),
        T.StructField("bom_present", T.BooleanType(), False),
        T.StructField("ambiguous", T.BooleanType(), False),
        T.StructField("reason", T.StringType(), False),
        T.StructField("bom_policy", T.StringType(), False),
        T.StructField("l3_called", T.BooleanType(), False),
        T.StructField("l3_changed", T.BooleanType(), False),
        T.StructField("accepted", T.BooleanType(), False),
    ]
)
