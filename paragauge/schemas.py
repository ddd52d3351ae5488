"""Explicit schemas: nothing in this package infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

CORPUS = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("target", T.StringType())]
)

KEYED_CORPUS = T.StructType([T.StructField("row_id", T.LongType()), *CORPUS.fields])

PREDICTIONS = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("prediction", T.StringType()),
        T.StructField("model", T.StringType()),
    ]
)

SPLIT_CORPUS = T.StructType([*KEYED_CORPUS.fields, T.StructField("split", T.StringType())])

PERF = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("train_min", T.DoubleType()),
        T.StructField("eval_min", T.DoubleType()),
        T.StructField("gpu", T.StringType()),
    ]
)

SYNONYMS = T.StructType(
    [T.StructField("word", T.StringType()), T.StructField("alt", T.StringType())]
)
