"""Codecs of the wire: hexadecimal and Base64 bytes, little-endian numbers in hexadecimal, big-endian document ids, JSON messages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_hex(c) -> Column:
    return F.hex(F.col(c) if isinstance(c, str) else c)


def from_hex(c) -> Column:
    """Null for text that isn't hexadecimal."""
    return F.unhex(F.col(c) if isinstance(c, str) else c)


def to_base64(c) -> Column:
    """On one line; Spark breaks its own after 76 characters."""
    return F.regexp_replace(F.base64(F.col(c) if isinstance(c, str) else c), r"[\r\n]", "")


def from_base64(c) -> Column:
    return F.unbase64(F.col(c) if isinstance(c, str) else c)


@F.pandas_udf(T.StringType())
def floats_to_hex(v: pd.Series) -> pd.Series:
    """Single-precision numbers as upper-case hexadecimal of their little-endian bytes."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes().hex().upper())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def floats_from_hex(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None or len(x) % 8 else np.frombuffer(bytes.fromhex(x), "<f4"))


@F.pandas_udf(T.StringType())
def longs_to_hex(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, "<i8").tobytes().hex().upper())


@F.pandas_udf(T.ArrayType(T.LongType()))
def longs_from_hex(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None or len(x) % 16 else np.frombuffer(bytes.fromhex(x), "<i8"))


def xid_bytes(c) -> Column:
    """A document id as eight big-endian bytes."""
    return F.unhex(F.lpad(F.hex(F.col(c) if isinstance(c, str) else c), 16, "0"))


def xid_number(c) -> Column:
    """Back to a number; also for negative ids, whose first bit is set."""
    h = F.hex(F.col(c) if isinstance(c, str) else c)
    return F.conv(h, 16, -10).cast("bigint")


#: fields of the messages, by kind
MESSAGES: dict[str, str] = {
    "search": "collection_name string, n int, d int, k int, nprobe int, k_factor int, metric_type int, vecs string",
    "search_response": "status boolean, msg string, n int, k int, scores string, ids string",
    "add": "collection_name string, n int, d int, vecs string, ids string",
    "add_response": "status boolean, msg string",
    "rerank": "collection_name string, n int, d int, k int, nprobe int, metric_type int, vecs string, input_ids string",
    "delete": "collection_name string, ids string",
    "checkpoint": "collection_name string",
    "load": "collection_name string, mode int",
    "list": "status boolean, msg string, collections array<string>",
    "kv": "type int, keys array<string>, vals array<string>",
    "embed": "data string, model_type string",
}


def to_message(*fields) -> Column:
    """A JSON message of columns; null fields are left out."""
    return F.to_json(F.struct(*fields))


def from_message(c, kind: str) -> Column:
    """A struct of the fields of a kind of message; fields that are missing are null, as is everything in text that isn't JSON."""
    return F.from_json(F.col(c) if isinstance(c, str) else c, MESSAGES[kind])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def fp16_encode(v: pd.Series) -> pd.Series:
    """Bit patterns of the numbers in half precision."""
    return v.map(lambda x: None if x is None else np.asarray(x, np.float32).astype(np.float16).view(np.uint16).astype(np.int32))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def fp16_decode(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, np.int32).astype(np.uint16).view(np.float16).astype(np.float64))
