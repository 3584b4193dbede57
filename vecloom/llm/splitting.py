"""Splitting oversized texts at natural boundaries, with overlap.

A text is measured once: prefix sums over its characters, of characters or of tokens of a public tokenizer (``tokens``: how many begin before each character). Its possible
cuts form one sorted offset array per kind of boundary: ends of paragraphs, sentences, lines, clauses and words. Piece by piece, the furthest place within the limit is
found by binary search in the sums, and the last boundary before it by binary search in the offsets, the best kind first; a boundary in the first half of the piece
is passed over for one of a lesser kind in the second half. With no boundary at all the piece is cut hard at the limit, though not inside a
character with its combining marks or between CR and LF unless the limit leaves nothing else. The next piece begins ``overlap`` (by the sums) before the cut.

Defined results: null and empty texts give no piece; a text within its limit gives one; null, unknown or non-positive limits mean no limit;
an overlap below 0 counts as 0 and one of half the limit or more as just under half, so every piece makes way; of repeated rows of one
id one counts; an empty table gives no rows; columns of clashing names are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Tokenizer

#: best first; a cut falls at the end of a match
BOUNDARIES = [
    re.compile(r"(?:\r?\n|\r)[ \t]*(?:\r?\n|\r)\s*"),
    regex.compile(r"(?:[.!?…؟۔।॥]+[\"'”’»)\]]*\s+|[。！？｡]+[」』”’）]*\s*)"),
    re.compile(r"\r\n|\r|\n"),
    re.compile(r"[,;:、，；：،]\s*"),
    re.compile(r"\s+"),
]
KINDS = ["paragraph", "sentence", "line", "clause", "word", "hard", "end"]
JOINED = regex.compile(r"[\p{M}‍️\n]")


def boundary_offsets(text: str) -> list[np.ndarray]:
    return [np.fromiter((m.end() for m in b.finditer(text)), np.int64) for b in BOUNDARIES]


def split(text: str, limit: int | None, overlap: int | None = 0, sums: np.ndarray | None = None) -> list[tuple[int, int, str]]:
    """Pieces as (begin, end, kind of cut). ``sums`` are the sizes of all prefixes (len(text) + 1 ascending numbers, 0 first); without
    them every character has size 1."""
    n = len(text)
    if not n:
        return []
    if sums is None:
        sums = np.arange(n + 1)
    if limit is None or limit <= 0 or sums[-1] <= limit:
        return [(0, n, "end")]
    over = min(max(overlap or 0, 0), max(0, (limit - 1) // 2))
    cuts = boundary_offsets(text)
    out, begin = [], 0
    while True:
        # furthest end within the limit
        far = int(np.searchsorted(sums, sums[begin] + limit, "right")) - 1
        if far >= n:
            out.append((begin, n, "end"))
            return out
        far = max(far, begin + 1)  # one character may exceed the limit in another unit
        back = lambda end: int(np.searchsorted(sums, sums[end] - over, "left"))
        end, kind = 0, "hard"
        for least in (begin + (far - begin) // 2, begin):
            for k, c in enumerate(cuts):
                i = int(np.searchsorted(c, far, "right")) - 1
                if i >= 0 and c[i] > least and back(int(c[i])) > begin:
                    end, kind = int(c[i]), KINDS[k]
                    break
            if end:
                break
        if not end:
            end = far
            while end > begin + 1 and JOINED.match(text[end]) and back(end - 1) > begin:
                end -= 1
            if JOINED.match(text[end]) and text[end] != "\n" and end == begin + 1:
                end = far
        out.append((begin, end, kind))
        begin = max(back(end), begin + 1)


def _pieces(unit: Tokenizer | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("src", pa.string()), ("id", pa.int64()), ("piece_no", pa.int32()), ("begin_char", pa.int64()), ("end_char", pa.int64()), ("cut", pa.string()), ("piece", pa.string())])
    cols: list[list] = [[] for _ in schema]
    size = 0
    for b in batches:
        for src, id, limit, over, text in zip(*(b.column(c) for c in ("src", "id", "most", "overlap", "text"))):
            t = text.as_py() or ""
            most = limit.as_py()
            # a token has at least one byte, so a text of few bytes is within the limit without being parted into tokens
            sums = None if unit is None or not t or most is None or most <= 0 or 4 * len(t) <= most else unit.sums(t)
            for k, (s, e, kind) in enumerate(split(t, most, over.as_py(), sums)):
                for col, v in zip(cols, (src.as_py(), id.as_py(), k, s, e, kind, t[s:e])):
                    col.append(v)
                size += e - s
            if size > 1 << 24 or len(cols[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
                cols, size = [[] for _ in schema], 0
    if cols[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def pieces(df: DataFrame, src: str, id: str, text: str, limit: str, overlap: str, unit: Tokenizer | None = None) -> DataFrame:
    """Pieces of each row's text: ``src, id, piece_no`` from 0, ``begin_char, end_char, cut, piece``; limit and overlap count characters, or tokens of ``unit``. Of rows of equal src and id the one
    of the greatest text counts. Splitting is done where the rows are; only the removal of repeated rows shuffles."""
    rows = df.select(F.col(src).alias("src"), F.col(id).cast("bigint").alias("id"), F.struct(F.col(text).alias("text"), F.col(limit).cast("bigint").alias("most"), F.col(overlap).cast("bigint").alias("overlap")).alias("x"))
    one = rows.filter("id is not null").groupBy("src", "id").agg(F.max("x").alias("x")).select("src", "id", "x.most", "x.overlap", "x.text")
    return one.mapInArrow(partial(_pieces, unit), "src string, id bigint, piece_no int, begin_char bigint, end_char bigint, cut string, piece string")
