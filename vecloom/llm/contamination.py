"""Held-out passages in a corpus, by greedy string tiling.

1. Seeds. Texts and passages are tokens; of every ``least`` consecutive tokens the short window (half as long) of the least hash is a seed, so two texts with ``least`` tokens in
   common share one wherever that run lies. Only a text's seeds leave the task in which it is read, and of these only those that some passage has, where the passages' seeds are few
   enough to be sent to the tasks (``SEEDS``); where they aren't, the join alone decides. Texts aren't shuffled.
2. Join. Seeds of texts and passages are joined on the seed: candidates, a pair for each text and passage. They are joined back to the texts.
3. Tiling. Karp-Rabin hashes of all short windows of a text and a passage that agree, token by token, are joined along diagonals to maximal matches. The longest match
   that lies on unmarked tokens of both sides is marked again and again (tiles), so a passage whose sentences were reordered is still covered.
4. A pair counts if its longest tile has ``least`` tokens, or if the tiles cover at least the share ``coverage`` of the passage, which shows reordered passages in shorter fragments.

Tokens: HTML tags are taken out first without parting their neighbours; the rest is compared without case and accents; a token is
a maximal run of letters or digits, or a single letter or digit for passages of languages in ``char_langs``.

Defined results: null and empty texts and passages match nothing; passages shorter than the least match can't be found; repeated passages under
several ids are reported under each; of repeated rows of one id the greatest passage counts, of repeated documents the greatest text; rows with a null id are left out;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded, cut

WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
MARK = re.compile(r"[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
DENSE = re.compile(r"[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3\U00020000-\U0003ffff]")
SEEDS = 4_000_000  # seeds of passages, eight bytes each, that may be sent to the tasks
CACHED = 1_000_000  # words whose codes a worker remembers
_codes: dict[str, int] = {}

def plain(text: str) -> str:
    """Without tags, case and accents."""
    if "<" in text:
        text = TAG.sub("", text)
    text = text.casefold()
    if not text.isascii():
        text = MARK.sub("", unicodedata.normalize("NFD", text))
    return text


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ROOT = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        n = max(n, 2 * len(_POWERS[0]), 4096)
        for k, root in enumerate((_ROOT, pow(_ROOT, -1, 1 << 64))):
            steps = np.full(n, root, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every window."""
    n = len(codes)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        total = np.append(np.uint64(0), np.cumsum(_mix(codes) * up[:n], dtype=np.uint64))
        return _mix((total[width:] - total[:-width]) * down[: n - width + 1])


def tokens(text: str, chars: bool) -> np.ndarray:
    """64-bit codes of the tokens of a plain text."""
    words = WORD.findall(text)
    if chars:
        return _mix(np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4"))
    if len(_codes) > CACHED:
        _codes.clear()
    get = _codes.get
    out = [get(w) for w in words]
    for i, c in enumerate(out):
        if c is None:
            out[i] = _codes[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    return np.array(out, np.uint64)


def seeds(codes: np.ndarray, least: int) -> np.ndarray:
    """Distinct seeds of a row of tokens."""
    short = (least + 1) // 2
    h = windows(codes, short)
    around = least - short + 1
    if len(h) < around:
        return np.empty(0, np.uint64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, around).min(axis=1))


def tile(matches: list[tuple[int, int, int]], width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of maximal matches (length, position in text, position in passage): the longest that is free first; of a
    match that is partly marked its free parts of at least ``width`` go on."""
    tiles: list[tuple[int, int, int]] = []
    left = [(-n, p, q) for n, p, q in matches]
    heapq.heapify(left)
    text, passage = set(), set()
    while left:
        n, p, q = heapq.heappop(left)
        n = -n
        free = np.array([p + i not in text and q + i not in passage for i in range(n)])
        if free.all():
            tiles.append((n, p, q))
            text.update(range(p, p + n))
            passage.update(range(q, q + n))
            continue
        edge = np.diff(np.concatenate(([0], free.view(np.int8), [0])))
        for b, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if e - b >= width:
                heapq.heappush(left, (-int(e - b), p + int(b), q + int(b)))
    return tiles


def matches(text: np.ndarray, hashes: np.ndarray, order: np.ndarray, passage: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of at least ``width`` tokens; ``hashes`` are those of the text's windows in ascending order, ``order`` their places."""
    h = windows(passage, width)
    low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
    count = high - low
    q = np.repeat(np.arange(len(h)), count)
    p = order[np.repeat(low - np.append(0, np.cumsum(count))[:-1], count) + np.arange(len(q))]
    same = np.ones(len(q), bool)
    for i in range(width):  # equal hashes of unequal windows don't count
        same &= text[p + i] == passage[q + i]
    p, q = p[same], q[same]
    at = np.lexsort((q, p - q))
    p, q = p[at], q[at]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1] + 1) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(q)) - 1
    return [(int(q[e] - q[s]) + width, int(p[s]), int(q[s])) for s, e in zip(first, last)] if len(q) else []


def _passage_seeds(sizes: dict[bool, int], char_langs: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text, lang in zip(*(b.column(c).to_pylist() for c in ("item_id", "passage", "lang"))):
                chars = lang in char_langs
                t = plain(text)
                found = seeds(tokens(t, chars), sizes[chars])
                letters = "".join(WORD.findall(t)) if chars else ""
                dense = all(DENSE.search(letters, i, i + sizes[True]) for i in range(len(letters) - sizes[True] + 1))
                rows += [(item, chars, dense, int(x)) for x in found.view(np.int64)]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.bool_(), pa.int64()))], ["item_id", "chars", "dense", "seed"])

    return run


def _text_seeds(sizes: dict[bool, int], kinds: list[bool], dense: bool, known):
    """Seeds of texts that passages have; of all passages where ``known`` isn't sent. ``dense``: texts without a character of a script without
    spaces can't hold a run of such passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, flags, values = [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                t = plain(text.as_py())
                for chars in kinds:
                    if chars and dense and not DENSE.search(t):
                        continue
                    found = seeds(tokens(t, chars), sizes[chars]).view(np.int64)
                    if known is not None:
                        have = known.value[chars]
                        at = np.minimum(np.searchsorted(have, found), len(have) - 1)
                        found = found[have[at] == found]
                    if len(found):
                        ids.append(np.full(len(found), doc))
                        flags.append(np.full(len(found), chars))
                        values.append(found)
            cols = [np.concatenate(c) if c else np.empty(0, k) for c, k in ((ids, np.int64), (flags, bool), (values, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "chars", "seed"])

    return run


def _tiles(sizes: dict[bool, int], coverage: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("tiles", pa.int32()), ("longest", pa.int32()), ("covered", pa.int32()), ("coverage", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, items in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("items").to_pylist()):
                t = plain(text.as_py())
                for chars in {x["chars"] for x in items}:
                    width = (sizes[chars] + 1) // 2
                    codes = tokens(t, chars)
                    hashes = windows(codes, width)
                    order = np.argsort(hashes, kind="stable")
                    for x in items:
                        if x["chars"] != chars:
                            continue
                        passage = tokens(plain(x["passage"]), chars)
                        found = tile(matches(codes, hashes[order], order, passage, width), width)
                        covered = sum(m[0] for m in found)
                        if found and (found[0][0] >= sizes[chars] or covered >= coverage * len(passage)):
                            rows.append((doc, x["item_id"], len(found), found[0][0], covered, covered / len(passage)))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    return run


def leaks(docs: DataFrame, id: str, text: str, items: DataFrame, item_id: str, passage: str, lang: str | None = None, words: int = 12, chars: int = 24, char_langs: tuple[str, ...] = ("zh",), coverage: float = 0.5) -> DataFrame:
    """One row per document and passage with a common run of at least ``words`` tokens (``chars`` for ``char_langs``) or a share ``coverage`` of the passage in tiles:
    ``doc_id, item_id, tiles, longest, covered`` (tokens of the passage that are marked) and ``coverage`` (their share)."""
    spark, sizes = docs.sparkSession, {False: words, True: chars}
    kind = F.lit(None).cast("string") if lang is None else F.col(lang)
    one = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.struct(F.col(passage).alias("p"), kind.alias("l")).alias("x")).filter("item_id is not null and x.p is not null")
    held = cut(one.groupBy("item_id").agg(F.max("x").alias("x")).select("item_id", F.col("x.p").alias("passage"), F.col("x.l").alias("lang")))
    seeded = cut(held.mapInArrow(_passage_seeds(sizes, char_langs), "item_id bigint, chars boolean, dense boolean, seed bigint"))
    kinds = {r["chars"]: r["dense"] for r in seeded.groupBy("chars").agg(F.min("dense").alias("dense")).collect()}  # two rows at most
    source = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    distinct = seeded.select("chars", "seed").distinct()
    known = None
    if distinct.limit(SEEDS + 1).count() <= SEEDS:
        rows = distinct.toArrow()
        flag, value = rows.column("chars").to_numpy(), rows.column("seed").to_numpy()
        known = spark.sparkContext.broadcast({c: np.sort(value[flag.astype(bool) == c]) for c in kinds})
    of_texts = source.mapInArrow(_text_seeds(sizes, sorted(kinds), kinds.get(True, True), known), "doc_id bigint, chars boolean, seed bigint")
    pairs = of_texts.join(bounded(seeded.select("item_id", "chars", "seed"), 1_000_000), ["chars", "seed"]).select("doc_id", "item_id", "chars").distinct()
    # a document's list is no longer than the passages are many
    wanted = cut(pairs.join(bounded(held, 100_000), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "chars", "passage")).alias("items")))
    ids = bounded(wanted.select("doc_id"), 1_000_000)
    texts = source.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
    return texts.join(wanted, "doc_id").mapInArrow(_tiles(sizes, coverage), "doc_id bigint, item_id bigint, tiles int, longest int, covered int, coverage double")
