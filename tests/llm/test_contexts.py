from collections import defaultdict

import numpy as np
from __spark_entry__ import queries

import pytest

from vecloom.llm.packing import CONTEXT, LINEAR, QUADRATIC, contexts, pack, parts
from vecloom.llm.tokens import tokenizer

DATA = "/root/testdata/sf0.01"


def test_pack_goes_to_the_cheapest_context_with_room():
    """Against the rule followed step by step."""
    tokens = np.sort(np.random.default_rng(3).integers(1, 90, 300))[::-1]
    room = [100] * -(-int(tokens.sum()) // 100)
    cost, want = [0.0] * len(room), []
    for t in tokens:
        at = min((c, k) for k, c in enumerate(cost) if room[k] >= t)[1] if max(room) >= t else len(room)
        if at == len(room):
            room.append(100)
            cost.append(0.0)
        room[at] -= t
        cost[at] += LINEAR * t + QUADRATIC * t * t
        want.append(at)
    assert pack(tokens, 100).tolist() == want


@pytest.fixture(scope="session")
def tokens(spark):
    return tokenizer(spark)


def test_sums_count_tokens(tokens):
    for text in ("Ein Wörterbuch 12345 的时候,\n\n", "", "a", "日本語", "<|endoftext|>"):
        sums = tokens.sums(text)
        assert len(sums) == len(text) + 1 and sums[0] == 0 and sums[-1] == tokens.count(text) and all(np.diff(sums) >= 0)


def test_parts_cover_the_text(tokens):
    text = " Ein Wörterbuch 12345 的时候,\n\n" * 50
    whole = tokens.count(text)
    for size in (5, 7, 100, whole - 1, whole):
        got = parts(text, size, tokens)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(got, got[1:]))
        assert sum(n for *_, n in got) == whole and max(n for *_, n in got) <= size
        assert all(n > size - 4 for *_, n in got[:-1])  # no token parts a character here by more
    assert parts("", 5, tokens) == parts(None, 5, tokens) == []


def test_shards_and_repeated_rows(spark, tokens):
    rng = np.random.default_rng(5)
    rows = [(i, "a " * int(n)) for i, n in enumerate(rng.integers(0, 60, 500))] + [(None, "a"), (7, "a"), (501, "b " * 130)]
    got = contexts(spark.createDataFrame(rows, "id bigint, text string"), "id", "text", size=50, shard=100).collect()
    check(dict(sorted((r for r in rows if r[0] is not None), key=lambda r: r[1])), got, 50, tokens)


def check(texts, got, size, tokens):
    held, by = defaultdict(int), defaultdict(list)
    for r in got:
        held[r["context_id"]] += r["tokens"]
        by[r[1]].append((r["part_no"], r["begin_char"], r["end_char"], r["tokens"]))
    want = {i: [(k, *p) for k, p in enumerate(parts(t, size, tokens))] for i, t in texts.items() if t}
    assert {i: sorted(p) for i, p in by.items()} == want
    assert all(len(p) == 1 or sum(x[3] for x in p) > size for p in by.values())
    assert max(held.values()) <= size
    return sum(held.values()) / (len(held) * size)


def test_all_notebooks_are_packed_with_little_room_left(spark, tokens):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    fill = check(texts, queries()["p7_contexts"](spark, DATA).collect(), CONTEXT, tokens)
    assert fill > 0.98


def test_balance(spark):
    (r,) = queries()["p7_balance"](spark, DATA).collect()
    assert r["least"] <= r["contexts"] <= 1.02 * r["least"] + 1 and r["fill"] > 0.98 and r["mean_cost"] <= r["top_cost"]
