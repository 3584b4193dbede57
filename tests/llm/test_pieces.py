import numpy as np
import pytest
from __spark_entry__ import queries

from vecloom.llm.splitting import BOUNDARIES, pieces, split
from vecloom.llm.tokens import tokenizer

DATA = "/root/testdata/sf0.001"
TEXTS = ["One two three. Four five!\n\nSix seven, eight nine. Ten", "x" * 500, "e\u0301" * 100, "的时候。他们" * 40, "a b " * 100, "\r\n" * 60, " ", "wörter und 12345 " * 30]


def check(text, got, limit, overlap, sums):
    """Pieces cover the text in order, none is over the limit, neighbours overlap as asked (or less where a token can't be parted)."""
    assert got[0][0] == 0 and got[-1][1] == len(text) and got[-1][2] == "end"
    for s, e, _ in got:
        assert s < e and (sums[e] - sums[s] <= limit or e == s + 1)
    for (_, e, kind), (s, f, _) in zip(got, got[1:]):
        assert s <= e < f and sums[e] - sums[s] <= overlap
        if kind not in ("hard", "end"):
            assert any(m.end() == e for b in BOUNDARIES for m in b.finditer(text))


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("limit,overlap", [(1, 0), (7, 3), (20, 5), (64, 200), (10_000, 5)])
def test_by_characters(text, limit, overlap):
    check(text, split(text, limit, overlap), limit, min(overlap, max(0, (limit - 1) // 2)), np.arange(len(text) + 1))


@pytest.mark.parametrize("text", TEXTS)
def test_by_tokens(spark, text):
    sums = tokenizer(spark).sums(text)
    for limit, overlap in ((6, 2), (30, 10)):
        check(text, split(text, limit, overlap, sums), limit, overlap, sums)


def test_odd_rows(spark):
    rows = [("a", 1, None, 5, 1, 0), ("a", 2, "", 5, 1, 0), ("a", 3, "short", None, 1, 0), ("a", 4, "longer text", 0, 1, 0), ("a", None, "lost", 5, 1, 0), (None, 5, "some text here", 6, -3, 0), ("a", 6, "some text", 6, 0, 1), ("a", 6, "some text", 6, 0, 2)]
    df = spark.createDataFrame(rows, "src string, id bigint, text string, most int, overlap int, piece_no int")
    got = sorted((r["src"] or "", r["id"], r["piece_no"], r["piece"]) for r in pieces(df, "src", "id", "text", "most", "overlap").collect())
    assert got == [("", 5, 0, "some "), ("", 5, 1, "text "), ("", 5, 2, "here"), ("a", 3, 0, "short"), ("a", 4, 0, "longer text"), ("a", 6, 0, "some "), ("a", 6, 1, "text")]
    assert pieces(df.limit(0), "src", "id", "text", "most", "overlap").count() == 0


def test_queries_cover_whole_texts(spark):
    for name in ("p4_pieces", "p4_token_pieces"):
        by = {}
        for r in queries()[name](spark, DATA).collect():
            by.setdefault((r["src_table"], r["item_id"]), []).append((r["piece_no"], r["begin_char"], r["end_char"]))
        texts = {("pubmedqa", r["id"]): r["text"] for r in spark.read.parquet(f"{DATA}/pubmedqa.parquet").collect() if r["text"] and r["id"] is not None}
        assert by and all(min(p)[1] == 0 and max(p)[2] == len(texts[k]) for k, p in by.items() if k in texts) and set(texts) <= set(by)
