import random

from __spark_entry__ import queries

from vecloom.llm.contamination import TAG, WORD, leaks, plain

DATA = "/root/testdata/sf0.001"


def units(text, chars):
    words = WORD.findall(plain(text))
    return list("".join(words)) if chars else words


def brute(docs, items, words=12, chars=24):
    """Pairs with a common run, by looking up all windows."""
    out = set()
    for d, t in docs:
        for i, p, lang in items:
            if d is None or t is None or i is None or p is None:
                continue
            c = lang == "zh"
            n = chars if c else words
            a, b = units(t, c), units(p, c)
            have = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
            if any(tuple(a[k : k + n]) in have for k in range(len(a) - n + 1)):
                out.add((d, i))
    return out


def test_against_all_windows(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r["item_id"], r["passage"], r["lang"]) for r in spark.read.parquet(f"{DATA}/eval_item.parquet").collect()]
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in queries()["p8_found"](spark, DATA).collect()} == want and want


def test_runs_of_every_length_and_place(spark):
    rng = random.Random(2)
    passage = [f"w{k}" for k in range(40)]
    items = [(1, " ".join(passage), "en"), (2, " ".join(passage[::-1]), "en"), (3, "too short", "en"), (4, None, "en"), (None, " ".join(passage), "en"), (5, "".join(chr(0x4E00 + k) for k in range(60)), "zh"), (6, "", "zh")]
    docs = [(None, " ".join(passage)), (900, None), (901, ""), (902, " ".join(passage[:13]) + " x " + " ".join(passage[20:34])), (902, "a")]
    for d in range(120):
        n, at = rng.randrange(8, 18), rng.randrange(20)
        noise = [f"n{rng.randrange(50)}" for _ in range(rng.randrange(30))]
        docs.append((d, " ".join(noise + [w.upper() if rng.random() < 0.3 else f"<b>{w}</b>" for w in passage[at : at + n]] + noise)))
    docs += [(500 + n, "abc " + "，".join(chr(0x4E00 + 7 + k) for k in range(n))) for n in (23, 24, 30)]
    got = leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id bigint, passage string, lang string"), "item_id", "passage", "lang", coverage=2.0)
    rows = got.collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == brute(docs, items)
    two = next(r for r in rows if r["doc_id"] == 902)
    assert (two["tiles"], two["longest"], two["covered"]) == (2, 14, 27)


def test_coverage_shows_reordered_passages(spark):
    """Fragments of eight words, none of them of twelve, in another order."""
    parts = [[f"p{k}x{i}" for i in range(8)] for k in range(6)]
    passage = " ".join(w for p in parts for w in p)
    moved = " ".join(w for k in (5, 2, 4, 1, 3, 0) for w in [*parts[k], "and"])
    d = spark.createDataFrame([(1, moved, 0), (2, " ".join(parts[0]), 0)], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([(7, passage)], "item_id bigint, passage string")
    got = leaks(d, "doc_id", "text", i, "item_id", "passage").collect()
    assert [(r["doc_id"], r["tiles"], r["longest"], r["coverage"]) for r in got] == [(1, 6, 8, 1.0)]
    assert leaks(d.limit(0), "doc_id", "text", i, "item_id", "passage").count() == 0 == leaks(d, "doc_id", "text", i.limit(0), "item_id", "passage").count()
    assert TAG.sub("", "a<b>c</b>") == "ac"
