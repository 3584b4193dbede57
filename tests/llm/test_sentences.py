from vecloom.llm.sentences_op import learn, sentences

SCHEMA = "doc_id bigint, text string, lang string, cells array<struct<cell_no int, cell_kind string, exec_count int, begin_char int, end_char int>>"


def test_tokens_with_ample_counts_count_in_any_corpus(spark):
    """350,000 periods of a language: a word seen three times is still a known one, so it ends its sentence before a digit."""
    many = "The word was here. " * 200
    rare = "He was in the zorkan. The next was the zorkan. And this was the zorkan. 5 of them were here."
    texts = [many] * 1750 + [rare]
    docs = spark.createDataFrame([(i, t, "en", [(0, "text", None, 0, len(t))]) for i, t in enumerate(texts)], SCHEMA)
    model = learn(docs)
    assert "zorkan" in model.known["en"]
    got = sentences(docs.filter("doc_id = 1750"), model=model).collect()
    assert [rare[r["begin_char"] : r["end_char"]] for r in sorted(got, key=lambda r: r["begin_char"])] == ["He was in the zorkan.", "The next was the zorkan.", "And this was the zorkan.", "5 of them were here."]


WORDS = {
    "it": "il gatto che non sono della con una per gli questo anche come dal suo nella essere stato delle più",
    "nl": "het een van niet zijn voor met worden deze maar ook nog wordt heeft naar door over bij uit dan",
    "pl": "nie jest się na do że to jak przez dla przy tego oraz tylko może został jego które być pod",
    "pt": "não uma com para mais foi pelo são dos das mas também seu sua quando muito nos já pela isso",
}


def test_languages_are_learned_from_labels(spark):
    """Labels the module knows nothing of, in several notations, some of them wrong; a cell in another language than its row's label."""
    import random

    from vecloom.llm.sentences_op import profiles

    rng = random.Random(4)
    text = lambda lang, n=60: " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))
    notation = {"it": ["it", "IT", "it-IT"], "nl": ["nl", "nl_BE"], "pl": ["pl"], "pt": ["pt", "pt-BR", " PT "]}
    rows = [(lang, rng.choice(notation[rng.choice(list(WORDS)) if rng.random() < 0.1 else lang])) for lang in WORDS for _ in range(60)]
    docs = [(i, t := text(lang), label, [(0, "text", None, 0, len(t))]) for i, (lang, label) in enumerate(rows)]
    known = profiles(spark.createDataFrame(docs, SCHEMA))
    for lang in WORDS:
        assert all(known.language(text(lang, 12), label) == lang for label in (None, "en", "xx", *notation[lang]))
    assert known.language("это русский текст", "it") == "ru" and known.language("これは文です", None) == "ja"


def test_units_in_many_scripts(spark):
    want = {
        "en": ["Dr. Low saw 3.5 of them.", 'He said "Stop!" and left.', "Is it so?"],
        "zh": ["他们来了。", "“走吧！”他说。", "好的？"],
        "ja": ["今日は晴れです。", "「行こう。」と言った。"],
        "hi": ["यह एक वाक्य है।", "यह दूसरा है।"],
        "ar": ["هذا نص.", "هل هذا صحيح؟"],
    }
    docs, spans = [], {}
    for i, (lang, units) in enumerate(want.items()):
        t = ("" if lang in ("zh", "ja") else " ").join(units)
        docs += [(i, t, lang, [(0, "text", None, 0, len(t))])]
        spans[i] = (t, units)
    many = [(100 + k, "Dr. Low was here. Dr. Low came. He saw Dr. Low and left.", "en", [(0, "text", None, 0, 56)]) for k in range(30)]
    docs += [(50, None, "en", None), (51, "", "en", []), (52, "# Head 1.2\n\n- one\n- two. Three\n\n|a|b|\n", None, [(0, "text", None, -5, 500)]), (None, "A b.", "en", [(0, "text", None, 0, 4)])]
    df = spark.createDataFrame(docs + many + docs[:1], SCHEMA).selectExpr("*", "1 as begin_char", "'x' as token")
    got = {}
    for r in sentences(df).collect():
        got.setdefault(r["doc_id"], []).append((r["begin_char"], r["end_char"]))
    for i, (t, units) in spans.items():
        assert [t[s:e] for s, e in sorted(set(got[i]))] == units
    assert len(got[0]) == 2 * len(want["en"])  # the row came twice
    assert [docs[-2][1][s:e] for s, e in sorted(got[52])] == ["Head 1.2", "one", "two.", "Three"] and 50 not in got and 51 not in got
