"""Sentence units of Markdown in many languages, with abbreviations learned from the corpus.

Three passes over the texts:

1. Languages. Script tells a language where it is enough. For text in Latin script the words of the cells are counted for every label the rows bear (its first two letters, in lower
   case), whatever languages these are; relative frequencies, drawn towards those of the whole corpus while a label has little text, give each label the ``PROFILE`` words that
   tell it best, with weights. A cell is of the label of the greatest sum of weights, its row's own label counting ``OWN`` in advance. So wrong and missing labels and cells in another language than
   the rest are put right by the corpus; a few function words (``FUNCTION_WORDS``) are counted in beforehand for corpora too small to learn from.
2. Statistics. For every language the passes count, over all texts, how often a token stands with and without a period, how often with a period at
   the end of a paragraph, how often a word begins a paragraph or follows ``!`` or ``?``, and which words follow numbers with a period. The counts are
   added up by Spark; log-likelihood ratios over them give the model: abbreviations (tokens bound to their period which end
   paragraphs significantly less than other tokens with periods), collocations of a number with the word after it, and sentence starters.
3. Classification of every possible end with these statistics, the case of what follows, quotes, and the rules of the script.

Tokens are judged in Spark by their counts alone, whatever their share of the corpus. The model holds abbreviations, collocations and starters, and of the
other tokens seen with periods only those for which having been seen can decide: single characters, tokens that stand before a digit somewhere,
and those that are abbreviations in another language.

Markdown: blank lines part paragraphs; headings, list items and table rows are blocks of their own; tables, images, display formulas and fenced
code hold no units; markers aren't part of a unit. An ordered list inside a paragraph begins only with 1, as otherwise a wrapped line such as
"2. Lauf" would be one.

Defined results: null and empty texts, texts without cells and cells out of range give no units (ranges are clipped to the text); rows with a null id are
left out; repeated rows are texts of their own and give their units each time; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

NUMBER = "##"
#: frequent function words, counted in beforehand; fixed values
FUNCTION_WORDS = {
    "en": "the of and is to in it for by was were this that with from on at we you not are a an or as be do does",
    "de": "der die das und ist nicht wurde für von mit im am dem den ein eine einer auf aus dazu wird so bei gilt hat es",
    "es": "el la los las de en y que una por con se no del al son un está lo para es en vez",
    "fr": "le la les des une est et pour que dans on du de en un ne pas au aux ce se quel pourquoi elle il",
}
PROFILE = 400  # words of a label that are held
BEFOREHAND = 20  # occurrences of each function word counted in
EVIDENCE = 2_000  # words by which a label's frequencies are drawn towards those of the corpus
RARE, TELLING, OWN = 2e-4, 4.0, 1.0  # frequency below which a word tells little; the most a word tells; what the row's own label counts
SCRIPTS = [
    ("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[㐀-鿿]")), ("th", re.compile("[฀-๿]")), ("hi", re.compile("[ऀ-ॿ]")),
    ("ar", re.compile("[؀-ۿ]")), ("ru", re.compile("[Ѐ-ӿ]")), ("el", re.compile("[Ͱ-Ͽἀ-῿]")),
]
OF_SCRIPTS = {lang for lang, _ in SCRIPTS}
WORD = re.compile(r"[^\W\d_][\w’'-]*")
CLOSE = r"(?:[\"'”’»)\]}*_`]|[   ]?»(?=[\s,.;:!?)…—]|$))*"
CJK_CLOSE = r"[」』”’）)\]】》〉\"']*"
END = re.compile(rf"(?P<cjk>[。！？｡]+|…{{2,}}(?=[^\s\"'”’»)\]…]|$))(?P<q>{CJK_CLOSE})|(?P<stop>[.!?…؟۔।॥;]+)(?P<c>{CLOSE})(?=\s|$)")
OPEN = "\"'“”„«»‘’‹›([{¡¿*_`「『（ \t\r\n      "
THAI = re.compile(r"(?<=[ก-๎])[ \t ]*\s[ \t ]*(?=[ก-๎])")
CODE = re.compile(r"`[^`\n]+`")
IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)")
HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]+|$)")
ITEM = re.compile(r"[ \t]*(?:([-*+])|(\d{1,9})[.)])[ \t]+")
HEAD_NUMBER = re.compile(r"\d+(?:\.\d+)*\.(?=\s)")
FENCE = re.compile(r"[ \t]{0,3}(```+|~~~+)")
RULE = re.compile(r"[ \t]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|=+)[ \t]*$")


def base(label: str | None) -> str:
    """A label without region, script and case."""
    return (label or "").strip().lower()[:2]


def by_script(text: str) -> str | None:
    """The language where the script tells it; None for Latin and other scripts."""
    if text.isascii():
        return None
    best, most = None, 0
    for lang, chars in SCRIPTS:
        n = len(chars.findall(text))
        if lang == "ja" and n:
            return "ja"
        if n > most:
            best, most = lang, n
    return best if best and 3 * most > len(WORD.findall(text)) or most > 20 else None


class Profiles:
    """Words that tell the languages of text in Latin script: ``weights`` of each word for languages, and the language of most text."""

    def __init__(self, weights: dict[str, list[tuple[str, float]]], default: str):
        self.weights, self.default = weights, default

    @classmethod
    def fit(cls, rows: list[tuple[str, str, int]], totals: dict[str, int]) -> Profiles:
        """Of counts (label, word, n) and the number of words of each label."""
        counts: dict[str, Counter] = defaultdict(Counter)
        for label, word, n in rows:
            counts[label][word] += n
        size = Counter(totals)
        for label, words in FUNCTION_WORDS.items():
            for w in set(words.split()):
                counts[label][w] += BEFOREHAND
                size[label] += 2 * BEFOREHAND
        whole, all_ = Counter(), sum(size.values())
        for c in counts.values():
            whole.update(c)
        labels = sorted(counts)
        weights: dict[str, list[tuple[str, float]]] = defaultdict(list)
        share = {label: {w: (c[w] + EVIDENCE * whole[w] / all_) / (size[label] + EVIDENCE) for w in whole} for label, c in counts.items()}
        for w in whole:
            mean = sum(share[label][w] for label in labels) / len(labels)
            for label in labels:
                x = math.log((share[label][w] + RARE) / (mean + RARE))
                if abs(x) > 0.1:
                    weights[w].append((label, max(-TELLING, min(TELLING, x))))
        return cls(dict(weights), max(labels, key=lambda x: (size[x], x)))

    def language(self, text: str, label: str | None = None) -> str:
        told = by_script(text)
        if told:
            return told
        score: dict[str, float] = defaultdict(float)
        own = base(label)
        get = self.weights.get
        for w in text.lower().split():
            for lang, x in get(w, ()):
                score[lang] += x
        if own and own not in OF_SCRIPTS:
            score[own] += OWN
        return max(score, key=lambda x: (score[x], x)) if score and max(score.values()) > 0 else self.default


def words_of_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of cells in Latin script by the label of their row; ``word`` null for the number of all."""
    for b in batches:
        counts: dict[str, Counter] = defaultdict(Counter)
        for text, cells, label in zip(b.column("text"), b.column("cells"), b.column("lang").to_pylist()):
            own = base(label)
            if not own.isalpha() or own in OF_SCRIPTS:
                continue
            t = text.as_py()
            for begin, end in ranges(t, cells.as_py()):
                cell = t[begin:end]
                if by_script(cell) is None:
                    counts[own].update(cell.lower().split())
        rows = [(label, w, n) for label, c in counts.items() for w, n in c.items() if w.isalpha()] + [(label, None, c.total()) for label, c in counts.items()]
        cols = list(zip(*rows)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()))], ["label", "word", "n"])


def profiles(docs: DataFrame) -> Profiles:
    """Of each label the PROFILE words whose frequency in it exceeds that in the corpus most, weighed by how often they occur; counted over all texts."""
    counted = cut(docs.mapInArrow(words_of_labels, "label string, word string, n bigint").groupBy("label", "word").agg(F.sum("n").alias("n")))
    totals = {r["label"]: r["n"] for r in counted.filter("word is null").collect()}  # labels have two letters
    words = counted.filter("word is not null")
    sizes = counted.filter("word is null").select("label", F.col("n").alias("size"))
    whole = words.groupBy("word").agg(F.sum("n").alias("m"))
    all_ = max(1, sum(totals.values()))
    share, usual = F.col("n") / F.col("size"), F.col("m") / all_
    told = words.join(F.broadcast(sizes), "label").join(whole, "word").withColumn("told", share * F.log((share + RARE) / (usual + RARE)))
    best = told.filter("told > 0").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.col("told").desc(), "word"))).filter(F.col("r") <= PROFILE).select("word").distinct()
    rows = words.join(F.broadcast(best), "word", "left_semi").select("label", "word", "n").collect()  # PROFILE words and all their labels
    return Profiles.fit([tuple(r) for r in rows], totals)


def ranges(text: str, cells: list | None) -> list[tuple[int, int]]:
    """Where the text cells lie."""
    return sorted({(max(0, c["begin_char"]), min(len(text), c["end_char"])) for c in cells or [] if c and c["cell_kind"] == "text" and c["begin_char"] is not None and c["end_char"] is not None})


def blocks(cell: str) -> Iterator[tuple[int, int, bool]]:
    """Ranges of paragraphs, items and headings (whether it is one) in Markdown, without their markers."""
    begin = end = None
    number: int | None = None  # of the ordered item that is open; 0 in a bullet, None in a paragraph
    fence, formula, at = "", False, 0
    for line in cell.splitlines(keepends=True):
        s, at = at, at + len(line)
        text = line.strip()
        if fence:
            if text.startswith(fence):
                fence = ""
            continue
        if formula:
            formula = "$$" not in text
            continue
        first = text[:1]
        lone = not text or first == "|" or first == "!" and IMAGE.fullmatch(text) or first == "$" and text.startswith("$$") or first in "=-_*" and RULE.fullmatch(line.rstrip("\r\n"))
        if lone or first in "`~" and FENCE.match(line):
            if begin is not None:
                yield begin, end, False
            begin = number = None
            if text and not lone:
                fence = FENCE.match(line)[1]
            elif text.startswith("$$"):
                formula = text.count("$$") == 1
            continue
        if first == "#" and (m := HEADING.match(line)):
            if begin is not None:
                yield begin, end, False
            begin = number = None
            yield s + m.end(), at, True
            continue
        if first == ">":
            s += line.index(">") + 1
        elif (first in "-*+" or first.isdigit()) and (m := ITEM.match(line)):
            k = int(m[2]) if m[2] else 0
            if not k or begin is None or k == 1 or number and k == number + 1:
                if begin is not None:
                    yield begin, end, False
                begin, end, number = s + m.end(), at, k
                continue
        if begin is None:
            begin, number = s, None
        end = at
    if begin is not None:
        yield begin, end, False


def masked(text: str) -> str:
    """Inline code and images without characters that could end a sentence, at unchanged length."""
    if "`" in text:
        text = CODE.sub(lambda m: "`" + "x" * (len(m[0]) - 2) + "`", text)
    if "![" in text:
        text = IMAGE.sub(lambda m: " " * len(m[0]), text)
    return text


def paragraphs(text: str, cells: list | None, label: str | None, known: Profiles) -> Iterator[tuple[int, str, str, bool]]:
    """(offset in text, masked paragraph, language, heading) of the text cells."""
    for begin, end in ranges(text, cells):
        cell = text[begin:end]
        if not cell.strip():
            continue
        lang = known.language(IMAGE.sub("", cell) if "![" in cell else cell, label)
        for s, e, heading in blocks(cell):
            yield begin + s, masked(cell[s:e]), lang, heading


def before(text: str, stop: int) -> str:
    """The token that ends at ``stop``, without opening marks; numbers as one type."""
    s = stop
    while s and not text[s - 1].isspace():
        s -= 1
    token = text[s:stop].lstrip("\"'“„«»‘‹([{¡¿*_`—–")
    if token[:1].isdigit() or token[:1] == "." and token[1:2].isdigit():
        return NUMBER
    return token


def after(text: str, at: int) -> str:
    """The next word, past opening marks; a mark or digit if there is no letter."""
    n = len(text)
    while at < n and text[at] in OPEN:
        at += 1
    m = WORD.match(text, at)
    return m[0] if m else text[at : at + 1]


def small(word: str) -> bool:
    """Whether a word is one that doesn't begin sentences by its case: in lower case throughout (mRNA and pH do begin some)."""
    return word[:1].islower() and word == word.lower()


def observe(known: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        for text, cells, label in zip(b.column("text"), b.column("cells"), b.column("lang").to_pylist()):
            for _, p, lang, heading in paragraphs(text.as_py(), cells.as_py(), label, known.value):
                c = counts[lang]
                for m in END.finditer(p):
                    if not m["cjk"] and m["stop"] == "." and after(p, m.end())[:1].isdigit():
                        c["k"][before(p, m.start())] += 1
                if heading:
                    continue
                c["w"].update(WORD.findall(p))
                size = len(p.rstrip())
                if lang in ("zh", "ja"):
                    c["s"][p.lstrip(OPEN)[:2]] += 1
                elif (w := after(p, 0))[:1].isupper():
                    c["s"][w] += 1
                for m in END.finditer(p):
                    if m["cjk"]:
                        if not m["q"] and (nxt := p[m.end() :].lstrip(OPEN)[:2]):
                            c["s"][nxt] += 1
                        continue
                    stop = m["stop"]
                    if stop == ".":
                        t = before(p, m.start())
                        c["p"][t] += 1
                        if m.end() >= size:
                            c["e"][t] += 1
                        elif p[m.end() :].lstrip()[:1].isdigit():
                            c["d"][t] += 1
                        elif t == NUMBER and (w := after(p, m.end()))[:1].isupper():
                            c["c"][w] += 1
                        if t == NUMBER:
                            c["w"][NUMBER] += 1
                    elif stop[-1] in "!?؟" and (w := after(p, m.end()))[:1].isupper():
                        c["s"][w] += 1
        rows = [(lang, kind, t, n) for lang, kinds in counts.items() for kind, c in kinds.items() for t, n in c.items()]
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], ["lang", "kind", "token", "n"])


def ratio(k1: float, n1: float, k2: float, n2: float) -> float:
    """-2 log of the likelihood ratio that k1 of n1 and k2 of n2 come from one binomial."""

    def like(k: float, n: float, p: float) -> float:
        return (k * math.log(p) if k else 0) + ((n - k) * math.log(1 - p) if n > k else 0)

    if not n1 or not n2:
        return 0.0
    p = (k1 + k2) / (n1 + n2)
    if p <= 0 or p >= 1:
        return 0.0
    return 2 * (like(k1, n1, k1 / n1) + like(k2, n2, k2 / n2) - like(k1, n1, p) - like(k2, n2, p))


class Model:
    """bound: tokens whose period never ends a sentence before a capital or digit; open: abbreviations that may; known: other tokens seen with
    periods; joined: words that go with the number before them; first: words (in scripts without spaces pairs of characters) that begin sentences."""

    def __init__(self, profiles: Profiles):
        self.profiles = profiles
        self.bound, self.open, self.known, self.joined, self.first = (defaultdict(set) for _ in range(5))
        self.any_bound: set[str] = set()

    @classmethod
    def fit(cls, rows: list, profiles: Profiles) -> Model:
        """Of rows ``lang, token, role``."""
        model = cls(profiles)
        for lang, token, role in rows:
            getattr(model, role)[lang].add(token)
        model.any_bound = {t for lang in list(model.bound) if lang not in OF_SCRIPTS for t in model.bound[lang]} - {NUMBER}
        return model

    @staticmethod
    def roles(lang: str, t: str, r: dict) -> Iterator[str]:
        """What a token is in a language, by its counts and the totals of the language."""
        periods, ends, words, begun = (r[f"all_{k}"] or 0 for k in "pews")
        w, p, e, s, c = (r[k] or 0 for k in "wpesc")
        if s >= 2 and (lang in ("zh", "ja") or s / max(w, s) >= 0.5 and ratio(s, w, begun - s, max(words - w, 1)) >= 30):
            yield "first"
        if c >= 3 and s * 20 <= c and ratio(c, max(w, c), periods, max(words, periods)) >= 7.88:
            yield "joined"
        if p < 3:
            return
        w = max(w, p)  # with inner periods a token is no plain word
        rate = ends / periods if periods else 0
        rarely = e / p < rate / 4 and ratio(e, p, ends - e, periods - p) >= 7.88
        # how firmly the token is bound to its period, weighed for length, inner periods and occurrences without
        tied = ratio(p, w, max(periods - p, 1), max(words - w, 1)) if p / w > periods / max(words, 1) else 0.0
        letters = len(t.replace(".", "").replace("-", ""))
        score = tied * math.exp(-letters / 2) * (t.count(".") + 1) * letters ** -min(w - p, 20.0)
        short = t == NUMBER or letters <= 6
        # a collocation of the token with numbers ("no. 5") tells even where the same letters are a common word
        if rarely and short and (t == NUMBER or score >= 0.3 or 10 * (r["d"] or 0) >= 9 * p):
            yield "bound" if e * 50 <= p else "open"
        else:
            yield "known"

    def ends(self, lang: str, p: str, m: re.Match) -> bool:
        """Whether the stop of a match of END ends a sentence."""
        nxt_at = m.end()
        if m["cjk"]:
            rest = p[nxt_at:].lstrip()
            if not rest:
                return True
            if rest[0] in "，、；：,;:。！？…—～）)":
                return False
            if not (set(m["q"]) & set("」』”’\"'")):
                return True
            pair = rest.lstrip(OPEN)[:2]
            if pair in self.first[lang] or rest[0] in "“「『‘" or rest[0].isascii() and rest[0].isalnum():
                return True
            if lang == "ja" or not m["cjk"].endswith(("。", "｡")):
                return False
            return True
        stop, w = m["stop"], after(p, nxt_at)
        if not w:
            return True
        if stop[-1] in "।॥۔":
            return True
        if stop.endswith(";"):
            return stop == ";" and lang == "el" and "Ͱ" <= p[m.start() - 1 : m.start()] <= "῿"
        if w[0] in "—–-,;:)" or small(w):
            return False
        if stop != "." :
            return True
        t = before(p, m.start())
        cased = w[0].isupper() or w[0].islower()
        if t in self.bound[lang] or t not in self.known[lang] and t in self.any_bound:
            return False
        if t == NUMBER and w in self.joined[lang]:
            return False
        if t in self.open[lang]:
            return w in self.first[lang]
        if t in self.known[lang]:
            return True
        if len(t) == 1 and t.isupper() and cased:
            return False
        if w[0].isdigit():
            return t == NUMBER
        return True

    def units(self, p: str, lang: str, heading: bool) -> Iterator[tuple[int, int]]:
        begin = 0
        skip = HEAD_NUMBER.match(p.lstrip()) if heading else None
        skip = len(p) - len(p.lstrip()) + skip.end() if skip else -1
        cuts = []
        for m in END.finditer(p):
            if m.end() > skip and self.ends(lang, p, m):
                cuts.append(m.end())
        if lang == "th" and not heading:
            cuts = sorted({*cuts, *(m.start() for m in THAI.finditer(p))})
        for e in [*cuts, len(p)]:
            part = p[begin:e]
            s = begin + len(part) - len(part.lstrip())
            f = begin + len(part.rstrip())
            if f > s and any(ch.isalnum() for ch in part):
                yield s, f
            begin = e


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(r["lang"], r["token"], role, role != "known" or len(r["token"]) == 1 or bool(r["k"])) for r in b.to_pylist() for role in Model.roles(r["lang"], r["token"], r)]
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.bool_()))], ["lang", "token", "role", "held"])


def learn(docs: DataFrame) -> Model:
    """The model of a corpus of rows ``text, cells, lang``."""
    known = profiles(docs)
    sent = docs.sparkSession.sparkContext.broadcast(known)
    counted = docs.mapInArrow(partial(observe, sent), "lang string, kind string, token string, n bigint").groupBy("lang", "kind", "token").agg(F.sum("n").alias("n"))
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")))
    tokens = counted.groupBy("lang", "token").agg(*[of(k).alias(k) for k in "wpescdk"])
    totals = counted.groupBy(F.col("lang").alias("l")).agg(of("p").alias("all_p"), of("e").alias("all_e"), of("w").alias("all_w"), of("s").alias("all_s"))
    some = tokens.filter("p >= 3 or s >= 2 or c >= 3")
    judged = cut(some.join(F.broadcast(totals), some["lang"] == totals["l"]).drop("l").mapInArrow(judge, "lang string, token string, role string, held boolean"))
    elsewhere = judged.filter((F.col("role") == "bound") & ~F.col("lang").isin(*OF_SCRIPTS)).select("token").distinct()
    held = judged.filter("held").unionByName(judged.filter("not held").join(elsewhere, "token", "left_semi"))
    return Model.fit(held.select("lang", "token", "role").collect(), known)


def sentences(docs: DataFrame, id: str = "doc_id", text: str = "text", cells: str = "cells", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """``doc_id, begin_char, end_char`` of every unit in the cells of kind text; the model is learned from the same texts if omitted."""
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.expr(f"filter({cells}, c -> c.cell_kind = 'text')").alias("cells"), F.col(lang).alias("lang")).filter("doc_id is not null and text is not null and size(cells) > 0")
    model = model or learn(rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, begins, ends = [], [], []
            for doc, t, cs, label in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("cells"), b.column("lang").to_pylist()):
                for at, p, l, heading in paragraphs(t.as_py(), cs.as_py(), label, sent.value.profiles):
                    for s, e in sent.value.units(p, l, heading):
                        ids.append(doc)
                        begins.append(at + s)
                        ends.append(at + e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "begin_char", "end_char"])

    return rows.mapInArrow(classify, "doc_id bigint, begin_char int, end_char int")
