"""Language ID, toxicity and fertility rules."""

import math
import random
import zlib

import numpy as np
import pytest

from millrace.llm import fertility, langid, toxicity
from millrace.llm.queries import TOKENIZERS

PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
VOICES = {
    "en": "the and of that with from this have which there would about".split(),
    "de": "der und das nicht über eine schön wird auch später können".split(),
    "fr": "le la des était être avec pour très où déjà même".split(),
}


def prose(lang, rng, n=60):
    return " ".join(rng.choice(VOICES[lang]) + rng.choice(["", "s", "en", "e"]) for _ in range(n))


@pytest.fixture(scope="module")
def voices():
    rng = random.Random(3)
    return [(prose(lang, rng), lang) for _ in range(80) for lang in VOICES]


def test_language_held_out_accuracy(voices):
    model = langid.fit(voices[:180])
    found = [model.score(t) for t, _ in voices[180:]]
    assert np.mean([p == y for (p, _), (_, y) in zip(found, voices[180:], strict=True)]) > 0.97
    assert all(0 <= s <= 1 for _, s in found)


def test_language_subwords_do_not_cross_words():
    joined = set(langid.subwords("ab cd", 20))
    assert joined >= set(langid.subwords("ab", 20)) and joined == set(langid.subwords("cd! AB", 20)) - (set(langid.subwords("cd ab", 20)) - joined)
    assert len(langid.subwords("12 ² !", 15)) == 0 == len(langid.subwords(None, 15))


def test_language_odd_rows(spark, voices, odd_docs, no_docs):
    model = langid.fit(voices)
    rows = langid.predict(odd_docs, model).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == "und" and by[i].rejected and by[i].score == 0 for i in (2, 3, 4, 7, 8))
    assert by[6].lang_pred in VOICES and by[5].kept is False
    assert langid.predict(no_docs, model).collect() == []
    assert langid.train(no_docs).languages == ["und"]
    assert langid.predict(odd_docs, langid.train(no_docs)).where("NOT rejected AND lang_pred <> 'und'").count() == 0


def test_language_training_fold(spark):
    rows = spark.range(200).withColumnRenamed("id", "doc_id")
    kept = {r.doc_id for r in rows.where(langid.is_training_row(rows["doc_id"])).collect()}
    assert kept == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    terms = ["idiot", "moron", "worthless", "scum", "disgusting", "idiots"]
    machine, rng = toxicity.LexiconAutomaton(terms), random.Random(1)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            op = rng.random()
            if op < 0.33:
                w.insert(k, rng.choice("abinot"))
            elif w and op < 0.66:
                w.pop(min(k, len(w) - 1))
            elif w:
                w[min(k, len(w) - 1)] = rng.choice("abinot")
        word = "".join(w)
        best = min(((d, t) for t, x in enumerate(terms) if (d := edits(word, x)) <= toxicity.edits_allowed(len(x))), default=None)
        assert machine.match(word) == best, word


@pytest.fixture(scope="module")
def abuse():
    rng, rows = random.Random(5), []
    for k in range(600):
        words = [rng.choice("river stone table window garden yellow simple market paper" .split()) + str(rng.randint(0, 30)) for _ in range(40)]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "worthless", "scumbag"]))
        rows.append((" ".join(words), int(toxic)))
    return rows


def test_toxicity_held_out_misspelled_and_quoted(abuse):
    model = toxicity.fit(abuse[:400])
    memo = model.memo()
    assert set(model.terms) == {"idiot", "worthless", "scumbag"}
    assert all((model.score(t, memo) >= 0.5) == bool(y) for t, y in abuse[400:])
    assert model.score("you w0rthles idi0t and scumbaag", memo) >= 0.5
    quoted, direct = model.score('they wrote "idiot" about the market', memo), model.score("you idiot about the market", memo)
    assert quoted < direct and quoted < 0.5


def test_toxicity_odd_rows(spark, abuse, odd_docs, no_docs):
    model = toxicity.fit(abuse)
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert toxicity.score(no_docs, model).collect() == []
    empty = toxicity.fit([])
    assert empty.terms == [] and 0 <= empty.score("anything", empty.memo()) <= 1
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, toxic int")
    assert toxicity.train(odd_docs, labels).terms == []


def plain_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_fertility_counts_against_plain_python(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab#* \n\té") for _ in range(rng.randint(0, 120))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in fertility.measure(docs, PIECES).collect():
        assert tuple(r[c] for c in fertility.BASE) == plain_counts(texts[r.doc_id]), repr(texts[r.doc_id])


def test_fertility_rejects_odd_tokens_only(spark, odd_docs, no_docs):
    rng = random.Random(4)
    rows = [(i, prose("en", rng, 80 + i), "en") for i in range(60)] + [(99, " ".join(chr(0x2500 + rng.randint(0, 900)) * 3 for _ in range(80)), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in fertility.judge(docs, PIECES).collect()}
    assert kept[99] is False and all(kept[i] for i in range(60))
    out = fertility.judge(odd_docs, PIECES).collect()
    assert len(out) == odd_docs.count() and all(r.base_failed and not r.kept for r in out)
    assert fertility.judge(no_docs, PIECES).collect() == []
    assert fertility.script_of("日本") == "CJK" and fertility.script_of("12") == "none"


def plain_fertility(text, sp):
    """Characters per token, share of byte pieces and entropy, word by word."""
    words = text.encode().split()
    pieces = [i for w in words for i in sp.encode(w.decode())]
    n = len(pieces)
    if not n:
        return 0.0, 0.0, 0.0
    shares = [pieces.count(i) / n for i in set(pieces)]
    return sum(len(w.decode()) for w in words) / n, sum(sp.is_byte(i) for i in pieces) / n, -sum(x * math.log2(x) for x in shares) / math.log2(n + 1)


def test_fertility_verdicts_against_plain_python(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(12)
    odd = lambda: " ".join(chr(0x2500 + rng.randint(0, 900)) * 3 for _ in range(70))
    texts = [(rng.choice([prose(lang, rng, rng.randint(20, 120)), "same words here " * 40, prose(lang, rng, 30) + odd(), odd()]) if rng.random() < 0.4 else prose(lang, rng, 90), lang) for lang in VOICES for _ in range(30)]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in fertility.judge(docs, PIECES).collect()}
    figures = [plain_fertility(t, sp) for t, _ in texts]
    base = [plain_counts(t) for t, _ in texts]
    failed = [n < 50 or 100 * repeats > 50 * n for n, _, _, _, repeats in base]
    fences = {}
    for lang in VOICES:
        for m in range(3):
            v = sorted(f[m] for f, bad, (_, known) in zip(figures, failed, texts) if known == lang and not bad)
            low, mid, high = (v[max(0, math.ceil(p * len(v)) - 1)] for p in (0.25, 0.5, 0.75))
            spread = max(high - low, abs(mid) * 0.02, 0.005)
            fences[lang, m] = low - 4 * spread, high + 4 * spread
    verdicts = []
    for i, (_, lang) in enumerate(texts):
        assert [got[i][m] for m in fertility.MEASURES] == pytest.approx(figures[i], abs=1e-9)
        verdicts.append(not failed[i] and all(fences[lang, m][0] - 1e-9 <= figures[i][m] <= fences[lang, m][1] + 1e-9 for m in range(3)))
        assert got[i].base_failed == failed[i] and got[i].kept == verdicts[-1], texts[i][0][:60]
    assert any(verdicts) and any(not v and not bad for v, bad in zip(verdicts, failed))


def plain_language(model, text):
    """Language and score from all 2 to 4 character subwords of the padded words, one by one."""
    bits, full = len(model.logits).bit_length() - 1, (1 << 64) - 1
    factors = [int(x) for x in langid.FACTORS]
    sums, n = [0.0] * len(model.languages), 0
    for word in langid.RUNS.findall(text.lower()):
        word = f" {word} "
        for k in range(2, 5):
            for i in range(len(word) - k + 1):
                h = ord(word[i]) * factors[0] & full
                for j in range(1, k):
                    h = ((h ^ (h >> 29)) + ord(word[i + j]) * factors[j]) & full
                n += 1
                for at, x in enumerate(model.logits[(h * factors[0] & full) >> (64 - bits)]):
                    sums[at] += float(x)
    if not n:
        return "und", 0.0
    z = [(s / n + float(b)) / model.temperature for s, b in zip(sums, model.bias)]
    p = [math.exp(x - max(z)) for x in z]
    best = p.index(max(p))
    return model.languages[best], p[best] / sum(p)


def test_language_scores_against_plain_python(spark, voices):
    model = langid.fit(voices)
    rng = random.Random(6)
    texts = ["", "12 ?!", "a", "\u00e9 \u65e5\u672c\u8a9e", "Le Der THE", "x" * 300] + [prose(rng.choice(list(VOICES)), rng, rng.randint(1, 40)) for _ in range(40)]
    got = langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()
    for r in got:
        name, score = plain_language(model, texts[r.doc_id])
        assert r.lang_pred == name and r.score == pytest.approx(score, abs=1e-5), texts[r.doc_id][:60]
        assert r.rejected == (name == "und" or r.score < model.reject_below)
