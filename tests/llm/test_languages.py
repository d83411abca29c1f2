import math
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftmill.llm import languages
from draftmill.llm.common import crc_mod
from draftmill.llm.queries import op12_language_id

SF = "/root/testdata/sf0.01"


def is_letter(c):
    return unicodedata.category(c).startswith("L")


def grams(text):
    """A text's n-grams, by their definition."""
    out, word = [" "], False
    for c in text.lower():
        if is_letter(c):
            out.append(c)
            word = True
        elif word:
            out.append(" ")
            word = False
    out += [" "] if word else []
    if out == [" "]:
        return []
    return [g for n in languages.ORDERS for i in range(len(out) - n + 1) if (g := "".join(out[i : i + n])) != " "]


def test_grams_against_their_definition(monkeypatch):
    monkeypatch.setattr(languages, "CELLS", 64)
    monkeypatch.setattr(languages, "BATCH", 50)
    texts = ["Ab  cd-é9f", "", "123 ,.", "x", "日本語 Σίσυφος", "a" * 3000, "\0q\0", "ß\U0001f600Ünd \U00020000", " end "]
    for t in texts:
        points, owner = languages.laid_out([t])
        assert sum(len(p) for p, _ in languages.places(points, owner, 1 << 16, 4)) == len(grams(t)), t
    found = [Counter() for _ in texts]
    for part in languages.batches(texts):
        for place, own in languages.places(*languages.laid_out(texts[part]), 1 << 16, 4):
            assert (np.diff(own) >= 0).all()
            for p, o in zip(place.tolist(), own.tolist(), strict=True):
                found[part.start + o][p] += 1
    place_of = lambda g: Counter(p for part in languages.places(np.array([0 if c == " " else ord(c) for c in g], np.uint32), np.zeros(len(g), np.int32), 1 << 16, 4) for p in part[0].tolist())
    whole = {g: None for t in texts for g in grams(t)}
    for g in whole:  # the place of the longest n-gram is what its parts don't account for
        rest = place_of(g)
        for n in languages.ORDERS:
            for i in range(len(g) - n + 1):
                if n < len(g) and g[i : i + n] != " ":
                    rest[whole[g[i : i + n]]] -= 1
        (whole[g],) = rest.elements()
    for t, got in zip(texts, found, strict=True):
        assert got == Counter(whole[g] for g in grams(t))


def test_scores_against_plain_bayes(spark):
    """With far more places than n-grams, hashed naive Bayes is naive Bayes."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("and then the end", "en"), ("der hund und die katze", "de"), ("das ende", "de"), ("le chat", "fr")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.learn(docs, F.lit(True))
    counts = defaultdict(Counter)
    for _, t, lang in rows:
        counts[lang].update(grams(t))
    width, share = model.matrix.shape[1], Counter(lang for *_, lang in rows)
    for t in ("the dog", "die hunde", "chat", "quiz"):
        logs = {lang: math.log(share[lang] / 5) + sum(math.log((c[g] + languages.SMOOTH) / (c.total() + languages.SMOOTH * width)) for g in grams(t)) / len(languages.ORDERS) for lang, c in counts.items()}
        top = max(logs, key=logs.get)
        (lang,), (score,) = model.predict([t])
        assert lang == top and score == pytest.approx(1 / sum(math.exp(x - logs[top]) for x in logs.values()), abs=2e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    rows = op12_language_id(spark, SF).collect()
    assert len(rows) == len(known) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and known[r.doc_id][0] and r.lang_pred != "und"]
    assert len(held) > 150 and sum(r.lang_pred == known[r.doc_id][0] for r in held) / len(held) > 0.97
    assert all((r.lang_pred == "und") == (not any(map(is_letter, known[r.doc_id][1] or ""))) for r in rows)


def test_held_out_languages_and_other_columns_are_never_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.withColumns({"lang": F.when(crc_mod("doc_id", 4) == 2, "xx").otherwise(F.col("lang")), "source": F.lit("s")})
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in languages.languages(x).collect()} for x in (docs, other))
    assert a == b


def test_odd_rows(spark, odd, none):
    docs = odd.withColumns({"lang": F.when(F.col("doc_id") == 9, "").when(F.col("doc_id") % 2 == 0, "b").when(F.col("doc_id") == 1, None).otherwise("a"), "lang_pred": F.lit(1), "place": F.lit("x")})
    rows = languages.languages(docs).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {"und"} and {r.lang_pred for r in rows if r.doc_id not in (3, 4, 5)} <= {"a", "b"}
    assert {(r.lang_pred, r.score) for r in languages.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}
    assert languages.languages(none.withColumn("lang", F.lit("a"))).count() == 0


def test_many_languages_narrow_the_model_and_too_many_are_refused(spark, monkeypatch):
    docs = spark.range(40).selectExpr("id AS doc_id", "concat('word ', chr(97 + id % 20)) AS text", "concat('l', id % 20) AS lang")
    monkeypatch.setattr(languages, "MODEL_BYTES", 1 << 16)
    assert languages.learn(docs, F.lit(True)).matrix.shape == (20, 512)
    monkeypatch.setattr(languages, "MOST", 19)
    with pytest.raises(ValueError, match="19 languages"):
        languages.learn(docs, F.lit(True))
