"""Language spans: Viterbi against enumeration, word scores against counting, held-out accuracy, scripts and odd rows."""

import collections
import itertools
import zlib

import numpy as np
import pytest
import regex
from conftest import SF
from pyspark.sql import functions as F

pytest.importorskip("terrane.llm")

from terrane.llm import language_spans  # noqa: E402


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(40):
        counts = rng.integers(0, 6, 5)
        scores, prior = rng.normal(0, 3, (counts.sum(), 3)), rng.normal(0, 1, 3)
        path = language_spans.viterbi(scores, counts, prior, switch=2.0)
        at = 0
        for n in counts.tolist():
            own = scores[at : at + n]

            def worth(states):
                return prior[states[0]] + sum(own[t, s] for t, s in enumerate(states)) - 2.0 * sum(a != b for a, b in itertools.pairwise(states))  # noqa: B023

            if n:
                best = max(worth(s) for s in itertools.product(range(3), repeat=n))
                assert worth(path[at : at + n].tolist()) == pytest.approx(best)
            at += n


def test_n_grams_of_words_equal_counting():
    texts = ["Der süße x", "", "a  b1c", "日本"]
    words = language_spans.words_of([t.encode() for t in texts])
    assert words.counts.tolist() == [3, 0, 3, 1] and words.letters.tolist() == [3, 4, 1, 1, 1, 1, 2]
    expected = collections.Counter()
    for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", " ".join(texts).lower()):
        spelt = b" " + w.encode() + b" "
        for size in range(1, 5):
            expected[size] += sum(spelt[i : i + size] not in (b" ", b"") for i in range(len(spelt) - size + 1))
    assert {size: len(at) for size, (at, _) in enumerate(language_spans.cells_of(words.data), 1)} == expected
    assert all(list(language_spans.cells_of(language_spans.words_of(t).data)) == [] for t in ([], [b""], [b"1 2"]))


def test_blocks_do_not_change_scores(monkeypatch):
    rng = np.random.default_rng(1)
    names, cells = ["x", "y"], language_spans.CELLS
    model = language_spans.Model(names, rng.normal(size=(2, cells)), np.ones((len(language_spans.SCRIPTS), 2), dtype=bool), np.zeros(2))
    words = language_spans.words_of([("word%s long longer " % i).encode() for i in range(200)])
    whole = model.scores(words)
    monkeypatch.setattr(language_spans, "BLOCK_BYTES", 50)
    assert np.allclose(whole, model.scores(words), atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_spans.predict(docs, language_spans.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    swapped = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, "zz").otherwise(F.col("lang")))
    a, b = language_spans.fit(docs), language_spans.fit(swapped.repartition(3))
    assert a.names == b.names and np.allclose(a.weights, b.weights) and (a.uses == b.uses).all()


EN = "the quick brown fox jumps over the lazy dog while seven other animals were watching from behind that old wooden fence and then went home"
DE = "der schnelle braune Fuchs springt über den faulen Hund während sieben andere Tiere hinter jenem alten Zaun zuschauten und danach nach Hause gingen"
RU = "быстрая коричневая лиса прыгает через ленивую собаку"


def test_mixed_texts_scripts_and_odd_rows(spark):
    rng = np.random.default_rng(7)
    shuffled = lambda text: " ".join(rng.permutation(text.split()))
    rows = [(i, shuffled(text), lang) for i, (text, lang) in enumerate([(EN, "en"), (DE, "de"), (RU, "ru")] * 60)]
    odd = [(900, None, "en"), (901, "", "en"), (902, "1234 ... 99 _ ²", "de"), (903, f"{EN}. {DE}!", None), (904, "собака fox", None), (905, "Ελληνικά", None), (None, EN, None), (900, DE, "de"), (906, "¿ " + DE + " 5 " * 9000, None), (907, "x", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("id", "cell", "n", "score", "spans", "lang_pred", "share", "count")}).repartition(4)
    model = language_spans.fit(docs)
    got = collections.defaultdict(list)
    for r in language_spans.predict(docs, model).where("doc_id >= 900 or doc_id is null").collect():
        got[r.doc_id].append(r)
    assert sorted((r.lang_pred, r.score, len(r.spans)) for r in got[901] + got[902]) == [("und", 0.0, 0)] * 2
    assert sorted(r.lang_pred for r in got[900]) == ["de", "und"] and got[None][0].lang_pred == "en"
    spans = got[903][0].spans
    assert [s.lang for s in spans] == ["en", "de"] and (spans[0].start, spans[1].end) == (0, len(EN) + 2 + len(DE))
    assert abs(spans[0].end - len(EN)) <= 12 and spans[1].start - spans[0].end >= 1
    assert [(s.lang, s.start, s.end) for s in got[904][0].spans] == [("ru", 0, 6), ("en", 7, 10)]
    assert got[905][0].lang_pred in model.names
    assert [(s.lang, s.start, s.end) for s in got[906][0].spans] == [("de", 2, 2 + len(DE))] and got[907][0].lang_pred in model.names
    assert language_spans.predict(docs.limit(0), model).count() == 0 and language_spans.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in language_spans.predict(docs, None).collect()} == {"und"}


def test_rare_languages_are_fitted_whole(spark):
    docs = spark.createDataFrame([(i, f"alpha beta word{i}", "big") for i in range(3000)] + [(5000 + i, "zzyx qqry", "rare") for i in range(8)], "doc_id long, text string, lang string")
    model = language_spans.fit(docs, rows=100)
    assert model.names == ["big", "rare"]
    got = language_spans.predict(docs.where("doc_id >= 5000"), model).collect()
    assert {r.lang_pred for r in got} == {"rare"}
