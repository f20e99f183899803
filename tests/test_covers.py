"""Stems by published examples, covers by trying all stretches, and scores of a table by hand."""

import random
import re

import pytest
from conftest import SF

from terrane.functions.stemming import stem
from terrane.operators import covers

STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss",
    "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc", "digitizer": "digit", "vietnamization": "vietnam", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "formaliti": "formal", "sensitiviti": "sensit", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "replacement": "replac",
    "adoption": "adopt", "communism": "commun", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is", "élan": "élan",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def slow_covers(places, k):
    spans = [(a, b) for i, (a, _) in enumerate(places) for b, _ in places[i:] if len({w for p, w in places if a <= p <= b}) == k]
    return sorted({s for s in spans if not any(t != s and s[0] <= t[0] and t[1] <= s[1] for t in spans)})


def test_covers_equal_trying_all_stretches():
    rng = random.Random(5)
    for _ in range(200):
        places = [(p, rng.randrange(3)) for p in sorted(rng.sample(range(40), rng.randint(1, 12)))]
        k = len({w for _, w in places})
        assert covers.minimal_covers(places, k) == slow_covers(places, k)


def test_scores_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    asked = {1: "the with", 2: "entions of", 3: "nothing-like-this", 4: "licensed work"}
    queries = spark.createDataFrame([*asked.items(), (5, None), (None, "x")], "query int, term string")
    got = {(r.query, r.doc): (r.stems, r.score) for r in covers.cover_scores(docs, queries, "doc_id", "text").collect()}
    expected = {}
    for query, text in asked.items():
        wanted = {stem(w) for w in re.findall("[a-z0-9]+", text)}
        for doc, body in docs.collect():
            places = [(i, stem(w)) for i, w in enumerate(re.findall("[a-z0-9]+", (body or "").lower())) if stem(w) in wanted]
            if places and len(places) < 80:
                k = len({w for _, w in places})
                expected[query, doc] = (k, pytest.approx(k / len(wanted) * sum(1 / (b - a + 1) for a, b in slow_covers(places, k))))
    assert len(expected) > 50 and all(got[key] == value for key, value in expected.items())
    assert covers.cover_scores(docs.limit(0), queries, "doc_id", "text").count() == 0
