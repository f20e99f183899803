"""The filter interaction audit against a count by hand of every order."""

import collections
import itertools
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("terrane.llm")

from terrane.llm import filter_audit  # noqa: E402

FILTERS = "ABCDE"


def rows():
    long = " ".join(f"w{i}" for i in range(230))
    dull = "same words again " * 90
    texts = [None, "", "", "short", "Short TEXT", long, long, long.upper(), dull, dull, long + " 5%", "  " + long, "é" * 300 + " A", "a|b", long + "\x0b\x0c", "x " * 40_000, "x " * 40_000]
    out = [(i, t, "web" if i % 3 else None, "x", 1) for i, t in enumerate(texts)]
    out += [(i, long, "hot", "x", 1) for i in range(100, 160)] + [(120, long, "hot", "x", 1)] * 3
    return out + [(None, long, "web", "x", 1), (None, "only here", "", "x", 1), (3, "another text of id 3", "web", "x", 1), (3, "Short TEXT", "web", "x", 1)]


LABELS = [(0, 1, 0), (5, 1, 0), (6, 1, 1), (6, 0, 0), (8, None, 1), (9, 0, 1), (110, 1, 1), (120, 1, 0), (120, 1, 0), (None, 1, 1), (9999, 1, 1), (3, 1, None)]


def fails(doc_id, text, lowest):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    out = set("A") if len(words) < 200 else set()
    out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
    out |= {"D"} if re.search(r"[#$%&*|]", t) else set()
    return out | ({"E"} if doc_id is not None and lowest is not None and lowest < doc_id else set())


def by_hand(docs):
    lowest = {}
    for i, t, *_ in docs:
        if i is not None:
            lowest[t or ""] = min(lowest.get(t or "", i), i)
    good, toxic = {i for i, q, _ in LABELS if q == 1 and i is not None}, {i for i, _, x in LABELS if x == 1 and i is not None}
    out = {}
    for part in {s or "" for _, _, s, *_ in docs}:
        own = [(i, fails(i, t, lowest.get(t or ""))) for i, t, s, *_ in docs if (s or "") == part]
        removed_by = collections.Counter()
        for order in itertools.permutations(FILTERS):
            left = own
            for k, letter in enumerate(order):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                removed_by[letter] += len(gone)
                redundant = sum(letter in f for _, f in own) - len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), redundant, sum(f == {letter} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(removed_by[order[step - 1]])
    return out


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_audit_equals_counting_by_hand(spark, ranges):
    """With many ranges, the copies of one text lie in several of them."""
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string, mask string, edge int").repartition(5).withColumns({c: F.lit("clash") for c in ("id", "part", "print", "key", "lowest", "n", "good")})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = filter_audit.audit(docs, labels).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = by_hand(rows())
    assert len(got) == len(expected) and {(r.part, r.filter_order, r.step): [r[f] for f in filter_audit.FIGURES] for r in got} == expected
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert sum(r.removed for r in filter_audit.audit(docs, labels.limit(0)).collect()) == sum(v[1] for v in expected.values())
