"""The alignment of two tokenizers against overlaps of all token pairs, encoded whole."""

import collections
import hashlib

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

pytest.importorskip("terrane.llm")

from terrane.llm import token_alignment  # noqa: E402

TEXTS = [
    None, "", " ", "  ", "a", "a ", " a", "a\n", "\na", "a\nb", "a \n b", "a\n\nb  c", "tab\there", "Hello, world! it's 3.14", "naïve façade — “quotes” über straße", "日本語 のテキスト\n한국어", "🎉🎉 party🎉", "<|endoftext|> ok <s> </s> <unk>",
    "under▁line", "nul\0byte", "no\xa0break", "x" * 300, "ﬁ ① ﬁ", "é ́", "<0x0A> <0x41>", "the the the the", "the the the the", "crlf\r\nline", "　wide", "'s 's don't 'RE", "﻿bom", "word " * 3000 + "end",
]


def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    files = token_alignment.default_tokenizers()
    a = Tokenizer.from_file(files[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=files[2])
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}

    def encode(text):
        left = a.encode(" " + text, add_special_tokens=False).ids
        right = b.encode(text)
        left_bytes = [bytes(spelt[c] for c in a.id_to_token(i)) for i in left]
        right_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in right]
        return (left, right, left_bytes, right_bytes) if b"".join(left_bytes) == b"".join(right_bytes) == b" " + text.encode() else ([], [], [], [])

    return encode


def by_hand(texts):
    encode = encoders()
    made = []
    for text in texts:
        a, b, a_bytes, b_bytes = encode(text) if text else ([], [], [], [])
        a_ends, b_ends = np.cumsum([*map(len, a_bytes)]).astype(int), np.cumsum([*map(len, b_bytes)]).astype(int)
        a_starts, b_starts = a_ends - [len(x) for x in a_bytes], b_ends - [len(x) for x in b_bytes]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(np.searchsorted(b_ends, a_starts[i], "right"), np.searchsorted(b_starts, a_ends[i], "left"))]
        both = sorted(set(a_ends.tolist()) & set(b_ends.tolist()))
        within = lambda ids, ends, low, high: ",".join(map(str, ids[np.searchsorted(ends, low, "right") : np.searchsorted(ends, high, "right")]))
        groups = [within(a, a_ends, low, high) + "|" + within(b, b_ends, low, high) for low, high in zip([0, *both], both, strict=False)]
        made.append((len(a), len(b), groups, links))
    count = collections.Counter(p for *_, links in made for p in set(links))
    most_a, most_b = {}, {}
    for (x, y), n in count.items():
        most_a[x], most_b[y] = max(most_a.get(x, 0), n), max(most_b.get(y, 0), n)
    return [(a, b, len(g), len(li), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "", sum(count[p] == most_a[p[0]] for p in li), sum(count[p] == most_b[p[1]] for p in li), sum(count[p] for p in li)) for a, b, g, li in made]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "n_best_b", "count_sum")


def test_odd_texts_equal_all_overlaps(spark):
    ids = [*range(len(TEXTS) - 2), None, 3]
    docs = spark.createDataFrame(list(zip(ids, TEXTS, strict=True)), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "row", "pair", "key", "a", "times", "groups")}).repartition(3)
    expected = collections.Counter(zip(ids, by_hand(TEXTS), strict=True))
    alignment = token_alignment.align(docs)
    counts = token_alignment.pair_counts(alignment)
    for lookup_keys in (token_alignment.LOOKUP_KEYS, 40, 1):
        got = token_alignment.scored(alignment, counts, lookup_keys).collect()
        assert collections.Counter((r.doc_id, tuple(r[c] for c in COLUMNS)) for r in got) == expected
    assert token_alignment.alignment_scores(docs.limit(0)).count() == 0
    kept = token_alignment.align(docs.where("doc_id = 4"), keep_groups=True).first()
    assert hashlib.sha256(kept.groups.encode()).hexdigest() == kept.groups_sha256


def test_query_equals_all_overlaps(spark):
    from terrane.llm import queries

    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_token_alignment(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert got == dict(zip([r.doc_id for r in docs], by_hand([r.text for r in docs]), strict=True))


def test_ids_equal_the_tokenizers_file():
    aligner = token_alignment.Aligner(token_alignment.default_tokenizers())
    rng = np.random.default_rng(5)
    parts = ["a", "The", "it's", " ", "\n", "ß", "日", "12", "!!", "the", "-", "🎉", "é", "  ", "\t", "\x85", "\xa0", "\x1c", "x" * 2500]
    for text in ["".join(rng.choice(parts, 12)) for _ in range(400)]:
        assert aligner.ids_of(" " + text) == aligner.a.encode(" " + text, add_special_tokens=False).ids
