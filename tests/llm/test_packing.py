import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayline.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello, world", "it's  a\ttest\n\n of 12 things!! Éa ñandú STRASSE ß Σας ΟΔΟΣ", "\x1c\x85 x y é ́z <|endoftext|> İstanbul ﬁ", "The.,; thing's 'd'll re're"]


def test_ids_equal_the_tokenizers():
    own, plain = packing.WordIds(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for text in TEXTS:
        assert np.frombuffer(own.ids(text or ""), "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_on_documents(spark):
    own, plain = packing.WordIds(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect():
        assert np.frombuffer(own.ids(row["text"]), "<u4").tolist() == plain.encode(row["text"], add_special_tokens=False).ids


def test_ids_of_many_texts_at_once(monkeypatch):
    """Chunks, long runs, stops and capitals of every kind, and a memory that is too small for what comes: always the tokeniser's ids."""
    odd = ["A.", "a,.", "Ab., cd.", "É. é, É", "x. ' .", ". a", ", ,", "H\u0331 h\u0331. ΟΔΟΣ. Word, it's'll. don't.", "a\xa0b. c\x85", "ab" * 90 + ". x" + "y" * 200, "e\u0301. \u0301", "  ", "\n", "ª. µ, ÿ×. ÷", "<|endoftext|>. a", "9. a9. 9a,"]
    texts = [*TEXTS, *odd, " ".join(f"{a}{b}. {b}{a},, {a}{i}" for i, (a, b) in enumerate(zip(odd * 5, TEXTS * 10, strict=False)))]
    plain = Tokenizer.from_file(VOCABULARY)
    want = [plain.encode(text or "", add_special_tokens=False).ids for text in texts]
    for chunk, cached in ((1 << 20, 1 << 20), (64, 1 << 20), (64, 8), (1000, 50)):
        monkeypatch.setattr(packing, "CHUNK", chunk)
        monkeypatch.setattr(packing, "CACHED", cached)
        own = packing.WordIds(VOCABULARY)
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in own.of(texts)] == want
    assert packing.WordIds(VOCABULARY).of([]) == []


def test_new_words_are_encoded_together(monkeypatch):
    own, calls = packing.WordIds(VOCABULARY), []
    monkeypatch.setattr(own, "_plainly", lambda run: calls.append(run) or packing.WordIds._plainly(own, run))
    text = " ".join("".join(chr(97 + (i // 26**k) % 26) for k in range(5)) + "." * (i % 2) + "!?" * (i % 3 == 0) for i in range(5000))
    assert len(own.ids(text)) > 5000 and set(calls) <= {"!?", ".!?", "."} and len(calls) <= 3


def checked(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("shape", ["mixed", "large", "small", "one", "hot"])
def test_places_are_valid_and_few(spark, shape):
    rng = np.random.default_rng(5)
    n = {"mixed": rng.integers(1, 101, 700), "large": rng.integers(30, 101, 300), "small": rng.integers(1, 12, 500), "one": np.array([100]), "hot": np.where(rng.random(600) < 0.5, 34, rng.integers(1, 101, 600))}[shape]
    pieces = spark.createDataFrame([(i, 0, 0, int(x), i) for i, x in enumerate(n)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.place(pieces, 100).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(n)))
    made = checked(rows, 100)
    bins = []  # best fit decreasing
    for x in sorted(n.tolist(), reverse=True):
        fits = [i for i, b in enumerate(bins) if b >= x]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= x
        else:
            bins.append(100 - x)
    assert made <= len(bins) * 1.02 + 1


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "word " * 500, "c"), (3, "word " * 500, "c"), (None, "x", "d")], "doc_id long, text string, length string")
    placed = packing.pack(docs, VOCABULARY, 64).cache()
    rows = placed.collect()
    checked(rows, 64)
    assert sum(r["length"] for r in rows) == 1 + 1 + 2 * 501 + 2
    assert [r["ids_crc32"] for r in rows if r["doc_id"] == 1] == [zlib.crc32(b"\0\0\0\0")]
    assert {(r["piece"], r["start"]) for r in rows if r["doc_id"] == 3} == {(i, 64 * i) for i in range(8)}
    made = packing.sequences(docs, placed, VOCABULARY, 64).collect()
    assert sum(len(r["ids"]) // 4 for r in made) == sum(r["length"] for r in rows)
    assert packing.pack(docs.limit(0), VOCABULARY, 64).count() == 0
