import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from momentis.llm import suffix_dedup as s


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mark = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = True
        spans = int(np.sum(mark[1:] & ~mark[:-1]) + mark[0]) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~mark].tobytes() if len(b) else b""
        out.append((len(b), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß€") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, line = text(60), text(12)
    out = [None, "", "short", "short", text(300), "z" * 1500, "ab" * 400]
    out += [text(rng.randint(0, 40)) + shared[rng.randint(0, 90) :] + text(rng.randint(0, 40)) for _ in range(25)]
    out += ["\n".join([line, text(40)] * 3) for _ in range(6)]
    near = text(250).split()
    for _ in range(8):
        copy = list(near)
        for _ in range(3):
            copy[rng.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    return out + [out[4], out[4], out[9]]


@pytest.mark.parametrize(("hot", "rows", "size"), [(s.HOT, s.BLOCK_ROWS, s.BLOCK_BYTES), (3, 5, s.BLOCK_BYTES), (3, 1000, 2000)])
def test_equals_brute_force(spark, monkeypatch, hot, rows, size):
    monkeypatch.setattr(s, "HOT", hot)
    monkeypatch.setattr(s, "BLOCK_ROWS", rows)
    monkeypatch.setattr(s, "BLOCK_BYTES", size)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, uid string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in s.remove_repeats(docs, keep=["doc_id"], digest=True).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_columns_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None, 1), (None, "a" * 300, 2)], "doc_id long, text string, block int")
    got = sorted(map(tuple, s.remove_repeats(docs).select("block", "n_removed", "text").collect()))
    assert got == [(1, 0, None), (2, 300, "")]
    assert s.remove_repeats(docs.where("false")).count() == 0


def test_long_texts_and_names_that_clash(spark):
    """Texts of over a segment, and columns called as the added ones are."""
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    passage = long[1_048_400:1_048_900]
    docs = spark.createDataFrame([(1, long, 5, "h"), (2, "x" + passage + "y", 6, "h"), (3, None, 7, "h")], "doc_id long, text string, n_bytes int, h string").repartition(2)
    out = s.remove_repeats(docs)
    assert out.columns == ["doc_id", "h", "n_bytes", "n_removed", "n_spans", "text"]
    got = {r.doc_id: (r.n_removed, r.text) for r in out.collect()}
    assert got == {1: (500, long.replace(passage, "")), 2: (500, "xy"), 3: (0, None)}
