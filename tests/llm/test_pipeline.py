"""The pipeline against plain loops over a small corpus, and its stages' contracts."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from momentis.llm import pii_surrogates
from tests.llm.test_operators import similar


def good(text):
    words = (text or "").split()
    grams = Counter(zip(*(words[k:] for k in range(5)), strict=False))
    hit = {k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)}
    return len(words) >= 10 and 100 * len(hit) <= 20 * len(words)


def cut(texts, length=200):
    data = [t.encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mark = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = True
        out.append(np.frombuffer(b, np.uint8)[~mark].tobytes().decode("utf-8", "ignore"))
    return out


def test_pipeline_equals_plain_loops(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(3000)) for _ in range(n))
    shared, base = text(60), text(200)
    texts = [None, "", "too short", "same five words here now " * 8, text(50), base, base, base.replace(" ", "  ", 1), base + " one more", text(40) + " " + shared, shared + " " + text(90), text(700) * 1]
    texts += [text(60) + " mail ann.lee@mail.org ip 10.1.2.3 " + text(20) for _ in range(3)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [r for r in rows if good(r[1])]
    first = {}
    for r, c in zip(kept, similar([r[1] for r in kept]), strict=True):
        first.setdefault(c, r)
    kept = sorted(first.values())
    own = pii_surrogates.Surrogates(pii_surrogates.DEFAULT_KEY)
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r, t in zip(kept, cut([r[1] for r in kept]), strict=True):
        ids = np.array([*tokens.encode(own.replaced(t)[0], add_special_tokens=False).ids, 0], "<u4")
        edges = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(r[0], p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, "clean words that nobody else has written in any other place at all", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() == 1 and stage(spark, docs.where("false"), "").count() == 0, name


def test_stages_leave_unread_results_alone(spark, tmp_path):
    """A stage deletes what the one before wrote for itself only when it reads that one's written result."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(i, text(i % 6), "en", "s", 1) for i in range(12)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    docs = spark.read.parquet(path)
    good, one = corpus_pipeline.quality(spark, docs, ""), corpus_pipeline.near_duplicates(spark, docs, "")
    assert good.count() == 12 and one.count() == 6
    good.write.parquet(str(tmp_path / "good"))
    kept = spark.read.parquet(str(tmp_path / "good"))
    single = corpus_pipeline.near_duplicates(spark, kept, "")
    cut = corpus_pipeline.repeats(spark, single, "")
    assert single.count() == 6 and cut.count() == 6
