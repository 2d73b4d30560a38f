import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from momentis.llm import token_alignment as ta
from momentis.llm.common import numbered

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a int, key string, links string"
ODD = [None, "", " ", "\n\n", "a", " a  b ", "it's <|endoftext|> We'LL </s> <s> x", "ΑΣ İstanbul é ﬁ 日本語 123 ½ \x85a 🎉", "a\x00b \x1c c\x1d d", "lead▁mark", "x" * 3000, "a \n b\tc", "<0x41> <unk>", "no\xa0break 　 wide  em", "Étion dans, çouelle. " * 400]


def plain(texts):
    """The contract by the libraries alone, text by text, groups by common ends."""
    own_a = Tokenizer.from_file(A)
    own_a.encode_special_tokens = True
    own_b = sentencepiece.SentencePieceProcessor(model_file=B)
    bytes_of = {c: b for b, c in enumerate(ta.byte_symbols())}
    rows, total = [], Counter()
    for t in texts:
        if not t:
            rows.append(None)
            continue
        e = own_a.encode(" " + t, add_special_tokens=False)
        ids_b = own_b.encode(t)
        part_a = [bytes(bytes_of[c] for c in x) for x in e.tokens]
        pieces = [own_b.id_to_piece(k) for k in ids_b]
        part_b = [bytes([int(p[3:5], 16)]) if own_b.is_byte(k) else p.replace("▁", " ").encode() for p, k in zip(pieces, ids_b, strict=True)]
        if not b"".join(part_a) == b"".join(part_b) == (" " + t).encode():
            rows.append(None)
            continue
        found, i, at_a, at_b, ga, gb = [], 0, 0, 0, [], []
        for x, k in zip(part_a, e.ids, strict=True):
            at_a += len(x)
            ga.append(k)
            while at_b < at_a:
                at_b += len(part_b[i])
                gb.append(ids_b[i])
                i += 1
            if at_a == at_b:
                found.append((ga, gb))
                ga, gb = [], []
        links = [(a[-1], b[-1]) for a, b in found]
        total.update(links)
        rows.append((len(e.ids), len(ids_b), found, links))
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in r[2])
        out.append((r[0], r[1], len(r[2]), len(r[3]), sum(total[x] == most[x[1]] for x in r[3]), sum(total[x] for x in r[3]), hashlib.sha256(text.encode()).hexdigest()))
    return out


def made(seed, n):
    rng = random.Random(seed)
    return ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(97, 123), rng.randrange(0xA0, 0x250), 32, 32, 10])) for _ in range(80)) for _ in range(n)]


def test_against_the_libraries(spark):
    texts = ODD + made(3, 150) + ODD[:8]
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, i, "k", "l") for i, t in enumerate(texts)], SCHEMA)
    aligned = numbered(ta.align(docs, A, B), "uid")
    want = Counter((None if i == 3 else i // 2, *w) for i, w in enumerate(plain(texts)))
    for limit in (ta.BROADCAST_PAIRS, 20, 0):  # all pairs broadcast, the most frequent ones, none
        got = ta.link_scores(aligned, broadcast=limit).collect()
        assert Counter(tuple(r[x] for x in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in got) == want


def test_whole_query(spark, tmp_path):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    table = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    got = {r.doc_id: tuple(r)[1:] for r in ta.op11_token_alignment(spark, sf).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(table, plain([r["text"] for r in table]), strict=True)}
    assert ta.link_scores(ta.align(spark.createDataFrame([], SCHEMA), A, B)).count() == 0


def test_components_are_minimal_groups():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 30)
        a, b = (sorted({n, *rng.sample(range(1, n + 1), rng.randint(0, n - 1))}) for _ in range(2))
        cuts = [0, *sorted(set(a) & set(b))]
        want = [([i for i, x in enumerate(a) if lo < x <= hi], [j for j, x in enumerate(b) if lo < x <= hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        of_a, of_b = ta.groups(np.array(a), np.array(b))
        assert [(np.flatnonzero(of_a == g).tolist(), np.flatnonzero(of_b == g).tolist()) for g in range(len(cuts) - 1)] == want


def test_groups_of_a_very_long_chunk(spark):
    text = "ab1c" * 200_000
    row = ta.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B, with_groups=True).collect()[0]
    parts = [g.split("|") for g in row.groups.split(";")]
    assert sum(len(a.split(",")) for a, _ in parts) == row.n_a and sum(len(b.split(",")) for _, b in parts) == row.n_b
    assert len(parts) == row.n_groups == row.n_links
