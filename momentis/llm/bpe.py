"""Byte-level BPE with word ends: encoding by a pair occurrence index, decoding, and memoised encoding of whole columns.

Encoding collects the new words of a batch, maps every pair of neighbouring symbols to all its positions in them, takes the active
ranks in ascending order, merges each pair at all its positions and updates the lists of the pairs beside them. As a merge never
makes a pair of a lower rank (checked when the vocabulary is loaded), this gives each word what merging it alone would.

Texts split at spaces and line feeds into chunks that encode independently; results of chunks are kept in a table that is emptied
when it has MEMO entries, so a worker's memory is bounded.

Defined results: null and empty texts encode to no ids and decode to an empty text; very long texts are encoded whole, and ids keep the order of the text; of equal pairs
the one further left is merged first; rows are treated one by one, so repeated rows, null ids and other columns pass unchanged, but for one named as the result; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentis.llm.common import small_batches, strings

MEMO = 800_000
#: White space as the tokenizer files' patterns understand it.
_SPACES = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class PairIndexBPE:
    """Encoder and decoder of a tokenizer file with the parts: NFC, lower case, pattern split, byte level, BPE with word ends."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab = dict(model["vocab"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        made: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, whole = vocab[a], vocab[b], vocab[a + b]
            if made.get(x, -1) >= rank or made.get(y, -1) >= rank:
                raise ValueError("a merge uses a symbol that only a later merge makes")
            self.merges.setdefault((x, y), (rank, whole))
            made.setdefault(whole, rank)
        self.pair_of = {rank: (pair, whole) for pair, (rank, whole) in self.merges.items()}
        symbols = byte_symbols()
        self.symbol = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.end] for s in symbols]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace(r"\s", _SPACES))
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.memo: dict[str, bytes] = {}
        size = max(self.tokens) + 1
        self.texts = pa.array([self.tokens.get(i, "") for i in range(size)], pa.large_string())
        self.numbers = pa.array([str(i) for i in range(size)], pa.large_string())

    def words(self, chunk: str) -> list[str]:
        """The pieces that are merged separately."""
        text = unicodedata.normalize("NFC", chunk)
        return self.pattern.findall("".join(c.lower() for c in text) if "Σ" in text else text.lower())

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, by the pair occurrence index over all of them."""
        ids: list[int] = []
        starts = []
        for w in words:
            starts.append(len(ids))
            ids += [self.symbol[b] for b in w[:-1]]
            ids.append(self.last[w[-1]])
            ids.append(-1)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, index, heap = self.merges, {}, []
        for p in range(n - 1):
            got = merges.get((ids[p], ids[p + 1]))
            if got:
                rank = got[0]
                if rank in index:
                    index[rank].append(p)
                else:
                    index[rank] = [p]
                    heap.append(rank)
        heapq.heapify(heap)
        while heap:
            rank = heapq.heappop(heap)
            (a, b), whole = self.pair_of[rank]
            for p in sorted(index.pop(rank)):
                q = after[p]
                if ids[p] != a or ids[q] != b:
                    continue
                ids[p], ids[q] = whole, -2
                far = after[p] = after[q]
                before[far] = p
                for left, pair in ((before[p], (ids[before[p]], whole)), (p, (whole, ids[far]))):
                    got = merges.get(pair)
                    if got and left >= 0:
                        if got[0] in index:
                            index[got[0]].append(left)
                        else:
                            index[got[0]] = [left]
                            heapq.heappush(heap, got[0])
        out = []
        for p in starts:
            own = []
            while ids[p] != -1:
                own.append(ids[p])
                p = after[p]
            out.append(own)
        return out

    def learn(self, chunks: set[str]) -> None:
        """Put chunks into the table."""
        if len(self.memo) + len(chunks) > MEMO:
            self.memo.clear()
        known: dict[str, int] = {}
        parts: dict[str, list[int]] = {}  # the words' numbers, specials as -1 - id
        for chunk in chunks:
            own = []
            for piece in self.specials.split(chunk) if self.specials and "<|" in chunk else (chunk,):
                if piece in self.special:
                    own.append(-1 - self.special[piece])
                else:
                    own += [known.setdefault(w, len(known)) for w in self.words(piece)]
            parts[chunk] = own
        coded = [np.array(x, np.int32).tobytes() for x in self.merge([w.encode() for w in known])]
        for chunk, own in parts.items():
            self.memo[chunk] = b"".join([coded[k] if k >= 0 else np.array([-1 - k], np.int32).tobytes() for k in own])

    def encode(self, texts: list[str]) -> pa.LargeListArray:
        """The ids of each text."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        found = [list(map(self.memo.get, chunks)) for chunks in split]
        new = {c for chunks, got in zip(split, found, strict=True) if None in got for c, x in zip(chunks, got, strict=True) if x is None}
        if new:
            self.learn(new)
            for k, got in enumerate(found):
                if None in got:
                    found[k] = [self.memo[c] if x is None else x for c, x in zip(split[k], got, strict=True)]
        coded = [b"".join(got) for got in found]
        stops = np.cumsum([0, *map(len, coded)]) // 4
        return pa.LargeListArray.from_arrays(pa.array(stops, pa.int64()), pa.array(np.frombuffer(b"".join(coded), np.int32)))

    def joined(self, ids: pa.LargeListArray, of: pa.Array) -> pa.Array:
        """For each row, an entry per id, with a space between them."""
        return pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets, of.take(ids.values)), pa.scalar(" ", pa.large_string()))

    def decode(self, ids: pa.LargeListArray) -> pa.Array:
        """The text of each row of ids: without a decoder in the file, its tokens with a space between them."""
        return self.joined(ids, self.texts)


_loaded: dict[str, PairIndexBPE] = {}


def tokenizer(path: str) -> PairIndexBPE:
    """The tokenizer of a file, loaded once in each worker."""
    if path not in _loaded:
        _loaded[path] = PairIndexBPE(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with the ids of each text."""
    small_batches(docs.sparkSession)

    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield tokenizer(path).encode([x or "" for x in column]).to_pandas()

    return docs.withColumn(into, F.pandas_udf(ids, "array<int>")(F.col(f"`{text}`")))


def decode(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with the text of each row of ids."""

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            rows = pa.array([[] if x is None else x for x in column], pa.large_list(pa.int32()))
            yield tokenizer(path).decode(rows).to_pandas()

    return docs.withColumn(into, F.pandas_udf(texts, "string")(F.col(f"`{ids}`")))


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: its number of ids and the SHA-256 of its ids and of the text they decode to."""
    small_batches(docs.sparkSession)

    def sha(column: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for batch in batches:
            ids = own.encode(strings(batch.column(1)))
            columns = [batch.column(0), pc.list_value_length(ids).cast(pa.int64()), sha(own.joined(ids, own.numbers)), sha(own.decode(ids))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def op5_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
