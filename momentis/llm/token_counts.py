"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates every vocabulary match; going through match ends from left to right, dynamic programming carries
the best score and its number of pieces. Ties go to the piece that starts first, as in the tokenizers library, which offers starts
in order and replaces a best path only by a better one. A character that no one-character piece covers costs the lowest score minus
ten and counts as its UTF-8 bytes (byte fallback).

Texts are normalised as the file says: a space before the text, spaces as U+2581. Where no piece holds U+2581 after another character and scores are
whole numbers, no piece crosses into a word from before it and sums are exact wherever a run stands, so the runs between count separately, and their counts are kept in a
bounded table. Under any other vocabulary a text is one run, summed in the library's order.

Defined results: null and empty texts count 0; very long texts are counted whole, in time and memory that grow with their length; repeated rows count separately; an empty table gives an empty
result; other columns pass unchanged, but for one named as the result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentis.llm.common import small_batches, strings

MEMO = 500_000
#: Longer runs (texts without spaces) aren't kept.
MEMO_LENGTH = 60
PENALTY = 10.0
MARK = chr(0x2581)
#: Kinds of pieces in a model file that match text: normal and user-defined.
_TEXT_KINDS = (1, 4)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


def pieces(path: str) -> list[tuple[str, float, int]]:
    """Text, score and kind of each piece of a model file, by id."""
    out = []
    for number, value in _fields(open(path, "rb").read()):
        if number == 1:
            own = dict(_fields(value))
            out.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, 1)))
    return out


class UnigramCounter:
    """Counts pieces of the best segmentation."""

    def __init__(self, path: str):
        all_pieces = pieces(path)
        self.automaton = ahocorasick.Automaton()
        for text, score, kind in all_pieces:
            if kind in _TEXT_KINDS:
                self.automaton.add_word(text, (len(text), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s, _ in all_pieces) - PENALTY
        # Runs between spaces count separately where no piece reaches over a space and whole scores add up exactly in any order;
        # under other vocabularies each text is one run, whose sums are formed in the library's order.
        self.whole = any(MARK in text.lstrip(MARK) for text, _, kind in all_pieces if kind in _TEXT_KINDS) or any(s != int(s) for _, s, _ in all_pieces)
        self.run = re.compile(f"{MARK}+[^{MARK}]*")
        self.memo: dict[str, int] = {}

    def best(self, run: str) -> tuple[float, int]:
        """Score and number of pieces of the best segmentation of a normalised text."""
        score, count = [0.0], [0]
        matches = self.automaton.iter(run)
        end, found = next(matches, (-1, None))
        for at, character in enumerate(run):
            top, pieces_, single = None, 0, False
            while end == at:  # longest, and so first to start, first
                size, own = found
                single |= size == 1
                candidate = score[at + 1 - size] + own
                if top is None or candidate > top:
                    top, pieces_ = candidate, count[at + 1 - size] + 1
                end, found = next(matches, (-1, None))
            if not single:
                candidate = score[at] + self.unknown
                if top is None or candidate > top:
                    top, pieces_ = candidate, count[at] + len(character.encode())
            score.append(top)
            count.append(pieces_)
        return score[-1], count[-1]

    def count(self, text: str) -> int:
        """Number of tokens of a text."""
        if not text:
            return 0
        if self.whole:
            return self.best(MARK + text.replace(" ", MARK))[1]
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            runs = self.run.findall(MARK + text.replace(" ", MARK))
        else:
            runs = [MARK + x for x in text.split(" ")]
        memo = self.memo
        try:
            return sum([memo[x] for x in runs])
        except KeyError:
            pass
        total = 0
        for x in runs:
            n = memo.get(x)
            if n is None:
                n = self.best(x)[1]
                if len(x) <= MEMO_LENGTH:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[x] = n
            total += n
        return total


_loaded: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    if path not in _loaded:
        _loaded[path] = UnigramCounter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each text as last column (which takes the place of one so named)."""
    small_batches(docs.sparkSession)
    names = [x for x in docs.columns if x != into]
    inner = [f"_k{i}" for i in range(len(names))]
    plain = docs.select(*(F.col(f"`{x}`").alias(y) for x, y in zip(names, inner, strict=True)))
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            counts = pa.array([own.count(t) for t in strings(batch.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], [*inner, "_n"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields), "_n long"])
    return plain.mapInArrow(run, schema).select(*(F.col(y).alias(x) for x, y in zip(names, inner, strict=True)), F.col("_n").alias(into))


def op1_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, path).select("doc_id", "n_tokens")
