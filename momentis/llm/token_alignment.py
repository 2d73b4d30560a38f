"""Cross-tokenizer alignment: the minimal groups of tokens of two vocabularies that cover the same bytes, and how often ids are linked.

A text with a space before it is encoded by a byte-level vocabulary (A) and by a piece vocabulary with byte fallback (B). Tokens are the
nodes of a graph, an A and a B token with a byte in common its edges; union-find gives its components, which are exactly the groups
between byte offsets where tokens of both end. The members of a component are expanded into links: the pairs that end together. Links
are counted in the whole corpus by id pair, and each document's links are then scored by these counts.

Both vocabularies begin a token at a space or line feed that stands between two characters that are no white space (of B this is checked:
none of its pieces holds a space after another character, or a line feed), so such a character always begins a group, and a text is the
sequence of its chunks between them. A chunk is encoded and grouped once and kept in a table bounded by bytes.

Scale: one pass over the texts, whose result (counts, digest, and the document's distinct links with their numbers) is written once.
Pair counts are pre-aggregated before their shuffle. They are bounded by the two vocabularies, not by the corpus; at most `BROADCAST_PAIRS`
of them are broadcast, the most frequent ones, which also keeps frequent pairs out of the shuffle; the rest are joined by a shuffle in
which no key has more than the least broadcast count. Document sums are pre-aggregated where their links lie.

Null and empty texts, and texts that one of the two doesn't give back byte by byte (for B those with U+2581), have no tokens: zeros and
the empty string. Very long texts are taken whole; special tokens' strings are text; repeated rows count each; ids may be null or
repeated; an empty table gives an empty result; only the two columns named are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentis.llm.bpe import byte_symbols
from momentis.llm.common import materialize, numbered, small_batches
from momentis.llm.packing import ChunkTokens

BROADCAST_PAIRS = 500_000
#: What the table of chunks may hold, in bytes of chunks and results.
MEMO_BYTES = 96 << 20
#: Chunks that are encoded at once.
SOME = 10_000
MARK = "▁"


def components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Union-find over the edges (x, y) of n nodes, all edges at once: the least node of each node's component.

    In each round every root takes the least root that an edge leads to, and paths are compressed until all nodes point at roots.
    """
    parent = np.arange(n)
    while True:
        px, py = parent[x], parent[y]
        if (px == py).all():
            return parent
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number, from 0 and in order, of the component of each A and each B token; a and b hold the ends of consecutive tokens over the same bytes."""
    # Between two neighbouring ends there's one token of each side: an edge for each pair with a byte in common.
    ends = np.sort(np.concatenate([a, b]), kind="stable")
    ends = ends[np.append(ends[1:] != ends[:-1], True)]
    top = components(len(a) + len(b), np.searchsorted(a, ends), len(a) + np.searchsorted(b, ends))
    # A component's least node is its first A token.
    number = np.cumsum(top[: len(a)] == np.arange(len(a))) - 1
    return number, number[top[len(a) :]]


class Aligner:
    """Two vocabularies and what is known of chunks: (numbers of A and of B tokens in one, the groups' text, links as bytes), or None if bytes differ."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        known = {k: bytes(byte_of[c] for c in t) for t, k in self.a.get_vocab(with_added_tokens=False).items() if all(c in byte_of for c in t)}
        self.bytes_a = [known.get(k, b"") for k in range(max(known) + 1)]
        #: The same merges in a faster library, where ids are the file's merges in order (this is checked).
        self.fast = ChunkTokens(path_a).fast
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = []
        across = re.compile(f"[^{MARK}]{MARK}|\n")
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            if across.search(piece):
                raise ValueError("a piece of this vocabulary reaches over a space or a line feed")
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace(MARK, " ").encode())
        self.memo: dict[str, tuple[int, str, bytes]] = {}
        self.held = 0

    def learn(self, chunks: list[str]) -> dict[str, tuple[int, str, bytes]]:
        """What is to be known of chunks, each with its leading space or line feed; those whose bytes differ are left out."""
        # At a chunk's start A begins a token whatever stands before, but white space at a chunk's end depends on what follows.
        joined = [c for c in chunks if not c[-1].isspace()]
        single = [c for c in chunks if c[-1].isspace()]
        ids_a = self.fast.encode_ordinary("".join(joined))
        for x in self.a.encode_batch(single, add_special_tokens=False):
            ids_a += x.ids
        chunks = joined + single
        # B puts a space before what it encodes: a chunk's own, or one that is a token by itself before a line feed.
        pieces = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        pieces = [y if c[0] == " " else y[1:] for c, y in zip(chunks, pieces, strict=True)]
        parts_a = list(map(self.bytes_a.__getitem__, ids_a))
        parts_b = [list(map(self.bytes_b.__getitem__, x)) for x in pieces]
        data = [c.encode() for c in chunks]
        wrong = {c for c, x, y in zip(chunks, data, parts_b, strict=True) if b"".join(y) != x}
        if b"".join(parts_a) != b"".join(data):
            raise ValueError("this vocabulary doesn't give all bytes back")
        if wrong:
            return self.learn([c for c in chunks if c not in wrong])
        return {} if not chunks else self._grouped(chunks, np.array(ids_a), np.cumsum(list(map(len, parts_a))), np.array(list(chain.from_iterable(pieces))), np.cumsum(list(map(len, chain.from_iterable(parts_b)))), np.cumsum(list(map(len, data))))

    def _grouped(self, chunks: list[str], ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, b: np.ndarray, stops: np.ndarray) -> dict[str, tuple[int, str, bytes]]:
        """The tokens of chunks one behind the other, by their ids and ends and the chunks' ends, in groups."""
        of_a, of_b = groups(a, b)
        # The members of a component expanded: only its last tokens end together, and they do.
        last_a, last_b = (np.flatnonzero(np.append(g[1:] != g[:-1], True)) for g in (of_a, of_b))
        links = (ids_a[last_a] << 32 | ids_b[last_b]).astype("<i8").tobytes()
        upto = [np.searchsorted(x, stops, "right") for x in (a, b, a[last_a])]
        # Tokens by group, A before B, each with what stands behind it: , in a side, | between the sides, ; between groups, a line feed after a chunk.
        side = np.concatenate([2 * of_a, 2 * of_b + 1])
        order = np.argsort(side, kind="stable")
        side = side[order]
        mark = np.where(side[1:] == side[:-1], 0, np.where(side[1:] % 2 == 1, 1, 2))
        mark = np.append(mark, 2)
        mark[np.searchsorted(side, 2 * upto[2]) - 1] = 3
        both = np.empty(2 * len(order), object)
        both[::2] = list(map(str, np.concatenate([ids_a, ids_b])[order].tolist()))
        both[1::2] = np.array([",", "|", ";", "\n"], object)[mark]
        said = "".join(both.tolist()).split("\n")
        numbers = (np.diff(upto[0], prepend=0) << 32 | np.diff(upto[1], prepend=0)).tolist()
        edges = [0, *(8 * upto[2]).tolist()]
        return {c: (n, text, links[lo:hi]) for c, n, text, lo, hi in zip(chunks, numbers, said, edges, edges[1:], strict=False)}

    def fresh(self, chunks: list[str]) -> dict[str, tuple[int, str, bytes]]:
        """What is to be known of new chunks; it goes into the table while that has room, so what comes early, and so most often, stays."""
        found = {}
        for k in range(0, len(chunks), SOME):
            found |= self.learn(chunks[k : k + SOME])
        if self.held < MEMO_BYTES:
            self.memo |= found
            self.held += sum([330 + len(c) + len(x[1]) + len(x[2]) for c, x in found.items()])
        return found

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, int, str, bytes] | None]:
        """For each text its numbers of A and of B tokens, the groups' text, and the links as bytes."""
        get = self.memo.get
        split = [chunks_of(t) if t and MARK not in t else [] for t in texts]
        found = [list(map(get, own)) for own in split]
        new = {c for own, got in zip(split, found, strict=True) if None in got for c, x in zip(own, got, strict=True) if x is None}
        fresh = self.fresh(list(new)) if new else {}
        for own, got in zip(split, found, strict=True):
            if None in got:
                got = [fresh.get(c) if x is None else x for c, x in zip(own, got, strict=True)]  # noqa: PLW2901
            if not got or None in got:
                yield None
                continue
            numbers, said, links = zip(*got, strict=True)
            total = sum(numbers)
            yield total >> 32, total & 0xFFFFFFFF, ";".join(said), b"".join(links)


#: White space that stands beside other white space, or is neither a space nor a line feed.
_odd = re.compile(r"\s\s|[^\S \n]")
_edge = re.compile(r"(?<=\S)(?=[ \n]\S)")


def chunks_of(text: str) -> list[str]:
    """A text, with a space before it, cut before the spaces and line feeds between two characters that are no white space."""
    text = " " + text
    if "\x01" in text or text[1].isspace() or text[-1].isspace() or _odd.search(text):
        return _edge.split(text)
    return text.replace(" ", "\x01 ").replace("\n", "\x01\n").split("\x01")[1:]


_loaded: dict[tuple[str, str], Aligner] = {}


def align(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """Per document: key, n_a, n_b, n_groups, n_links, groups_sha256, links (distinct id pairs, A's id in the upper half, and their number) and, if wanted, the groups as text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _loaded.get((path_a, path_b))
        if own is None:
            own = _loaded[path_a, path_b] = Aligner(path_a, path_b)
        for batch in batches:
            counts, shas, said, pairs, times, sizes = [], [], [], [], [], [0]
            for found in own.align(batch.column(1).to_pylist()):
                a, b, text_, links = found or (0, 0, "", b"")
                distinct, each = np.unique(np.frombuffer(links, "<i8"), return_counts=True)
                counts.append((a, b, len(links) // 8, len(links) // 8))  # a link for each group
                shas.append(hashlib.sha256(text_.encode()).hexdigest() if found else "")
                said.append(text_)
                pairs.append(distinct)
                times.append(each)
                sizes.append(sizes[-1] + len(distinct))
            numbers = np.array(counts, np.int64).reshape(-1, 4).T
            distinct_links = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *pairs])), pa.array(np.concatenate([np.zeros(0, np.int64), *times]))], ["pair", "n"])
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), distinct_links)
            columns = [batch.column(0), *(pa.array(x) for x in numbers), pa.array(shas, pa.string()), lists, *([pa.array(said, pa.string())] if with_groups else [])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", *(["groups"] if with_groups else [])])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair: long, n: long>>"
    return rows.mapInArrow(run, schema + (", groups string" if with_groups else "")).withColumnRenamed("key", key)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair in all documents, and whether no pair of its B id has more."""
    counts = materialize(aligned.select(F.inline("links")).groupBy("pair").agg(F.sum("n").alias("count")))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.join(most, b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_scores(aligned: DataFrame, key: str = "doc_id", broadcast: int = BROADCAST_PAIRS) -> DataFrame:
    """The rows of align with n_best and count_sum of their links in place of the links. They are written, unless they have a `uid` from `numbered`."""
    if "uid" not in aligned.columns:
        aligned = numbered(aligned, "uid")
    counts = materialize(pair_counts(aligned))
    links = aligned.select("uid", F.inline("links"))
    if counts.count() <= broadcast:
        scored = links.join(F.broadcast(counts), "pair", "left")
    else:
        # The most frequent pairs, by powers of two of their counts (at most 64 rows come here).
        level = F.length(F.bin("count")).alias("level")
        room, least = broadcast, 64
        for row in counts.groupBy(level).count().orderBy(F.desc("level")).collect():
            room -= row["count"]
            if room < 0:
                break
            least = row["level"]
        frequent = F.length(F.bin("count")) >= least
        near = links.join(F.broadcast(counts.where(frequent)), "pair", "left")
        far = near.where("count IS NULL").drop("count", "best").join(counts.where(~frequent), "pair")
        scored = near.where("count IS NOT NULL").unionByName(far)
    # Numbers alone are summed, where the links lie; the documents' other columns meet the sums once.
    sums = scored.groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    found = aligned.drop("links").join(sums, "uid", "left")
    return found.select(key, "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("n_best", "count_sum")), "groups_sha256")


def op11_token_alignment(spark, sf_dir: str, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    return link_scores(align(spark.read.parquet(f"{sf_dir}/documents.parquet"), path_a, path_b))
