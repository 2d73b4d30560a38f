"""Best-fit packing of tokenised documents into sequences of a fixed size.

Only the histogram of lengths matters, and it has at most `CAPACITY` entries at any input size. Over it the configuration linear
program (the fewest patterns, in fractions, that cover all lengths) is solved by multiplicative weights: prices fall with what is
covered, a knapsack dynamic program over the capacity finds the best patterns at these prices, and a dual solution bounds all packings
from below. The fractional solution is rounded down, the program of what is left solved anew while rounding takes a good share, and best
fit decreasing packs the rest. Best fit decreasing alone is packed too, and the better of both holds, so the result never takes more
sequences than that; where it already needs no more than the volume's bound, nothing is left to solve.

The patterns become a table of slots (bounded by the number of patterns), and every piece finds its own slot from its rank among the
pieces of its length. Ranks are counted in blocks of rows, so that a length that a third of all pieces share meets in no task.

Defined results: null and empty texts are one piece of one id (the closing 0); very long texts are read whole and cut; repeated rows are
packed separately; ids may be null or repeated; pieces of one length are alike, so any of them may take any slot of it, and which one does
follows the rows' order in the files; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentis.llm.bpe import byte_symbols
from momentis.llm.common import numbered, small_batches, strings

CAPACITY = 2048
#: Pricings by the knapsack in each program, how many of them are early (few steps, soon forgotten), steps over the pool after each, and what
#: a step may cover of a length.
PRICINGS, EARLY, INNER, STEP = 24, 16, 60, 0.05
#: How fast prices fall with the covered share, how near to the best a pattern steps, how near a new one must come to enter the pool,
#: what stays of early steps, and the gap to the bound that ends a program.
RATE, NEAR, WORTHY, FADE, GAP = 6.0, 0.2, 0.05, 0.9, 0.002
#: New patterns that a pricing puts into the pool, about.
FRESH = 600
#: A program is solved anew for what rounding leaves while the last rounding took this share of it.
SHARE = 0.3
MEMO = 800_000
#: Pieces in a block, and in a part (one task's rows, as rows are numbered), as powers of two.
BLOCK_BITS, PART_BITS = 10, 33

Pattern = tuple[list[tuple[int, int]], int]


class Fillings:
    """The worthiest filling of every room under prices of lengths: an unbounded knapsack by dynamic programming."""

    def __init__(self, lengths: np.ndarray, price: np.ndarray, capacity: int):
        self.lengths, self.price, self.capacity = lengths, price, capacity
        self.worth = np.zeros(capacity + 1)
        self.first = np.zeros(capacity + 1, np.int64)  # the index of the length to place first in a room, or -1
        self.room = np.zeros(capacity + 1, np.int64)  # what is left of a room once its unused units are taken off
        self.first[:] = -1
        fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
        for room in range(1, capacity + 1):
            self.worth[room], self.first[room], self.room[room] = self.worth[room - 1], self.first[room - 1], self.room[room - 1]
            if k := fits[room]:
                got = self.worth[room - lengths[:k]] + price[:k]
                best = int(np.argmax(got))
                if got[best] > self.worth[room] + 1e-12:
                    self.worth[room], self.first[room], self.room[room] = got[best], best, room

    def patterns(self, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each length the best pattern with it, and one whose second piece is any that loses up to `WORTHY` of the best worth, as
        triples (pattern, length index, count): else all would share the one length that is worth most."""
        lengths, size = self.lengths, len(self.lengths)
        left = self.capacity - lengths
        after = left[:, None] - lengths[None, :]
        worth = np.where(after >= 0, self.price[None, :] + self.worth[np.maximum(after, 0)], -1.0)
        near = worth >= self.worth[left][:, None] - WORTHY * self.worth[-1]
        second = np.argmax(np.where(near & (after >= 0), rng.random((size, size)), -1.0), axis=1)
        held = (near & (after >= 0)).any(axis=1)
        row, item = [np.arange(2 * size), size + np.flatnonzero(held)], [np.tile(np.arange(size), 2), second[held]]
        alive, room = np.arange(2 * size), np.concatenate([left, np.where(held, left - lengths[second], left)])
        while True:
            more = self.first[room] >= 0
            alive, room = alive[more], self.room[room[more]]
            if not len(alive):
                break
            got = self.first[room]
            row.append(alive)
            item.append(got)
            room = room - lengths[got]
        key, count = np.unique(np.concatenate(row) * size + np.concatenate(item), return_counts=True)
        return key // size, key % size, count


class Programme:
    """The configuration linear program over a histogram: the fewest patterns, in fractions, that cover every length.

    Multiplicative weights: each length has a price that falls exponentially with the share of it that is covered; the knapsack prices
    the patterns; those within `NEAR` of the best take a step of at most `STEP` of any of their lengths. Patterns stay in a pool, and
    between two pricings the weights go on over the pool alone. Prices divided by the worth of the best pattern are a
    feasible dual solution, whose value bounds every packing from below.
    """

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int):
        self.lengths, self.counts, self.capacity = lengths, counts.astype(float), capacity
        self.bound = float(self.counts @ lengths) / capacity
        self.pool: dict[bytes, int] = {}
        self.row, self.item, self.count = (np.zeros(0, np.int64) for _ in range(3))
        self.taken = np.zeros(0)

    def add(self, row: np.ndarray, item: np.ndarray, count: np.ndarray) -> None:
        """Put new patterns into the pool."""
        edges = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]]))
        keep = np.zeros(len(row), bool)
        to = np.zeros(len(row), np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = item[a:b].tobytes() + count[a:b].tobytes()
            if key not in self.pool:
                self.pool[key] = len(self.pool)
                keep[a:b], to[a:b] = True, self.pool[key]
        self.row, self.item, self.count = np.concatenate([self.row, to[keep]]), np.concatenate([self.item, item[keep]]), np.concatenate([self.count, count[keep]])
        self.taken = np.concatenate([self.taken, np.zeros(len(self.pool) - len(self.taken))])

    def solve(self) -> np.ndarray:
        """How often each pattern of the pool is used; every length is covered."""
        lengths, counts = self.lengths, self.counts
        covered, mean = np.zeros(len(lengths)), lengths / self.capacity
        self.value, use, rng = np.inf, None, np.random.default_rng(5)
        for turn in range(PRICINGS):
            fillings = Fillings(lengths, mean, self.capacity)
            self.bound = max(self.bound, float(counts @ mean) / fillings.worth[-1])
            row, item, count = fillings.patterns(rng)
            worth = np.bincount(row, mean[item] * count)
            fresh = (worth >= (1 - WORTHY) * fillings.worth[-1])[row] if turn else np.ones(len(row), bool)
            if turn and len(lengths) > FRESH:
                # Of many lengths, each pricing takes some by lot; all come in turn.
                fresh &= (rng.random(2 * len(lengths)) < FRESH / (2 * len(lengths)))[row]
            self.add(row[fresh], item[fresh], count[fresh])
            if self.value <= self.bound * (1 + GAP):
                break
            mean = np.zeros(len(lengths))
            near = NEAR / (1 + turn / 4)
            early = turn < EARLY
            # A small pool's steps are cheap, so more of them can bring its prices nearer.
            for _ in range(INNER // 20 if early else INNER * max(1, min(10, 20_000 // len(self.row)))):
                share = covered / counts
                price = lengths / self.capacity * np.exp(-RATE * np.minimum(share - share.min(), 100))
                value = np.bincount(self.row, price[self.item] * self.count, len(self.pool))
                top = value.max()
                mean += price / top
                good = np.flatnonzero(value >= top * (1 - near))
                at = np.isin(self.row, good) if len(good) < len(value) else slice(None)
                row, item, count = self.row[at], self.item[at], self.count[at]
                # Each good pattern steps as far as its scarcest length allows, whose step is dealt out among all that hold it.
                room = STEP * counts / np.maximum(np.bincount(item, count, len(lengths)), 1)
                size = np.full(len(self.pool), np.inf)
                np.minimum.at(size, row, room[item])
                size[np.isinf(size)] = 0.0
                self.taken += size
                covered += np.bincount(item, size[row] * count, len(lengths))
            # What was taken under early prices fades, so that the average follows the later ones.
            self.taken *= FADE / 2 if early else FADE
            covered = np.bincount(self.item, self.taken[self.row] * self.count, len(lengths))
            least = (covered / counts).min()
            if least > 0 and self.taken.sum() / least < self.value:
                self.value, use = self.taken.sum() / least, self.taken / least
        found = np.zeros(len(self.pool))
        if use is not None:
            found[: len(use)] = use
        return found


def rounded(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Whole patterns from the fractional solution: those it uses are taken as often as it says, rounded down, where all their pieces
    are still there; the program of what is left is solved anew, as long as rounding takes a good share."""
    out: list[Pattern] = []
    while left.any():
        lengths = np.flatnonzero(left)
        programme = Programme(lengths, left[lengths], capacity)
        use = programme.solve()
        edges = np.flatnonzero(np.concatenate([[True], programme.row[1:] != programme.row[:-1], [True]]))
        order = sorted(((use[programme.row[a]], a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)), reverse=True)
        before = int(left @ np.arange(capacity + 1))
        for amount, a, b in order:
            items, counts = lengths[programme.item[a:b]], programme.count[a:b]
            times = min(int(amount), int((left[items] // counts).min()))
            if times > 0:
                left[items] -= counts * times
                out.append((sorted(zip(items.tolist(), counts.tolist(), strict=True), reverse=True), times))
        if before - int(left @ np.arange(capacity + 1)) < SHARE * before:
            break
    return out


def configure(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns (length and count, ...) with the number of sequences that each fills; they hold every piece exactly once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[Pattern] = []
    if left[capacity]:
        out.append(([(capacity, 1)], int(left[capacity])))
        left[capacity] = 0
    whole = best_fit(left, capacity)
    if sum(n for _, n in whole) > -(-int(left @ np.arange(capacity + 1)) // capacity):
        rest = left.copy()
        found = rounded(rest, capacity)
        found += best_fit(rest, capacity)
        # Rounding can lose to best fit where few pieces are left over; the better of the two packs.
        whole = min(whole, found, key=lambda patterns: sum(n for _, n in patterns))
    return out + whole


def best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit decreasing over a histogram: equal open sequences are kept together."""
    rooms: dict[int, dict[tuple, int]] = defaultdict(dict)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            room = next((r for r in range(length, capacity + 1) if rooms.get(r)), None)
            if room is None:
                each = min(capacity // length, n)
                many = n // each
                content = ((length, each),)
                rest = capacity - each * length
                rooms[rest][content] = rooms[rest].get(content, 0) + many
                n -= many * each
                continue
            content, many = rooms[room].popitem()
            use = min(many, n)
            if many > use:
                rooms[room][content] = many - use
            grown = (*content[:-1], (length, content[-1][1] + 1)) if content[-1][0] == length else (*content, (length, 1))
            rooms[room - length][grown] = rooms[room - length].get(grown, 0) + use
            n -= use
    return [(list(content), many) for opened in rooms.values() for content, many in opened.items()]


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, first sequence, first offset), sorted by length and rank."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for content, many in patterns:
        offset = 0
        for length, copies in content:
            rows.append((length, used[length], copies, sequence, offset))
            used[length] += copies * many
            offset += copies * length
        sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(table: np.ndarray):
    shift = 1 << 48

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = table[:, 0] * shift + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            row = table[np.searchsorted(starts, length * shift + rank, "right") - 1]
            within = rank - row[:, 1]
            sequence = row[:, 3] + within // row[:, 2]
            offset = row[:, 4] + within % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(sequence), pa.array(offset)], [*batch.schema.names[2:], "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """pieces, whose length is 1 up to capacity, with sequence_id and offset as last columns (which take the place of columns so named)."""
    names = [x for x in pieces.columns if x not in ("sequence_id", "offset")]
    inner = [f"_k{i}" for i in range(len(names))]
    rows = pieces.select(F.col(f"`{length}`").cast("long").alias("length"), *(F.col(f"`{x}`").alias(y) for x, y in zip(names, inner, strict=True)))
    rows = numbered(rows, "uid")
    histogram = {int(n): int(c) for n, c in rows.groupBy("length").count().collect()}  # at most `capacity` rows
    table = slots(configure(histogram, capacity))
    # Ranks within a length, from counts of blocks, of parts of many blocks, and of the parts before: no task orders more than a part.
    rows = rows.withColumns({"part": F.shiftright("uid", PART_BITS), "block": F.shiftright("uid", BLOCK_BITS)})
    blocks = rows.groupBy("length", "part", "block").count()
    parts = blocks.groupBy("length", "part").agg(F.sum("count").alias("count"))
    up_to = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("count").over(up_to("length", "part")), F.lit(0))).drop("count")
    blocks = blocks.withColumn("before", F.coalesce(F.sum("count").over(up_to("length", "part", "block")), F.lit(0))).drop("count")
    starts = blocks.join(parts, ["length", "part"]).select("length", "block", (F.col("base") + F.col("before")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("length", "block").orderBy("uid"))
    ranked = rows.withColumn("inside", inside).join(starts, ["length", "block"]).select("length", (F.col("start") + F.col("inside") - 1).alias("rank"), *inner)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields[2:]] + ["sequence_id long, offset long"])
    placed = ranked.mapInArrow(_placed(table), schema)
    return placed.select(*(F.col(y).alias(x) for x, y in zip(names, inner, strict=True)), "sequence_id", "offset")


#: Fixed value: the split pattern of byte-level vocabularies, as the tokenizers library applies it.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ChunkTokens:
    """Ids as the tokenizers library gives them for a byte-level vocabulary, kept for the chunks between spaces.

    A space that stands between two characters that are no white space begins a chunk that the library's pattern never joins to
    what stands before. New chunks are encoded together, by the same merges in the faster library where the file's merges are its ids in order (this is
    checked); texts with any other chunk, at edges of white space or with special tokens, go through the tokenizers library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.special = [x.content for x in self.own.get_added_tokens_decoder().values()]
        model = json.load(open(path, encoding="utf-8"))["model"]
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte_of[c] for c in token): k for token, k in model["vocab"].items() if token not in self.special}
        if len(ranks) != 256 + len(pairs) or any(model["vocab"][a + b] != 256 + k for k, (a, b) in enumerate(pairs)):
            raise ValueError("the ids of this vocabulary aren't its merges in order")
        import tiktoken

        self.fast = tiktoken.Encoding("chunks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        #: Bytes that each id stands for.
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            self.width[k] = len(token)
        self.memo: dict[str, bytes] = {"": b""}

    def coded(self, text: str) -> bytes:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Put the ids of chunks into the table; all that begin with a space are encoded as one text, cut by the bytes of its ids."""
        if len(self.memo) + len(chunks) > MEMO:
            self.memo.clear()
            self.memo[""] = b""
        some = []
        for c in chunks:
            if c == " " or c[-1].isspace() or (c[0] == " " and c[1].isspace()) or ("<" in c and any(x in c for x in self.special)):
                self.memo[c] = _WHOLE
            elif c[0] == " ":
                some.append(c)
            else:
                self.memo[c] = self.coded(c)
        ids = np.array(self.fast.encode_ordinary("".join(some)), "<u4")
        stops = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(c.encode()) for c in some])) + 1
        data, edges = ids.tobytes(), [0, *(4 * stops).tolist()]
        for c, a, b in zip(some, edges, edges[1:], strict=False):
            self.memo[c] = data[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        split = [t.replace(" ", "\x01 ").split("\x01") if "\x01" not in t else None for t in texts]
        found = [None if chunks is None else list(map(self.memo.get, chunks)) for chunks in split]
        new = {c for chunks, got in zip(split, found, strict=True) if got and None in got for c, x in zip(chunks, got, strict=True) if x is None}
        if new:
            self.learn(new)
            for k, got in enumerate(found):
                if got and None in got:
                    found[k] = [self.memo[c] if x is None else x for c, x in zip(split[k], got, strict=True)]
        return [self.coded(t) if got is None or _WHOLE in got else b"".join(got) for t, got in zip(texts, found, strict=True)]


#: Stands for a chunk that only its whole text decides; no ids have one byte.
_WHOLE = b"?"


_loaded: dict[str, ChunkTokens] = {}


def cut(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """Pieces of tokenised documents: key, piece, start, length and ids_crc32."""
    small_batches(docs.sparkSession)
    end = np.array([closing], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = ChunkTokens(path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(_loaded[path].encode(strings(batch.column(1)))):
                ids += end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for p, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    row.append(k), piece.append(p), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("key", key)


def op4_best_fit_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(cut(docs, path))
