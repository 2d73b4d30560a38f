"""Suffix-array dedup: every byte covered by a `length`-byte string that also starts elsewhere goes.

How it scales. A `length`-byte window has a smallest 32-byte hash inside it, its anchor (the first of equals). Neighbouring windows
with the same anchor form one context. Equal windows have equal anchors, so a window can only repeat inside the group of its anchor:

1. each block of documents (up to `BLOCK_ROWS` of them and about `BLOCK_BYTES`; a longer document is a block of its own) reports its distinct
   (anchor, context) hashes with counts, and only anchors seen twice go on;
2. a context seen twice repeats whole; the others of a group are compared: their texts, as
   symbols of eight bytes, are joined into shards, whose Burrows-Wheeler transform is extended backwards breadth first. Intervals
   of one suffix have found their common prefix and are left; those that survive until the minimum length share that prefix symbol by symbol, and
   of the windows around it the bytes beside the shared symbols are compared too;
3. a group of over `HOT` contexts (a passage that very many documents share) isn't gathered: each block reports the distinct
   windows of its contexts there, and windows counted twice repeat. This is exact too and spreads over all tasks;
4. each block cuts its own documents.

A key never meets more than one row per block, so no group of copies meets in one task; what all blocks hold is summed by pre-aggregation and
joined back, which adaptive execution splits. What is counted across blocks has keys of 128 bits: a hash of the anchor and one of the context or window.

Defined results: null and empty texts have nothing removed and keep nothing; texts shorter than `length` stay whole; very long texts are read
whole, in segments; repeated rows are copies of one another and lose all windows; equal anchors in one window count from the first; ids may be null,
repeated or of any type; other columns pass, but for those that are added; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentis.llm.common import materialize, mixed, powers, prefix_sums, small_batches

LENGTH = 200
ANCHOR = 32
SYMBOL = 8
HOT = 4096
SHARD_BYTES = 1 << 20
SEGMENT = 1 << 20
BLOCK_ROWS, BLOCK_BYTES = 1024, 8 << 20
#: Low bits that hold a place in a segment while hashes are compared.
_PLACE = np.uint64((1 << 21) - 1)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    rest = width - step
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def contexts(data: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """For each segment of a text: first window, number of windows, anchor hash, context hash and anchor place of each context.

    The last array has the segment's prefix sums.

    Window numbers count from the text's start; the prefix sums start at the first window of the segment.
    """
    width = length - ANCHOR + 1
    for at in range(0, len(data) - length + 1, SEGMENT):
        x = np.frombuffer(data, np.uint8, min(SEGMENT + length - 1, len(data) - at), at).astype(np.uint64)
        x += np.uint64(1)
        sums = prefix_sums(x)
        inverse = powers(len(sums))[1]
        h = mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: len(x) - ANCHOR + 1])
        least = sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), width)
        starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        ends = np.append(starts[1:], len(least))
        whole = (sums[ends - 1 + length] - sums[starts]) * inverse[starts]
        anchor = (least[starts] & _PLACE).astype(np.int64)
        yield at + starts, ends - starts, h[anchor], mixed(whole ^ (ends - starts).astype(np.uint64)), anchor - starts, sums


def repeated_windows(texts: list[bytes], groups: np.ndarray, offsets: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Which windows of each context also start in another context of its group, by backward extension of a transform.

    offsets: where the anchor's grid starts in each text, so that equal windows are cut into equal symbols. counts: how often the
    context occurs. Gives, per text, a mask over its windows.
    """
    found = [np.zeros(max(0, len(t) - length + 1), bool) for t in texts]
    need = (length - SYMBOL + 1) // SYMBOL
    pieces, owner, place = [], [], []
    for k, t in enumerate(texts):
        phase = int(offsets[k]) % SYMBOL
        n = (len(t) - phase) // SYMBOL
        if n < need:
            continue
        pieces.append(np.frombuffer(t, np.uint64, n, phase))
        owner.append(np.full(n, k))
        place.append(phase + SYMBOL * np.arange(n))
    if not pieces:
        return found
    # Symbols of different groups differ: a window never repeats across groups.
    marked = [mixed(p ^ np.uint64(groups[o[0]])) for p, o in zip(pieces, owner, strict=True)]
    ids = np.unique(np.concatenate(marked), return_inverse=True)[1].astype(np.int64) + 1
    stops = np.cumsum([len(p) + 1 for p in pieces])
    n = int(stops[-1])
    text = np.zeros(n, np.int64)  # 0 ends each piece
    inside = np.ones(n, bool)
    inside[stops - 1] = False
    text[inside] = ids
    owner_at, place_at = np.full(n, -1), np.zeros(n, np.int64)
    owner_at[inside], place_at[inside] = np.concatenate(owner), np.concatenate(place)

    order = bounded_suffix_order(text, need)
    survivors = expand_intervals(text, order, need)
    windows_of: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for label, (low, high) in enumerate(survivors):
        at = order[low:high]
        windows_of.append((np.full(high - low, label), owner_at[at], place_at[at]))
    if not windows_of:
        return found
    label, own, pos = (np.concatenate(x) for x in zip(*windows_of, strict=True))
    # The shared symbols are equal byte by byte; of the eight windows whose first whole symbol is this one, the bytes beside them are compared.
    rows = []
    inside = SYMBOL * need
    for k in np.unique(own):
        mine = own == k
        data = np.frombuffer(texts[k], np.uint8)
        for back in range(SYMBOL):
            start = pos[mine] - back
            ok = (start >= 0) & (start + length <= len(data))
            s = start[ok]
            beside = np.concatenate([np.arange(back), np.arange(back + inside, length)])
            rest = np.zeros((len(s), 2 * SYMBOL), np.uint8)
            rest[:, : len(beside)] = data[s[:, None] + beside]
            rows.append((np.full(len(s), k), s, label[mine][ok] * SYMBOL + back, rest.view(np.uint64)))
    k, s, at, rest = (np.concatenate(x) for x in zip(*rows, strict=True))
    by = np.lexsort((rest[:, 1], rest[:, 0], at))
    k, s, at, rest = k[by], s[by], at[by], rest[by]
    first = np.concatenate([[True], (at[1:] != at[:-1]) | (rest[1:] != rest[:-1]).any(axis=1)])[: len(at)]
    group = np.cumsum(first) - 1
    again = np.bincount(group, weights=counts[k])[group] > 1 if len(k) else np.zeros(0, bool)
    for kk, ss in zip(k[again], s[again], strict=True):
        found[kk][ss] = True
    return found


def bounded_suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix positions sorted by their first `depth` symbols at least, by prefix doubling."""
    rank, step = text.copy(), 1
    order = np.argsort(rank, kind="stable")
    while step < depth + 1:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] + 1 if step < len(rank) else 0
        key = (rank.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty_like(rank)
        rank[order] = fresh
        step *= 2
    return order


def expand_intervals(text: np.ndarray, order: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Intervals of at least two suffixes with `need` symbols in common and no end mark among them.

    Level by level, each interval of a string w gives the intervals of every cw, through the last-to-first mapping of the transform.
    An interval left with one suffix has no longer common prefix and isn't extended; the level reached is its common prefix.
    """
    last = text[order - 1]  # the transform; order is cyclic, and the final end mark precedes position 0
    by_symbol = np.argsort(last, kind="stable")
    forward = np.empty_like(by_symbol)
    forward[by_symbol] = np.arange(len(by_symbol))
    head = text[order]
    low = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    high = np.append(low[1:], len(head))
    keep = (high - low > 1) & (head[low] > 0)
    low, high = low[keep], high[keep]
    for _ in range(need - 1):
        if not len(low):
            break
        size = high - low
        group = np.repeat(np.arange(len(low)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[group]
        real = last[at] > 0  # nothing extends over an end mark
        group, to, symbol = group[real], forward[at[real]], last[at[real]]
        by = np.argsort(to)
        group, to, symbol = group[by], to[by], symbol[by]
        if not len(to):
            return []
        first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (symbol[1:] != symbol[:-1])]))
        stop = np.append(first[1:], len(to))
        many = stop - first > 1
        low, high = to[first[many]], to[stop[many] - 1] + 1
    return list(zip(low.tolist(), high.tolist(), strict=True))


def _blocks(most_rows: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the number of their block, the text last."""
        block, rows, size = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            numbers = []
            for n in pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist():
                if rows >= most_rows or (rows and size + n > most_bytes):
                    block, rows, size = block + 1, 0, 0
                rows, size = rows + 1, size + n
                numbers.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *batch.columns], ["block", *batch.schema.names])

    return run


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, hs, cs = None, [], []

        def flush() -> pa.RecordBatch:
            h, c = np.concatenate(hs), np.concatenate(cs)
            _, first, times = np.unique(mixed(h) ^ c, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), block)), pa.array(h[first].view(np.int64)), pa.array(c[first].view(np.int64)), pa.array(times.astype(np.int64))], ["block", "h", "c", "n"])

        for batch in batches:
            for b, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != block:
                    if hs:
                        yield flush()
                    block, hs, cs = b, [], []
                for _, _, h, c, *_ in contexts((text.as_py() or "").encode(), length):
                    hs.append(h)
                    cs.append(c)
        if hs:
            yield flush()

    return run


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Index of each value in the sorted `of`, or -1."""
    if not len(of):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return np.where(of[at] == values, at, -1)


def _column(table: pa.Table, name: str) -> np.ndarray:
    values = table.column(name).combine_chunks()
    return (values.fill_null(0) if values.null_count else values).to_numpy(zero_copy_only=False)


def _wanted(length: int):
    """The texts of the contexts asked for, or the distinct windows of those in hot groups."""

    def run(_key, docs: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"block": [], "h": [], "c": [], "n": [], "grid": [], "text": []}
        if asked.num_rows and docs.num_rows:
            block = asked.column("block")[0].as_py()
            key = mixed(_column(asked, "h").view(np.uint64)) ^ _column(asked, "c").view(np.uint64)
            by = np.argsort(key)
            key, n, hot = key[by], _column(asked, "n")[by], _column(asked, "hot")[by]
            open_, seen = np.ones(len(key), bool), []
            for text in docs.column("text"):
                data = (text.as_py() or "").encode()
                for start, windows, h, c, grid, sums in contexts(data, length):
                    at = _member(mixed(h) ^ c, key)
                    base = int(start[0])
                    for i in np.flatnonzero(at >= 0):
                        k, s, w = at[i], int(start[i]), int(windows[i])
                        if not open_[k]:
                            continue
                        open_[k] = False
                        if hot[k]:
                            r = np.arange(s - base, s - base + w)
                            seen.append((np.full(w, n[k]), mixed((sums[r + length] - sums[r]) * powers(len(sums))[1][r]), np.full(w, h[i])))
                        else:
                            part = data[s : s + w - 1 + length]
                            out["block"].append(block), out["h"].append(int(h[i].view(np.int64))), out["c"].append(int(c[i].view(np.int64)))
                            out["n"].append(int(n[k])), out["grid"].append(int(grid[i])), out["text"].append(part)
            if seen:
                times, h, anchor = (np.concatenate(x) for x in zip(*seen, strict=True))
                by = np.lexsort((anchor, h))
                times, h, anchor = times[by], h[by], anchor[by]
                first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (anchor[1:] != anchor[:-1])]))
                total = np.add.reduceat(times, first).astype(np.int64)
                m = len(first)
                out["block"] += [block] * m
                out["h"] += h[first].view(np.int64).tolist()
                out["c"] += anchor[first].view(np.int64).tolist()
                out["n"] += total.tolist()
                out["grid"] += [None] * m
                out["text"] += [None] * m
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=list(out))

    return run


def _compare(length: int):
    """Shards of whole groups: which windows of each context repeat."""

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[5] for r in rows]
        groups = np.array([r[1] for r in rows], np.int64).view(np.uint64)
        masks = repeated_windows(texts, groups, np.array([r[4] for r in rows]), np.array([r[3] for r in rows], float), length)
        out: list[list[int]] = [[], [], [], [], []]
        for (block, h, c, n, _, _), mask in zip(rows, masks, strict=True):
            if n > 1 or not mask.any():
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
            for low, high in edge.reshape(-1, 2).tolist():
                for column, value in zip(out, (block, h, c, low, high), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["block", "h", "c", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if size >= SHARD_BYTES and row[1] != rows[-1][1]:
                    yield shard(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5])
        if rows:
            yield shard(rows)

    return run


def covered(windows: np.ndarray, length: int, n: int) -> np.ndarray:
    """Bytes within any of the windows, as a mask; windows holds their first bytes' flags."""
    delta = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(windows)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + length, -1)
    return np.cumsum(delta[:n]) > 0


def _cut(length: int, names: list[str], digest: bool):
    def run(_key, docs: pa.Table, found: pa.Table) -> pa.Table:
        kind = _column(found, "kind") if found.num_rows else np.zeros(0)
        h = _column(found, "h").view(np.uint64) if found.num_rows else np.zeros(0, np.uint64)
        c = _column(found, "c").view(np.uint64) if found.num_rows else np.zeros(0, np.uint64)
        full = np.sort(mixed(h[kind == 1]) ^ c[kind == 1])
        some = mixed(h[kind == 2]) ^ c[kind == 2]
        by = np.argsort(some, kind="stable")
        some = some[by]
        low, high = (_column(found, x)[kind == 2][by] if found.num_rows else np.zeros(0, int) for x in ("low", "high"))
        hot = np.sort(h[kind == 3] ^ mixed(c[kind == 3]))
        hot_in = np.sort(mixed(h[kind == 4]) ^ c[kind == 4])
        kept_text, n_bytes, n_removed, n_spans, sha = [], [], [], [], []
        for text in docs.column("text"):
            data = (text.as_py() or "").encode()
            windows = np.zeros(max(0, len(data) - length + 1), bool)
            if found.num_rows:
                for start, many, hh, cc, _, sums in contexts(data, length):
                    key = mixed(hh) ^ cc
                    for i in np.flatnonzero(_member(key, full) >= 0):
                        windows[start[i] : start[i] + many[i]] = True
                    at = _member(key, some)
                    for i in np.flatnonzero(at >= 0):
                        for k in range(at[i], np.searchsorted(some, key[i], "right")):
                            windows[start[i] + low[k] : start[i] + high[k]] = True
                    for i in np.flatnonzero(_member(key, hot_in) >= 0):
                        r = np.arange(start[i] - start[0], start[i] - start[0] + many[i])
                        own = mixed((sums[r + length] - sums[r]) * powers(len(sums))[1][r]) ^ mixed(hh[i : i + 1])
                        windows[start[i] + np.flatnonzero(_member(own, hot) >= 0)] = True
            gone = covered(windows, length, len(data)) if windows.any() else None
            kept = data if gone is None else np.frombuffer(data, np.uint8)[~gone].tobytes()
            n_bytes.append(len(data))
            n_removed.append(len(data) - len(kept))
            n_spans.append(0 if gone is None else int(np.sum(gone[1:] & ~gone[:-1]) + gone[0]))
            if digest:
                sha.append(hashlib.sha256(kept).hexdigest())
            else:
                kept_text.append(text.as_py() if gone is None else kept.decode("utf-8", "ignore"))
        out = [docs.column(x).combine_chunks() for x in names]
        out += [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha if digest else kept_text, pa.string())]
        return pa.table(out, names=[*names, "n_bytes", "n_removed", "n_spans", "result"])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """Cut repeated strings out of every text.

    keep: other columns of the result (all, if None), under their own names. Adds n_bytes, n_removed, n_spans and the remaining text
    under the text's name, cut at whole characters (digest: instead kept_sha256 of the remaining bytes).
    """
    spark = docs.sparkSession
    small_batches(spark)
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else text]
    names = [x for x in (docs.columns if keep is None else keep) if x not in (text, *added)]
    inner = [f"_k{i}" for i in range(len(names))]
    plain = docs.select(*(F.col(f"`{x}`").alias(y) for x, y in zip(names, inner, strict=True)), F.col(f"`{text}`").alias("text"))
    # Written once, so that no later job can deal the rows into other blocks.
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    rows = materialize(plain.mapInArrow(_blocks(BLOCK_ROWS, BLOCK_BYTES), f"block long, {kept}"))

    seen = materialize(rows.select("block", "text").mapInArrow(_anchors(length), "block long, h long, c long, n long"))
    twice = seen.groupBy("h").agg(F.sum("n").alias("total")).where("total > 1").select("h")
    marked = materialize(seen.join(twice, "h", "left_semi"), [seen])
    one = materialize(marked.groupBy("h", "c").agg(F.sum("n").alias("n"), F.min("block").alias("block")))
    groups = one.groupBy("h").agg(F.count("*").alias("members")).where("members > 1")
    asked = materialize(one.join(groups, "h").select("block", "h", "c", "n", (F.col("members") > HOT).alias("hot")))

    by_block = rows.groupBy("block")
    gathered = materialize(rows.select("block", "text").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_wanted(length), "block long, h long, c long, n long, grid int, text binary"))
    compared = gathered.where("text is not null").repartition("h").sortWithinPartitions("h", "c").mapInArrow(_compare(length), "block long, h long, c long, low long, high long")
    hot = gathered.where("text is null").select("block", "h", "c", "n")
    hot_twice = hot.groupBy("h", "c").agg(F.sum("n").alias("times")).where("times > 1").select("h", "c")
    none = F.lit(None).cast("long")
    found = (
        marked.join(one.where("n > 1").select("h", "c"), ["h", "c"], "left_semi").select("block", F.lit(1).alias("kind"), "h", "c", none.alias("low"), none.alias("high"))
        .unionByName(compared.select("block", F.lit(2).alias("kind"), "h", "c", "low", "high"))
        .unionByName(hot.join(hot_twice, ["h", "c"], "left_semi").select("block", F.lit(3).alias("kind"), "h", "c", none.alias("low"), none.alias("high")))
        .unionByName(asked.where("hot").select("block", F.lit(4).alias("kind"), "h", "c", none.alias("low"), none.alias("high")))
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{x} {kinds[x]}" for x in inner), "n_bytes long, n_removed long, n_spans long, result string"])
    done = by_block.cogroup(found.groupBy("block")).applyInArrow(_cut(length, inner, digest), schema)
    return done.select(*(F.col(y).alias(x) for x, y in zip(names, inner, strict=True)), "n_bytes", "n_removed", "n_spans", F.col("result").alias(added[-1]))


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, keep=["doc_id"], digest=True)
