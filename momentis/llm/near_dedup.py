"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A document is the bag of its five-word shingles (lower case), each weighing its count times its inverse document frequency in the scale-free form
1 + ln(N / n) / ln N: 2 for a shingle of one of N documents, 1 for one of all, the same at every corpus size. Frequencies are counted over
all documents in 2**18 hash buckets, so that their table has a fixed size (1 MB).

1. Copies: documents with the same words collapse into one, by a 128-bit hash.
2. Sampling: 40 consistent weighted samples per text (Ioffe's improved scheme: a sample is the shingle and its quantised weight
   that minimise ln a), in ten bands of four; texts whose weighted Jaccard similarity is 0.8 share a band with probability 0.995.
3. Candidates: in each band bucket every text meets the bucket's first text. Pairs are verified on the whole bags. Texts that fail
   stay in the bucket for the next round with a new first text; after `ROUNDS` rounds at most, each bucket is settled: its texts are dealt into
   blocks of `LEADER_GROUP`, and every two blocks are compared in a task of their own, each text against every text of another class.
4. Classes: connected components of verified pairs, by alternating large and small stars over distributed tables.
5. Links past the first text: one minus the similarity is a metric, so a text that failed at distance d of a first text can only
   resemble a text that followed it at d - (1 - `SIMILARITY`) or more. Those are compared too, in blocks of `BLOCK` by `BLOCK` texts,
   where their classes still differ. So no link between texts that share a bucket is lost, and no table holds pairs of all members.

The number of jobs is bounded whatever a bucket holds. A bucket of m texts that are all unlike one another costs m * m comparisons within
its tasks, as any exact comparison does.

Defined results: a text of one to four words is one shingle; null and wordless texts are classes of their own, one per row; very long texts are
read whole; repeated rows are copies; of a class the row numbered first is kept or stands for it; ids may be null or repeated; an empty table
gives an empty result; other columns pass, whatever their names, but for those that are added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentis.llm.common import materialize, mixed, numbered, powers, prefix_sums, release, small_batches

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 4
BUCKET_BITS = 18
LEADER_GROUP = 1000
BLOCK = 256
#: Allows for rounding where distances bound one another.
SLACK = 1e-6
#: Rounds with one first text for each bucket before the rest is settled in blocks.
ROUNDS = 3
#: Consistent samples draw their random numbers from tables of this many entries, indexed by hash.
_DRAW_BITS = 14

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingles(text: str) -> tuple[np.ndarray, bytes]:
    """Sorted 64-bit shingle hashes of a text, repeated as they occur, and a hash of its words; none for a wordless text."""
    x = np.frombuffer(text.lower().encode(), np.uint8)
    blank = _SPACE[x]
    edge = np.flatnonzero(np.diff(np.concatenate([[1], blank.view(np.int8), [1]])))
    if not len(edge):
        return np.zeros(0, np.uint64), b""
    start, stop = edge[::2], edge[1::2]
    sums = prefix_sums(x.astype(np.uint64) + np.uint64(1))
    words = mixed((sums[stop] - sums[start]) * powers(len(sums))[1][start] + (stop - start).astype(np.uint64))
    n = max(1, len(words) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(words))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    h = mixed(h)
    h.sort()
    return h, hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def bag(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights, from the sorted upper halves of the hashes."""
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    times = np.diff(np.append(first, len(h)))
    distinct = h[first]
    return distinct, times * idf[distinct >> np.uint32(32 - BUCKET_BITS)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    least = np.minimum(a[1][same], b[1][at[same]]).sum()
    return float(least / (a[1].sum() + b[1].sum() - least))


def inverse_frequencies(counts: np.ndarray, documents: int) -> np.ndarray:
    """Weight of each bucket from its documents; what a bucket holds above the middle one counts as a shingle's own frequency."""
    own = np.maximum(counts - np.median(counts), 1.0)
    return (1.0 + np.log(max(documents, 2) / np.minimum(own, documents or 1)) / np.log(max(documents, 2))).astype(np.float32)


_tables: list[np.ndarray] = []
_SALTS = np.random.default_rng(7).integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _draws() -> list[np.ndarray]:
    """r ~ Gamma(2, 1), ln c with c ~ Gamma(2, 1), and beta ~ U(0, 1)."""
    if not _tables:
        u = 1.0 - np.random.default_rng(20170821).random((5, 1 << _DRAW_BITS))
        _tables.extend(x.astype(np.float32) for x in (-np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]))
    return _tables


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each bag, a hash per band of the consistent weighted samples in it."""
    r_of, c_of, beta_of = _draws()
    size = np.array([len(h) for h, _ in bags])
    start = np.cumsum(size) - size
    h = np.concatenate([h for h, _ in bags])
    log_weight = np.log(np.concatenate([w for _, w in bags])).astype(np.float32)
    samples = np.empty((len(bags), BANDS * ROWS), np.uint64)
    for k, salt in enumerate(_SALTS):
        at = h * salt
        at ^= at >> np.uint32(15)
        at *= np.uint32(0x2C1B3C6D)
        # Three numbers from places of their own: two shingles share all of them once in 2**32 only.
        r, beta = r_of[at >> np.uint32(32 - _DRAW_BITS)], beta_of[(at * np.uint32(0x9E3779B1)) >> np.uint32(32 - _DRAW_BITS)]
        level = np.floor(log_weight / r + beta)
        a = c_of[(at >> np.uint32(2)) & np.uint32((1 << _DRAW_BITS) - 1)] - r * (level - beta + np.float32(1))
        least = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, start), size))
        best = least[np.searchsorted(least, start)]
        samples[:, k] = mixed((h[best].astype(np.uint64) << np.uint64(32)) ^ (level[best].astype(np.int64) & 0xFFFF).astype(np.uint64))
    bands = np.zeros((len(bags), BANDS), np.uint64)
    for k in range(ROWS):
        bands = mixed(bands * np.uint64(31) + samples[:, k * BANDS : (k + 1) * BANDS])
    return mixed(bands + np.arange(BANDS, dtype=np.uint64))


def upper(h: np.ndarray) -> np.ndarray:
    """The upper halves of sorted hashes: enough to compare two texts, in half the space."""
    return (h >> np.uint64(32)).astype(np.uint32)


_PART = 1024


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per bucket of a partition, in rows of 1024 neighbouring buckets, and the number of documents as row -1."""
    counts, documents = np.zeros(1 << BUCKET_BITS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            h, _ = shingles(text.as_py() or "")
            if len(h):
                documents += 1
                distinct = h[np.concatenate([[True], h[1:] != h[:-1]])]
                np.add.at(counts, (distinct >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
    if documents:
        rows = counts.reshape(-1, _PART)
        at = np.flatnonzero(rows.any(axis=1))
        packed = [rows[i].tobytes() for i in at] + [np.array([documents]).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int64()), pa.array(packed, pa.binary())], ["part", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each part; a task holds one sum of 8 KB for each of its parts."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(counts.as_py(), np.int64)
            sums[part] = sums[part] + x if part in sums else x
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """The weight of each shingle bucket, from all documents; 2**18 numbers at any input size."""
    partial = texts.select("text").mapInArrow(_frequencies, "part long, counts binary")
    rows = dict(partial.repartition("part").mapInArrow(_added, "part long, counts binary").collect())
    documents = int(np.frombuffer(rows.pop(-1), np.int64)[0]) if rows else 0
    counts = np.zeros((1 << BUCKET_BITS) // _PART * _PART).reshape(-1, _PART)
    for part, packed in rows.items():
        counts[part] = np.frombuffer(packed, np.int64)
    return inverse_frequencies(counts.ravel(), documents)


def _sampled(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = idf.value, set()
        for batch in batches:
            keys, bands, bags, fresh, waiting = [], [None] * batch.num_rows, [], [], 0
            for i, text in enumerate(batch.column(1)):
                h, key = shingles(text.as_py() or "")
                keys.append(key or None)
                if key and key not in known:
                    known.add(key)
                    fresh.append(i)
                    bags.append(bag(upper(h), weights))
                    waiting += len(h)
                if fresh and (waiting > 30_000 or i == batch.num_rows - 1):
                    for k, found in zip(fresh, signatures(bags).view(np.int64).tolist(), strict=True):
                        bands[k] = found
                    bags, fresh, waiting = [], [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["uid", "words", "bands"])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [upper(shingles(t.as_py() or "")[0]).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.binary())], ["uid", "bag"])


def _compared(idf):
    """Similarity of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        last, left = None, None
        for batch in batches:
            found = []
            for u, a, b in zip(batch.column("u").to_pylist(), batch.column("bag_u"), batch.column("bag_v"), strict=True):
                if u != last:
                    last, left = u, bag(np.frombuffer(a.as_py(), np.uint32), weights)
                found.append(similarity(left, bag(np.frombuffer(b.as_py(), np.uint32), weights)))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(found, pa.float64())], ["u", "v", "s"])

    return run


def _crossed(idf):
    def run(followed: pa.Table, failed: pa.Table) -> pa.Table:
        """A link for each class of texts that failed in which one resembles a text that followed."""
        weights = idf.value
        u, v, done = [], [], set()
        if followed.num_rows and failed.num_rows:
            order = followed.sort_by([("d", "descending")])
            far = order.column("d").to_numpy()
            uids = order.column("uid").to_pylist()
            bags = [bag(np.frombuffer(x.as_py(), np.uint32), weights) for x in order.column("bag")]
            totals = np.array([w.sum() for _, w in bags])
            for uid, d, top, x in zip(failed.column("uid").to_pylist(), failed.column("d").to_pylist(), failed.column("top").to_pylist(), failed.column("bag"), strict=True):
                if top in done:
                    continue
                own = bag(np.frombuffer(x.as_py(), np.uint32), weights)
                total = own[1].sum()
                near = (far >= d - (1.0 - SIMILARITY) - SLACK) & (np.minimum(totals, total) >= (SIMILARITY - SLACK) * np.maximum(totals, total))
                k = next((k for k in np.flatnonzero(near).tolist() if similarity(bags[k], own) >= SIMILARITY), None)
                if k is not None:
                    u.append(uids[k])
                    v.append(uid)
                    done.add(top)
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _led(idf):
    def run(rest: pa.Table) -> pa.Table:
        """Links that join each text to all classes it resembles; a class's texts stand by their distance from its first text."""
        weights = idf.value
        groups: list[list[tuple[int, tuple, float]]] = []
        u, v = [], []
        order = rest.sort_by("uid")
        for uid, x in zip(order.column("uid").to_pylist(), order.column("bag"), strict=True):
            own = bag(np.frombuffer(x.as_py(), np.uint32), weights)
            joined = None
            for members in groups:
                first = 1.0 - similarity(members[0][1], own)
                near = members[0][0] if first <= 1.0 - SIMILARITY else None
                if near is None:
                    # Only a text this far from the first one can be near; those of other groups are compared even where a chain joins them.
                    near = next((k for k, other, d in members[1:] if d >= first - (1.0 - SIMILARITY) - SLACK and similarity(other, own) >= SIMILARITY), None)
                if near is not None:
                    u.append(near)
                    v.append(uid)
                    if joined is None:
                        joined = members, first
            if joined is None:
                groups.append([(uid, own, 0.0)])
            else:
                joined[0].append((uid, own, joined[1]))
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _blocks_met(idf):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Links between the texts of two blocks of a bucket, as many as join all classes that have one."""
        weights = idf.value
        sides = []
        for side in (left, right):
            uid, own = side.column_names[-2:]
            order = side.sort_by(uid)
            bags = [bag(np.frombuffer(x.as_py(), np.uint32), weights) for x in order.column(own)]
            sides.append((order.column(uid).to_pylist(), bags, np.array([w.sum() for _, w in bags])))
        (uids, bags, totals), (others, other_bags, _) = sides
        top = {}

        def find(x):
            while top.get(x, x) != x:
                x = top[x]
            return x

        u, v = [], []
        for uid, own in zip(others, other_bags, strict=True):
            total = own[1].sum()
            near = np.minimum(totals, total) >= (SIMILARITY - SLACK) * np.maximum(totals, total)
            for k in np.flatnonzero(near).tolist():
                if (a := find(uids[k])) != (b := find(uid)) and similarity(bags[k], own) >= SIMILARITY:
                    top[a] = b
                    u.append(uids[k])
                    v.append(uid)
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _settled(rest: DataFrame, bags: DataFrame, idf) -> DataFrame:
    """Links within the buckets of rows (key, uid, members): block by block, each two blocks of a bucket in a task of their own."""
    blocks = F.ceil(F.col("members") / LEADER_GROUP)
    dealt = rest.select("key", "uid", blocks.alias("blocks"), F.pmod(F.xxhash64("uid"), blocks).alias("own"))
    within = dealt.join(bags, "uid").select("key", "own", "uid", "bag").groupBy("key", "own").applyInArrow(_led(idf), "u long, v long")
    many = dealt.where("blocks > 1")
    each = lambda low, high: F.explode(F.sequence(low, high))
    left = many.where("own < blocks - 1").select("key", "uid", F.col("own").alias("a"), each(F.col("own") + 1, F.col("blocks") - 1).alias("b"))
    right = many.where("own > 0").select("key", "uid", each(F.lit(0).cast("long"), F.col("own") - 1).alias("a"), F.col("own").alias("b"))
    left, right = (x.join(bags, "uid").select("key", "a", "b", "uid", "bag") for x in (left, right))
    right = right.select(*(F.col(x).alias(f"right_{x}") for x in right.columns))
    across = left.groupBy("key", "a", "b").cogroup(right.groupBy("right_key", "right_a", "right_b")).applyInArrow(_blocks_met(idf), "u long, v long")
    return within.union(across).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): rows (uid, root) of all but the roots, by alternating large and small stars."""
    edges = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct())
    while not _stars(edges):
        both = materialize(edges.union(edges.select("v", "u")), [edges])
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").distinct(), [both, least])
        down = materialize(large.groupBy("v").agg(F.min("u").alias("m")))
        small = large.join(down, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).union(down.select("m", "v"))
        edges = materialize(small.where("u < v").distinct(), [large, down])
    return edges.select(F.col("v").alias("uid"), F.col("u").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether each v hangs on one u, and no u on another."""
    hung = edges.groupBy("v").agg(F.count("*").alias("n"))
    if not hung.where("n > 1").isEmpty():
        return False
    return edges.select("u").distinct().join(hung.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def near_duplicates(docs: DataFrame, text: str = "text", into: tuple[str, str] = ("class_id", "class_first")) -> DataFrame:
    """The input's columns with a class number (the same for all rows of a class) and whether the row stands for its class, under the names `into`."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    names = [x for x in docs.columns if x not in into]
    inner = [f"_k{i}" for i in range(len(names))]
    rows = numbered(docs.select(*(F.col(f"`{x}`").alias(y) for x, y in zip(names, inner, strict=True))), "uid")
    roots = classes(rows.select("uid", F.col(inner[names.index(text)]).alias("text")))
    out = rows.join(roots, "uid", "left").withColumn("top", F.coalesce("root", "uid"))
    return out.select(*(F.col(y).alias(x) for x, y in zip(names, inner, strict=True)), F.col("top").alias(into[0]), (F.col("top") == F.col("uid")).alias(into[1]))


def keep_first(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that stand first in their class."""
    small_batches(docs.sparkSession, 500)
    names = docs.columns
    inner = [f"_k{i}" for i in range(len(names))]
    rows = numbered(docs.select(*(F.col(f"`{x}`").alias(y) for x, y in zip(names, inner, strict=True))), "uid")
    roots = materialize(classes(rows.select("uid", F.col(inner[names.index(text)]).alias("text"))))
    gone = roots.where("uid <> root").select("uid")
    return rows.join(gone.hint("merge"), "uid", "left_anti").select(*(F.col(y).alias(x) for x, y in zip(names, inner, strict=True)))


def classes(texts: DataFrame) -> DataFrame:
    """(uid, root) of rows (uid, text) whose class has more than themselves; the root is one of them and stands for itself too."""
    spark = texts.sparkSession
    idf = spark.sparkContext.broadcast(document_frequencies(texts))
    sampled = materialize(texts.mapInArrow(_sampled(idf), "uid long, words binary, bands array<long>").where("words is not null"))
    alike = materialize(sampled.groupBy("words").agg(F.min(F.when(F.col("bands").isNotNull(), F.col("uid"))).alias("root"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copies = materialize(sampled.select("uid", "words").join(alike, "words").where("uid <> root").select("uid", "root"))
    apart = sampled.where("bands is not null").join(copies.select("uid"), "uid", "left_anti")
    rest = _crowded(materialize(apart.select("uid", F.explode("bands").alias("key"))))
    release(sampled, alike)

    found: list[DataFrame] = []
    rounds: list[DataFrame] = []
    tables: list[DataFrame] = []
    bags = None
    while not rest.isEmpty():
        if bags is None:
            # One plan at every size: the texts are dealt out by row, whether or not these rows would fit a broadcast.
            bags = materialize(texts.join(rest.select("uid").distinct().hint("merge"), "uid", "left_semi").mapInArrow(_hashed, "uid long, bag binary"))
        else:
            last = len(rounds) == ROUNDS
            found.append(materialize(_settled(rest if last else rest.where(F.col("members") <= LEADER_GROUP), bags, idf)))
            if last:
                break
            rest = rest.where(F.col("members") > LEADER_GROUP)
        met = rest.where("uid <> lead")
        pairs = met.select(F.col("lead").alias("u"), F.col("uid").alias("v")).distinct()
        left = pairs.join(bags.select(F.col("uid").alias("u"), F.col("bag").alias("bag_u")), "u")
        both = left.join(bags.select(F.col("uid").alias("v"), F.col("bag").alias("bag_v")), "v")
        compared = materialize(both.mapInArrow(_compared(idf), "u long, v long, s double"))
        links = compared.where(F.col("s") >= SIMILARITY).select("u", "v")
        found.append(links)
        tables.append(compared)
        rounds.append(compared.where(F.col("s") >= 2 * SIMILARITY - 1 - SLACK))
        failed = met.join(links.select(F.col("u").alias("lead"), F.col("v").alias("uid")), ["lead", "uid"], "left_anti")
        rest = _crowded(materialize(failed.select("uid", "key")))

    alone = copies.select("root", F.col("root").alias("top")).distinct()
    if not found:
        return copies.union(alone.select("root", "top"))
    edges = found[0]
    for more in found[1:]:
        edges = edges.union(more)
    linked = _past_first(components(edges), rounds, bags, idf)
    roots = materialize(linked.union(linked.select("root", F.col("root").alias("top")).distinct()).toDF("member", "top"))
    release(bags, *found, *tables)
    moved = copies.join(roots, F.col("root") == F.col("member"), "left").select("uid", F.coalesce("top", "root").alias("root"))
    own = alone.join(roots, F.col("root") == F.col("member"), "left_anti")
    return moved.union(own).union(roots)


def _past_first(linked: DataFrame, rounds: list[DataFrame], bags: DataFrame, idf) -> DataFrame:
    """Components (uid, root) joined further by the links between texts that followed a first text and texts that failed it.

    All that followed are in the first text's class, so texts that failed are compared only where their own class is another one.
    """
    met = rounds[0]
    for more in rounds[1:]:
        met = met.union(more)
    met = met.select(F.col("u").alias("lead"), F.col("v").alias("uid"), (1 - F.col("s")).alias("d"), (F.col("s") >= SIMILARITY).alias("linked"))
    top = linked.select("uid", F.col("root").alias("top"))
    failed = met.where("not linked").join(top, "uid", "left").join(top.select(F.col("uid").alias("lead"), F.col("top").alias("lead_top")), "lead", "left")
    failed = materialize(failed.select("lead", "uid", "d", F.coalesce("top", "uid").alias("top"), F.coalesce("lead_top", "lead").alias("lead_top")).where("top <> lead_top").drop("lead_top"))
    if failed.isEmpty():
        return linked
    least = failed.groupBy("lead").agg(F.min("d").alias("least"), F.count("*").alias("n_failed"))
    followed = met.where("linked").join(least, "lead").where(F.col("d") >= F.col("least") - (1.0 - SIMILARITY) - SLACK)
    followed = materialize(followed.select("lead", "uid", "d", "n_failed"))
    sizes = materialize(followed.groupBy("lead").agg(F.count("*").alias("n"), F.first("n_failed").alias("n_failed")))
    blocks = sizes.select("lead", F.ceil(F.col("n") / BLOCK).alias("rows"), F.ceil(F.col("n_failed") / BLOCK).alias("columns"))
    part = lambda count: F.pmod(F.xxhash64("uid"), count)
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    left = followed.drop("n_failed").join(blocks, "lead").join(bags.select("uid", F.col("bag").alias("left_bag")), "uid").select("lead", part("rows").alias("row"), each("columns").alias("column"), "uid", "d", F.col("left_bag").alias("bag"))
    right = failed.join(blocks, "lead").join(bags, "uid").select("lead", each("rows").alias("row"), part("columns").alias("column"), "uid", "d", "top", "bag")
    at = ["lead", "row", "column"]
    links = materialize(left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(_crossed(idf), "u long, v long"))
    return linked if links.isEmpty() else components(linked.select(F.col("root").alias("u"), F.col("uid").alias("v")).union(links))


def _crowded(buckets: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several texts, with the bucket's first text and size; buckets is a written table, which goes."""
    many = materialize(buckets.groupBy("key").agg(F.min("uid").alias("lead"), F.count("*").alias("members")).where("members > 1"))
    return materialize(buckets.join(many, "key"), [buckets, many])


def op8_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = materialize(near_duplicates(docs).select("doc_id", "class_id", "class_first"))
    first = found.where("class_first").select(F.col("class_id").alias("class_row"), F.col("doc_id").alias("first_doc"))
    return found.join(first, F.col("class_id") == F.col("class_row")).select("doc_id", F.col("first_doc").alias("class_id"), "class_first")
