"""Main text of web pages: a tag scanner cuts blocks, and a suffix array of each host decides which of their words are boilerplate.

1. The scanner gives each block of a page a region: `out` (head, scripts, styles, menus, headers, footers, asides, forms, notices, adverts
   and comments, known by tag, role, class or id, and lists of links only), `main` (inside an article or main element) or `open`. Markup
   only takes `out` blocks off; all others are for the array to decide.
2. The token streams of a host's distinct pages, all blocks of them, are joined, with an end mark of its own after each, into one text
   whose suffix array is built by prefix doubling. Neighbouring suffixes that share `RUN` tokens form intervals, and an interval's
   suffixes start in a number of distinct pages. A token of an `open` block goes if it lies in a string of `RUN` tokens or more that
   starts in `OPEN_PAGES` distinct pages and `OPEN_SHARE` of the host's; inside `main`, where articles may quote one another, that takes
   `MAIN_PAGES` pages and `MAIN_SHARE` of them, and a page most of whose main words repeat is a copy, not boilerplate, and keeps them.
3. What is left of each block is a line.

A host of over `SHARD_BYTES` of pages is dealt into shards of about that size by its pages' token streams, so that a host with a third of all pages
spreads over all tasks. Each shard is an array of its own, but shares are those of the host: a string that a share of the host's pages holds is held by that share of
some shard's pages, so every array names the strings that may go, the pages of all shards that hold them are counted and added up by host, and what
reaches the host's share comes back to each shard. Where shards hold few pages (under `MANY` on average), the arrays' strings are added up without being named first.
The results are those of one array for each host, whatever `SHARD_BYTES` is. Only cut texts are shuffled, once; no page's markup is.

Defined results: null and empty pages give an empty text; a null url is a host of its own; very long pages are read whole, in linear time;
pages with the same words count as one page; equal shares are enough (ties are boilerplate); an empty table gives an empty result; other columns pass, whatever
their names, but for one named as the result.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentis.llm.common import materialize, powers, small_batches, strings

RUN = 8
OPEN_PAGES, OPEN_SHARE = 2, 0.02
MAIN_PAGES, MAIN_SHARE = 4, 0.5
SHARD_BYTES = 4 << 20
#: Pages of a shard from which its array's own shares say what may go.
MANY = 256
#: Hosts of several shards are broadcast up to so many, and joined by a shuffle beyond.
BROADCAST_HOSTS = 100_000

#: Fixed names of HTML: elements without content, elements whose content is no text, elements that end a block, and regions.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
OUT_TAGS = frozenset("head nav footer aside form button dialog menu label fieldset header".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar note".split())
#: What a class or id is called that is no main text: the whole name, its last word, or its first word before a word for a container.
OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer sidebar header "
    "cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments "
    "disqus reply replies respond widget toolbar pagination pager masthead disclaimer copyright toc".split()
)
CONTAINERS = frozenset("area bar block body box button buttons container content footer form header inner item items links list notice panel region row section slot thread title unit wrap wrapper zone".split())
MAIN_NAMES = frozenset("article articlebody content maincontent entry post postbody story".split())
#: Elements that a new block element ends, when they are open.
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["tr", "td", "th"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")


def named_out(name: str) -> bool:
    """Whether a class or id names what is no main text: `reader-comments`, `cookie-bar`, `share`; not `comments-open` or `share-price-table`."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return bool(words) and (words[-1] in OUT_NAMES or (words[0] in OUT_NAMES and len(words) > 1 and words[-1] in CONTAINERS))


def region_of(tag: str, attributes: str, around: str) -> str:
    """Region of an element in a region: out stays out, and main stays main for its parts that aren't out."""
    if around == "out" or tag in OUT_TAGS:
        return "out"
    found = "main" if tag in ("article", "main") else around
    out = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "out"
        if name == "role":
            if value.lower() in OUT_ROLES:
                return "out"
            if value.lower() in ("main", "article"):
                found = "main"
        elif name in ("class", "id") and tag not in ("html", "body"):
            names = value.split()
            if tag in ("div", "section") and {w.replace("-", "").replace("_", "").lower() for w in names} & MAIN_NAMES:
                found = "main"
            elif any(map(named_out, names)):
                out = True
        elif name == "itemprop" and value.lower() == "articlebody":
            found = "main"
    return "out" if out else found


class Open:
    """The open elements of a page, with the places of each tag and of the blocks, so that no end tag looks through all of them."""

    def __init__(self):
        self.stack: list[tuple[str, str]] = []
        self.of: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, around: str) -> None:
        self.of.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, around))

    def cut(self, place: int) -> str:
        """Close all elements from a place on; gives the region around the first of them."""
        around = self.stack[place][1]
        while len(self.stack) > place:
            tag, _ = self.stack.pop()
            self.of[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
        return around


def blocks(page: str) -> list[tuple[str, str]]:
    """Region and text of each block with text, in page order."""
    out: list[tuple[str, str]] = []
    opened = Open()
    region, parts, at = "open", [], 0
    lists: list[list[int]] = []  # first block, characters, and characters in links of each open list
    linked = characters = 0

    def close() -> None:
        nonlocal linked, characters
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append((region, text))
                if lists:
                    lists[-1][1] += characters
                    lists[-1][2] += linked
            parts.clear()
        linked = characters = 0

    def end_lists(place: int) -> None:
        """Close the lists whose elements close; one of links only is a menu."""
        while lists and lists[-1][3] >= place:
            first, n, in_links, _, items = lists.pop()
            if items > 1 and n and in_links == n:
                out[first:] = [("out", t) for _, t in out[first:]]

    while True:
        at_tag = page.find("<", at)
        if at_tag < 0 or page.find(">", at_tag) < 0 and not page.startswith(("<!", "<?"), at_tag):
            break
        m = _TOKEN.search(page, at_tag)
        if not m:
            break
        if m.start() > at:
            own = page[at : m.start()]
            parts.append(own)
            n = len(own) - own.count(" ") - own.count("\n")
            characters += n
            if opened.of.get("a"):
                linked += n
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in BLOCKS:
                close()
            places = opened.of.get(tag)
            # The end of an inline element doesn't reach over the blocks that are open within it.
            if places and (tag in BLOCKS or not opened.blocks or opened.blocks[-1] < places[-1]):
                place = places[-1]
                if opened.stack[place][1] != region:
                    close()
                end_lists(place)
                region = opened.cut(place)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                # Nothing within is markup: on to the end tag, or to the page's end where there is none.
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            close()
        if tag in VOID:
            continue
        if tag in CLOSES and opened.blocks and opened.stack[opened.blocks[-1]][0] in CLOSES[tag]:
            end_lists(opened.blocks[-1])
            region = opened.cut(opened.blocks[-1])
        inner = region_of(tag, m[3], region)
        if inner != region and tag not in BLOCKS:
            close()
        if tag in ("ul", "ol"):
            lists.append([len(out), 0, 0, len(opened.stack), 0])
        elif tag == "li" and lists:
            lists[-1][4] += 1
        opened.push(tag, region)
        region = inner
    if at < len(page):
        parts.append(page[at:])
        characters += len(page) - at
    close()
    end_lists(0)
    return out


def host_of(url):
    """The host of a url column; the whole text of one without, and empty for null."""
    found = F.regexp_extract(url, "^[^:/]*://([^/?#]*)", 1)
    return F.lower(F.coalesce(F.when(found != "", found), url, F.lit("")))


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's suffixes in the order of their first `depth` symbols at least, and the number of the interval each lies in:
    those of one interval share so many symbols. By prefix doubling."""
    rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        reach = min(step, depth - step)
        if reach <= 0:
            break
        after = np.zeros_like(rank)
        after[:-reach] = rank[reach:] + 1
        key = rank * (len(rank) + 2) + after
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        step += reach
    order = np.argsort(rank, kind="stable")
    return order, rank[order]


def joined(streams: list[tuple[int, ...]], marks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The streams in one text, each with an end mark from `marks` on; of each place its stream and whether `RUN` tokens start there; where each stream begins."""
    size = np.array([len(x) + 1 for x in streams])
    begin = np.cumsum(size) - size
    text = np.empty(size.sum(), np.int64)
    owner = np.repeat(np.arange(len(streams)), size)
    for k, (x, a) in enumerate(zip(streams, begin.tolist(), strict=True)):
        text[a : a + len(x)] = x
        text[a + len(x)] = marks + k
    left = np.repeat(begin + size - 1, size) - np.arange(len(text))
    return text, owner, left >= RUN, begin


def repeats(text: np.ndarray, owner: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """In how many streams of a joined text the string of `RUN` tokens from each place starts (0 where an end comes before)."""
    order, interval = suffix_array(text, RUN)
    n = int(owner[-1]) + 1
    pairs = np.unique(interval * n + owner[order])
    pages = np.bincount(pairs // n)
    times = np.empty(len(text), np.int64)
    times[order] = pages[interval]
    return np.where(whole, times, 0)


def hashed(text: np.ndarray, ids: dict[str, int]) -> np.ndarray:
    """128 bits for the string of `RUN` tokens from each place, the same in every shard, as two columns."""
    own = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest() for w in ids)
    tokens = np.concatenate([np.frombuffer(own, "<u8").reshape(-1, 2), np.zeros((1, 2), np.uint64)])[np.minimum(text, len(ids))]
    out = np.zeros_like(tokens)
    for k, factor in enumerate(powers(RUN)[0]):
        out[: len(out) - k] += tokens[k:] * factor
    return out.view(np.int64)


def different(strings: np.ndarray) -> np.ndarray:
    """Each row once, in order."""
    rows = strings[np.lexsort((strings[:, 1], strings[:, 0]))]
    return rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))] if len(rows) else rows


def places(strings: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each row stands among ordered different ones; -1 where it doesn't."""
    out = np.full(len(strings), -1)
    if len(among):
        first = np.searchsorted(among[:, 0], strings[:, 0])
        for step in range(int(np.unique(among[:, 0], return_counts=True)[1].max())):
            at = np.minimum(first + step, len(among) - 1)
            same = (among[at] == strings).all(axis=1)
            out[same] = at[same]
    return out


def spread(starts: np.ndarray) -> np.ndarray:
    """Places within `RUN` tokens from any start."""
    delta = np.zeros(len(starts) + RUN, np.int64)
    delta[: len(starts)] += starts
    delta[RUN : RUN + len(starts)] -= starts
    return np.cumsum(delta)[: len(starts)] > 0


def tokens_of(pages: list[list[tuple[str, str]]]) -> tuple[list, dict[str, int], dict[tuple[int, ...], int], list[int]]:
    """The words of pages' blocks, their numbers, the distinct streams of numbers, and which of them is each page's."""
    ids: dict[str, int] = {}
    words = [[(r, t.split(" ")) for r, t in page] for page in pages]
    streams = [tuple(ids.setdefault(w, len(ids)) for _, line in page for w in line) for page in words]
    distinct: dict[tuple[int, ...], int] = {}
    return words, ids, distinct, [distinct.setdefault(x, len(distinct)) for x in streams]


def may_go(pages: list[list[tuple[str, str]]]) -> np.ndarray:
    """Strings that reach the least share in a shard's own array: all that reach a share of the host, in one shard at least."""
    _, ids, distinct, _ = tokens_of(pages)
    text, owner, whole, _ = joined(list(distinct), len(ids))
    return different(hashed(text, ids)[repeats(text, owner, whole) >= max(1, int(OPEN_SHARE * len(distinct)))])


def counted(pages: list[list[tuple[str, str]]], sought: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The strings of a shard's array, only the sought ones where some are given, and how many of its distinct pages hold each."""
    _, ids, distinct, _ = tokens_of(pages)
    text, owner, whole, _ = joined(list(distinct), len(ids))
    strings = hashed(text, ids)
    if sought is None:
        found = different(strings[whole])
        times = np.zeros(len(found), np.int64)
        times[places(strings[whole], found)] = repeats(text, owner, whole)[whole]
        return found, times
    at = np.where(whole, places(strings, sought), -1)
    pairs = np.unique(at[at >= 0] * len(distinct) + owner[at >= 0])
    times = np.bincount(pairs // max(len(distinct), 1), minlength=len(sought))
    return sought[times > 0], times[times > 0]


def decide(pages: list[list[tuple[str, str]]], gone: tuple[np.ndarray, np.ndarray] | None = None) -> list[str]:
    """The texts of a host's pages, given as blocks; of a shard's, where the host's strings that go are given, and for each whether it goes inside `main`."""
    words, ids, distinct, which = tokens_of(pages)
    if not ids:
        return [""] * len(pages)
    text, owner, whole, begin = joined(list(distinct), len(ids))
    if gone is None:
        times = repeats(text, owner, whole)
        n = len(distinct)
        open_gone = spread(times >= max(OPEN_PAGES, math.ceil(OPEN_SHARE * n)))
        main_gone = spread(times >= max(MAIN_PAGES, math.ceil(MAIN_SHARE * n)))
    else:
        at = np.where(whole, places(hashed(text, ids), gone[0]), -1)
        open_gone, main_gone = spread(at >= 0), spread(np.append(gone[1], False)[at])
    texts = []
    for page, k in zip(words, which, strict=True):
        at, starts, inside, taken = int(begin[k]), [], 0, 0
        for region, line in page:
            starts.append(at)
            if region == "main":
                inside += len(line)
                taken += int(main_gone[at : at + len(line)].sum())
            at += len(line)
        copy = 2 * taken > inside
        lines = []
        for (region, line), a in zip(page, starts, strict=True):
            if region == "out":
                continue
            gone = open_gone if region == "open" else main_gone
            if region == "open" or not copy:
                line = [w for w, x in zip(line, gone[a : a + len(line)].tolist(), strict=True) if not x]
            if line:
                lines.append(" ".join(line))
        texts.append("\n".join(lines))
    return texts


_REGIONS = ("out", "main", "open")


def extract(pages: DataFrame, html: str = "html", url: str = "url", into: str = "text") -> DataFrame:
    """pages without html, with the main text of each as last column."""
    small_batches(pages.sparkSession, 256)
    names = [x for x in pages.columns if x not in (html, into)]
    inner = [f"_k{i}" for i in range(len(names))]
    own = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"), *(F.col(f"`{x}`").alias(y) for x, y in zip(names, inner, strict=True)))
    sizes = own.groupBy("host").agg(F.sum(F.length("html")).alias("size"), F.count("*").alias("rows")).where(F.col("size") > SHARD_BYTES)
    sizes = sizes.withColumn("shards", F.ceil(F.col("size") / SHARD_BYTES)).select(F.col("host").alias("big"), "shards", (F.col("rows") >= MANY * F.col("shards")).alias("many"))
    sizes = materialize(sizes)
    n_big = sizes.limit(BROADCAST_HOSTS + 1).count()
    if n_big <= BROADCAST_HOSTS:
        sizes = F.broadcast(sizes)
    dealt = own.join(sizes, F.col("host") == F.col("big"), "left").select("host", "shards", "many", "html", *inner) if n_big else own.select("host", F.lit(None).cast("long").alias("shards"), F.lit(None).cast("boolean").alias("many"), "html", *inner)
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields[4:])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(x) for x in strings(batch.column(3))]
            # Pages with the same words are in one shard.
            keys = [hashlib.blake2b(" ".join(t for _, t in page).encode("utf-8", "surrogatepass"), digest_size=16).digest() for page in found]
            parts = pa.array([int.from_bytes(x[:8], "little") % (n or 1) for x, n in zip(keys, batch.column(1).to_pylist(), strict=True)], pa.int64())
            regions = pa.array([[_REGIONS.index(r) for r, _ in page] for page in found], pa.list_(pa.int8()))
            texts = pa.array([[t for _, t in page] for page in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), parts, regions, texts, *batch.columns[1:3], pa.array(keys, pa.binary()), *batch.columns[4:]], [*heads, *inner])

    heads = ["host", "part", "regions", "texts", "shards", "many", "key"]
    schema = f"host string, part long, regions array<byte>, texts array<string>, shards long, many boolean, key binary{kept}"
    result = f"{kept[2:]}, found string" if kept else "found string"
    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            found = decide([page for b in held for page in read(b)])
            at = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns[len(heads) :], pa.array(found[at : at + b.num_rows], pa.string())], [*inner, "found"])
                at += b.num_rows

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a < b:
                    if keys[a] != key and held:
                        yield from flush()
                        held = []
                    key = keys[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    whole = dealt.where("shards IS NULL").mapInArrow(scanned, schema)
    judged = whole.repartition("host", "part").sortWithinPartitions("host", "part").mapInArrow(decided, result)
    if n_big:
        cut = dealt.where("shards IS NOT NULL").mapInArrow(scanned, schema).repartition("host", "part")
        judged = judged.unionByName(_of_shards(cut, inner, result, n_big))
    return judged.select(*(F.col(y).alias(x) for x, y in zip(names, inner, strict=True)), F.col("found").alias(into))


def read(rows: pa.RecordBatch | pa.Table) -> list[list[tuple[str, str]]]:
    """Scanned pages as blocks."""
    return [[(_REGIONS[r], t) for r, t in zip(rs, ts, strict=True)] for rs, ts in zip(rows.column("regions").to_pylist(), rows.column("texts").to_pylist(), strict=True)]


def _of_shards(cut: DataFrame, inner: list[str], result: str, n_big: int) -> DataFrame:
    """Texts of the pages of hosts of several shards; all steps read the one shuffle of cut."""

    def told(pages: pa.Table, found: np.ndarray, **more: np.ndarray) -> pa.Table:
        """Strings with their host."""
        one = lambda x, kind: pa.array([pages.column(x)[0].as_py()] * len(found), kind)
        return pa.table({"host": one("host", pa.string()), "shards": one("shards", pa.int64()), "a": found[:, 0], "b": found[:, 1], **more})

    def pairs(rows: pa.Table) -> np.ndarray:
        return np.stack([rows.column(x).to_numpy() for x in "ab"], axis=1).astype(np.int64)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pages with the same words are in one partition.
        seen = {x for b in batches for x in zip(b.column(0).to_pylist(), b.column(6).to_pylist(), strict=True)}
        times = Counter(host for host, _ in seen)
        yield pa.RecordBatch.from_arrays([pa.array(times.keys(), pa.string()), pa.array(times.values(), pa.int64())], ["host", "n"])

    def named(pages: pa.Table) -> pa.Table:
        return told(pages, may_go(read(pages)) if pages.column("many")[0].as_py() else np.empty((0, 2), np.int64))

    def added(pages: pa.Table, sought: pa.Table) -> pa.Table:
        if not pages.num_rows:
            return pa.table({"host": pa.array([], pa.string()), **{x: pa.array([], pa.int64()) for x in ("shards", "a", "b", "c")}})
        found, times = counted(read(pages), different(pairs(sought)) if pages.column("many")[0].as_py() else None)
        return told(pages, found, c=times)

    def judge(pages: pa.Table, gone: pa.Table) -> pa.Table:
        strings = pairs(gone)
        order = np.lexsort((strings[:, 1], strings[:, 0]))
        found = decide(read(pages), (strings[order], np.array(gone.column("main").to_pylist(), bool)[order]))
        return pa.table([*(pages.column(x) for x in inner), pa.array(found, pa.string())], [*inner, "found"])

    shard = lambda rows: rows.groupBy("host", "part")
    each = lambda rows: shard(rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))))
    n = cut.mapInArrow(sized, "host string, n long").groupBy("host").agg(F.sum("n").alias("n"))
    likely = shard(cut).applyInArrow(named, "host string, shards long, a long, b long").distinct()
    counts = shard(cut).cogroup(each(likely)).applyInArrow(added, "host string, shards long, a long, b long, c long")
    totals = counts.groupBy("host", "shards", "a", "b").agg(F.sum("c").alias("c")).where(F.col("c") >= OPEN_PAGES)
    reached = lambda pages, share: F.col("c") >= F.greatest(F.lit(pages), F.ceil(F.lit(share) * F.col("n")))
    gone = totals.join(F.broadcast(n) if n_big <= BROADCAST_HOSTS else n, "host").where(reached(OPEN_PAGES, OPEN_SHARE))
    gone = gone.select("host", "shards", "a", "b", reached(MAIN_PAGES, MAIN_SHARE).alias("main"))
    return shard(cut).cogroup(each(gone)).applyInArrow(judge, result)


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
