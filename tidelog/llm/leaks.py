"""Documents that contain passages of test items, by greedy string tiling.

1. Seeds: every window of `tile` and of `least` words of an item has a running hash. The seeds' bits, a Bloom filter of at
   most FILTER_BITS, travel with the tasks; a document whose windows hit it is reduced to the words of those windows. What
   the reduced documents hit is joined with the seeds by hash, so false hits of the filter go no further. A pair of a
   document and an item is a candidate if it shares a window of `least` words or as many windows of `tile` words as the
   coverage asked for needs at least. All items are looked for in one pass over the documents.
2. Tiles: for a candidate pair the longest match of unmarked words is marked as a tile, again and again, down to `tile`
   words. The longest length that matches is found by halving, the matches by equal running hashes (Karp-Rabin), each
   checked word by word before it is marked.
3. A pair is a leak if its longest tile has `least` words or its tiles cover `covered` of the item's words, in whatever
   order they stand.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tidelog.llm.markup import plain
from tidelog.session import cut

WORD = re.compile(r"[^\W_]+")
LEAST, TILE, COVERED = 12, 5, 0.8
#: The filter has so many bits per seed, as a power of two, but never more than FILTER_BITS (64 MB); with more seeds it lets more through to the join, and nothing is lost.
BITS_PER_SEED, FILTER_BITS = 32, 1 << 29
#: What a worker keeps of earlier lines, words and tilings, and how many words are hashed at once; they change nothing but time and memory.
KEPT_LINES, KEPT_LETTERS, KEPT_WORDS, KEPT_TILINGS = 100_000, 10_000_000, 500_000, 20_000
CHUNK = 400_000
BASE = 0x9E3779B97F4A7C15
ONE, SHIFTS = np.uint64(1), (0, 17, 34)


def words(text: str) -> list[str]:
    """Runs of letters and digits, without regard to case and Unicode form; text without markup."""
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    return WORD.findall(text.casefold())


class Powers:
    """Powers of BASE and of its inverse modulo 2^64, as many as were asked for so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.where(np.arange(size) == 0, ONE, np.uint64(b)), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


POWERS = Powers()


class Running:
    """Hashes of the windows of a sequence of word hashes: prefix sums of a polynomial, so a window of any length takes one subtraction. 0 stands for a gap."""

    def __init__(self, x: np.ndarray) -> None:
        up, self.down = POWERS.upto(len(x) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)], dtype=np.uint64)])
        self.gaps = np.concatenate([[0], np.cumsum(x == 0)])

    def windows(self, n: int, gaps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of each window of n words without a gap."""
        gaps = self.gaps if gaps is None else gaps
        if len(self.sums) <= n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(gaps[n:] == gaps[:-n])
        h = (self.sums[at + n] - self.sums[at]) * self.down[at] + np.uint64(n)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32)), at


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes (0: gap): (start in a, start in b, length) of tiles of at least `least`, longest first (ties: earliest in a, then in b)."""
    ra, rb = Running(a), Running(b)
    mark_a, mark_b = ~np.isin(a, b) | (a == 0), ~np.isin(b, a) | (b == 0)
    out: list[tuple[int, int, int]] = []
    most = min(len(a), len(b))

    def free(mark: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(mark)])

    while most >= least:
        gaps_a, gaps_b = free(mark_a), free(mark_b)
        shared = lambda n: bool(np.isin(ra.windows(n, gaps_a)[0], rb.windows(n, gaps_b)[0]).any())  # noqa: B023, E731
        if not shared(least):
            break
        low = least
        while low < most:  # the longest length that still matches: windows of a match match
            middle = (low + most + 1) // 2
            low, most = (middle, most) if shared(middle) else (low, middle - 1)
        hb, jb = rb.windows(low, gaps_b)
        starts: dict[int, list[int]] = {}
        for h, j in zip(hb.tolist(), jb.tolist(), strict=True):
            starts.setdefault(h, []).append(j)
        next_: dict[int, int] = {}
        free_from = 0
        for h, i in zip(*(x.tolist() for x in ra.windows(low, gaps_a)), strict=True):
            if i < free_from or h not in starts:
                continue
            there, k = starts[h], next_.get(h, 0)
            while k < len(there) and (mark_b[there[k] : there[k] + low].any() or (a[i : i + low] != b[there[k] : there[k] + low]).any()):
                k += 1  # marked once, it stays marked
            next_[h] = k
            if k < len(there):
                j = there[k]
                out.append((i, j, low))
                mark_a[i : i + low] = mark_b[j : j + low] = True
                free_from = i + low
        most = low - 1
    return out


class WordHasher:
    """Hashes of the words of a text, line by line; keeps what it saw. Picklable; the memory is per worker."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.lines: dict[str, np.ndarray] = {}
        self.held = 0

    def __getstate__(self) -> tuple:
        return ()  # None would leave __setstate__ uncalled

    def __setstate__(self, state: tuple) -> None:
        self.__init__()

    def word(self, w: str) -> int:
        h = self.words.get(w)
        if h is None:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            h = self.words[w] = xxhash.xxh3_64_intdigest(w) or 1
        return h

    def line(self, line: str) -> np.ndarray:
        known = self.lines.get(line)
        if known is None:
            get = self.words.get
            known = np.array([get(w) or self.word(w) for w in words(line)], np.uint64)
            if len(line) <= 10_000:
                if len(self.lines) >= KEPT_LINES or self.held > KEPT_LETTERS:
                    self.lines.clear()
                    self.held = 0
                self.lines[line] = known
                self.held += len(line)
        return known

    def __call__(self, text: str | None) -> np.ndarray:
        return np.concatenate([self.line(x) for x in plain(text).split("\n")]) if text else np.zeros(0, np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def item_words(items: DataFrame) -> DataFrame:
    """_item (a number), item_id, words (hashes) of each item; null texts have no words."""
    hasher = WordHasher()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists([hasher(t) for t in b.column(2).to_pylist()])], names=["_item", "item_id", "words"])

    kind = items.schema["item_id"].dataType.simpleString()
    numbered = items.select(F.monotonically_increasing_id().alias("_item"), "item_id", F.col("text").cast("string").alias("text"))
    return numbered.mapInArrow(run, f"_item long, item_id {kind}, words array<long>")


def item_seeds(known: DataFrame, least: int, tile: int) -> DataFrame:
    """seed, _item, n (words of the item), times (windows of `tile` words with that hash), whole (windows of `least`); items shorter than `least` have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [[], [], [], [], []]
            for item, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(w) < least:
                    continue
                r = Running(np.array(w, np.int64).view(np.uint64))
                for n in {tile, least}:
                    h, times = np.unique(r.windows(n)[0], return_counts=True)
                    for c, x in zip(columns, (h.view(np.int64), np.full(len(h), item), np.full(len(h), len(w)), times * (n == tile), times * (n == least)), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64)) for c in columns], names=["seed", "_item", "n", "times", "whole"])

    return known.select("_item", "words").mapInArrow(run, "seed long, _item long, n long, times long, whole long")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """The Bloom filter of the seeds, as words of 64 bits; at most FILTER_BITS bits come to the driver."""
    n = seeds.select(F.approx_count_distinct("seed")).first()[0]
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(10, int(n * BITS_PER_SEED - 1).bit_length()))
    spot = F.explode(F.array(*(F.shiftrightunsigned("seed", s).bitwiseAND(F.lit(bits - 1)) for s in SHIFTS)))
    filled = seeds.select(spot.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    if filled.num_rows:
        out[filled.column("word").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    return out


def hits(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(table) * 64 - 1)
    ok = np.ones(len(h), bool)
    for s in SHIFTS:
        at = (h >> np.uint64(s)) & mask
        ok &= (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & ONE == ONE
    return ok


def reduced(documents: DataFrame, table: np.ndarray, least: int, tile: int) -> DataFrame:
    """doc_id, words, seeds of documents that hit the filter: the words (hashes, 0 between pieces) of windows that do, and the hashes of these windows."""
    hasher = WordHasher()
    shipped = documents.sparkSession.sparkContext.broadcast(table)

    def chunk(texts: list[np.ndarray]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """Number, words and seeds of those of the texts that hit, all hashed at once."""
        size = np.array([len(t) + 1 for t in texts])
        start = np.cumsum(size) - size
        x = np.zeros(int(size.sum()), np.uint64)
        for s, t in zip(start, texts, strict=True):
            x[s : s + len(t)] = t
        r, keep, seeds, at = Running(x), np.zeros(len(x) + 1, np.int64), [], []
        for n in {tile, least}:
            h, where = r.windows(n)
            ok = hits(shipped.value, h)
            seeds.append(h[ok])
            at.append(where[ok])
            np.add.at(keep, where[ok], 1)
            np.add.at(keep, where[ok] + n, -1)
        seeds, at = np.concatenate(seeds), np.concatenate(at)
        kept = np.cumsum(keep)[:-1] > 0
        owner = np.searchsorted(start, at, "right") - 1
        order = np.argsort(owner, kind="stable")
        seeds, owner = seeds[order], owner[order]
        found, docs, hashes = np.unique(owner), [], []
        for k in found.tolist():
            s, e = start[k], start[k] + size[k]
            own = np.where(kept[s:e], x[s:e], 0)
            docs.append(own[(own != 0) | np.concatenate([[False], own[:-1] != 0])])  # one 0 after each piece
            hashes.append(np.unique(seeds[np.searchsorted(owner, k) : np.searchsorted(owner, k, "right")]))
        return found.tolist(), docs, hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, n, first = [], 0, 0
            for i, text in enumerate([*b.column(1).to_pylist(), None]):
                if i < b.num_rows:
                    held.append(hasher(text))
                    n += len(held[-1])
                if held and (n > CHUNK or i == b.num_rows):
                    found, docs, hashes = chunk(held)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([f + first for f in found], pa.int64())), _lists(docs), _lists(hashes)], names=["doc_id", "words", "seeds"])
                    first, held, n = i + 1, [], 0

    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, words array<long>, seeds array<long>")


def tiled(pairs: DataFrame, tile: int) -> DataFrame:
    """doc_id, item_id, longest, coverage, tiles of pairs (doc_id, item_id, doc, item: hashes of their words)."""
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, longest int, coverage double, tiles int"
    known: dict[tuple[bytes, bytes], tuple[int, float, int]] = {}

    def one(doc: np.ndarray, item: np.ndarray) -> tuple[int, float, int]:
        own = np.where(np.isin(doc, item), doc, 0)
        own = own[(own != 0) | np.concatenate([[False], own[:-1] != 0])]  # the same for most revisions of a page
        key = own.tobytes(), item.tobytes()
        if key not in known:
            if len(known) >= KEPT_TILINGS:
                known.clear()
            marked = [n for _, _, n in tiles(own, item, tile)]
            known[key] = max(marked, default=0), sum(marked) / max(len(item), 1), len(marked)
        return known[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(d.values.to_numpy().view(np.uint64), i.values.to_numpy().view(np.uint64)) for d, i in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int32(), pa.float64(), pa.int32())))], names=["doc_id", "item_id", "longest", "coverage", "tiles"])

    return pairs.select("doc_id", "item_id", "doc", "item").mapInArrow(run, schema)


def leaks(documents: DataFrame, items: DataFrame, least: int = LEAST, tile: int = TILE, covered: float = COVERED) -> DataFrame:
    """doc_id, item_id, longest (words of the longest tile), coverage (share of the item's words in tiles of `tile` words or more), tiles: every pair with a tile of `least` words or with `covered`.

    Null and empty texts share nothing; items shorter than `least` words are not looked for. Equal items and equal documents
    are all reported. Tiles that cover c of n words, each of `tile` words or more, hold at least c * n / tile windows of
    `tile` words, so the candidates lose no pair. A seed that many documents share meets few items; the join splits it."""
    known = cut(item_words(items))
    seeds = cut(item_seeds(known, least, tile))
    docs = cut(reduced(documents, seed_filter(seeds), least, tile).withColumn("_doc", F.monotonically_increasing_id()))
    shared = docs.select("_doc", F.explode("seeds").alias("seed")).join(seeds, "seed")
    counts = shared.groupBy("_doc", "_item", "n").agg(F.sum("times").alias("times"), F.sum("whole").alias("whole"))
    pairs = counts.where((F.col("whole") > 0) | (F.col("times") * tile >= F.col("n") * F.lit(covered))).select("_doc", "_item")
    both = pairs.join(docs.select("_doc", "doc_id", F.col("words").alias("doc")), "_doc").join(known.select("_item", "item_id", F.col("words").alias("item")), "_item")
    return tiled(both, tile).where((F.col("longest") >= least) | (F.col("coverage") >= covered))
