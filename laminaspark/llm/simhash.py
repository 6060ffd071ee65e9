"""SimHash near-dedup by anchor-point covering."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaspark.llm.common import LOWER, UPPER, components, contracted, join_hot, over_batches, read, slices, staged, stars

WORDS, SEED, THRESHOLD = 4, 42, 4
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the XXH64 hashes (seed 42) of the word shingles, repeats
    included. Fewer words than a shingle: the whole sequence is the one shingle. No words: 0."""
    return _fingerprint(text.encode().translate(_LOWER), words)


def _fingerprint(text: bytes, words: int) -> int:
    found = _WORD.findall(text)
    if not found:
        return 0
    buffer = memoryview(b" ".join(found))
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    if len(found) <= words:
        return xxhash.xxh64_intdigest(buffer, SEED)
    starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(buffer[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), dtype=np.uint64, count=len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, digest: bool = False) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; null text counts as empty. digest: text_sha256 too."""

    def start():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp, sha = [], []
            for part in slices(batch, "text"):
                texts = [(t or "").encode().translate(_LOWER) for t in part.column("text").to_pylist()]
                fp += [_fingerprint(t, words) for t in texts]
                sha += [hashlib.sha256(t).hexdigest() for t in texts] if digest else []
            columns = {"doc_id": batch.column("doc_id"), "fp": np.array(fp, dtype=np.uint64).view(np.int64)} | ({"text_sha256": sha} if digest else {})
            return pa.RecordBatch.from_pydict(columns)

        return f

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), start, "doc_id long, fp long" + ", text_sha256 string" * digest)


class Covering:
    """A covering code of one block of bits: the perfect Hamming code of 15 bits (covering radius 1) times all words of the
    other bits. Anchors are its codewords. Each block word lies within the radius of one anchor, its home; `copies` gives
    every anchor within radius + threshold, the home first, as masks by syndrome: an anchor is the word XOR a mask."""

    RADIUS, N = 1, 15

    def __init__(self, first: int, bits: int, threshold: int, second: tuple[int, int] = (0, 0)):
        """Of `bits` bits from `first` on and, if given, those of a second block behind them."""
        self.first, self.own, self.second, self.threshold = first, bits, second, threshold
        self.bits = bits = bits + second[1]
        near: dict[int, list[tuple[int, int]]] = {s: [] for s in range(16)}  # syndrome: (mask, how far beyond the radius)
        for weight in range(self.RADIUS + threshold + 1):
            for at in itertools.combinations(range(self.N), weight):
                syndrome, mask = 0, 0
                for k in at:
                    syndrome, mask = syndrome ^ (k + 1), mask | 1 << k
                near[syndrome].append((mask, max(0, weight - self.RADIUS)))
        free = [(sum(1 << k for k in at), len(at)) for n in range(threshold + 1) for at in itertools.combinations(range(self.N, bits), n)]
        rows = [sorted({(e + n, m | f) for m, e in near[s] for f, n in free if e + n <= threshold}) for s in range(16)]
        self.masks = np.full((16, max(map(len, rows))), -1, dtype=np.int64)
        for s, row in enumerate(rows):
            self.masks[s, : len(row)] = [m for _, m in row]
        words = np.arange(1 << self.N)
        self.syndrome = np.zeros(1 << self.N, dtype=np.int64)
        for k in range(self.N):
            self.syndrome ^= np.where(words >> k & 1, k + 1, 0)

    def word(self, fp: np.ndarray) -> np.ndarray:
        first = (fp >> np.uint64(self.first)).astype(np.uint64) & np.uint64((1 << self.own) - 1)
        at, bits = self.second
        return first | ((fp >> np.uint64(at)) & np.uint64((1 << bits) - 1)) << np.uint64(self.own) if bits else first

    def copies(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors (a row a fingerprint, the home in column 0) and which of them are there."""
        word = self.word(fp).astype(np.int64)
        masks = self.masks[self.syndrome[word & ((1 << self.N) - 1)]]
        return word[:, None] ^ np.maximum(masks, 0), masks >= 0

    def cost(self, distinct: int) -> tuple[float, float]:
        """Copies of a fingerprint, and fingerprints that it is compared with, on average over evenly spread ones."""
        copies = float((self.masks >= 0).sum(axis=1).mean())
        return copies, distinct * copies / (1 << self.bits - 4)


#: Comparisons that cost as much as one copy of a fingerprint, which is made, sent and sorted.
WORTH = 500


def covers(distinct: int, threshold: int = THRESHOLD) -> list[Covering]:
    """Blocks of the 64 bits such that fingerprints which differ in `threshold` bits or fewer differ in few bits of some block.
    Three blocks of 21 or 22 bits: in one at most a third of them. Five blocks by pairs, of 25 or 26 bits: in the two least of
    them at most two fifths. Two blocks of 32 bits: in one at most half. Any choice finds the same links; the one is taken
    whose copies and comparisons cost least for this number of fingerprints."""
    three, five = (21, 21, 22), (13, 13, 13, 13, 12)
    at = [sum(five[:k]) for k in range(5)]
    plans = [
        [Covering(sum(three[:k]), n, threshold // 3) for k, n in enumerate(three)],
        [Covering(at[i], five[i], 2 * threshold // 5, (at[j], five[j])) for i, j in itertools.combinations(range(5), 2)],
        [Covering(k, 32, threshold // 2) for k in (0, 32)],
    ]
    return min(plans, key=lambda blocks: sum(copies + compared / WORTH for copies, compared in (b.cost(distinct) for b in blocks)))


#: Fingerprints compared at once inside an anchor.
CHUNK = 2048


class Forest:
    """Disjoint sets over positions 0..n-1; keeps the links that joined two sets."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.root(x), self.root(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                self.links.append((x, y))


def compare(cell: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links between homes and all fingerprints of the same cell (rows sorted by cell): a spanning forest of each cell, at
    most as many links as rows, never all pairs. Small cells are expanded together; large ones compared chunk by chunk."""
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(cell)]]))
    a, b = [], []
    small = sizes <= 64
    per = np.repeat(np.arange(len(starts)), sizes)
    mine = np.flatnonzero(home & small[per])
    for at in range(0, len(mine), 50_000):
        h = mine[at : at + 50_000]
        n = sizes[per[h]]
        left = np.repeat(h, n)
        right = np.repeat(starts[per[h]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        near = (np.bitwise_count(fp[left] ^ fp[right]) <= threshold) & (fp[left] != fp[right])
        a.append(left[near])
        b.append(right[near])
    if a:
        x, y = np.concatenate(a), np.concatenate(b)
        used = np.unique(np.concatenate([x, y]))
        forest = Forest(len(used))
        forest.join(np.searchsorted(used, x), np.searchsorted(used, y))
        links = np.array(forest.links, dtype=np.int64).reshape(-1, 2)
        a, b = [used[links[:, 0]]], [used[links[:, 1]]]
    for k in np.flatnonzero(~small):
        lo, hi = starts[k], starts[k] + sizes[k]
        inside, forest = np.flatnonzero(home[lo:hi]), Forest(hi - lo)
        here = fp[lo:hi]
        for i in range(0, len(inside), CHUNK):
            for j in range(0, hi - lo, CHUNK):
                x, y = np.nonzero(np.bitwise_count(here[inside[i : i + CHUNK], None] ^ here[None, j : j + CHUNK]) <= threshold)
                forest.join(inside[i : i + CHUNK][x], y + j)
        links = np.array(forest.links, dtype=np.int64).reshape(-1, 2)
        a.append(lo + links[:, 0])
        b.append(lo + links[:, 1])
    if not a:
        return fp[:0], fp[:0]
    x, y = fp[np.concatenate(a)], fp[np.concatenate(b)]
    unlike = x != y
    return x[unlike], y[unlike]


#: Copies that a cell may hold before it is dealt into parts, and its comparisons into tiles of part by part.
CELL = 20_000
#: Large cells up to which their list is a literal of the plan; more are joined.
FEW = 500


def links(distinct: DataFrame, count: int, threshold: int = THRESHOLD, cover: Sequence[Covering] | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect the same fingerprints as all pairs within the
    threshold do. Every fingerprint goes to each anchor within covering radius plus threshold; those at their home anchor
    are compared with all that came. Cells whose copies exceed CELL are dealt into parts: tile (i, j) compares
    the homes of part i with the copies of part j, so a task holds two parts of a cell at most, whatever its size."""
    blocks = cover or covers(count, threshold)

    def start():
        def f(batch: pa.RecordBatch) -> pa.Table:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            out = []
            for k, block in enumerate(blocks):
                for at in range(0, len(fp), 4096):
                    part = fp[at : at + 4096]
                    anchors, there = block.copies(part)
                    home = np.zeros_like(there)
                    home[:, 0] = True
                    rows = np.broadcast_to(part[:, None], there.shape)[there]
                    out.append(pa.table({"cell": (anchors[there] << 4) | k, "fp": rows.view(np.int64), "home": home[there]}))
            return pa.concat_tables(out)

        return f

    copies = over_batches(distinct.select("fp"), start, "cell long, fp long, home boolean")
    sizes = copies.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).select("cell", F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
    hot = sizes.limit(FEW + 1).collect() if count > CELL // 15 else []
    if hot:
        if len(hot) <= FEW:
            parts = F.coalesce(F.create_map(*(F.lit(x) for kv in hot for x in kv))[F.col("cell")], F.lit(1))
            copies = copies.withColumn("parts", parts)
        else:
            copies = copies.join(sizes, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own, every = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("long"), F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)
        column = F.transform(every, lambda i: F.struct((i * F.col("parts") + F.col("own")).alias("tile"), (F.col("home") & (i == F.col("own"))).alias("home")))
        row = F.transform(F.filter(every, lambda j: F.col("home") & (j != F.col("own"))), lambda j: F.struct((F.col("own") * F.col("parts") + j).alias("tile"), F.lit(True).alias("home")))
        copies = copies.withColumn("own", own).select("cell", "fp", F.explode(F.concat(column, row)).alias("to")).select("cell", "fp", "to.tile", "to.home")
    else:
        copies = copies.withColumn("tile", F.lit(0).cast("long"))

    def near(batches):
        held: list[np.ndarray] | None = None  # the last cell may go on in the next batch

        def send(cols):
            a, b = compare(cols[0], cols[1].view(np.uint64), cols[2], threshold)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a.view(np.int64), b.view(np.int64))), pa.array(np.maximum(a.view(np.int64), b.view(np.int64)))], names=["a", "b"])

        for batch in batches:
            cols = [batch.column("key").to_numpy(), batch.column("fp").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            cut = np.searchsorted(cols[0], cols[0][-1])
            held = [c[cut:] for c in cols]
            if cut:
                yield from send([c[:cut] for c in cols])
        if held is not None:
            yield from send(held)

    key = F.shiftleft("cell", 27).bitwiseOR(F.col("tile"))  # 36 bits of cell, 27 of tile
    dealt = copies.select(key.alias("key"), "fp", "home").repartition("key").sortWithinPartitions("key")
    return contracted(dealt.mapInArrow(lambda batches: stars(near(batches)), "a long, b long"))


def near_components(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fp, component_id) of rows (doc_id, fp): fingerprints within the threshold are linked, component_id is the
    smallest doc_id that can be reached, itself included. Equal fingerprints are first reduced to one."""
    prints = staged(prints)
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    count = distinct.count()
    joined = components(links(distinct, count, threshold))
    of = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    small = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = join_hot(of, small, "component", count).select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row. Null texts count as empty; empty texts have fingerprint zero and
    are linked like any other. Null ids are passed over when the smallest is chosen. Repeated rows repeat; other columns
    aren't read; an empty table gives no rows."""
    out = near_components(fingerprints(docs, words), threshold)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, text_sha256) of one row of each group of near copies: the smallest doc_id, of rows that share it the smallest
    digest (SHA-256 of the text with A-Z lower-cased). An aggregate with partial minima, so that a group may hold any share."""
    rows = staged(fingerprints(docs, words, digest=True))
    distinct = staged(rows.groupBy("fp").agg(F.min(F.struct("doc_id", "text_sha256")).alias("least")))
    joined = components(links(distinct, distinct.count(), threshold))
    of = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("least", F.coalesce("component", "fp").alias("component"))
    return of.groupBy("component").agg(F.min("least").alias("least")).select("least.doc_id", "least.text_sha256")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"))
