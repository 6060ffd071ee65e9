"""Document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaspark.llm.common import read, slices

K, WORDS = 128, 5
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, _BASE | np.uint64(1), dtype=np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes of a text that are hashed at once; each takes some fifty bytes of memory meanwhile.
BLOCK = 1 << 18
_GAP = re.compile(rb"[ \t-\r]")


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word (between ASCII white space, A-Z as a-z), over blocks of the text that end between words."""
    if len(text) <= BLOCK:
        return _hashes_of(text)
    out, at = [], 0
    while at < len(text):
        gap = _GAP.search(text, at + BLOCK)
        end = gap.start() if gap else len(text)
        out.append(_hashes_of(text[at:end]))
        at = end
    return np.concatenate(out)


def _hashes_of(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, dtype=np.uint8)
    inside = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    kept = np.flatnonzero(inside)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(len(kept)) - np.repeat(firsts, lengths)
    powers = _POWERS if place.max(initial=0) < len(_POWERS) else np.cumprod(np.full(int(place.max()) + 1, _BASE | np.uint64(1), dtype=np.uint64))
    return _mix(np.add.reduceat((_FOLD[raw[kept]] + np.uint64(1)) * powers[place], firsts) + lengths.astype(np.uint64))


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Hashes of the word shingles; fewer words than a shingle are one shingle, no words none."""
    w = word_hashes(text.encode())
    n = max(1, len(w) - words + 1) if len(w) else 0
    h = np.zeros(n, dtype=np.uint64)
    for k in range(min(words, len(w))):
        h = (h + w[k : k + n]) * _BASE + np.uint64(k + 1)
    return _mix(h)


def sketch(text: str, k: int = K, words: int = WORDS) -> np.ndarray:
    """The k least distinct shingle hashes, ascending."""
    h = shingle_hashes(text, words)
    if len(h) > 4 * k:  # all that can be among the k least distinct ones, unless few are distinct
        low = np.unique(np.partition(h, 4 * k - 1)[: 4 * k])
        if len(low) >= k:
            return low[:k]
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what a and b were made of."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness: the share of the union's k least hashes that both have. Two empty ones are alike."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    shared = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(shared, both, assume_unique=True).sum() / len(both))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; 1 if a is empty."""
    mine = distinct(a, k)
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / mine) if mine else 1.0


def to_text(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), dtype=">u8").astype(np.uint64)


def merge_all(sketches: pd.Series) -> str:
    """The sketch of all texts together, from sketches of their parts; an aggregate function for `merged`."""
    return to_text(reduce(merge, map(from_text, sketches), np.zeros(0, dtype=np.uint64)))


def merged(prints: DataFrame, key: str, column: str = "fingerprint") -> DataFrame:
    """(key, fingerprint): one sketch a key, merged first inside each partition and then across them, so that a key of any
    size moves one sketch a partition. Null sketches are passed over."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[name] = merge(held.get(name, np.zeros(0, dtype=np.uint64)), from_text(text))
            if len(held) > 20_000:
                yield _keyed(held, kind)
                held = {}
        if held:
            yield _keyed(held, kind)

    named = prints.select(F.col(key).cast("string").alias("key"), F.col(column).alias("fingerprint")).where("fingerprint IS NOT NULL")
    kind = "key string, fingerprint string"
    return named.mapInArrow(run, kind).groupBy("key").agg(F.pandas_udf(merge_all, "string")("fingerprint").alias("fingerprint"))


def _keyed(held: dict, _: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array([to_text(x) for x in held.values()], pa.string())], names=["key", "fingerprint"])


def fingerprint(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, distinct_shingles) of every whole text; null counts as empty. A pure map."""

    def run(batches):
        for batch in batches:
            made = [sketch(t or "", k, words) for part in slices(batch, "text") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([to_text(x) for x in made], pa.string()), pa.array([distinct(x, k) for x in made], pa.float64())], names=["doc_id", "fingerprint", "distinct_shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string, distinct_shingles double")


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points give way to the first as many (or all) of the following text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


#: Rows in a bucket of the order by doc_id, and the most buckets.
BUCKET_ROWS, BUCKETS = 2048, 20_000


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket, extra): partitions sorted by doc_id, one bucket each, so that each row's successor follows it.
    The first row of the next bucket comes once more as the last row of a bucket (extra = 1; after the last bucket the very
    first row). Text moves once. Cuts are quantiles of doc_id; a list of BUCKETS cuts and first rows at most. An id (or null)
    that so many rows share that it is several quantiles has as many buckets, by ranges of the hash of the text, which its
    rows are sorted by; only then the first pass reads texts."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_at"), F.coalesce("text", F.lit("")).alias("text"))
    rows = ids.count()
    n = min(BUCKETS, rows // BUCKET_ROWS + 1)
    cuts = np.sort(np.array(ids.stat.approxQuantile("_at", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else [], dtype=np.int64))
    hot = np.unique(cuts[1:][cuts[1:] == cuts[:-1]]).tolist()
    spread = F.when(F.col("_at").isin(hot), F.xxhash64("text")).otherwise(F.lit(0).cast("long")) if hot else F.lit(0).cast("long")

    @F.pandas_udf("int")
    def bucket(at: pd.Series, spread: pd.Series) -> pd.Series:
        low, high = (np.searchsorted(cuts, at.to_numpy(), side=side) for side in ("left", "right"))
        parts = high - low
        share = np.floor((spread.to_numpy() / 2.0**64 + 0.5) * parts).astype(np.int64)
        return pd.Series(np.where(parts > 1, low + 1 + np.minimum(share, parts - 1), high).astype(np.int32))

    least = F.min(F.struct("_at", "_spread")) if hot else F.struct(F.min("_at").alias("_at"), F.lit(0).cast("long").alias("_spread"))
    firsts = ids.withColumn("_spread", spread).groupBy(bucket("_at", "_spread").alias("bucket")).agg(least.alias("first")).orderBy("bucket").collect()
    give = [(r["first"]["_at"], r["first"]["_spread"], firsts[k - 1]["bucket"]) for k, r in enumerate(firsts)]  # the first row of all goes to the last bucket
    to = spark.createDataFrame(give, "_at long, _spread long, _to int")
    all_rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_at"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_spread", spread)
    dealt = all_rows.withColumn("_own", bucket("_at", "_spread")).join(F.broadcast(to), ["_at", "_spread"], "left")
    here, there = F.struct(F.col("_own").alias("bucket"), F.lit(0).alias("extra")), F.struct(F.col("_to").alias("bucket"), F.lit(1).alias("extra"))
    copies = dealt.withColumn("_c", F.explode(F.when(F.col("_to").isNull(), F.array(here)).otherwise(F.array(here, there))))
    return copies.select("doc_id", "text", F.col("_c.bucket").alias("bucket"), F.col("_c.extra").alias("extra"), "_at").repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions("extra", "_at", F.xxhash64("text")).select("doc_id", "text", "extra")


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edited(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Each document beside its edited text and its successor by doc_id (after the last: the first).

    Null texts count as empty, null ids come first, rows that repeat a doc_id follow each other by a hash of their text; a
    single row is its own successor; an empty table gives no rows; other columns aren't read. The likenesses are estimated
    resemblances of the sketches, 1 for two empty ones."""

    def run(batches):
        last, out = None, []
        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text, extra in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "extra")), strict=True):
                    now = (doc_id, text, sketch(text, k, words), extra)
                    if last is not None and not last[3]:
                        changed = edited(last[1], text)
                        other = sketch(changed, k, words)
                        out.append((last[0], len(last[1]), hashlib.sha256(changed.encode()).hexdigest(), to_text(last[2]), to_text(other), resemblance(last[2], other, k), resemblance(last[2], now[2], k)))
                    last = now
                    if len(out) >= 1000:
                        yield _edited_rows(out)
                        out = []
        if out:
            yield _edited_rows(out)

    return in_order(docs).mapInArrow(run, _EDITED)


def _edited_rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _EDITED.split(", ")])


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edited(read(spark, sf_dir, "documents"))
