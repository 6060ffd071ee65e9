"""Exact dedup through a cuckoo-filter index of live digests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaspark.llm.common import ascii_lower, identified, marked, read, staged, without

SLOTS, KICKS = 4, 200
#: Live digests that a task holds before it hands on what it has (map side only; a later index merges it).
LIVE = 200_000
#: Bytes of content that it holds before it does so.
HELD = 32 << 20
#: Digests that a merging task is dealt at most, on average.
MERGED = 400_000
_MIX = 0x9E3779B97F4A7C15


class CuckooFilter:
    """Partial-key cuckoo hashing (Fan et al. 2014): a 16-bit tag of each digest in one of two buckets of four slots.
    Supports deletion. `insert` tells whether there was room; the caller grows it from its stored keys."""

    def __init__(self, buckets: int = 1024):
        self.mask = buckets - 1
        if buckets & self.mask:
            raise ValueError("buckets must be a power of two")
        self.rows: list[list[int]] = [[] for _ in range(buckets)]
        self.homeless: int | None = None

    def at(self, digest: bytes) -> tuple[int, int, int]:
        tag = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return tag, first, self.other(first, tag)

    def other(self, bucket: int, tag: int) -> int:
        return bucket ^ ((tag * _MIX >> 20) & self.mask)

    def __contains__(self, digest: bytes) -> bool:
        tag, a, b = self.at(digest)
        return tag in self.rows[a] or tag in self.rows[b]

    def insert(self, digest: bytes) -> bool:
        tag, a, b = self.at(digest)
        for bucket in (a, b):
            if len(self.rows[bucket]) < SLOTS:
                self.rows[bucket].append(tag)
                return True
        bucket = a
        for k in range(KICKS):
            row = self.rows[bucket]
            row[k % SLOTS], tag = tag, row[k % SLOTS]
            bucket = self.other(bucket, tag)
            if len(self.rows[bucket]) < SLOTS:
                self.rows[bucket].append(tag)
                return True
        return False  # a tag is out: the filter must be built anew

    def delete(self, digest: bytes) -> bool:
        tag, a, b = self.at(digest)
        for bucket in (a, b):
            if tag in self.rows[bucket]:
                self.rows[bucket].remove(tag)
                return True
        return False


class LiveIndex:
    """Live texts by digest, with the row that each keeps. The cuckoo filter answers first: a digest that it doesn't hold is new,
    and nothing stored is looked at. A hit is verified against the contents in the digest's bucket, so that unlike texts of
    one digest stay apart. Rows that a larger one supersedes are retired; live digests that go on are deleted from the filter,
    which is built anew, twice as large, from the stored keys when it overflows."""

    def __init__(self, buckets: int = 1024):
        self.filter, self.live, self.size, self.resized = CuckooFilter(buckets), 0, 0, 0
        self.probes = self.verified = 0  # how often the filter let through to the bucket, and how often the content was there
        self.stored: dict[int, dict[bytes, dict[bytes, tuple]]] = {}  # bucket, digest, content: row
        self.recurred: set[tuple[bytes, bytes]] = set()

    @staticmethod
    def bucket(digest: bytes) -> int:
        return int.from_bytes(digest[10:12], "little")

    def find(self, digest: bytes, content: bytes = b"") -> tuple | None:
        if digest not in self.filter:
            return None
        self.probes += 1
        row = self.stored.get(self.bucket(digest), {}).get(digest, {}).get(content)
        self.verified += row is not None
        return row

    def insert(self, digest: bytes, row: tuple, content: bytes = b"") -> None:
        contents = self.stored.setdefault(self.bucket(digest), {}).setdefault(digest, {})
        first = not contents
        contents[content] = row
        self.live, self.size = self.live + 1, self.size + len(content)
        if first and not self.filter.insert(digest):
            self.grow()

    def delete(self, digest: bytes, content: bytes = b"") -> tuple | None:
        """Takes a live text out; its digest leaves the filter with the last of its texts."""
        if self.find(digest, content) is None:
            return None
        bucket = self.stored[self.bucket(digest)]
        row = bucket[digest].pop(content)
        if not bucket[digest]:
            del bucket[digest]
            self.filter.delete(digest)
        self.live, self.size = self.live - 1, self.size - len(content)
        return row

    def grow(self) -> None:
        """Two digests of equal tag and buckets may fill both; then the next size parts them or, past eight a pair, never
        would: beyond 2 ** 16 buckets the bucket index takes fresh bits, so growing always ends."""
        buckets = 2 * (self.filter.mask + 1)
        while True:
            self.filter, self.resized = CuckooFilter(buckets), self.resized + 1
            if all(self.filter.insert(d) for rows in self.stored.values() for d in rows):
                return
            buckets *= 2

    def add(self, digest: bytes, keep: tuple, size: int, content: bytes = b"") -> None:
        """A row (or a group of them) of this text: the larger `keep` lives on and retires its predecessor."""
        if (old := self.find(digest, content)) is None:
            self.insert(digest, (keep, size), content)
            return
        self.recurred.add((digest, content))
        self.stored[self.bucket(digest)][digest][content] = (max(keep, old[0]), size + old[1])

    def rows(self):
        return ((d, c, *row) for rows in self.stored.values() for d, contents in rows.items() for c, row in contents.items())

    def retire(self) -> list[tuple]:
        """Deletes and gives the texts that didn't recur since the last call (all of them if all did), so that hot ones stay."""
        cold = [r for r in self.rows() if r[:2] not in self.recurred] or list(self.rows())
        for digest, content, *_ in cold:
            self.delete(digest, content)
        self.recurred.clear()
        return cold


_GROUPS = "digest binary, content binary, keep_id long, keep_row long, group_size long"
_NONE = -(1 << 63)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    digest, content, keep, size = zip(*rows, strict=True)
    ids = [None if k[0] == _NONE else k[0] for k in keep]
    return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(content, pa.binary()), pa.array(ids, pa.int64()), pa.array([k[1] for k in keep], pa.int64()), pa.array(size, pa.int64())], names=["digest", "content", "keep_id", "keep_row", "group_size"])


def _through_index(rows: DataFrame, most: int | None, by_digest: bool = False) -> DataFrame:
    """Groups (digest, content, keep_id, keep_row, group_size) of each partition's rows (digest, content, doc_id, row, n). most:
    hand on texts that don't recur when as many are held, or HELD bytes of them (partial groups); None holds what the shuffle
    deals to the partition. by_digest: rows come sorted, and a digest's groups go on when the next one begins."""

    def run(batches):
        index, last = LiveIndex(), None
        for batch in batches:
            out: list[tuple] = []
            for digest, content, doc_id, row, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if by_digest and digest != last:
                    out += index.retire()
                    last = digest
                index.add(digest, (_NONE if doc_id is None else doc_id, row), size, content or b"")
                if most and (index.live >= most or index.size >= HELD):
                    out += index.retire()
            if out:
                yield _batch(out)
        if index.live:
            yield _batch(list(index.rows()))

    return rows.mapInArrow(run, _GROUPS)


def groups(rows: DataFrame) -> DataFrame:
    """Groups by digest (digest, keep_id, keep_row, group_size) over all rows (digest, doc_id, row), which should be staged: they
    are counted first. Each input partition first reduces its own rows, so that a digest which a third of all rows share
    crosses the network once a partition; then one index per hash partition merges them."""
    partial = _through_index(rows.select("digest", F.lit(None).cast("binary").alias("content"), "doc_id", "row", F.lit(1).cast("long").alias("n")), LIVE)
    parts = rows.count() // MERGED + 1  # above the session's number of partitions only where tables are large
    named = parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _through_index(partial.repartition(parts, "digest") if named else partial.repartition("digest"), None).drop("content")


def by_content(rows: DataFrame) -> DataFrame:
    """Groups by digest and content (digest, content, keep_id, keep_row, group_size, contents: how many the digest has) of rows
    (digest, content, doc_id, row, n): each partition's first, then all of a digest in turn."""
    partial = _through_index(rows, LIVE)
    merged = _through_index(partial.repartition("digest").sortWithinPartitions("digest"), None, by_digest=True)
    named = staged(merged)
    several = named.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
    return named.join(several.select("digest"), "digest", "left_semi")


def decide(docs: DataFrame, normalise=ascii_lower, digest=None) -> DataFrame:
    """(row, doc_id, keep_id, keep_row, group_size, sha) of every row of `identified` documents. digest: of the normalised text as
    12 bytes or more, SHA-256 if not given; whatever it is, only equal texts are one group.

    Digests go through the index as small staged rows. Texts are read again, and move, only for rows whose digest another row
    has too; the index verifies them by content. Where a digest proves to have several contents, its rows meet by these."""
    content = normalise(F.col("_d.text"))
    sha = F.unhex(F.sha2(content, 256))
    rows = staged(docs.select(F.col("_d.doc_id").cast("long").alias("doc_id"), F.col("_row").alias("row"), (digest(content) if digest else sha).alias("digest"), *([sha.alias("sha")] if digest else [])))
    rows = rows if digest else rows.withColumn("sha", F.col("digest"))
    found = staged(groups(rows))
    hits = staged(rows.join(found.where("group_size > 1").select("digest"), "digest", "left_semi").select("row", "doc_id", "digest"))
    asked = marked(docs, "_row", hits.select("row")).select(F.col("_row").alias("row"), content.cast("binary").alias("content")).join(hits, "row").select("digest", "content", "doc_id", "row", F.lit(1).cast("long").alias("n"))
    collided = staged(by_content(asked))
    columns = ["row", "doc_id", "keep_id", "keep_row", "group_size", "sha"]
    if collided.isEmpty():
        return rows.join(found, "digest").select(*columns)  # a hot digest's rows are split by AQE; the other side has one row a digest
    apart = collided.select("digest").distinct()
    plain = rows.join(apart, "digest", "left_anti").join(found, "digest")
    return plain.select(*columns).unionByName(asked.join(collided, ["digest", "content"]).join(rows.select("row", "sha"), "row").select(*columns))


def exact_dedup(docs: DataFrame, normalise=ascii_lower, digest=None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row, the dropped ones too.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id stays
    (null ids are the smallest; of rows that repeat a doc_id and its text one stays, the largest by place in the files).
    Other columns aren't read; an empty table gives no rows."""
    made = decide(identified(docs.select("doc_id", "text")), normalise, digest)
    return made.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose rows stay, with their own columns. Texts that recur alone cross the network."""
    tagged = identified(docs)
    return without(tagged, decide(tagged).where("row <> keep_row").select("row"))


def keep_kept(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The documents that decisions (doc_id, kept, text_sha256) keep, with their own columns. Where a table repeats doc_id and
    text together, the first of the repeated rows by place in the files."""
    tagged = identified(docs)
    key = F.sha2(ascii_lower(F.col("_d.text")), 256)
    rows = staged(tagged.select(F.col("_d.doc_id").cast("long").alias("i"), key.alias("k"), F.col("_row").alias("row")))
    stay = decisions.where("kept").select(F.col("doc_id").alias("s"), F.col("text_sha256").alias("h"))
    first = rows.join(stay, F.col("i").eqNullSafe(F.col("s")) & (F.col("k") == F.col("h")), "left_semi").groupBy("i", "k").agg(F.min("row").alias("stays"))
    return without(tagged, rows.join(first.select("stays"), F.col("row") == F.col("stays"), "left_anti").select("row"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
WINDOW g AS (PARTITION BY h)
"""
