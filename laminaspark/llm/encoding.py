"""Byte-level BPE encoding and decoding with recursive DuckDB queries."""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaspark.llm.common import over_batches, read, slices

#: Characters of the words that one query contracts; words after which a task starts a new generation of two (a slice of
#: texts may add its own words to that).
QUERY_CHARS, REMEMBERED = 1 << 17, 350_000

#: A row of run is a token at a byte position of a word. Each step sees the words that the last step changed: among neighbouring
#: tokens that the merge table joins, the least rank, leftmost first, is merged, and the word's rows go on without the one
#: that the merge took. A word without such a pair is done: its rows come out, no longer live. A candidate is one number:
#: rank, position and distance to the next token, the latter two in 23 bits each.
CONTRACT = """
WITH RECURSIVE run(w, p, t, live) AS (
    SELECT w, p, t, true FROM pos
  UNION ALL
    SELECT r.w, r.p, CASE WHEN r.p = here THEN m ELSE t END, here IS NOT NULL FROM run r LEFT JOIN (
        SELECT w, (best >> 46)::INT AS m, ((best >> 23) & 8388607)::INT AS here, (((best >> 23) & 8388607) + (best & 8388607))::INT AS taken FROM (
            SELECT w, min((m::BIGINT << 46) | (p::BIGINT << 23) | (np - p)) AS best
            FROM (SELECT w, p, t, lead(w) OVER o AS nw, lead(t) OVER o AS nt, lead(p) OVER o AS np FROM run WHERE live WINDOW o AS (ORDER BY w, p))
            JOIN merges ON pair = t::BIGINT * 1048576 + nt WHERE nw = w GROUP BY w)) USING (w)
    WHERE live AND r.p IS DISTINCT FROM taken)
SELECT w, p, t FROM run WHERE NOT live
"""
#: The same for long words, with many single steps in one. While the least rank stays the least, the steps would merge its
#: pairs one after the other from the left; so all that don't overlap are merged at once, up to and with the first whose
#: merge makes a neighbouring pair of a lower rank, which would come next. (A token's id is its rank; -1 marks a position
#: that a merge took.)
CONTRACT_LONG = """
WITH RECURSIVE run(w, p, t) USING KEY (w, p) AS (
    SELECT w, p, t FROM pos
  UNION
    SELECT w, unnest([p, np]), unnest([m, -1]) FROM (
        SELECT c.*, min(CASE WHEN a.m < c.m OR b.m < c.m THEN o END) OVER (PARTITION BY w) AS stop FROM (
            SELECT *, CASE WHEN lag(o) OVER (PARTITION BY w ORDER BY o) = o - 2 THEN m ELSE pt END AS lt FROM (
                SELECT *, row_number() OVER (PARTITION BY w, island ORDER BY o) AS k FROM (
                    SELECT *, o - row_number() OVER (PARTITION BY w ORDER BY o) AS island FROM (
                        SELECT x.*, m, min(m) OVER (PARTITION BY w) AS least FROM (
                            SELECT w, p, t, lag(t) OVER q AS pt, lead(t) OVER q AS nt, lead(t, 2) OVER q AS nnt, lead(p) OVER q AS np, row_number() OVER q AS o
                            FROM recurring.run WHERE t >= 0 AND w IN (SELECT w FROM run) WINDOW q AS (PARTITION BY w ORDER BY p)) x
                        JOIN merges ON pair = t::BIGINT * 1048576 + nt)
                    WHERE m = least))
            WHERE k % 2 = 1) c
        LEFT JOIN merges a ON a.pair = lt::BIGINT * 1048576 + c.m LEFT JOIN merges b ON b.pair = c.m::BIGINT * 1048576 + nnt)
    WHERE stop IS NULL OR o <= stop)
SELECT w, p, t FROM run WHERE t >= 0
"""
#: Bytes from which a word counts as long.
LONG = 256
#: Ordered aggregation: a word's ids, and its bytes from the ids alone.
GATHER = "SELECT w, list(t ORDER BY p) AS ids, string_agg(bytes, '' ORDER BY p) AS hex FROM done JOIN vocabulary USING (t) GROUP BY w ORDER BY w"


class Bpe:
    """Encodes words by the ranks of a file and decodes their ids, in DuckDB; remembers frequent words."""

    def __init__(self, ranks: dict[bytes, int]):
        # A query that outgrows its memory spills where Spark's own tasks do; the files go with the connection.
        scratch = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": os.path.join(scratch, f"duckdb-{os.getpid()}-{id(self):x}")})
        self.prefixes = {b[:k] for b in ranks for k in range(1, len(b) + 1)}
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        vocabulary = pa.table({"t": pa.array(ranks.values(), pa.int32()), "bytes": [b.hex() for b in ranks]})
        pairs = [(ranks[b[:i]] * 1048576 + ranks[b[i:]], r) for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        merges = pa.table({"pair": pa.array([p for p, _ in pairs], pa.int64()), "m": pa.array([m for _, m in pairs], pa.int32())})
        for name, table in (("vocabulary", vocabulary), ("merges", merges)):
            self.db.register("given", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        # Ids and decoded bytes by word: of the words since the last turn, and of those before it.
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def contract(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each word (not empty) its ids as little-endian unsigned 32-bit integers, and what they decode to."""
        n = np.array([len(b) for b in words])
        buffer = np.frombuffer(b"".join(words), dtype=np.uint8)
        w = np.repeat(np.arange(len(words), dtype=np.int32), n)
        p = (np.arange(len(buffer)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        step = CONTRACT_LONG if n.max() >= LONG else CONTRACT
        self.db.register("pos", pa.table({"w": w, "p": p, "t": self.byte[buffer]}))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE done AS {step}")
        got = self.db.sql(GATHER).to_arrow_table()
        self.db.unregister("pos")
        ids = got.column("ids").combine_chunks()
        flat, ends = ids.flatten().to_numpy().astype("<u4").tobytes(), ids.offsets.to_numpy()
        return [(flat[4 * a : 4 * b], bytes.fromhex(h)) for a, b, h in zip(ends, ends[1:], got.column("hex").to_pylist(), strict=False)]

    def segments(self, word: bytes) -> list[bytes]:
        """The word cut wherever no token of the vocabulary that occurs in it reaches across. No merge can cross such a place,
        so the parts are encoded alone as they are in the word."""
        prefixes, ranks, reach, out, begin = self.prefixes, self.ranks, 0, [], 0
        for at in range(len(word)):
            if at >= reach and at > begin:
                out.append(word[begin:at])
                begin = at
            end = at + 1
            while end <= len(word) and (piece := word[at:end]) in prefixes:
                if end > reach and piece in ranks:
                    reach = end
                end += 1
        out.append(word[begin:])
        return out

    def know(self, texts: list[list[str]]) -> None:
        """Makes ids and decoded hold all words of these texts: by what is remembered and else by queries of a bounded size."""
        if len(self.ids) > REMEMBERED:
            self.old, self.ids, self.decoded = (self.ids, self.decoded), {}, {}
        new: set[str] = set()
        for words in texts:
            new.update(words)
        new.difference_update(self.ids)
        ids, decoded = self.old
        for w in new.intersection(ids):
            self.ids[w], self.decoded[w] = ids.pop(w), decoded.pop(w)
        new.difference_update(self.ids)
        part, used = [], 0
        for w in sorted(new, key=len):  # words of like length settle in like numbers of steps
            part.append(w)
            used += len(w)
            if used > QUERY_CHARS:
                self.learn(part)
                part, used = [], 0
        if part:
            self.learn(part)

    def learn(self, words: list[str]) -> None:
        """Words of LONG bytes and more by their segments, equal ones once; the others as they are."""
        raw = [w.encode() for w in words]
        parts = {w: self.segments(b) for w, b in zip(words, raw, strict=True) if len(b) >= LONG}
        whole = [b for b in raw if len(b) < LONG]
        known: dict[bytes, tuple[bytes, bytes]] = {}
        part, used = [], 0
        for b in sorted({*whole, *(s for segments in parts.values() for s in segments)}, key=len):
            part.append(b)
            used += len(b)
            if used > QUERY_CHARS:
                known |= zip(part, self.contract(part), strict=True)
                part, used = [], 0
        if part:
            known |= zip(part, self.contract(part), strict=True)
        for w, b in zip(words, raw, strict=True):
            of = [known[s] for s in parts[w]] if w in parts else [known[b]]
            self.ids[w], self.decoded[w] = b"".join(i for i, _ in of), b"".join(d for _, d in of)


def ranks_of(name: str) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, and ids array<int> if asked): every whole text, cut into words by the
    public pattern, encoded by the ranks of the file and decoded again. Nulls count as empty: no tokens, the digests of
    nothing. Rows are independent: repeated rows repeat, other columns aren't read, an empty table gives no rows."""

    def start():
        bpe, pattern = Bpe(ranks_of(vocabulary)), regex.compile(public_tokenizers.PATTERN)

        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [pattern.findall(t) if t else [] for t in batch.column("text").to_pylist()]
            bpe.know(texts)
            out: list[tuple] = []
            for doc_id, words in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = b"".join(map(bpe.ids.__getitem__, words))
                row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"".join(map(bpe.decoded.__getitem__, words))).hexdigest())
                out.append((*row, np.frombuffer(ids, "<u4").astype(np.int32)) if with_ids else row)
            kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), kinds, strict=False)], names=[n for n, _ in kinds[: 4 + with_ids]])

        return lambda batch: pa.Table.from_batches([part(x) for x in slices(batch, "text", 8 << 20)])

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), start, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, keep=True)


def decode(ids: list[int], vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> bytes:
    """The bytes of a list of ids, by ordered aggregation."""
    table = {r: b for b, r in ranks_of(vocabulary).items()}
    db = duckdb.connect(config={"threads": 1})
    db.register("given", pa.table({"p": pa.array(range(len(ids)), pa.int64()), "hex": [table[i].hex() for i in ids]}))
    return bytes.fromhex(db.sql("SELECT string_agg(hex, '' ORDER BY p) FROM given").fetchall()[0][0] or "")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
