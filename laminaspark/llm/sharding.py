"""Sharding by k-d tree partitioning: distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaspark.llm.common import ranked, read, staged

SHARDS = 8
#: Bits of the split key that one pass over the staged rows settles; passes a key takes.
STEP, PASSES = 13, 4
#: A boundary moves to the edge of a group of equal texts if that costs at most this share of a shard's bytes.
SNAP = 0.002
DIMENSIONS = ("d_size", "d_chars", "d_lang")


def metadata(docs: DataFrame) -> DataFrame:
    """One small row a document: size, crc, group (a hash of the text), and coordinates from 0 to 2^20 - 1: the logarithms
    of size and of code points, and the language by its first letters. Equal texts have equal coordinates in the first two.
    tie: a hash of doc_id and place, so that any group can be cut, of equal or null ids too; it must be staged before use."""
    body = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(body) + 1).cast("long")
    scale = float(1 << 20) - 1

    def log_scaled(c: Column) -> Column:
        return F.least(F.floor(F.log2(c.cast("double")) / 40 * scale), F.lit(scale)).cast("long")

    letters = F.rpad(F.coalesce("lang", F.lit("")), 2, " ") if "lang" in docs.columns else F.lit("  ")
    lang = F.least(F.ascii(letters) * 256 + F.ascii(F.substring(letters, 2, 1)), F.lit(65535)) * 16
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(body), 32).alias("group"),
        log_scaled(size).alias("d_size"),
        log_scaled(F.char_length(body) + 1).alias("d_chars"),
        lang.cast("long").alias("d_lang"),
        F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.monotonically_increasing_id(), F.lit(11)), 12).alias("tie"),
    )


def _order_key(dimension: str) -> Column:
    """52 bits: the coordinate, then the text's group, so that equal texts lie together and ties have an order."""
    return F.shiftleft(F.col(dimension), 32).bitwiseOR(F.col("group"))


def _cut(rows: DataFrame, key: Column, base: dict[int, int], target: dict[int, float]) -> dict[int, tuple[int, int, int]]:
    """For each node the least key at which the bytes up to and including it exceed the node's target, with the bytes below
    it and at it. `base` gives nothing but the nodes. Each pass sums bytes by the next STEP bits of the key below the prefix
    found so far: at most 2 ** STEP sums a node reach the driver, whatever the number of rows."""
    prefix, below = dict.fromkeys(base, 0), dict.fromkeys(base, 0)
    at: dict[int, int] = {}
    for k in range(PASSES):
        low = STEP * (PASSES - 1 - k)
        cases = F.coalesce(F.create_map(*(F.lit(x).cast("long") for kv in prefix.items() for x in kv))[F.col("node").cast("long")], F.lit(-1).cast("long"))
        part = F.shiftrightunsigned(key, low)
        inside = rows.where(F.shiftrightunsigned(key, low + STEP) == cases) if k else rows.where(cases >= 0)
        sums = inside.groupBy("node", part.alias("bits")).agg(F.sum("size").alias("n")).orderBy("node", "bits").collect()
        for node in base:
            mine, run, found = [(r["bits"], r["n"]) for r in sums if r["node"] == node], below[node], None
            for bits, n in mine:
                found = (bits, run, n)
                if run + n > target[node]:
                    break
                run += n
            if found:
                prefix[node], below[node], at[node] = found
    return {node: (prefix[node], below[node], at[node]) for node in base if node in at}


def kd_tree(rows: DataFrame, shards: int = SHARDS, target_bytes: int | None = None) -> tuple[DataFrame, int]:
    """Adds `node`, the leaf of each staged row (0..leaves-1), and tells the number of leaves: `shards`, or as many as bring
    every leaf to target_bytes or less.

    Level by level, every node with more than one shard to give is cut along its widest dimension (range of coordinates,
    as a share of the whole table's range) where its bytes divide as its shards do. The cut falls between two groups of equal texts if that stays within SNAP of a
    shard's bytes; otherwise, as for a group larger than that, inside the group, by a hash of doc_id and place. All nodes of a level
    share their passes, and the driver holds the tree alone."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    leaves = shards if target_bytes is None else max(1, -(-total // target_bytes))
    nodes, done = {0: leaves}, rows.withColumn("node", F.lit(0).cast("long"))
    whole: dict[str, int] = {}
    while max(nodes.values()) > 1:
        ranges = done.groupBy("node").agg(F.sum("size").alias("n"), *(f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max))).collect()
        widest, target, bytes_of = {}, {}, {}
        if not ranges:
            break
        whole = whole or {d: max(1, ranges[0][f"max_{d}"] - ranges[0][f"min_{d}"]) for d in DIMENSIONS}
        for r in ranges:
            if nodes[r["node"]] > 1:
                widest[r["node"]] = max(DIMENSIONS, key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"]) / whole[d])
                target[r["node"]] = r["n"] * (nodes[r["node"]] // 2) / nodes[r["node"]]
                bytes_of[r["node"]] = r["n"] / nodes[r["node"]]
        if not widest:
            break
        key = F.coalesce(*(F.when(F.col("node") == n, _order_key(d)) for n, d in widest.items()), F.lit(0).cast("long"))
        cuts = _cut(done, key, widest, target)
        inside: dict[int, int] = {}  # nodes that are cut inside a group
        limit: dict[int, int] = {}  # rows below this key go left
        for node, (at, below, n) in cuts.items():
            room = SNAP * bytes_of[node]
            near = min((abs(below - target[node]), at), (abs(below + n - target[node]), at + 1))
            if near[0] <= room:
                limit[node] = near[1]
            else:
                limit[node], inside[node] = at, at
        left = key < F.coalesce(*(F.when(F.col("node") == n, F.lit(x).cast("long")) for n, x in limit.items()))
        if inside:
            equal = key == F.coalesce(*(F.when(F.col("node") == n, F.lit(x).cast("long")) for n, x in inside.items()), F.lit(-1).cast("long"))
            ties = _cut(done.where(equal), F.col("tie"), inside, {n: target[n] - cuts[n][1] for n in inside})
            ends = {n: at + (abs(below + size - (target[n] - cuts[n][1])) < abs(below - (target[n] - cuts[n][1]))) for n, (at, below, size) in ties.items()}
            left = left | (equal & (F.col("tie") < F.coalesce(*(F.when(F.col("node") == n, F.lit(x).cast("long")) for n, x in ends.items()), F.lit(0).cast("long"))))
        split = F.col("node").isin(list(limit))
        done = staged(done.withColumn("node", F.when(split, F.col("node") * 2 + F.when(left, 0).otherwise(1)).otherwise(F.col("node") * 2)))
        nodes = {m: k for n, s in nodes.items() for m, k in (((2 * n, s // 2), (2 * n + 1, s - s // 2)) if n in limit else ((2 * n, s),))}
    order = {n: k for k, n in enumerate(sorted(nodes))}
    leaf = F.create_map(*(F.lit(x).cast("long") for kv in order.items() for x in kv))[F.col("node")]
    return done.withColumn("node", leaf), len(order)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): every document in one of `shards` shards whose bytes are
    near equal (law `bytes`; another number of shards may move rows, so grown_shard is null); slot numbers each shard's
    rows gaplessly from 0.

    DataFrame functions only. The text is read once, for size, checksum and group; all passes go over staged small rows.
    Null text counts as empty (size 1), null ids tie, repeated rows repeat, other columns aren't read; an empty table gives
    no rows."""
    rows = staged(metadata(docs))
    tree, _ = kd_tree(rows, shards)
    sharded = staged(tree.select("doc_id", "size", "text_crc32", "tie", F.col("node").cast("int").alias("shard")))
    out = ranked(sharded, ["shard"], ["tie", "doc_id", "text_crc32"], "slot", sharded.count())
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))
