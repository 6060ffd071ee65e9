"""Near copies by the Jaccard likeness of their word shingles. SimHash fingerprints of the shingle sets meet in the anchors of a
covering code and are linked by their bits; whole sets are compared inside what they link. Alike sets whose fingerprints
differ in more bits are found by an exact join over prefixes of the sets, which passes over what is linked already."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminaspark.llm import simhash
from laminaspark.llm.common import LOWER, UPPER, components, contracted, identified, join_hot, joining, marked, over_batches, slices, staged, stars, without
from laminaspark.llm.sketches import _mix, shingle_hashes

#: Documents whose shingles are looked at for common ones; how often one must occur there; how many are told apart at most.
SAMPLE, OFTEN, COMMON = 5_000, 5, 100_000
#: Rows that a cell may hold before its comparisons are cut into tiles of two parts.
CELL = 20_000
#: Differing bits of 256 up to which a pair is compared whole. Sets alike to 0.8 differ in 39 bits on average (48 for sets of
#: four and five shingles) with a deviation of 6, so a link is missed with a chance below 1e-9; likenesses under 0.3 end here.
NEAR = 88
#: What finding links by SimHash may cost a fingerprint, in copies; with more fingerprints the reach in bits is less.
COPIES = 400
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_PRINT = ["f0", "f1", "f2", "f3"]


def prefix(n):
    """How many of a set's n shingles, in any order common to all sets, hold one shared with every set that is alike to 0.8."""
    return n - (4 * n + 4) // 5 + 1


def _node(text: bytes) -> int:
    """A hash of the word sequence, as a signed long."""
    h = xxhash.xxh64_intdigest(b" ".join(text.split()))
    return h - (1 << 64) if h >> 63 else h


def _tokens(text: str) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    return np.unique(shingle_hashes(text)).view(np.int64)


def wide_print(tokens: np.ndarray) -> np.ndarray:
    """A 256-bit SimHash of a set of hashes, as four longs; no tokens: zeros."""
    ones = np.zeros(256, dtype=np.int64)
    for at in range(0, len(tokens), 4096):
        t = tokens[at : at + 4096].view(np.uint64)
        words = np.stack([_mix(t + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) for k in range(4)], axis=1)
        ones += np.unpackbits(words.view(np.uint8).reshape(len(t), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(tokens)).view(np.int64)


def _lowered(batch: pa.RecordBatch):
    """Texts in bounded slices, as they are and as bytes with A-Z lower-cased; null counts as empty."""
    for part in slices(batch, "text"):
        texts = [t or "" for t in part.column("text").to_pylist()]
        yield part, texts, [t.encode().translate(_LOWER) for t in texts]


def _sets(rows: DataFrame) -> DataFrame:
    """(row, tokens) of rows (_row, text)."""

    def start():
        def f(batch: pa.RecordBatch) -> pa.Table:
            out = [pa.table({"row": part.column("_row"), "tokens": pa.array([_tokens(t or "") for t in part.column("text").to_pylist()], pa.list_(pa.int64()))}) for part in slices(batch, "text")]
            return pa.concat_tables(out)

        return f

    return over_batches(rows.select("_row", "text"), start, "row long, tokens array<long>")


def _common(rows: DataFrame, count: int) -> np.ndarray:
    """Shingles that many documents share, by a bounded sample of rows. They come last in the order of shingles, so that few
    of them are in a prefix; any choice finds the same links."""
    some = _sets(rows.where(F.pmod(F.xxhash64("_row"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(1, count)) * (1 << 20))))
    often = some.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "token").limit(COMMON)
    return np.sort(np.array([r.token for r in often.collect()], dtype=np.int64))


_ROWS = "row long, doc_id long, text_sha256 string, node long, n int, " + ", ".join(f"{f} long" for f in _PRINT) + ", prefix array<long>"


def _rows(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """What is needed of each document but its text: its word sequence's hash, its set's size, wide fingerprint and prefix,
    shingles that aren't common first."""

    def start():
        def f(batch: pa.RecordBatch) -> pa.Table:
            out = []
            for part, texts, low in _lowered(batch):
                size, prints, prefixes = [], [], []
                for text in texts:
                    t = _tokens(text)
                    late = common[np.minimum(np.searchsorted(common, t), len(common) - 1)] == t if len(common) else np.zeros(len(t), dtype=bool)
                    size.append(len(t))
                    prints.append(wide_print(t))
                    prefixes.append(np.concatenate([t[~late], t[late]])[: prefix(len(t))] if len(t) else t)
                four = np.array(prints, dtype=np.int64).reshape(-1, 4)
                columns = {"row": part.column("_row"), "doc_id": part.column("doc_id"), "text_sha256": [hashlib.sha256(t).hexdigest() for t in low], "node": pa.array([_node(t) for t in low], pa.int64()), "n": pa.array(size, pa.int32())}
                out.append(pa.table(columns | {f: four[:, k] for k, f in enumerate(_PRINT)} | {"prefix": pa.array(prefixes, pa.list_(pa.int64()))}))
            return pa.concat_tables(out)

        return f

    return over_batches(rows.select("_row", "doc_id", "text"), start, _ROWS)


def _shared(prefixes: DataFrame) -> DataFrame:
    """The rows (token, node) whose token another node has too, each once. They pass in order, so a task holds a batch,
    not a cell."""

    def run(batches):
        last, sent = None, False  # the row before the batch, and whether it went out
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if last is not None:
                cols = [np.concatenate(x) for x in zip(last, cols, strict=True)]
            once = np.ones(len(cols[0]), dtype=bool)
            once[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            cols = [c[once] for c in cols]
            same = cols[0][1:] == cols[0][:-1]
            stays = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if len(stays):
                out, again = stays.copy(), sent and last is not None
                out[0] &= not again
                last, sent = [c[-1:] for c in cols], bool(stays[-1]) or (len(stays) == 1 and again)
                yield pa.RecordBatch.from_arrays([pa.array(c[out]) for c in cols], names=batch.schema.names)

    return prefixes.repartition("token").sortWithinPartitions("token", "node").mapInArrow(run, "token long, node long")


def reach(distinct: int) -> tuple[int, list[simhash.Covering]]:
    """The differing bits of 64 up to which fingerprints are linked, and the blocks whose anchors do it: 11 or 7 by four blocks
    of 16 bits (in one at most a quarter of them), else 5 as `simhash.covers` says. Sets alike to 0.8 differ in 10 on average."""
    for threshold in (11, 7):
        blocks = [simhash.Covering(at, 16, threshold // 4) for at in range(0, 64, 16)]
        if sum(copies + compared / simhash.WORTH for copies, compared in (b.cost(distinct) for b in blocks)) <= COPIES:
            return threshold, blocks
    return 5, simhash.covers(distinct, 5)


def within(cell: np.ndarray, n: np.ndarray, own: np.ndarray, whole: np.ndarray, known: np.ndarray, prints: np.ndarray):
    """Rows (sorted by cell) of one cell that aren't linked yet and whose sizes and fingerprints allow a likeness of 0.8; in a
    tile of two parts only those across. Yields positions, as many at once as there are rows at most."""
    at, d = np.arange(len(cell)), 0
    while len(at):
        d += 1
        at = at[at + d < len(cell)]
        at = at[cell[at] == cell[at + d]]
        i = at[(known[at] != known[at + d]) & (5 * np.minimum(n[at], n[at + d]) >= 4 * np.maximum(n[at], n[at + d])) & (whole[at] | (own[at] != own[at + d]))]
        i = i[np.bitwise_count(prints[i] ^ prints[i + d]).sum(axis=1, dtype=np.int64) <= NEAR]
        yield i, i + d


#: Links gathered before they are reduced to those that join.
LINKS = 500_000


def _tiled(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows (parts, node, ...) dealt by key and tile, in that order: a key's rows are cut into parts, and a tile meets two of
    them, so that a task holds two parts at a time whatever the key's size. whole: the tile of one part alone."""
    own, series = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)
    tiles = F.transform(series, lambda i: F.least(i, F.col("own")).cast("long") * F.col("parts") + F.greatest(i, F.col("own")))
    dealt = rows.withColumn("own", own).withColumn("tile", F.explode(tiles)).withColumn("whole", F.col("tile") % (F.col("parts") + 1) == 0)
    return dealt.select(key, "tile", "node", "n", "own", "whole", *columns).repartition(key, "tile").sortWithinPartitions(key, "tile")


def _clusters(cells: DataFrame) -> DataFrame:
    """(node, component) over all candidates: nodes that share a cell, are near by size and fingerprint and aren't linked yet.
    Rows (token, parts, node, n, known, fingerprint). Of each cell no more links than rows go on, which connect what all its candidates connect."""

    def run(batches):
        for cols in _whole_cells(batches):
            token, tile, node, n, own, whole, known = cols[:7]
            cell = np.cumsum(np.concatenate([[False], (token[1:] != token[:-1]) | (tile[1:] != tile[:-1])]))
            label, found, size = np.arange(len(node)), [], 0
            out: list[tuple[np.ndarray, np.ndarray]] = []

            def reduce():
                nonlocal label, found, size
                i, j, label = joining(*map(np.concatenate, zip(*found, strict=True)), label)
                out.append((node[i], node[j]))
                found, size = [], 0

            for i, j in within(cell, n, own, whole, known, np.stack(cols[7:], axis=1).view(np.uint64)):
                if len(i):
                    found.append((i, j))
                    size += len(i)
                    if size > LINKS:
                        reduce()
            if found:
                reduce()
            if out:
                a, b = map(np.concatenate, zip(*out, strict=True))
                rows = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=["a", "b"])

    dealt = _tiled(cells, "token", ["known", *_PRINT])
    return components(contracted(dealt.mapInArrow(lambda batches: stars(run(batches)), "a long, b long")))


def alike(n: np.ndarray, own: np.ndarray, whole: bool, known: np.ndarray, prints: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between sets with a Jaccard likeness of 0.8 or more, by the whole sets: those that connect what all connect beside
    what is connected already (equal numbers in `known`).
    Each set is compared at once with all later ones that aren't connected to it yet."""
    starts = np.cumsum(n) - n
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mine, label, out = np.zeros(len(distinct), dtype=bool), np.unique(known, return_inverse=True)[1], []
    for i in range(len(n) - 1):
        j = np.arange(i + 1, len(n))
        j = j[(label[j] != label[i]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j])) & (whole | (own[i] != own[j]))]
        j = j[np.bitwise_count(prints[j] ^ prints[i]).sum(axis=1, dtype=np.int64) <= NEAR]
        if not len(j):
            continue
        mine[ids[starts[i] : starts[i] + n[i]]] = True
        places = np.repeat(starts[j] - (np.cumsum(n[j]) - n[j]), n[j]) + np.arange(n[j].sum())
        common = np.add.reduceat(mine[ids[places]].astype(np.int64), np.cumsum(n[j]) - n[j])
        mine[ids[starts[i] : starts[i] + n[i]]] = False
        near = j[9 * common >= 4 * (n[i] + n[j])]
        x, y, label = joining(np.full(len(near), i), near, label)
        out += zip(x.tolist(), y.tolist(), strict=True)
    return out


def _verified(members: DataFrame) -> DataFrame:
    """(a, b), contracted: links between members of a cluster, verified on their sets. Rows (cluster, parts, node, n, known, fingerprint, tokens)."""

    def run(batches):
        held: list = []

        def send():
            n, own = np.array([r[3] for r in held], dtype=np.int64), np.array([r[4] for r in held])
            known, prints = np.array([r[6] for r in held], dtype=np.int64), np.array([r[7:11] for r in held], dtype=np.int64).view(np.uint64)
            found = alike(n, own, held[0][5], known, prints, [r[11] for r in held])
            if found:
                a, b = (np.array([held[k][2] for k in side], dtype=np.int64) for side in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            plain = [c.to_pylist() for c in batch.columns[:-1]]
            for k, row in enumerate(zip(*plain, strict=True)):
                if held and held[0][:2] != row[:2]:
                    yield from send()
                    held.clear()
                held.append((*row, batch.column(11)[k].values.to_numpy()))
        if held:
            yield from send()

    dealt = _tiled(members, "cluster", ["known", *_PRINT, "tokens"])
    return contracted(dealt.mapInArrow(lambda batches: stars(run(batches)), "a long, b long"))


def _whole_cells(batches):
    """Columns of batches sorted by (token, tile), cut where a cell ends."""
    held = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        cut = len(last) - int(last.sum())
        held = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if held is not None:
        yield held


#: Shingles that a cluster may hold before its comparisons are cut into tiles of two parts.
TOKENS = 100_000


def _inside(clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b), staged: links inside clusters of two and more nodes by their whole sets, tile by tile, so that each set moves once
    a part and no list of pairs is ever made. Rows (cluster, node, n, row, known, fingerprint)."""
    clusters = staged(clusters)
    parts = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.ceil(F.sum("n") / TOKENS).cast("int").alias("parts")).where("size > 1").drop("size")
    members = staged(join_hot(clusters, parts, "cluster", clusters.count()))
    sets = _sets(marked(rows, "_row", members.select("row")))
    return staged(_verified(members.join(sets, "row")))


def by_simhash(nodes: DataFrame) -> DataFrame:
    """nodes with their cluster: what SimHash fingerprints of 64 bits (f0) within `reach` link, directly or by others."""
    rows = nodes.where("n > 0").withColumn("fp", F.col("f0"))
    distinct = staged(rows.select("fp").distinct())
    count = distinct.count()
    threshold, blocks = reach(count)
    joined = components(simhash.links(distinct, count, threshold, blocks)).withColumnRenamed("node", "fp")
    of = distinct.join(joined, "fp", "left").select("fp", F.coalesce("component", "fp").alias("cluster"))
    return join_hot(rows, of, "fp", rows.count()).drop("fp")


def by_prefixes(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """nodes with their cluster: candidates for links between sets that aren't linked yet, wherever their fingerprints are. Two
    sets alike to 0.8 share a shingle of their prefixes (a fifth of each set), so every pair meets in a cell. Pairs of a cell
    that their sizes and wide fingerprints allow are candidates; their connected components are clusters. known: nodes
    with the component that they are in so far."""
    shared = staged(_shared(nodes.select(F.explode("prefix").alias("token"), "node")))
    large = staged(shared.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CELL).select("token", F.ceil(F.col("rows") / CELL).cast("int").alias("parts")))
    dealt = shared.withColumn("parts", F.lit(1)) if large.isEmpty() else shared.join(large, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    clusters = _clusters(dealt.join(known.drop("row"), "node")).withColumnRenamed("component", "cluster")
    return known.join(clusters, "node")


def links(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, component) of word sequences that are alike to 0.8 or more to another, directly or by others. nodes: (node, n,
    row, fingerprint, prefix), staged; rows: the documents, of which those in a cluster are read again.

    SimHash fingerprints are linked by anchors, and the whole sets of what they link are compared. Fingerprints can't be
    near for certain, so the links that are left between different components are found by prefixes of the sets."""
    small = nodes.drop("prefix")
    first = components(_inside(by_simhash(small.withColumn("known", F.col("node"))), rows))
    known = staged(small.join(first, "node", "left").withColumn("known", F.coalesce("component", "node")).drop("component"))
    rest = _inside(by_prefixes(nodes, known), rows)
    return components(known.where("known != node").select(F.col("known").alias("a"), F.col("node").alias("b")).unionByName(rest))


def groups(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_sha256, kept) of `identified` documents (_d, _row). Of each group of documents that are linked by a
    Jaccard likeness of 0.8 or more of their 5-word shingles one row is kept: the smallest doc_id (null ids first), of rows
    that share it the smallest digest (SHA-256 of the text with A-Z lower-cased), then the smallest row. Null counts as
    empty; texts of the same words are alike, those of fewer than five words by these alone; an empty table has no rows."""
    rows = docs.select("_row", F.col("_d.doc_id").cast("long").alias("doc_id"), F.col("_d.text").alias("text"))
    small = staged(_rows(rows, _common(rows, rows.count())))
    first = [F.first(c).alias(c) for c in ("n", *_PRINT, "prefix")]
    nodes = staged(small.groupBy("node").agg(F.min(F.struct("doc_id", "text_sha256", "row")).alias("least"), *first))
    joined = links(nodes.withColumn("row", F.col("least.row")).drop("least"), rows).withColumnRenamed("node", "of")
    of = nodes.select("node", "least").join(joined, F.col("node") == F.col("of"), "left").select("least", F.coalesce("component", "node").alias("component"))
    least = of.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.row").alias("stays"))
    return small.select("row", "doc_id", "text_sha256").join(least, F.col("row") == F.col("stays"), "left").select("row", "doc_id", "text_sha256", F.col("stays").isNotNull().alias("kept"))


def representatives(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of the row that stays of each group."""
    return groups(identified(docs)).where("kept").select("doc_id", "text_sha256")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns. Texts of the others alone cross the network."""
    tagged = identified(docs)
    return without(tagged, groups(tagged).where("NOT kept").select("row"))
