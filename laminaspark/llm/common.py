"""What several operators of this subpackage share: staging in the shared folder, gapless ranks, components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the session (`spark.checkpoint.dir`); a folder of its own only where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):  # local and local-cluster run on one machine
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="laminaspark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


_staged: dict[str, list[str]] = {}


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _forget(app: str) -> None:
    """Deletes what this application staged when Python ends: through its session, or by path where the session is gone and
    the shared folder is mounted."""
    spark = SparkSession.getActiveSession()
    lives = spark is not None and spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app
    for at in _staged.pop(app, []):
        if lives:
            _delete(spark, at)
        elif at.startswith(("file:", "/")):
            shutil.rmtree("/" + at.removeprefix("file:").lstrip("/"), ignore_errors=True)


def unstaged(df: DataFrame) -> None:
    """Deletes what `staged` wrote for df, which nothing reads any more."""
    spark = df.sparkSession
    if (at := getattr(df, "_staged_at", None)) in (names := _staged.get(spark.sparkContext.applicationId, [])):
        names.remove(at)
        _delete(spark, at)


def staged(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back, so that a lost executor
    costs a read and no work is done twice. Rows and their order inside a file stay as they were written."""
    spark = df.sparkSession
    at = f"{work_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(at, compression="zstd")
    app = spark.sparkContext.applicationId
    if app not in _staged:
        _staged[app] = []
        atexit.register(_forget, app)
    _staged[app].append(at)
    out = spark.read.schema(df.schema).parquet(at)
    object.__setattr__(out, "_staged_at", at)
    return out


def identified(docs: DataFrame) -> DataFrame:
    """(_d, _row): the columns of docs as a struct, and a number of the row by its file and place there, the same whenever the
    files are read again. Rows that don't come straight from files are staged first."""

    def tagged(rows: DataFrame) -> DataFrame:
        meta = rows.metadataColumn("_metadata")
        return rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_d"), F.xxhash64(meta["file_path"], meta["row_index"]).alias("_row"))

    try:
        return tagged(docs)
    except AnalysisException:
        return tagged(staged(docs))


def untagged(rows: DataFrame) -> DataFrame:
    return rows.select("_d.*")


#: Bits of the map by which rows are found; its size is fixed, and too few bits only let more rows pass to the join behind it.
BITS = 1 << 24


def marked(rows: DataFrame, column: str, keys: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose long in `column` may be among the keys (one column of longs), or those whose isn't for certain. The lowest bits
    of all keys make a map of BITS bits: 512 rows of 4 KB at most, whatever the number of keys, which every task gets."""
    low = lambda c: F.col(c).bitwiseAND(F.lit(BITS - 1))
    name = keys.columns[0]
    chunks = keys.select(F.shiftright(low(name), 15).alias("_chunk"), low(name).bitwiseAND(F.lit(32767)).alias("_place")).groupBy("_chunk").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    place = low("_at").bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    hit = F.coalesce(F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    met = rows.withColumn("_at", F.col(column)).withColumn("_chunk", F.shiftright(low("_at"), 15)).join(F.broadcast(chunks), "_chunk", "left")
    return met.where(hit if inside else ~hit).select(*(F.col(f"`{c}`") for c in rows.columns))


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of `identified` documents, as documents again, but those whose _row is in `dropped` (one column of longs).
    Only rows that the map of the dropped ones may mean go through the join; the others stay where they are, so that texts
    move about as far as rows are dropped. Beyond some ten million dropped rows the map is full and all rows pass the join."""
    gone = staged(dropped.toDF("_gone"))
    asked = marked(rows, "_row", gone).join(gone, F.col("_row") == F.col("_gone"), "left_anti")
    return untagged(marked(rows, "_row", gone, inside=False).unionByName(asked))


_kept: dict[str, Callable] = {}


def take(plan: str) -> Callable | None:
    """The function that an earlier task of the same plan left in this worker process; those of other plans are dropped."""
    f = _kept.pop(plan, None)
    _kept.clear()
    return f


def leave(plan: str, f: Callable) -> None:
    _kept[plan] = f


def over_batches(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None]], schema: str, keep: bool = False) -> DataFrame:
    """mapInArrow where start() runs once a task (it loads models and vocabularies) and returns the function of a batch.

    keep: a task that ends well leaves the function, with what it remembers, to the next task of this plan in the same worker
    process. It is never shared between plans, and its memory must be bounded; a lost worker costs a start."""
    plan = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = (take(plan) if keep else None) or start()
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]
        if keep:
            leave(plan, f)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterable[pa.RecordBatch]:
    """The batch in slices whose texts hold about `most` bytes (one text at least), so that memory doesn't follow the batch size."""
    at = used = 0
    for k, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if used and used + (n or 0) > most:
            yield batch.slice(at, k - at)
            at, used = k, 0
        used += n or 0
    yield batch.slice(at)


#: Rows in a chunk of a ranked key, and the least number of chunks.
CHUNK_ROWS, CHUNKS = 100_000, 64


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, rows: int) -> DataFrame:
    """Adds the gapless rank from 0 of each row within its keys. A key may hold any share of the rows: they are dealt by
    hash into chunks, ranked inside a chunk, and a running sum over the chunks' counts gives each chunk its first rank.
    rows: how many df has (sets the number of chunks). `order` must tell rows apart, or equal rows rank as they come."""
    chunks = max(CHUNKS, rows // CHUNK_ROWS)
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    counts = dealt.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = dealt.withColumn("_local", F.row_number().over(inside) - 1)
    return local.join(firsts, [*keys, "_chunk"]).withColumn(out, (F.col("_first") + F.col("_local")).cast("long")).drop("_chunk", "_first", "_local")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


#: Rows of a join from which on its hot keys are looked for, and the parts over which the rows of such a key are dealt.
SALTED, SALTS = 1_000_000, 64


def join_hot(rows: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with `one`, which has one row a key, where a key may hold any share of the `total` rows. Keys with over a
    thousandth of them (fewer than a thousand, whatever the table) are dealt over SALTS parts, and their row in `one` is
    sent to each. (AQE doesn't split a join whose one side is an aggregate by the key.)"""
    if total < SALTED:
        return rows.join(one, key)
    hot = [r[0] for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * 1000 > total).select(key).collect()]
    if not hot:
        return rows.join(one, key)
    is_hot = F.col(key).isin(hot)
    dealt = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0))
    every = one.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(every, [key, "_salt"]).drop("_salt")


def joining(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of links between positions those that join two sets (a label each), and the labels after that: each set goes over to
    the least that a link leads to, until no link is left between two sets."""
    kept_i, kept_j = [i[:0]], [j[:0]]
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return np.concatenate(kept_i), np.concatenate(kept_j), label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))
        first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
        kept_i.append(i[first])
        kept_j.append(j[first])
        up = np.arange(int(label.max()) + 1)
        up[high[first]] = low[first]
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


#: Links that a task holds before it sends some on.
STARS = 500_000


def stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between longs, as links from each node to the smallest that a task's links lead to: however many links a
    dense group has, no more go on than the task has nodes. (Beyond STARS nodes they go on in portions, of which that holds.)"""
    held, size = [], 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        a, b = map(np.concatenate, zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = joining(at[: len(a)], at[len(a) :], np.arange(len(nodes)))[2]
        away = label != np.arange(len(nodes))
        return nodes[away], nodes[label[away]]

    def batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for x in batches:
        held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
        size += x.num_rows
        if size > STARS:
            held = [reduced()]
            size = len(held[0][0])
            if 2 * size > STARS:
                yield batch(*held[0])
                held, size = [], 0
    if size:
        yield batch(*reduced())


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) that `stars` made task by task, fewer still: a node's links meet in one task, which links the node once, and
    the few nodes that its tasks chose to each other. So the links follow the nodes, not the pairs of a group."""
    return links.repartition("a").mapInArrow(stars, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, component), component the smallest node.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond"). Each step
    is an aggregate with partial sums and an equi-join whose hot keys are salted; no adjacency list is ever gathered.
    Nodes of any type that orders. Null ends and loops are left out. Raises if `most_rounds` don't reach the fixpoint."""
    now = staged(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = join_hot(both.where("v > u"), least, "u", state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_hot(large, low, "u", state[0]).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        last, now = now, staged(small)
        unstaged(last)
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError(f"components: no fixpoint after {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _state(edges: DataFrame) -> tuple:
    """Count and two order-free sums that tell whether a step changed the edges."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())
