"""Exact dedup, SimHash, sketches, components."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laminaspark.llm import dedup, simhash, sketches
from laminaspark.llm.common import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(text):
    return hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()


def check_groups(rows, got):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[key(text)].append(doc_id)
    small = lambda x: (x is not None, x or 0)
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    kept = Counter()
    for r in got:
        mine = groups[r.text_sha256]
        assert r.doc_id in mine and r.group_size == len(mine) and r.keep_id == max(mine, key=small)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert all(kept[k] == 1 for k in groups)


def test_exact(docs, texts, odd, none):
    check_groups(list(texts.items()), dedup.exact_dedup(docs).collect())
    check_groups([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], dedup.exact_dedup(odd).collect())
    assert dedup.exact_dedup(none).count() == 0


def test_exact_in_parts(monkeypatch, spark):
    monkeypatch.setattr(dedup, "LIVE", 5)
    rows = [(k, f"text {k % 40}" if k % 3 else "THE hot one") for k in range(600)]
    check_groups(rows, dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect())


def test_keep_kept(odd):
    left = dedup.keep_kept(odd, dedup.exact_dedup(odd))
    assert left.columns == odd.columns
    got = left.select("doc_id", "text").collect()
    assert Counter(key(r.text) for r in got) == Counter({key(r.text) for r in odd.select("text").collect()})


def test_colliding_digests_are_told_apart_by_content(spark, odd, monkeypatch):
    """Three digests for all texts: unlike texts of one digest are hits, and their contents part them."""
    few = lambda content: F.sha2((F.char_length(content) % 3).cast("string"), 256).cast("binary")
    rows = [(k, f"text {k % 37}" if k % 3 else "THE hot one") for k in range(300)]
    for live in (200_000, 7):
        monkeypatch.setattr(dedup, "LIVE", live)
        check_groups(rows, dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), digest=few).collect())
    check_groups([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], dedup.exact_dedup(odd, digest=few).collect())


def test_filter_spares_lookups():
    """New digests are stored without a look at the bucket; each hit looks once, and counts as verified if its content is there."""
    index = dedup.LiveIndex()
    for k in range(2000):
        index.add(digest(k), (k, 0), 1)
    assert index.probes <= 10 and index.verified == 0  # but for false positives of 16-bit tags
    before = index.probes
    for k in range(500):
        index.add(digest(k), (k, 1), 1)
    assert index.probes == before + 500 and index.verified == 500
    index.add(digest(1), (7, 0), 1, b"another text")
    assert index.find(digest(1)) == ((1, 1), 2) and index.find(digest(1), b"another text") == ((7, 0), 1)


def test_retiring_keeps_what_recurs():
    index = dedup.LiveIndex()
    for k in (1, 2, 3, 2):
        index.add(digest(k), (k, 0), 1)
    assert {r[2][0] for r in index.retire()} == {1, 3} and index.live == 1 and digest(1) not in index.filter
    index.add(digest(1), (5, 0), 1)
    assert sorted((r[2][0], r[3]) for r in index.retire()) == [(2, 2), (5, 1)] and index.live == 0


def test_one_of_each(spark, odd, none):
    for docs in (odd, odd.repartition(4), none):
        left = dedup.one_of_each(docs)
        assert left.columns == odd.columns
        want = Counter({key(r.text) for r in docs.select("text").collect()})
        assert Counter(key(r.text) for r in left.select("text").collect()) == want
    assert {r.doc_id for r in dedup.one_of_each(odd).collect()} >= {2, 4, 5, 7}


def digest(k):
    return hashlib.sha256(str(k).encode()).digest()


def test_index_inserts_deletes_and_grows():
    index = dedup.LiveIndex(buckets=4)
    for k in range(3000):
        index.add(digest(k), (k, 0), 1)
    assert index.resized > 0 and index.live == 3000 and all(index.find(digest(k)) == ((k, 0), 1) for k in range(3000))
    for k in range(0, 3000, 2):
        assert index.delete(digest(k)) == ((k, 0), 1)
    assert index.live == 1500 and all((index.find(digest(k)) is None) == (k % 2 == 0) for k in range(3000))
    assert index.delete(digest(0)) is None
    index.add(digest(1), (0, 0), 4)
    index.add(digest(1), (9, 0), 1)
    assert index.find(digest(1)) == ((9, 0), 6) and index.live == 1500


def test_index_verifies_hits():
    """A digest with the same tag and buckets but another rest is no copy."""
    index = dedup.LiveIndex()
    a, b = bytes(32), bytes(20) + b"x" * 12
    index.add(a, (1, 0), 1)
    assert b in index.filter and index.find(b) is None
    index.add(b, (2, 0), 1)
    assert index.find(a) == ((1, 0), 1) and index.find(b) == ((2, 0), 1)


def simhash_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(LOWER).encode())
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def by_brute_force(prints, threshold=4):
    """(id, fp) rows: component of each."""
    fp = np.array([f for _, f in prints], dtype=np.uint64)
    up = list(range(len(fp)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= threshold):
            a, b = root(i), root(int(j))
            up[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(prints):
        groups[root(i)].append(d)
    return [min((d for d in groups[root(i)] if d is not None), default=None) for i in range(len(fp))]


def test_simhash(docs, texts, odd, none):
    for df, rows in ((docs, list(texts.items())), (odd, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])):
        prints = [(d, simhash_of(t)) for d, t in rows]
        want = Counter((d, f"{f:016x}", c) for (d, f), c in zip(prints, by_brute_force(prints), strict=True))
        assert Counter(tuple(r) for r in simhash.near_dedup(df).collect()) == want
    assert simhash.near_dedup(none).count() == 0


@pytest.mark.parametrize("cell", [20_000, 60])
def test_near_components_of_a_large_group(spark, monkeypatch, cell):
    """Chains, a dense group, and strangers; with cells cut into parts, too."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(3)
    fp = [int(x) for x in rng.integers(0, 1 << 63, 300)]
    center = fp[0]
    fp += [center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (400, 2))]
    for _ in range(100):
        fp.append(fp[-1] ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False)))
    prints = list(enumerate(fp + fp[:50]))
    df = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in prints], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.near_components(df).collect()}
    assert [got[d] for d, _ in prints] == by_brute_force(prints)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, (1 << 64) - 1), st.sets(st.integers(0, 63), max_size=4), st.sampled_from([1, 10**9]))
def test_covering_misses_no_pair(x, flips, count):
    y = x ^ sum(1 << b for b in flips)
    a, b = np.array([x], dtype=np.uint64), np.array([y], dtype=np.uint64)
    met = False
    for block in simhash.covers(count):
        (home, _), (anchors, there) = (m[0] for m in block.copies(a)), (m[0] for m in block.copies(b))
        met |= home[0] in anchors[there].tolist()
    assert met


def test_representatives(odd, docs, texts):
    got = simhash.representatives(docs).collect()
    prints = [(d, simhash_of(t)) for d, t in texts.items()]
    assert sorted(r.doc_id for r in got) == sorted(set(by_brute_force(prints)))
    assert len(simhash.representatives(odd).collect()) == len({c for c in by_brute_force([(k, simhash_of(r.text)) for k, r in enumerate(odd.select("text").collect())])})


def test_cover_plans():
    """The number of fingerprints chooses the blocks by cost; every plan covers all pairs (see the test above for two counts)."""
    assert [len(simhash.covers(n)) for n in (10**6, 10**9, 10**10)] == [3, 10, 2]
    rng = np.random.default_rng(6)
    for n in (10**6, 10**9, 10**10):
        blocks = simhash.covers(n)
        x = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300).astype(np.uint64)
        y = x.copy()
        for k in range(300):
            for bit in rng.choice(64, 4, replace=False):
                y[k] ^= np.uint64(1) << np.uint64(bit)
        met = np.zeros(300, dtype=bool)
        for b in blocks:
            home, there = b.copies(x)[0][:, :1], b.copies(y)
            met |= ((there[0] == home) & there[1]).any(axis=1)
        assert met.all()


def test_hot_keys_are_dealt(spark, monkeypatch):
    """A hub with half of the edges is salted, and nothing else changes."""
    from laminaspark.llm import common

    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("u"), F.col("id").alias("v"))
    least = rows.groupBy("u").agg(F.min("v").alias("m"))
    want = Counter(map(tuple, rows.join(least, "u").collect()))
    assert Counter(map(tuple, common.join_hot(rows, least, "u", 20_000).collect())) == want
    monkeypatch.setattr(common, "SALTED", 100)
    salted = common.join_hot(rows, least, "u", 20_000)
    assert Counter(map(tuple, salted.collect())) == want
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
    edges = rows.select(F.lit(-1).cast("long").alias("a"), F.col("v").alias("b")).unionByName(rows.select(F.col("v").alias("a"), (F.col("v") + 100_000).alias("b")))
    assert {r.component for r in components(edges).collect()} == {-1}


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000, k) for k in range(1001, 1300)] + [(k, k + 1) for k in range(2000, 2100)] + [(7, 7)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in pairs if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def shingles(text):
    w = (text or "").translate(LOWER).split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in sketches.with_edited(docs).collect()}
    ids = sorted(texts)
    assert set(got) == set(ids)
    off = []
    for k, d in enumerate(ids):
        t, following, r = texts[d], texts[ids[(k + 1) % len(ids)]], got[d]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r.edited_fingerprint == sketches.to_text(sketches.sketch(changed))
        off += [r.near_edited - jaccard(shingles(t), shingles(changed)), r.near_next - jaccard(shingles(t), shingles(following))]
    assert np.abs(off).mean() < 0.03 and np.abs(off).max() < 0.2


def test_fingerprints_in_buckets(monkeypatch, docs):
    whole = {tuple(r) for r in sketches.with_edited(docs).collect()}
    monkeypatch.setattr(sketches, "BUCKET_ROWS", 10)
    assert {tuple(r) for r in sketches.with_edited(docs.repartition(5)).collect()} == whole


def test_fingerprints_of_hot_ids(monkeypatch, spark):
    """Two thirds of the rows share an id (a null among them): their buckets stay small, and each row meets its successor."""
    monkeypatch.setattr(sketches, "BUCKET_ROWS", 20)
    ids = [None] * 400 + [7] * 400 + list(range(-200, 200))
    docs = spark.createDataFrame([(d, f"text {k % 390} of id {d}") for k, d in enumerate(ids)], "doc_id long, text string").repartition(4)
    sizes = sketches.in_order(docs).where("extra = 0").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 60 and sum(r["count"] for r in sizes) == 1200
    hashed = docs.withColumn("h", F.xxhash64("text")).collect()
    rows = sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    want = Counter()
    for r, following in zip(rows, [*rows[1:], rows[0]], strict=True):
        want[r.doc_id, hashlib.sha256(sketches.edited(r.text, following.text).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in sketches.with_edited(docs).collect()) == want


def test_fingerprints_of_odd_rows(spark, odd, none):
    got = sketches.with_edited(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.select("doc_id").collect())
    assert {r.near_edited for r in got if r.doc_id in (3, 4)} == {1.0} and sketches.with_edited(none).count() == 0
    alone = sketches.with_edited(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert [(r.near_next, r.n_chars) for r in alone] == [(1.0, 15)]


def test_sketch_algebra(texts):
    a, b = (" ".join(list(texts.values())[k : k + 30]) for k in (0, 15))
    x, y, both = sketches.sketch(a), sketches.sketch(b), shingles(a) | shingles(b)
    assert sketches.sketch("") .size == 0 and sketches.sketch("One two").tolist() == sketches.sketch("one  two").tolist()
    assert abs(sketches.resemblance(x, y) - jaccard(shingles(a), shingles(b))) < 0.15
    assert abs(sketches.containment(x, y) - len(shingles(a) & shingles(b)) / len(shingles(a))) < 0.2
    assert abs(sketches.distinct(sketches.merge(x, y)) / len(both) - 1) < 0.3
    assert sketches.from_text(sketches.to_text(x)).tolist() == x.tolist()
    assert sketches.distinct(sketches.sketch("a b c d e f")) == 2


def test_merged_sketches(docs, texts):
    prints = sketches.fingerprint(docs).join(docs.select("doc_id", "lang"), "doc_id")
    got = {r.key: r.fingerprint for r in sketches.merged(prints, "lang").collect()}
    by_lang = defaultdict(list)
    for r in docs.select("doc_id", "lang").collect():
        by_lang[r.lang].append(np.unique(sketches.shingle_hashes(texts[r.doc_id])))
    assert got == {k: sketches.to_text(np.unique(np.concatenate(v))[: sketches.K]) for k, v in by_lang.items()}


def test_exact_dedup_over_more_partitions(odd, monkeypatch):
    """Tables with more digests than the session's partitions may hold are dealt over more of them."""
    monkeypatch.setattr(dedup, "MERGED", 1)
    got = dedup.exact_dedup(odd).collect()
    check_groups([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], got)


def test_rounds_leave_one_staged_table(spark):
    """A chain needs several rounds; what they staged is deleted but for the last."""
    from laminaspark.llm import common

    app = spark.sparkContext.applicationId
    before = len(common._staged.get(app, []))
    got = components(spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert {r.component for r in got.collect()} == {0} and len(common._staged[app]) == before + 1


def test_marked_rows(spark, monkeypatch):
    """The map finds all keys and few others; a map that is too small lets more rows through, never fewer."""
    from laminaspark.llm import common

    rows = spark.range(20_000).select(F.xxhash64("id").alias("_row"), "id")
    keys = rows.where("id % 7 = 0").select("_row")
    for bits, most in ((1 << 24, 2900), (1 << 17, 5000), (1 << 15, 20_000)):
        monkeypatch.setattr(common, "BITS", bits)
        found = {r.id for r in common.marked(rows, "_row", keys).collect()}
        assert found >= set(range(0, 20_000, 7)) and len(found) <= most
        assert {r.id for r in common.marked(rows, "_row", keys, inside=False).collect()} == set(range(20_000)) - found
    assert common.marked(rows, "_row", keys.limit(0)).count() == 0
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(50)], "doc_id long, text string")
    tagged = common.identified(docs)
    gone = tagged.where("_d.doc_id < 20").select("_row")
    assert sorted(r.doc_id for r in common.without(tagged, gone).collect()) == list(range(20, 50))


@pytest.mark.parametrize("block", [1, 7, 64])
def test_word_hashes_in_blocks(monkeypatch, texts, block):
    """Cutting a text between words changes no hash, with any white space and with words longer than a block."""
    some = [t.encode() for t in list(texts.values())[:20] if t] + [b"", b" ", b"a\tb\x0bc \n d", b"x" * 300 + b" y", "漢字 ünï  x".encode()]
    whole = [sketches.word_hashes(t) for t in some]
    monkeypatch.setattr(sketches, "BLOCK", block)
    assert all((sketches.word_hashes(t) == w).all() and len(sketches.word_hashes(t)) == len(w) for t, w in zip(some, whole, strict=True))
