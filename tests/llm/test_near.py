"""Near copies by 5-word Jaccard against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from laminaspark.llm import common, near
from tests.llm.test_copies import jaccard, shingles


def smallest(rows):
    """The smallest doc_id of each group of (doc_id, text) that likenesses of 0.8 or more link."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    having = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s or {()}:
            having[x].append(k)
    for a, b in {(a, b) for ks in having.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}:
        if jaccard(sets[a], sets[b]) >= 0.8:
            up[max(root(a), root(b))] = min(root(a), root(b))
    groups = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        groups[root(k)].append(d)
    return Counter(min(g) for g in groups.values())


def test_stage_against_brute_force(spark, docs, texts, sf):
    got = Counter(r.doc_id for r in corpus_pipeline.simhash_near(spark, docs, sf).collect())
    assert got == smallest(list(texts.items()))
    assert 1 in got and 177 not in got  # a likeness of 0.83, which four SimHash bits don't reach


@pytest.mark.parametrize("cell, tokens", [(20_000, 100_000), (7, 100_000), (20_000, 700), (5, 300)])
def test_groups_chains_and_a_shared_passage(spark, monkeypatch, cell, tokens):
    """Likenesses on both sides of 0.8, chains, a large group, a passage in all documents; with cells cut into tiles, too."""
    monkeypatch.setattr(near, "CELL", cell)
    monkeypatch.setattr(near, "TOKENS", tokens)
    monkeypatch.setattr(near, "LINKS", 10 * cell)
    passage = " ".join(f"common{k}" for k in range(12))
    word = lambda d, k: f"w{d}x{k}"
    rows, d = [], 0
    for base in range(30):
        text = [word(base, k) for k in range(60)]
        for edits in range(6):
            text = text[:]
            text[(edits * 17 + base) % 60 : (edits * 17 + base) % 60 + 1 + base % 3] = [f"e{base}y{edits}"]
            rows.append((d := d + 1, f"{passage} {' '.join(text)}"))
    for k in range(60):
        text = [word("g", j) for j in range(80)]
        text[k], text[(k * 7 + 3) % 80] = f"u{k}", f"v{k}"
        rows.append((d := d + 1, " ".join(text)))
    rows += [(d + 1, "a b c"), (d + 2, "A  b\tc"), (d + 3, "a b"), (d + 4, ""), (d + 5, None)]
    got = Counter(r.doc_id for r in near.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == smallest(rows)


def test_wide_prints_of_alike_sets_are_near():
    """Sets alike to 0.8, of few and of many shingles, stay well inside the bound that candidates must meet."""
    rng = np.random.default_rng(3)
    most = 0
    for n in (4, 8, 9, 40, 300):
        for _ in range(300):
            a = rng.integers(-(1 << 63), 1 << 63, n)
            b = np.concatenate([a[: n - n // 9], rng.integers(-(1 << 63), 1 << 63, n // 9)]) if n > 8 else np.concatenate([a, rng.integers(-(1 << 63), 1 << 63, n // 4)])
            most = max(most, int(np.bitwise_count((near.wide_print(a) ^ near.wide_print(b)).view(np.uint64)).sum()))
    assert 30 < most <= near.NEAR - 10


def test_joining():
    i, j, label = near.joining(np.array([0, 5, 2, 3, 1]), np.array([1, 6, 3, 1, 0]), np.arange(8))
    assert label.tolist() == [0, 0, 0, 0, 4, 5, 5, 7] and len(i) == 4


def test_stage_links_by_simhash_and_finds_the_rest(spark, monkeypatch):
    """Alike sets whose SimHash differs in few bits are linked through anchors alone; those beyond aren't lost, and the exact
    path sees no pair that is linked already."""
    rng = np.random.default_rng(5)
    rows = []
    for base in range(120):
        text = [f"b{base}w{k}" for k in range(90)]
        other = text[:]
        for at in rng.integers(0, 90, base % 3):
            other[at] = f"b{base}e{at}"
        rows += [(2 * base + 1, " ".join(text)), (2 * base + 2, " ".join(other + ["end"]))]
    bits = {d: int(near.wide_print(near._tokens(t))[0]) for d, t in rows}
    pairs = [(d, d + 1) for d in range(1, 240, 2) if jaccard(shingles(rows[d - 1][1]), shingles(rows[d][1])) >= 0.8]
    reached = {a for a, b in pairs if ((bits[a] ^ bits[b]) & (1 << 64) - 1).bit_count() <= near.reach(240)[0]}
    assert len(reached) > 60 and len(reached) < len(pairs)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(r.doc_id for r in corpus_pipeline.simhash_near(spark, docs, "").collect()) == smallest(rows)
    rest = near.by_prefixes
    seen = []

    def nothing(nodes, known):
        seen.append(rest(nodes, known).groupBy("cluster").agg({"known": "count"}).count())
        return rest(nodes, known).where("false")

    monkeypatch.setattr(near, "by_prefixes", nothing)
    kept = {r.doc_id for r in corpus_pipeline.simhash_near(spark, docs, "").collect()}
    assert {d + 1 for d in reached} == {d for d, _ in rows} - kept
    assert seen[0] >= len(pairs) - len(reached) and seen[0] <= 120 - len(reached)


@pytest.mark.parametrize("distinct, bits", [(1_000, 11), (5_000_000, 7), (50_000_000, 5)])
def test_reach(distinct, bits):
    """Fingerprints that differ in that many bits meet in an anchor of some block, whatever the bits."""
    rng = np.random.default_rng(bits)
    threshold, blocks = near.reach(distinct)
    assert threshold == bits
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for at in rng.choice(64, bits, replace=False):
            b[k] ^= np.uint64(1) << np.uint64(at)
    met = np.zeros(len(a), dtype=bool)
    for block in blocks:
        anchors, there = block.copies(b)
        met |= ((block.copies(a)[0][:, :1] == anchors) & there).any(axis=1)
    assert met.all()


def test_links_follow_the_nodes_of_a_dense_group(spark, monkeypatch):
    """Near copies that are nearly all alike to each other: what goes to the components grows with the documents, not their pairs."""
    spread = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in spread}
    find, seen = near.components, []

    def counted(edges):
        ends = [(r.a, r.b) for r in edges.select("a", "b").collect()]
        seen.append((len(ends), len({x for e in ends for x in e})))
        return find(edges)

    monkeypatch.setattr(near, "components", counted)
    monkeypatch.setattr(near, "TOKENS", 5_000)
    text = [f"w{k}" for k in range(150)]
    copies = [" ".join(w if k != d % 150 else f"x{d}" for k, w in enumerate(text)) for d in range(400)]
    rows = [*enumerate(copies), *((1000 + d, f"{d} is none of them at all {d} {d + 1}") for d in range(50))]
    try:
        for k, v in spread.items():
            spark.conf.set(k, v)
        got = Counter(r.doc_id for r in near.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == smallest(rows) and len(got) == 51
    assert seen[0][1] > 300 and all(links <= 2 * nodes for links, nodes in seen)


@pytest.mark.parametrize("most", [500_000, 300, 20])
def test_stars(monkeypatch, most):
    """Links become fewer than nodes and still connect what they connected; in portions, too."""
    monkeypatch.setattr(common, "STARS", most)
    rng = np.random.default_rng(8)
    a, b = (np.concatenate([rng.integers(-300, 300, 400), rng.integers(1000, 1060, 2000)]) for _ in range(2))
    batches = [pa.RecordBatch.from_arrays([pa.array(a[k : k + 90]), pa.array(b[k : k + 90])], names=["a", "b"]) for k in range(0, len(a), 90)]
    out = [(x, y) for batch in common.stars(iter([*batches, batches[0].slice(0, 0)])) for x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True)]

    def least(pairs):
        up = {x: x for p in zip(a.tolist(), b.tolist(), strict=True) for x in p}
        root = lambda x: x if up[x] == x else root(up[x])
        for x, y in pairs:
            p, q = sorted((root(x), root(y)))
            up[q] = p
        return {x: root(x) for x in up}

    want = least(zip(a.tolist(), b.tolist(), strict=True))
    assert least(out) == want and all(x > y for x, y in out)
    if most > len(a):
        assert set(out) == {(x, y) for x, y in want.items() if x != y}
    assert list(common.stars(iter([]))) == list(common.stars(iter([batches[0].slice(0, 0)]))) == []
