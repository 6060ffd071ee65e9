"""Token counts, packing, encoding."""

import base64
import hashlib
import json
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from laminaspark.llm import common, encoding, packing, token_counts

FILE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def segment(word: bytes, pieces) -> int:
    """Tokens of the best segmentation, by brute force over positions."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for d in range(1, len(word) + 1):
        for j in range(d):
            s = pieces.get(word[j:d])
            if s is not None:
                score, n = best[j][0] + s, best[j][1] + 1
                if score > best[d][0] or (score == best[d][0] and n < best[d][1]):
                    best[d] = score, n
    return best[-1][1]


def test_token_counts_by_brute_force(docs, texts):
    pieces, pattern = token_counts.zipf_pieces(), regex.compile(public_tokenizers.PATTERN)
    known: dict = {}
    for r in token_counts.token_counts(docs).collect():
        words = pattern.findall(texts[r.doc_id])
        for w in words:
            if w not in known:
                known[w] = segment(w.encode(), pieces)
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(known[w] for w in words))


def test_token_counts_are_the_best(texts):
    """Every other segmentation of short words scores no higher."""
    pieces = token_counts.zipf_pieces()
    trie = token_counts.ScoreTrie(pieces)
    for w in ("the", " and", "tion", "x1", " é"):
        b = w.encode()
        cuts = [[i for i in range(1, len(b)) if m >> (i - 1) & 1] for m in range(1 << (len(b) - 1))]
        scores = [sum(pieces.get(b[i:j], -math.inf) for i, j in zip([0, *c], [*c, len(b)], strict=True)) for c in cuts]
        assert math.isclose(trie.best([w]), max(scores))


def test_token_counts_begin_anew(monkeypatch, texts):
    words = regex.findall(public_tokenizers.PATTERN, " ".join(list(texts.values())[:20]))
    pieces = token_counts.zipf_pieces()
    whole = token_counts.ScoreTrie(pieces).tokens(words)
    monkeypatch.setattr(token_counts, "NODES", 50)
    assert token_counts.ScoreTrie(pieces).tokens(words) == whole


def test_token_counts_in_a_bounded_trie(monkeypatch):
    """Many distinct words in one text, and one long word, leave a trie within its bounds and change no count."""
    rng, pieces = np.random.default_rng(4), token_counts.zipf_pieces()
    words = [f" {k:x}" for k in rng.integers(0, 1 << 40, 30_000)]
    whole = token_counts.ScoreTrie(pieces).tokens(words + words[:999])
    monkeypatch.setattr(token_counts, "NODES", 4000)
    monkeypatch.setattr(token_counts, "HELD", 500)
    trie = token_counts.ScoreTrie(pieces)
    assert trie.tokens(words + words[:999]) == whole and len(trie.score) <= 4000 + 257 and len(trie.words) <= 500
    long = "".join(rng.choice(list("abcdefghij é"), 3000))
    trie = token_counts.ScoreTrie(pieces)
    assert trie.tokens([long, "a", long]) == 2 * segment(long.encode(), pieces) + 1 and len(trie.score) < 400
    assert trie.tokens(["x" * 200_000]) > 0 and len(trie.score) < 800


def test_odd_rows(odd, none):
    for f in (token_counts.token_counts, encoding.encode):
        got = f(odd).collect()
        assert len(got) == odd.count() and Counter(r.doc_id for r in got)[5] == 2
        assert all(r.n_tokens == 0 for r in got if r.doc_id in (3, 4)) and f(none).count() == 0
    assert packing.pack(none).count() == 0


def check_packing(rows, texts, length):
    """texts: (doc_id, text) with repeats."""
    want = Counter()
    for doc_id, t in texts:
        ids = np.array([*FILE.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = (len(ids) - 1) % length + 1
        cuts = [0, *range(first, len(ids) + 1, length)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(bins), -(-sum(n for places in bins.values() for _, n in places) // length)


def test_packing(docs, texts):
    used, bound = check_packing(packing.pack(docs).collect(), texts.items(), 2048)
    assert used <= bound * 1.01 + 1


def test_packing_odd_rows(odd):
    check_packing(packing.pack(odd).collect(), [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], 2048)


def test_packing_ties(spark):
    """Rows that share id, piece and length, and rows of no id, get places of their own, also after chunks are dealt."""
    rows = [(7, "same words here")] * 300 + [(7, "same words there")] * 300 + [(None, "same words here")] * 300
    used, bound = check_packing(packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect(), rows, 2048)
    assert used <= bound + 1


def test_ids_only_of_a_plain_file():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        settings = json.load(f)
    ranks = packing._checked("byte_bpe_50k")[0]
    assert packing.plain(settings, ranks)
    token = settings["added_tokens"][0]
    for change in ({"normalizer": {"type": "NFC"}}, {"added_tokens": [token, token | {"content": "<x>"}]}, {"pre_tokenizer": settings["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": settings["model"] | {"dropout": 0.1}}, {"model": settings["model"] | {"vocab": dict(list(settings["model"]["vocab"].items())[:-1])}}):
        assert not packing.plain(settings | change, ranks)
    slow = packing.Ids()
    slow.plain = False
    assert slow("some text") == packing.Ids()("some text")


IDS = packing.Ids()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    assert IDS(text) == FILE.encode(text, add_special_tokens=False).ids


def test_fullest_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 40, 6), rng.integers(1, 4, 6), strict=True)}
        room = int(rng.integers(1, 90))
        sums = {0}
        for n, c in counts.items():
            sums |= {s + n * k for s in sums for k in range(c + 1)}
        chosen = packing.fullest(counts, room)
        assert sum(n * q for n, q in chosen) == max(s for s in sums if s <= room) and all(q <= counts[n] for n, q in chosen)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_uses_each_piece_once(histogram):
    patterns = packing.plan(histogram, 64)
    used = Counter()
    for times, chosen in patterns:
        assert sum(n * q for n, q in chosen) <= 64
        for n, q in chosen:
            used[n] += times * q
    assert used == Counter(histogram)
    table = packing.slots(patterns)
    assert len({tuple(r[:2]) for r in table.tolist()}) == len(table)


@pytest.fixture(scope="module")
def tik():
    ranks = encoding.ranks_of("byte_bpe_multi_50k.tiktoken")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(ids, text):
    return hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_encoding(docs, texts, odd, tik):
    for r in encoding.encode(docs, with_ids=True).collect():
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) == (len(ids), *digests(ids, texts[r.doc_id]), ids)
    want = Counter((x.doc_id, *digests(tik.encode_ordinary(x.text or ""), x.text or "")) for x in odd.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in encoding.encode(odd).collect()) == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="abcdehnort é漢🙂'", min_size=1, max_size=40), min_size=1, max_size=20))
def test_contract(tik, words):
    bpe = test_contract.__dict__.setdefault("bpe", encoding.Bpe(encoding.ranks_of("byte_bpe_multi_50k.tiktoken")))
    for w, (ids, back) in zip(words, bpe.contract([w.encode() for w in words]), strict=True):
        assert back == w.encode() and np.frombuffer(ids, "<u4").tolist() == tik._core_bpe.encode_single_piece(w.encode())


@pytest.mark.parametrize("least", [1, 10**9])
def test_long_words(monkeypatch, tik, texts, least):
    """Both forms of the steps, on words of few letters, runs, and whole texts without their spaces."""
    monkeypatch.setattr(encoding, "LONG", least)
    bpe, rng = encoding.Bpe(encoding.ranks_of("byte_bpe_multi_50k.tiktoken")), np.random.default_rng(2)
    words = ["".join(rng.choice(list(a), int(rng.integers(1, 150)))) for a in ("ab", "the", "aehrst", "étionaux", "=- ", "0123456789") for _ in range(15)]
    words += ["".join(t.split())[:400] or "x" for t in list(texts.values())[:60]]
    for w, (ids, back) in zip(words, bpe.contract([w.encode() for w in words]), strict=True):
        assert back == w.encode() and np.frombuffer(ids, "<u4").tolist() == tik._core_bpe.encode_single_piece(w.encode())


def test_words_without_a_space(tik):
    """A million letters in one word, and long runs: cut where no token reaches across, encoded as the whole would be."""
    bpe, rng = encoding.Bpe(encoding.ranks_of("byte_bpe_multi_50k.tiktoken")), np.random.default_rng(8)
    for letters, n in (("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/", 1_000_000), ("étonauxbdhi", 20_000), ("a", 20_000), ("the", 9_000)):
        word = letters * n if len(letters) in (1, 3) else "".join(rng.choice(list(letters), n))
        assert b"".join(bpe.segments(word.encode())) == word.encode()
        bpe.learn([word])
        assert bpe.decoded[word] == word.encode()
        assert np.frombuffer(bpe.ids[word], "<u4").tolist() == tik._core_bpe.encode_single_piece(word.encode())


def test_generations(monkeypatch, docs, texts, tik):
    monkeypatch.setattr(encoding, "REMEMBERED", 100)
    bpe = encoding.Bpe(encoding.ranks_of("byte_bpe_multi_50k.tiktoken"))
    pattern = regex.compile(public_tokenizers.PATTERN)
    for t in list(texts.values())[:40]:
        words = pattern.findall(t)
        bpe.know([words])
        assert np.frombuffer(b"".join(bpe.ids[w] for w in words), "<u4").tolist() == tik.encode_ordinary(t)


def test_decode(tik, texts):
    t = next(iter(texts.values()))
    assert encoding.decode(tik.encode_ordinary(t)) == t.encode() and encoding.decode([]) == b""
    assert base64.b64encode(b"") == b""


def test_tasks_go_on_with_what_a_worker_kept(docs, texts, tik):
    """Many small tasks in few workers, two queries by turns, give what one task gives."""
    many = docs.repartition(40)
    for _ in range(2):
        assert {r.doc_id: r.n_tokens for r in encoding.encode(many).collect()} == {d: len(tik.encode_ordinary(t or "")) for d, t in texts.items()}
        assert Counter(token_counts.token_counts(many).collect()) == Counter(token_counts.token_counts(docs.coalesce(1)).collect())


def test_kept_functions_stay_with_their_plan():
    common.leave("a", len)
    assert common.take("a") is len and common.take("a") is None
    common.leave("a", len)
    assert common.take("b") is None and common.take("a") is None
