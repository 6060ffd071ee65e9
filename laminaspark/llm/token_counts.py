"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import base64
import math
from array import array

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laminaspark.llm.common import over_batches, read, slices

#: Trie nodes and words that a task holds at most; then it starts a new trie. Bytes of a word that share the trie (more than
#: the longest piece has).
NODES, HELD, SHARED = 1_500_000, 750_000, 256


def zipf_pieces(name: str = "byte_bpe_50k.tiktoken") -> dict[bytes, float]:
    """Unigram log-scores of a public vocabulary. The files hold ranks and no probabilities and nothing may be trained, so
    the score follows Zipf's law over the ranks: -ln(rank + 1). Every byte is a piece, so every text has a segmentation."""
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): -math.log(int(b) + 1) for a, b in map(bytes.split, f)}


class _Counts(dict):
    """Token count by pre-token. One that isn't there goes through the trie when it is asked for; when the bounds are reached,
    trie and counts begin anew, inside a document too."""

    def __init__(self, trie: ScoreTrie):
        self.trie = trie

    def __missing__(self, word: str) -> int:
        trie, raw = self.trie, word.encode()
        if len(self) >= HELD or len(trie.score) + min(len(raw), SHARED) > NODES:
            trie.clear()
        n = trie.best_of(raw)[1]
        if len(raw) <= SHARED:
            self[word] = n
        return n


class ScoreTrie:
    """A trie of distinct pre-tokens. A node's forward score is the best log-score of any segmentation of the prefix that
    it stands for; it depends on the prefix alone and is computed once, when the node is made, from its ancestors. The node
    where a word ends holds its token count: of the best segmentation, and of equal ones the one of fewest tokens."""

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces, self.longest, self.words = pieces, max(map(len, pieces)), _Counts(self)
        self.clear()

    def clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.score, self.count = array("d", [0.0]), array("l", [0])
        self.words.clear()

    def insert(self, word: bytes) -> int:
        """The node where the word ends."""
        return self.path(word)[-1]

    def path(self, word: bytes) -> list[int]:
        """The nodes of all its prefixes, the root first."""
        edges, score, count, pieces, longest = self.edges, self.score, self.count, self.pieces, self.longest
        path, node = [0], 0
        for d, byte in enumerate(word, 1):
            key = node << 8 | byte
            if (to := edges.get(key)) is None:
                best, fewest = -math.inf, 0
                for j in range(max(0, d - longest), d):
                    if (s := pieces.get(word[j:d])) is not None:
                        s += score[path[j]]
                        n = count[path[j]] + 1
                        if s > best or (s == best and n < fewest):
                            best, fewest = s, n
                to = edges[key] = len(score)
                score.append(best)
                count.append(fewest)
            node = to
            path.append(node)
        return path

    def best_of(self, word: bytes) -> tuple[float, int]:
        """Forward score and token count of a pre-token. Beyond SHARED bytes a word has the trie for its first part only; from
        there on scores go on in a window as long as the longest piece, so that no word's length bounds memory."""
        path = self.path(word[:SHARED])
        if len(path) > len(word):
            return self.score[path[-1]], self.count[path[-1]]
        pieces, longest = self.pieces, self.longest
        ends = [(self.score[k], self.count[k]) for k in path[-longest:]]  # of the prefixes that end at d - longest .. d - 1
        for d in range(len(path), len(word) + 1):
            best, fewest = -math.inf, 0
            for j, (score, count) in enumerate(ends, d - len(ends)):
                if (s := pieces.get(word[j:d])) is not None:
                    s += score
                    if s > best or (s == best and count + 1 < fewest):
                        best, fewest = s, count + 1
            ends.append((best, fewest))
            del ends[0]
        return ends[-1]

    def tokens(self, words: list[str]) -> int:
        """Tokens of a list of pre-tokens: the sum of their terminal counts."""
        return sum(map(self.words.__getitem__, words))

    def best(self, words: list[str]) -> float:
        return sum(self.best_of(w.encode())[0] for w in words)


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every whole text; null counts as empty (0, 0). A pure map without any shuffle:
    each worker keeps a trie of the distinct pre-tokens that its tasks have met, of bounded size. Repeated rows repeat; other columns
    aren't read; an empty table gives no rows."""

    def start():
        trie, pattern = ScoreTrie(zipf_pieces(vocabulary)), regex.compile(public_tokenizers.PATTERN)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            all_words, tokens = [], []
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    words = pattern.findall(text) if text else []
                    all_words.append(len(words))
                    tokens.append(trie.tokens(words))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(all_words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

        return f

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), start, "doc_id long, n_pretokens long, n_tokens long", keep=True)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
