"""Best-fit packing of tokenized documents by minimum bin slack."""

from __future__ import annotations

import base64
import functools
import json
import zlib
from collections.abc import Iterable

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from laminaspark.llm.common import identified, over_batches, ranked, read, slices, staged

LENGTH, END = 2048, 0
SPECIAL = "<|endoftext|>"  # the one string that the tokenizer file treats apart


def plain(settings: dict, ranks: dict[bytes, int]) -> bool:
    """Whether a tokenizer file says no more than its ranks do: byte-level BPE by the public pattern over the same vocabulary,
    nothing that changes or adds to a text, and no added token but SPECIAL."""
    model, before = settings["model"], settings["pre_tokenizer"] or {}
    steady = all(settings.get(k) is None for k in ("normalizer", "truncation", "padding")) and [t["content"] for t in settings["added_tokens"]] == [SPECIAL]
    level = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    merging = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    byte = {c: b for b, c in byte_letters().items()}
    return steady and level and merging and {bytes(byte[c] for c in piece): k for piece, k in model["vocab"].items() if piece != SPECIAL} == ranks


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: its own if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@functools.cache
def _checked(name: str) -> tuple[dict[bytes, int], bool]:
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        return ranks, plain(json.load(f), ranks)


class Ids:
    """The ids that the tokenizer file gives. Its vocabulary as ranks gives the same ids faster, if the file's settings say no
    more than that (checked once a process); texts with the special token's string, and every text of a file with other
    settings, go to the file's own tokenizer."""

    def __init__(self, name: str = "byte_bpe_50k"):
        ranks, self.plain = _checked(name)
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.file, self.slow = public_tokenizers.path(f"{name}.json"), None

    def __call__(self, text: str) -> list[int]:
        if self.plain and SPECIAL not in text:
            return self.fast.encode_ordinary(text)
        self.slow = self.slow or Tokenizer.from_file(self.file)
        return self.slow.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and an end id 0, cut into pieces of `length` ids if longer,
    the first piece taking what is left over. Null text counts as empty: one piece that holds the end id alone."""

    def start():
        ids = Ids()

        def f(batch: pa.RecordBatch) -> pa.Table:
            out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    row = np.array([*ids(text or ""), END], dtype="<u4")
                    cuts = [0, *range((len(row) - 1) % length + 1, len(row) + 1, length)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for name, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(row[a:b].tobytes())), strict=True):
                            out[name].append(value)
            return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))

        return f

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), start, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The (length, times) whose sum is the largest that fits into room. Bit s of a number says that sum s can be reached;
    lengths enter from the longest on, so that among equal sums the one of longer pieces is found."""
    steps, bits, mask = [], 1, (1 << (room + 1)) - 1
    for n in sorted((n for n in counts if n <= room), reverse=True):
        steps.append((n, bits))
        left, k = min(counts[n], room // n), 1
        while left > 0:
            take = min(k, left)
            bits |= (bits << (n * take)) & mask
            left, k = left - take, k * 2
        if bits >> room & 1:
            break
    at, chosen = bits.bit_length() - 1, []
    for n, before in reversed(steps):
        times = 0
        while not before >> at & 1:
            at, times = at - n, times + 1
        if times:
            chosen.append((n, times))
    return chosen


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum bin slack over a histogram of piece lengths: (how many sequences, [(length, times in each)]).

    The longest piece left opens a sequence and the fullest feasible combination of the others joins it. While the pieces
    last, the same combination stays the fullest one, so it is taken as often as they allow: the work depends on the
    number of distinct lengths (`length` at most), not on the number of pieces."""
    counts, out = {n: c for n, c in histogram.items() if c}, []
    while counts:
        first = max(counts)
        rest = counts | {first: counts[first] - 1}
        if not rest[first]:
            del rest[first]
        chosen = dict(fullest(rest, length - first))
        chosen[first] = chosen.get(first, 0) + 1
        times = min(counts[n] // q for n, q in chosen.items())
        out.append((times, sorted(chosen.items(), reverse=True)))
        for n, q in chosen.items():
            counts[n] -= times * q
            if not counts[n]:
                del counts[n]
    return out


def slots(patterns: Iterable[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """A row (length, first rank, times, first sequence, offset) for each length of each pattern, ordered by length and rank:
    the pieces of a length, by rank, fill the patterns in turn. At most length * H(length) patterns (16,800 for 2048) of 63
    distinct lengths each exist, whatever the corpus; in practice a few thousand rows."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for times, chosen in patterns:
        offset = 0
        for n, q in chosen:
            rows.append((n, taken.get(n, 0), q, sequence, offset))
            taken[n] = taken.get(n, 0) + times * q
            offset += n * q
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Packs every document into sequences of at most `length` tokens, as few as the method finds: rows (doc_id, piece,
    start, length, ids_crc32, sequence_id, offset).

    Documents are tokenized once; what remains are small rows in the shared folder. The driver sees only the histogram of
    lengths (`length` rows at most). Nulls count as empty texts, repeated rows are packed as often as they occur, other
    columns are not read, and an empty table gives no rows. Ties: pieces of equal length rank by doc_id, piece and place in
    the staged rows within chunks dealt by their hash, so that a task that runs again ranks them alike."""
    rows = identified(staged(pieces(docs, length)))
    items = rows.select("_d.*", "_row")
    histogram = {r[0]: r[1] for r in items.groupBy("length").count().collect()}
    table = slots(plan(histogram, length))
    span = 1 << 44  # more than the pieces of one length
    starts = table[:, 0] * span + table[:, 1]

    def start():
        def f(batch: pa.RecordBatch) -> pa.Table:
            n, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            _, base, times, sequence, offset = table[np.searchsorted(starts, n * span + rank, side="right") - 1].T
            into, place = np.divmod(rank - base, times)
            return pa.table({**{c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, "sequence_id": sequence + into, "offset": offset + place * n})

        return f

    rank = ranked(items, ["length"], ["doc_id", "piece", "_row"], "_rank", sum(histogram.values()))
    return over_batches(rank, start, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
