"""Best-fit packing of token sequences by a configuration linear program.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece lengths (at most ``capacity`` numbers,
whatever the table's size) decides the plan:

1. Configuration LP: cover the histogram with as few bins as possible, a bin being a multiset of lengths that fits.
   It is solved by multiplicative weights: each round a knapsack dynamic program over the current prices finds the
   best bins (the best completion through each length, kept if near the optimum), they are used for a share of the demand, and
   prices of covered lengths fall.
2. Rounding: bins are taken in whole numbers, the fullest first, as often as demand allows; what is left is packed largest
   first with the longest length that fits (best fit), again bin pattern by bin pattern.
3. Each pattern owns a run of ranks per length; a piece's rank within its length gives its sequence and its offset.

Ranks come from bucketed counts (:func:`facetry.llm.common.with_rank`), so one length may hold any share of all pieces. The plan has
a size that depends on the capacity alone (``MAX_CONFIGS`` bins from the LP; the rest patterns each use up a length) and goes to the tasks as arrays.

Token ids are those of the 50k byte-level BPE; the rank file of the same vocabulary is read by tiktoken, which gives equal
ids about four times faster (tests compare them). As there, the string of the special token inside a text is that token's one id.

Defined results: a null or empty text is one piece holding only the end id; repeated rows are packed separately; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import WORK, filled, hash_bucket, materialize, slots_for, table, unfilled, with_rank

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"  # the vocabulary's only special token; its id follows the ranks
ROUNDS = 160
EPS = 0.02
CURVES = (1.05, 1.2, 1.5)  # first prices tried; the plan with the fewest bins is kept
DECAY = 0.1
MAX_CONFIGS = 16_384


def encoder(path: str | None = None):
    """The byte-level BPE of the public rank file ``path``; ids equal those of the JSON file of the same vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter than ``capacity`` if there are several."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def to_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked, the token ids."""
    kind = dict(docs.dtypes)[id_col]
    kept = "bigint" if kind in ("int", "smallint", "tinyint") else kind

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = partial(encoder(tokenizer).encode, allowed_special="all")
        for df in batches:
            rows = []
            for doc, text in zip(df["doc_id"], df["text"]):
                ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                for i, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append((doc, i, start, length, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    schema = f"doc_id {kept}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    number = kind in ("bigint", "int", "smallint", "tinyint")
    made = docs.select((filled(id_col) if number else F.col(id_col)).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
    return made.select(unfilled("doc_id"), *made.columns[1:]) if number else made


def knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each room 0..capacity with any number of each length, and the length taken there (0: leave one free)."""
    capacity = len(prices) - 1
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        value = prices[1 : room + 1] + best[room - 1 :: -1][:room]
        i = int(value.argmax())
        if value[i] > best[room - 1]:
            best[room], take[room] = value[i], i + 1
        else:
            best[room] = best[room - 1]
    return best, take


def _through(lengths: np.ndarray, take: np.ndarray) -> list[tuple[int, ...]]:
    """The best bin through each of ``lengths``, longest first."""
    capacity = len(take) - 1
    used = np.maximum.accumulate(np.where(take > 0, np.arange(capacity + 1), 0))  # largest room not above that takes something
    room, items = capacity - lengths, [lengths]
    while True:
        room = used[room]
        nxt = take[room]
        if not nxt.any():
            break
        items.append(nxt)
        room = room - nxt
    grid = -np.sort(-np.stack(items, axis=1), axis=1)
    return [tuple(row[row > 0].tolist()) for row in grid]


def configuration_lp(histogram: dict[int, int], capacity: int, rounds: int = ROUNDS, eps: float = EPS, curve: float = CURVES[0]) -> dict[tuple[int, ...], float]:
    """Fractional numbers of bins by bin pattern that cover the histogram, by multiplicative weights.

    First prices are (length / capacity) ** curve: above 1, long lengths are worth more than the room they take.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[i] for i in lengths.tolist()], dtype=float)
    prices = np.full(capacity + 1, -np.inf)
    first = (lengths / capacity) ** curve
    prices[lengths] = first
    covered = np.zeros(len(lengths))
    at = {length: i for i, length in enumerate(lengths.tolist())}
    amount: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        best, take = knapsack(prices)
        value = prices[lengths] + best[capacity - lengths]
        near = lengths[(value >= (1 - eps) * best[capacity]) & (covered < need)]
        gain = np.zeros(len(lengths))
        for config in set(_through(near, take)) if len(near) else ():
            index = [at[i] for i in config]
            times = {i: index.count(i) for i in set(index)}
            left = min((need[i] - covered[i] - gain[i]) / k for i, k in times.items())
            if left > 0:
                step = max(left / 2, min(left, 1.0))
                amount[config] = amount.get(config, 0.0) + step
                for i, k in times.items():
                    gain[i] += k * step
        covered += gain
        done = covered / need
        if (done > 1 - 1e-9).all():
            break
        prices[lengths] = np.where(done > 1 - 1e-9, -np.inf, first * np.exp(-DECAY * done))  # weights fall with the cover
    return amount


@dataclass(frozen=True)
class Plan:
    """Runs of ranks per length, sorted by (length, first rank): ``per_bin`` copies in each of consecutive sequences."""

    length: np.ndarray
    first: np.ndarray
    per_bin: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.zeros(len(length), dtype=np.int64)
        lo = np.searchsorted(self.length, length, side="left")
        hi = np.searchsorted(self.length, length, side="right")
        for a, b in {(a, b) for a, b in zip(lo.tolist(), hi.tolist())}:
            mine = (lo == a) & (hi == b)
            run[mine] = a + np.searchsorted(self.first[a:b], rank[mine], side="right") - 1
        within = rank - self.first[run]
        return self.sequence[run] + within // self.per_bin[run], self.offset[run] + within % self.per_bin[run] * length


def _round(histogram: dict[int, int], capacity: int, amount: dict[tuple[int, ...], float]) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of bins: the LP's bins rounded down by demand, fullest first, then best fit for the rest."""
    left = dict(histogram)
    bins: list[tuple[tuple[int, ...], int]] = []

    def use(config: tuple[int, ...], most: float) -> None:
        times = {i: config.count(i) for i in set(config)}
        k = int(min(most, min(left.get(i, 0) // m for i, m in times.items())))
        if k > 0:
            bins.append((config, k))
            for i, m in times.items():
                left[i] -= k * m

    ranked = sorted(amount, key=lambda c: (-amount[c] * sum(c), c))[:MAX_CONFIGS]
    ranked.sort(key=lambda c: (-sum(c), -amount[c], c))
    for config in ranked:
        use(config, np.floor(amount[config]))
    for config in ranked:
        if sum(config) == capacity:
            use(config, np.inf)
    rest = sorted(i for i, n in left.items() if n > 0)
    while rest:
        config, room, used = [rest[-1]], capacity - rest[-1], {rest[-1]: 1}
        while room > 0:
            i = int(np.searchsorted(rest, room, side="right")) - 1
            while i >= 0 and left[rest[i]] <= used.get(rest[i], 0):
                i -= 1
            if i < 0:
                break
            config.append(rest[i])
            used[rest[i]] = used.get(rest[i], 0) + 1
            room -= rest[i]
        use(tuple(config), np.inf)
        rest = [i for i in rest if left[i] > 0]
    return bins


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, curves: tuple[float, ...] = CURVES) -> Plan:
    """The rounded LP with the fewest bins, as runs of ranks."""
    tried = [_round(histogram, capacity, configuration_lp(histogram, capacity, rounds, curve=c) if histogram else {}) for c in curves]
    bins = min(tried, key=lambda b: sum(k for _, k in b))
    cursor, runs, total = dict.fromkeys(histogram, 0), [], 0
    for config, k in bins:
        offset = 0
        for length in sorted(set(config), reverse=True):
            m = config.count(length)
            runs.append((length, cursor[length], m, total, offset))
            cursor[length] += k * m
            offset += m * length
        total += k
    cols = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5).T
    return Plan(*cols, bins=total)


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = WORK) -> DataFrame:
    """``pieces`` (a written table with doc_id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``."""
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = packing_plan(histogram, capacity)
    buckets = slots_for(sum(histogram.values()), bucket_rows)
    h = F.xxhash64("doc_id", "piece", "ids_crc32")
    ranked = with_rank(pieces.withColumn("_b", hash_bucket(h, buckets)), ["length"], "_b", ["doc_id", "piece", "ids_crc32"], "_rank").drop("_b")
    names = [c for c in ranked.columns if c != "_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                seq, off = plan.place(batch.column("length").to_numpy(), batch.column("_rank").to_numpy())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "_rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def sequences(packed_with_ids: DataFrame) -> DataFrame:
    """Training rows: the token ids of each sequence in order and the document of each run (a sequence has at most ``capacity`` tokens)."""
    part = F.struct("offset", "doc_id", "piece", "ids")
    got = packed_with_ids.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    return got.select(
        "sequence_id",
        F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"))).alias("parts"),
    )


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = materialize(to_pieces(table(spark, sf_dir, "documents")))
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
