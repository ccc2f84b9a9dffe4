"""Language-model scores by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates of all orders, c(context, token) / c(context), and a uniform share
1 / (V + 1) in which all unknown tokens are one. The mixture depends on how often training text holds the longest known context
(a bucket per order and power of two); its weights are learned by expectation-maximisation on a part of the training documents that the
estimates leave out at that time. The final scores use the counts of all training documents with these weights.

1. Documents are packed, as they lie, into compressed blobs of ``BLOB_BYTES`` of text (a written table).
2. Each blob sends its distinct n-grams (hashes of 56 bits, single tokens of 64, sorted, as differences) with its own counts, cut into shards by hash. A shard adds
   up what all blobs sent and answers each with the totals in the order asked, so no blob sees more of the model than it asked for and
   a frequent n-gram is one number per blob.
3. Blobs of the part that was left out turn tokens into cells: bucket and ratios of the estimates to the uniform share, on a
   grid of quarter octaves, with counts and sums of logarithms. Cells of the corpus are added up; their number is bounded by the grid. Per
   order of the longest known context one group of cells goes through expectation-maximisation.
4. Every blob meets its answers and scores its texts.

Tokens are lower-cased (A-Z) runs without ASCII white space and one end mark per text. Defined results: a null or empty text is its end
mark; rows without id are scored and never teach; repeated rows count as often as they are there; without any training text every
token is the one unknown token (score 0); a bucket that the left-out part doesn't hold keeps the weights pooled over its order; an empty
table gives no rows; other columns are ignored. One text is handled within one task, at about 100 bytes of memory per token.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import filled, materialize, table, uint64_mix, unfilled
from facetry.llm.near_dups import Shingler

ORDER = 3
PARTS = 10  # a document's part is crc32(id) modulo PARTS: 0 never teaches, 1 sets the weights, the others make the estimates meanwhile
LEFT_OUT = 1
BLOB_BYTES = 8 << 20
SHARD_BYTES = 12 << 20  # text per shard of the counts
GRID = 4  # cells per octave
MIDDLE = 256  # the cell of ratio 1; 0 stands for an estimate of zero
TOP_BUCKET = 31
ROUNDS = 60
TOLERANCE = 1e-7

LONGER = np.uint64((1 << 64) - 256)  # n-grams of several tokens are known by 56 bits, single tokens by 64
_END, _START, _ODD = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, so that leading zeros lie together, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())


def _numbers(body: bytes, dtype: type) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def _several(parts: list[bytes]) -> bytes:
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def _apart(body: bytes, n: int) -> list[bytes]:
    sizes = struct.unpack_from(f"<{n}I", body)
    at = np.cumsum([4 * n, *sizes])
    return [body[a:b] for a, b in zip(at, at[1:])]


_BLOBS = "blob long, left_out boolean, taught long, n long, ids array<bigint>, parts array<int>, sizes array<int>, body binary"


def blobs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts packed into blobs as they lie; those of the left-out part into blobs of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        z, first, made = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32, 0
        kept: dict[bool, list[tuple[int, int, bytes]]] = {False: [], True: []}
        held = {False: 0, True: 0}

        def out(side: bool) -> pd.DataFrame:
            nonlocal made
            rows, made = kept[side], made + 1
            ids, parts, data = zip(*rows)
            one = (first + made, side, sum(p != 0 for p in parts), len(rows), list(ids), list(parts), [len(x) for x in data], z.compress(b"".join(data)))
            kept[side], held[side] = [], 0
            return pd.DataFrame([one], columns=["blob", "left_out", "taught", "n", "ids", "parts", "sizes", "body"])

        for df in batches:
            for i, part, text in zip(df["doc_id"].tolist(), df["part"].tolist(), df["text"]):
                data, side = (text or "").encode("utf-8", "surrogatepass"), part == LEFT_OUT
                if held[side] and held[side] + len(data) > BLOB_BYTES:
                    yield out(side)
                kept[side].append((i, part, data))
                held[side] += len(data) + 16
        for side in (False, True):
            if kept[side]:
                yield out(side)

    part = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(PARTS)).cast("int")
    part = F.when(F.col(id_col).isNull(), F.lit(0)).otherwise(part)
    return docs.select(filled(id_col).alias("doc_id"), part.alias("part"), F.col(text_col).alias("text")).mapInPandas(run, _BLOBS)


class Grams:
    """Token hashes of a blob's texts one after the other, and hashes of the n-grams that end at each token."""

    def __init__(self, sizes: np.ndarray, body: bytes, order: int):
        import zstandard

        data, words, hashes, pos = zstandard.ZstdDecompressor().decompress(body), Shingler(1).words, [], 0
        for s in sizes:
            hashes.append(words(data[pos : pos + s].decode("utf-8", "surrogatepass")))
            hashes.append(np.array([_END]))
            pos += s
        self.lengths = np.array([len(a) + 1 for a in hashes[::2]], dtype=np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        token = np.concatenate(hashes)
        self.keys = [uint64_mix(token + _ODD)]
        start = uint64_mix(np.array([_START]) + _ODD)
        for n in range(2, order + 1):
            before = self.previous(self.keys[-1], start)
            self.keys.append(uint64_mix(before * _ODD + token + np.uint64(n)) & LONGER)
            start = uint64_mix(start * _ODD + _START + np.uint64(n)) & LONGER

    def previous(self, x: np.ndarray, at_start: int | np.ndarray) -> np.ndarray:
        """``x`` one token earlier in the same text."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first] = at_start
        return out

    def of_texts(self, x: np.ndarray) -> np.ndarray:
        """A value per text at each of its tokens."""
        return np.repeat(x, self.lengths)


def _cut(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the shards begin among sorted keys; a shard is a range of the hash."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


_ASKED = "slot long, blob long, left_out boolean, shard int, n int, body binary"


def asked(packed: DataFrame, shards: int, order: int) -> DataFrame:
    """Distinct n-grams of each blob with their counts in the training documents that stay and that are left out, by order and shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for b in df.itertuples(index=False):
                grams = Grams(b.sizes, b.body, order)
                part = grams.of_texts(np.asarray(b.parts))
                stays, out = (part != 0) & (part != LEFT_OUT), part == LEFT_OUT
                for n, keys in enumerate(grams.keys, 1):
                    unique, at = np.unique(keys, return_inverse=True)
                    counts = [np.bincount(at[role], minlength=len(unique)).astype(np.uint32) for role in (stays, out)]
                    cut, made = _cut(unique, shards), []
                    for s in range(shards):
                        x, y = cut[s], cut[s + 1]
                        if x < y:
                            body = _several([_planes(np.diff(unique[x:y], prepend=np.uint64(0))), *[_planes(c[x:y]) for c in counts]])
                            made.append((s * order + n - 1, b.blob, b.left_out, s, n, body))
                    yield pd.DataFrame(made, columns=["slot", "blob", "left_out", "shard", "n", "body"])

    return packed.select("blob", "left_out", "parts", "sizes", "body").mapInPandas(run, _ASKED)


_ANSWERS = "blob long, left_out boolean, shard int, n int, body binary, tokens long, kinds long, staying long"


def _answer(df: pd.DataFrame) -> pd.DataFrame:
    """Totals of a shard's n-grams for each blob, in the order asked. The one row without blob holds the shard's own sums."""
    parts = [_apart(b, 3) for b in df["body"]]
    keys = [np.cumsum(_numbers(p[0], np.uint64), dtype=np.uint64) for p in parts]
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    add = lambda k: np.bincount(at, weights=np.concatenate([_numbers(p[k], np.uint32) for p in parts]), minlength=len(unique)).astype(np.int64)
    stays = add(1)
    every = stays + add(2)
    ends, out, n = np.cumsum([len(k) for k in keys]), [], int(df["n"].iloc[0])
    for end, k, blob, left_out, shard in zip(ends, keys, df["blob"], df["left_out"], df["shard"]):
        own = at[end - len(k) : end]
        body = _several([_planes(every[own]), _planes(stays[own]) if left_out else b""])
        out.append((blob, left_out, shard, n, body, 0, 0, 0))
    if n == 1:
        out.append((None, None, int(df["shard"].iloc[0]), 1, None, int(every.sum()), int((every > 0).sum()), int(stays.sum())))
        out.append((None, None, int(df["shard"].iloc[0]), 0, None, 0, int((stays > 0).sum()), 0))
    out = pd.DataFrame(out, columns=["blob", "left_out", "shard", "n", "body", "tokens", "kinds", "staying"])
    return out.astype({"blob": "Int64", "left_out": "boolean"})


class Estimates:
    """Estimates of all orders for each token of a blob under counts ``which`` (0: all training documents, 1: those that stay)."""

    def __init__(self, grams: Grams, answers: pd.DataFrame, which: int, tokens: int, kinds: int, texts: int):
        counts = []
        for n, keys in enumerate(grams.keys, 1):
            bodies = answers["body"][answers["n"] == n]
            total = np.concatenate([_numbers(_apart(b, 2)[which], np.int64) for b in bodies])
            _, at = np.unique(keys, return_inverse=True)
            counts.append(total[at])
        self.count = counts[0]
        self.uniform = 1.0 / (kinds + 1)
        self.shares, longest, context = [], np.zeros(len(counts[0]), dtype=np.int64), np.full(len(counts[0]), tokens, dtype=np.int64)
        bucket = np.zeros(len(counts[0]), dtype=np.int64)
        for n, c in enumerate(counts, 1):
            if n > 1:
                context = grams.previous(counts[n - 2], texts)
            known = context > 0
            self.shares.append(np.divide(c, context, out=np.zeros(len(c)), where=known))
            longest[known] = n
            bucket[known] = np.minimum(TOP_BUCKET, np.frexp(context[known].astype(np.float64))[1] - 1)
        self.longest, self.bucket = longest, bucket


_CELLS = "longest int, bucket int, steps array<int>, n long, logs array<double>"


def _cells(key: tuple, packed: pd.DataFrame, answers: pd.DataFrame, order: int, totals: dict[str, int]) -> pd.DataFrame:
    """Tokens of a left-out blob counted by bucket and by the ratios of their estimates to the uniform share."""
    made = []
    for b in packed.itertuples(index=False):
        answers = answers.sort_values(["n", "shard"])
        e = Estimates(Grams(b.sizes, b.body, order), answers, 1, totals["staying"], totals["staying_kinds"], totals["staying_texts"])
        with np.errstate(divide="ignore"):
            logs = np.log2(np.array(e.shares) / e.uniform)
        there = np.isfinite(logs)
        logs = np.where(there, logs, 0.0)
        steps = np.where(there, np.clip(np.floor(logs * GRID), -MIDDLE + 1, MIDDLE - 1) + MIDDLE, 0).astype(np.int64)
        code = e.longest * (TOP_BUCKET + 1) + e.bucket
        for s in steps:
            code = code * (2 * MIDDLE) + s
        _, first, at, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        sums = np.array([np.bincount(at, weights=x, minlength=len(n)) for x in logs])
        made += zip(e.longest[first].tolist(), e.bucket[first].tolist(), steps[:, first].T.tolist(), n.tolist(), sums.T.tolist())
    return pd.DataFrame(made, columns=["longest", "bucket", "steps", "n", "logs"])


def _maximised(ratios: np.ndarray, n: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Weights of the mixture for events ``ratios`` (a row each, a column per order) seen ``n`` times; the prior counts as one event."""
    weights = prior.copy()
    for _ in range(ROUNDS):
        part = ratios * weights
        part *= (n / part.sum(axis=1))[:, None]
        new = (part.sum(axis=0) + prior) / (n.sum() + 1.0)
        if np.abs(new - weights).max() < TOLERANCE:
            return new
        weights = new
    return weights


def _weights(df: pd.DataFrame) -> pd.DataFrame:
    """Weights per bucket (-1: pooled) of one order of the longest known context, lowest order first."""
    longest = int(df["longest"].iloc[0])
    n = df["n"].to_numpy(dtype=np.float64)
    steps, logs = np.array(df["steps"].tolist())[:, :longest], np.array(df["logs"].tolist())[:, :longest]
    ratios = np.hstack([np.ones((len(n), 1)), np.where(steps > 0, np.exp2(logs / n[:, None]), 0.0)])
    pooled = _maximised(ratios, n, np.full(longest + 1, 1.0 / (longest + 1)))
    out = [(longest, -1, pooled.tolist())]
    for bucket in np.unique(df["bucket"]):
        own = (df["bucket"] == bucket).to_numpy()
        out.append((longest, int(bucket), _maximised(ratios[own], n[own], pooled).tolist()))
    return pd.DataFrame(out, columns=["longest", "bucket", "weights"])


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(key: tuple, packed: pd.DataFrame, answers: pd.DataFrame, order: int, totals: dict[str, int], weights: np.ndarray) -> pd.DataFrame:
    made = []
    for b in packed.itertuples(index=False):
        answers = answers.sort_values(["n", "shard"])
        grams = Grams(b.sizes, b.body, order)
        e = Estimates(grams, answers, 0, totals["tokens"], totals["kinds"], totals["texts"])
        own = weights[e.longest, e.bucket]
        p = own[:, 0] * e.uniform
        for n, share in enumerate(e.shares, 1):
            p += own[:, n] * share
        base = (e.count + 0.1) / (totals["tokens"] + 0.1 * (totals["kinds"] + 1))
        add = lambda x: np.add.reduceat(x, grams.first)
        made.append(
            pd.DataFrame(
                {
                    "doc_id": np.asarray(b.ids),
                    "held_out": np.asarray(b.parts) == 0,
                    "n_tokens": grams.lengths,
                    "n_known": add((e.count > 0).astype(np.int64)),
                    "train_tokens": totals["tokens"],
                    "base_score": add(np.log10(base)),
                    "score": add(np.log10(p)),
                }
            )
        )
    return pd.concat(made) if made else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _table_of(weights: list, order: int) -> np.ndarray:
    """Weights by order of the longest known context and bucket."""
    out = np.zeros((order + 1, TOP_BUCKET + 1, order + 1))
    for longest in range(order + 1):
        out[longest, :, : longest + 1] = 1.0 / (longest + 1)
    for w in sorted(weights, key=lambda w: w["bucket"]):
        at = slice(None) if w["bucket"] < 0 else w["bucket"]
        out[w["longest"], at, : len(w["weights"])] = w["weights"]
    return out


def interpolated_scores(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigrams) and score (log10 probability of the text)."""
    packed = materialize(blobs(docs, id_col, text_col))
    size = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("s"), F.sum("taught").alias("t"), F.sum(F.when(F.col("left_out"), F.col("n"))).alias("o")).first()
    if size["s"] is None:
        return docs.sparkSession.createDataFrame([], _SCORES)
    shards = max(1, -(-size["s"] // SHARD_BYTES))
    answers = materialize(asked(packed, shards, order).groupBy("slot").applyInPandas(_answer, _ANSWERS))
    sums = answers.filter("blob is null").groupBy("n").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds"), F.sum("staying").alias("staying"))
    sums = {r["n"]: r for r in sums.collect()}
    texts = size["t"] or 0
    totals = {"tokens": sums[1]["tokens"], "kinds": sums[1]["kinds"], "texts": texts, "staying": sums[1]["staying"], "staying_kinds": sums[0]["kinds"], "staying_texts": texts - (size["o"] or 0)}
    answers = answers.filter("blob is not null").select("blob", "left_out", "shard", "n", "body")

    def cells(key: tuple, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        return _cells(key, own, got, order, totals)

    left = packed.filter("left_out").groupBy("blob").cogroup(answers.filter("left_out").groupBy("blob")).applyInPandas(cells, _CELLS)
    added = left.groupBy("longest", "bucket", "steps").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("logs")[i]) for i in range(order)]).alias("logs"))
    learned = added.groupBy("longest").applyInPandas(_weights, "longest int, bucket int, weights array<double>").collect()  # at most 32 buckets for each order
    weights = _table_of(learned, order)

    def score(key: tuple, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        return _score(key, own, got, order, totals, weights)

    scored = packed.groupBy("blob").cogroup(answers.groupBy("blob")).applyInPandas(score, _SCORES)
    return scored.select(unfilled("doc_id"), *scored.columns[1:])


def op11_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_scores(table(spark, sf_dir, "documents"))
