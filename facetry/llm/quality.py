"""Quality filter: perplexity under an interpolated modified Kneser-Ney model of trusted text, per language.

The model is over characters (UTF-16 units, white space runs as one space) with four-grams, so one gram is a 64-bit number whose
shifts are its contexts and lower orders. Trusted text is every labelled document of good quality that is not toxic; a fifth of it sets the threshold, the rest teaches.

1. Documents are dealt into blocks by id range. A pass over the texts keeps, per block and language, the distinct grams and how often
   trusted documents hold them.
2. Distinct grams with trusted counts (a plain aggregation) become log probabilities by window functions: orders four and three need
   only rows that share the two middle characters, orders two and one are small tables.
3. Sharded join: each block's grams, cut into shards by hash, meet the model's shard and leave with their log probabilities.
4. The block's texts (compressed on the way) meet the block's own part of the model and are scored: nobody holds the whole model.
5. Per language a quantile of the held-out trusted documents' log perplexity gives the threshold, from counts of narrow bins.

Defined results: null and blank texts consist of the end mark alone and are scored like others; a null language is a language of its own;
documents of a language without trusted text have no score, those of one without held-out text no threshold, and both are kept; rows without id are scored but never trusted; a repeated label counts
once, contradicting labels are not trusted; repeated rows are scored each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetry.llm.common import filled, materialize, table, uint64_mix, unfilled

BLOCK_BYTES = 16 << 20  # text per block
BLOB_BYTES = 4 << 20
BLOCKS_PER_LOOKUP = 32
SHARD_BYTES = 64 << 20  # text per shard of the model
LABEL_ROWS = 2_000_000  # as many trusted ids (16 bytes each) may be broadcast; more of them are joined by a shuffle
QUANTILE = 0.995
MARGIN = 0.25  # the threshold lies this share of (quantile - median) above the quantile
BIN = 0.001
NO_LANG = "?"
SLICE = 1 << 18  # characters handled at once
FOLDS = 5  # one trusted document in so many is held out to set the threshold, by hash of its text
OTHER, TEACH, HELD_OUT = 0, 1, 2
_BOS, _EOS = 1, 2


def _units(text: str | None) -> np.ndarray:
    body = " ".join(text.split()) if text else ""
    return np.concatenate([np.full(3, _BOS, np.uint64), np.frombuffer(body.encode("utf-16-le", "surrogatepass"), dtype="<u2").astype(np.uint64), np.full(1, _EOS, np.uint64)])


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed four-grams of all texts one after the other, and how many each text has."""
    parts = [_units(t) for t in texts]
    size = np.array([len(p) for p in parts])
    u = np.concatenate(parts)
    packed = u[:-3] << np.uint64(48) | u[1:-2] << np.uint64(32) | u[2:-1] << np.uint64(16) | u[3:]
    keep = np.ones(len(u), dtype=bool)
    for back in (1, 2, 3):
        keep[np.cumsum(size) - back] = False
    return packed[keep[:-3]], size - 3


def _sliced(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about SLICE characters."""
    a, filled = 0, 0
    for i, t in enumerate(texts):
        filled += len(t or "") + 4
        if filled >= SLICE:
            yield a, i + 1
            a, filled = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, weights=counts, minlength=len(unique)).astype(np.int64)


def prepared(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, h (hash of the text), lang, text, role and block of every row; bytes of all texts."""
    said = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("x")).filter("doc_id is not null and q = 1 and coalesce(x, 0) = 0")
    said = materialize(said.select("doc_id", F.lit(True).alias("trusted")))
    if said.count() <= LABEL_ROWS:
        said = F.broadcast(said)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    held_out = F.pmod(F.col("h"), F.lit(FOLDS)) == 0
    rows = rows.join(said, "doc_id", "left").withColumn("role", F.when(F.col("trusted").isNull(), F.lit(OTHER)).when(held_out, F.lit(HELD_OUT)).otherwise(F.lit(TEACH))).drop("trusted")
    stats = docs.agg(F.min(F.col("doc_id").cast("long")).alias("lo"), F.max(F.col("doc_id").cast("long")).alias("hi"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("s")).first()
    lo, hi, total = int(stats["lo"] or 0), int(stats["hi"] or 0), int(stats["s"] or 0)
    wanted = max(1, -(-total // BLOCK_BYTES))
    width = max(1, -(-(hi - lo + 1) // wanted))
    run = F.coalesce(F.expr(f"(doc_id - {lo}) div {width}"), F.col("h"))
    # ids that crowd in a few ranges: every range is split so that the fullest fits
    most = docs.select(F.expr(f"(cast(doc_id as bigint) - {lo}) div {width}").alias("r"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("s")).filter("r is not null").groupBy("r").agg(F.sum("s").alias("s")).agg(F.max("s")).first()[0] or 0
    parts = max(1, -(-int(most) // (4 * BLOCK_BYTES)))
    return rows.withColumn("block", F.xxhash64(run, F.pmod(F.col("h"), F.lit(parts)))), total


GRAMS = "block long, lang string, shard int, keys array<bigint>, counts array<bigint>"


def block_grams(rows: DataFrame, shards: int) -> DataFrame:
    """Distinct grams of each block and language with their trusted counts, in shards by hash of the gram."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = {}

        def out() -> pd.DataFrame:
            made = []
            for (block, lang), (keys, counts) in have.items():
                shard = (uint64_mix(keys) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[order], np.arange(shards + 1))
                for s in range(shards):
                    part = order[cut[s] : cut[s + 1]]
                    if len(part):
                        made.append((block, lang, s, keys[part].astype(np.int64), counts[part]))
            have.clear()
            return pd.DataFrame(made, columns=["block", "lang", "shard", "keys", "counts"])

        for df in batches:
            for (block, lang, role), g in df.groupby(["block", "lang", "role"]):
                texts = g["text"].tolist()
                for a, b in _sliced(texts):
                    keys, _ = grams(texts[a:b])
                    keys, counts = np.unique(keys, return_counts=True)
                    old = have.get((block, lang), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                    have[block, lang] = _merged(np.concatenate([old[0], keys]), np.concatenate([old[1], counts if role == TEACH else np.zeros(len(keys), np.int64)]))
            if sum(len(k) for k, _ in have.values()) > 4_000_000:
                yield out()
        if have:
            yield out()

    return rows.select("block", "lang", "role", "text").mapInPandas(run, GRAMS)


def _discounts(counts: DataFrame, count: str) -> DataFrame:
    """Discounts d1, d2, d3 per language from counts of counts."""
    n = lambda k: F.sum((F.col(count) == k).cast("double"))
    t = counts.groupBy("lang").agg(*[n(k).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    raw = lambda k: k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
    d = lambda k: F.when(raw(k).isNull(), F.lit(0.75 * k)).otherwise(F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), raw(k))))
    return t.select("lang", *[d(k).alias(f"d{k}") for k in (1, 2, 3)])


def _discount(c: Column) -> Column:
    return F.when(c <= 0, F.lit(0.0)).when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))


def _interpolated(df: DataFrame, count: str, context: list[str], once: Column, share: str, back: str) -> DataFrame:
    """``share``: discounted probability of the gram in its context; ``back``: weight left for the lower order (1 in unseen contexts)."""
    w = Window.partitionBy(*context)
    c = F.when(once, F.col(count)).otherwise(F.lit(0))
    total = F.sum(c).over(w)
    left = F.sum(F.when(once, _discount(F.col(count))).otherwise(F.lit(0.0))).over(w)
    df = df.withColumn("_t", total).withColumn("_l", left)
    value = F.when(F.col("_t") > 0, (F.col(count) - _discount(F.col(count))) / F.col("_t")).otherwise(F.lit(0.0))
    return df.withColumn(share, value).withColumn(back, F.when(F.col("_t") > 0, F.col("_l") / F.col("_t")).otherwise(F.lit(1.0))).drop("_t", "_l")


def model(counted: DataFrame) -> DataFrame:
    """(lang, key, logp) of every gram in ``counted`` (a written table of lang, key, n: how often trusted text holds it).

    Languages without trusted text are left out.
    """
    bits = lambda shift, width: F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << width) - 1))
    known = counted.groupBy("lang").agg(F.sum("n").alias("all")).filter(F.col("all") > 0).select("lang")
    rows = counted.join(known, "lang").select("lang", "key", "n", bits(48, 16).alias("a"), bits(16, 32).alias("bc"), bits(16, 16).alias("c"), bits(0, 16).alias("d"))
    rows = rows.join(_discounts(counted, "n"), "lang").repartition("lang", "bc")
    rows = _interpolated(rows, "n", ["lang", "bc", "a"], F.lit(True), "s4", "b4").drop("d1", "d2", "d3")
    by = Window.partitionBy("lang", "bc", "d")
    rows = rows.withColumn("n3", F.sum((F.col("n") > 0).cast("long")).over(by)).withColumn("first", F.row_number().over(by.orderBy("a")) == 1)
    rows = materialize(rows)
    third = rows.filter("first and n3 > 0")
    rows = rows.join(_discounts(third, "n3"), "lang").repartition("lang", "bc")
    rows = _interpolated(rows, "n3", ["lang", "bc"], F.col("first"), "s3", "b3").drop("d1", "d2", "d3")
    second = third.groupBy("lang", "c", "d").agg(F.count(F.lit(1)).alias("n2"))
    pairs = rows.select("lang", "c", "d").distinct().join(second, ["lang", "c", "d"], "left").fillna(0, ["n2"])
    pairs = materialize(pairs)
    seen = pairs.filter("n2 > 0")
    first = seen.groupBy("lang", "d").agg(F.count(F.lit(1)).alias("n1"))
    every = materialize(pairs.select("lang", "d").distinct().join(first, ["lang", "d"], "left").fillna(0, ["n1"]))
    letters = every.filter("n1 > 0").groupBy("lang").agg((F.count(F.lit(1)) + 1).alias("letters"))
    ones = _interpolated(every.join(_discounts(every.filter("n1 > 0"), "n1"), "lang"), "n1", ["lang"], F.lit(True), "s1", "b1").join(letters, "lang")
    ones = ones.select("lang", "d", (F.col("s1") + F.col("b1") / F.col("letters")).alias("p1"))
    twos = _interpolated(pairs.join(_discounts(seen, "n2"), "lang"), "n2", ["lang", "c"], F.lit(True), "s2", "b2").join(ones, ["lang", "d"])
    twos = twos.select("lang", "c", "d", (F.col("s2") + F.col("b2") * F.col("p1")).alias("p2"))
    p = F.col("s4") + F.col("b4") * (F.col("s3") + F.col("b3") * F.col("p2"))
    return rows.join(twos, ["lang", "c", "d"]).select("lang", "key", F.log(p).cast("float").alias("logp"))


SCORES = "doc_id long, h long, lang string, role int, n_units long, logp double"
_PACKED = "block long, ids array<bigint>, hs array<bigint>, langs array<string>, roles array<int>, sizes array<int>, body binary"


def _packed(rows: DataFrame) -> DataFrame:
    """Rows of a block gathered into compressed pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        z = zstandard.ZstdCompressor(level=6)
        for df in batches:
            made = []
            for block, g in df.groupby("block"):
                ids = g["doc_id"].tolist()
                data = [None if t is None else t.encode("utf-8", "surrogatepass") for t in g["text"]]
                size = np.cumsum([len(x or b"") for x in data]) // BLOB_BYTES
                for s in np.unique(size):
                    at = np.flatnonzero(size == s)
                    pick = lambda xs: [xs[i] for i in at]
                    made.append((block, pick(ids), pick(g["h"].tolist()), pick(g["lang"].tolist()), pick(g["role"].tolist()), [-1 if x is None else len(x) for x in pick(data)], z.compress(b"".join(x or b"" for x in pick(data)))))
            yield pd.DataFrame(made, columns=["block", "ids", "hs", "langs", "roles", "sizes", "body"])

    return rows.withColumn("doc_id", filled("doc_id")).mapInPandas(run, _PACKED)


def _score(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    import zstandard

    z, by_lang = zstandard.ZstdDecompressor(), {}
    for lang, g in known.groupby("lang"):
        keys, logp = np.concatenate([k.view(np.uint64) for k in map(np.asarray, g["keys"])]), np.concatenate(list(map(np.asarray, g["logps"]))).astype(np.float64)
        order = np.argsort(keys)
        by_lang[lang] = keys[order], logp[order]
    out = []
    for ids, hs, langs, roles, sizes, body in zip(texts["ids"], texts["hs"], texts["langs"], texts["roles"], texts["sizes"], texts["body"]):
        data, pos, docs = z.decompress(body), 0, []
        for s in sizes:
            docs.append(None if s < 0 else data[pos : pos + s].decode("utf-8", "surrogatepass"))
            pos += max(s, 0)
        langs = np.asarray(langs, dtype=object)
        for lang in dict.fromkeys(langs.tolist()):
            at = np.flatnonzero(langs == lang)
            own = [docs[i] for i in at]
            for a, b in _sliced(own):
                packed, size = grams(own[a:b])
                total = np.full(b - a, np.nan)
                if lang in by_lang:
                    keys, logp = by_lang[lang]
                    total = np.add.reduceat(logp[np.searchsorted(keys, packed)], np.cumsum(size) - size)
                out += [(ids[i], hs[i], lang, int(roles[i]), int(n), t) for i, n, t in zip(at[a:b], size, total)]
    return pd.DataFrame(out, columns=["doc_id", "h", "lang", "role", "n_units", "logp"])


def _look_up(asked: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
    if not len(part):  # a language without a model
        return pd.DataFrame(columns=["block", "lang", "keys", "logps"])
    known, logp = np.asarray(part["model_keys"].iloc[0]), np.asarray(part["model_logps"].iloc[0])
    found = [logp[np.searchsorted(known, np.asarray(k))] for k in asked["keys"]]
    return pd.DataFrame({"block": asked["block"], "lang": asked["lang"], "keys": asked["keys"], "logps": found})


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, h, lang, role, n_units and logp (sum of log probabilities; null without a model) of every row."""
    rows, total = prepared(docs, labels)
    shards = int(min(4096, max(16, total // SHARD_BYTES)))
    held = materialize(block_grams(rows, shards))
    counted = held.select("lang", F.explode(F.arrays_zip("keys", "counts")).alias("g")).groupBy("lang", F.col("g.keys").alias("key")).agg(F.sum("g.counts").alias("n"))

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series((uint64_mix(keys.to_numpy().view(np.uint64)) % np.uint64(shards)).astype(np.int32))

    placed = model(materialize(counted)).withColumn("shard", shard("key"))
    parts = placed.groupBy("lang", "shard").agg(F.array_sort(F.collect_list(F.struct("key", "logp"))).alias("m"))
    parts = materialize(parts.select("lang", "shard", F.col("m.key").alias("model_keys"), F.col("m.logp").alias("model_logps")))

    # the model's part meets the blocks' parts in groups of a bounded number of blocks
    salts = max(1, -(-total // (BLOCK_BYTES * BLOCKS_PER_LOOKUP)))
    salted = parts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    asked = held.select("block", "lang", "shard", "keys", F.pmod("block", F.lit(salts)).cast("int").alias("salt"))
    at = ["lang", "shard", "salt"]
    known = asked.groupBy(*at).cogroup(salted.groupBy(*at)).applyInPandas(_look_up, "block long, lang string, keys array<bigint>, logps array<float>")
    scored = _packed(rows).groupBy("block").cogroup(known.groupBy("block")).applyInPandas(_score, SCORES)
    return scored.select(unfilled("doc_id"), *scored.columns[1:])


def thresholds(scored: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """(lang, threshold) of the log perplexity of held-out trusted documents, from counts of bins of width ``BIN``."""
    bins = scored.filter((F.col("role") == HELD_OUT) & F.col("logp").isNotNull()).select("lang", F.floor(-F.col("logp") / F.col("n_units") / BIN).alias("bin"))
    bins = bins.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("bin"))
    share = F.sum("n").over(Window.partitionBy("lang"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, (F.col("bin") + 1) * BIN))
    found = bins.withColumn("upto", upto).withColumn("all", share).groupBy("lang").agg(at(quantile).alias("top"), at(0.5).alias("mid"))
    return found.select("lang", (F.col("top") + margin * (F.col("top") - F.col("mid"))).alias("threshold"))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, h, lang, n_units, log_perplexity, threshold and kept of every row (a written table)."""
    scored = materialize(scores(docs, labels))
    out = scored.join(thresholds(scored), "lang", "left").withColumn("log_perplexity", -F.col("logp") / F.col("n_units"))
    kept = F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(True))
    return materialize(out.select("doc_id", "h", F.when(F.col("lang") != NO_LANG, F.col("lang")).alias("lang"), "n_units", "log_perplexity", "threshold", kept.alias("kept")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "lang", "n_units", F.round("log_perplexity", 6).alias("log_perplexity"), F.round("threshold", 6).alias("threshold"), "kept")
