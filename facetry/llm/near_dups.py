"""MinHash near-duplicates: universal hash minima, banding, signature and exact verification, connected components.

1. Each text becomes the set of its distinct word shingles (64-bit hashes), a fingerprint of that set and ``HASHES`` minima of universal
   hash functions. Texts with equal sets form a class that one document stands for, so exact copies never meet.
2. Bands of ``ROWS`` minima are bucket keys; only buckets with several classes are kept.
3. Each class is first compared with the most popular class of its buckets (the one that shares most buckets with others): by length, by
   signature, then exactly on the full sets. That ties a group of copies together with as many pairs as members.
4. Buckets that still hold several components connect classes into clusters. These are compared inside tasks, block by block on full sets,
   and only a spanning forest of the links found leaves a task. So every pair of a bucket ends up in one component or is
   compared exactly, and pairs of a group are never listed.
5. Links become components by alternating large-star and small-star until nothing changes.

Bands of four minima out of 128 miss a pair at similarity 0.85 with a chance below 1e-10, at 0.8 below 1e-7; the signature test
of step 3 only decides which links are found early.

Words are separated by ASCII white space; ASCII letters are lower-cased. Defined results: null, empty and blank texts have an empty set and
are linked with nothing; a text with fewer words than a shingle has its whole word sequence as the one shingle; rows with the same id
are one node of the graph; rows without id get the component of the documents with an equal set, or null; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import filled, materialize, table, uint64_mix, unfilled

HASHES = 128
ROWS = 4
SLACK = 5.0
VERIFY_ROWS = 128  # texts that meet one text in a verification group
BLOCK = 400  # classes per block when whole clusters are compared
SEED = 7

_POWER = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """64-bit hashes of the distinct ``k``-word shingles of a text, sorted."""

    def __init__(self, k: int):
        rng = np.random.default_rng(SEED)
        self.k = k
        self.byte = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.place = rng.integers(0, 2**64, k, dtype=np.uint64) | np.uint64(1)
        self.inverse = np.uint64(pow(int(_POWER), -1, 2**64))
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        ramp = lambda base: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, base, dtype=np.uint64))])
        self.up, self.down = ramp(_POWER), ramp(self.inverse)

    def words(self, text: str | None) -> np.ndarray:
        """One hash per word: a sum over its bytes of random numbers times powers of an odd constant, then mixed."""
        parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not parts:
            return np.zeros(0, dtype=np.uint64)
        raw = np.frombuffer(b" ".join(parts), dtype=np.uint8)
        if len(raw) > len(self.up):
            self._grow(2 * len(raw))
        value = self.byte[raw] * self.up[: len(raw)]
        gaps = np.flatnonzero(raw == 0x20)
        value[gaps] = 0
        total = np.cumsum(value)
        start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
        before = np.concatenate([[np.uint64(0)], total[gaps]])
        return uint64_mix((total[end - 1] - before) * self.down[start] + (end - start).astype(np.uint64))

    def __call__(self, text: str | None) -> np.ndarray:
        w = self.words(text)
        if not len(w):
            return w
        n = max(1, len(w) - self.k + 1)
        out = np.zeros(n, dtype=np.uint64)
        for j in range(min(self.k, len(w))):
            out += uint64_mix(w[j : j + n] + self.place[j]) * self.place[j]
        return np.unique(uint64_mix(out + np.uint64(min(self.k, len(w)))))


def universal_family(hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + 1)
    return rng.integers(0, 2**64, hashes, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**64, hashes, dtype=np.uint64)


def minima(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest value (upper 32 bits of a * x + b) per hash function."""
    a, b = family
    best = np.full(len(a), 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(shingles), 1024):
        best = np.minimum(best, (shingles[i : i + 1024, None] * a + b).min(axis=0))
    return (best >> np.uint64(32)).astype(np.uint32)


def sketch(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (hash of the text), n (set size), f1 and f2 (fingerprint of the set), sig (minima as bytes; null for an empty set)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, family = Shingler(k), universal_family()
        for df in batches:
            rows = []
            for text in df["text"]:
                s = shingle(text)
                m = uint64_mix(s)
                f1, f2 = int(m.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(uint64_mix(m + _POWER))) if len(s) else 0
                rows.append((len(s), f1 - 2**64 if f1 >= 2**63 else f1, f2 - 2**64 if f2 >= 2**63 else f2, minima(s, family).tobytes() if len(s) else None))
            out = pd.DataFrame(rows, columns=["n", "f1", "f2", "sig"])
            out.insert(0, "h", df["h"].to_numpy())
            out.insert(0, "doc_id", df["doc_id"].to_numpy())
            yield out

    made = docs.select(filled(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, h long, n long, f1 long, f2 long, sig binary")
    return made.select(unfilled("doc_id"), "h", "n", "f1", "f2", "sig")


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, node) per band of every node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = HASHES // ROWS
        salt = uint64_mix(np.arange(1, bands + 1, dtype=np.uint64))
        for df in batches:
            if not len(df):
                continue
            sig = np.frombuffer(b"".join(df["sig"]), dtype=np.uint32).reshape(len(df), bands, ROWS).astype(np.uint64)
            key = np.broadcast_to(salt, (len(df), bands)).copy()
            for j in range(ROWS):
                key = uint64_mix(key ^ (sig[:, :, j] + np.uint64(j << 40))) + _POWER
            yield pd.DataFrame({"key": key.astype(np.int64).ravel(), "node": np.repeat(df["node"].to_numpy(), bands)})

    return nodes.select("node", "sig").mapInPandas(run, "key long, node long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b), the component being its smallest node; alternating large-star and small-star."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    state = None
    while True:
        # large star: each node ties its larger neighbours to the smallest node it sees
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = materialize(large)
        # small star: each node ties itself and its smaller neighbours to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        edges = materialize(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sets reach ``den * intersection >= num * union``."""
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"))
    least = max(0.0, num / den - SLACK * (num / den * (1 - num / den) / HASHES) ** 0.5)

    @F.pandas_udf("double")
    def agreement(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        read = lambda s: np.frombuffer(b"".join(s), dtype=np.uint32).reshape(len(s), HASHES)
        return pd.Series((read(x) == read(y)).mean(axis=1))

    near = pairs.join(side("a"), "a").filter(F.col("n_a") > 0).join(side("b"), "b")
    near = near.filter(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num).withColumn("est", agreement("sig_a", "sig_b"))
    near = materialize(near.filter(F.col("est") >= least).select("a", "b"))
    # a text may be compared with any number of others: cut that list into parts that fit in one task
    parts = near.groupBy("a").count().select("a", F.ceil(F.col("count") / VERIFY_ROWS).cast("long").alias("parts"))
    dealt = near.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    centers = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    of = lambda name: texts.select(F.col("node").alias(name), "text")
    rows = dealt.join(of("b"), "b").select("a", "part", "b", "text").unionByName(centers.join(of("a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text"))

    def test(df: pd.DataFrame) -> pd.DataFrame:
        shingle = Shingler(k)
        own = [shingle(t) for t in df["text"][df["b"].isna()]]
        out = []
        for b, text in zip(df["b"], df["text"]):
            if not pd.isna(b):
                s = shingle(text)
                for o in own:
                    both = len(np.intersect1d(s, o, assume_unique=True))
                    if both * den >= num * (len(s) + len(o) - both):
                        out.append(int(b))
                        break
        return pd.DataFrame({"a": np.full(len(out), df["a"].iloc[0], dtype=np.int64), "b": np.array(out, dtype=np.int64)})

    return rows.groupBy("a", "part").applyInPandas(test, "a long, b long")


def _links_between(df: pd.DataFrame, k: int, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between different components of one block (side 0) or of two blocks (sides 0 and 1)."""
    shingle = Shingler(k)
    sets = [shingle(t) for t in df["text"]]
    size = np.array([len(s) for s in sets], dtype=np.int64)
    _, col, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = often[col] > 1
    new = np.cumsum(often > 1) - 1
    row, col, width = row[shared], new[col[shared]], int((often > 1).sum())
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    left = np.flatnonzero(df["side"].to_numpy() == 0)
    right = np.flatnonzero(df["side"].to_numpy() == 1)
    right = right if len(right) else left
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    for first in range(0, width, 4096):
        lo, hi = np.searchsorted(col, [first, first + 4096])
        has = np.zeros((len(sets), min(4096, width - first)), dtype=np.float32)
        has[row[lo:hi], col[lo:hi] - first] = 1
        both += has[left] @ has[right].T
    both = both.astype(np.int64)  # whole numbers below 2 ** 24, so exact
    component = df["component"].to_numpy()
    linked = (both * den >= num * (size[left][:, None] + size[right][None] - both)) & (component[left][:, None] != component[right][None])
    root = {c: c for c in component.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    node, out = df["node"].to_numpy(), []
    for i, j in np.argwhere(linked):
        x, y = find(component[left[i]]), find(component[right[j]])
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(node[left[i]]), int(node[right[j]])))
    return out


def _block_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, k: int, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different components among classes that buckets connect.

    Classes that share a mixed bucket, directly or through others, form a cluster. It is cut into blocks of about ``block`` classes of
    one length band (sets of sizes beyond the threshold's ratio cannot be linked), big components into blocks of their own.
    Block pairs are compared inside tasks on full sets; pairs within one component need no comparison.
    """
    lead = members.groupBy("key").agg(F.min("node").alias("a"))
    cluster = components(members.join(lead, "key").select("a", F.col("node").alias("b")).filter("a != b"))
    band = F.floor(F.log("n") / (F.log(F.lit(den / num)) * (1 + 1e-9))).cast("long")  # sizes at exactly the ratio stay within one band
    at = members.select("node", "component").distinct().join(cluster.withColumnRenamed("component", "cluster"), "node").join(nodes.select("node", "n"), "node")
    at = materialize(at.select("node", "component", "cluster", band.alias("band")))
    sizes = at.groupBy("cluster", "band", "component").agg(F.count(F.lit(1)).alias("s"))
    small = sizes.filter(F.col("s") < block).groupBy("cluster", "band").agg(F.ceil(F.sum("s") / block).cast("long").alias("small_parts"))
    sizes = sizes.join(small, ["cluster", "band"], "left")
    big = F.col("s") >= block
    at = at.join(sizes, ["cluster", "band", "component"]).select(
        "node",
        "component",
        "cluster",
        "band",
        F.when(big, F.col("component")).alias("whole"),
        F.when(big, F.pmod(F.xxhash64("node"), F.ceil(F.col("s") / block).cast("long"))).otherwise(F.pmod(F.xxhash64("component"), F.col("small_parts"))).alias("part"),
    )
    at = materialize(at.withColumn("block", F.concat_ws("/", "cluster", "band", F.coalesce(F.col("whole").cast("string"), F.lit("-")), "part")))
    blocks = at.select("cluster", "band", "whole", "block").distinct()
    other = blocks.select("cluster", F.col("band").alias("to"), F.col("whole").alias("whole2"), F.col("block").alias("block2"))
    near = blocks.withColumn("to", F.explode(F.array("band", F.col("band") + 1))).join(other, ["cluster", "to"])
    near = near.filter((F.col("band") != F.col("to")) | (F.col("block") <= F.col("block2"))).filter(~F.coalesce(F.col("whole") == F.col("whole2"), F.lit(False)))
    near = materialize(near.select("block", "block2", F.concat_ws("|", "block", "block2").alias("pair")))
    first = at.join(near, "block").select("pair", F.lit(0).alias("side"), "node", "component")
    second = at.join(near.filter("block != block2").select(F.col("block2").alias("block"), "pair"), "block").select("pair", F.lit(1).alias("side"), "node", "component")
    rows = first.unionByName(second).join(texts, "node")

    def test(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_links_between(df, k, num, den), columns=["a", "b"], dtype=np.int64)

    return rows.groupBy("pair").applyInPandas(test, "a long, b long")


def linked_components(nodes: DataFrame, docs: DataFrame, k: int, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """(node, component) of nodes that have a link. ``nodes``: node, n, sig; ``docs``: doc_id, text."""
    met = buckets(nodes)
    full = met.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = materialize(met.join(full, "key"))
    popularity = met.groupBy("node").agg(F.sum("c").alias("pop"))
    met = materialize(met.join(popularity, "node").select("key", "node", "pop"))
    texts = materialize(docs.join(popularity.select(F.col("node").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("node"), "text"))
    best = met.groupBy("key").agg(F.max(F.struct("pop", "node")).alias("top"))
    # one comparison per class to begin with: the most popular class of all its buckets
    first = met.join(best, "key").filter("node != top.node").groupBy("node").agg(F.max("top").alias("top"))
    first = first.select(F.col("top.node").alias("a"), F.col("node").alias("b"))
    links = materialize(_verified(first, nodes, texts, k, num, den))
    comp = materialize(components(links))
    at = met.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("key")
    members = materialize(at.join(mixed, "key").select("key", "node", "component"))
    if not members.head(1):
        return comp
    more = materialize(_block_links(members, nodes, texts, k, num, den, block))
    return materialize(components(links.unionByName(more))) if more.head(1) else comp


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, h (hash of the text), n_shingles, component_id and kept."""
    made = materialize(sketch(docs, k, id_col, text_col))
    key = ["f1", "f2", "n"]
    classes = materialize(made.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")).filter("node is not null"))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    comp = linked_components(classes, plain, k, num, den, block)
    named = classes.select(*key, "node").join(comp, "node", "left").select(*key, F.coalesce("component", "node").alias("component_id"))
    out = made.select("doc_id", "h", *key).join(named, key, "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100).drop("h")
