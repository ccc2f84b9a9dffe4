"""Trie of conversation prefixes from sorted conversations: intervals by range-minimum over common-prefix lengths.

1. A turn becomes a digest of (role, text); a conversation the digests of its turns in order. Conversations are sorted by that key and id
   (range partitions), so the members of every trie node lie side by side.
2. Each block of ``BLOCK`` sorted rows gets the lengths of common prefixes of neighbours and a sparse table of their range minima. Every
   distinct prefix of the block is a candidate that finds its extent to the left and to the right by binary search in that
   table, independently of all others. Sums over a node's subtree are differences of running sums in the order of (left end, depth).
3. Nodes strictly inside a block are complete. Nodes that touch a block's edge are at most the prefixes of its first and last row; their
   parts are added up by prefix, and subtree sums among them come from running sums over the same order.
4. Member ids of a node that end there are hashed where they lie, for edge nodes as a stream of sorted runs.

No node's members and no node's children ever meet in one task; a hot first turn or thousands of copies of a conversation are just
many blocks with the same edge node. Only the final hash of one node's ids runs through one task, as SHA-256 needs the bytes in
order: in runs, with constant memory.

Defined results: null role or text count as empty, null turns come first, equal turn numbers are ordered by role and text; rows without
conversation id are left out; a conversation with no turn left ends at the root; an empty table gives no rows; other columns are
ignored. A conversation's digests (16 bytes a turn) and sizes have to fit in a row, its texts need not.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetry.llm.common import materialize, table
from facetry.operators.scale import running

GROUP = 5
HEADS = 9
BLOCK = 8_192
ROWS_PER_RANGE = 16_384
DIGEST = 16
EMPTY = hashlib.sha256().hexdigest()


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (digest, bytes of the text) in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    one = F.struct(at.alias("at"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    own = rows.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return own.select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["bytes"].alias("bytes"))).alias("turns"))


def spliced(own: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """Every conversation with its first h turns replaced by those of the first of its group; h = crc32(id) modulo ``heads``."""
    own = materialize(own)
    first = own.select(F.col("conv_id").alias("_first"), F.slice("turns", 1, heads - 1).alias("_head")).filter(F.col("_first") % group == 0)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    rows = own.withColumn("_first", F.col("conv_id") - F.col("conv_id") % group).withColumn("_h", h).join(first, "_first", "left")
    head = F.coalesce(F.expr("slice(_head, 1, _h)"), F.expr("slice(turns, 1, 0)"))
    return rows.select("conv_id", F.concat(head, F.expr("slice(turns, _h + 1, greatest(size(turns) - _h, 0))")).alias("turns"))


class SparseTable:
    """Range minima over ``values`` for any range in two reads; searches run for all queries at once."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > (1 << (len(self.levels) - 1)):
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))
        self.size = len(values)

    def rightmost(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Largest r with minimum(start + 1 .. r) >= least."""
        r = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 1 << k
            inside = r + step < self.size
            ok = inside & (level[np.where(inside, np.minimum(r + 1, len(level) - 1), 0)] >= least)
            r = np.where(ok, r + step, r)
        return r

    def leftmost(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest l with minimum(l + 1 .. start) >= least."""
        x = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[k], 1 << k
            inside = x - step >= 0
            ok = inside & (level[np.where(inside, np.minimum(x - step + 1, len(level) - 1), 0)] >= least)
            x = np.where(ok, x - step, x)
        return x


def common_prefixes(keys: list[bytes]) -> np.ndarray:
    """Turns that each row shares with the row before; -1 for the first."""
    out = np.full(len(keys), -1, dtype=np.int64)
    for i in range(1, len(keys)):
        a, b = keys[i - 1], keys[i]
        n = min(len(a), len(b)) // DIGEST
        if a[: n * DIGEST] == b[: n * DIGEST]:
            out[i] = n
            continue
        x, y = (np.frombuffer(k, dtype=f"V{DIGEST}", count=n) for k in (a, b))
        out[i] = int(np.argmax(x != y))
    return out


def _digests(key: bytes) -> list[bytes]:
    """Digest of every prefix of ``key``, the empty one first."""
    h, out = hashlib.md5(), []
    out.append(h.digest())
    for i in range(0, len(key), DIGEST):
        h.update(key[i : i + DIGEST])
        out.append(h.digest())
    return out


_NODES = (
    "edge boolean, block long, l int, r int, depth long, prefix binary, parent binary, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends_sha256 string, ends binary"
)


def _block(block: int, ids: np.ndarray, keys: list[bytes], sizes: list[np.ndarray]) -> pd.DataFrame:
    """Nodes of one block of sorted rows. Edge nodes hold the sums of the complete nodes below them in this block."""
    n = len(keys)
    size = np.array([len(k) // DIGEST for k in keys], dtype=np.int64)
    lcp = common_prefixes(keys)
    ranges = SparseTable(lcp)
    new = size - lcp  # prefixes that no row before has; a copy has none
    begin = np.concatenate([[0], np.cumsum(new)])
    row = np.repeat(np.arange(n), new)
    depth = np.arange(begin[-1]) - begin[row] + lcp[row] + 1
    left, right = ranges.leftmost(row, depth), ranges.rightmost(row, depth)
    # the parent holds the prefix shorter by a turn: the same row's, or the one where that prefix begins
    up = np.arange(begin[-1]) - 1
    first = np.flatnonzero((depth == lcp[row] + 1) & (depth > 0))
    at = ranges.leftmost(row[first], depth[first] - 1)
    up[first] = begin[at] + depth[first] - 1 - (lcp[at] + 1)
    up[depth == 0] = -1
    edge = (left == 0) | (right == n - 1)
    members = right - left + 1
    smallest = _smallest(ids, left, right)
    children = np.bincount(up[~edge & (up >= 0)], minlength=len(up))
    nbytes = np.concatenate([np.concatenate([[0], s])[lcp[i] + 1 :] for i, s in enumerate(sizes)]).astype(np.int64)
    leaf = ~edge & (children == 0)
    saved = np.where(edge, 0, (members - 1) * nbytes)
    below = begin[right + 1]  # nodes of the subtree are those up to here in this order
    total = lambda x: (lambda c: c[below] - c[: len(x)])(np.concatenate([[0], np.cumsum(x)]))
    # rows that end at a node are sorted before those that go on: the run of rows equal to its first one
    change = np.flatnonzero(np.concatenate([(lcp[1:] != size[1:]) | (lcp[1:] != size[:-1]), [True]]))
    stop = change[np.searchsorted(change, left)]
    shas, ends = [None] * len(up), [None] * len(up)
    for j in np.flatnonzero(~edge).tolist():
        shas[j] = EMPTY
    for j in np.flatnonzero(size[left] == depth).tolist():
        text = ",".join(map(str, ids[left[j] : stop[j] + 1].tolist())).encode()
        if edge[j]:
            ends[j] = zlib.compress(text, 1)
        else:
            shas[j] = hashlib.sha256(text).hexdigest()
    prefix, parent = [None] * len(up), [None] * len(up)
    names = (_digests(keys[0]), _digests(keys[-1]))
    for j in np.flatnonzero(edge).tolist():
        own = names[0] if left[j] == 0 else names[1]
        prefix[j] = own[depth[j]]
        parent[j] = own[depth[j] - 1] if depth[j] else None
    for j in np.flatnonzero(~edge).tolist():
        if edge[up[j]]:
            parent[j] = prefix[up[j]]
    out = pd.DataFrame(
        {
            "edge": edge,
            "block": block,
            "l": left.astype(np.int32),
            "r": right.astype(np.int32),
            "depth": depth,
            "prefix": prefix,
            "parent": parent,
            "conv_id": smallest,
            "parent_conv_id": pd.array(np.where(up >= 0, smallest[up], 0), dtype="Int64"),
            "n_convs": members,
            "n_children": children,
            "n_leaves": total(leaf),
            "saved_tokens": total(saved),
            "bytes": nbytes,
            "ends_sha256": shas,
            "ends": ends,
        }
    )
    out.loc[out["parent"].notna() | (up < 0), "parent_conv_id"] = pd.NA
    return out


def _smallest(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Minimum of ``ids`` over each range, by a sparse table."""
    levels = SparseTable(ids).levels
    k = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    out = np.empty(len(left), dtype=np.int64)
    for level in np.unique(k):
        at = k == level
        out[at] = np.minimum(levels[level][left[at]], levels[level][right[at] - (1 << int(level)) + 1])
    return out


def block_nodes(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes of every block of the sorted ``rows`` (conv_id, key, sizes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for df in batches:
            for a in range(0, len(df), block):
                part = df.iloc[a : a + block]
                yield _block(number, part["conv_id"].to_numpy(), [bytes(k) for k in part["key"]], [np.asarray(s, dtype=np.int64) for s in part["sizes"]])
                number += 1

    return rows.mapInPandas(run, _NODES)


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over the runs of ids of each prefix, which come in order."""
    prefix, h = None, hashlib.sha256()
    for df in batches:
        out = []
        for p, body in zip(df["prefix"], df["ends"]):
            if p != prefix:
                if prefix is not None:
                    out.append((prefix, h.hexdigest()))
                prefix, h = p, hashlib.sha256()
            else:
                h.update(b",")
            h.update(zlib.decompress(body))
        yield pd.DataFrame(out, columns=["prefix", "sha"])
    if prefix is not None:
        yield pd.DataFrame([(prefix, h.hexdigest())], columns=["prefix", "sha"])


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(rebuilt: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per distinct prefix of ``rebuilt`` (conv_id, turns)."""
    key = F.unhex(F.concat_ws("", "turns.digest"))
    rows = materialize(rebuilt.select("conv_id", key.alias("key"), F.col("turns.bytes").alias("sizes")))
    ranges = max(1, -(-rows.count() // ROWS_PER_RANGE))
    rows = rows.repartitionByRange(ranges, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    made = materialize(block_nodes(rows, block))
    edges = made.filter("edge")

    # parts of an edge node lie in blocks side by side: add them up by prefix
    whole = edges.groupBy("prefix").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.first("bytes").alias("bytes"),
        F.min("conv_id").alias("conv_id"),
        F.min(F.struct("block", "l")).alias("first"),
        F.max(F.struct("block", "r")).alias("last"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    whole = materialize(whole)
    below = whole.groupBy(F.col("parent").alias("prefix")).agg(F.count(F.lit(1)).alias("more"))
    whole = whole.join(below, "prefix", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    whole = materialize(whole.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")))

    # a subtree among edge nodes is a run in the order (first row, depth), up to the last node that begins within it
    begins = whole.select("prefix", F.col("first.block").alias("b"), F.col("first.l").alias("i"), F.col("depth").alias("d"), "leaf", "own", F.lit(0).alias("side"))
    stops = whole.select("prefix", F.col("last.block").alias("b"), F.col("last.r").alias("i"), F.lit((1 << 62)).alias("d"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("own"), F.lit(1).alias("side"))
    order = materialize(begins.unionByName(stops))
    summed = running(order, [], ["b", "i", "d", "prefix"], {"leaves": F.col("leaf"), "kept": F.col("own")})
    begin = F.col("side") == 0
    value = lambda total, own: F.sum(F.when(begin, F.col(own) - F.col(total)).otherwise(F.col(total)))
    subtree = summed.groupBy("prefix").agg(value("leaves", "leaf").alias("_leaves"), value("kept", "own").alias("_own"))

    streams = edges.filter("ends is not null").select("prefix", "block", "l", "ends").repartition("prefix").sortWithinPartitions("prefix", "block", "l")
    shas = streams.select("prefix", "ends").mapInPandas(_streamed, "prefix binary, sha string")
    names = materialize(whole.select("prefix", "conv_id"))
    above = names.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    top = whole.join(subtree, "prefix").join(shas, "prefix", "left").join(above, "parent", "left")
    top = top.withColumn("n_leaves", F.col("n_leaves") + F.col("_leaves")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("_own"))
    top = top.withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY)))

    # a block knows the edge nodes above its own complete nodes, so the look-up is by block and no hot parent meets all its children
    within = edges.select("block", F.col("prefix").alias("parent")).distinct().join(above, "parent").withColumnRenamed("parent_conv_id", "_up")
    inner = made.filter("not edge").drop("prefix").join(within, ["block", "parent"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up"))
    return inner.select(*RESULT).unionByName(top.select(*RESULT))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spliced(turns_in_order(table(spark, sf_dir, "conversations"))))


OP12_SQL = """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
hs AS (SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT hs.c, t.k, t.role, t.text FROM hs JOIN t ON t.c = hs.base AND t.k <= hs.h
  UNION ALL SELECT hs.c, t.k + 100000, t.role, t.text FROM hs JOIN t ON t.c = hs.c AND t.k > hs.h),
s AS (SELECT hs.c, coalesce(list({'role': r.role, 'text': r.text} ORDER BY r.k) FILTER (r.k IS NOT NULL), []) AS turns FROM hs LEFT JOIN r ON r.c = hs.c GROUP BY hs.c),
p AS (SELECT c, d, turns[1:d] AS pre, CASE WHEN d > 0 THEN turns[1:d - 1] END AS par, CASE WHEN d > 0 THEN strlen(turns[d].text) ELSE 0 END AS bytes, d = len(turns) AS stops
  FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM s)),
n AS (SELECT d, pre, any_value(par) AS par, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (stops), '')) AS ends_sha256 FROM p GROUP BY d, pre),
k AS (SELECT d - 1 AS d, par, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.d = n.d AND k.par = n.pre),
below AS (SELECT DISTINCT a.d AS top_d, a.pre AS top, b.d, b.pre FROM p a JOIN p b ON a.c = b.c AND b.d >= a.d),
sub AS (SELECT top_d, top, sum((f.n_children = 0)::BIGINT) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved_tokens FROM below JOIN f ON f.d = below.d AND f.pre = below.pre GROUP BY ALL)
SELECT f.conv_id, f.d::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, sub.n_leaves::BIGINT AS n_leaves, sub.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN sub ON sub.top_d = f.d AND sub.top = f.pre LEFT JOIN n u ON u.d = f.d - 1 AND u.pre = f.par
"""
