"""Deterministic sharded WARC writer and a reader of its archives.

1. A first pass keeps (key, payload size, digest) per row. Of rows with equal payloads the one with the largest key is the
   ``response``; the others ``revisit`` it.
2. Bytes per key range give cut points (refined where a range is too heavy), so shards are runs of the key order of about
   equal size that do not depend on how the input is partitioned.
3. Payload rows and the few facts about copies meet in one shuffle by shard, sorted; each shard is streamed through a
   writer that makes headers and digests anew, one gzip member per record, and rolls to the next file by compressed size.
4. Files are written under temporary names of the attempt; the manifest of the attempts that succeeded is written as a table, then the files get
   their final names (a step that may be repeated) and the manifest is written beside them. Only files that it lists count.

Files are written with ``pyarrow.fs`` below the shared folder, so any store that it knows (local or mounted, S3, GCS, HDFS) will do.

Defined results: a null payload is empty; rows without key sort first and have no key header; of rows equal in key and payload one is the
response and the others revisit it; a null URL becomes a ``urn:page`` name; an empty table writes a manifest without rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import materialize, shared_folder, table

ROLL_BYTES = 32 << 20  # compressed
SHARD_BYTES = 16 << 20  # payload bytes per shard at least; more where that would make over MAX_SHARDS
MAX_SHARDS = 4096
DATE = "1970-01-01T00:00:00Z"
NO_KEY = -(2**63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RANGES, _PARTS = 4096, 256
MANIFEST = "shard long, seq long, tmp string, name string, records long, bytes long, sha256 string"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def key_ranges(sizes: DataFrame, key: str, size: str, shard_bytes: int) -> list[tuple[int, int]]:
    """(first key, parts) of each run of keys; a single key beyond the size gets several parts.

    Ranges that are too heavy are split again until they fit. The driver holds ``_RANGES`` rows first and
    ``_PARTS`` per heavy range later, of which there are at most ``MAX_SHARDS``.
    """
    span = sizes.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    if span["a"] is None:
        return [(NO_KEY, 1)]
    heavy, parts, leaves = [(int(span["a"]), int(span["b"]))], _RANGES, []
    while heavy:
        cut = sizes.sparkSession.createDataFrame([(a, b, -(-(b - a + 1) // parts)) for a, b in heavy], "lo long, hi long, width long")
        place = F.expr(f"cast((cast({key} as decimal(20,0)) - cast(lo as decimal(20,0))) div width as bigint)")
        inside = sizes.join(F.broadcast(cut), F.col(key).between(F.col("lo"), F.col("hi")))  # at most MAX_SHARDS ranges
        found = []
        for r in inside.groupBy("lo", "hi", "width", place.alias("i")).agg(F.sum(size).alias("s")).collect():
            first = r["lo"] + r["i"] * int(r["width"])
            found.append((first, min(r["hi"], first + int(r["width"]) - 1), int(r["s"])))
        leaves += [x for x in found if x[2] <= shard_bytes or x[0] == x[1]]
        heavy, parts = [(a, b) for a, b, s in found if s > shard_bytes and a < b], _PARTS
    cuts: list[tuple[int, int]] = []
    filled = None
    for first, _, s in sorted(leaves):
        if s > shard_bytes:
            cuts.append((first, -(-s // shard_bytes)))
            filled = None
        elif filled is None or filled + s > shard_bytes:
            cuts.append((first, 1))
            filled = s
        else:
            filled += s
    return cuts


def shard_of(cuts: list[tuple[int, int]], keys: np.ndarray, digests: pd.Series) -> np.ndarray:
    """Shard numbers; a key with several parts is split by its payloads' digests."""
    first = np.array([c[0] for c in cuts], dtype=np.int64)
    parts = np.array([c[1] for c in cuts], dtype=np.int64)
    at = np.maximum(np.searchsorted(first, keys, side="right") - 1, 0)
    out = (np.cumsum(parts) - parts)[at]
    many = parts[at] > 1
    if many.any():
        top = np.array([int(d[:8], 16) for d in digests[many]], dtype=np.int64)
        out[many] += top * parts[at][many] >> 32
    return out


def _record(kind: str, key: int | None, url: str | None, payload: bytes, digest: str, record_id: str, refers: tuple[str, int | None] | None) -> bytes:
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{key}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    head += [f"X-Row-Key: {key}"] if key is not None else []
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{refers[0]}>"]
        head += [f"X-Refers-To-Row-Key: {refers[1]}"] if refers[1] is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip header without time, so equal records give equal bytes
    return z.compress(data) + z.flush()


class _Roll:
    """The open file of a shard."""

    def __init__(self, folder: str, shard: int, seq: int):
        self.fs, root = _fs(folder)
        self.shard, self.seq, self.name = shard, seq, f"part-{shard:05d}-{seq:05d}.warc.gz"
        self.tmp = f"_temporary/{uuid.uuid4().hex}-{self.name}"
        self.fs.create_dir(f"{root}/_temporary", recursive=True)
        self.out = self.fs.open_output_stream(f"{root}/{self.tmp}", compression=None)
        self.sha, self.records, self.bytes = hashlib.sha256(), 0, 0

    def add(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.records += 1
        self.bytes += len(member)

    def close(self) -> tuple:
        self.out.close()
        return self.shard, self.seq, self.tmp, self.name, self.records, self.bytes, self.sha.hexdigest()


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes WARC files into ``folder`` and returns the manifest (shard, seq, name, records, bytes, sha256)."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    facts = materialize(rows.select("key", "digest", F.octet_length("payload").cast("long").alias("size")))
    total = facts.agg(F.sum("size")).first()[0] or 0
    cuts = key_ranges(facts.select("key", (F.col("size") + 512).alias("size")), "key", "size", max(shard_bytes, -(-total // MAX_SHARDS)))
    shards = sum(parts for _, parts in cuts)

    groups = facts.filter(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("key").alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = facts.join(groups.select("digest", "size", "top"), ["digest", "size"]).select("key", "digest", "top").distinct()

    @F.pandas_udf("long")
    def shard(keys: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series(shard_of(cuts, keys.to_numpy(), digests))

    lined = rows.select("key", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("top"), "url", "payload").unionByName(
        copies.select("key", "digest", F.lit(0).alias("kind"), "top", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    )
    lined = lined.withColumn("shard", shard("key", "digest")).repartition(min(shards, MAX_SHARDS), "shard").sortWithinPartitions("shard", "key", "digest", "kind", "url")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roll: _Roll | None = None
        last: tuple = ()
        top, seen, done = None, 0, []
        for df in batches:
            for at, k, digest, kind, t, u, data in zip(df["shard"], df["key"], df["digest"], df["kind"], df["top"], df["url"], df["payload"]):
                if (k, digest) != last:
                    last, top, seen = (k, digest), None, 0
                if kind == 0:
                    top = int(t)
                    continue
                if roll and (roll.shard != at or roll.bytes >= roll_bytes):
                    done.append(roll.close())
                    roll = _Roll(folder, at, roll.seq + 1 if roll.shard == at else 0)
                roll = roll or _Roll(folder, at, 0)
                b32 = base64.b32encode(bytes.fromhex(digest)).decode()
                own = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{k}/{digest}/{seen}"))
                name = None if k == NO_KEY else int(k)
                if top is None or top == k and seen == 0:
                    made = _record("response", name, u, data, b32, own, None)
                else:
                    first = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{top}/{digest}/0"))
                    made = _record("revisit", name, u, data, b32, own, (first, None if top == NO_KEY else top))
                seen += 1
                roll.add(_member(made))
            if done:
                yield pd.DataFrame(done, columns=[c.split()[0] for c in MANIFEST.split(", ")])
                done = []
        if roll:
            yield pd.DataFrame([roll.close()], columns=[c.split()[0] for c in MANIFEST.split(", ")])

    fs, root = _fs(folder)
    fs.create_dir(root, recursive=True)
    made = materialize(lined.select("shard", "key", "digest", "kind", F.coalesce("top", F.lit(0)).alias("top"), "url", "payload").mapInPandas(write, MANIFEST))

    def rename(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        store, top = _fs(folder)
        for df in batches:
            for tmp, name in zip(df["tmp"], df["name"]):
                if store.get_file_info(f"{top}/{tmp}").type != pafs.FileType.NotFound:  # else an earlier attempt has moved it
                    store.move(f"{top}/{tmp}", f"{top}/{name}")
            yield df.drop(columns="tmp")

    final = made.mapInPandas(rename, MANIFEST.replace("tmp string, ", ""))
    final.write.parquet(f"{folder.rstrip('/')}/_manifest")
    return spark.read.parquet(f"{folder.rstrip('/')}/_manifest")


def _members(data: bytes) -> Iterator[bytes]:
    view, pos = memoryview(data), 0
    while pos < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            part = view[pos : pos + (1 << 16)]
            if not len(part):
                raise ValueError("a gzip member is cut off")
            out.append(z.decompress(part))
            pos += len(part) - len(z.unused_data)
        yield b"".join(out)


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    named = lambda lines: {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    warc = named(head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, named(http.decode("utf-8").split("\r\n")[1:]), payload


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the files in the manifest; digests of full payloads are computed anew and compared with the headers."""
    files = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/*.warc.gz") if manifest.head(1) else None
    if files is None:
        return spark.createDataFrame([], RECORD)
    files = files.withColumn("name", F.substring_index("path", "/", -1)).join(manifest.select("name"), "name", "left_semi").select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda x: None if x is None else int(x)
        for df in batches:
            for content in df["content"]:
                rows = []
                for record in _members(content):
                    warc, http, payload = parse(record)
                    digest, size = warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                    if warc["warc-type"] == "response":
                        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if (found, len(payload)) != (digest, size):
                            raise ValueError(f"record {warc['warc-record-id']}: payload and headers differ")
                    rows.append((number(warc.get("x-row-key")), warc["warc-target-uri"], warc["warc-type"], number(warc.get("x-refers-to-row-key")), size, digest, payload if with_payload else None))
                    if len(rows) >= 500:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    return files.mapInPandas(run, RECORD)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
    return df.astype({"page_id": "Int64", "refers_to": "Int64"})


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    got = read_archives(spark, folder, manifest, with_payload=False)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
