"""WARC archives: a deterministic sharded writer, and a reader that checks what it reads.

Pages are cut into shards by ranges of their id, each shard is written in id order and rolled into
files by compressed size. Every record is a gzip member of its own with headers and digests made
anew from the payload. Tasks write files under names of their own attempt; the entries of attempts
that succeeded are stored, a second job renames their files and lists them in a manifest table, and
one small file, itself written through a temporary name, then makes the archive valid. A lost
executor leaves only temporary files behind, and its task writes, or renames, anew.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, slices, stored

#: Payloads below this size are never written as revisits.
LEAST_SHARED = 100
#: The sort key of pages without an id, and hex digits of a payload's digest that order equal ids.
NULL_KEY, SALT_DIGITS = -(2**63), 15
#: Files are read by so many tasks at most.
MOST_READERS = 50_000
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's for URLs
#: Records carry this date so that the same pages give the same bytes.
DATE = "1970-01-01T00:00:00Z"

MANIFEST = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("file", T.IntegerType()),
        T.StructField("temporary", T.StringType()),
        T.StructField("records", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("sha256", T.StringType()),
    ]
)
READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("intact", T.BooleanType()),
    ]
)


@dataclass(frozen=True)
class Layout:
    shard_bytes: int = 256 << 20  # of payload, at most, unless one id alone has more
    least_shards: int = 48
    roll_bytes: int = 128 << 20  # of compressed file; a file has one record at least
    level: int = 6
    most_tasks: int = 50_000  # beyond, a task writes several shards


def store(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))


def _line(value: str) -> str:
    """A header value: control characters and non-ASCII as percent escapes."""
    return "".join(c if " " <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode("ascii") + block + b"\r\n\r\n") + squeeze.flush()


def _common(kind: str, page_id: int | None, url: str | None, digest: str, size: int) -> list[tuple[str, str]]:
    out = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size))]
    out += [("WARC-Target-URI", _line(url))] if url else []
    return out + ([("X-Page-ID", str(page_id))] if page_id is not None else [])


def response(page_id: int | None, url: str | None, payload: bytes, level: int = 6) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = _common("response", page_id, url, digest, len(payload)) + [("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Type", "application/http;msgtype=response")]
    return _member(headers, block, level)


def revisit(page_id: int | None, url: str | None, digest: str, size: int, first: int, level: int = 6) -> bytes:
    headers = _common("revisit", page_id, url, digest, size) + [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page", str(first))]
    return _member(headers, b"", level)


def _info(shard: int, number: int, level: int) -> bytes:
    name = f"shard-{shard:05d}-{number:04d}"
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name + ".warc.gz"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)


def _keyed(pages: DataFrame) -> DataFrame:
    """page_id, key, salt, digest and bytes of each row.

    Rows are sorted by key, the page_id with null as the least, then by salt, which comes from the
    payload: rows that share one id spread over shards as far as their payloads differ.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    return rows.select("page_id", F.coalesce("page_id", F.lit(NULL_KEY)).alias("key"), F.conv(F.left("digest", F.lit(SALT_DIGITS)), 16, 10).cast("long").alias("salt"), "digest", "bytes")


def cuts(rows: DataFrame, most: int, least_shards: int = 1) -> list[tuple[int, int]]:
    """Ascending (key, salt) at which new shards begin, for ``rows`` of key, salt and size.

    The shard of a record is the size of all that sorts before it, divided by the shard size: ``most``,
    or less to make ``least_shards``. So a shard holds no more than that, but for its last (key, salt).
    Rows are summed by (key, salt), sorted in ranges, and numbered by running sums in a range plus the
    sum of the ranges before; only narrow columns move. Where ranges end does not matter: the result
    depends on the rows alone. The driver sees a row for each range and one for each shard.
    """
    spark = rows.sparkSession
    sums = rows.groupBy("key", "salt").agg(F.sum("size").alias("size"))
    ranged = stored(sums.repartitionByRange("key", "salt").select("key", "salt", "size", F.spark_partition_id().alias("part")), "warc-ranges")
    parts = ranged.groupBy("part").agg(F.min(F.struct("key", "salt")).alias("low"), F.sum("size").alias("size")).orderBy("low").collect()
    total = sum(r["size"] for r in parts)
    most = max(1, min(most, total // least_shards))
    offsets = [(r["part"], sum_before) for r, sum_before in zip(parts, itertools.accumulate((r["size"] for r in parts), initial=0))]
    inside = Window.partitionBy("part").orderBy("key", "salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("until", F.sum("size").over(inside)).join(F.broadcast(spark.createDataFrame(offsets, "part int, offset long")), "part")
    shard = F.expr(f"(offset + until - size) div {most}")
    firsts = placed.groupBy(shard.alias("shard")).agg(F.min(F.struct("key", "salt")).alias("first")).collect()
    drop_stored(ranged)
    return sorted(tuple(r["first"]) for r in firsts)[1:]


class Places:
    """The shard of a (key, salt), by the places where shards begin."""

    def __init__(self, begins: list[tuple[int, int]]):
        import numpy as np

        self.keys, self.salts = (np.array([b[i] for b in begins], np.int64) for i in (0, 1))

    def of(self, key: int, salt: int) -> int:
        import numpy as np

        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        return int(low + np.searchsorted(self.salts[low:high], salt, "right"))


def decide(keyed: DataFrame) -> DataFrame:
    """key, salt, page_id, digest, bytes and first, the page that they revisit, for all that revisit.

    Digests are grouped with partial sums, so a payload that a third of all pages share moves as
    one row a task; joining them back is an ordinary join that adaptive execution can split.
    Rows that repeat the smallest page_id of their payload are all responses; null ids revisit.
    """
    rows = keyed.where(F.col("bytes") >= LEAST_SHARED)
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    return rows.distinct().join(first, "digest").where("page_id is null or page_id <> first").select("key", "salt", "page_id", "digest", "bytes", "first")


PACKED = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("key", T.LongType()),
        T.StructField("salt", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("member", T.BinaryType()),
    ]
)


class Seen:
    """The least page_id a task has met for each payload; forgetting some costs only bytes moved."""

    def __init__(self, most: int = 200_000):
        self.least: dict[bytes, int] = {}
        self.most = most

    def certain_revisit(self, digest: bytes, page_id: int | None) -> bool:
        """Whether a row met before has the same payload and a smaller id."""
        before = self.least.get(digest)
        if page_id is not None and (before is None or page_id < before):
            if len(self.least) >= self.most:
                self.least.clear()
            self.least[digest] = page_id
        return before is not None and (page_id is None or page_id > before)


def write(pages: DataFrame, root: str, layout: Layout = Layout()) -> str:
    """Writes ``pages`` (page_id, url, html) below ``root`` and returns the manifest's path.

    A null html is an empty payload; null ids sort first. An empty table gives an empty manifest.
    Rows that repeat an id are all written; those alike in id and payload stand in one shard.
    Other columns are not written.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    keyed = _keyed(rows)
    begins = cuts(keyed.select("key", "salt", (F.col("bytes") + 200).alias("size")), layout.shard_bytes, layout.least_shards)
    shards, level, roll = len(begins) + 1, layout.level, layout.roll_bytes
    # two longs a shard; shards are sized so that even 100 TB make some 400,000
    shared = spark.sparkContext.broadcast(begins)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Compressed records before the shuffle; rows known to revisit go without their payload."""
        places, seen = Places(shared.value), Seen()

        def one(page_id, url, html):
            payload = (html or "").encode("utf-8", "replace")
            raw = hashlib.sha256(payload)
            digest, key = raw.hexdigest(), NULL_KEY if page_id is None else page_id
            salt = int(digest[:SALT_DIGITS], 16)
            again = len(payload) >= LEAST_SHARED and seen.certain_revisit(raw.digest(), page_id)
            return places.of(key, salt), key, salt, page_id, url, digest, None if again else response(page_id, url, payload, level)

        for b in slices(batches, 64):
            made = [one(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield _batch(made, PACKED)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(shared.value)
        for b in batches:
            found = [places.of(k, s) for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *b.columns], names=["shard", *b.schema.names])

    marks = decide(keyed).mapInArrow(place, "shard int, key long, salt long, page_id long, digest string, bytes long, first long")
    both = rows.mapInArrow(pack, PACKED).withColumn("mark", F.lit(1)).unionByName(marks.withColumn("mark", F.lit(0)), allowMissingColumns=True)
    tasks = min(shards, layout.most_tasks)
    dealt = both.repartitionById(tasks, F.expr(f"cast(cast(shard as bigint) * {tasks} div {shards} as int)"))
    ordered = dealt.sortWithinPartitions("shard", "key", "salt", F.col("page_id").asc_nulls_first(), "mark", "url", "member")

    def write_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(root)
        folder = f"{base}/_temporary/{uuid.uuid4().hex}"
        files.create_dir(folder, recursive=True)
        done, out, shard, number, held, said, records = [], None, None, 0, 0, hashlib.sha256(), 0
        at, first = None, None

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((shard, number, name, records, held, said.hexdigest()))
                out = None

        for b in slices(batches, 64):
            for row in b.to_pylist():
                if row["shard"] != shard:
                    close()
                    shard, number = row["shard"], -1
                if (row["salt"], row["page_id"], row["digest"]) != at:
                    at, first = (row["salt"], row["page_id"], row["digest"]), None
                if row["mark"] == 0:
                    first = (row["first"], row["bytes"])
                    continue
                member = row["member"]
                if first is not None:
                    member = revisit(row["page_id"], row["url"], row["digest"], first[1], first[0], level)
                if out is None or held + len(member) > roll and records:
                    close()
                    number += 1
                    name = f"{folder}/{shard:06d}-{number:04d}"
                    out, held, said, records = files.open_output_stream(name, compression=None), 0, hashlib.sha256(), 0
                    info = _info(shard, number, level)
                    out.write(info)
                    said.update(info)
                    held += len(info)
                out.write(member)
                said.update(member)
                held += len(member)
                records += 1
        close()
        yield _batch(done, MANIFEST)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Renames files; one that an earlier attempt has renamed is left as it is."""
        files, base = store(root)
        for b in batches:
            out = []
            for r in b.to_pylist():
                final = f"{base}/{final_name(r['shard'], r['file'])}"
                try:
                    files.move(r["temporary"], final)
                except OSError:
                    if files.get_file_info(final).type != pafs.FileType.File:
                        raise
                out.append(tuple(r.values()))
            yield _batch(out, MANIFEST)

    # Spark's committer keeps the entries of attempts that succeeded, one for each file
    entries = stored(ordered.mapInArrow(write_shards, MANIFEST), "warc-entries")
    entries.mapInArrow(settle, MANIFEST).write.mode("overwrite").parquet(f"{root}/_manifest.parquet")
    drop_stored(entries)
    files, base = store(root)
    files.create_dir(base, recursive=True)
    if files.get_file_info(f"{base}/_temporary").type == pafs.FileType.Directory:
        files.delete_dir(f"{base}/_temporary")
    listed = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest.parquet").agg(F.count("*").alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")).first()
    with files.open_output_stream(f"{base}/_manifest.json.tmp", compression=None) as f:
        f.write(json.dumps({"manifest": "_manifest.parquet", "files": listed["files"], "records": listed["records"] or 0, "bytes": listed["bytes"] or 0}, indent=1).encode())
    files.move(f"{base}/_manifest.json.tmp", f"{base}/_manifest.json")
    return f"{root}/_manifest.json"


def final_name(shard: int, file: int) -> str:
    return f"shard-{shard:06d}-{file:04d}.warc.gz"


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    columns = list(zip(*rows, strict=True)) or [()] * len(schema.fields)
    return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields, strict=True)], names=schema.names)


def records(stream, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member; memory is one record and one read."""
    buffer = b""
    while True:
        buffer = buffer or stream.read(step)
        if not buffer:
            return
        squeeze, parts = zlib.decompressobj(31), []
        while True:
            parts.append(squeeze.decompress(buffer))
            if squeeze.eof:
                buffer = squeeze.unused_data
                break
            buffer = stream.read(step)
            if not buffer:
                raise ValueError("a WARC file ends inside a record")
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("ascii").split("\r\n")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(headers["Content-Length"])
        if lines[0] != "WARC/1.1" or len(rest) != size + 4:
            raise ValueError("not a WARC 1.1 record")
        yield headers, rest[:size]


def read(spark: SparkSession, manifest: str, payloads: bool = True) -> DataFrame:
    """The records that the manifest lists, one task a file; payloads only if asked for.

    ``intact`` says whether the digests and lengths in the headers are those of the bytes read
    (for revisits, which have no bytes, it is true).
    """
    root = manifest.rsplit("/", 1)[0]
    files, base = store(root)
    with files.open_input_stream(f"{base}/_manifest.json", compression=None) as f:
        head = json.loads(f.read())
    if not head["files"]:
        return spark.createDataFrame([], READ)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(root)
        for b in batches:
            for name in map(final_name, b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows: list[tuple] = []
                with files.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for headers, block in records(f):
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"])
                        intact = True
                        if payload is not None:
                            seen = hashlib.sha256(payload).hexdigest()
                            intact = (seen, len(payload), "sha256:" + hashlib.sha256(block).hexdigest()) == (digest, size, headers["WARC-Block-Digest"])
                            digest, size = seen, len(payload)
                        number = lambda k: int(headers[k]) if k in headers else None
                        rows.append((number("X-Page-ID"), headers.get("WARC-Target-URI"), kind, number("X-Refers-To-Page"), size, digest, payload if payloads else None, intact))
                        if len(rows) >= (64 if payloads else 4096):
                            yield _batch(rows, READ)
                            rows = []
                if rows:
                    yield _batch(rows, READ)

    # the manifest is small; dealing it out anew gives every file a task, up to a bound on tasks
    listed = spark.read.schema(MANIFEST).parquet(f"{root}/{head['manifest']}").select("shard", "file")
    return listed.repartition(min(head["files"], MOST_READERS)).mapInArrow(parse, READ)
