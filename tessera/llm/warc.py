"""Deterministic sharded WARC archives of a page table, and their reader.

Writer: slim rows (id, hashes, bytes) are sorted by range and their byte prefix
sums cut the order into ranges of equal bytes; pages are dealt by range number,
sorted, and each range is written in order to gzip members, one for each
record, rolled to a new file when the compressed size reaches the limit.
Headers and digests are made anew from the row, so a rerun or a retried task
writes the same bytes under the same names.  A file appears under its own name
only when complete (it is written under a temporary name and moved), and an
archive exists once its manifest does.

Identical payloads are stored once: of equal payloads the one with the largest
page_id is the response, the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged

#: Bytes in a range, compressed bytes in a file, bytes that a record counts besides its payload.
RANGE, ROLL, HEAD = 64 << 20, 16 << 20, 512
#: A payload held by more than one of so many rows has its largest id broadcast; there are no more such payloads than this.
HOT = 2000
#: Date of every record: archives must not depend on when they are written.
DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"  # fixed value
MANIFEST = "file string, range int, n_records long, n_bytes long"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or local path, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The name of the record of a page and payload; a revisit can tell that of its response."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id} {digest}')}>"


def _framed(head: dict[str, str], block: bytes) -> bytes:
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def info(name: str) -> bytes:
    """The warcinfo record that opens a file."""
    block = b"software: tessera\r\nformat: WARC File Format 1.0\r\n"
    head = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_NAMES, name)}>", "WARC-Date": DATE, "WARC-Filename": name}
    return _framed(head | {"WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Type": "application/warc-fields", "Content-Length": str(len(block))}, block)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.0 record: response with the payload, or revisit with its headers alone."""
    digest = sha1_base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": urllib.parse.quote(url or "", safe="!#$%&'()*+,/:;=?@[]~-._"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1_base32(block)}",
        "X-Page-ID": "" if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page-ID": str(refers_to)}
    return _framed(head, block)


def gzip_member(data: bytes) -> bytes:
    """One gzip member without time or name in its header."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Roller:
    """Files of one range: temporary names while open, own names when complete."""

    def __init__(self, out: str, roll: int):
        self.fs, self.base = filesystem(out)
        self.roll, self.range, self.seq, self.stream = roll, None, 0, None

    def add(self, of: int, member: bytes) -> Iterator[tuple]:
        if of != self.range:
            yield from self.close()
            self.range, self.seq = of, 0
        if self.stream is None:
            self.name = f"part-{self.range:07d}-{self.seq:05d}.warc.gz"
            self.tmp = f"{self.base}/.tmp-{uuid.uuid4().hex}-{self.name}"
            first = gzip_member(info(self.name))
            self.stream, self.n, self.size = self.fs.open_output_stream(self.tmp, compression=None), 0, len(first)
            self.stream.write(first)
        self.stream.write(member)
        self.n, self.size = self.n + 1, self.size + len(member)
        if self.size >= self.roll:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.stream is not None:
            self.stream.close()
            self.fs.move(self.tmp, f"{self.base}/{self.name}")
            yield self.name, self.range, self.n, self.size
            self.stream, self.seq = None, self.seq + 1


def _writer(out: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, note, done = _Roller(out, roll), None, []
        for batch in batches:
            for of, page_id, mark, kind, url, html, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:  # what the pages of this id and content, which follow, refer to; url has the payload's digest
                    note = (page_id, mark, url, to)
                    continue
                payload = (html or "").encode("utf-8", "surrogatepass")
                same = note is not None and note[:2] == (page_id, mark) and note[2] == hashlib.sha1(payload).hexdigest()
                done += files.add(of, gzip_member(record(page_id, url, payload, note[3] if same else None)))
        done += files.close()
        yield pa.RecordBatch.from_pandas(pd.DataFrame(done, columns=["file", "range", "n_records", "n_bytes"]), pa.schema([("file", pa.string()), ("range", pa.int32()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))

    return run


def _slim(pages: DataFrame) -> DataFrame:
    """page_id, mark (hash of url and payload), payload digest and bytes of every page."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), _mark().alias("mark"), F.sha1(payload.cast("binary")).alias("digest"), (F.octet_length(payload) + F.lit(HEAD)).cast("long").alias("n")
    )


def _mark() -> Column:
    return F.xxhash64(F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html"), F.lit("")))


def _codes(none: np.ndarray, page_id: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Keys as byte strings that compare as (id, nulls last, mark)."""
    out = np.empty((len(none), 17), np.uint8)
    out[:, 0] = none
    for at, x in ((1, page_id), (9, mark)):
        out[:, at : at + 8] = (x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S17").ravel()


def _bounds(slim: DataFrame, range_bytes: int) -> np.ndarray:
    """The first key of each range but the first, in order.

    Slim rows are sorted by range of key; byte totals of the partitions and a
    window in each give every key its place, whatever the partitions were.
    Rows of one key that fill several ranges give their key as often.  The
    driver gets a key of 17 bytes for each ``range_bytes``.
    """
    none = F.col("page_id").isNull().cast("int")
    groups = slim.groupBy(none.alias("none"), F.coalesce("page_id", F.lit(0)).alias("page_id"), "mark").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    ordered = staged(groups.repartitionByRange("none", "page_id", "mark").withColumn("part", F.spark_partition_id()), "warc-keys")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = ordered.groupBy("part").agg(F.sum("n").alias("b")).select("part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    within = Window.partitionBy("part").orderBy("none", "page_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumn("b", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(parts), "part")
    first = F.floor((F.col("b0") + F.col("b")) / range_bytes)
    last = F.when(F.col("rows") > 1, F.floor((F.col("b0") + F.col("b") + F.col("n") - 1) / range_bytes)).otherwise(first)
    firsts = placed.select("none", "page_id", "mark", F.explode(F.sequence(first, last)).alias("range")).groupBy("range").agg(F.min(F.struct("none", "page_id", "mark")).alias("k"))
    rows = firsts.select("range", "k.*").orderBy("range").toPandas()
    return _codes(*(rows[c].to_numpy(np.int64)[1:] for c in ("none", "page_id", "mark")))


def _place(bounds: np.ndarray):
    """A function from keys to the first and last range that may hold them."""

    @F.pandas_udf("struct<lo:int,hi:int>")
    def place(none: pd.Series, page_id: pd.Series, mark: pd.Series) -> pd.DataFrame:
        key = _codes(none.to_numpy(), page_id.to_numpy(), mark.to_numpy())
        hi = np.searchsorted(bounds, key, "right").astype(np.int32)
        # only a key that begins several ranges is dealt over them
        lo = np.searchsorted(bounds, key, "left").astype(np.int32) + 1
        return pd.DataFrame({"lo": np.minimum(lo, hi), "hi": hi})

    return lambda mark: place(F.col("page_id").isNull().cast("int"), F.coalesce("page_id", F.lit(0)), mark)


def _revisits(slim: DataFrame) -> DataFrame:
    """page_id, mark, digest and to of the pages whose payload a larger id has.

    Payloads of more than one in HOT rows (so at most HOT of them) are matched
    by broadcast: their rows stay where they are.
    """
    known = slim.where("page_id is not null").select("page_id", "mark", "digest")
    largest = staged(known.groupBy("digest").agg(F.max("page_id").alias("to"), F.min("page_id").alias("low"), F.count("*").alias("copies")).where("low < to"), "warc-payloads")
    many = max(1, slim.count() // HOT)
    hot = F.broadcast(largest.where(F.col("copies") > many).select("digest", "to"))
    rare = largest.where(F.col("copies") <= many).select("digest", "to")
    both = known.join(hot, "digest").unionByName(known.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(rare, "digest"))
    return both.where("page_id < to").select("page_id", "mark", "digest", "to").distinct()


def write_warc(pages: DataFrame, out: str, range_bytes: int = RANGE, roll_bytes: int = ROLL) -> DataFrame:
    """Write the pages (page_id, url, html) under ``out``; returns the manifest.

    Null html is an empty payload, a null url an empty target.  Any page_id of
    64 bits is taken; pages with a null id are written last, as responses.  Of
    rows that repeat an id and a payload the payload's largest id is theirs:
    all are responses if it is their own, and their records share a name.
    Rows equal in id, url and html that fill several ranges are dealt over
    them.  An empty table gives an empty manifest; other columns of the table
    are not written.  A text is held whole, however long.

    An archive is written once: a folder that has a manifest is refused before
    anything is written.  What a failed run left there is written anew, and
    files that the manifest doesn't name are not part of the archive.
    """
    spark = pages.sparkSession
    fs, base = filesystem(out)
    if fs.get_file_info(f"{base}/manifest").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{out} holds an archive")
    fs.create_dir(base, recursive=True)
    slim = staged(_slim(pages), "warc-slim")
    bounds = _bounds(slim, range_bytes)
    place = _place(bounds)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), _mark().alias("mark"), F.lit(1).alias("kind"), F.col("url").cast("string").alias("url"), "html", F.lit(None).cast("long").alias("to"))
    dealt = F.col("at.lo") + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("at.hi") - F.col("at.lo") + 1)
    rows = rows.withColumn("at", place(F.col("mark"))).withColumn("range", dealt.cast("int")).drop("at")
    notes = _revisits(slim).withColumn("at", place(F.col("mark"))).withColumn("range", F.explode(F.sequence("at.lo", "at.hi"))).drop("at")
    notes = notes.select("page_id", "mark", F.lit(0).alias("kind"), F.col("digest").alias("url"), F.lit(None).cast("string").alias("html"), "to", "range")
    # one shuffle of the pages, a range to a task; what they refer to arrives just before them
    dealt = rows.unionByName(notes).select("range", "page_id", "mark", "kind", "url", "html", "to").repartitionById(len(bounds) + 1, F.col("range"))
    manifest = dealt.sortWithinPartitions(F.col("page_id").asc_nulls_last(), "mark", "kind").mapInArrow(_writer(out, roll_bytes), MANIFEST)
    tmp, final = f"{out}/.tmp-manifest-{uuid.uuid4().hex}", f"{out}/manifest"
    manifest.write.json(tmp)
    fs.move(filesystem(tmp)[1], filesystem(final)[1])
    return spark.read.schema(MANIFEST).json(final)


def members(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive file."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof and at < len(data):
            part = view[at : at + 65536]
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        text = b"".join(out)
        head, _, block = text.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, block[: int(fields["Content-Length"])]


def _reader(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(out)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    data = f.read()
                for head, block in members(data):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
                    digest, kind = head["WARC-Payload-Digest"][5:], head["WARC-Type"]
                    ok = head["WARC-Block-Digest"][5:] == sha1_base32(block) and (kind == "revisit" or (len(payload) == size and sha1_base32(payload) == digest))
                    to = head.get("X-Refers-To-Page-ID")
                    rows.append((int(head["X-Page-ID"]) if head["X-Page-ID"] else None, urllib.parse.unquote(head["WARC-Target-URI"]), size, digest, kind, int(to) if to else None, ok))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """Records of an archive by its manifest, a file at a time in a task:
    page_id, url, payload_bytes, payload_digest, record_type, refers_to and
    intact (block and payload agree with their digests)."""
    files = spark.read.schema(MANIFEST).json(f"{out}/manifest").select("file")
    n = max(1, files.count())
    return files.repartition(min(n, 10_000)).mapInArrow(
        _reader(out), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
