"""WARC archives compressed with a dictionary: a data source that writes and reads .warc.zst files, and pages written through it.

An archive begins with a skippable frame that holds a Zstandard dictionary, itself compressed; each record after it is a frame of
its own, so any record can be opened with the dictionary alone. The dictionary is trained on the archive's first records. A task
holds these and one record at a time. Files of tasks that didn't end well are in no manifest, and readers pass them over.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from fumiyomi.llm.common import shared_folder

# Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# End of the fixed values.
#: Bytes of records of an archive, of records a dictionary is trained on, and of a dictionary; the level of compression.
ARCHIVE_BYTES, TRAIN_BYTES, DICTIONARY_BYTES, LEVEL = 256_000_000, 4_000_000, 65_536, 3
#: Payloads shorter than this are always kept whole.
LEAST_BYTES = 100
#: Date of records where none is given.
DATE = "1970-01-01T00:00:00Z"
RECORDS = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
MANIFEST = "_archives.json"
_UNSAFE = re.compile(r"[\x00-\x20\x7f<>]")


def uri(text: str) -> str:
    """A URI fit for a header line."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", text)


def record(row: dict) -> bytes:
    """A record's bytes: headers, HTTP head and, unless it is a revisit, the payload."""
    payload = row["payload"] or b""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{uri(row['record_id'])}>", f"WARC-Date: {row['date'] or DATE}"]
    if row["target_uri"]:
        lines.append(f"WARC-Target-URI: {uri(row['target_uri'])}")
    if revisit:
        lines.append(f"WARC-Profile: {PROFILE}")
        if row["refers_to"] is not None:
            lines.append(f"WARC-Refers-To: <{uri(row['refers_to'])}>")
    lines += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records, or else from pieces of them; None where they are too short to train one."""
    for samples in (records, [r[i : i + 512] for r in records for i in range(0, min(len(r), 65_536), 512)]):
        try:
            return zstandard.train_dictionary(max(256, min(size, sum(map(len, samples)) // 8)), samples, k=256, d=8)
        except zstandard.ZstdError:
            pass
    return None


class Archive:
    """Bytes of one archive: the dictionary's frame once its first records are there, then a frame a record."""

    def __init__(self, out, level: int = LEVEL, train: int = TRAIN_BYTES):
        self.out, self.level, self.train = out, level, train
        self.held: list[bytes] = []
        self.size, self.records, self.pack = 0, 0, None

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.records += 1
        if self.pack:
            self.out.write(self.pack.compress(data))
            return
        self.held.append(data)
        if self.size >= self.train:
            self.begin()

    def begin(self) -> None:
        shared = trained(self.held)
        if shared:
            frame = zstandard.ZstdCompressor(level=19).compress(shared.as_bytes())
            self.out.write(DICTIONARY_MAGIC.to_bytes(4, "little") + len(frame).to_bytes(4, "little") + frame)
        self.pack = zstandard.ZstdCompressor(level=self.level, dict_data=shared) if shared else zstandard.ZstdCompressor(level=self.level)
        for data in self.held:
            self.out.write(self.pack.compress(data))
        self.held = []

    def close(self) -> None:
        if not self.pack:
            self.begin()
        self.out.close()


def opened(source) -> Iterator[dict]:
    """Records of an archive, one after the other; source is read once, from its start."""
    mark = source.read(8)
    shared = None
    if len(mark) == 8 and int.from_bytes(mark[:4], "little") == DICTIONARY_MAGIC:
        data = source.read(int.from_bytes(mark[4:], "little"))
        data = zstandard.ZstdDecompressor().decompress(data) if data[:4] == zstandard.FRAME_HEADER else data
        shared, rest = zstandard.ZstdCompressionDict(data), b""
    else:
        rest = mark
    unpack = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()

    stream = Stream(unpack.stream_reader(After(rest, source), read_across_frames=True, closefd=False))
    while first := stream.line():
        if not first.strip():
            continue
        headers = {}
        while line := stream.line().strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield parsed(headers, stream.block(int(headers.get("content-length", 0))))


class After:
    """Bytes that were read too early, then the source."""

    def __init__(self, first: bytes, source):
        self.first, self.source = first, source

    def read(self, n: int = -1) -> bytes:
        if self.first:
            out, self.first = self.first, b""
            return out
        return self.source.read(n)


class Stream:
    """Lines and blocks of a stream that may give fewer bytes than asked for."""

    def __init__(self, source, step: int = 1 << 18):
        self.source, self.step, self.held, self.at = source, step, b"", 0

    def more(self) -> bool:
        data = self.source.read(self.step)
        self.held, self.at = self.held[self.at :] + data, 0
        return bool(data)

    def line(self) -> bytes:
        while (end := self.held.find(b"\n", self.at)) < 0 and self.more():
            pass
        end = len(self.held) if end < 0 else end + 1
        out, self.at = self.held[self.at : end], end
        return out

    def block(self, n: int) -> bytes:
        parts, have = [self.held[self.at : self.at + n]], min(n, len(self.held) - self.at)
        self.at += have
        while have < n:
            data = self.source.read(max(self.step, n - have))
            if not data:
                raise EOFError(f"a record of {n} bytes ends after {have}")
            parts.append(data[: n - have])
            self.held, self.at = data, len(parts[-1])
            have += len(parts[-1])
        return b"".join(parts)


def parsed(headers: dict, block: bytes) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n") if headers.get("content-type", "").startswith("application/http") else (b"", b"", block)
    n = re.search(rb"(?i)^content-length:\s*([0-9]+)", head, re.M)
    kind = headers.get("warc-type", "")
    bare = lambda name: headers[name].strip("<>") if name in headers else None
    return {
        "record_id": bare("warc-record-id"), "record_type": kind, "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
        "refers_to": bare("warc-refers-to"), "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha256:") or None,
        "payload_bytes": int(n[1]) if n and kind == "revisit" else len(payload), "payload": None if kind == "revisit" else payload,
    }


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


@dataclass
class OneArchive(InputPartition):
    file: str


class WarcSource(DataSource):
    """format("warczst"): option path is a folder that the driver and all executors reach, as a URI pyarrow knows. Writing takes
    the columns of RECORDS, and archiveBytes as an option; each save adds its archives to the folder's manifest, in one step at
    its end. Reading gives RECORDS of the archives in the manifest, or of all *.warc.zst files where there is none; a payload
    is null in revisits."""

    @classmethod
    def name(cls) -> str:
        return "warczst"

    def schema(self) -> str:
        return RECORDS

    def writer(self, schema, overwrite):  # noqa: ANN001
        if overwrite:
            raise ValueError("archives are added to a folder, never replaced: use mode append")
        return WarcWriter(self.options)

    def reader(self, schema):  # noqa: ANN001
        return WarcReader(self.options)


def place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def manifest(fs: pafs.FileSystem, base: str) -> list[str] | None:
    if fs.get_file_info(f"{base}/{MANIFEST}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
        return json.loads(f.read())


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("archivebytes", ARCHIVE_BYTES))
        fs, base = place(self.path)
        fs.create_dir(base, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = place(self.path)
        files, archive = [], None
        for batch in iterator:
            for k in range(0, batch.num_rows, 64):
                for row in batch.slice(k, 64).to_pylist():
                    if archive is None:
                        files.append(f"{uuid.uuid4().hex}.warc.zst")
                        archive = Archive(fs.open_output_stream(f"{base}/{files[-1]}", compression=None))
                    archive.add(record(row))
                    if archive.size >= self.most:
                        archive.close()
                        archive = None
        if archive:
            archive.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = place(self.path)
        files = (manifest(fs, base) or []) + [f for m in messages if m for f in m.files]
        with fs.open_output_stream(f"{base}/{MANIFEST}.new") as f:
            f.write(json.dumps(files).encode())
        fs.move(f"{base}/{MANIFEST}.new", f"{base}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = place(self.path)
        for f in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{base}/{f}")


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[OneArchive]:
        fs, base = place(self.path)
        files = manifest(fs, base)
        if files is None:
            files = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(base)) if f.base_name.endswith(".warc.zst"))
        return [OneArchive(f) for f in files] or [OneArchive("")]

    def read(self, partition: OneArchive) -> Iterator[tuple]:
        if not partition.file:
            return
        fs, base = place(self.path)
        with fs.open_input_file(f"{base}/{partition.file}") as f:
            for r in opened(f):
                yield tuple(r.values())


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(WarcSource)
    return spark


def page_records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """RECORDS of pages (page_id, url, html; more columns are ignored). Of equal payloads of so many bytes the page with the least
    id is a response and the others revisit it; others are responses. A null html is an empty payload, a null or empty url is
    left out. Pages without id are never referred to; pages repeated under the least id are responses, too.

    Digests are grouped with partial minima and only those of several pages are joined back; a digest of very many pages is a
    long run of the streamed side, which adaptive execution splits."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    firsts = rows.filter(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1 and first is not null").drop("k")
    rows = rows.join(firsts.hint("shuffle_hash"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return rows.select(
        name("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.lit(DATE).alias("date"),
        F.when(again, name("first")).alias("refers_to"), F.col("digest").alias("payload_digest"), F.col("n").alias("payload_bytes"), F.when(~again, F.col("payload")).alias("payload"),
    )


def archive(pages: DataFrame, path: str) -> None:
    """Writes pages as archives in a folder."""
    registered(pages.sparkSession)
    page_records(pages).write.format("warczst").option("path", path).mode("append").save()


def archived(spark: SparkSession, path: str) -> DataFrame:
    """The records of a folder's archives."""
    return registered(spark).read.format("warczst").option("path", path).load()


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records. What is in an archive is measured again; a
    revisit has its header's word."""
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^urn:page:(-?[0-9]+)$', 1) as long)")
    here = F.col("payload").isNotNull()
    return records.select(
        number("record_id").alias("page_id"), F.when(here, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(here, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return pages_of(archived(spark, path))
