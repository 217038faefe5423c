"""WARC archives as a data source: one gzip member per record, read in order.

``WarcSource`` writes rows as records into archive files and reads archive files into rows. The reader
takes a file from front to back in blocks of bounded size: each member is inflated step by step, its
record's header gives the length of the block behind it, and digests are taken of the bytes as they
pass. What is damaged gives a row that says so, and reading goes on at the next member.

Tasks write files of names of their own and only the files that the job's commit lists count, so that a
task that runs again leaves no record twice. Files are opened through pyarrow's file systems.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import BATCH_BYTES, cut, shared_dir, small_batches

RECORD = "record_id string, record_type string, target_uri string, refers_to string, http string, payload binary, payload_digest string"
READ = "file string, at bigint, record_id string, record_type string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, payload binary, damage string"
#: A payload of fewer bytes is stored again rather than referred to.
LEAST_SHARED = 100
#: Bytes after which a task begins a new file, and bytes that the reader holds of a file at a time.
FILE_BYTES, READ_BYTES = 256 << 20, 1 << 16
#: Bytes that a record's header may take.
MOST_HEADER = 1 << 20
# Names and forms of the archive format.
VERSION, END = "WARC/1.1", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GZIP = b"\x1f\x8b\x08"


def _opened(path: str):
    """A file system of pyarrow and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def record(row: dict, date: str) -> bytes:
    """The bytes of one record, uncompressed. A header's text loses its line breaks; revisits have no payload, only what tells of it."""
    clean = lambda x: "".join(" " if c in "\r\n" else c for c in x)
    payload = row["payload"] or b""
    http = clean(row["http"] or "")
    block = (http.replace(" | ", "\r\n") + "\r\n\r\n").encode() + payload if http else payload
    said = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{clean(row['record_id'])}>"), ("WARC-Date", date), ("WARC-Target-URI", row["target_uri"]),
        ("WARC-Payload-Digest", f"sha256:{row['payload_digest'] or sha256(payload)}"), ("WARC-Block-Digest", f"sha256:{sha256(block)}"),
        ("WARC-Refers-To", f"<{clean(row['refers_to'])}>" if row["refers_to"] else None), ("WARC-Profile", PROFILE if row["record_type"] == "revisit" else None),
        ("Content-Type", "application/http;msgtype=response" if http else "text/html"), ("Content-Length", str(len(block))),
    ]
    head = "\r\n".join([VERSION, *(f"{k}: {clean(v)}" for k, v in said if v is not None)])
    return head.encode() + END + block + END


def member(data: bytes) -> bytes:
    """One gzip member, without a time, so that equal records give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, date: str, file_bytes: int):
        self.path, self.date, self.file_bytes = path, date, file_bytes

    def write(self, batches) -> WriterCommitMessage:
        files, stream, size = [], None, 0
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for k in range(batch.num_rows):  # one record's bytes at a time
                if stream is None or size >= self.file_bytes:
                    if stream is not None:
                        stream.close()
                        files[-1] = (files[-1][0], size)
                    files.append((f"records-{uuid.uuid4().hex}.warc.gz", 0))
                    stream, size = system.open_output_stream(f"{folder}/{files[-1][0]}", compression=None), 0
                size += stream.write(member(record(batch.slice(k, 1).to_pylist()[0], self.date)))
        if stream is not None:
            stream.close()
            files[-1] = (files[-1][0], size)
        return _Written(files)

    def commit(self, messages) -> None:
        system, folder = _opened(self.path)
        files = sorted(f for m in messages if m for f in m.files)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/_archives-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        """Files without a commit are never read."""


class Members:
    """The members of an archive stream: inflates one at a time, and finds the next one behind damage."""

    def __init__(self, stream):
        self.stream, self.held, self.at, self.over = stream, b"", 0, False

    def _more(self) -> bool:
        data = b"" if self.over else self.stream.read(READ_BYTES)
        self.over |= not data
        self.held += data
        return bool(data)

    def begin(self) -> bool:
        """Whether another member begins; ``at`` is where."""
        while len(self.held) < 3 and self._more():
            pass
        self.z = zlib.decompressobj(31)
        return bool(self.held)

    def read(self) -> bytes:
        """Some bytes of the member, of bounded number; none at its end."""
        while not self.z.eof:
            if not self.held and not self._more():
                raise ValueError("the file ends within a record")
            out = self.z.decompress(self.held, READ_BYTES)
            left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            self.at += len(self.held) - len(left)
            self.held = left
            if out:
                return out
        return b""

    def skip(self) -> None:
        """To the next place that looks like a member's begin."""
        while True:
            found = self.held.find(_GZIP)
            if found >= 0:
                self.at, self.held = self.at + found, self.held[found:]
                return
            drop = max(0, len(self.held) - 2)
            self.at, self.held = self.at + drop, self.held[drop:]
            if not self._more():
                self.at, self.held = self.at + len(self.held), b""
                return


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines) if sep} | {"": lines[0]}


def _one(members: Members, with_payload: bool) -> dict:
    """The record of the member that begins; raises ValueError or zlib.error where it is damaged."""
    held = b""
    while END not in held:
        if len(held) > MOST_HEADER:
            raise ValueError("no end of the header")
        if not (data := members.read()):
            raise ValueError("the record ends within its header")
        held += data
    head, _, held = held.partition(END)
    told = _headers(head)
    if not told[""].startswith("WARC/") or not told.get("content-length", "").isdigit():
        raise ValueError("no header of a record")
    left, of_block, of_payload = int(told["content-length"]), hashlib.sha256(), hashlib.sha256()
    http, kept, size = b"" if "application/http" in told.get("content-type", "") else None, [], 0
    while left:
        if not held and not (held := members.read()):
            raise ValueError("the record is shorter than its length")
        data, held = held[:left], held[left:]
        left -= len(data)
        of_block.update(data)
        if http is not None and END not in http:
            if len(http) > MOST_HEADER:
                raise ValueError("no end of the header")
            http += data
            if END not in http:
                continue
            head, _, data = http.partition(END)
            http = head + END
        of_payload.update(data)
        size += len(data)
        if with_payload:
            kept.append(data)
    while len(held) <= len(END) and (data := members.read()):
        held += data
    if held != END:
        raise ValueError("the record does not end behind its block")
    bare = lambda name: told.get(name, "").removeprefix("sha256:") if told.get(name, "").startswith("sha256:") else None
    unkept = told.get("warc-type") == "revisit"
    damage = None
    if bare("warc-block-digest") not in (None, of_block.hexdigest()):
        damage = "the block's digest differs"
    elif not unkept and bare("warc-payload-digest") not in (None, of_payload.hexdigest()):
        damage = "the payload's digest differs"
    if unkept and http is not None:  # the stored answer's header tells the length
        length = _headers(http).get("content-length", "")
        size = int(length) if length.isdigit() else None
    id_of = lambda name: told[name].strip("<>") if name in told else None
    return {
        "record_id": id_of("warc-record-id"), "record_type": told.get("warc-type"), "target_uri": told.get("warc-target-uri"), "refers_to": id_of("warc-refers-to"), "payload_bytes": size,
        "payload_digest": bare("warc-payload-digest") or (None if unkept else of_payload.hexdigest()), "payload": b"".join(kept) if with_payload and not unkept else None, "damage": damage,
    }


def records(stream, file: str, with_payload: bool):
    """A dict for each record of an archive stream, in order."""
    members = Members(stream)
    while members.begin():
        at = members.at
        try:
            yield {"file": file, "at": at, **_one(members, with_payload)}
        except (ValueError, zlib.error) as e:
            yield {"file": file, "at": at, "damage": str(e)}
            if members.at == at:  # not a byte was taken: step over what looked like a begin
                members.at, members.held = at + 1, members.held[1:]
            members.skip()


class _Part(InputPartition):
    def __init__(self, file: str):
        self.file = file


class _Reader(DataSourceReader):
    def __init__(self, path: str, with_payload: bool, schema):
        self.path, self.with_payload, self.schema = path, with_payload, schema

    def partitions(self):
        """A file each: those that commits list, or all of a folder that none wrote; a path may also name one file."""
        from pyarrow import fs

        system, folder = _opened(self.path)
        if system.get_file_info(folder).type == fs.FileType.File:
            return [_Part(folder)]
        every = [i.path for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.File]
        lists = [p for p in every if p.rsplit("/", 1)[-1].startswith("_archives-")]
        if not lists:
            return [_Part(p) for p in sorted(every) if p.endswith(".warc.gz")]
        named = [n for p in lists for n, _ in json.loads(system.open_input_stream(p).read())]
        return [_Part(f"{folder}/{n}") for n in sorted(named)]

    def read(self, part):
        if part is None or part.file is None:
            return
        system, _ = _opened(self.path)
        kinds = pa.schema([(n, {"bigint": pa.int64(), "binary": pa.binary()}.get(k, pa.string())) for n, k in (c.split(" ") for c in READ.split(", "))])
        held, size = [], 0
        with system.open_input_stream(part.file, compression=None) as stream:
            for r in records(stream, part.file.rsplit("/", 1)[-1], self.with_payload):
                held.append(r)
                size += 500 + len(r.get("payload") or b"")
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, kinds)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")`` once registered.

    Options: ``path``; ``date`` (of the records written), ``fileBytes`` (after which a task begins a new file);
    ``payload`` ("false" leaves payloads out of the rows; digests are verified all the same).
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("payload", "true").lower() != "false", schema)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"), int(self.options.get("filebytes", FILE_BYTES)))


def write_records(rows: DataFrame, path: str) -> None:
    """Appends rows (RECORD) to the archives in a folder."""
    rows.sparkSession.dataSource.register(WarcSource)
    small_batches(rows.sparkSession)
    rows.select(*(c.split(" ")[0] for c in RECORD.split(", "))).write.format("warc").mode("append").save(path)


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of a folder of archives, or of one archive file, as READ."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_records(pages: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """Rows (RECORD) of ``pages`` (page_id, url, html): responses, and revisits of payloads stored already.

    Of equal payloads of ``least_shared`` bytes or more the row of least page_id, then least url, is the response.
    Payloads meet as maxima kept a task, and rows that refer to them by digest, without their payloads.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    who = lambda i: F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.substring(F.sha2(F.concat_ws("|", F.coalesce("url", F.lit("")), "payload_digest"), 256), 1, 16), F.lit(":"), i.cast("string"))
    http = F.concat(F.lit("HTTP/1.1 200 OK | Content-Type: text/html; charset=utf-8 | Content-Length: "), F.col("n_bytes").cast("string"))
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    shared = F.col("n_bytes") >= least_shared
    slim = cut(rows.where(shared).groupBy("payload_digest", "page_id", "url", "n_bytes").agg(F.count(F.lit(1)).alias("n")))
    first = slim.groupBy("payload_digest").agg(F.min(key).alias("k"))
    kept = rows.where(shared).groupBy("payload_digest").agg(F.min(F.struct(*(F.col("page_id").isNull().alias("none"), F.col("page_id"), F.col("url").isNull().alias("no_url"), F.col("url"), F.col("n_bytes"), F.col("payload")))).alias("f"))
    kept = kept.select("payload_digest", "f.page_id", "f.url", "f.n_bytes", "f.payload")
    zero = F.lit(0)
    responses = kept.select(who(zero).alias("record_id"), F.lit("response").alias("record_type"), "url", F.lit(None).cast("string").alias("refers_to"), http.alias("http"), "payload", "payload_digest")
    met = slim.join(first, "payload_digest")
    own = F.col("page_id").eqNullSafe(F.col("k.page_id")) & F.col("url").eqNullSafe(F.col("k.url"))
    again = met.withColumn("i", F.explode(F.when(F.when(own, 1).otherwise(0) < F.col("n"), F.sequence(F.when(own, F.lit(1)).otherwise(F.lit(0)).cast("long"), F.col("n") - 1)).otherwise(F.array().cast("array<bigint>"))))
    head = F.concat(F.lit("urn:page:"), F.coalesce(F.col("k.page_id").cast("string"), F.lit("")), F.lit(":"), F.substring(F.sha2(F.concat_ws("|", F.coalesce("k.url", F.lit("")), "payload_digest"), 256), 1, 16), F.lit(":0"))
    revisits = again.select(who(F.col("i")).alias("record_id"), F.lit("revisit").alias("record_type"), "url", head.alias("refers_to"), http.alias("http"), F.lit(None).cast("binary").alias("payload"), "payload_digest")
    small = rows.where(~shared).select(who(F.monotonically_increasing_id()).alias("record_id"), F.lit("response").alias("record_type"), "url", F.lit(None).cast("string").alias("refers_to"), http.alias("http"), "payload", "payload_digest")
    return responses.unionByName(revisits).unionByName(small).withColumnRenamed("url", "target_uri")


def archive_pages(pages: DataFrame, path: str | None = None, payload: bool = False) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) into archives and reads them back; ``path`` defaults to a new folder among the shared ones.

    Defined cases: a null html is an empty payload; a null url leaves the target out; line breaks in a url become spaces; rows
    that repeat each get a record, of which one at most is a response if they are large enough; a null page_id comes
    behind all others; html of any length is one record; an empty table gives no record; other columns are ignored.
    """
    path = path or f"{shared_dir(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    write_records(page_records(pages), path)
    return read_records(pages.sparkSession, path, payload)


def page_digest(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records that ``archive_pages`` wrote; a damaged one stops the job."""
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+):", 1).try_cast("long")
    whole = read.withColumn("fine", F.when(F.col("damage").isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("archive"), "file", F.lit("at"), "at", F.lit(": "), "damage"))).otherwise(F.lit(True))).where("fine")
    return whole.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
