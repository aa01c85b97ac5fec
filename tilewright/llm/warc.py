"""WARC archives under Zstandard: one frame a record, behind a dictionary in a leading skippable frame.

Tasks write archives of bounded size into a shared folder and hand on their paths; what counts as written is the table of these paths, so files of attempts
that failed are never read. Readers stream: a frame is decoded at a time, its record checked against its headers, lengths and digests, and what
doesn't hold is named in the row instead of failing the job. Behind a broken frame reading goes on at the next one that holds a record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARROW, Scratch, hashed_sample, shared_dir, split_batch

#: Fixed values of the formats: magic numbers, record types, the revisit profile, the headers that every record has.
FRAME, DICTIONARY, DICTIONARY_FRAME = b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec", b"\x5d\x2a\x4d\x18"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Compressed bytes after which a task begins another archive, bytes of payload in a batch of rows, and bytes read at a time.
ARCHIVE_BYTES, BATCH_BYTES, READ_BYTES = 1 << 26, 1 << 22, 1 << 18

DATE = "2024-01-01T00:00:00Z"
COLUMNS = "path string, record long, offset long, record_type string, record_id string, target_uri string, page_id string, refers_to_id string, refers_to string, payload_bytes long, payload_digest string, payload binary, problem string"
_SCHEMA = pa.schema([(n, ARROW[t]) for n, t in (x.split() for x in COLUMNS.split(", "))])


# --- records


def digest_field(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def digest_hex(field: str) -> str | None:
    """The lower-case hex form of a sha1 field in base 32 or hex; None if it is neither."""
    kind, _, value = field.partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch("[0-9a-fA-F]{40}", value):
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else None
    except ValueError:
        return None


def record_id(page: str | None, payload: str) -> str:
    """The same for the same page and payload, so a revisit can name a record that another task writes."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}/{payload}')}>"


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record; headers that are None are left out, and what a header can't hold is percent-encoded."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    lines += [f"{k}: {re.sub('[^!-~\u0080-\U0010ffff]', lambda m: ''.join(f'%{b:02X}' for b in m[0].encode()), v)}" if k == "WARC-Target-URI" else f"{k}: {v}" for k, v in headers if v is not None]
    lines += [f"WARC-Block-Digest: {digest_field(block)}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page: str | None, url: str | None, payload: bytes, response: str | None, date: str) -> bytes:
    """The record of a page: a response with its payload, or a revisit of page `response`, which has the same payload."""
    digest = digest_field(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", date), ("WARC-Target-URI", url), ("X-Page-ID", page), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if response is None:
        return record("response", headers, http + payload)
    headers[0] = ("WARC-Record-ID", record_id(page, f"{digest}/{response}"))
    return record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(response, digest)), ("X-Refers-To-Page-ID", response)], http)


def parse(raw: bytes) -> dict:
    """The columns of a record, and under problem what is wrong with it (else None)."""
    out: dict = dict.fromkeys(("record_type", "record_id", "target_uri", "page_id", "refers_to_id", "refers_to", "payload_bytes", "payload_digest", "payload", "problem"))

    def wrong(what: str) -> dict:
        return out | {"problem": what}

    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        return wrong("no end of the headers")
    try:
        version, *lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError:
        return wrong("headers aren't UTF-8")
    if not re.fullmatch(r"WARC/1\.[01]", version):
        return wrong("no WARC version")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            return wrong("a header without a name")
        if name.lower() in fields and name.lower() in REQUIRED:
            return wrong(f"{name.lower()} comes twice")
        fields.setdefault(name.lower(), value.strip(" \t"))
    out |= {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "page_id": fields.get("x-page-id"), "refers_to_id": fields.get("warc-refers-to"), "refers_to": fields.get("x-refers-to-page-id")}
    for name in REQUIRED:
        if name not in fields:
            return wrong(f"no {name}")
    if out["record_type"] not in TYPES:
        return wrong("unknown type")
    if not re.fullmatch(r"<[a-zA-Z][a-zA-Z0-9+.-]*:[!-~]+>", out["record_id"]):
        return wrong("record id is no URI")
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z", fields["warc-date"], re.ASCII):
        return wrong("date isn't in UTC")
    if not re.fullmatch("[0-9]+", fields["content-length"]):
        return wrong("content length is no number")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        return wrong(f"content length {size}, {len(rest) - 4} found")
    block = rest[:size]
    if "warc-block-digest" in fields and digest_hex(fields["warc-block-digest"]) != hashlib.sha1(block).hexdigest():
        return wrong("block digest differs")
    if out["record_type"] not in ("response", "revisit"):
        return out
    http, gap, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?i)(?:^|\r\n)content-length:[ \t]*([0-9]+)[ \t]*(?:\r\n|$)", http)
    if not gap or not http.startswith(b"HTTP/"):
        return wrong("no HTTP headers")
    declared = digest_hex(fields.get("warc-payload-digest", ""))
    if out["record_type"] == "revisit":
        if payload or not out["refers_to_id"] or not declared or not said:
            return wrong("a revisit has no payload, but its digest, its length and what it refers to")
        return out | {"payload_bytes": int(said[1]), "payload_digest": declared}
    found = hashlib.sha1(payload).hexdigest()
    if said and int(said[1]) != len(payload):
        return wrong(f"payload length {int(said[1])}, {len(payload)} found")
    if "warc-payload-digest" in fields and declared != found:
        return wrong("payload digest differs")
    return out | {"payload_bytes": len(payload), "payload_digest": found, "payload": payload}


# --- archives


def train(samples: list[bytes], size: int = 1 << 16) -> bytes:
    """A dictionary from sample records; empty where they are too few for one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


class Writer:
    """Writes records into archives of about `most` bytes below a folder; done() gives (path, records, bytes) of each."""

    def __init__(self, folder: str, dictionary: bytes, date: str, most: int = ARCHIVE_BYTES, level: int = 3):
        import zstandard

        self.folder, self.dictionary, self.date, self.most, self.out, self.written = folder, dictionary, date, most, None, []
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if given:
            given.precompute_compress(level=level)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=given, write_checksum=True).compress

    def add(self, raw: bytes) -> None:
        if self.out is None:
            fs, folder = file_system(self.folder)
            name = f"{uuid.uuid4().hex}.warc.zst"
            self.out, self.path, self.n, self.size = fs.open_output_stream(f"{folder}/{name}", compression=None), f"{self.folder}/{name}", 0, 0
            if self.dictionary:
                self._put(DICTIONARY_FRAME + struct.pack("<I", len(self.dictionary)) + self.dictionary)
            info = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            self._put(self.compress(info))
        self._put(self.compress(raw))
        self.n += 1
        if self.size >= self.most:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.written.append((self.path, self.n, self.size))
            self.out = None

    def done(self) -> list[tuple[str, int, int]]:
        self.close()
        return self.written


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match("[a-z0-9+.-]+:", path) else (fs.LocalFileSystem(), path)


class Frames:
    """(offset, bytes, problem) of each frame of an archive, decoded one at a time from a stream."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.held, self.pos, self.base, self.z = stream, b"", 0, 0, zstandard
        self.context = zstandard.ZstdDecompressor()

    def _peek(self, n: int) -> bytes:
        while len(self.held) - self.pos < n and (more := self.stream.read(max(READ_BYTES, n - len(self.held) + self.pos))):
            self.held, self.base, self.pos = self.held[self.pos :] + more, self.base + self.pos, 0
        return self.held[self.pos : self.pos + n]

    def _seek(self, offset: int) -> None:
        if self.base <= offset <= self.base + len(self.held):
            self.pos = offset - self.base
        else:
            self.stream.seek(offset)
            self.held, self.pos, self.base = b"", 0, offset

    def _load(self, raw: bytes) -> None:
        if raw[:4] == FRAME:
            raw = self.z.ZstdDecompressor().decompressobj().decompress(raw)
        if raw[:4] != DICTIONARY:
            raise ValueError("the leading frame holds no dictionary")
        self.context = self.z.ZstdDecompressor(dict_data=self.z.ZstdCompressionDict(raw))

    def _decode(self) -> bytes:
        """The frame that begins here, decoded; reading goes on behind it."""
        decoder, parts, step = self.context.decompressobj(), [], 1 << 14
        while True:
            if self.pos == len(self.held):
                self.base, self.held, self.pos = self.base + self.pos, self.stream.read(READ_BYTES), 0
                if not self.held:
                    raise ValueError("frame cut off")
            chunk = memoryview(self.held)[self.pos : self.pos + step]
            parts.append(decoder.decompress(chunk))
            if decoder.eof:
                self.pos += len(chunk) - len(decoder.unused_data)
                return b"".join(parts)
            self.pos, step = self.pos + len(chunk), READ_BYTES

    def __iter__(self) -> Iterator[tuple[int, bytes, str | None]]:
        first = True
        while head := self._peek(4):
            begin = self.base + self.pos
            if 0x50 <= head[0] <= 0x5F and head[1:] == DICTIONARY_FRAME[1:] and len(self._peek(8)) == 8:  # skippable
                size = struct.unpack("<I", self._peek(8)[4:])[0]
                if first and head == DICTIONARY_FRAME:
                    try:
                        if len(raw := self._peek(8 + size)[8:]) < size:
                            raise ValueError("dictionary cut off")
                        self._load(raw)
                    except (ValueError, self.z.ZstdError) as e:
                        yield begin, b"", said(e)
                self._seek(begin + 8 + size)
                first = False
                continue
            first = False
            try:
                if head != FRAME:
                    raise ValueError("no frame")
                raw = self._decode()
            except (ValueError, self.z.ZstdError) as e:
                yield begin, b"", said(e)
                self._seek(begin + 1)
                self._resume()
                continue
            yield begin, raw, None

    def _resume(self) -> None:
        """To the next place where a frame begins that decodes to a record, or the end."""
        while len(self._peek(4)) == 4:
            k = self.held.find(FRAME, self.pos)
            self.pos = k if k >= 0 else len(self.held) - 3
            if k < 0:
                continue
            try:
                if self.context.decompressobj().decompress(self._peek(1 << 14)).startswith(b"WARC/"):
                    return
            except self.z.ZstdError:
                pass
            self.pos += 1
        self.pos = len(self.held)


def said(error: Exception) -> str:
    return re.sub(r"\s+", " ", str(error))


def records_of(path: str) -> Iterator[dict]:
    """The columns of each record of an archive, by COLUMNS; frames and records that are broken have a problem."""
    fs, inside = file_system(path)
    with fs.open_input_file(inside) as stream:
        for n, (offset, raw, problem) in enumerate(Frames(stream)):
            yield {"path": path, "record": n, "offset": offset} | (parse(raw) if problem is None else parse(b"") | {"problem": problem})


# --- frames


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload and response: of equal payloads of least_bytes or more, the largest id (as its type orders) is the response of all
    rows with another id; response is null for rows that are responses themselves. Rows that repeat that id are responses too; a row without an
    id revisits if any row of its group has one.

    What is grouped and joined are digests. Only rows whose payload comes again join by it; a group of any size is split by adaptive execution.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    large = F.octet_length("payload") >= least_bytes
    groups = rows.where(large).groupBy(F.sha2("payload", 256).alias("_k")).agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_c")).where("_c > 1 and _last is not null").drop("_c")
    key = F.when(large, F.sha2("payload", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url", "payload").cast("string")))  # small ones meet nothing, wherever they go
    found = rows.withColumn("_k", key).join(groups, "_k", "left")
    return found.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last")).alias("response"))


def sample_dictionary(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", max_samples: int = 1000, sample_chars: int = 1 << 14) -> bytes:
    """A dictionary for the records of pages, trained on max_samples rows at most, by a hash of their id, of sample_chars characters each. Empty where
    rows are too few or too alike for one."""
    ids = hashed_sample(pages.select(F.col(id_col).alias("id")).where("id is not null"), "id", max_samples)
    some = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.substring(F.col(payload_col).cast("string"), 1, sample_chars).alias("payload")).join(F.broadcast(ids.distinct()), "id").limit(max_samples)
    return train([page_record(str(r["id"]), r["url"], (r["payload"] or "").encode(), None, DATE) for r in some.collect()])


def write_archives(marked: DataFrame, scratch: Scratch, dictionary: bytes = b"", folder: str | None = None, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """path, records and bytes of the archives that hold the rows of mark_revisits(), each row in one; an empty table needs none.

    folder: where archives go, a folder or URI that driver and executors share; a new one below the session's shared folder by default. Each task
    writes its rows, one at a time, and begins another archive after archive_bytes. The archives are written once, when this is called.
    """
    spark = marked.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(made)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(folder, dictionary, date, archive_bytes)
        for batch in batches:
            for part in split_batch(batch, 2):
                for page, url, payload, response in zip(*(c.to_pylist() for c in part.columns)):
                    out.add(page_record(page, url, payload.encode(), response, date))
        if done := out.done():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "records", "bytes"])

    rows = marked.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("response").cast("string").alias("response"))
    return scratch.table(rows.mapInArrow(write, "path string, records long, bytes long"))


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """path and bytes of the archives below a folder, or of those that a glob matches; their content isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of the archives in column path, and for each frame or record that is broken: path, record (from 0, in the archive), offset
    (of its frame), record_type, record_id, target_uri, page_id and refers_to (as written, null elsewhere), refers_to_id, payload_bytes and payload_digest (SHA-1, bare
    lower-case hex; of a revisit as its headers state), payload (null for revisits, and without `payloads`), problem (null if all holds).

    An archive is streamed by one task, a record at a time. Archives without a leading dictionary are read as they are.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in records_of(path):
                    size += len(row["payload"] or b"") if payloads else 0
                    held.append(row if payloads else row | {"payload": None})
                    if size >= BATCH_BYTES or len(held) >= 4096:
                        yield pa.RecordBatch.from_pylist(held, _SCHEMA)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, _SCHEMA)

    paths = archives.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(read, COLUMNS)  # a task an archive


def archive_pages(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000, folder: str | None = None) -> DataFrame:
    """path, records and bytes of the archives of pages, a record a row: responses, and revisits of the row with the largest id among equal payloads.

    Null payloads are empty ones. Null urls have no target, and what isn't printable in a url is percent-encoded. Payloads of any length are taken whole.
    """
    dictionary = sample_dictionary(pages, id_col, url_col, payload_col)
    return write_archives(mark_revisits(pages, id_col, url_col, payload_col, least_bytes), scratch, dictionary, folder)


def read_pages(records: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Of read_archives(): a row a page. A record or frame that doesn't hold ends the query with its place and problem."""
    place = F.concat_ws(" ", "path", F.col("offset").cast("string"), "problem")
    page = F.when(F.col("problem").isNotNull(), F.raise_error(place).cast(id_type)).otherwise(F.col("page_id").cast(id_type))
    return records.where("problem is not null or record_type in ('response', 'revisit')").select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))
