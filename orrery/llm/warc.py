"""WARC in Zstandard: a reader of archives in which every record is a frame of its own, behind a dictionary.

An archive may begin with a skippable frame that holds the dictionary (itself Zstandard or plain). Each further frame is
one record. A file is read by one task in chunks, frame by frame, so memory holds one record and a few chunks, whatever
the file's size. Each record is checked: version line, the named headers, the block's length against Content-Length,
the record's end, nothing behind it in its frame, and a block digest where there is one. What fails gives a row whose
`error` says why, and reading goes on with the next frame; a frame that can't be decoded is skipped up to the next
magic number.

Defined results: an empty file gives no rows; a file that can't be opened, a truncated frame or a broken dictionary
gives a row with an error; null paths give nothing; repeated paths are read once each; an empty list gives no rows. A
record is held whole, whatever its length. Other columns of the list or of the pages are not looked at, whatever their
names; rows that repeat are records each.

write_archives() writes rows of (id, url, body) as such archives: null urls and bodies leave their headers out and read
as null, an empty body has an empty block."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import column, new_path

MAGIC, DICTIONARY = b"\x28\xb5\x2f\xfd", 0x184D2A5D
CHUNK, DICT_SIZE, DICT_SAMPLE = 1 << 17, 16_384, 400
BATCH = 8_000_000
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
FIELDS = "path string, place long, record_type string, record_id string, date string, target_uri string, content_type string, content_length long, headers map<string,string>, block binary, error string"
TYPES = (pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string())
NAMES = [x.split()[0] for x in FIELDS.split(", ")]


def parse(data: bytes) -> tuple[dict[str, str], bytes | None, str | None]:
    """A record's headers (names as in NEEDED where they are of those), its block, and what is wrong with it."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return {}, None, "headers don't end"
    version, *lines = data[:end].split(b"\r\n")
    if not re.fullmatch(rb"WARC/\d+\.\d+", version):
        return {}, None, "no WARC version line"
    headers: dict[str, str] = {}
    known = {x.lower(): x for x in (*NEEDED, "WARC-Target-URI", "Content-Type", "WARC-Block-Digest")}
    last = None
    for raw in lines:
        line = raw.decode("utf-8", "replace")
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            return headers, None, f"bad header line {line[:80]!r}"
        last = known.get(name.strip().lower(), name.strip())
        headers[last] = value.strip()
    if missing := [x for x in NEEDED if not headers.get(x)]:
        return headers, None, "missing " + ", ".join(missing)
    if not headers["Content-Length"].isdecimal():
        return headers, None, "Content-Length is no number"
    size, start = int(headers["Content-Length"]), end + 4
    block, rest = data[start : start + size], data[start + size :]
    if len(block) < size:
        return headers, block, f"block has {len(block)} of {size} bytes"
    if rest != b"\r\n\r\n":
        return headers, block, "more in the frame than one record" if rest[:4] == b"\r\n\r\n" else "the record's end is missing"
    if (digest := headers.get("WARC-Block-Digest", "")).lower().startswith("sha1:") and digest[5:].upper() != base64.b32encode(hashlib.sha1(block).digest()).decode():
        return headers, block, "block digest differs"
    return headers, block, None


def frames(stream) -> Iterator[tuple[int, bytes | None, str | None]]:
    """Place in the file, content and error of every frame but skippable ones. stream: an object with read(n)."""
    held, at = b"", 0
    dictionary, first = None, True

    def more() -> bool:
        nonlocal held
        chunk = stream.read(CHUNK)
        held += chunk
        return bool(chunk)

    while held or more():
        while len(held) < 8 and more():
            pass
        magic = held[:4]
        if len(held) >= 8 and 0x184D2A50 <= struct.unpack("<I", magic)[0] <= 0x184D2A5F:
            (size,) = struct.unpack("<I", held[4:8])
            while len(held) < 8 + size and more():
                pass
            if len(held) < 8 + size:
                yield at, None, "truncated skippable frame"
                return
            if first and struct.unpack("<I", magic)[0] == DICTIONARY:
                own = held[8 : 8 + size]
                try:
                    own = zstandard.ZstdDecompressor().decompressobj().decompress(own) if own[:4] == MAGIC else own
                    dictionary = zstandard.ZstdCompressionDict(own)
                except zstandard.ZstdError as e:
                    yield at, None, f"broken dictionary: {e}"
            held, at, first = held[8 + size :], at + 8 + size, False
            continue
        first = False
        if magic != MAGIC:
            start = at
            while (i := held.find(MAGIC, 1)) < 0:
                at, held = at + max(0, len(held) - 3), held[-3:]
                if not more():
                    yield start, None, "no frame here"
                    return
            at, held = at + i, held[i:]
            yield start, None, "no frame here"
            continue
        d = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        start, parts, fed = at, [], held
        try:
            while True:
                parts.append(d.decompress(fed))
                at += len(fed)
                if d.eof:
                    break
                fed = stream.read(CHUNK)
                if not fed:
                    yield start, None, "truncated frame"
                    return
            held = d.unused_data
            at -= len(held)
            yield start, b"".join(parts), None
        except zstandard.ZstdError as e:
            # the next frame is looked for in the chunk that failed
            i = fed.find(MAGIC, 1)
            at, held = (at + i, fed[i:]) if i > 0 else (at + len(fed), b"")
            yield start, None, f"frame can't be decoded: {e}"


def rows_of(path: str) -> Iterator[tuple]:
    try:
        system, name = fs.FileSystem.from_uri(path)
        stream = system.open_input_stream(name, compression=None, buffer_size=CHUNK)
    except (OSError, pa.ArrowException, ValueError) as e:
        yield path, 0, *[None] * 5, None, None, None, f"can't be opened: {e}"
        return
    with stream:
        for place, data, error in frames(stream):
            headers, block = {}, None
            if error is None:
                headers, block, error = parse(data)
            length = headers.get("Content-Length", "")
            yield path, place, headers.get("WARC-Type"), headers.get("WARC-Record-ID"), headers.get("WARC-Date"), headers.get("WARC-Target-URI"), headers.get("Content-Type"), int(length) if length.isdecimal() else None, list(headers.items()), block, error


def read_archives(paths: DataFrame) -> DataFrame:
    """The records of the archives that the column `path` names (with scheme), a task for each file."""
    files = paths.select(column(paths, "path").cast("string").alias("path")).filter("path is not null")

    def run(batches):
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)

        for b in batches:
            for path in b["path"].to_pylist():
                for row in rows_of(path):
                    rows.append(row)
                    size += len(row[9] or b"") + 500
                    if size > BATCH:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()

    return files.mapInArrow(run, FIELDS)


def record(number: int | None, url: str | None, body: str | None) -> bytes:
    block = (body or "").encode("utf-8", "replace")
    lines = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:page:{'' if number is None else number}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    if body is not None:
        lines.append("Content-Type: text/html")
    lines += [f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "replace") + block + b"\r\n\r\n"


def dictionary_of(sample: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the sample; where that is too little to train on, the sample's own beginning."""
    try:
        return zstandard.train_dictionary(DICT_SIZE, sample)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICT_SIZE], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archives(pages: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Writes rows of page_id, url, html as archives in folder, one for each task; the column `path` names them."""
    p = pages.select(column(pages, "page_id").cast("long").alias("id"), column(pages, "url").cast("string").alias("url"), column(pages, "html").cast("string").alias("body"))

    def run(batches):
        path = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.zst"
        system, name = fs.FileSystem.from_uri(folder)
        out, squeeze = None, None
        for b in batches:
            every = [record(*r) for r in zip(b["id"].to_pylist(), b["url"].to_pylist(), b["body"].to_pylist(), strict=True)]
            if out is None and every:
                system.create_dir(name, recursive=True)
                out = system.open_output_stream(name + path[len(folder) :], compression=None)
                # the dictionary is fitted on the first records of the file, of bounded number
                d = dictionary_of(every[:DICT_SAMPLE])
                own = zstandard.ZstdCompressor(level=19).compress(d.as_bytes())
                out.write(struct.pack("<II", DICTIONARY, len(own)) + own)
                squeeze = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True)
            for x in every:
                out.write(squeeze.compress(x))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    return p.mapInArrow(run, "path string")


def through_archives(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, html and error of every page, by way of archives in the shared folder."""
    folder = new_path(spark, "warc")
    paths = [r.path for r in write_archives(pages, folder).collect()]  # a name for each task
    files = spark.createDataFrame([(x,) for x in paths], "path string").repartition(max(1, len(paths)))
    r = read_archives(files)
    return r.select(
        F.regexp_extract("record_id", r"^<urn:page:(-?\d*)>$", 1).try_cast("long").alias("page_id"),
        F.col("target_uri").alias("url"),
        F.when(F.col("content_type").isNotNull(), F.col("block").cast("string")).alias("html"),
        "error",
    )


SQL = "SELECT page_id, url, html, CAST(NULL AS VARCHAR) AS error FROM pages"
