"""WARC archives of Zstandard-compressed records with an embedded dictionary.

Every task writes one archive.  It trains a dictionary on the first records it archives (a bounded
sample, which only affects compression), puts it into a leading skippable frame, and compresses each record
as a frame of its own with it.  Equal payloads are stored once: the others become revisit records.

Files are written through the file system of the folder's URI under names of their own for each attempt, and
the table of files (the manifest) is checkpointed, so a repeated task leaves at most an unlisted file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, ensure_checkpoint_dir, skew_join, text_of

SKIPPABLE = 0x184D2A5D  # frame that holds the dictionary
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def filesystem(uri: str):
    """pyarrow file system and path of a folder's URI."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.LocalFileSystem() if uri.startswith("/") else fs.FileSystem.from_uri(uri)[0], uri if uri.startswith("/") else fs.FileSystem.from_uri(uri)[1]


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has no payload."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    block = http + (payload if refers_to is None else b"")
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:x-page:{page_id}>"), ("WARC-Target-URI", target), ("WARC-Date", date),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(block))), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:x-page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    return CRLF.join([b"WARC/1.1", *(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in head)]) + 2 * CRLF + block + 2 * CRLF


def parse(rec: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block."""
    head, _, rest = rec.partition(2 * CRLF)
    lines = head.split(CRLF)
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC record")
    headers = {k.decode().lower(): v.decode("utf-8", "surrogatepass") for k, _, v in (x.partition(b": ") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != 2 * CRLF:
        raise ValueError("the block's length differs from the header's")
    return headers, rest[:n]


def train(samples: list[bytes], size: int):
    """A dictionary of the samples, or None if they are too few or too small to train one."""
    import zstandard
    if len(samples) < 8 or sum(map(len, samples)) < 8 * size:
        size = sum(map(len, samples)) // 8
    if len(samples) < 8 or size < 256:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8)
    except zstandard.ZstdError:
        return None


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 1000, dictionary_bytes: int = 16_384, sample_bytes: int = 1 << 19,
                   level: int = 6, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive every page; returns the manifest (file, records, bytes, dictionary_bytes).

    Of records with equal payloads of ``min_revisit_bytes`` or more, those with the largest id are responses and the others
    revisit it; rows that repeat id and payload are all responses.  Null html is an empty payload, a null url
    ``about:blank``; rows with a null id revisit the largest id, or are responses if there is none.  An empty table writes nothing.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("payload"))
    p = p.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    same = (p.where(F.col("size") >= min_revisit_bytes).groupBy("digest", "size").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("digest", "size", "last"))
    rows = skew_join(p, same, ["digest", "size"], "left").select(
        F.col("id").cast("string").alias("id"), "url", "payload", "digest",
        F.when(~F.col("id").eqNullSafe(F.col("last")), F.col("last")).cast("string").alias("refers_to"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        fs, path = filesystem(folder)
        name = f"{uuid.uuid4().hex}.warc.zst"
        out = comp = dictionary = None
        held: list[bytes] = []
        n = size = dict_size = held_bytes = 0

        def start():
            nonlocal out, comp, dictionary, size, dict_size
            fs.create_dir(path, recursive=True)
            out = fs.open_output_stream(f"{path}/{name}.part", compression=None)
            dictionary = train(held, dictionary_bytes)
            if dictionary is not None:
                raw = dictionary.as_bytes()
                dict_size = len(raw)
                out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
                size += 8 + len(raw)
                dictionary.precompute_compress(level=level)
            comp = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True, write_content_size=True)

        def put():
            nonlocal n, size
            for r in held:
                frame = comp.compress(r)
                out.write(frame)
                n += 1
                size += len(frame)
            held.clear()
        for b in it:
            for i in range(b.num_rows):
                rid, url, payload, digest, ref = (b.column(c)[i].as_py() for c in ("id", "url", "payload", "digest", "refers_to"))
                held.append(record(rid, url, payload.encode("utf-8"), digest, ref, date))
                held_bytes += len(held[-1])
                if out is None and held_bytes >= sample_bytes:
                    start()
                if out is not None:
                    put()
        if held:
            start()
            put()
        if out is not None:
            out.close()
            fs.move(f"{path}/{name}.part", f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64()), pa.array([dict_size], pa.int64())],
                                             ["file", "records", "bytes", "dictionary_bytes"])
    return cut_lineage(rows.mapInArrow(run, "file string, records long, bytes long, dictionary_bytes long"))


def records_of(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Decompressed records of one archive, one at a time."""
    import zstandard
    data = stream.read(8)
    dictionary = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        dictionary = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", data[4:])[0]))
        data = b""
    ctx = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        obj, parts = ctx.decompressobj(), []
        while not obj.eof:
            data = data or stream.read(chunk)
            if not data:
                if parts:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(obj.decompress(data))
            data = obj.unused_data if obj.eof else b""
        yield b"".join(parts)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload of every record of the listed files.

    A response's digest is computed from its payload and must equal the header's.
    """
    files = max(1, manifest.count())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        number = lambda s: None if s in (None, "<urn:x-page:None>") else int(s[len("<urn:x-page:"):-1])
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for b in it:
            for name in b.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for rec in records_of(stream):
                        h, block = parse(rec)
                        payload = block.partition(2 * CRLF)[2]
                        digest = base64.b32decode(h["warc-payload-digest"][len("sha1:"):]).hex()
                        if h["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(h["x-payload-length"])):
                            raise ValueError(f"payload of {h['warc-record-id']} differs from its header")
                        rows.append((number(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], int(h["x-payload-length"]), digest,
                                     number(h.get("warc-refers-to")), payload if h["warc-type"] == "response" else None))
                        held += len(rec)
                        if held >= 1 << 22:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)
    return manifest.select("file").repartition(files).mapInArrow(
        run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def archive_folder(spark) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
