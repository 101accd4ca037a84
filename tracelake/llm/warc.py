"""ARC archives converted to WARC, with identical payloads recorded once.

ARC files hold records of a header line, whose fields depend on the version that the file's first
record declares, and as many bytes of content as that line says.  The converter reads them by these
declared lengths and writes gzipped WARC records with synthesised identifiers, timestamps, types and
digests.  Content with a HTTP head is a ``response``, whose payload is what follows the head; a payload
that occurs again is a ``revisit`` that refers to the one response; other content is a ``resource``.

Archives never go through a shuffle: they are written and read in place, one task per file.  What is
shuffled to find repeated payloads is an index row per record.  Every attempt writes files of its
own, and a manifest names those of the attempts that succeeded.  A damaged record becomes a row that
says where and why, and the rest of its file is converted.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.storage import materialize, new_path

#: The fields of a URL record's header line, by ARC version.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length".split(),
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are always recorded in full.
MIN_REVISIT_BYTES = 1000
#: URLs and content types may hold spaces; what stands between and after them may not.
_HEADER_LINES = {
    "1": re.compile(r"(\S.*?) (\S+) (\d{4,17}) (.*) (\d+)"),
    "2": re.compile(r"(\S.*?) (\S+) (\d{4,17}) (.*) (\S+) (\S+) (\S+) (\d+) (\S+) (\d+)"),
}
_LEVEL = 1
_BATCH = 4096


class ArcError(ValueError):
    """An archive that is not what it declares."""


def arc_file_header(version: str, name: str, date: str) -> bytes:
    """The record that opens an ARC file: its version block and the names of the fields."""
    block = f"{version} 0 tracelake\n{' '.join(ARC_FIELDS[version])}\n".encode()
    if version == "1":
        line = f"filedesc://{name} 0.0.0.0 {date} text/plain {len(block)}\n"
    else:
        line = f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(block)}\n"
    return line.encode() + block + b"\n"


def arc_record(version: str, url: str, date: str, content: bytes, kind: str = "text/html", ip: str = "0.0.0.0", name: str = "-", offset: int = 0) -> bytes:
    """One URL record: header line, content, line feed."""
    url = re.sub(r"\s", lambda m: "%{:02X}".format(ord(m[0])), url) or "-"
    if version == "1":
        line = f"{url} {ip} {date} {kind} {len(content)}\n"
    else:
        line = f"{url} {ip} {date} {kind} 200 - - {offset} {name} {len(content)}\n"
    return line.encode() + content + b"\n"


def http_response(payload: bytes, kind: str = "text/html; charset=utf-8") -> bytes:
    """What a server sends for ``payload``."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def http_parts(content: bytes) -> tuple[bytes, bytes] | None:
    """HTTP head, the empty line included, and payload; null if the content does not open with a status line and fields."""
    if not content.startswith(b"HTTP/"):
        return None
    end = re.search(rb"\r?\n\r?\n", content)
    return (content[: end.end()], content[end.end() :]) if end else None


def read_arc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each URL record of an uncompressed ARC stream.

    The version comes from the first record's block; lengths are taken from the header lines, so
    content may hold anything.  A file that does not open with a version block raises.  A line that is
    no header, and content that is cut off, come back as a record whose only field is ``Error``; what
    follows is read from the next line that is a header.
    """
    fields: list[str] | None = None
    header, archive_date, lost = _HEADER_LINES["1"], "", False
    while True:
        try:
            line = stream.readline()
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if not line:
                return
            if not text:
                continue
            if fields is None:
                found = re.fullmatch(r"(filedesc:\S*) (\S+) (\d*) .*?(\d+)", text)
                block = stream.read(int(found[4])) if found else b""
                version = block.split(b" ", 1)[0].decode("ascii", "replace")
                if version not in ARC_FIELDS:
                    raise ArcError("the file does not open with a version block")
                fields, header, archive_date = ARC_FIELDS[version], _HEADER_LINES[version], found[3]
                continue
            parts = header.fullmatch(text)
            if parts is None:
                if not lost:  # one row for each damaged stretch
                    yield {"Error": f"no header line: {text[:80]}"}, b""
                lost = True
                continue
            lost = False
            content = stream.read(int(parts[len(fields)]))
            if len(content) != int(parts[len(fields)]):
                yield {"Error": f"{parts[len(fields)]} bytes declared, {len(content)} there: {text[:80]}"}, b""
                return
            yield dict(zip(fields, parts.groups(), strict=True)) | {"File-date": archive_date}, content
        except (EOFError, gzip.BadGzipFile, zlib.error) as damage:
            yield {"Error": f"compressed data end: {damage}"}, b""
            return


def warc_date(arc_date: str, otherwise: str = "") -> str:
    """14 digits, or fewer that leave the rest at its start, as a WARC timestamp; a date that does not exist is that of the archive, else of 1970."""
    for given in (arc_date, otherwise, ""):
        full = (given + "19700101000000"[len(given) :])[:14]
        try:
            return datetime.datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
        except ValueError:
            continue
    raise AssertionError


def record_id(*parts: object) -> str:
    """The same record always gets the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """One gzip member."""
    head = [("WARC-Type", kind), *fields.items(), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", _LEVEL, mtime=0)


def read_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a gzipped WARC stream."""
    with gzip.open(stream) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC version in {line[:40]!r}")
            fields = {}
            while (line := f.readline()).strip():
                name, _, value = line.decode().partition(":")
                fields[name.strip()] = value.strip()
            yield fields, f.read(int(fields["Content-Length"]))


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _file(folder: str, suffix: str) -> tuple:
    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}{suffix}"
    return fs, f"{root}/{name}", name


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of bounded length."""
    waiting: list[tuple] = []
    for row in rows:
        waiting.append(row)
        if len(waiting) >= _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), schema.types, strict=True)], schema=schema)
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting, strict=True), schema.types, strict=True)], schema=schema)


def write_arcs(pages: DataFrame, folder: str, version: str = "2", date: str = "20240101000000", max_bytes: int = 1 << 28) -> DataFrame:
    """Write (key, url, payload) rows as ARC files of HTTP responses, each record a gzip member, of up to about ``max_bytes`` of content.

    Returns the sidecar (path, seq, key): which row the file's ``seq``-th record, from 0, is.  Null urls
    and payloads are empty.
    """
    kind = pages.schema["key"].dataType
    rows = pages.select("key", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("payload", F.lit("").cast("binary")).alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, size, seq, path, name = None, 0, 0, "", ""
        for batch in batches:
            paths, seqs = [], []
            for url, payload in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if sink is not None and size >= max_bytes:
                    sink.close()
                    sink = None
                if sink is None:
                    fs, path, name = _file(folder, ".arc.gz")
                    sink, seq = fs.open_output_stream(path, compression=None), 0
                    head = arc_file_header(version, name, date)
                    sink.write(gzip.compress(head, _LEVEL, mtime=0))
                    size = len(head)
                record = arc_record(version, url, date, http_response(payload), name=name, offset=size)
                sink.write(gzip.compress(record, _LEVEL, mtime=0))
                paths.append(path)
                seqs.append(seq)
                size, seq = size + len(record), seq + 1
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(seqs, pa.int64()), batch.column(0)], ["path", "seq", "key"])
        if sink is not None:
            sink.close()

    return materialize(rows.mapInArrow(write, f"path string, seq long, key {kind.simpleString()}"), "arc_sidecar")


def _per_file(files: DataFrame) -> DataFrame:
    """A row per file, dealt out evenly."""
    return files.repartition(max(1, min(files.count(), 1 << 15)))


def _records(fs, path: str) -> Iterator[tuple[int, dict[str, str], bytes]]:
    with fs.open_input_stream(path, compression=None) as raw:
        opened = gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(raw)
        for seq, (fields, content) in enumerate(read_arc(opened)):
            yield seq, fields, content


def _captured(path: str, seq: int, fields: dict[str, str], payload: bytes) -> tuple[str, str, str, str]:
    """Record id, date, digest of a capture, and its address as UTF-8."""
    date, digest = warc_date(fields["Archive-date"], fields["File-date"]), _sha1(payload)
    return record_id(fields["URL"], date, digest, path.rsplit("/", 1)[-1], seq), date, digest, fields["URL"]


def index_arcs(files: DataFrame, folder: str) -> DataFrame:
    """(path, seq, url, date, record, bytes, digest, error) of every record; bytes and digest are those of a HTTP payload, else null."""
    names = "path string, seq long, url string, date string, record string, bytes long, digest string, error string"
    schema = pa.schema([(n.split()[0], pa.int64() if n.endswith("long") else pa.string()) for n in names.split(", ")])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(folder)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    try:
                        for seq, fields, content in _records(fs, path):
                            if "Error" in fields:
                                yield path, seq, None, None, None, None, None, fields["Error"]
                                continue
                            parts = http_parts(content)
                            record, date, digest, url = _captured(path, seq, fields, parts[1] if parts else content)
                            yield path, seq, url, date, record, len(parts[1]) if parts else None, digest if parts else None, None
                    except ArcError as damage:
                        yield path, None, None, None, None, None, None, str(damage)

        return _batches(rows(), schema)

    return _per_file(files.select("path")).mapInArrow(index, names)


def convert(files: DataFrame, folder: str, ranks: DataFrame | None = None, min_revisit: int = MIN_REVISIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Convert ARC files (``path``) to WARC files in ``folder``; returns (arc, path, records) of the files and (path, seq, error) of what is damaged.

    Of HTTP records with equal payloads of ``min_revisit`` bytes or more one is the response and others
    are revisits of it.  ``ranks`` (path, seq, rank) says which: that of the largest rank, a null one
    being below any other, and of equal ranks every one is a response.  Without ranks it is the earliest
    capture.  A file without a version block is damaged as a whole and converts to nothing.
    """
    index = materialize(index_arcs(files, folder), "arc_index")
    long = index.where(F.col("bytes") >= min_revisit)
    if ranks is None:
        ranked = long.withColumn("rank", F.lit(None).cast("int"))
        best = F.min_by(F.struct("record", "url", "date", "rank"), F.struct("date", "path", "seq"))
    else:
        ranked = long.join(ranks.select("path", "seq", "rank").hint("shuffle_hash"), ["path", "seq"], "left")
        best = F.max_by(F.struct("record", "url", "date", "rank"), F.struct("rank", "record"))
    targets = ranked.groupBy("digest").agg(best.alias("target"), F.count("*").alias("n")).where("n > 1").drop("n")
    targets = materialize(targets, "arc_targets")
    other = F.col("record") != F.col("target.record")
    if ranks is not None:
        other = other & ~F.col("rank").eqNullSafe(F.col("target.rank"))
    # What repeats grows with the archives: shuffled at every size, and a digest that a third of all records have is split.
    revisits = ranked.join(targets.hint("shuffle_hash"), "digest").where(other)
    # One row per ARC file again: its records that are revisits, no more than the file has.
    entry = F.struct("seq", F.col("target.record").alias("record"), F.col("target.url").alias("url"), F.col("target.date").alias("date"))
    decisions = revisits.groupBy("path").agg(F.collect_list(entry).alias("revisits"))
    whole = index.where(F.col("seq").isNull()).select("path")
    plan = materialize(files.select("path").distinct().join(whole, "path", "left_anti").join(decisions, "path", "left"), "arc_plan")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, revisits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target_of = {r["seq"]: r for r in revisits or []}
                fs, out_path, name = _file(folder, ".warc.gz")
                count = 0
                with fs.open_output_stream(out_path, compression=None) as sink:
                    about = {"WARC-Record-ID": record_id(name), "WARC-Date": warc_date(""), "WARC-Filename": name, "Content-Type": "application/warc-fields"}
                    sink.write(warc_record("warcinfo", about, f"software: tracelake\r\nisPartOf: {path.rsplit('/', 1)[-1]}\r\n".encode()))
                    for seq, fields, content in _records(fs, path):
                        if "Error" in fields:
                            continue
                        parts = http_parts(content)
                        own, date, digest, url = _captured(path, seq, fields, parts[1] if parts else content)
                        head = {"WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": url, "WARC-IP-Address": fields["IP-address"], "X-Archive-Sequence": str(seq)}
                        target = target_of.get(seq)
                        if parts is None:
                            kind, block = "resource", content
                            head |= {"Content-Type": fields["Content-type"], "WARC-Payload-Digest": digest}
                        else:
                            kind, block = ("response", content) if target is None else ("revisit", parts[0])
                            head |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest}
                        if target is not None:
                            head |= {
                                "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": target["record"], "WARC-Refers-To-Target-URI": target["url"],
                                "WARC-Refers-To-Date": target["date"], "WARC-Truncated": "length",
                            }
                        sink.write(warc_record(kind, head, block))
                        count += 1
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([out_path]), pa.array([count], pa.int64())], ["arc", "path", "records"])

    written = materialize(_per_file(plan).mapInArrow(rewrite, "arc string, path string, records long"), "warc_files")
    return written, index.where(F.col("error").isNotNull()).select("path", "seq", "error")


def read_warcs(files: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """(arc, seq, record, url, date, payload_bytes, payload_digest, record_type, refers_to) of every capture in the WARC files (arc, path).

    Digests are bare lower-case hex; that of a payload that is there is computed and must equal the
    header's.  The length of a revisit's payload is what its HTTP head declares, null if it declares none.
    """
    names = "arc string, seq long, record string, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n.split()[0], kinds[n.split()[1]]) for n in names.split(", ")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(folder)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for arc, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    with fs.open_input_stream(path, compression=None) as raw:
                        for head, block in read_warc(raw):
                            kind = head["WARC-Type"]
                            if kind == "warcinfo":
                                continue
                            parts = http_parts(block)
                            payload = parts[1] if parts else block
                            if kind == "revisit":
                                declared = re.search(rb"(?im)^Content-Length:\s*(\d+)", block)
                                size, payload = int(declared[1]) if declared else None, None
                            else:
                                size = len(payload)
                                if _sha1(payload) != head["WARC-Payload-Digest"]:
                                    raise ValueError(f"digest of {head['WARC-Record-ID']} does not hold in {path}")
                            digest = base64.b32decode(head["WARC-Payload-Digest"].partition(":")[2]).hex()
                            row = (arc, int(head["X-Archive-Sequence"]), head["WARC-Record-ID"], head["WARC-Target-URI"], head["WARC-Date"], size, digest, kind, head.get("WARC-Refers-To"))
                            yield row + (payload,) * with_payload

        return _batches(rows(), schema)

    return _per_file(files.select("arc", "path")).mapInArrow(read, names)


def archive_pages(
    pages: DataFrame, spark: SparkSession, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: str = "2"
) -> DataFrame:
    """Pages written as legacy ARC files, converted to WARC and read back: a row per page.

    Columns: id, payload_bytes, payload_digest, record_type, refers_to.  Null html is an empty payload,
    null urls are empty.  Rows with a null id come back with one.  Repeated rows give repeated rows, all
    of one kind.  An empty table gives an empty one; further columns are not read.
    """
    folder = new_path(spark, "archives")
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("url"), F.col(html_col).cast("binary").alias("payload"))
    sidecar = write_arcs(rows, folder, version)
    files, damaged = convert(sidecar.select("path").distinct(), folder, sidecar.withColumnRenamed("key", "rank"))
    if not damaged.isEmpty():
        raise ArcError(f"written archives do not read back: {damaged.first()}")
    placed = sidecar.withColumnRenamed("path", "arc").hint("shuffle_hash")
    out = materialize(read_warcs(files, folder).drop("url", "date").join(placed, ["arc", "seq"]), "warc_read")
    # Only what revisits refer to is looked up; a payload that every third page has is one row here.
    asked = out.where(F.col("refers_to").isNotNull()).select(F.col("refers_to").alias("record")).distinct()
    target = out.join(asked.hint("shuffle_hash"), "record", "left_semi").select(F.col("record").alias("refers_to"), F.col("key").alias("target_key"))
    target = materialize(target, "warc_targets").hint("shuffle_hash")
    found = out.where(F.col("refers_to").isNotNull()).join(target, "refers_to").unionByName(out.where(F.col("refers_to").isNull()).withColumn("target_key", F.lit(None).cast(out.schema["key"].dataType)))
    return found.select(F.col("key").alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("target_key").alias("refers_to"))
