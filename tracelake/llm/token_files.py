"""Token-id files: flat unsigned integers plus 64-bit document offsets, read by memory mapping.

A data set is a folder of shards in order.  Shard ``s`` holds consecutive documents of the order:

- ``s.bin``   the ids of its documents one after the other, little-endian unsigned 16-bit integers if
              every id fits, else 32-bit ones;
- ``s.off``   little-endian unsigned 64-bit integers, one more than documents: where each document
              starts in ``s.bin``, counted in ids, and where the last one ends;
- ``s.arrow`` the document ids, an Arrow file of one column.

The manifest has a row per shard: its place, its counts, and ``base``, the ids of all shards before
it, a prefix sum over these rows.  A document's global start is its shard's base plus its offset.

Every attempt at a shard writes files of its own; the manifest names those of the attempt that
succeeded, so a lost executor leaves unused files and no wrong ones.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.pieces import PieceEncoder
from tracelake.storage import new_path

MANIFEST = "shard int, path string, dtype string, n_docs long, n_tokens long"
_BATCH = 2048


def _byte_letters() -> dict[int, int]:
    """The printable letter that byte-level vocabularies write for each byte, as a translation table."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class FileTokenizer:
    """Whole texts through a ``tokenizers`` file with byte-level pre-tokenization.

    The library's model encodes each distinct match of ``pattern`` once.  With ``added_tokens``, a text
    that holds the string of one of the file's added tokens goes through the library whole, which gives
    that token its own id; else such strings are ordinary text.
    """

    def __init__(self, path: str, pattern: str, added_tokens: bool = False):
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            setup = json.load(f)
        if setup["pre_tokenizer"]["type"] != "ByteLevel" or setup["pre_tokenizer"]["add_prefix_space"] or setup["normalizer"]:
            raise ValueError("only plain byte-level vocabularies can be cut into matches")
        self.tokenizer = Tokenizer.from_file(path)
        self._letters = _byte_letters()
        n_ids = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = "<u2" if n_ids <= 1 << 16 else "<u4"
        self._code = "H" if self.dtype == "<u2" else "I"
        self.encode_packed = PieceEncoder(regex.compile(pattern).findall, self._encode_matches)
        self._added = [t["content"] for t in setup["added_tokens"]] if added_tokens else []

    def encode_whole(self, text: str) -> bytes:
        """Packed ids of one text."""
        if any(t in text for t in self._added):
            return array(self._code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self.encode_packed(text)

    def _encode_matches(self, matches) -> Iterator[bytes]:
        tokenize, table, code = self.tokenizer.model.tokenize, self._letters, self._code
        space = chr(table[ord(" ")])
        for m in matches:
            if m.isascii() and m[1:].isalnum() and m[0] == " ":
                letters = space + m[1:]  # letters and digits stand for themselves
            else:
                letters = m.encode("utf-8", "surrogatepass").decode("latin-1").translate(table)
            yield array(code, [t.id for t in tokenize(letters)]).tobytes()


@functools.lru_cache(maxsize=4)
def file_tokenizer(path: str, pattern: str, added_tokens: bool = False) -> FileTokenizer:
    """One per Python worker and vocabulary."""
    return FileTokenizer(path, pattern, added_tokens)


def write_token_files(
    docs: DataFrame,
    folder: str,
    make_tokenizer: Callable[[], FileTokenizer],
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode all texts in ascending id order into ``folder`` and return its manifest, which is also written there.

    Each document's ids are followed by ``end_id``.  Null texts are empty.  Null ids come first, rows
    with the same id are ordered by text; every row is a document.  An empty table gives an empty
    manifest.  ``folder`` is a URI that executors and the driver share.
    """
    spark = docs.sparkSession
    ordered = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
        .repartitionByRange("id")  # its sample goes to the driver, so no texts in it
        .sortWithinPartitions("id", "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, shard = make_tokenizer(), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=tok.dtype).tobytes()
        width, starts, ids_out, sink = len(end), [0], None, None
        fs, root = pa.fs.FileSystem.from_uri(folder)
        path = f"{root}/{shard:08d}-{uuid.uuid4().hex}"
        for batch in batches:
            if sink is None:
                fs.create_dir(root, recursive=True)
                sink, names = fs.open_output_stream(path + ".bin"), fs.open_output_stream(path + ".arrow")
                ids_out = pa.ipc.new_file(names, pa.schema([("id", batch.schema.field(0).type)]))
            for at in range(0, batch.num_rows, _BATCH):
                some = batch.slice(at, min(_BATCH, batch.num_rows - at))
                ids_out.write_batch(pa.RecordBatch.from_arrays([some.column(0)], ["id"]))
                texts = some.column(1).to_pylist()
                tok.encode_packed.learn(texts)
                for text in texts:
                    packed = tok.encode_whole(text) + end
                    sink.write(packed)
                    starts.append(starts[-1] + len(packed) // width)
        if sink is None:
            return
        sink.close()
        ids_out.close()
        names.close()
        with fs.open_output_stream(path + ".off") as out:
            out.write(np.array(starts, dtype="<u8").tobytes())
        row = {"shard": [shard], "path": [path], "dtype": [tok.dtype], "n_docs": [len(starts) - 1], "n_tokens": [starts[-1]]}
        kinds = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("dtype", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
        yield pa.RecordBatch.from_pydict(row, schema=kinds)

    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest's rows with ``base`` (ids in all shards before) and ``first_doc`` (documents before)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return rows.withColumns({"base": sums("n_tokens"), "first_doc": sums("n_docs")})


def _mapped(fs, path: str, dtype: str) -> np.ndarray:
    """A memory map where the file is local, else its content."""
    if isinstance(fs, pa.fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_documents(spark: SparkSession, folder: str, id_type: str = "long", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of a data set: id, ``start`` (global), ``n_tokens``, ``ids_crc32``, and ``ids`` if asked for.

    ids_crc32 is that of the ids as little-endian unsigned 32-bit integers, the end id included.
    """
    manifest = read_manifest(spark, folder)
    n = manifest.count()
    # A row per shard, dealt out evenly.
    shards = manifest.repartition(max(1, n)).select("path", "dtype", "base")
    schema = f"`{id_col}` {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                path, tokens = row["path"], _mapped(fs, row["path"] + ".bin", row["dtype"])
                offsets, done = _mapped(fs, path + ".off", "<u8").astype(np.int64), 0
                with fs.open_input_file(path + ".arrow") as f:
                    ids = pa.ipc.open_file(f)
                    for k in range(ids.num_record_batches):
                        own = ids.get_batch(k).column(0)
                        ends = offsets[done : done + len(own) + 1]
                        docs = [tokens[a:b].astype("<u4") for a, b in zip(ends, ends[1:], strict=False)]
                        columns = [own, pa.array(ends[:-1] + row["base"]), pa.array(np.diff(ends)), pa.array([zlib.crc32(x) for x in docs], pa.int64())]
                        columns += [pa.array([x.astype(np.int64) for x in docs], pa.list_(pa.int64()))] * with_ids
                        yield pa.RecordBatch.from_arrays(columns, [id_col, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)
                        done += len(own)

    return shards.mapInArrow(read, schema)


def new_folder(spark: SparkSession) -> str:
    return new_path(spark, "tokens")
