"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can be the last of the prefix's encoding, because
an encoding is right if and only if each two neighbouring tokens are stable: the merges would not have
joined anything across their seam.  So a table with one token per prefix holds the encodings of all
prefixes.  Appending bytes extends the table and changes nothing before; after an edit only the rows
from the edit on are computed again, up to where they agree with the old ones.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from array import array
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.pieces import REMEMBERED_BYTES, PieceEncoder


#: Documents whose new pieces a worker encodes together.
_BATCH = 2048


class Ranks:
    """A vocabulary of byte strings in merge order."""

    def __init__(self, path: str):
        pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        self.ids: dict[bytes, int] = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes_of: dict[int, bytes] = {rank: token for token, rank in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self._halves: dict[int, tuple[int, int]] = {}
        self._joined: dict[tuple[int, int], int] = {}
        self._stable: dict[tuple[int, int], bool] = {}
        for rank in sorted(self.bytes_of):
            token = self.bytes_of[rank]
            for cut in range(1, len(token)):
                pair = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                # The last merge of a token is its only cut into two earlier tokens that no
                # earlier merge would have joined across.
                if None not in pair and max(pair) < rank and self._seam_holds(*pair, rank):
                    self._halves[rank] = pair
                    self._joined[pair] = rank
                    break

    def _seam_holds(self, left: int, right: int, before: int) -> bool:
        """Whether no merge ranked under ``before`` joins ``left`` and ``right`` across their seam.

        Goes back in time: of the tokens at the seam, the one that was made last is taken apart, and
        the two that then meet must not have a merge that would have come first.
        """
        while True:
            joined = self._joined.get((left, right))
            if joined is not None and joined < before:
                return False
            for undo_left in (True, False) if left > right else (False, True):
                made = left if undo_left else right
                if made in self._halves:
                    # At equal rank the leftmost merge comes first, so a merge of the same rank
                    # across the seam beats one on its right but not one on its left.
                    before = made if undo_left else made + 1
                    if undo_left:
                        left = self._halves[made][1]
                    else:
                        right = self._halves[made][0]
                    break
            else:
                return True

    def stable(self, left: int, right: int) -> bool:
        """Whether ``left`` followed by ``right`` is how their bytes are encoded."""
        pair = (left, right)
        known = self._stable.get(pair)
        if known is None:
            known = self._seam_holds(left, right, len(self.bytes_of) + 1)
            if len(self._stable) < 1_000_000:
                self._stable[pair] = known
        return known


    def last_tokens(self, data: bytes, last: list[int], begin: int) -> Iterator[int]:
        """Append to ``last`` the last token of each prefix of ``begin`` bytes or more; yields each length.

        Short tokens are tried first: they are the likeliest, and only one can be right.
        """
        find, known = self.ids.get, self._stable
        for end in range(begin, len(data) + 1):
            for start in range(end - 1, max(-1, end - self.longest - 1), -1):
                token = find(data[start:end])
                if token is None:
                    continue
                if not start:
                    break
                holds = known.get((last[start - 1], token))
                if holds or holds is None and self.stable(last[start - 1], token):
                    break
            else:
                raise ValueError(f"byte {data[end - 1]} is not in the vocabulary")
            last.append(token)
            yield end

    def encode_sorted(self, strings: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of each byte string; of sorted ones, the prefix shared with the one before is not computed again."""
        table = PrefixTable(self)
        for data in strings:
            shared = len(os.path.commonprefix((table.data, data)))
            table.truncate(shared)
            table.append(data[shared:])
            yield table.encode()


class PrefixTable:
    """Encodings of all prefixes of a byte string: ``last[i]`` ends the encoding of the first i + 1 bytes."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the string; what the table has stays as it is."""
        begin, self.data = len(self.data) + 1, self.data + more
        for _ in self.ranks.last_tokens(self.data, self.last, begin):
            pass

    def truncate(self, length: int) -> None:
        """Keep the first ``length`` bytes."""
        self.data = self.data[:length]
        del self.last[length:]

    def replace(self, start: int, stop: int, by: bytes) -> int:
        """Put ``by`` in place of bytes start to stop; returns how many rows were computed again.

        A row depends on its last ``longest`` bytes and rows only, so once that many rows in a row
        agree with the old ones, the rest is the old rest.
        """
        data = self.data[:start] + by + self.data[stop:]
        last, old, shift = self.last[:start], self.last, len(by) - (stop - start)
        done = agreed = 0
        for end in self.ranks.last_tokens(data, last, start + 1):
            done += 1
            agreed = agreed + 1 if end > start + len(by) and last[-1] == old[end - 1 - shift] else 0
            if agreed >= self.ranks.longest:
                last.extend(old[end - shift :])
                break
        self.data, self.last = data, last
        return done

    def encode(self, end: int | None = None) -> list[int]:
        """Ids of the first ``end`` bytes, all by default."""
        end, out = len(self.data) if end is None else end, []
        while end:
            token = self.last[end - 1]
            out.append(token)
            end -= len(self.ranks.bytes_of[token])
        return out[::-1]


class ByteBpe:
    """Encodes and decodes whole texts: each match of ``pattern`` by its own prefix table."""

    def __init__(self, path: str, pattern: str, remembered_bytes: int = REMEMBERED_BYTES):
        self.ranks = Ranks(path)
        self.matches = regex.compile(pattern).findall
        self._code = "H" if max(self.ranks.bytes_of) < 1 << 16 else "I"
        self.encode_packed = PieceEncoder(self.matches, self._encode_matches, bound=remembered_bytes)
        self._decimal = [str(i) for i in range(max(self.ranks.bytes_of) + 1)]

    def _encode_matches(self, matches: Iterable[str]) -> Iterator[bytes]:
        data = (m.encode("utf-8", "surrogatepass") for m in matches)
        return (array(self._code, ids).tobytes() for ids in self.ranks.encode_sorted(data))

    def encode(self, text: str | None) -> list[int]:
        return memoryview(self.encode_packed(text)).cast(self._code).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, ids))

    def decimal(self, ids: list[int]) -> str:
        return " ".join(map(self._decimal.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str, remembered_bytes: int = REMEMBERED_BYTES) -> ByteBpe:
    """One per Python worker and vocabulary."""
    return ByteBpe(path, pattern, remembered_bytes)


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, remembered_bytes: int = REMEMBERED_BYTES
) -> DataFrame:
    """One row per document: id, ``ids`` (if asked for), ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    decoded_sha256 is that of the bytes that the ids decode to.  Null texts encode as empty ones, to no
    ids and the digests of nothing.  Repeated rows give repeated rows, an empty table an empty one;
    columns besides the two named are not read.  ``ranks_path`` must be readable on executors.  A worker forgets
    its pieces once they take about ``remembered_bytes``, which changes no result.
    """
    source = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    kinds = [("ids", "array<int>")] * with_ids + [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in kinds)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = codec(ranks_path, pattern, remembered_bytes), hashlib.sha256
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                some = batch.slice(at, min(_BATCH, batch.num_rows - at))
                kept, counts, of_ids, of_bytes = [], [], [], []
                texts = some.column(1).to_pylist()
                bpe.encode_packed.learn(texts)
                for text in texts:
                    ids = bpe.encode(text)
                    if with_ids:
                        kept.append(ids)
                    counts.append(len(ids))
                    of_ids.append(sha(bpe.decimal(ids).encode()).hexdigest())
                    of_bytes.append(sha(bpe.decode(ids)).hexdigest())
                columns = [some.column(0)] + [pa.array(kept, pa.list_(pa.int32()))] * with_ids
                columns += [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [id_col] + [n for n, _ in kinds])

    return source.mapInArrow(encode, schema)


def decode_documents(tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id and ``data``, the bytes that its array of ids decodes to; null ids decode to none."""
    source = tokens.select(F.col(id_col), F.col(ids_col).alias("__ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(ranks_path, pattern)
        for batch in batches:
            data = [bpe.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [id_col, "data"])

    return source.mapInArrow(decode, f"`{id_col}` {tokens.schema[id_col].dataType.simpleString()}, data binary")
