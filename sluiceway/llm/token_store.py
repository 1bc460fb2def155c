"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their key.  Entries stand in blocks, keys
share prefixes with the key before them; a sparse index has the last key of every block,
a Bloom filter answers for absent keys, and a footer says where those are.  A lookup asks
the filter, then the index by binary search, and reads one block.

    block   entries (varints shared, rest, bytes; rest of the key; ids), CRC-32
    index   per block: last key, place, size, documents, tokens before it in the shard
    filter  bits of all keys
    footer  72 bytes: places and sizes of index and filter, documents, tokens, bytes an id, magic
"""

from __future__ import annotations

import bisect
import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dealt, map_arrow, materialise, new_path, qualified, raw, read_table, span_keys
from .store import open_read, open_write

#: A shard ends at so many bytes or documents, whose keys are held until then.
BLOCK_BYTES, SHARD_BYTES, SHARD_DOCS = 64 << 10, 256 << 20, 1 << 20
BITS_PER_KEY, PROBES = 10, 7
FOOTER = struct.Struct("<QQQQQQQ8s8s")
MAGIC = b"SORTTOK1"
#: What a worker remembers of texts that it has encoded.
CACHE_BYTES = 48 << 20
END_ID = 1


def key_of(value: int | str | None) -> bytes:
    """A key whose bytes sort as the values do, null first."""
    if value is None:
        return b"\0"
    return b"\1" + (struct.pack(">Q", value + (1 << 63)) if isinstance(value, int) else value.encode())


def value_of(key: bytes, text: bool) -> int | str | None:
    return None if key == b"\0" else key[1:].decode() if text else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _bits(key: bytes, size: int) -> Iterator[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    for i in range(PROBES):
        yield (a + i * b) % size


class ShardWriter:
    """Writes one shard; keys must not descend, equal ones may follow one another."""

    def __init__(self, uri: str, id_bytes: int):
        self.uri, self.out, self.id_bytes = uri, open_write(uri), id_bytes
        self.at = self.docs = self.tokens = 0
        self.block, self.count, self.before, self.last = bytearray(), 0, 0, b""
        self.index: list[bytes] = []
        self.keys: list[bytes] = []

    def add(self, key: bytes, ids: bytes) -> None:
        if self.docs and key < (self.last or self.keys[-1]):
            raise ValueError("keys descend")
        shared = len(os.path.commonprefix([self.last, key])) if self.count else 0
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        self.last, self.count, self.docs = key, self.count + 1, self.docs + 1
        self.tokens += len(ids) // self.id_bytes
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.count:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.out.write(data)
            self.index.append(_varint(len(self.last)) + self.last + _varint(self.at) + _varint(len(data)) + _varint(self.count) + _varint(self.before))
            self.at += len(data)
            self.block, self.count, self.before = bytearray(), 0, self.tokens

    def close(self) -> tuple[str, int, int]:
        self._flush()
        index = b"".join(self.index)
        size = max(64, len(self.keys) * BITS_PER_KEY)
        bits = bytearray(-(-size // 8))
        for key in self.keys:
            for bit in _bits(key, size):
                bits[bit >> 3] |= 1 << (bit & 7)
        self.out.write(index + bytes(bits) + FOOTER.pack(self.at, len(index), self.at + len(index), size, self.docs, self.tokens, self.id_bytes, b"\0" * 8, MAGIC))
        self.out.close()
        return self.uri, self.docs, self.tokens


class ShardReader:
    def __init__(self, uri: str):
        self.file = open_read(uri)
        self.file.seek(0, 2)
        self.file.seek(self.file.tell() - FOOTER.size)
        at, n, bits_at, self.bits, self.docs, self.tokens, self.id_bytes, _, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a shard")
        self.file.seek(at)
        index, pos = self.file.read(n), 0
        self.blocks: list[tuple[bytes, int, int, int, int]] = []
        while pos < n:
            size, pos = _number(index, pos)
            key, pos = index[pos : pos + size], pos + size
            a, pos = _number(index, pos)
            b, pos = _number(index, pos)
            c, pos = _number(index, pos)
            d, pos = _number(index, pos)
            self.blocks.append((key, a, b, c, d))
        self.file.seek(bits_at)
        self.filter = self.file.read(-(-self.bits // 8))
        self.last_keys = [b[0] for b in self.blocks]

    def entries(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size, _, _ = self.blocks[k]
        self.file.seek(at)
        data = self.file.read(size)
        if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("a block is damaged")
        pos, key = 0, b""
        while pos < size - 4:
            shared, pos = _number(data, pos)
            rest, pos = _number(data, pos)
            n, pos = _number(data, pos)
            key = key[:shared] + data[pos : pos + rest]
            pos += rest
            yield key, data[pos : pos + n]
            pos += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self.entries(k)

    def lookup(self, value: int | str | None) -> list[np.ndarray]:
        """ids of every document with this key."""
        key, out = key_of(value), []
        if not all(self.filter[b >> 3] >> (b & 7) & 1 for b in _bits(key, self.bits)):
            return out
        for k in range(bisect.bisect_left(self.last_keys, key), len(self.blocks)):
            found = [ids for own, ids in self.entries(k) if own == key]
            out += found
            if self.last_keys[k] > key:
                break
        return [np.frombuffer(x, f"<u{self.id_bytes}") for x in out]

    def close(self) -> None:
        self.file.close()


def _edges() -> np.ndarray:
    """Whether text may be cut between two bytes, by their kinds: beside blanks, and where the
    tokenizer's own pattern parts ASCII letters, digits and marks whatever stands around them."""
    cut = np.zeros((8, 8), bool)
    for a, afters in ((_BLANK, range(1, 6)), (_LETTER, (_DIGIT, _MARK, _APOSTROPHE)), (_DIGIT, (_LETTER, _DIGIT, _MARK, _APOSTROPHE)), (_MARK, (_LETTER, _DIGIT))):
        for b in afters:
            cut[a, b] = True
    return cut.ravel()


_BLANK, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _WIDE = range(6)
_KIND = np.full(256, _WIDE, np.uint8)
for _c in range(128):
    _KIND[_c] = _BLANK if _c in (9, 10, 11, 12, 13, 32) else _APOSTROPHE if _c == 39 else (_LETTER if chr(_c).isalpha() else _DIGIT) if chr(_c).isalnum() else _MARK
_EDGES = _edges()
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of texts that are encoded by themselves begin and end (bytes)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = _KIND[data]
    inside = kind != _BLANK
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begin = np.empty(len(data), bool)
    begin[1:] = _EDGES[kind[:-1] << 3 | kind[1:]]
    begin[firsts] = inside[firsts]
    last = inside.copy()
    last[:-1] &= begin[1:] | ~inside[1:]
    last[firsts[firsts > 0] - 1] = inside[firsts[firsts > 0] - 1]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


class Encoder:
    """The tokenizer over parts of texts, each different one encoded once and remembered.

    Its own rules drop blanks, make letters small and part ASCII letters, digits and marks, so texts
    are cut there.  What is remembered stands in arrays sorted by a hash, with length and both ends
    to tell equal hashes apart, and never takes more than CACHE_BYTES: all is forgotten beyond.
    New parts are encoded many at a time, and the places of the ids tell whose they are."""

    def __init__(self, path: str, most_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.id_bytes = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.most_bytes = most_bytes
        self._forget()

    def _forget(self) -> None:
        # hash, first and last eight bytes, length, place and number of ids
        self.known = [np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)]
        self.ids = np.empty(0, f"<u{self.id_bytes}")

    @property
    def bytes_held(self) -> int:
        return sum(x.nbytes for x in self.known) + self.ids.nbytes

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of every text, as little-endian numbers of id_bytes."""
        data, offsets = raw(column)
        whole = data.tobytes()
        # where a special token may stand, capitals and marks matter
        special = [k for k in range(len(column)) if whole.find(b"<|", int(offsets[k]), int(offsets[k + 1])) >= 0] if b"<|" in whole else []
        start, end = chunks(data, offsets)
        if special:
            doc = np.searchsorted(offsets, start, "right") - 1
            plain = ~np.isin(doc, special)
            start, end = start[plain], end[plain]
        small = _SMALL[data]
        count, place = self._find(small, start, end)
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(place - ends[:-1], count) + np.arange(ends[-1])].tobytes()
        at = (ends[np.searchsorted(start, offsets)] * self.id_bytes).tolist()
        out = [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
        for k in special:
            parts = whole[offsets[k] : offsets[k + 1]].split()
            out[k] = self._fresh(parts)[0].tobytes()
        if self.bytes_held > self.most_bytes:
            self._forget()
        return out

    def _find(self, small: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and place of the ids of every part; new ones are learnt."""
        if not len(start):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        size = end - start
        key, first, last = span_keys(small, start, size)
        _, index, inverse = np.unique(key, return_index=True, return_inverse=True)
        same = lambda a, b: (first[a] == b[0]) & (last[a] == b[1]) & (size[a] == b[2])
        every = np.arange(len(start))
        unlike = ~same(every, (first[index][inverse], last[index][inverse], size[index][inverse]))
        at = np.minimum(np.searchsorted(self.known[0], key[index]), max(0, len(self.known[0]) - 1))
        if len(self.known[0]):
            hit = self.known[0][at] == key[index]
            odd = hit & ~same(index, tuple(x[at] for x in self.known[1:4]))
        else:
            hit = odd = np.zeros(len(index), bool)
        if unlike.any() or odd.any():  # a hash that two parts share: nothing is looked up or remembered
            return self._append([small[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        count, place = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
        count[hit], place[hit] = (self.known[5][at[hit]], self.known[4][at[hit]]) if hit.any() else (0, 0)
        new = index[~hit]
        if len(new):
            count[~hit], place[~hit] = self._append([small[a:b].tobytes() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            where = np.searchsorted(self.known[0], key[new])
            rows = (key[new], first[new], last[new], size[new], place[~hit], count[~hit])
            self.known = [np.insert(x, where, y) for x, y in zip(self.known, rows, strict=True)]
        return count[inverse], place[inverse]

    def _append(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, count = self._fresh(parts)
        place = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, ids])
        return count, place

    def _fresh(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts, from the tokenizer itself, and how many each has."""
        ids, counts = [np.empty(0, self.ids.dtype)], [np.empty(0, np.int64)]
        for k in range(0, len(parts), 500):
            text = b"\n".join(parts[k : k + 500]).decode()
            found = self.tokenizer.encode(text, add_special_tokens=False)
            breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 10)
            first = np.array([a for a, _ in found.offsets], np.int64)
            ids.append(np.array(found.ids, self.ids.dtype))
            counts.append(np.diff(np.searchsorted(first, breaks), prepend=0, append=len(first)))
        return np.concatenate(ids), np.concatenate(counts)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_shards(docs: DataFrame, path: str, to: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, partitions: int | None = None) -> DataFrame:
    """Encode whole texts and write shards in ascending order of id; returns the list of shards:
    file, n_docs, n_tokens, start (tokens of all shards before).

    Null texts are empty (only the end id); null ids come first; rows with equal ids stand
    together, in the order of a hash of their texts.  An empty table gives no shard.  Texts are
    encoded where they are read; only ids are sorted.  Other columns are not read."""
    spark, to = docs.sparkSession, qualified(docs.sparkSession, to)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    firsts = spark.sparkContext.broadcast(_firsts(rows.select("id"), n))

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = encoder(path)
        end = b"" if end_id is None else end_id.to_bytes(table.id_bytes, "little")
        ids = [x + end for x in table.encode(batch.column(1))]
        part = [bisect.bisect_right(firsts.value, key_of(x)) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(part, pa.int32()), pa.array(ids, pa.binary())], ["id", "tie", "part", "ids"])

    encoded = map_arrow(rows.select("id", "text", F.xxhash64("text").alias("tie")), encode, f"id {kind}, tie long, part int, ids binary", 1)
    ranged = encoded.repartitionById(n, F.col("part")).sortWithinPartitions(F.asc_nulls_first("id"), "tie").select("id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_bytes, writer, done = encoder(path).id_bytes, None, []
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                writer = writer or ShardWriter(f"{to}/{uuid.uuid4().hex}.sst", id_bytes)
                writer.add(key_of(key), ids)
                if writer.at >= SHARD_BYTES or writer.docs >= SHARD_DOCS:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        if done:
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64()), pa.array([at << 32 | k for k in range(len(done))], pa.int64())], ["file", "n_docs", "n_tokens", "place"])

    written = materialise(ranged.mapInArrow(run, "file string, n_docs long, n_tokens long, place long"), "shards")
    # one row per shard, not per document
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return written.select("file", "n_docs", "n_tokens", before.cast("long").alias("start"))


def _firsts(ids: DataFrame, n: int) -> list[bytes]:
    """Keys at which the second and later of n ranges of about as many rows begin; ids alone are shuffled."""
    ranges = ids.repartitionByRange(n, F.asc_nulls_first("id")).groupBy(F.spark_partition_id()).agg(F.min(F.struct("id")).alias("first"))
    return sorted(key_of(r.first.id) for r in ranges.select("first").toLocalIterator())[1:]


def read_shards(shards: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per document: id, start, n_tokens, ids_crc32 (of the ids as 32-bit little-endian
    numbers).  Shards are dealt to as many tasks as there are shards; an empty list gives no rows,
    a null or missing file and a damaged block are errors."""
    text = id_type == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, rows = ShardReader(uri), []
                for key, ids in reader:
                    n = len(ids) // reader.id_bytes
                    rows.append((value_of(key, text), start, n, zlib.crc32(np.frombuffer(ids, f"<u{reader.id_bytes}").astype("<u4").tobytes())))
                    start += n
                    if len(rows) == 50_000:
                        yield _rows(rows, text)
                        rows = []
                reader.close()
                if rows:
                    yield _rows(rows, text)

    listed = materialise(shards.select("file", "start"), "listed")
    return dealt(listed, listed.count(), "file").mapInArrow(run, f"id {id_type}, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple], text: bool) -> pa.RecordBatch:
    types = [pa.string() if text else pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["id", "start", "n_tokens", "ids_crc32"])


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(read_table(spark, sf_dir, "documents"), vocabulary(), new_path(spark, "sst"))).withColumnRenamed("id", "doc_id")
