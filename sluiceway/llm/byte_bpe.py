"""Byte-level BPE encoding and decoding without regular expressions.

Texts of a batch are held as bytes.  Every code point gets a class (letter, number, blank,
other), and a small automaton over the classes decides where a piece begins.  Its transition
functions compose associatively, so stretches of the batch are run at once for every state,
the results are composed along the stretches, and a second run from the right state marks
the beginnings.  Distinct pieces are merged once by rank and cached; ids keep the bytes at
which they begin, and decoding looks the ids up.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, raw, read_table, span_keys

#: What a worker remembers of pieces that it has merged, in bytes.
CACHE_BYTES = 64 << 20
#: Bytes that an entry takes besides its piece and ids.
_ENTRY = 200
BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LANE = 256

# Symbols: letter, number, other, blank inside or at the end of a run of blanks that more
# follow or that ends the text, last blank of a run before other text (space, or another
# one), apostrophe that a suffix of one letter or of two follows.
LETTER, NUMBER, OTHER, BLANK, SPACE, LAST, SHORT, LONG = range(8)
# States, by what stands before: nothing that can go on, letters, numbers, others, blanks,
# a space that joins the next piece, one or two letters of a suffix to come.
CLOSED, LETTERS, NUMBERS, OTHERS, BLANKED, JOINING, ONE, TWO = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece begins, by state and symbol."""
    go, begin = np.zeros((8, 8), np.uint8), np.zeros((8, 8), bool)
    run = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, SHORT: OTHERS, LONG: OTHERS}
    for state in range(8):
        for symbol in range(8):
            if symbol == BLANK:
                go[state, symbol], begin[state, symbol] = BLANKED, state != BLANKED
            elif symbol in (SPACE, LAST):
                go[state, symbol], begin[state, symbol] = JOINING if symbol == SPACE else CLOSED, True
            elif state in (ONE, TWO):
                go[state, symbol], begin[state, symbol] = ONE if state == TWO else CLOSED, False
            elif state == JOINING:
                go[state, symbol], begin[state, symbol] = run[symbol], False
            elif symbol in (SHORT, LONG) and state != OTHERS:
                go[state, symbol], begin[state, symbol] = ONE if symbol == SHORT else TWO, True
            else:
                go[state, symbol], begin[state, symbol] = run[symbol], state != run[symbol]
    return go, begin


GO, BEGIN = _automaton()


@cache
def classes() -> np.ndarray:
    """Class of every code point, as the tokenizer library itself takes them: it is asked once
    which code points are letters and which are numbers."""
    import tiktoken

    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        for low in range(0, 0x110000, 1 << 12):  # in parts, which bounds the memory
            some = "".join(chr(c) for c in range(low, low + (1 << 12)) if not 0xD800 <= c < 0xE000)
            out[np.frombuffer(bytes(probe.encode_ordinary(some)).decode().encode("utf-32-le"), "<u4")] = kind
    out[BLANKS] = BLANK
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and where each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    points = data[at].astype(np.uint32)
    many = np.flatnonzero(points >= 0xC0)
    if len(many):
        lead, where = points[many], at[many]
        byte = lambda k: data[np.minimum(where + k, len(data) - 1)].astype(np.uint32) & 0x3F
        two = (lead & 0x1F) << 6 | byte(1)
        three = (lead & 0x0F) << 12 | byte(1) << 6 | byte(2)
        four = (lead & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3)
        points[many] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
    return points, at


def symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Symbol of every code point; firsts: where texts begin."""
    out = classes()[points]
    n = len(out)
    ends = np.zeros(n + 1, bool)  # the code point before is the last of its text
    ends[firsts] = True
    ends[n] = True
    blank = out == BLANK
    follows = np.zeros(n, bool)
    follows[:-1] = ~blank[1:] & ~ends[1:n]
    last = blank & follows
    out[last] = LAST
    out[last & (points == 32)] = SPACE
    apostrophes = np.flatnonzero(points == 39)
    if len(apostrophes):
        a = np.minimum(apostrophes + 1, n - 1)
        b = np.minimum(apostrophes + 2, n - 1)
        has1 = ~ends[np.minimum(apostrophes + 1, n)]
        has2 = has1 & ~ends[np.minimum(apostrophes + 2, n)]
        p, q = points[a], points[b]
        short = has1 & np.isin(p, [ord(c) for c in "stmd"])
        long = has2 & (((p == ord("r")) & (q == ord("e"))) | ((p == ord("v")) & (q == ord("e"))) | ((p == ord("l")) & (q == ord("l"))))
        out[apostrophes[short]] = SHORT
        out[apostrophes[long]] = LONG
    return out


def scan(symbol: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces begin.  Texts begin in state CLOSED."""
    n = len(symbol)
    if not n:
        return np.empty(0, np.int64)
    lanes = -(-n // LANE)
    padded = np.zeros(lanes * LANE, np.uint8)
    padded[:n] = symbol
    fresh = np.zeros(lanes * LANE, bool)
    fresh[firsts] = True
    column = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
    news = np.ascontiguousarray(fresh.reshape(lanes, LANE).T)
    any_new = news.any(axis=1)
    flat = GO.ravel()
    maps = np.repeat(np.arange(8, dtype=np.uint8)[:, None], lanes, axis=1)  # the function of each lane so far
    for j in range(LANE):
        if any_new[j]:
            maps[:, news[j]] = CLOSED
        maps = flat[(maps << 3) | column[j]]
    width = 1
    while width < lanes:  # inclusive scan by composition: the function of all lanes up to each
        earlier, later = maps[:, :-width], maps[:, width:]
        maps = np.concatenate([maps[:, :width], np.take_along_axis(later, earlier, axis=0)], axis=1)
        width *= 2
    state = np.concatenate([np.full(1, CLOSED, np.uint8), maps[CLOSED, :-1]])
    out = np.empty((LANE, lanes), bool)
    begins = BEGIN.ravel()
    for j in range(LANE):
        if any_new[j]:
            state = np.where(news[j], np.uint8(CLOSED), state)
        key = (state << 3) | column[j]
        out[j] = begins[key]
        state = flat[key]
    marks = np.ascontiguousarray(out.T).ravel()[:n]
    marks[firsts] = True
    return np.flatnonzero(marks)


class Ranks:
    """Vocabulary of a rank file, and pieces merged before."""

    def __init__(self, lines: bytes):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}
        self.bytes = {v: k for k, v in self.rank.items()}
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.held = 0

    def merge(self, piece: bytes) -> tuple[int, ...]:
        rank = self.rank
        if (whole := rank.get(piece)) is not None:
            return (whole,)
        if len(piece) > 128:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank.get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
        while pairs:
            least = min(pairs)
            if least == 1 << 30:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pairs[i - 1] = rank.get(parts[i - 1] + parts[i], 1 << 30)
        return tuple(rank[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap and a linked list: n log n, for pieces of any length."""
        import heapq

        rank, n = self.rank, len(piece)
        end, right, left = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, to = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != to:
                continue
            alive[j], end[i], right[i] = False, end[j], right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := rank.get(piece[i : end[right[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[right[i]]))
            if (p := left[i]) >= 0 and (r := rank.get(piece[p : end[i]])) is not None:
                heapq.heappush(heap, (r, p, end[i]))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = right[i]
        return tuple(out)

    def ids(self, piece: bytes) -> tuple[int, ...]:
        found = self.cache.get(piece)
        if found is None:
            found = self.merge(piece)
            if len(piece) <= 64:
                self.held += _ENTRY + len(piece) + 8 * len(found)
                if self.held > CACHE_BYTES:
                    self.cache.clear()
                    self.held = _ENTRY + len(piece) + 8 * len(found)
                self.cache[piece] = found
        return found


@cache
def ranks(path: str) -> Ranks:
    with open(path, "rb") as f:
        return Ranks(f.read())


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pieces begin (bytes), how long they are, and the first piece of every text (one more for the end)."""
    points, at = code_points(data)
    filled = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
    begin = at[scan(symbols(points, np.searchsorted(at, filled)), np.searchsorted(at, filled))]
    size = np.diff(np.append(begin, len(data)))
    return begin, size, np.searchsorted(begin, offsets)


def distinct(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index for each different piece, and which of these every piece is.  Pieces up to 7
    bytes are told apart by their bytes, longer ones by a hash, then by both their ends."""
    keys, first, last = span_keys(data, begin, size)
    _, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
    inverse = inverse.ravel()
    rep = index[inverse]
    if not ((size[rep] == size) & (first[rep] == first) & (last[rep] == last)).all():
        return np.arange(len(begin)), np.arange(len(begin))
    return index, inverse


def encode_batch(data: np.ndarray, offsets: np.ndarray, path: str):
    """ids of every different piece, which of these each piece is, the first piece of every text, and where pieces begin."""
    table = ranks(path)
    begin, size, firsts = pieces(data, offsets)
    index, inverse = distinct(data, begin, size)
    whole = data.tobytes()
    ids = [table.ids(whole[a : a + n]) for a, n in zip(begin[index].tolist(), size[index].tolist(), strict=True)]
    return ids, inverse, firsts, begin


def hold(ids: np.ndarray, per: np.ndarray, data: np.ndarray, offsets: np.ndarray, table: Ranks) -> None:
    """Decodes the ids of every text and holds them against its bytes; a difference is an error."""
    vocabulary, whole, flat = table.bytes, data.tobytes(), ids.tolist()
    for a, b, start, end in zip(per[:-1].tolist(), per[1:].tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b"".join([vocabulary[i] for i in flat[a:b]]) != whole[start:end]:
            raise ValueError("a text is not what its ids decode to")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, ids, starts (bytes at which tokens begin).
    Null texts, as empty ones, have no tokens; other columns are not read.  If `decoded`, the ids
    of every text are decoded too, and an error is raised if that does not give the text."""
    _check(docs, path)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = raw(batch.column(1))
        table = ranks(path)
        distinct_ids, inverse, firsts, _ = encode_batch(data, offsets, path)
        count = np.array([len(x) for x in distinct_ids], np.int64)
        flat = np.fromiter((i for x in distinct_ids for i in x), np.int32, int(count.sum()))
        base = np.concatenate([[0], np.cumsum(count)])[:-1]
        n = count[inverse]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(base[inverse] - ends[:-1], n) + np.arange(ends[-1])]
        sizes = _sizes(table)[ids].astype(np.int64)
        per = ends[firsts]
        if decoded:
            hold(ids, per, data, offsets, table)
        starts = np.cumsum(sizes) - sizes - np.repeat(offsets[:-1], np.diff(per))
        lists = lambda values: pa.ListArray.from_arrays(pa.array(per, pa.int32()), values)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(per), pa.int64()), lists(pa.array(ids, pa.int32())), lists(pa.array(starts, pa.int32()))], ["id", "n_tokens", "ids", "starts"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, n_tokens long, ids array<int>, starts array<int>", 1).withColumnRenamed("id", id_col)


def _sizes(table: Ranks) -> np.ndarray:
    if not hasattr(table, "sizes"):
        table.sizes = np.zeros(max(table.bytes, default=0) + 1, np.int32)
        table.sizes[list(table.bytes)] = [len(b) for b in table.bytes.values()]
    return table.sizes


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """`encoded` with the bytes of its ids; null ids give null, an unknown id is an error."""

    @F.pandas_udf(T.BinaryType())
    def run(ids):
        table = ranks(path).bytes
        return ids.map(lambda x: None if x is None else b"".join([table[int(i)] for i in x]))

    return encoded.withColumn(to, run(ids_col))


def _check(docs: DataFrame, path: str) -> None:
    with open(path, "rb") as f:
        f.read(1)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes whole texts; one row per row of docs: id_col, n_tokens, ids_sha256, decoded_sha256."""
    _check(docs, path)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = raw(batch.column(1))
        vocabulary = ranks(path).bytes
        ids, inverse, firsts, _ = encode_batch(data, offsets, path)
        named = [",".join(map(str, x)) for x in ids]
        decoded = [b"".join([vocabulary[i] for i in x]) for x in ids]
        count = np.array([len(x) for x in ids], np.int64)
        total = np.concatenate([[0], np.cumsum(count[inverse])])[firsts]
        which, at = inverse.tolist(), firsts.tolist()
        a, b = [], []
        for i, j in zip(at, at[1:], strict=False):
            own = which[i:j]
            a.append(hashlib.sha256(",".join([named[k] for k in own]).encode()).hexdigest())
            b.append(hashlib.sha256(b"".join([decoded[k] for k in own])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(total), pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, F.col(text_col).cast("string").alias("text")), run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", 1)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"), vocabulary())
