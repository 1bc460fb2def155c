import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sluiceway.llm import byte_bpe
from sluiceway.llm.common import raw

from .awkward import TEXTS, awkward, empty

PATH = byte_bpe.vocabulary()
with open(PATH, "rb") as f:
    TABLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})


def ids_of(texts):
    data, offsets = raw(pa.array(texts, pa.string()))
    ids, inverse, firsts, _ = byte_bpe.encode_batch(data, offsets, PATH)
    return [[i for k in inverse[a:b] for i in ids[k]] for a, b in zip(firsts, firsts[1:], strict=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aA1 '\n\t\r 　strevldm.,!漢é"))), max_size=8))
def test_as_the_library_does(texts):
    assert ids_of(texts) == [TABLE.encode_ordinary(t) for t in texts]


def test_every_code_point_between_others():
    every = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}" for c in every[k : k + 5000]) for k in range(0, len(every), 5000)] + ["".join(f" {c}1" for c in every[k : k + 5000]) for k in range(0, len(every), 5000)]
    assert ids_of(texts) == [TABLE.encode_ordinary(t) for t in texts]


def test_long_pieces():
    r = random.Random(4)
    texts = ["".join(r.choice("abcdeilnorst") for _ in range(n)) for n in (100, 129, 1000, 30_000)] + ["=" * 5000, " " * 3000 + "x", "\n" * 777]
    assert ids_of(texts) == [TABLE.encode_ordinary(t) for t in texts]


def test_awkward_rows_and_round_trip(spark):
    docs = awkward(spark)
    expected = sorted(((k, len(i := TABLE.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in TEXTS), key=str)
    assert sorted((tuple(r) for r in byte_bpe.digests(docs, PATH).collect()), key=str) == expected
    rows = byte_bpe.decode(byte_bpe.encode(docs.repartition(3), PATH), PATH).collect()
    assert sorted(((r.doc_id, bytes(r.decoded)) for r in rows), key=str) == sorted(((k, (t or "").encode()) for k, t in TEXTS), key=str)
    for r in rows:
        assert len(r.ids) == len(r.starts) == r.n_tokens
        parts = [r.decoded[a:b] for a, b in zip(r.starts, [*r.starts[1:], len(r.decoded)], strict=False)]
        assert [TABLE.decode_single_token_bytes(i) for i in r.ids] == [bytes(p) for p in parts]
    assert byte_bpe.digests(empty(spark), PATH).count() == 0 and byte_bpe.encode(empty(spark), PATH).count() == 0
