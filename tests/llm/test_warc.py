import base64
import hashlib
import random
import zlib

import pytest

from sluiceway.llm import warc
from sluiceway.llm.common import new_path

SCHEMA = "page_id long, url string, html string, sha string, id string, _keep long, _n long"


def brute(rows, least=0):
    out = []
    for key, _, html, *_ in rows:
        data = (html or "").encode()
        same = [k for k, _, h, *_ in rows if (h or "") == (html or "") and k is not None]
        keep = max(same, default=None) if len(data) >= least else key
        out.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if keep is None or keep == key else "revisit", None if keep is None or keep == key else keep))
    return sorted(out, key=str)


def rows():
    nested = "\x1f" + zlib.compress(b"WARC/1.1\r\n").decode("latin-1")
    texts = ["<p>a</p>", "<p>a</p>", None, "", "x" * 3_000_000, "ünï\r\n\r\nWARC/1.1\r\n", nested, "<p>a</p>", "".join(chr(32 + (k * k * 7919) % 90) for k in range(50_000))]
    return [(k, "http://a.example/\r\nX: y" if k == 1 else None if k == 2 else f"http://h{k}.example/ü?q", t, "s", "i", 1, 2) for k, t in enumerate(texts)] + [(0, "http://h0.example/", texts[0], None, None, None, None), (None, None, "no id", None, None, None, None)]


@pytest.mark.parametrize(("range_bytes", "least"), [(700, 0), (1 << 23, 0), (5000, 5)])
def test_round_trip(spark, range_bytes, least):
    pages = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    files = warc.write_archives(pages, new_path(spark, "warc"), least_bytes=least)
    found = warc.read_archives(files, range_bytes).collect()
    got = sorted(((int(r.record_id) if r.record_id else None, r.payload_bytes, r.payload_digest, r.record_type, int(r.refers_to) if r.refers_to else None) for r in found), key=str)
    assert got == brute(rows(), least)
    by = {r.record_id: r for r in found if r.record_type == "response"}
    assert by["4"].payload == ("x" * 3_000_000).encode() and by["5"].payload.decode() == rows()[5][2]


def test_empty_table(spark):
    files = warc.write_archives(spark.createDataFrame([], SCHEMA), new_path(spark, "warc"))
    assert warc.read_archives(files).count() == 0


def test_any_byte_belongs_to_one_range(tmp_path):
    data = b"".join(warc.record(str(k), "http://a/", bytes(range(256)) * k, None) for k in range(12))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    for step in (97, 1000, len(data)):
        keys = [f["WARC-Record-ID"] for a in range(0, len(data), step) for f, _ in warc.records(f"file://{path}", a, min(len(data), a + step), len(data))]
        assert keys == [f"<urn:record:{k}>" for k in range(12)]


@pytest.mark.parametrize("bad", [{0}, {5}, {11}, {4, 6}, {0, 1, 11}, {2, 3, 4}])
def test_a_damaged_record_takes_no_other_with_it(tmp_path, bad):
    whole = [warc.record(str(k), "http://a/", bytes((k * k + j * j * 31) % 251 for j in range(900)), None) for k in range(12)]
    torn = [x[:200] + bytes([x[200] ^ 255]) + x[201:] if k in bad else x for k, x in enumerate(whole)]
    data, path = b"".join(torn), tmp_path / "a.warc.gz"
    path.write_bytes(data)
    place = [sum(map(len, torn[:k])) for k in range(13)]
    stretches = [(k, next(j for j in range(k, 13) if j not in bad)) for k in sorted(bad) if k - 1 not in bad]
    for step in (97, 1000, len(data)):
        passed, keys = [], []
        for a in range(0, len(data), step):
            keys += [f["WARC-Record-ID"] for f, _ in warc.records(f"file://{path}", a, min(len(data), a + step), len(data), passed)]
        assert keys == [f"<urn:record:{k}>" for k in range(12) if k not in bad]
        assert passed == [(place[a], place[b] - place[a]) for a, b in stretches]
        assert keys == [f["WARC-Record-ID"] for a in range(0, len(data), step) for f, _ in warc.records(f"file://{path}", a, min(len(data), a + step), len(data))]


def test_a_record_in_the_payload_of_another_is_none_beside_damage(tmp_path):
    r = random.Random(3)
    inner = warc.record("inner", None, r.randbytes(400), None)
    outer = warc.record("outer", None, r.randbytes(90_000) + inner + r.randbytes(500), None)
    last = warc.record("last", None, b"z" * 900, None)
    data = outer + last[:100] + b"?" + last[101:]
    assert inner in data
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    passed, keys = [], []
    for a in range(0, len(data), 10_000):
        keys += [f["WARC-Record-ID"] for f, _ in warc.records(f"file://{path}", a, min(len(data), a + 10_000), len(data), passed)]
    assert keys == ["<urn:record:outer>"] and passed == [(len(outer), len(last))]


def test_damage_is_listed_and_ranges_are_read_by_many_tasks(spark, tmp_path):
    whole = [warc.record(str(k), None, bytes([k]) * 3000, None) for k in range(40)]
    data = b"".join(whole[:20]) + b"junk" + b"".join(whole[20:])
    (tmp_path / "a.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", len(data)), (None, 5), (f"file://{tmp_path}/none", 0)], "file string, bytes long")
    found = warc.read_archives(files, 300)
    assert found.count() == 40
    assert found.rdd.getNumPartitions() > 20
    assert [tuple(x)[1:] for x in warc.passed_over(files, 300).collect()] == [(len(b"".join(whole[:20])), 4)]
