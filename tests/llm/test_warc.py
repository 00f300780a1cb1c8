import hashlib

import numpy as np
import pytest

from rasterloom.llm import warc
from rasterloom.llm.common import scratch_path

PAGES = "page_id long, url string, html string, kind string"


def expected(rows):
    first = {}
    for pid, _, html, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        if len(raw) >= warc.LEAST:
            first.setdefault(raw, pid)
    out = []
    for pid, _, html, _ in rows:
        raw = (html or "").encode()
        copy = len(raw) >= warc.LEAST and first[raw] != pid
        out.append((pid, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if copy else "response", first[raw] if copy else None))
    return sorted(out, key=str)


def through(spark, rows, records_per_file=50):
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(2), path, records_per_file=records_per_file)
    got = warc.read_archives(spark, path).collect()
    return sorted(((r.page_id, r.payload_bytes, r.computed if r.kind == "response" else r.digest, r.kind, r.refers_to) for r in got), key=str)


def rows(n=60):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    made = [(i, f"u{i}", f"page {i} " * (i % 9), "x") for i in range(n)]
    made += [(1000 + i, None, "same payload " * 20, None) for i in range(7)]
    made += [(2000, "u", None, None), (2001, "u", "", None), (2002, "a\r\nb", inner * 3 + "é" * 40, None), (2003, "u", inner, None), (2004, "u", "WARC/1.1\r\n", None), (2005, "u", "tail WARC/1.1\r\nContent-Length: 7\r\n\r\n" * 4, None)]
    return made


def test_round_trip(spark):
    assert through(spark, rows()) == expected(rows())


@pytest.mark.parametrize("limit", ["300b", "1k"])
def test_many_splits(spark, limit):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    spark.conf.set(keys[0], limit)
    spark.conf.set(keys[1], "0b")
    spark.conf.set(keys[2], "1")
    try:
        assert through(spark, rows(), records_per_file=0) == expected(rows())
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_empty_and_repeated(spark):
    assert through(spark, []) == []
    twice = [(1, "u", "z" * 200, None)] * 2
    assert sorted(x[3] for x in through(spark, twice)) == ["response", "response"]
    assert through(spark, [(None, "u", "short", None)]) == [(None, 5, hashlib.sha256(b"short").hexdigest(), "response", None)]


def test_pointer_jumping():
    at, following = np.array([0, 10, 14, 30, 35]), np.array([10, 30, 20, 60, 99])
    assert warc.reached(at, following, 0).tolist() == [True, True, False, True, False]
    assert warc.jump(at, following, 50).tolist() == [60, 60, -1, 60, 99]
