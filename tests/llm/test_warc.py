"""WARC bundles: exact round trip, revisit rule, seek table."""

import hashlib
import io
import random

import pytest
import zstandard

from costlens.llm import warc as W

SCHEMA = "page_id long, url string, html string, record_type string"


def brute(rows):
    first = {}
    for i, _, h, _ in rows:
        h = h or ""
        if i is not None and len(h.encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h, _ in rows:
        data, least = (h or "").encode(), first.get(h or "")
        revisit = least is not None and i != least
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", least if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rng = random.Random(10)
    body = ["é" * n for n in (49, 50, 51)] + ["x" * 99, "x" * 100, "", "<html>\r\n\r\nWARC/1.1\r\n\r\n" + "y" * 200, "z" * 700_000]
    rows = [(i, f"http://h/{i}", rng.choice(body + [f"page {i} " * 40]), "mine") for i in rng.sample(range(1000), 200)]
    rows += [(5000, None, None, None), (5001, "a\r\nX-Page-Id: 7", "w" * 300, ""), (None, "u", "w" * 300, ""), (None, "u", "v" * 300, ""),
             (None, "u", "v" * 300, "")]
    rows += [rows[0], rows[1]]
    out = W.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows)
    assert W.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_frames_and_bundles(spark, tmp_path):
    rows = [(i, "u", f"page {i} " * 50, "") for i in range(60)]
    folder = f"file://{tmp_path}/bundles"
    index = W.write_bundles(W.planned(spark.createDataFrame(rows, SCHEMA).coalesce(1)), folder, frame=1500, bundle=900)
    assert index.select("bundle").distinct().count() > 3 and index.agg({"frame": "max"}).first()[0] > 1
    assert sorted((tuple(r) for r in W.read_bundles(index, folder).collect()), key=repr) == brute(rows)
    any_file = next((tmp_path / "bundles").iterdir()).read_bytes()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(any_file), read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")


def test_damage_is_reported(spark, tmp_path):
    sink = io.BytesIO()
    sink.close = lambda: None
    writer = W.BundleWriter(sink)
    writer.frame(b"abc" * 100)
    writer.frame(b"def")
    writer.close()
    data = sink.getvalue()
    reader = W.BundleReader(io.BytesIO(data), len(data))
    assert reader.frame(1) == b"def" and reader.frame(0) == b"abc" * 100
    with pytest.raises(ValueError):
        W.BundleReader(io.BytesIO(data[:-1]), len(data) - 1)
