import gzip
import hashlib
import io
import random
import zipfile

import pyarrow as pa
from wayline.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first string"


def brute(rows):
    out = []
    for page_id, url, html in rows:
        body = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == body and r[0] is not None]
        head = min(same) if same and len(body) >= 100 else None
        revisit = head is not None and (page_id is None or page_id > head)
        out.append((str(page_id), len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", head if revisit else None, b"" if revisit else body))
    return sorted(out, key=str)


def test_round_trip_matches_brute_force(spark, tmp_path):
    rng = random.Random(4)
    bodies = ["é" * 60, "x" * 99, "y" * 100, "", None, "<p>" + "z" * 5000, "\r\n\r\n" * 40]
    rows = [(k, f"http://h/{k}?%0A", rng.choice(bodies)) for k in range(80)] + [(3, None, "y" * 100), (None, "u", "y" * 100), (90, "u", "q" * 200), (90, "u", "q" * 200)]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], SCHEMA).repartition(3)
    manifest = warc.write_packages(df, str(tmp_path / "w"), package_bytes=1000)
    assert manifest.count() > 3 and manifest.agg({"n_records": "sum"}).first()[0] == len(rows)
    for record in manifest.collect():
        with zipfile.ZipFile(record.package) as z:
            assert z.testzip() is None
    got = warc.read_records(warc.list_records(manifest)).collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got), key=str) == brute(rows)
    assert {r.url for r in got if r.page_id == 7} == {"http://h/7?%0A"}


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert warc.read_records(warc.list_records(warc.write_packages(df, str(tmp_path / "w")))).count() == 0


def test_zip64_directory(monkeypatch):
    """With the limits lowered, the writer puts ZIP64 records where the reader must follow them."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", comment := zipfile.ZIP_STORED) as z:
        for k in range(5):
            z.writestr(f"archive/{k}", bytes([k]) * (150 * k))
        z.writestr("packed", b"a" * 500, zipfile.ZIP_DEFLATED)
        z.comment = b"comment PK"
    data = out.getvalue()
    members = warc.read_directory(pa.BufferReader(data), len(data))
    assert sorted(members) == [f"archive/{k}" for k in range(5)] and comment == 0
    for k in range(5):
        at, n = members[f"archive/{k}"]
        assert data[at : at + n] == bytes([k]) * (150 * k)


def test_records_are_plain_warc():
    record = warc.build_record(5, "http://a", b"body", hashlib.sha256(b"body").hexdigest(), None)
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and record.endswith(b"body\r\n\r\n")
    assert warc.parse_record(gzip.decompress(gzip.compress(record)))[:4] == (5, "http://a", b"body", 4)
