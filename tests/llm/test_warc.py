import base64
import gzip
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from stripewise.llm.warc import DATA, StoredZip, _record, _records, _wanted, directory, place, read_archives, typed_pages, write_archives


class Bytes:
    def __init__(self, data):
        self.f, self.n = io.BytesIO(data), len(data)
        self.seek, self.read = self.f.seek, self.f.read

    def size(self):
        return self.n


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2 b", "<p>one</p>"), (3, None, None), (4, "http://a/4", ""), (5, "u", "é😀" * 50_000), (5, "u", "é😀" * 50_000), (None, "v", "<p>null</p>"), (None, None, "<p>null</p>"), (6, "line\nbreak", "x\r\n\r\ny")]
    return spark.createDataFrame([(*r, "d", 0, True) for r in rows], "page_id long, url string, html string, digest string, row long, revisit boolean").repartition(3)


@pytest.mark.parametrize("zip64", [False, True])
def test_round_trip(pages, tmp_path, zip64):
    packages = write_archives(pages, f"file://{tmp_path}/w", package_bytes=1000, zip64=zip64)
    assert len(list((tmp_path / "w").iterdir())) == packages.count()
    got = read_archives(packages).collect()
    assert len(got) == pages.count() == sum(r.records for r in packages.collect())
    want = {}
    for r in pages.collect():
        want.setdefault(r.html or "", []).append(r.page_id)
    for html, ids in want.items():
        raw = html.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        mine = [r for r in got if r.payload_digest == digest]
        last = max((i for i in ids if i is not None), default=None)
        assert sorted((r.page_id for r in mine), key=repr) == sorted(ids, key=repr)
        assert {r.payload_bytes for r in mine} == {len(raw)}
        answers = [r for r in mine if r.record_type == "response"]
        assert [(r.page_id, r.payload) for r in answers] == [(last, bytearray(raw))]
        assert all(r.refers_to == last and r.payload is None for r in mine if r.record_type == "revisit")
    for f in (tmp_path / "w").iterdir():
        with zipfile.ZipFile(f) as z:
            assert z.testzip() is None and all(i.compress_type == 0 for i in z.infolist())


def test_small_payloads_stay_responses(pages, tmp_path):
    got = read_archives(write_archives(pages, f"file://{tmp_path}/w", min_bytes=11)).collect()
    assert {r.record_type for r in got if r.payload_bytes < 11} == {"response"}
    only = read_archives(write_archives(pages, f"file://{tmp_path}/x"), url_prefix="http://a/2").collect()
    assert [r.page_id for r in only] == [2]


def test_empty(pages, tmp_path):
    assert read_archives(write_archives(pages.where("page_id > 99"), f"file://{tmp_path}/w")).count() == 0


def test_directories_of_other_writers():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(DATA, b"abc", zipfile.ZIP_STORED)
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment PK\x05\x06 that looks like an end"
    source = Bytes(out.getvalue())
    found = directory(source)
    at = place(source, found[DATA])
    assert out.getvalue()[at : at + 3] == b"abc"
    with pytest.raises(ValueError):
        place(source, found["packed"])
    with pytest.raises(ValueError):
        directory(Bytes(b"no archive"))


def test_many_members():
    out = io.BytesIO()
    z = StoredZip(out)
    for i in range(70_000):
        z.add(str(i), [b"%d" % i])
    z.close()
    source = Bytes(out.getvalue())
    found = directory(source)
    assert len(found) == 70_000
    at = place(source, found["69999"])
    assert out.getvalue()[at : at + 5] == b"69999"


def test_a_hot_payload_is_spread(spark, tmp_path):
    """Four fifths of the pages are equal: writers get like numbers of rows all the same."""
    pages = spark.range(20_000).selectExpr("id AS page_id", "concat('u', id) AS url", "if(id % 5 < 4, 'soft 404', concat('page ', id)) AS html")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        typed = typed_pages(pages.repartition(8), 0, "page_id", "url", "html")
        rows = typed.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in rows) == 20_000 and max(r["count"] for r in rows) < 8000
        kinds = {r["r"]: r["count"] for r in typed.groupBy(F.col("first").isNotNull().alias("r")).count().collect()}
        assert kinds == {True: 15_999, False: 4001}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_record_ids_and_references(spark, tmp_path):
    """Repeated and null ids in several tasks: no two records share an id, revisits name a response."""
    import re

    pages = spark.createDataFrame([(7, "u", "same")] * 6 + [(None, "v", "same")] * 3, "page_id long, url string, html string").repartition(4)
    write_archives(pages, f"file://{tmp_path}/w").collect()
    texts = []
    for f in (tmp_path / "w").iterdir():
        source = Bytes(f.read_bytes())
        members = directory(source)
        texts += [gzip.decompress(d).decode() for _, _, d in _records(source, members, _wanted(source, members, None))]
    ids = [re.search(r"WARC-Record-ID: (.*)\r", t)[1] for t in texts]
    responses = {i for i, t in zip(ids, texts, strict=True) if "WARC-Type: response" in t}
    to = [re.search(r"WARC-Refers-To: (.*)\r", t)[1] for t in texts if "WARC-Type: revisit" in t]
    assert len(set(ids)) == 9 and len(responses) == 1 and set(to) == responses and len(to) == 8


def test_packages_of_other_writers(spark, tmp_path):
    """Two archives, a gzipped index, and ids that are no numbers."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        lines = []
        for name in ("a.warc.gz", "b.warc.gz"):
            parts = [_record(f"{name}-{i}", i, f"http://{name}/{i}", b"<p>%d" % i, None) for i in range(3)]
            at = 0
            for i, p in enumerate(parts):
                lines.append(f"com,{name})/{i} 2024 " + json.dumps({"url": f"http://{name}/{i}", "filename": name, "offset": str(at), "length": str(len(p))}))
                at += len(p)
            z.writestr(f"archive/{name}", b"".join(parts), zipfile.ZIP_STORED)
        z.writestr("indexes/index.cdxj.gz", gzip.compress("\n".join(lines).encode()), zipfile.ZIP_STORED)
    (tmp_path / "x.wacz").write_bytes(out.getvalue())
    packages = spark.createDataFrame([(f"file://{tmp_path}/x.wacz",)], "path string")
    got = {r.page_id: bytes(r.payload) for r in read_archives(packages, id_type="string").collect()}
    assert got == {f"{n}-{i}": b"<p>%d" % i for n in ("a.warc.gz", "b.warc.gz") for i in range(3)}
