import hashlib
import io

import pytest
import zstandard as zstd

from beaconry.llm import common, warc

LONG, LONG2 = "<p>" + "é" * 200, "<p>" + "z" * 150


def test_round_trip_and_revisits(spark):
    rows = [(5, "http://a/\n x", LONG, "e"), (2, "http://b", LONG, "e"), (9, None, LONG2, "e"), (1, "u", "short", "e"), (3, "u", "short", "e"), (4, "u", None, "e"), (7, "u", "", "e"), (9, None, LONG2, "e"), (None, "n", "lone" * 40, "e")]
    out = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string, digest string"))
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out.collect()), key=repr)
    first = {LONG: 2, LONG2: 9}
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        to = first.get(h)
        again = to is not None and to != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", to if again else None))
    assert got == sorted(want, key=repr)


def test_payloads_come_back_and_the_dictionary_leads(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<html>{'common boilerplate words ' * 20}{i * i * 37 % 10007} {hashlib.md5(str(i).encode()).hexdigest()}</html>") for i in range(1600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(warc.with_references(pages, "page_id", "html"), str(tmp_path / "w"), "page_id", "url")
    paths = [r["path"] for r in manifest.collect()]
    assert any(open(p, "rb").read(4) == b"\x5d\x2a\x4d\x18" for p in paths)
    got = warc.read_archives(spark, manifest).collect()
    assert {(r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in got} == set(rows)
    assert all(r["error"] is None for r in got)


def one_frame(record, dictionary=None):
    d = None if dictionary is None else zstd.ZstdCompressionDict(dictionary)
    return zstd.ZstdCompressor(dict_data=d).compress(record)


def test_packed_dictionary_and_plain_archives():
    good = warc.record_bytes(1, "u", b"x" * 10, hashlib.sha256(b"x" * 10).hexdigest(), None)
    trained = zstd.train_dictionary(2000, [good + bytes([i]) * 50 for i in range(200)]).as_bytes()
    for body in (trained, zstd.ZstdCompressor().compress(trained)):
        lead = (0x184D2A5D).to_bytes(4, "little") + len(body).to_bytes(4, "little") + body
        raw = lead + one_frame(good, trained) * 3
        assert list(warc.frames(io.BytesIO(raw))) == [good] * 3
    assert list(warc.frames(io.BytesIO(one_frame(good) * 2))) == [good] * 2
    assert list(warc.frames(io.BytesIO(b""))) == []
    with pytest.raises(warc.BadRecord):
        list(warc.frames(io.BytesIO(one_frame(good)[:-3])))


@pytest.mark.parametrize(
    "change",
    [
        lambda x: x.replace(b"WARC/1.1", b"WARK/1.1"),
        lambda x: x.replace(b"WARC-Date: ", b"WARC-Dote: "),
        lambda x: x.replace(b"Content-Length: 9", b"Content-Length: 8", 1),
        lambda x: x.replace(b"payload", b"paylaod"),
        lambda x: x[:-2],
        lambda x: x.replace(b"WARC-Type: response", b"WARC-Type: metadata"),
        lambda x: x.replace(b"WARC-Type: ", b"WARC-Type ", 1),
    ],
)
def test_bad_records_are_refused(change):
    payload = b"the payload"
    good = warc.record_bytes(1, "u", payload, hashlib.sha256(payload).hexdigest(), None)
    assert warc.parse_record(good)["payload"] == payload
    bad = change(good)
    assert bad != good
    with pytest.raises(warc.BadRecord):
        warc.parse_record(bad)


def test_empty_table(spark):
    out = warc.archived(spark.createDataFrame([], "page_id long, url string, html string"))
    assert out.collect() == []
    assert common.shared_dir(spark)


def test_an_archive_cut_after_a_frame_is_found_out(spark, tmp_path):
    from pyspark.sql import functions as F

    from beaconry.llm import warc

    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * i) for i in range(5)] + [(None, "u", "s"), (None, "v", "s")], "page_id long, url string, html string").coalesce(1)
    rows = warc.with_references(pages, "page_id", "html")
    manifest = warc.write_archives(rows, f"file://{tmp_path}/w", "page_id", "url")
    assert warc.read_archives(spark, manifest).count() == 7
    more = manifest.withColumn("records", F.col("records") + 1)
    with pytest.raises(Exception, match="where the manifest has"):
        warc.read_archives(spark, more).collect()
    assert warc.read_archives(spark, more, strict=False).where("error is not null").count() == manifest.count()
