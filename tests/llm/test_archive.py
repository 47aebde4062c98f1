import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from netloom.llm import warc_archive as wa
from netloom.llm.files import dealt, read_file

PAGES = "page_id long, url string, html string, file string"


def pages():
    draw = random.Random(2)
    words = ["<p>", "</p>", "naïve", "漢字", "the", "of", 'href="/a"', "\r\n"]
    html = lambda n: "<html>" + " ".join(draw.choice(words) for _ in range(n)) + "</html>"
    long = html(600)
    texts = [None, "", "x", html(20), long, long, long.replace("of", "if"), html(60_000), "é" * 500, "é" * 500, "a" * 999, "a" * 999]
    out = [(i, f"http://h/{i}", t, "clash") for i, t in enumerate(texts)]
    return [*out, out[5], (None, None, long, None), (100, "http://h/\r\nWARC-Type: x", "", None)]


def test_awkward_pages(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    files = wa.write_archives(spark.createDataFrame(pages(), PAGES), folder)
    assert all(wa.Reader(read_file(folder, r["file"])).start > 8 for r in files.collect())  # a small table has a dictionary too
    got = wa.read_archives(files, folder).collect()
    assert len(got) == len(pages())
    of = {}
    for i, _, html, _ in pages():
        of.setdefault(i, (html or "").encode())
    for r in got:
        data = of[r["page_id"]]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha1(data).hexdigest()
        same = [i for i, x in of.items() if x == data and i is not None]
        if len(data) < 1000 or same == [r["page_id"]] and len(data) != len(of[5]):
            assert r["record_type"] == "response" and r["refers_to"] is None
        elif r["record_type"] == "revisit":
            assert r["refers_to"] == max(same)
    assert [r["record_type"] for r in got].count("response") == len(pages()) - 4  # 4, 8, one of the two rows 5, and the null id
    assert wa.archive(spark.createDataFrame([], PAGES)).count() == 0


def test_dictionary_travels_in_the_file_and_records_are_read_alone(spark, tmp_path):
    draw = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    many = [(i, f"http://h/{i}", "<html><body class='x'>" + " ".join(draw.choice(words) for _ in range(300))) for i in range(800)]
    folder = str(tmp_path / "w")
    files = wa.write_archives(spark.createDataFrame(many, "page_id long, url string, html string"), folder)
    data = read_file(folder, files.first()["file"])
    reader = wa.Reader(data)
    assert reader.start > 8  # the leading frame holds a dictionary
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompressobj().decompress(data[reader.start :])
    offsets, at = [], reader.start
    while at < len(data):
        offsets.append(at)
        at = reader.at(at)[1]
    fields, http, payload = wa.parse(reader.at(offsets[len(offsets) // 2])[0])
    assert many[int(fields["X-Page-ID"])][2].encode() == payload and http.startswith(b"HTTP/1.1 200")
    assert fields["WARC-Type"] == "response"
    assert wa.read_archives(files, folder).count() == 800


def test_few_or_unlike_records_have_a_dictionary_too():
    draw = random.Random(6)
    unlike = [draw.randbytes(40) for _ in range(20)]
    for records in ([b"WARC/1.1 one"], unlike, [b"WARC/1.1 " + bytes([65 + i]) * 3000 for i in range(40)]):
        writer = wa.Writer(wa.train(records))
        for x in records:
            writer.add(x)
        reader = wa.Reader(writer.data())
        assert reader.start > 8 and list(reader) == records
    assert wa.train([]) == b""


def test_files_are_read_by_many_tasks(spark):
    files = spark.createDataFrame([(f"{i:032x}", 1) for i in range(40)], "file string, n_records long")
    tasks = dealt(files, 40).select(F.spark_partition_id().alias("at")).distinct().count()
    assert tasks > 5 and dealt(files.limit(0), 0).count() == 0
