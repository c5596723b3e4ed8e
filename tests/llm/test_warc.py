"""Archives: exact round trips, the revisit rule by brute force, reads by ranges."""

from collections import defaultdict
from hashlib import sha1

import pytest

from factloom.llm import warc

LONG = "x" * 1000


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, value int, _span int")


@pytest.fixture(scope="module")
def odd_pages(spark):
    texts = [None, "", "short", LONG, LONG, LONG, "é" * 500, "é" * 500, "é" * 499 + "x", "z" * 3_000_000]
    texts += [f"WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 7\r\n\r\n{n}\n" + "\r\n\r\n" * 300 for n in (1, 1, 2)]
    texts += [LONG] * 40 + ["\x00\x01 ok"]
    rows = [(at, f"http://a.example/{at}", text, "d", 1, 2) for at, text in enumerate(texts)]
    rows += [(90, None, "w" * 1200, None, None, None), (91, "http://x/\r\nWARC-Type: revisit\r\n\r\n a", "w" * 1200, None, None, None)]
    rows += [(None, "", "w" * 1200, None, None, None), (None, None, "alone" * 300, None, None, None)]
    rows += [(None, None, None, None, None, None), (91, "again", "w" * 1200, None, None, None)]
    return pages_of(spark, rows).repartition(4)


def expected(pages):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.collect()]
    ids = defaultdict(list)
    for page_id, body in rows:
        ids[body].append(page_id)
    wanted = []
    for page_id, body in rows:
        known = [i for i in ids[body] if i is not None]
        best = max(known) if known and len(body) >= 1000 and len(ids[body]) > 1 else None
        kind = ("response", None) if best is None or page_id == best else ("revisit", best)
        wanted.append((page_id, len(body), sha1(body).hexdigest(), *kind))
    return wanted


def key(row):
    return repr(tuple(row))


def test_round_trip_by_brute_force(spark, odd_pages):
    got = warc.round_trip(odd_pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(key, got.collect())) == sorted(map(key, expected(odd_pages)))


def test_empty_table(spark, odd_pages, tmp_path):
    assert warc.round_trip(odd_pages.limit(0)).collect() == []
    warc.write_archives(odd_pages.limit(0), str(tmp_path / "none"))
    assert warc.indexed(spark, str(tmp_path / "none")).collect() == []


def test_index_and_any_choice_of_records(spark, odd_pages, tmp_path):
    folder = str(tmp_path / "archives")
    warc.write_archives(odd_pages, folder)
    index = warc.indexed(spark, folder)
    rows = index.collect()
    assert len(rows) == odd_pages.count()
    by_file = defaultdict(list)
    for row in rows:
        by_file[row["file"]].append((row["offset"], row["length"]))
    for file, spans in by_file.items():
        with warc.opened(file) as source:
            body = source.read()
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and body[at : at + length].endswith(b"\r\n\r\n")
            at += length
        assert at == len(body)
    texts = {r["page_id"]: r["html"] or "" for r in odd_pages.filter("page_id < 90").collect()}
    chosen = index.filter("record_type = 'response' AND page_id % 3 = 0 AND page_id < 90")
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_records(chosen).collect()}
    assert got and got == {i: texts[i] for i in got}
    assert {r["url"] for r in rows if r["page_id"] == 90} == {"urn:page:90"}


def test_reads_are_coalesced_and_bounded(spark, tmp_path, monkeypatch):
    pages = pages_of(spark, [(n, "u", f"{n} " * 20_000, None, None, None) for n in range(40)]).coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"))
    index = warc.indexed(spark, str(tmp_path / "a")).toPandas().sort_values("offset")
    reads = []

    class Watched:
        def __init__(self, file):
            self.file = open(file.removeprefix("file:"), "rb")

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def seek(self, at):
            self.file.seek(at)

        def read(self, size):
            reads.append(size)
            return self.file.read(size)

    monkeypatch.setattr(warc, "opened", Watched)
    monkeypatch.setattr(warc, "RANGE", 500_000)

    class Frame:
        """Stands in for the table: keeps the function that tasks run."""

        sparkSession, schema = spark, spark.createDataFrame(index.head(1), warc.INDEX).schema

        def __getattr__(self, _):
            return lambda *a: self

        def mapInPandas(self, function, _):
            return function

    read = warc.read_records(Frame())
    every = [frame for frame in read(iter([index]))]
    assert sum(map(len, every)) == 40 and len(reads) < 20 and max(reads) <= 500_000
    reads.clear()
    list(read(iter([index.iloc[::20]])))
    assert len(reads) == 2 and sum(reads) == index.iloc[::20]["length"].sum()


def test_broken_archive_is_named(tmp_path):
    (tmp_path / "part-0").write_bytes(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nnot a record")
    with pytest.raises(ValueError, match="byte 40"):
        list(warc.records(str(tmp_path / "part-0")))
