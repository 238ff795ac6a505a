import hashlib
import random

from conftest import SF

from plumbline.llm import warc

PAGES = "page_id long, url string, html string"


def round_trip(spark, rows, tmp_path, **options):
    frame = spark.createDataFrame(rows, PAGES + ", k int" if rows and len(rows[0]) == 4 else PAGES)
    path = f"file://{tmp_path}/warc"
    warc.write(frame, path, **options)
    return warc.merged_index(warc.read(spark, path, with_html=True)).collect()


def test_round_trip_and_references(spark, tmp_path):
    big, odd = "<p>" + "x" * 2000, "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\x00"
    rows = [(1, "http://b.org/1", big, 0), (2, None, big, 0), (3, "http://a.org/x\r\ny z", "small", 0), (4, "http://a.org/x", "small", 0), (5, "http://a.org", None, 0), (6, "", "", 0), (7, "http://b.org/1", odd, 0), (8, "http://b.org/1", big, 0), (8, "http://b.org/1", big, 0)]
    got = round_trip(spark, rows, tmp_path, records_per_file=2)
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for k, _, html, _ in rows:
        data = (html or "").encode()
        assert by[k].payload_bytes == len(data) and by[k].payload_digest == hashlib.sha1(data).hexdigest()
        if by[k].record_type == "response":
            assert by[k].html == (html or "")
    assert {k: r.refers_to for k, r in by.items() if r.record_type == "revisit"} == {1: 8, 2: 8}


def test_index_is_in_global_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"http://h{rng.randrange(4)}.example.org/{rng.randrange(5)}", str(i)) for i in range(400)]
    got = round_trip(spark, rows, tmp_path, records_per_file=30)
    order = [(r.url_key, r.timestamp, r.page_id) for r in got]
    assert order == sorted(order) and len(order) == 400


def test_pages_without_id_and_url_and_with_extreme_ids(spark, tmp_path):
    ids = [None, -(1 << 63), -5, 0, 253_402_300_799, 253_402_300_800, (1 << 63) - 1]
    rows = [(k, None, f"text {i}") for i, k in enumerate(ids)] + [(3, "http://a.org", "x" * 5000), (None, "http://a.org", "x" * 5000)]
    got = round_trip(spark, rows, tmp_path, records_per_file=2)
    assert sorted((str(r.page_id), r.html) for r in got if r.html and len(r.html) < 100) == sorted((str(k), h) for k, _, h in rows if len(h) < 100)
    assert all(len(r.timestamp) == 20 and "1970" <= r.timestamp[:4] <= "9999" for r in got)
    order = [(r.url_key, r.timestamp, r.page_id or 0) for r in got]
    assert order == sorted(order) and len(got) == len(rows)


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.choices(range(50), k=rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_empty(spark, tmp_path):
    assert round_trip(spark, [], tmp_path) == []


def test_query(spark):
    assert warc.op10_warc(spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").count()
