import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from docquarry.llm import warc


def rows():
    big = "<p>" + "é" * 700 + "</p>"
    return [
        (1, "http://b.com/x", big), (2, "http://a.com/y?q=1#f", big), (5, "http://a.com/y?q=1", big), (3, None, "small"), (4, "http://a.com/y", "small"),
        (6, "https://www.A.com/", None), (None, "http://n.org", big), (7, "http://c.com/ sp\r\nace", ""), (8, "http://z.net", "<html>\r\n\r\nWARC/1.1\r\n" + "x" * 2000), (8, "http://z.net", "<html>\r\n\r\nWARC/1.1\r\n" + "x" * 2000),
    ]


def test_records_round_trip_and_refer_to_the_newest(spark, tmp_path):
    df = spark.createDataFrame([(*r, "t") for r in rows()], "page_id long, url string, html string, type string").repartition(3)
    got = warc.archived(df, path=str(tmp_path / "w")).collect()
    assert len(got) == len(rows())
    for r in got:
        if r.page_id == 8:
            assert (r.record_type, r.refers_to, r.payload_bytes) == ("response", None, 2020)
    of = {r.page_id: r for r in got}
    for page, _, html in rows():
        data = (html or "").encode()
        assert (of[page].payload_bytes, of[page].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {p: (of[p].record_type, of[p].refers_to) for p in (1, 2, 5, None, 3, 4)} == {1: ("revisit", 5), 2: ("revisit", 5), None: ("revisit", 5), 5: ("response", None), 3: ("response", None), 4: ("response", None)}


def test_archives_are_plain_gzip_and_cut_by_size(spark, tmp_path):
    df = spark.createDataFrame(rows(), "page_id long, url string, html string").coalesce(1)
    warc.write(df, str(tmp_path / "w"), archive=300)
    found = sorted((tmp_path / "w").glob("part-*"))
    assert len(found) > 2
    text = b"".join(gzip.GzipFile(fileobj=io.BytesIO(f.read_bytes())).read() for f in found)
    assert text.count(b"WARC-Type: ") == len(rows()) and b"%0D%0A" in text


def test_captures_are_in_order_over_all_archives(spark, tmp_path):
    rng = random.Random(2)
    pages = [(i, f"http://h{rng.randrange(4)}.com/{rng.randrange(9)}", f"page {i}") for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    got = warc.archived(df, path=str(tmp_path / "w")).orderBy("capture_no").collect()
    assert [r.capture_no for r in got] == list(range(300))
    assert [(r.url_key, r.page_id) for r in got] == sorted((warc.url_key(u), i) for i, u, _ in pages)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_equals_a_sort(k):
    rng = random.Random(k)
    lists = [sorted(rng.choices(range(20), k=rng.randint(0, 9))) for _ in range(k)]
    assert list(warc.LoserTree(lists, key=lambda x: x)) == sorted(x for one in lists for x in one)


@pytest.mark.parametrize("seed", range(6))
def test_blocks_in_the_order_of_their_heads_equal_a_sort(seed):
    rng = random.Random(seed)
    runs = [sorted(rng.choices(range(40), k=rng.randint(0, 60))) for _ in range(rng.randint(1, 9))]
    rows = [(k, run[i - i % 4], i, x) for k, run in enumerate(runs) for i, x in enumerate(run)]
    rows.sort(key=lambda r: (r[1], r[0], r[2]))
    got = list(warc.interleaved(rows, lambda r: r[0], lambda r: r[1], lambda r: r[3]))
    assert [r[3] for r in got] == sorted(x for run in runs for x in run) and sorted(got) == sorted(rows)


def test_a_merge_holds_open_blocks_only(monkeypatch):
    runs = [[k + 50 * i for i in range(4000)] for k in range(5)]
    rows = sorted(((run[i - i % 64], k, i, x) for k, run in enumerate(runs) for i, x in enumerate(run)), key=lambda r: r[:3])
    held, add = [], warc.LoserTree.add
    monkeypatch.setattr(warc.LoserTree, "add", lambda self, n, x: (add(self, n, x), held.append(sum(len(y) - a for y, a in zip(self.lists, self.at, strict=True))))[0])
    assert [r[3] for r in warc.interleaved(rows, lambda r: r[1], lambda r: r[0], lambda r: r[3])] == sorted(x for run in runs for x in run)
    assert max(held) <= 5 * 64 * 2


def test_many_runs_take_a_match_for_each_level():
    """Runs of one capture each, all open at once or one after the other; leaves of runs that ended are used again."""
    rows = [(i, (i * 7919 % 40_000,)) for i in range(40_000)]
    for head in (lambda r: (-1,), lambda r: r[1]):
        given = sorted(rows, key=head)
        matches, beats = [0], warc.LoserTree._beats

        class Counted(warc.LoserTree):
            def _beats(self, a, b):
                matches[0] += 1
                return beats(self, a, b)

        tree = Counted(key=lambda r: r[1])
        out = []
        for row in given:
            out += tree.before(head(row))
            tree.add(row[0], [row])
        out += tree.before()
        assert [r[1] for r in out] == sorted(r[1] for r in rows) and matches[0] < 40_000 * 40
    assert tree.k < 10


def test_captures_of_many_small_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    rng = random.Random(4)
    pages = [(rng.randrange(400), f"http://h{rng.randrange(4)}.com/{rng.randrange(9)}", f"page {i}") for i in range(500)] + [(-5, "http://neg.com", "x"), (3 * 10**10 + 7, "http://far.com", "y")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    warc.write(df, str(tmp_path / "w"), archive=2000)
    got = warc.merged(warc.read(spark, str(tmp_path / "w"))).orderBy("capture_no").collect()
    assert len({r.run for r in got}) > 20 and [r.capture_no for r in got] == list(range(502))
    assert [(r.url_key, r.page) for r in got] == sorted(((warc.url_key(u), i) for i, u, _ in pages), key=lambda x: (x[0], x[1] % warc.SPAN, x[1]))
    assert {r.page: r.captured_at for r in got}[3 * 10**10 + 7] == "2024-01-01T00:00:07Z"


def test_a_very_long_page_and_clashing_columns(spark, tmp_path):
    html = "<p>é</p>" * 700_000
    df = spark.createDataFrame([(1, "http://a.b", html, "x", "y", 3), (2, "http://a.b", html, "x", "y", 3)], "page_id long, url string, html string, digest string, run string, salt int")
    got = warc.archived(df, path=str(tmp_path / "w")).orderBy("page_id").collect()
    assert [(r.record_type, r.refers_to, r.payload_bytes) for r in got] == [("revisit", 2, 6_300_000), ("response", None, 6_300_000)]


def test_url_keys():
    assert warc.url_key("HTTP://u@www.Example.com:80/A?b#c") == "com,example,www)/a?b"
    assert warc.url_key("http://x.org?q") == "org,x)?q" and warc.url_key("http://x.org") == "org,x)/" and warc.url_key(None) == ""


def test_damage_is_found(spark, tmp_path):
    data = warc.record(1, "http://a.b", b"payload", None, hashlib.sha1(b"other").digest())
    with pytest.raises(ValueError):
        warc.parsed(next(warc.members(data))[2])
    with pytest.raises(ValueError):
        list(warc.members(data[:-9]))


def test_no_pages(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(empty, path=str(tmp_path / "w")).select(F.count("*")).first()[0] == 0
