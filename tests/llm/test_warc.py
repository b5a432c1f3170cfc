import hashlib

from llm import warc
from llm.common import scratch_path

HTML = "<p>" + "é" * 60 + "</p>"


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 5) for i, u, h in rows],
                                 "page_id long, url string, html string, file string, offset int")


ROWS = [(k, f"https://www.h{k % 3}.example.com/{k % 5}?q={k}", HTML if k % 2 else f"<p>{k} WARC/1.1\r\n\r\n</p>" * 9) for k in range(60)]
ROWS += [(100, None, HTML), (101, "http://[bad", "short"), (102, "", "short"), (103, "HTTP://A.b:8080/x y\tz", None), (None, "u", HTML),
         (104, "same", "\r\n\r\n" * 40), (104, "same", "\r\n\r\n" * 40), (105, "http://x/", "0" * 3_000_000), (106, "http://x/", "t")]


def _want(rows):
    first = {}
    for i, _, h in rows:
        h = h or ""
        if len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in rows:
        h = h or ""
        old = first.get(h)
        again = old is not None and old != i
        out.append((i, len(h.encode()), hashlib.sha256(h.encode()).hexdigest(), "revisit" if again else "response", old if again else None))
    return sorted(out, key=str)


def test_pages_come_back_through_the_index(llm_spark):
    assert sorted(map(tuple, warc.round_trip(_pages(llm_spark, ROWS)).collect()), key=str) == _want(ROWS)


def test_small_blocks_files_and_single_lookups(llm_spark):
    folder = scratch_path(llm_spark, "warc-test")
    captures = warc.write(_pages(llm_spark, ROWS), folder, file_bytes=2_000)
    shards = warc.build_index(captures, folder, block=3)
    assert captures.select("file").distinct().count() > 4 and captures.count() == len(ROWS)
    some = _pages(llm_spark, [r for r in ROWS if r[0] in (7, 104, 105)] + [(999, "http://absent/", "")])
    got = sorted(map(tuple, warc.lookup(some, shards).collect()))
    assert got == sorted(r for r in _want(ROWS) if r[0] in (7, 104, 105))


def test_keys_reverse_the_host():
    assert warc.url_key("https://WWW.Example.org/a?b=c#d") == "org,example,www)/a?b=c"
    assert warc.url_key("http://h:81") == "h:81)/"
    assert "\t" not in warc.url_key("http://h/a\tb c") and warc.url_key(None) == ")"


def test_empty_table(llm_spark):
    assert warc.round_trip(_pages(llm_spark, [])).count() == 0
