"""WARC round trips and toxicity scores on null, empty, repeated and clashing input."""

import base64
import hashlib

from driftline.llm import toxicity, warc
from driftline.llm.common import table

SF = "/root/testdata/sf0.001"
PAGES = [(1, "http://a/", "<p>x</p>"), (5, "http://b/", "<p>x</p>"), (5, "http://b/", "<p>x</p>"), (2, None, None), (3, "http://c/ d", ""), (None, "u", "é\r\n\r\nWARC/1.0\r\n" * 50), (9, "v", "z" * 300000)]


def test_warc(spark):
    pages = spark.createDataFrame([(*r, "sha", 1) for r in PAGES], "page_id long, url string, html string, sha string, n int")
    read = warc.read_archives(warc.write_archives(warc.planned(pages), archive_bytes=2000))
    got = sorted((str(warc.of_uri(r.record_id)), r.record_type, str(r.refers_to and warc.of_uri(r.refers_to)), r.payload_digest, r.payload_bytes, bytes(r.payload) if r.payload is not None else None) for r in read.collect())
    html = lambda t: (t or "").encode()
    digest = lambda t: base64.b32encode(hashlib.sha1(html(t)).digest()).decode()
    last = {1: 5, 2: 3}
    want = sorted((str(i), "revisit" if i in last else "response", str(last.get(i)), digest(t), len(html(t)), None if i in last else html(t)) for i, _, t in PAGES)
    assert [(*x[:5], x[5] is None) for x in got] == [(*x[:5], x[5] is None) for x in want]
    assert [x[5] for x in got if x[5]] == [x[5] for x in want if x[5]]
    empty = pages.limit(0)
    assert warc.read_archives(warc.write_archives(warc.planned(empty))).count() == 0


def test_toxicity(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    rows = spark.createDataFrame([(1, None, 7, "a"), (2, "", 7, "a"), (2, "", 7, "a"), (None, "you are here", 7, "a"), (3, "word " * 50000, 7, "a")], "doc_id long, text string, score int, lang string")
    for m in (model, None):
        got = toxicity.score(rows, m).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
        assert toxicity.score(rows.limit(0), m).count() == 0
    assert toxicity.fit(docs, table(spark, SF, "labels").limit(0)) is None
