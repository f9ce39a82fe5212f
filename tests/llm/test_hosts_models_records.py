"""Host verdicts on a bad host, held-out quality of toxicity, foreign WARC records, n-gram scores and notices against SQL."""

import base64
import gzip
import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.llm import licenses, linededup, lm, quality, toxicity, warc
from driftline.llm.common import intermediate, release, small, table, written

SF = "/root/testdata/sf0.001"


def good(i):
    return " ".join(f"word{i}x{j}" for j in range(40))


def hosts(spark):
    """60 good hosts, one bad with 45 failures of 50, one that looks bad by one document alone."""
    rows = [(i, good(i) if i % 11 else "too short", f"host{i % 60}") for i in range(1200)]
    rows += [(5000 + i, "junk" if i < 45 else good(5000 + i), "bad") for i in range(50)]
    rows += [(9000, "junk", "once"), (9001, good(9001), None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_bad_host(spark):
    docs = hosts(spark)
    got = {r.doc_id: r for r in quality.apply_rules(docs).collect()}
    rejected = {i for i, r in got.items() if r.host_rejected}
    assert rejected == {5000 + i for i in range(50)}
    assert all(not got[5000 + i].kept and not got[5000 + i].base_failed for i in range(45, 50))
    assert got[9001].kept and got[1].kept
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = {r[0]: r[-1] for r in con.execute(quality.SQL).fetchall()}
    assert {i: r.kept for i, r in got.items()} == want
    assert sorted(r.doc_id for r in quality.kept_documents(docs).collect()) == sorted(i for i, k in want.items() if k)


def test_prior_takes_off_the_binomial_part(spark):
    """Hosts that differ by chance alone are all shrunk to the pooled rate; hosts that differ are hardly shrunk."""
    r = np.random.default_rng(3)
    same = [(h, bool(r.random() < 0.3)) for h in range(200) for _ in range(5)]
    apart = [(h, bool(r.random() < (0.95 if h % 4 == 0 else 0.02))) for h in range(200) for _ in range(20)]
    spread = {}
    for name, rows in (("same", same), ("apart", apart)):
        out = quality.host_verdicts(spark.createDataFrame(rows, "host long, base_failed boolean"), "host").collect()
        spread[name] = np.std([x.shrunk_rate for x in out]) / np.std([x.failures / x.docs for x in out])
    assert spread["same"] < 0.25 and spread["apart"] > 0.8


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where(toxicity.held_out()).select("score", "toxic").toPandas()
    assert len(rows) > 500 and auc(rows["score"].to_numpy(), rows["toxic"].to_numpy()) >= 0.95


def test_repeated_ids_teach_one_text(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    more = docs.union(docs.withColumn("text", F.concat("text", F.lit(" zz"))))
    a, b = toxicity.fit(docs, labels), toxicity.fit(more.repartition(7), labels)
    assert np.array_equal(a["learned"], b["learned"]) and np.allclose(a["curve"][1], b["curve"][1])


def foreign(kind, block, content, digest=True, **more):
    label = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    head = [f"warc-type: {kind}", f"WARC-RECORD-ID: <urn:x:{kind}>", f"content-length:{len(block)}", f"content-type: {content}", *([f"warc-block-digest: {label}"] if digest else []), *(f"{k.replace('_', '-')}: {v}" for k, v in more.items())]
    return gzip.compress(("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n")


def test_foreign_records(spark):
    http = b"HTTP/1.1 200 OK\r\nserver: x\r\n\r\nhello"
    md5 = "md5:" + hashlib.md5(b"hello").hexdigest()
    records = [
        foreign("warcinfo", b"software: x\r\n", "application/warc-fields"), foreign("request", b"GET / HTTP/1.1\r\nhost: a\r\n\r\n", "application/http; msgtype=request"),
        foreign("response", http, "application/http; msgtype=response", False, warc_payload_digest=md5, warc_target_uri="http://a/"), foreign("metadata", b"", "application/warc-fields", False), foreign("resource", b"\x00\r\n\r\n", "image/png", warc_payload_digest="blake9:abc"),
    ]
    read = lambda content: warc.read_archives(spark.createDataFrame([(bytearray(content),)], "content binary")).collect()
    got = read(b"".join(records))
    assert [r.record_type for r in got] == ["warcinfo", "request", "response", "metadata", "resource"]
    assert [bytes(r.payload) for r in got] == [b"software: x\r\n", b"", b"hello", b"", b"\x00\r\n\r\n"]
    assert got[2].target_uri == "http://a/" and got[2].payload_digest == md5[4:]
    for bad in (foreign("response", http, "application/http", False, warc_payload_digest="sha1:" + "A" * 32), foreign("metadata", b"x", "text/plain", warc_block_digest="sha256:00"), records[0][:-9]):
        with pytest.raises(Exception, match="digest|ends inside|frame"):
            read(records[1] + bad)


def sql(docs, text):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    got = con.execute(text)
    return {r[0]: r[1:] for r in got.fetchall()}


@pytest.mark.parametrize("of", ["lm", "lines", "licenses"])
def test_values_against_sql(spark, of):
    docs = table(spark, SF, "documents")
    if of == "lm":
        want, got = sql(docs, lm.SQL), {r.doc_id: (r.n_words, r.mean_log_score) for r in lm.scores(docs).collect()}
        assert got.keys() == want.keys()
        assert all(got[i][0] == want[i][0] and (want[i][1] is None) == (got[i][1] is None) and abs((got[i][1] or 0) - (want[i][1] or 0)) < 2e-6 for i in want)
    elif of == "lines":
        out = linededup.dedup_lines(docs)
        got = {r.doc_id: (r.n_lines, r.n_removed, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect()}
        want = sql(docs, linededup.SQL)
        assert got == want and any(x[1] for x in want.values())
    else:
        assert {r.doc_id: tuple(r)[1:] for r in licenses._named(licenses.scan(docs)).collect()} == sql(docs, licenses.SQL)


def test_wider_windows(spark):
    """Runs of three lines or more, at any place of their texts."""
    run = "l1\nl2\nl3\nl4"
    rows = [(1, f"a\n{run}\nb"), (2, f"{run}\nc"), (3, "d\nl2\nl3\ne"), (4, f"x\n\nl1\n\nl2\nl3\nl4"), (5, "l2\nl3\nl4")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), run=3).collect()}
    assert got == {1: rows[0][1], 2: "c", 3: rows[2][1], 4: "x\n\n", 5: ""}


def test_intermediate_tables_go(spark, tmp_path):
    df = spark.range(10)
    with intermediate(spark):
        inner = written(df)
        outer = written(inner, path=f"file://{tmp_path}/kept")
    assert outer.count() == 10
    with pytest.raises(Exception):
        inner.count()
    left = written(df)
    release(spark)
    with pytest.raises(Exception):
        left.count()


def test_small_counts_bytes(spark):
    many, wide = spark.range(1000), spark.createDataFrame([("x" * 5000,)], "a string")
    hinted = lambda d: "strategy=broadcast" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(small(many)) and not hinted(small(many, 4000)) and not hinted(small(wide, 4000)) and hinted(small(wide, 6000))
