"""Each stage's decisions against SQL on that stage's own input, the tokens against the tiktoken library."""

import base64
import hashlib

import duckdb
import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from driftline.llm import bpe, decontaminate, jaccard, linededup, quality
from driftline.llm.common import table, written

SF = "/root/testdata/sf0.001"


def sql(docs, text):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.execute(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    got = con.execute(text)
    names = [d[0] for d in got.description]
    return [dict(zip(names, r)) for r in got.fetchall()]


def test_stages(spark):
    docs, seen = table(spark, SF, "documents"), []
    columns = docs.columns
    for name, stage in C.STAGES:
        seen.append((name, docs))
        docs = written(stage(spark, docs, SF))
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns
    before = dict(seen)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    order = [n for n, _ in seen]
    after = {n: before[m] for n, m in zip(order, order[1:])}
    keeps = {
        "quality_rules": [r["doc_id"] for r in sql(before["quality_rules"], quality.SQL) if r["kept"]],
        "line_dedup": [r["doc_id"] for r in sql(before["line_dedup"], linededup.SQL) if r["n_removed"] == 0 or r["n_removed"] < r["n_lines"]],
        "jaccard_join": [r["doc_id"] for r in sql(before["jaccard_join"], jaccard.SQL) if r["doc_id"] == r["component_id"]],
        "decontamination": [r["doc_id"] for r in sql(before["decontamination"], decontaminate.SQL) if not r["contaminated"]],
    }
    for name, want in keeps.items():
        assert ids(after[name]) == sorted(want), name
        assert 0 < len(want) <= before[name].count()
    texts = {r.doc_id: r.text for r in after["line_dedup"].collect()}
    kept = {r["doc_id"]: r["kept_sha256"] for r in sql(before["line_dedup"], linededup.SQL)}
    assert all(hashlib.sha256((t or "").encode()).hexdigest() == kept[i] for i, t in texts.items())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.vocabulary()[0], "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids_sha256 for r in docs.select("doc_id", "ids_sha256").collect()}
    assert got == {r.doc_id: hashlib.sha256(",".join(map(str, lib.encode_ordinary(r.text or ""))).encode()).hexdigest() for r in before["bpe"].collect()}
