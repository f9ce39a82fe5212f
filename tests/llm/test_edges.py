"""Every operator and stage on null, empty, very long, repeated, tied and clashing input, and on empty tables."""

import hashlib

import pytest

import corpus_pipeline as C
from driftline.llm import bpe, decontaminate, jaccard, licenses, linededup, lm, quality, suffixes, toxicity, warc

LONG = " ".join(f"w{i}" for i in range(30))
HUGE = "\n".join(" ".join(f"v{i}x{j}" for j in range(9)) for i in range(12_000))
ROWS = [(1, None), (2, ""), (3, " \n\n"), (4, LONG), (4, LONG), (None, LONG + "\n" + LONG), (6, None), (7, "é" * 5000), (8, HUGE), (9, HUGE)]
#: Names that operators use, or have used, for columns of their own.
CLASHING = "n_words n_lines n_removed _gone _host _of _found _w base_failed kept h g n key doc words found text_ row order component_id unit part block range body node tokens id root score label fold toxic win term pos start items ids sha payload refers_to _l _text _id host lines at".split()


@pytest.fixture(scope="module")
def docs(spark):
    kinds = ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(i, t, "en", None if i == 1 else "good" if i in (4, 8, 9) else "host", 0 if t is None else len(t), *[f"own {c}" for c in CLASHING]) for i, t in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {kinds}").repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("a", " ".join(LONG.split()[5:17]), 1, "x"), ("b", None, 1, "x"), ("c", "", 1, "x")], "item_id string, text string, _item long, ws string")


@pytest.fixture(scope="module")
def folder(spark, items, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    items.write.parquet(f"{at}/benchmark.parquet")
    return at


def pages(d):
    return warc.read_archives(warc.write_archives(warc.planned(d, "doc_id", "source", "text"))).withColumnRenamed("record_id", "doc_id")


OPERATORS = {
    "bpe": lambda d, i: bpe.encode(d, *bpe.vocabulary()),
    "suffixes": lambda d, i: suffixes.spans(d),
    "warc": lambda d, i: pages(d),
    "toxicity": lambda d, i: toxicity.score(d, toxicity.fit(d, d.selectExpr("doc_id", "doc_id % 2 as toxic", "n"))),
    "jaccard": lambda d, i: jaccard.link(d),
    "quality": lambda d, i: quality.apply_rules(d),
    "linededup": lambda d, i: linededup.dedup_lines(d),
    "decontaminate": lambda d, i: decontaminate.report(decontaminate.find(d, i)),
    "lm": lambda d, i: lm.scores(d),
    "licenses": lambda d, i: licenses.scan(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(docs, items, name):
    got = OPERATORS[name](docs, items).collect()
    if name != "warc":
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in ROWS)
    assert len(got) == len(ROWS)
    assert OPERATORS[name](docs.limit(0), items).count() == 0
    values(name, {r.doc_id: r for r in got})


def values(name, by):
    if name == "quality":
        assert [by[i].n_words for i in (1, 2, 3, 4, 8)] == [0, 0, 0, 30, 108_000]
        assert all(r.base_failed and not r.kept for r in by.values() if r.n_words == 0)
    if name == "suffixes":
        assert [len(r.spans) for i, r in sorted((i or 99, r) for i, r in by.items())] == [0, 0, 0, 0, 0, 0, 0, 1, 2]
        assert by[9].spans[0].end == by[9].n_bytes and bytes(by[9].kept) == b""
    if name == "jaccard":
        assert by[9].component_id == 8 and by[4].component_id == 4 and by[8].n_shingles == 108_000 - 4
    if name == "linededup":
        assert by[9].n_removed == by[9].n_lines == 12_000 and by[9].text == "" and by[8].text == HUGE and by[1].text is None and by[2].text == ""
        assert all(r[c] == f"own {c}" for r in by.values() for c in CLASHING if c not in ("n_lines", "n_removed"))
    if name == "decontaminate":
        assert [by[i].n_hit for i in (1, 2, 3, 4, None, 8)] == [0, 0, 0, 12, 24, 0] and by[8].n_words == 108_000
    if name == "lm":
        assert by[1].mean_log_score is None and by[8].mean_log_score == by[9].mean_log_score
    if name == "bpe":
        assert by[9].decoded_sha256 == hashlib.sha256(HUGE.encode()).hexdigest() and by[1].n_tokens == 0
    if name == "warc":
        assert sorted(r.record_type for r in by.values()).count("revisit") >= 3


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stage(spark, docs, folder, name):
    stage, left = dict(C.STAGES)[name], sorted((i or 99) for i, _ in ROWS)
    want = {
        "quality_rules": [4, 4, 8, 9],
        "line_dedup": [i for i in left if i != 9],
        "jaccard_join": [1, 2, 3, 4, 6, 7, 8],
        "decontamination": [1, 2, 3, 6, 7, 8, 9],
        "bpe": left,
    }[name]
    got = stage(spark, docs, folder).collect()
    kept = sorted(r.doc_id or 99 for r in got)
    if name == "jaccard_join":
        assert kept in (want, sorted([*want, 99]))
    else:
        assert kept == want
    if name != "bpe":
        assert all(r[c] == f"own {c}" for r in got for c in CLASHING) and list(got[0].asDict()) == docs.columns
    none = stage(spark, docs.limit(0), folder)
    assert none.count() == 0


def test_clean_of_an_empty_benchmark(docs, items):
    assert decontaminate.clean(docs, items.limit(0)).count() == len(ROWS)
