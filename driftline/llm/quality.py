"""Quality rules with host-level verdicts.

Each document gets rule counts over its whole text; the base rules fail a document;
failures are then summed by host, each host's failure rate is shrunk with a beta
prior fitted to all hosts, and a host whose shrunk rate exceeds `host_limit` has all its
documents rejected.  The prior has the pooled rate m as mean; its weight 1 / rho - 1 comes
from the moments of the weighted squared deviations S = sum n (f / n - m) ** 2, of which
the binomial part is taken off: S = m (1 - m) ((1 - rho) (k - 1) + rho (N - sum n ** 2 / N))
for k hosts of n documents, N in all.

Defined cases: a null or empty text has no words and fails; a very long text is counted
whole; a null host is a host of its own; repeated rows are each judged; an empty table
gives an empty table; other columns, whatever their names, are not looked at, and
`kept_documents` returns them as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import small, table, written

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
LEAD = np.ones(256, bool)
LEAD[0x80:0xC0] = False

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A host is rejected when its shrunk failure rate is above this.
HOST_LIMIT = 0.5
#: Bounds of the prior's weight in documents; the upper one also stands for hosts that do not differ.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 1000.0


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[off])


def rule_counts(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    n = len(off) - 1
    out = {c: np.zeros(n, np.int64) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for a, b in K.pieces(off):
        part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        st, en, wo = K.words(part, o, K.SPACED)
        out["n_words"][a:b] = np.diff(wo)
        if not len(st):
            continue
        out["word_chars"][a:b] = _per_text(K.SPACED[part] & LEAD[part], o)
        out["n_symbols"][a:b] = _per_text(SYMBOLS[part], o)
        pre = K.prefix(part, K.BYTE)
        # lines: they start at a text's start and after each \n
        start = np.zeros(len(part) + 1, bool)
        start[o[:-1]] = True
        start[1:][part == 10] = True
        ls = np.flatnonzero(start[:-1])
        le = np.concatenate((ls[1:], [len(part)]))
        le = le - (part[le - 1] == 10)
        doc = np.searchsorted(o, ls, "right") - 1
        held = np.searchsorted(st, le) > np.searchsorted(st, ls)
        ls, le, doc = ls[held], le[held], doc[held]
        key = K.mix(K.span_hash(pre, ls, le) + doc.astype(np.uint64) * K.COEF[40])
        _, first = np.unique(key, return_index=True)
        out["n_dup_lines"][a:b] = np.bincount(doc, minlength=b - a) - np.bincount(doc[first], minlength=b - a)
        # windows of five words that their text has twice or more
        at, so = K.window_starts(wo, WINDOW)
        if len(at):
            h = K.gram_hash(K.span_hash(pre, st, en), at, WINDOW)
            h = K.mix(h + np.repeat(np.arange(b - a), np.diff(so)).astype(np.uint64) * K.COEF[41])
            order = np.argsort(h)
            s = h[order]
            same = s[1:] == s[:-1]
            if same.any():
                twice = np.zeros(len(h), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                cover = np.zeros(len(st) + 1, np.int64)
                np.add.at(cover, at[twice], 1)
                np.add.at(cover, at[twice] + WINDOW, -1)
                out["n_repeat_words"][a:b] = _per_text(np.cumsum(cover[:-1]) > 0, wo)
    return out


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def with_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and the five rule counts of each text."""
    names = [f"k{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text}`").alias("_text"))

    def count(batches):
        for batch in batches:
            c = rule_counts(*K.texts(batch.column("_text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(v) for v in c.values())], names=[*names, *c])

    kinds = dict(src.dtypes)
    out = src.mapInArrow(count, ", ".join(f"{n} {kinds[n]}" for n in names) + ", " + COUNTS)
    return out.withColumnsRenamed(dict(zip(names, keep)))


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(judged: DataFrame, host: str, limit: float = HOST_LIMIT) -> DataFrame:
    """A row per host: _host, docs, failures, shrunk_rate, host_rejected.  `judged` has base_failed."""
    hosts = judged.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    moments = hosts.agg(F.sum("failures").alias("f"), F.sum("docs").alias("n"), F.sum(F.col("docs").cast("double") ** 2).alias("q"), F.count("*").alias("k"), F.sum(F.col("failures").cast("double") ** 2 / F.col("docs")).alias("s"))
    m = F.col("f") / F.nullif("n", F.lit(0))
    within = F.nullif(m * (1 - m), F.lit(0.0))
    rho = ((F.col("s") - F.col("n") * m * m) / within - (F.col("k") - 1)) / F.nullif(F.col("n") - F.col("q") / F.nullif("n", F.lit(0)) - (F.col("k") - 1), F.lit(0.0))
    prior = moments.select(m.alias("m"), rho.alias("rho")).select("m", F.when(F.col("rho") > 0, F.least(F.lit(MOST_WEIGHT), F.greatest(F.lit(LEAST_WEIGHT), 1 / F.col("rho") - 1))).otherwise(F.lit(MOST_WEIGHT)).alias("w"))
    shrunk = (F.col("failures") + F.col("w") * F.col("m")) / (F.col("docs") + F.col("w"))
    return hosts.crossJoin(F.broadcast(prior)).select("_host", "docs", "failures", shrunk.alias("shrunk_rate"), (shrunk > limit).alias("host_rejected"))


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """A row per document: doc_id, the counts, base_failed, host_rejected, kept."""
    judged = with_counts(docs, text, (doc_id, host)).withColumnsRenamed({doc_id: "doc_id", host: "_of"}).withColumn("base_failed", base_failed())
    judged = written(judged)  # narrow; else the texts would be read once for the hosts and once for the documents
    verdicts = small(written(host_verdicts(judged, "_of", limit).where("host_rejected").select("_host", "host_rejected")))
    out = judged.join(verdicts, F.col("_of").eqNullSafe(F.col("_host")), "left")
    rejected = F.coalesce("host_rejected", F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", rejected.alias("host_rejected"), (~F.col("base_failed") & ~rejected).alias("kept"))


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents, all columns, that the rules keep."""

    @F.arrow_udf("boolean")
    def failed(texts: pa.Array) -> pa.Array:
        c = rule_counts(*K.texts(texts))
        return pa.array((c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"]))

    # the input's columns are kept in a struct, so that no name of theirs can clash; only the text goes to Python, once
    judged = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{host}`").alias("host"), failed(F.col(f"`{text}`")).alias("base_failed")))
    verdicts = small(written(host_verdicts(judged, "host").where("host_rejected").select("_host")))
    return judged.where("not base_failed").join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left_anti").select("doc.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).drop("host_rejected")


SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
ww AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
wc AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM ww GROUP BY r),
g AS (SELECT r, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d, lead(word, 4) OVER o AS e FROM ww WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, word, b, c, d, e) AS n FROM g WHERE e IS NOT NULL) WHERE n > 1),
rw AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM rep, range(5) AS x(k)) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
dl AS (SELECT r, sum(n - 1) AS n FROM (SELECT r, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
j AS (SELECT t.doc_id, t.source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN wc USING (r) LEFT JOIN dl USING (r) LEFT JOIN rw USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY source),
o AS (SELECT sum(f)::DOUBLE / sum(n) AS m, sum(n)::DOUBLE AS n, sum(n::DOUBLE * n) AS q, count(*) AS k, sum(f::DOUBLE * f / n) AS s FROM h),
p AS (SELECT m, ((s - n * m * m) / nullif(m * (1 - m), 0) - (k - 1)) / nullif(n - q / n - (k - 1), 0) AS rho FROM o),
q AS (SELECT m, CASE WHEN rho > 0 THEN least(1000.0, greatest(2.0, 1 / rho - 1)) ELSE 1000.0 END AS w FROM p),
x AS (SELECT source, (f + w * m) / (n + w) > 0.5 AS bad FROM h, q)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT x.bad AS kept
FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source
"""
