"""Line dedup by winnowing over line hashes, in DataFrame functions only.

1. A document's non-blank lines are hashed; each window of RUN consecutive lines selects
   its smallest hash (the first of equal ones).  Only selected lines are fingerprints, a row
   each of hash, document and line number, so any repeated run of RUN lines or more is bound to
   share one with its other occurrences.
2. The positions of each fingerprint are joined; those of fingerprints that stand in one
   place only are done, and their documents are not looked at again.
3. The others are extended both ways, line by line: the documents' line hashes are looked up
   around each, and wherever as many lines as make up RUN with those on its other side agree with an
   earlier place, the match holds.  The earliest place with the same lines is the first
   occurrence.  Longer runs are covered to both their ends, for each RUN lines of theirs hold a
   fingerprint.
4. Every line of a run's later occurrences (by document id, then position) goes, the first
   occurrence stays; blank lines are kept unless the whole text goes.

Lines are compared by 128 bits of hashes, fingerprints are chosen by 64 of them.

Hot lines: fingerprints and matches are aggregated before they are shuffled, every
position is joined to one first occurrence and never to all others, and adaptive
execution splits the places of a hot match.

Defined cases: a null text stays null, has no lines and loses none; an empty text
stays empty; a very long text is taken whole; an empty table gives no rows; rows with one
id are one document for the order, so that a repeated row is kept as it is; a null id
comes first; lines are compared as they are, white space included; other columns are
carried along untouched whatever their names, but for n_lines and n_removed, whose place
dedup_lines takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, written

#: Runs of this many lines are guaranteed to be found; it is the winnowing window.
RUN = 2
WORD = r"[^\x20\x09-\x0D]"


def _lines(text: str) -> F.Column:
    return F.split(F.col(text), "\n")


def _hashed(docs: DataFrame, doc_id: str, text: str, run: int) -> DataFrame:
    """_id, _l: the non-blank lines of documents that have `run` of them, as two hashes and the number in the text."""
    lines = F.transform(_lines(text), lambda x, i: F.struct(F.when(x.rlike(WORD), F.xxhash64(x)).alias("h"), F.xxhash64(F.lit(run), x).alias("g"), i.alias("i")))
    return docs.select(F.col(doc_id).alias("_id"), F.filter(lines, lambda x: x["h"].isNotNull()).alias("_l")).where(F.size("_l") >= run)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """_print, _id, _at: the selected lines, by their numbers among the document's non-blank lines."""
    held = _hashed(docs, doc_id, text, run).select("_id", F.transform("_l", lambda x: x["h"]).alias("_h"))
    least = lambda at: F.array_position(F.slice("_h", at + 1, run), F.array_min(F.slice("_h", at + 1, run)))
    chosen = F.transform(F.sequence(F.lit(0), F.size("_h") - run), lambda at: (at + least(at)).cast("int") - 1)
    return held.select("_id", F.inline(F.transform(F.array_distinct(chosen), lambda k: F.struct(F.get("_h", k).alias("_print"), k.alias("_at"))))).select("_print", "_id", "_at")


def matched(found: DataFrame) -> DataFrame:
    """_of, _ats: each document's fingerprints that stand in another place too."""
    place = F.struct("_id", "_at")
    shared = found.groupBy("_print").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z or not (a.`_id` <=> z.`_id`)").select("_print")
    return found.join(shared, "_print", "left_semi").groupBy(F.col("_id").alias("_of")).agg(F.collect_set("_at").alias("_ats"))


def extended(docs: DataFrame, places: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """_id, at, lines, h, g: every `run` lines around the places' fingerprints, by first line and by the lines' hashes."""
    held = _hashed(docs, doc_id, text, run).join(places, F.col("_id").eqNullSafe(F.col("_of")))
    starts = F.flatten(F.transform("_ats", lambda k: F.sequence(F.greatest(F.lit(0), k - (run - 1)), F.greatest(F.least(k, F.size("_l") - run), F.greatest(F.lit(0), k - (run - 1))))))
    held = held.select("_id", "_l", F.explode(F.array_distinct(F.filter(starts, lambda s: s <= F.size("_l") - run))).alias("at")).select("_id", "at", F.slice("_l", F.col("at") + 1, run).alias("_w"))
    return held.select("_id", "at", F.transform("_w", lambda x: x["i"]).alias("lines"), F.xxhash64(F.transform("_w", lambda x: x["h"])).alias("h"), F.xxhash64(F.transform("_w", lambda x: x["g"])).alias("g"))


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """_id, _lines array<int>: the extended matches that have an earlier occurrence."""
    places = small(written(matched(written(fingerprints(docs, doc_id, text, run)))))
    match = written(extended(docs, places, doc_id, text, run))
    at = F.struct("_id", "at")
    first = match.groupBy("h", "g").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last or not (first.`_id` <=> last.`_id`)").select("h", "g", "first")
    later = match.join(first, ["h", "g"]).where(~(F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("at") == F.col("first.at"))))
    return later.select("_id", F.col("lines").alias("_lines"))


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """doc (a struct of the input's columns), text (without later repeated runs), n_lines, n_removed."""
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    late = repeated_windows(docs, "_id", "_text", run).groupBy("_id").agg(F.array_distinct(F.flatten(F.collect_list("_lines"))).alias("_gone"))
    late = small(written(late.withColumnRenamed("_id", "_of")))
    out = docs.join(late, F.col("_id").eqNullSafe(F.col("_of")), "left")
    # the lambda's argument holds the split text, which is then split once, not once a line
    once = F.array(F.struct(_lines("_text").alias("l"), F.col("_gone").alias("g")))
    left = lambda s: F.array_except(F.sequence(F.lit(0), F.size(s["l"]) - 1), s["g"])
    rest = F.transform(once, lambda s: F.array_join(F.transform(left(s), lambda i: F.get(s["l"], i)), "\n"))[0]
    total = F.when(F.col("_text").isNull(), 0).otherwise(F.size(F.filter(_lines("_text"), lambda x: x.rlike(WORD)))).cast("long")
    out = out.select("doc", "_text", "_gone", total.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
    return out.select("doc", F.when(F.col("n_removed") == 0, F.col("_text")).when(F.col("n_removed") == F.col("n_lines"), F.lit("")).otherwise(rest).alias("text"), "n_lines", "n_removed")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """The documents with their columns, the text without later repeated runs, and n_lines, n_removed."""
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return removed(docs, doc_id, text, run).select(*[F.col("text").alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in names], "n_lines", "n_removed")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_single_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later occurrence of any line goes, whatever stands around it: the shortest run is one line."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), run=1)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
n AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS held FROM l),
h AS (SELECT *, CASE WHEN held THEN sum(held::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 END AS k FROM n),
w AS (SELECT doc_id, k, line AS a, lead(line, @ - 1) OVER (PARTITION BY doc_id ORDER BY k) AS b FROM h WHERE held),
f AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, k) AS r FROM w WHERE b IS NOT NULL) WHERE r > 1),
g AS (SELECT DISTINCT doc_id, k + x AS k FROM f, range(@) AS t(x)),
m AS (SELECT h.*, g.k IS NOT NULL AS gone FROM h LEFT JOIN g ON h.doc_id = g.doc_id AND h.k = g.k),
s AS (SELECT doc_id, sum(held::INT) AS n_lines, sum(gone::INT) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS rest, string_agg(line, chr(10) ORDER BY i) AS whole FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(CASE WHEN n_removed = 0 THEN coalesce(whole, '') WHEN n_removed = n_lines THEN '' ELSE rest END) AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id)
"""
#: Of runs of two lines or more, and of single lines.
SQL, SINGLE_SQL = _SQL.replace("@", "2"), _SQL.replace("@", "1")
