"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

The benchmark's items give distinct windows of WINDOW consecutive words.  The training
texts are split into words once, in a written table.  One pass over it counts the windows'
terms; each window then has a rarest and a second rarest term.  A second pass stores the
postings (document, position, the words around it) of these terms only.  The lists of a
window's two terms, each less its offset in the window, are intersected; what remains is
the start of a match in all likelihood, and the whole window is compared with the words
that the posting holds, so that no text is shuffled.  Proximity matches intersect the same two lists by the distance of their positions,
whatever the order, and compare all the places around them in the words that the rarer term's posting holds.

Benchmark terms are looked up in a hash set inside the scan while there are at most
SET_TERMS of them and SET_BYTES in all, else by a join.  Tables are broadcast if their
bytes are counted first and few; else both sides are shuffled, which holds at any size.

Defined cases: null and empty texts have no words; a very long text is split whole; an
item of fewer than WINDOW words is one window, one of none has no window; an item id may
repeat, its windows add up; null item ids are left out of the list; repeated documents are
each judged; an empty table gives no rows, an empty benchmark hits nothing; other columns,
whatever their names, stay in the struct `doc` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, written

WINDOW = 10
#: Words that proximity matches may stand away from their window's place.
SLOP = 2
#: Terms, and their characters in all, kept as a set inside the scan's expression.
SET_TERMS, SET_BYTES = 50_000, 2 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text") -> F.Column:
    """Words of the lower-cased text (A-Z only); null has none."""
    found = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(found, lambda w: w != "")


def split_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """key (one for each row), doc (a struct of the columns but the text, if there are any), n_words, words; a written table."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    base = docs.select(F.monotonically_increasing_id().alias("key"), F.struct(*rest).alias("doc") if rest else F.lit(None).cast("string").alias("doc"), words(f"`{text}`").alias("words"))
    return written(base.select("key", "doc", F.size("words").cast("long").alias("n_words"), "words"))


def windows_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """win, ws array<string>, items array: the distinct windows and the items that have them."""
    w = benchmark.select(F.col(item_id).cast("string").alias("item"), words(text).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    found = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("ws")).groupBy("ws").agg(F.collect_set("item").alias("items"))
    return written(found.withColumn("win", F.monotonically_increasing_id()))


def _hits(base: DataFrame, terms: DataFrame, around: int = 0) -> DataFrame:
    """The term of each occurrence; with `around`, postings: key, pos, term, before and ctx, the fewer than `around` words before it, itself and those after it."""
    n, size = terms.agg(F.count("*"), F.sum(F.length("term"))).first()
    literals = sorted(r[0] for r in terms.collect()) if n <= SET_TERMS and (size or 0) <= SET_BYTES else None
    if not around:
        if literals is not None:
            return base.select(F.explode(F.filter("words", lambda w: w.isin(literals))).alias("term"))
        return base.select(F.explode("words").alias("term")).join(terms, "term", "left_semi")
    before = lambda at: F.least(at, F.lit(around - 1))
    posting = lambda w, at: F.struct(w.alias("term"), at.alias("pos"), before(at).alias("before"), F.slice("words", at - before(at) + 1, before(at) + around).alias("ctx"))
    if literals is not None:
        at = F.filter(F.transform("words", lambda w, i: F.when(w.isin(literals), i)), lambda i: i.isNotNull())
        return base.select("key", F.inline(F.transform(at, lambda i: posting(F.get("words", i), i))))
    each = base.select("key", "words", F.posexplode("words").alias("pos", "term")).join(terms, "term", "left_semi")
    return each.withColumn("x", posting(F.col("term"), F.col("pos"))).select("key", "x.*")


def _rarest(base: DataFrame, windows: DataFrame, each: DataFrame) -> DataFrame:
    """win, r: each window's terms by rising count; a window with a term that no text has can't occur.

    `each` has win, n (the number of rows that the window has in it), term and any columns to keep with a term.
    """
    terms = written(windows.select(F.explode("ws").alias("term")).distinct())
    df = small(written(_hits(base, terms).groupBy("term").agg(F.count("*").alias("df"))))
    rest = [c for c in each.columns if c not in ("win", "n", "term")]
    ranked = each.join(df, "term").groupBy("win", "n").agg(F.array_sort(F.collect_list(F.struct("df", "term", *rest))).alias("r"))
    return ranked.where(F.size("r") == F.col("n")).select("win", "r")


def matches(base: DataFrame, windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, start, length, items: where a window stands.

    The offset-adjusted lists of a window's two rarest terms are intersected on (document, start); what remains
    is compared whole with the words that the rarest term's posting has around it.
    """
    ranked = _rarest(base, windows, windows.select("win", F.size("ws").alias("n"), F.posexplode("ws").alias("off", "term")))
    second = F.get("r", F.lit(1))
    pick = written(ranked.select("win", F.col("r")[0]["term"].alias("t1"), F.col("r")[0]["off"].alias("o1"), second["term"].alias("t2"), second["off"].alias("o2")))
    rare = written(pick.select(F.explode(F.array("t1", "t2")).alias("term")).where("term is not null").distinct())
    postings = written(_hits(base, rare, window))
    p = written(pick.drop("win").distinct())  # windows with the same terms at the same offsets share one intersection
    lists = ["key", "start", "t1", "o1", "t2", "o2"]
    one = postings.join(small(p), F.col("term") == F.col("t1")).select("key", (F.col("pos") - F.col("o1")).alias("start"), *lists[2:])
    two = postings.join(small(p.where("t2 is not null")), F.col("term") == F.col("t2")).select("key", (F.col("pos") - F.col("o2")).alias("start"), *lists[2:])
    both = one.where("t2 is not null").join(two, lists, "left_semi").unionByName(one.where("t2 is null")).where("start >= 0").distinct()
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"k.{c}")) for c in lists[2:]]
    named = both.alias("c").join(small(pick).alias("k"), same[0] & same[1] & same[2] & same[3])
    named = named.select("key", F.col("c.t1").alias("term"), (F.col("start") + F.col("c.o1")).alias("pos"), F.col("c.o1").alias("off"), "win")
    # a merge join at every size: the candidates grow with the corpus and are never broadcast
    firsts = written(pick.select(F.col("t1").alias("term")).distinct())
    held = postings.join(small(firsts), "term", "left_semi").join(named.hint("merge"), ["key", "term", "pos"]).select("key", (F.col("pos") - F.col("off")).alias("start"), "off", "before", "ctx", "win")
    exact = held.where("off <= before").join(small(windows), "win").where(F.slice("ctx", F.col("before") - F.col("off") + 1, F.size("ws")) == F.col("ws"))
    return exact.select("key", "start", F.size("ws").alias("length"), "items")


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, doc (a struct of the columns but the text), n_words and found, an array of (start, length, items) of each exact match."""
    base = split_texts(docs, text)
    got = matches(base, windows_of(benchmark, item_id, item_text, window), window).groupBy("key").agg(F.collect_list(F.struct("start", "length", "items")).alias("found"))
    none = F.array().cast("array<struct<start:int,length:int,items:array<string>>>")
    return base.select("key", "doc", "n_words").join(small(written(got)), "key", "left").withColumn("found", F.coalesce("found", none))


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, start, items: where all words of a window stand within the window's length and `slop` words around it, in any order.

    A start is a place where that many words, or the whole of a shorter text, begin.  A word that the window repeats need stand once.
    """
    w = windows_of(benchmark, window=window)
    base = split_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    # every window with its two rarest distinct terms
    ranked = _rarest(base, w, w.select("win", F.size(F.array_distinct("ws")).alias("n"), F.size("ws").alias("len"), F.explode(F.array_distinct("ws")).alias("term")))
    one = F.col("r")[0]
    pick = written(ranked.select("win", one["len"].alias("len"), one["term"].alias("t1"), F.coalesce(F.get("r", F.lit(1))["term"], one["term"]).alias("t2")))
    terms = written(pick.select(F.explode(F.array("t1", "t2")).alias("term")).distinct())
    postings = written(_hits(base, terms, window + 2 * slop))
    # positions less than `reach` apart lie in the same stretch of `reach` words or in neighbouring ones
    p = written(pick.select("len", "t1", "t2").distinct().withColumn("reach", F.col("len") + 2 * slop))
    stretch = F.floor(F.col("pos") / F.col("reach"))
    a = postings.join(small(p), F.col("term") == F.col("t1")).select("key", "len", "t1", "t2", "reach", "pos", "before", "ctx", stretch.alias("b"))
    b = postings.select("key", "pos", "term").join(small(p), F.col("term") == F.col("t2")).select("key", "len", "t1", "t2", F.col("pos").alias("p2"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("b"))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "len", "t1", "t2", "b")]
    near = a.alias("a").join(b.alias("b"), [*same, F.abs(F.col("a.pos") - F.col("b.p2")) < F.col("a.reach")], "left_semi")
    c = near.join(small(pick), ["len", "t1", "t2"]).select("key", "pos", "before", "ctx", "win").join(small(w), "win")
    # the posting's words are those of the text from `pos - before` on; all places that can hold it are among them
    n, zero = F.size("ws"), F.col("pos") - F.col("before")
    begin = lambda s: F.greatest(F.lit(0), s - slop)
    around = lambda s: F.slice("ctx", begin(s) - zero + 1, s + n + slop - begin(s))
    places = F.sequence(F.greatest(F.lit(0), F.col("pos") - n - (slop - 1)), F.col("pos") + slop)
    hit = c.select("key", n.alias("len"), "items", F.explode(F.filter(places, lambda s: F.size(F.array_except("ws", around(s))) == 0)).alias("start"))
    whole = hit.distinct().join(base.select("key", "doc", "n_words"), "key").where(F.col("start") <= F.greatest(F.lit(0), F.col("n_words") - F.col("len")))
    return whole.select(F.col("doc.doc_id").alias(doc_id), "start", "items").distinct()


def report(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated."""
    places = F.flatten(F.transform("found", lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1)))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("found", lambda x: x["items"]))))
    return found.select(F.col(f"doc.`{doc_id}`").alias("doc_id"), "n_words", F.size(F.array_distinct(places)).cast("long").alias("n_hit"), items.alias("items")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents, all columns, in which no window occurs."""
    # the text rides along in the struct beside its words
    base = split_texts(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text")))
    hit = small(written(matches(base, windows_of(benchmark)).select("key").distinct()))
    return base.select("key", "doc").join(hit, "key", "left_anti").select("doc.row.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report(find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))
    return out.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


_W = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
b AS (SELECT item_id, {_W} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + 9] AS ws FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, w[i:i + n - 1] AS ws FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT len(ws) AS n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (ws)),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, range(10) AS x(k) WHERE k < n GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op8_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, item_id: all places where an item's window stands in any order within SLOP words."""
    found = proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), SLOP)
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.explode("items").alias("item_id")).distinct()


PROXIMITY_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_W} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_W} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, w[i:i + 9] AS ws FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
one AS MATERIALIZED (SELECT row_number() OVER () AS k, ws, len(ws) AS n FROM (SELECT DISTINCT ws FROM win)),
wt AS MATERIALIZED (SELECT k, n, len(u) AS m, unnest(u) AS t FROM (SELECT k, n, list_distinct(ws) AS u FROM one)),
dp AS MATERIALIZED (SELECT doc_id, len(w) AS nd, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS pos FROM d),
c AS MATERIALIZED (SELECT doc_id, k FROM (SELECT DISTINCT doc_id, t FROM dp) JOIN wt USING (t) GROUP BY doc_id, k, m HAVING count(*) = m),
s AS (SELECT doc_id, k, m, t, unnest(range(greatest(0, pos - n - {SLOP - 1}), least(greatest(0, nd - n), pos + {SLOP}) + 1)) AS start FROM c JOIN wt USING (k) JOIN dp USING (doc_id, t))
SELECT DISTINCT doc_id, start, item_id FROM (SELECT doc_id, k, start FROM s GROUP BY doc_id, k, start, m HAVING count(DISTINCT t) = m) JOIN one USING (k) JOIN win USING (ws)
"""
