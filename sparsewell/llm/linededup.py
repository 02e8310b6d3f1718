"""Line dedup by winnowing over line hashes.

A text is its lines; those without a word only go along with others.  A window is the
fewest lines from a line on that make ``min_words`` words, or the fewest up to a line.
Each window selects its least line hash (the leftmost of equal ones); the lines selected
are the text's fingerprints.  Every run of ``min_words`` words holds a window whole, and
equal windows select the same line, so a run that stands in two places has a fingerprint
in both, at the same distance from its ends.

Fingerprints alone are stored and joined over all documents by their hash.  From those
that have more than one place (anchors) matches are extended both ways, line by line:
for each number of lines to the left, up to a whole window, as few to the right as make
``min_words`` words, and the other way round.  An extension is compared with the first
place (in the order of doc_id, text hash, line) that has the same anchor, the same lines to
its left and the same to its right; if that is an earlier one, its lines repeat.  Each line
of a repeated run is in such an extension, of the run's anchor or of the next one, so they
add up to exactly the maximal runs that stood before, whichever of the places before it was;
they are deleted with the blank lines inside them.

All of it is DataFrame operations.  No group is gathered and no pairs are formed: each
extension meets the first place of its kind only, and anchors of a frequent hash are
dealt over ``SALTS`` tasks.

Defined cases: a null or blank text has no windows and stays (null: empty); runs of the
same text repeat too, and may overlap; equal rows are the same document, so each keeps or
loses the same lines; a null doc_id comes first; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import dealt, saved

MIN_WORDS, SALTS = 50, 16
SPACE = r"[\x20\x09-\x0D]+"


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tkey"))


def _count_words(s):
    """Words of a line.  Only lines with other than single blanks are squeezed first."""
    plain = ~s.rlike(r"[\x09-\x0D]|  |^ | $")
    squeezed = F.trim(F.regexp_replace(s, SPACE, " "))
    blanks = lambda t: F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit("")))
    return F.when(s == "", 0).when(plain, blanks(s) + 1).when(squeezed == "", 0).otherwise(blanks(squeezed) + 1).cast("long")


def line_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, tkey (hash of the text), line, h and n (hash and words) of the lines with a
    word, dealt by document."""
    lines = _texts(docs).select("doc_id", "tkey", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    lines = lines.select("doc_id", "tkey", "line", F.xxhash64("s").alias("h"), _count_words(F.col("s")).alias("n")).where("n > 0")
    return lines.repartition("doc_id", "tkey").dropDuplicates(["doc_id", "tkey", "line"])


def windows(lines: DataFrame, min_words: int = MIN_WORDS, contents: bool = False) -> DataFrame:
    """doc_id, tkey, first and last line of each window, fp and at (hash and number of the
    line it selects); contents: hs, the hashes of its lines."""
    of = W.partitionBy("doc_id", "tkey")
    before = F.sum("n").over(of.orderBy("line").rowsBetween(W.unboundedPreceding, -1))
    lines = lines.withColumn("c", F.coalesce(before, F.lit(0)))
    lines = lines.withColumn("end", F.col("c") + F.col("n"))

    def framed(frame, first, last, enough):
        held = [F.collect_list("h").over(frame).alias("hs")] if contents else []
        w = lines.select("doc_id", "tkey", "n", first.alias("line"), last.alias("last"), F.sum("n").over(frame).alias("words"), F.min(F.struct("h", "line")).over(frame).alias("least"), *held)
        return w.where(enough).select("doc_id", "tkey", "line", "last", F.col("least.h").alias("fp"), F.col("least.line").alias("at"), *(["hs"] if contents else []))

    ahead, behind = of.orderBy("c").rangeBetween(0, min_words - 1), of.orderBy("end").rangeBetween(1 - min_words, 0)
    forward = framed(ahead, F.col("line"), F.max("line").over(ahead), F.col("words") >= min_words)
    # those that are windows from their first line on are there already
    backward = framed(behind, F.min("line").over(behind), F.col("line"), F.col("words") - F.col("n") >= min_words)
    return forward.unionByName(backward)


def _salt(*of: str):
    return F.pmod(F.xxhash64(*of), F.lit(SALTS)).cast("int").alias("salt")


def _all_salts():
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def anchors(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, tkey, at: the fingerprints whose hash has another place."""
    prints = saved(windows(lines, min_words).select("doc_id", "tkey", "at", "fp").distinct(), "line-fingerprints")
    shared = prints.groupBy("fp").count().where("count > 1").select("fp", _all_salts())
    return prints.withColumn("salt", _salt("doc_id", "tkey", "at")).join(shared, ["fp", "salt"], "left_semi").select("doc_id", "tkey", "at")


def repeated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, tkey, line, last: stretches of ``min_words`` words that stood before."""
    lines = saved(line_hashes(docs), "line-hashes")
    found = saved(anchors(lines, min_words), "line-anchors")
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.tkey") == F.col(f"{b}.tkey"))
    near = lines.alias("l").join(found.select("doc_id", "tkey").distinct().alias("f"), same("l", "f"), "left_semi")
    w = windows(near, min_words, contents=True)
    w = w.alias("w").join(found.alias("f"), same("w", "f") & (F.col("w.at") == F.col("f.at")), "left_semi")
    k = F.array_position("hs", F.col("fp")).cast("int")
    left, right = F.xxhash64(F.slice("hs", 1, k - 1)), F.xxhash64(F.slice("hs", k + 1, F.size("hs")))
    w = saved(w.select("doc_id", "tkey", "line", "last", "at", "fp", left.alias("left"), right.alias("right")), "line-extensions")
    place = F.struct("doc_id", "tkey", "at")
    firsts = w.groupBy("fp", "left", "right").agg(F.min(place).alias("first"), F.max(place).alias("end")).where(F.col("first") != F.col("end"))
    firsts = firsts.select("fp", "left", "right", "first", _all_salts())
    met = w.withColumn("salt", _salt("doc_id", "tkey", "at")).join(firsts, ["fp", "left", "right", "salt"])
    return met.where(place != F.col("first")).select("doc_id", "tkey", "line", "last")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text without the repeated runs, n_lines, removed (numbers of the lines
    deleted)."""
    gone = repeated(docs, min_words).distinct().select("doc_id", "tkey", F.explode(F.sequence("line", "last")).alias("line"))
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key")).agg(F.array_sort(F.collect_set("line")).alias("removed"))
    t = _texts(docs).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_key")), "left")
    t = t.withColumn("lines", F.split("text", "\n"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed"), lambda i: F.get("lines", i))
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return t.select("doc_id", text.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    d = dedup_lines(dealt(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return d.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Without windows: all pairs of equal lines, runs of them on the diagonals of two texts.
ORACLE_SQL = rf"""
WITH l0 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l1 AS (SELECT doc_id, i - 1 AS line, ls[i] AS s, len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS n FROM l0, unnest(range(1, len(ls) + 1)) AS u(i)),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM l1 WHERE n > 0),
m AS (SELECT b.doc_id, b.line, b.n, b.k, a.doc_id AS other, b.k - a.k AS shift
      FROM u a JOIN u b ON a.s = b.s AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.k < b.k))),
d AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY k) AS run FROM m),
r AS (SELECT doc_id, min(line) AS line, max(line) AS last FROM d GROUP BY doc_id, other, shift, run HAVING sum(n) >= {MIN_WORDS}),
gone AS (SELECT DISTINCT doc_id, p AS line FROM r, unnest(range(line, last + 1)) AS v(p)),
kept AS (SELECT doc_id, count(*) AS n_lines, count(gone.line) AS n_removed,
                string_agg(s, chr(10) ORDER BY l1.line) FILTER (gone.line IS NULL) AS text
         FROM l1 LEFT JOIN gone USING (doc_id, line) GROUP BY doc_id)
SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM kept
"""
