"""Quality rules: base counts, and distribution divergence from language references.

A document's histogram of character classes and its histogram of common words are
compared with those of each language by the Jensen-Shannon distance (base 2, so 0 to
1); the nearest language counts.  The common words of a language are learned: the ``COMMON``
that stand in most rows labelled with it.  Its reference histograms are sums over all rows labelled with
it that pass the base rule, as texts of one repeated phrase would outweigh the others.  A document is dropped if a distance exceeds its bound.  A text of n
words is by chance about sqrt(b / (8 n ln 2)) away from a distribution over b bins that
it was drawn from, so the bound for words is the larger the shorter the text, and each
comparison is made only from a least length on.

Every label is a language of its own; one of fewer than ``MIN_REFERENCE`` rows, or of none
that passes the base rule, has no reference.  Documents with such a label are in a language that nothing is
known of and are judged by the base rule alone.  Documents without a label are compared
with all references.

Everything is DataFrame operations; one pass over the texts writes the features of
each document, the references are sums over that small table.

Defined cases: a null or blank text has all counts 0 and fails the base rule; a null lang
adds to no reference, a row of a null doc_id to no common words; equal rows each give a row; an empty
table gives an empty result; further columns are ignored.  3-word windows are compared by
64-bit hashes of their words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import dealt, saved

SPACE, BLANKS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT = 50, 50
#: Bounds of the distances (for words that of long texts, and the bins that count for the
#: spread of short ones), and the words and characters from which they apply.
MAX_WORD_DISTANCE, WORD_BINS, MAX_CLASS_DISTANCE = 0.2, 45, 0.32
GUARD_WORDS, GUARD_CHARS = 80, 200
#: Common words of a language, and rows of it they are learned from at least.
COMMON, MIN_REFERENCE = 50, 20
#: Rows of a language they are learned from at most, if that is wanted (chosen by a hash of
#: the id); None: all.  The SQL still has the bound it had, and is equal up to it.
SAMPLE_ROWS: int | None = None
SQL_SAMPLE_ROWS = 4000
#: Successive removals; what is left is the last class.
CLASSES = (("lower", "[a-z]+"), ("space", SPACE), ("upper", "[A-Z]+"), ("symbol", "[#*$%&|<>]+"), ("letter", r"\p{L}+"), ("digit", "[0-9]+"), ("punctuation", r"[\x21-\x7E]+"))


def _array(items) -> Column:
    return F.array(*(F.lit(x) for x in items))


def _words(text: Column) -> Column:
    for blank in BLANKS[1:]:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _repeat_words() -> Column:
    """Words in 3-word windows that occur twice or more: the windows sorted by hash show
    equal neighbours; of the repeated windows in text order each adds the words up to the
    next, three at most."""
    after = lambda a, k: F.coalesce(F.least(F.lit(3), F.get(a, k + 1) - F.get(a, k)), F.lit(3))
    return F.aggregate(F.transform("repeats", lambda _, k: after(F.col("repeats"), k)), F.lit(0), lambda a, x: a + x)


def common_words(docs: DataFrame) -> dict[str, list[str]]:
    """lang -> its most frequent words, for languages that have a reference.  What is
    collected is bounded by the number of languages."""
    own = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r.lang: r["count"] for r in own.groupBy("lang").count().where(F.col("count") >= MIN_REFERENCE).collect()}
    own = own.where(F.col("lang").isin(list(sizes)))
    large = {lang: f"{(SAMPLE_ROWS << 32) // n:08x}" for lang, n in sizes.items() if n > SAMPLE_ROWS} if SAMPLE_ROWS else {}
    if large:
        below = F.create_map(*[F.lit(x) for pair in large.items() for x in pair])[F.col("lang")]
        own = own.where(below.isNull() | (F.left(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(8)) < below))
    words = own.select("lang", F.explode(F.array_distinct(_words(F.coalesce("text", F.lit(""))))).alias("w"))
    counts = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    of = W.partitionBy("lang")
    ranked = counts.select("lang", "w", F.row_number().over(of.orderBy(F.desc("n"), "w")).alias("k"))
    found: dict[str, list[str]] = {}
    for r in ranked.where(F.col("k") <= COMMON).orderBy("lang", "k").collect():
        found.setdefault(r.lang, []).append(r.w)
    return found


def listed_words(common: dict[str, list[str]]) -> list[str]:
    """The common words of all languages; places in it are the numbers of words."""
    return sorted({w for words in common.values() for w in words})


def features(docs: DataFrame, common: dict[str, list[str]]) -> DataFrame:
    """One row a document: base counts, characters by class, and ``common``, number and
    count of each common word of any language."""
    listed = listed_words(common)
    d = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", _words(F.col("text")))
    n = F.size("words")
    three = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    d = d.withColumn("windows", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), three)))
    # most texts repeat none, which needs no order
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("grams", F.when(again, F.sort_array(F.transform("windows", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    near = lambda x, k: (F.get("grams", k - 1)["g"] == x["g"]) | (F.get("grams", k + 1)["g"] == x["g"])
    d = d.withColumn("repeats", F.sort_array(F.transform(F.filter("grams", near), lambda x: x["i"])))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != ""))
    d = d.withColumn("rest_0", F.col("text"))
    for k, (_, pattern) in enumerate(CLASSES):
        d = d.withColumn(f"rest_{k + 1}", F.regexp_replace(f"rest_{k}", pattern, ""))
    parts = [(F.length(f"rest_{k}") - F.length(f"rest_{k + 1}")) for k in range(len(CLASSES))] + [F.length(f"rest_{len(CLASSES)}")]
    d = d.withColumn("known", F.sort_array(F.filter("words", lambda w: w.isin(listed))))
    d = d.withColumn("kinds", F.array_distinct("known"))
    d = d.withColumn("first", F.transform("kinds", lambda w: F.array_position("known", w)))
    count = lambda w, k: F.struct((F.array_position(_array(listed), w) - 1).cast("int").alias("w"), (F.coalesce(F.get("first", k + 1), F.size("known") + F.lit(1)) - F.get("first", k)).cast("long").alias("n"))
    long = lambda c, name: c.cast("long").alias(name)
    return d.select(
        "doc_id", "lang",
        long(n, "n_words"),
        long(F.length("text") - parts[1], "word_chars"),
        long(parts[3], "n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines")), "n_dup_lines"),
        long(F.when(F.size("repeats") > 0, _repeat_words()).otherwise(0), "n_repeat_words"),
        F.array(*(p.cast("long") for p in parts)).alias("classes"),
        F.transform("kinds", count).alias("common"),
    )


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def references(feats: DataFrame, common: dict[str, list[str]]) -> dict[str, tuple[list[float], list[float]]]:
    """lang -> shares of its common words (the rest is other words) and of the classes.
    Two bounded sums: languages times their words, and languages times classes."""
    own = feats.where(F.col("lang").isin(list(common)) & ~_base_failed())
    words = own.select("lang", F.explode("common").alias("x")).groupBy("lang", F.col("x")["w"].alias("w")).agg(F.sum(F.col("x")["n"]).alias("n")).collect()
    sums = own.groupBy("lang").agg(F.sum("n_words").alias("total"), *(F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES) + 1))).collect()
    listed = listed_words(common)
    seen, out = {(r.lang, listed[r.w]): r.n for r in words}, {}
    for r in sorted(sums, key=lambda r: r.lang):
        counts = [r[f"c{k}"] for k in range(len(CLASSES) + 1)]
        out[r.lang] = [seen.get((r.lang, w), 0) / r.total for w in common[r.lang]], [c / sum(counts) for c in counts]
    return out


def _term(p: Column, q: Column) -> Column:
    m = p + q
    return F.when(p > 0, p * F.log(2 * p / m)).otherwise(0.0) + F.when(q > 0, q * F.log(2 * q / m)).otherwise(0.0)


def _distance(total: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / F.lit(2 * 0.6931471805599453))))


def word_distance(shares: dict[str, float], listed: list[str]) -> Column:
    """To the shares of a language's words and of all other words.  Its words that the
    document lacks add their share times ln 2 each, so only those it has are visited."""
    n, of = F.col("n_words").cast("double"), _array([shares.get(w) for w in listed]).cast("array<double>")
    own = F.transform("common", lambda x: F.struct((x["n"] / n).alias("p"), F.get(of, x["w"]).alias("q")))
    own = F.filter(own, lambda x: x["q"].isNotNull())
    init = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    step = lambda a, x: F.struct((a["s"] + _term(x["p"], x["q"])).alias("s"), (a["p"] + x["p"]).alias("p"), (a["q"] + x["q"]).alias("q"))
    whole = float(sum(shares.values()))
    finish = lambda a: a["s"] + (F.lit(whole) - a["q"]) * F.lit(0.6931471805599453) + _term(1 - a["p"], F.lit(1 - whole))
    return _distance(F.aggregate(own, init, step, finish))


def class_distance(shares: list[float]) -> Column:
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x).cast("double")
    return _distance(sum(_term(F.get("classes", F.lit(k)) / chars, F.lit(q)) for k, q in enumerate(shares)))


def _least(distances: list[Column]) -> Column:
    return F.least(*distances, *distances[:1]) if distances else F.lit(None).cast("double")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, word_distance, class_distance (null
    where the text is too short to compare, or nothing is known of its language)."""
    common = common_words(docs)
    feats = saved(features(docs, common), "quality-features")
    refs = references(feats, common)
    known = F.col("lang").isNull() | F.col("lang").isin(list(refs))
    words = _least([word_distance(dict(zip(common[lang], w, strict=True)), listed_words(common)) for lang, (w, _) in refs.items()])
    classes = _least([class_distance(c) for _, c in refs.values()])
    d = feats.withColumn("word_distance", F.when(known & (F.col("n_words") >= GUARD_WORDS), words))
    d = d.withColumn("class_distance", F.when(known & (F.col("word_chars") >= GUARD_CHARS), classes))
    bound = F.sqrt(F.lit(MAX_WORD_DISTANCE**2) + F.lit(WORD_BINS / (8 * math.log(2))) / F.col("n_words"))
    far = F.coalesce(F.col("word_distance") > bound, F.lit(False)) | (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE)
    d = d.withColumn("base_failed", _base_failed()).withColumn("kept", ~F.col("base_failed") & ~far)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "word_distance", "class_distance")


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("word_distance", "class_distance")


def _oracle() -> str:
    """The same rules in SQL: one histogram per document and language, distances over all
    listed words, the absent ones included."""
    removed = "text"
    classes = []
    for _, pattern in CLASSES:
        rest = f"regexp_replace({removed}, '{pattern}', '', 'g')"
        classes.append(f"length({removed}) - length({rest})")
        removed = rest
    classes.append(f"length({removed})")
    term = "(CASE WHEN {p} > 0 THEN {p} * ln(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * ln(2 * {q} / ({p} + {q})) ELSE 0 END)"
    dist = "sqrt(greatest(0.0, least(1.0, ({}) / (2 * ln(2.0)))))"
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w0 AS (SELECT doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
       list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
       [{", ".join(classes)}] AS c FROM t),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM w0, unnest(range(1, len(w) - 1)) AS u(i)),
g2 AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM g2, unnest(range(i, i + 3)) AS u(p) GROUP BY doc_id),
f AS (SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, c FROM w0 LEFT JOIN rep USING (doc_id)),
sz AS (SELECT lang, count(*) AS n FROM t WHERE lang IS NOT NULL AND doc_id IS NOT NULL GROUP BY lang HAVING count(*) >= {MIN_REFERENCE}),
sm AS (SELECT lang, unnest(list_distinct(w)) AS word FROM w0 JOIN sz USING (lang)
       WHERE doc_id IS NOT NULL AND (n <= {SQL_SAMPLE_ROWS} OR left(md5(CAST(doc_id AS VARCHAR)), 8) < printf('%08x', CAST({SQL_SAMPLE_ROWS << 32} // n AS BIGINT)))),
sc AS (SELECT lang, word, count(*) AS n FROM sm GROUP BY ALL),
l AS (SELECT lang AS ref, word FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM sc) WHERE k <= {COMMON}),
fp AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM f),
wc AS (SELECT doc_id, lang, word, count(*) AS n FROM (SELECT doc_id, lang, unnest(w) AS word FROM w0) WHERE word IN (SELECT word FROM l) GROUP BY ALL),
tot AS (SELECT lang AS ref, sum(n_words) AS total FROM fp WHERE NOT base_failed GROUP BY lang),
q AS (SELECT ref, word, coalesce(n, 0) / CAST(total AS DOUBLE) AS q FROM l JOIN tot USING (ref) LEFT JOIN (SELECT wc.lang AS ref, word, sum(n) AS n FROM wc JOIN fp USING (doc_id) WHERE NOT base_failed GROUP BY ALL) USING (ref, word)),
k AS (SELECT * FROM fp WHERE lang IS NULL OR lang IN (SELECT ref FROM q)),
dw AS (SELECT k.doc_id, q.ref, coalesce(wc.n, 0) / CAST(k.n_words AS DOUBLE) AS p, q.q AS q FROM k CROSS JOIN q LEFT JOIN wc ON wc.doc_id = k.doc_id AND wc.word = q.word WHERE k.n_words >= {GUARD_WORDS}),
ds AS (SELECT doc_id, ref, sum({term.format(p="p", q="q")}) AS s, greatest(1 - sum(p), 0) AS p, greatest(1 - sum(q), 0) AS q FROM dw GROUP BY ALL),
wd AS (SELECT doc_id, min({dist.format("s + " + term.format(p="p", q="q"))}) AS word_distance FROM ds GROUP BY doc_id),
cc AS (SELECT lang AS ref, unnest(range(1, {len(CLASSES) + 2})) AS k, unnest(c) AS n FROM fp WHERE NOT base_failed AND lang IN (SELECT ref FROM l)),
cq AS (SELECT ref, k, sum(n) / CAST(sum(sum(n)) OVER (PARTITION BY ref) AS DOUBLE) AS q FROM cc GROUP BY ref, k),
cd AS (SELECT doc_id, min(d) AS class_distance FROM (SELECT doc_id, ref, {dist.format("sum(" + term.format(p="p", q="q") + ")")} AS d
      FROM (SELECT doc_id, ref, c[cq.k] / CAST(list_sum(c) AS DOUBLE) AS p, q FROM k CROSS JOIN cq WHERE word_chars >= {GUARD_CHARS}) GROUP BY doc_id, ref) GROUP BY doc_id),
r AS (SELECT * FROM fp LEFT JOIN wd USING (doc_id) LEFT JOIN cd USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (coalesce(word_distance > sqrt({MAX_WORD_DISTANCE**2!r} + {WORD_BINS / (8 * math.log(2))!r} / n_words), false) OR coalesce(class_distance, 0) > {MAX_CLASS_DISTANCE}) AS kept
FROM r
"""


ORACLE_SQL = _oracle()
