"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents are shuffled by a seeded hash and laid end to end as one
stream of words, which is cut into blocks of equally many words.  Slot ``j`` of the
schedule is the point ``frac(j * golden ratio)`` on the line of cumulative target
shares; the source whose interval holds the point owns the slot, and the r-th slot
of a source takes block ``r mod n_blocks`` of its stream.  Because golden-ratio
points are spread evenly in every prefix, each stretch of the schedule has the
target proportions.

Blocks are too coarse for a source that is small beside the others: its slots are few, or
none, and its last block is cut short.  A source that the schedule leaves more than
``NEAR`` of its target away from it is settled instead: all its words are taken as often
as fits into the target, and the first words of its stream once more, up to the target
exactly.

Nothing is gathered per source in one task: positions in a stream and ranks of
slots are sums in two levels, within hash (or slot) ranges and over the ranges.  The
targets themselves are found over one row a source, in one task: sources are thought of as
collections, of which there may be many thousands, not as a web host each.

Defined cases: a null or blank text has size 0 and is never taken; a null source is
a source of its own, last in order; equal rows are separate documents; an empty
table gives an empty result; further columns are ignored by :func:`mix` and kept by
:func:`mixed_documents`.  The order of documents depends on (seed, doc_id, text)
alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rows import packed, unpacked
from .store import saved

WEIGHTS = (5, 2, 1)
GOLDEN = 0.6180339887498949
#: Hex digits of the hash that make a range of a stream; slots of a range of the schedule;
#: cells of the unit interval.
RANGE_DIGITS, SLOT_RANGE, CELLS = 3, 65536, 1024
SEED = "20241"
#: The share of its target by which the words of a source may miss it.
NEAR = 0.02
#: Above this many sources their table is joined by shuffle, not broadcast.
BROADCAST_SOURCES = 10_000


def _place(of: str = ""):
    """The seeded order of documents: a hash of seed, doc_id and text."""
    name = F.coalesce(F.col(f"{of}doc_id").cast("string"), F.lit(""))
    return F.md5(F.concat_ws(" ", F.lit(SEED), name, F.coalesce(F.col(f"{of}text"), F.lit(""))).cast("binary"))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (white-space separated words) and place, the seeded order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    squeezed = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    size = F.when(squeezed == "", 0).otherwise(F.length(squeezed) - F.length(F.regexp_replace(squeezed, " ", "")) + 1)
    return docs.select("doc_id", "source", size.cast("long").alias("size"), _place().alias("place"))


def targets(sized: DataFrame, share: float = 1.5, passes: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sid, source, source_size, target: weights cycle over the sources in code-point
    order, a target stops at ``passes`` times the source's size, and what is cut off is
    shared again by weight.  The fixed point is found by levels: with sources ordered by
    the level cap / weight at which they fill, a source is full if the level that would
    use up the budget at its turn is not below its own."""
    by = W.orderBy(F.col("source").isNull(), "source")
    level = W.orderBy("full_at", "sid")
    before = level.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    t = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("sid", F.row_number().over(by) - 1)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    t = t.withColumn("w", w).withColumn("cap", passes * F.col("source_size").cast("double"))
    t = t.withColumn("full_at", F.col("cap") / F.col("w")).withColumn("budget", share * F.sum("source_size").over(every))
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    w_left = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    t = t.withColumn("level", left / w_left).withColumn("full", F.col("full_at") <= F.col("level"))
    rest = F.min(F.when(~F.col("full"), F.struct("full_at", "sid", "level"))).over(every)["level"]
    t = t.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(rest * F.col("w")))
    return t.select("sid", "source", "source_size", "target")


def block_words(total: int, n_sources: int) -> int:
    """Words of a block: a thousandth of the mean source, 2048 at most."""
    return max(1, min(2048, total // max(1, 1000 * n_sources)))


def schedule(spark, shares: DataFrame, block: int, n_slots: int) -> DataFrame:
    """slot, sid, rank: the owner of every slot and its rank among the owner's slots."""
    cum = F.sum("target").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0))
    own = shares.withColumn("hi", cum / F.sum("target").over(W.partitionBy()))
    own = own.withColumn("lo", F.lag("hi", 1, 0.0).over(W.orderBy("sid"))).where("hi > lo")
    own = own.withColumn("hi", F.when(F.col("hi") >= F.max("hi").over(W.partitionBy()), 2.0).otherwise(F.col("hi")))
    last = F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1))
    cells = own.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), last)).alias("cell"))
    slots = spark.range(n_slots).withColumnRenamed("id", "slot")
    turn = (F.col("slot") + 1) * F.lit(GOLDEN)
    slots = slots.withColumn("u", turn - F.floor(turn)).withColumn("cell", F.floor(F.col("u") * CELLS))
    owned = slots.join(cells, "cell").where("u >= lo and u < hi").select("slot", "sid", F.floor(F.col("slot") / SLOT_RANGE).alias("part"))
    owned = owned.withColumn("in_part", F.row_number().over(W.partitionBy("sid", "part").orderBy("slot")) - 1)
    parts = owned.groupBy("sid", "part").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(W.partitionBy("sid").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("sid", "part", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    return owned.join(parts, ["sid", "part"]).select("slot", "sid", (F.col("ahead") + F.col("in_part")).alias("rank"))


def mix(docs: DataFrame, share: float = 1.5, passes: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, place, size, source_size, target, taken (words the mix takes)."""
    spark = docs.sparkSession
    sized = saved(sizes(docs), "mix-sizes")
    t = saved(targets(sized, share, passes, weights), "mix-targets")
    total, n_sources = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    block = block_words(total, n_sources)
    few = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda x: x)
    sized = sized.join(few(t.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).drop("of")

    # places in the streams, in two levels
    sized = sized.withColumn("range", F.left("place", F.lit(RANGE_DIGITS)))
    sums = sized.groupBy("sid", "range").agg(F.sum("size").alias("n"))
    ahead = F.sum("n").over(W.partitionBy("sid").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("sid", "range", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    within = F.sum("size").over(W.partitionBy("sid", "range").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1))
    placed = sized.withColumn("start", F.coalesce(within, F.lit(0))).join(sums, ["sid", "range"])
    placed = saved(placed.withColumn("start", F.col("start") + F.col("ahead")).drop("ahead", "range"), "mix-places")

    n_slots = -(-int(share * total) // block)
    n_blocks = F.ceil(F.col("source_size") / block)
    ranked = schedule(spark, t, block, n_slots).join(few(t.select("sid", "source_size")), "sid")
    ranked = ranked.where(F.col("rank") < passes * n_blocks)
    taken = ranked.groupBy("sid", "source_size", (F.col("rank") % n_blocks).alias("block")).agg(F.count("*").alias("times"))
    taken = saved(taken, "mix-blocks")

    # sources that the schedule leaves far from their targets
    words = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    came = taken.groupBy(F.col("sid").alias("s")).agg(F.sum(words * F.col("times")).alias("came"))
    far = t.join(came, F.col("sid") == F.col("s"), "left").where(F.abs(F.coalesce("came", F.lit(0)) - F.col("target")) > NEAR * F.col("target"))
    far = far.select(F.col("sid").alias("far"), F.round("target").cast("long").alias("due"))

    start, stop = F.col("start"), F.col("start") + F.col("size")
    pieces = placed.where("size > 0").select("sid", "start", "size", F.explode(F.sequence(F.floor(start / block), F.floor((stop - 1) / block))).alias("block"))
    overlap = F.least(stop, (F.col("block") + 1) * block) - F.greatest(start, F.col("block") * block)
    got = pieces.join(taken.drop("source_size"), ["sid", "block"]).groupBy("sid", "start").agg(F.sum(overlap * F.col("times")).alias("got"))
    got = got.select(F.col("sid").alias("s"), F.col("start").alias("at"), "got")
    on = (F.col("sid") == F.col("s")) & (F.col("start") == F.col("at")) & (F.col("size") > 0)
    out = placed.join(got, on, "left").join(few(far), F.col("sid") == F.col("far"), "left")
    times = F.floor(F.col("due") / F.greatest(F.col("source_size"), F.lit(1)))
    more = F.greatest(F.lit(0), F.least(stop, F.col("due") - times * F.col("source_size")) - start)
    words = F.when(F.col("far").isNotNull(), times * F.col("size") + more).otherwise(F.coalesce("got", F.lit(0)))
    return out.select("doc_id", "source", "place", "size", "source_size", "target", words.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The documents of the mix, all columns: one of which no word is taken goes, one
    taken about twice comes twice."""
    m = mix(docs.select("doc_id", "text", "source"), **kw).where("taken > 0")
    copies = F.greatest(F.lit(1), F.round(F.col("taken") / F.col("size")).cast("int"))
    m = m.groupBy(F.col("doc_id").alias("of"), F.col("place").alias("of_place")).agg(F.max(copies).alias("copies"))
    own = packed(docs).select("row", F.col("row.doc_id").alias("doc_id"), _place("row.").alias("place"))
    own = own.join(m, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("place") == F.col("of_place")))
    return unpacked(own.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


_WEIGHTS = ", ".join(f"CAST({w} AS DOUBLE)" for w in WEIGHTS)
ORACLE_SQL = rf"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5(concat_ws(' ', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS place FROM documents),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS sid FROM s GROUP BY source),
w AS (SELECT *, [{_WEIGHTS}][sid % {len(WEIGHTS)} + 1] AS w, 2 * CAST(source_size AS DOUBLE) AS cap FROM g),
l AS (SELECT *, cap / w AS full_at, CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS budget FROM w),
v AS (SELECT *, (budget - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM l
      WINDOW b AS (ORDER BY full_at, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT sid, source, source_size, CASE WHEN full_at <= level THEN cap ELSE w * first_value(CASE WHEN full_at > level THEN level END IGNORE NULLS) OVER (ORDER BY full_at, sid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS target FROM v),
k AS (SELECT greatest(1, least(2048, total // (1000 * n))) AS block, (CAST(floor(CAST(1.5 AS DOUBLE) * total) AS BIGINT)) AS words FROM (SELECT CAST(sum(source_size) AS BIGINT) AS total, count(*) AS n FROM t)),
h AS (SELECT *, sum(target) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(target) OVER () AS hi FROM t),
o AS (SELECT sid, source_size, lag(hi, 1, 0.0) OVER (ORDER BY sid) AS lo, CASE WHEN hi >= max(hi) OVER () THEN 2.0 ELSE hi END AS hi FROM h),
u AS (SELECT j, (j + 1) * CAST({GOLDEN!r} AS DOUBLE) - floor((j + 1) * CAST({GOLDEN!r} AS DOUBLE)) AS u FROM k, unnest(range(0, (words + block - 1) // block)) AS x(j)),
r AS (SELECT sid, (source_size + block - 1) // block AS n_blocks, row_number() OVER (PARTITION BY sid ORDER BY j) - 1 AS rank FROM u JOIN o ON u >= lo AND u < hi AND hi > lo, k),
b AS (SELECT sid, rank % n_blocks AS blk, count(*) AS times FROM r WHERE rank < 2 * n_blocks GROUP BY ALL),
p AS (SELECT doc_id, size, source_size, target, sid, place, coalesce(sum(size) OVER (PARTITION BY sid ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
c AS (SELECT p.sid, p.start, sum((least(p.start + p.size, (x.blk + 1) * block) - greatest(p.start, x.blk * block)) * coalesce(b.times, 0)) AS got
      FROM p, k, unnest(range(CAST(p.start AS BIGINT) // block, (CAST(p.start AS BIGINT) + p.size - 1) // block + 1)) AS x(blk) LEFT JOIN b ON b.sid = p.sid AND b.blk = x.blk WHERE p.size > 0 GROUP BY ALL),
a AS (SELECT sid, sum(got) AS came FROM c GROUP BY sid),
f AS (SELECT sid, CAST(round(target) AS BIGINT) AS due FROM t LEFT JOIN a USING (sid) WHERE abs(coalesce(came, 0) - target) > CAST({NEAR} AS DOUBLE) * target),
z AS (SELECT p.*, got, due, due // greatest(source_size, 1) AS times FROM p LEFT JOIN c ON c.sid = p.sid AND c.start = p.start AND p.size > 0 LEFT JOIN f ON f.sid = p.sid)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN due IS NOT NULL THEN times * size + greatest(0, least(start + size, due - times * source_size) - start) ELSE coalesce(got, 0) END AS BIGINT) AS taken
FROM z
"""
