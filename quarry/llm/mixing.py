"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words. The whole part of target over source size is certain: every document is taken that
often. For the rest, a share p of the source's words, documents have unequal inclusion probabilities around p that add
up to the remaining words: by ``tilt``, longer documents are likelier (measure: the root of the size). They are ranked by
Pareto's order, random odds u / (1 - u) over inclusion odds, and taken in that order until the remaining words are
filled: the sample's size is fixed in words, not left to chance.

The running total in rank order needs no sort of a whole source. The rank is an integer of 52 bits; sums by its first 12
bits find the bucket where the target falls, which is divided by the next 12 bits in the same way, until it holds a few
hundred documents: only these are put in order. A source with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.storage import Scratch, row_of

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a last bucket holds at most, but for equal ranks, and the bits of a rank and of one division.
BUCKET_ROWS, BITS, DIGIT = 512, 52, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, most: float, scratch: Scratch) -> DataFrame:
    """source, source_size, rows, target. Sources by code point, null last, weigh ``weights`` in turn; together they get
    ``budget`` times all words, none more than ``most`` times its own, and what a source can't take goes to the others."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    order = F.col("source").asc_nulls_last()
    ranged = scratch.store(sums.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("part", before.alias("before"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    table = scratch.store(
        ranged.join(offsets, "part").select(
            "source", "source_size", "rows", weight.cast("double").alias("weight"), (F.col("source_size") * most).alias("cap")
        )
    )
    total, weighed = table.agg(F.sum("source_size"), F.sum("weight")).first()
    level, held = budget * (total or 0) / (weighed or 1), -1
    while True:  # each round caps more sources; most end after two or three
        full = F.col("cap") <= F.col("weight") * level
        n, taken, free = table.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == held or not free:
            break
        level, held = (budget * total - (taken or 0)) / free, n
    return table.select("source", "source_size", "rows", F.least("cap", F.col("weight") * level).alias("target"))


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    named = sources.withColumnRenamed("source", "of")
    return rows.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")


def draw(seed: int) -> Column:
    """A random number of 52 bits: 32 of the id, source and size, 20 of the row's place, which part rows that repeat."""
    content = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("")), F.col("size").cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(content), 1, 8), 16, 10).cast("long") * (1 << 20) + F.pmod(F.xxhash64("row"), F.lit(1 << 20))


def ranked(rows: DataFrame, sources: DataFrame, tilt: float) -> DataFrame:
    """rows (source, size, draw) with ``inclusion`` and ``rank``, Pareto's order as an integer of 52 bits."""
    p, measure = F.col("p"), F.floor(F.sqrt("size"))
    lean = F.when(F.col("span") > 0, F.lit(tilt) * F.least(p, 1 - p) * (measure - F.col("mean")) / F.col("span")).otherwise(0.0)
    u, own = (F.col("draw") + 0.5) / float(1 << BITS), F.col("inclusion")
    odds = u * (1 - own) / ((1 - u) * own) * (p / (1 - p))  # over the source's own odds, so that ranks are spread evenly
    rank = F.floor(odds / (1 + odds) * float(1 << BITS))
    out = _with_sources(rows, sources).withColumn("inclusion", F.when(F.col("size") > 0, p + lean).otherwise(0.0))
    return out.withColumn("rank", F.when((p > 0) & (F.col("size") > 0), rank).otherwise(0).cast("long"))


def _last_buckets(keyed: DataFrame, sources: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """source, bucket, room: the first bits of the rank at which a source's remaining words run out, and the words left
    there; and how many bits the bucket lacks."""
    found, shift = sources.where("left > 0").select("source", F.lit(0).cast("long").alias("bucket"), F.col("left").alias("room")), BITS
    while True:
        inside = _with_sources(keyed, found).where(F.shiftright("rank", shift) == F.col("bucket"))
        shift = max(0, shift - DIGIT)
        sums = inside.groupBy("source", "room", F.shiftright("rank", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))  # at most 2 ** DIGIT rows
        over = sums.withColumn("upto", upto).where("upto > room")
        first = over.groupBy("source").agg(F.min(F.struct("bucket", (F.col("room") - F.col("upto") + F.col("words")).alias("room"), "rows")).alias("at"))
        found = scratch.store(first.select("source", "at.*"))
        if not shift or (found.agg(F.max("rows")).first()[0] or 0) <= BUCKET_ROWS:
            return found.select("source", "bucket", "room"), shift


def pareto_mix(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), budget: float = 1.5, most: float = 2.0, seed: int = 20, tilt: float = 0.5, carry: bool = False
) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, copies, taken, inclusion.

    ``copies`` says how often the mix holds the document, ``taken`` its words times that; ``inclusion`` is the chance of
    one copy beyond the certain ones. The document at which a source's words run out is taken if that brings the total
    closer to the target. A null text has no words and is never taken beyond its certain copies; a null source is a
    source of its own, ranked last. Draws are a hash of doc_id, source, size and ``seed``: reruns agree, and rows that
    are equal in these are told apart by their place in the table. ``tilt``, between -1 and 1, makes longer documents
    likelier, shorter ones, or (0) none. An empty table gives an empty result; other columns are ignored, whatever their
    names. ``carry`` adds ``doc``, a struct of the row.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    own = [row_of(docs)] if carry else []
    read = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row"), *own)
    sized = scratch.store(read.withColumn("draw", draw(seed)))
    targets = source_targets(sized, weights, budget, most, scratch)
    measure = F.floor(F.sqrt("size"))
    spread = sized.where("size > 0").groupBy("source").agg((F.sum(measure * F.col("size")) / F.sum("size")).alias("mean"), F.min(measure).alias("lo"), F.max(measure).alias("hi"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = spread.withColumnRenamed("source", "of")
    sources = scratch.store(
        targets.join(named, F.col("source").eqNullSafe(F.col("of")), "left").select(
            "source", "source_size", "target", F.floor(ratio).alias("certain"), (ratio - F.floor(ratio)).alias("p"),
            (F.col("target") - F.floor(ratio) * F.col("source_size")).alias("left"), "mean", F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo")).alias("span"),
        )
    )
    odds = sources.select("source", "p", "mean", "span")
    keyed = ranked(sized.select("source", "size", "draw", "row"), odds, tilt).where("size > 0 AND p > 0").select("source", "size", "rank", "row")
    buckets, shift = _last_buckets(keyed, sources, scratch)
    line = _with_sources(keyed, buckets).where(F.shiftright("rank", shift) == F.col("bucket")).groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("rank", "row", "size"))).alias("line"), F.first("bucket").alias("bucket"), F.first("room").alias("room")
    )
    # In rank order to where the words run out; the last one if that brings the total closer.
    start = F.struct(F.col("room"), F.shiftleft("bucket", shift).alias("rank"), F.lit(-1).cast("long").alias("row"), F.lit(False).alias("full"))

    def take(acc: Column, x: Column) -> Column:
        fits = x["size"] <= acc["room"]
        taken = F.struct((acc["room"] - x["size"]).alias("room"), x["rank"].alias("rank"), x["row"].alias("row"), (~fits).alias("full"))
        return F.when(acc["full"], acc).when(fits | (x["size"] - acc["room"] < acc["room"]), taken).otherwise(acc.withField("full", F.lit(True)))

    ends = scratch.store(line.select("source", F.aggregate("line", start, take).alias("end")).select("source", F.col("end.rank").alias("end_rank"), F.col("end.row").alias("end_row")))
    of = ends.withColumnRenamed("source", "of")
    plan = scratch.store(sources.join(of, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"))
    scratch.keep(sized, plan)
    full = ranked(sized, plan, tilt)
    drawn = (F.col("size") > 0) & ((F.col("rank") < F.col("end_rank")) | ((F.col("rank") == F.col("end_rank")) & (F.col("row") <= F.col("end_row"))))
    copies = (F.col("certain") + F.when(drawn, 1).otherwise(0)).cast("long")
    return full.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "inclusion", *(["doc"] if carry else []))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as ``pareto_mix`` takes it, with their columns. Nulls, rows that
    repeat, odd names and empty tables are as there."""
    taken = pareto_mix(docs, carry=True, **options).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


#: The same mix, ranked as a whole: only rows that repeat in full may change places.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, coalesce(sum(floor(sqrt(size))::BIGINT * size) / nullif(sum(size), 0), 0)::DOUBLE AS mean,
  min(floor(sqrt(size))) FILTER (WHERE size > 0) AS lo, max(floor(sqrt(size))) FILTER (WHERE size > 0) AS hi FROM d GROUP BY source),
weighed AS (SELECT *, source_size * 2.0::DOUBLE AS cap, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM sums),
stairs AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT *, least(cap, weight * coalesce((SELECT min_by(level, cap / weight) FROM stairs WHERE cap > weight * level), 0)) AS target FROM stairs),
shares AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM targets),
s AS (SELECT *, floor(ratio) AS certain, ratio - floor(ratio) AS p, target - floor(ratio) * source_size AS room, greatest(hi - mean, mean - lo) AS span FROM shares),
chances AS (SELECT doc_id, d.source, size, source_size, target, certain, p, room, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(d.source, '') || ':' || size || ':20'), 1, 8))::BIGINT AS draw,
  CASE WHEN size = 0 THEN 0 WHEN span > 0 THEN p + 0.5::DOUBLE * least(p, 1 - p) * (floor(sqrt(size)) - mean) / span ELSE p END::DOUBLE AS inclusion FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
odds AS (SELECT *, (draw * 1048576 + 0.5::DOUBLE) / 4503599627370496 AS u FROM chances),
ranks AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN u * (1 - inclusion) / ((1 - u) * inclusion) * (p / (1 - p)) ELSE 0 END AS q FROM odds),
upto AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM ranks)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken, inclusion
FROM (SELECT *, (certain + CASE WHEN size > 0 AND p > 0 AND (upto <= room OR (upto - size < room AND upto - room < room - (upto - size))) THEN 1 ELSE 0 END)::BIGINT AS copies FROM upto)
"""
