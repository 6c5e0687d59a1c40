"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a keyed hash and queued, up to EPOCHS times over. A document's
virtual finish time is its source's cumulative words divided by its source's target. All sources'
queues are merged by a global range sort on finish time and truncated where the words reach the total
budget. Sums along an order are made range by range, so one huge source, or a million equal rows, are never in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlake.llm.shared import WORD, materialize, table, unused
from mixlake.operators.ordering import running_sums

EPOCHS = 3
WEIGHTS = (5.0, 2.0, 1.0)
#: Equal rows that one task numbers.
COPIES = 4096


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, rank, source_size, before, target) from (source, size); before: the words of the sources of smaller ranks.

    Sources by code point, null last, take `weights` in turn and share all words by weight. A target
    stops at `epochs` times its source's size and its excess goes to the others by weight: in order of
    size per weight, sources are full up to the first that isn't at the water level that remains.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = running_sums(one, [F.col("source").isNull(), F.col("source")], {"rank": F.lit(1), "upto": "source_size"})
    one = one.select("source", "source_size", (F.col("rank") - 1).alias("rank"), (F.col("upto") - F.col("source_size")).alias("before"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    one = one.withColumns({"w": weight, "cap": F.lit(float(epochs)) * F.col("source_size")})
    total, all_weights = one.agg(F.sum("source_size"), F.sum("w")).first()
    one = running_sums(one, [F.col("cap") / F.col("w"), F.col("rank")], {"place": F.lit(1), "caps": "cap", "ws": "w"})
    level = F.try_divide(F.lit(float(total or 0)) - F.col("caps") + F.col("cap"), F.lit(float(all_weights or 0)) - F.col("ws") + F.col("w"))
    found = one.where(F.col("cap") > F.col("w") * level).agg(F.min(F.struct("place", level.alias("level"))).alias("x")).first()
    water = F.lit(found.x.level if found.x else None).cast("double")
    return one.select("source", "rank", "source_size", "before", F.coalesce(F.least("cap", F.col("w") * water), F.col("cap")).alias("target"))


def queue(sizes: DataFrame, goals: DataFrame, seed: int = 0) -> DataFrame:
    """sizes (doc_id, source, size) with copy, rank, source_size, target, h and `done`: its source's words up to and with it, in shuffled order.

    Equal rows are told apart by `copy`, which counts them from 0: a sum by partial aggregates, then numbered in portions.
    """
    same = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_n"))
    portions = same.withColumn("_portion", F.explode(F.expr(f"sequence(0L, (_n - 1) div {COPIES})")))
    many = portions.where(f"_n > {COPIES}").repartition("doc_id", "source", "size", "_portion").unionByName(portions.where(f"_n <= {COPIES}"))
    copies = many.withColumn("copy", F.explode(F.expr(f"sequence(_portion * {COPIES}, least(_n, (_portion + 1) * {COPIES}) - 1)"))).drop("_n", "_portion")
    key = F.concat_ws(" ", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "size", "copy")
    goals = goals.withColumnRenamed("source", "_source")
    dealt = copies.withColumn("h", F.md5(key.cast("binary"))).join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    summed = running_sums(dealt, ["rank", "h", "doc_id", "size", "copy"], {"done": "size"})
    return summed.withColumn("done", F.col("done") - F.col("before")).drop("before")


def merged(queued: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """All entries of the queues in the order of their finish times: doc_id, rank, size, copy, v, and spent, the words up to and with each."""
    times = F.array(*(F.try_divide((F.lit(e) * F.col("source_size") + F.col("done")).cast("double"), F.col("target")) for e in range(epochs)))
    entries = queued.select("doc_id", "rank", "size", "copy", "h", F.explode(times).alias("v"))
    return running_sums(entries, ["v", "rank", "h", "doc_id", "copy"], {"spent": "size"})


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, times, taken, source, copy.

    size counts words (null text: 0); copy numbers the rows that agree in doc_id, source and size, from 0; times says how often the mix takes the document, at most
    `epochs`; taken is size times that. Null sources are one source, sorted last. Repeated rows queue
    each; the order depends on values only, so reruns agree whatever the partitions. Empty
    documents have no words to take and are taken 0 times. Other columns are left out,
    whatever their names. An empty table gives an empty one.
    """
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = materialize(sizes, "sizes")
    goals = materialize(targets(sizes, weights, epochs), "targets")
    queued = queue(sizes, goals, seed)
    budget = sizes.agg(F.sum("size")).first()[0] or 0
    in_time = F.count_if((F.col("spent") <= budget) & (F.col("size") > 0)).cast("int")
    times = merged(queued, epochs).groupBy("doc_id", "rank", "size", "copy").agg(in_time.alias("times"))
    goals = goals.withColumnRenamed("rank", "_rank")
    return times.join(goals, F.col("rank") == F.col("_rank")).select("doc_id", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"), "source", "copy")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, also rows without doc_id.

    Rows that agree in doc_id, source and size are numbered range by range, and take the turns of the queue's copies of their
    numbers: which of them comes first is open, as the queue doesn't tell them apart, but their turns add up to the plan's.
    docs are written once with a number for each row, so that numbers stay; texts are shuffled once.
    """
    row, times, size = unused(docs, "_row"), unused(docs, "_times"), unused(docs, "_size")
    rows = materialize(docs.withColumns({row: F.monotonically_increasing_id(), size: F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")}), "numbered", codec="zstd")
    light = rows.select(F.col(row).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(size).alias("size"))
    own = running_sums(light, ["row"], {"copy": F.lit(1)}, ["doc_id", "source", "size"]).withColumn("copy", F.col("copy") - 1)
    key = F.xxhash64("doc_id", "source", "size", "copy").alias("key")
    plan = mix(docs, doc_id, source, text, **options).where(F.col("times") > 0)
    plan = plan.select(key, *(F.col(c).alias(f"plan_{c}") for c in ("doc_id", "source", "size", "copy")), F.col("times").alias(times))
    same = [F.col(c).eqNullSafe(F.col(f"plan_{c}")) for c in ("doc_id", "source", "size", "copy")]
    own = own.select(key.alias("own_key"), "row", "doc_id", "source", "size", "copy")
    # one plan at every size: all sides have a row for each document
    turns = own.join(plan.hint("merge"), (F.col("own_key") == F.col("key")) & same[0] & same[1] & same[2] & same[3]).select(F.col("row").alias("turn_row"), times)
    both = rows.join(turns.hint("merge"), F.col(row) == F.col("turn_row"))
    return both.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(rows[c] for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


#: The same in DuckDB's SQL. Equal rows are numbered in any order, as they are alike.
SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
one AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
capped AS (SELECT *, CAST([5, 2, 1][CAST(rank % 3 + 1 AS INT)] AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM one),
levels AS (SELECT *, row_number() OVER o AS place, ((SELECT sum(source_size) FROM one) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM capped WINDOW o AS (ORDER BY cap / w, rank)),
goals AS (SELECT source, rank, source_size, coalesce(least(cap, w * (SELECT arg_min(level, place) FROM levels WHERE cap > w * level)), cap) AS target FROM levels),
copied AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy FROM sized),
hashed AS (SELECT *, md5(concat_ws(' ', 0, coalesce(CAST(doc_id AS VARCHAR), '-'), size, copy)) AS h FROM copied),
queued AS (SELECT c.*, g.rank, g.source_size, g.target, sum(c.size) OVER (PARTITION BY g.rank ORDER BY h, doc_id, size, copy ROWS UNBOUNDED PRECEDING) AS done FROM hashed c JOIN goals g ON c.source IS NOT DISTINCT FROM g.source),
entries AS (SELECT q.*, CASE WHEN target > 0 THEN CAST(e * source_size + done AS DOUBLE) / target END AS v FROM queued q, (SELECT unnest([0, 1, 2]) AS e)),
merged AS (SELECT *, sum(size) OVER (ORDER BY v NULLS FIRST, rank, h, doc_id, copy ROWS UNBOUNDED PRECEDING) AS spent FROM entries)
SELECT doc_id, size, source_size, target, CAST(size * count(*) FILTER (WHERE size > 0 AND spent <= (SELECT sum(size) FROM sized)) AS BIGINT) AS taken
FROM merged GROUP BY doc_id, rank, size, copy, source_size, target
"""
