"""Mixing sources to target weights by systematic sampling, with column expressions only.

The expected copies of a document are its source's target over the source's words. Within a source they are summed up
in a fixed order, one random offset is added, and a document is emitted once for every integer boundary that its
stretch of the sum crosses: floor(before + share + u) - floor(before + u) copies. All documents of a source expect
equally many copies, so the sum before the n-th document is (n - 1) times that number and the position is all there is
to compute. Documents are ordered by size class first; neighbours are then alike and what one takes too much the next
takes too little, which keeps the taken words within about the largest document of the target.

A source of any size is cut into cells (source, size class, one of ``CELLS`` hash values). Positions are counted inside
a cell and shifted by the number of documents in earlier cells, so no task sorts a whole source.

Null and blank texts have size 0. A null source is a source of its own, last in the order. Documents with equal ids are
told apart by their place in the sort only; each gets copies of its own. An empty table gives an empty result.

A text of any length is one document and is counted whole. Other columns travel inside a struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanmill.llm.common import checkpointed, packed, unpacked, words

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
CELLS = 64
SEED = 20240607


def targets(sizes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target of each source from ``sizes`` (source, source_size).

    Sources below their ceiling share what is left in proportion to their weights. With the sources ordered by ceiling
    over weight, those that meet the ceiling come first, so one pass with running sums finds where they end.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    df = sizes.withColumn("weight", F.get(cycle, ((F.row_number().over(by_name) - 1) % len(WEIGHTS)).cast("int")))
    df = df.withColumn("ceiling", (max_copies * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    df = df.withColumns({
        "_total": F.sum(F.col("source_size").cast("double")).over(everything),
        "_weights": F.sum("weight").over(everything),
        "_spent": F.coalesce(F.sum("ceiling").over(before), zero),
        "_passed": F.coalesce(F.sum("weight").over(before), zero),
    })
    df = df.withColumn("_level", (F.col("_total") - F.col("_spent")) / (F.col("_weights") - F.col("_passed")))
    # The first source that stays below its ceiling fixes the level of all that follow.
    df = df.withColumn("_free", F.col("_level") * F.col("weight") <= F.col("ceiling"))
    df = df.withColumn("_settled", F.first(F.when(F.col("_free"), F.col("_level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.select(
        "source", "source_size",
        F.least(F.coalesce(F.col("_settled") * F.col("weight"), F.col("ceiling")), F.col("ceiling")).alias("target"))


def _offset(source: Column, seed: int) -> Column:
    """The random offset of a source, in [0, 1); the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), source), F.lit(1 << 30)) / F.lit(float(1 << 30))


def copies(sized: DataFrame, seed: int = SEED, cells: int = CELLS) -> DataFrame:
    """key, doc_id, source, size, source_size, target, copies from ``sized`` (key, doc_id, source, size).

    ``sized`` is read twice, so it should be a stored or checkpointed table.
    """
    cell = ["source", "size_class", "cell"]
    df = sized.withColumns({
        "size_class": F.floor(4 * F.log2(F.col("size") + 1)).cast("int"),
        "cell": F.pmod(F.xxhash64("doc_id", "key", F.lit(seed)), F.lit(cells)).cast("int"),
    })
    counts = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("cell_size"))
    per_source = targets(counts.groupBy("source").agg(F.sum("cell_size").alias("source_size")))
    earlier = Window.partitionBy("source").orderBy(F.desc("size_class"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        counts.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(per_source.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .select(*[F.col(c).alias(f"_{c}") for c in cell], "shift", "source_size", "target")
    )
    inside = Window.partitionBy(*cell).orderBy(F.desc("size"), F.xxhash64("doc_id", "key", F.lit(seed + 1)), "doc_id", "key")
    placed = df.withColumn("position", F.row_number().over(inside)).join(
        shifts,
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("size_class") == F.col("_size_class")) & (F.col("cell") == F.col("_cell")),
    )
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    last = F.col("shift") + F.col("position")
    u = _offset(F.col("source"), seed)
    taken = F.floor(share * last + u) - F.floor(share * (last - 1) + u)
    return placed.select("key", "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("copies"))


def sized(docs: DataFrame) -> DataFrame:
    """key, doc_id, source, size; the key tells rows with equal ids apart and depends on their content only."""
    return docs.select(
        F.xxhash64("text").alias("key"), "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document."""
    df = copies(checkpointed(sized(docs)), seed)
    return df.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")


def emitted(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, whole and with all columns.

    Rows with equal id, text and source add up their copies and divide them again evenly.
    """
    drawn = copies(checkpointed(sized(docs)), seed).groupBy("key", "doc_id", "source").agg(
        F.sum("copies").alias("total"), F.count(F.lit(1)).alias("rows"))
    drawn = drawn.where("total > 0").select(*[F.col(c).alias(f"_{c}") for c in drawn.columns])
    joined = packed(docs, "doc_id", "text", "source").join(
        drawn,
        F.col("doc_id").eqNullSafe(F.col("_doc_id"))
        & F.xxhash64("text").eqNullSafe(F.col("_key"))
        & F.col("source").eqNullSafe(F.col("_source")),
    ).select("row", "_doc_id", "_key", "_source", "_total", "_rows")
    rank = F.row_number().over(Window.partitionBy("_doc_id", "_key", "_source").orderBy(F.lit(1)))
    single = joined.where("_rows = 1").withColumn("n", F.col("_total"))
    several = joined.where("_rows > 1").withColumn("rank", rank).withColumn(
        "n", F.expr("_total * rank div _rows - _total * (rank - 1) div _rows")).drop("rank")
    rows = single.unionByName(several).where("n > 0")
    return unpacked(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))), docs.columns)
