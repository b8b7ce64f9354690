"""Ordered computations that never sort a whole group in one task.

Input rows carry an order column, unique inside its group: a number, or a struct where several columns decide. A group
with more than a block's rows is *hot* and is cut into blocks at quantiles of its order column, estimated from a sample
chosen by hash; how dense or sparse the values are does not matter. Each helper works inside the blocks first, then carries
one summary row per block across the group, and adds the two.

A block has about ``block_rows`` rows, or 1 / ``MAX_BLOCKS`` of all rows if that is more. There are thus at most
2 * ``MAX_BLOCKS`` cuts and summaries over all groups together, whatever the size of the table, and both are broadcast for
that reason. Whether a table has hot groups at all is asked beforehand, by one aggregation over the group and nothing else:
where it has none, the plan is a plain window, and helpers can be stacked without their plans growing out of bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 16
MAX_BLOCKS = 8192
SAMPLES = 16  # expected sampled rows per block
FAN = 96  # cuts looked at in one step of the search for a row's block
BLOCK = "_block"


def find_cuts(df: DataFrame, group: list[str], seq: str, block_rows: int = BLOCK_ROWS) -> DataFrame | None:
    """The hot groups with ``_cuts``, the first order values of their blocks but the first block's; none if none is hot."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    facts = sizes.agg(F.max("_rows").alias("most"), F.sum("_rows").alias("total")).first()
    if facts.most is None or facts.most <= block_rows:
        return None
    size = max(block_rows, -(-facts.total // MAX_BLOCKS))
    hot = F.broadcast(sizes.where(F.col("_rows") > size))
    stride = max(1, size // SAMPLES)
    sampled = df.select(*group, F.col(seq).alias("_at")).join(hot, group).where(F.pmod(F.xxhash64("_at"), F.lit(stride)) == 0)
    found = sampled.groupBy(*group).agg(
        F.sort_array(F.collect_list("_at")).alias("_sample"), F.max(F.ceil(F.col("_rows") / F.lit(size))).alias("_blocks"))
    cuts = F.expr("transform(sequence(1, _blocks - 1), i -> _sample[cast(i * size(_sample) div _blocks as int)])")
    few = found.where("size(_sample) > 0 and _blocks > 1").select(*group, cuts.alias("_cuts"))
    return df.sparkSession.createDataFrame(few.collect(), few.schema)


def _block_of(seq: str) -> tuple[Column, Column]:
    """How many of ``_cuts`` are not above the row's order value; and before that, how many whole stretches of cuts are not."""
    passed = f"size(filter(transform(sequence(1, size(_cuts) div {FAN}), i -> _cuts[cast(i * {FAN} - 1 as int)]), c -> c <= `{seq}`))"
    passed = f"case when size(_cuts) < {FAN} then 0 else {passed} end"
    inside = f"size(filter(slice(_cuts, _passed * {FAN} + 1, {FAN}), c -> c <= `{seq}`))"
    return F.expr(f"_passed * {FAN} + {inside}"), F.expr(passed)


def with_block(df: DataFrame, group: list[str], seq: str, cuts: DataFrame, hot_only: bool = False) -> DataFrame:
    """``df`` with the block of each row, 0 in groups that are not hot (or without those)."""
    block, passed = _block_of(seq)
    joined = df.join(F.broadcast(cuts), group, "inner" if hot_only else "left").withColumn("_passed", passed)
    return joined.withColumn(BLOCK, F.when(F.col("_cuts").isNull(), 0).otherwise(block)).select(*df.columns, BLOCK)


def _carried(df: DataFrame, group: list[str], seq: str, cuts: DataFrame, summary: Column, carry: Column) -> DataFrame:
    """Group, block and ``_carry`` of the blocks of hot groups; ``carry`` is made of each block's ``summary``, ``_n``."""
    cells = with_block(df, group, seq, cuts, hot_only=True)
    return F.broadcast(cells.groupBy(*group, BLOCK).agg(summary.alias("_n")).select(*group, BLOCK, carry.alias("_carry")))


def _added(local: DataFrame, carry: DataFrame, keys: list[str], out: str) -> DataFrame:
    joined = local.join(carry, keys, "left")
    kept = [c for c in local.columns if c not in (BLOCK, out)]
    return joined.select(*kept, (F.col(out) + F.coalesce("_carry", F.lit(0))).alias(out))


def numbered(
    df: DataFrame, group: list[str], seq: str, out: str, block_rows: int = BLOCK_ROWS, among: DataFrame | None = None
) -> DataFrame:
    """Add ``out``: the 1-based rank of each row by ``seq`` inside its group.

    ``among`` holds group and ``seq`` of all rows that can be in a large group, and maybe of more; where ``df`` is costly and
    these are not, hot groups are asked for there.
    """
    cuts = find_cuts(df if among is None else among, group, seq, block_rows)
    if cuts is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(seq)))
    keys = [*group, BLOCK]
    cells = with_block(df, group, seq, cuts)
    local = cells.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(seq)))
    earlier = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = _carried(df.select(*group, seq), group, seq, cuts, F.count(F.lit(1)), F.sum("_n").over(earlier))
    return _added(local, carry, keys, out)


def ranked_by_score(
    df: DataFrame, group: list[str], score: Column, seq: str, out: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``out``: the 1-based rank by score descending (not a number first, null last), then ``seq``, inside each group."""
    order = F.struct(score.isNull(), ~F.isnan(score), -score, F.col(seq))
    return numbered(df.withColumn("_order", order), group, "_order", out, block_rows).drop("_order")


def running_sum(
    df: DataFrame,
    group: list[str],
    seq: str,
    value: Column,
    out: str,
    inclusive: bool = True,
    newest_first: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows up to this one (or strictly before it)."""
    keys, by, last = [*group, BLOCK], F.desc if newest_first else F.asc, 0 if inclusive else -1
    valued, cuts = df.withColumn("_value", value), find_cuts(df, group, seq, block_rows)

    def summed(rows: DataFrame, inside: list[str]) -> DataFrame:
        window = Window.partitionBy(*inside).orderBy(by(seq)).rowsBetween(Window.unboundedPreceding, last)
        return rows.withColumn(out, F.coalesce(F.sum("_value").over(window), F.lit(0))).drop("_value")

    if cuts is None:
        return summed(valued, group)
    outer = Window.partitionBy(*group).orderBy(by(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    local = summed(with_block(valued, group, seq, cuts), keys)
    carry = _carried(valued.select(*group, seq, "_value"), group, seq, cuts, F.sum("_value"), F.sum("_n").over(outer))
    return _added(local, carry, keys, out)


def prior_max(
    df: DataFrame, group: list[str], seq: str, value: Column, out: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``out``: the largest ``value`` of the rows strictly before this one, null for the first."""
    keys = [*group, BLOCK]
    valued, cuts = df.withColumn("_value", value), find_cuts(df, group, seq, block_rows)

    def highest(inside: list[str]) -> Column:
        return F.max("_value").over(Window.partitionBy(*inside).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))

    if cuts is None:
        return valued.withColumn(out, highest(group)).drop("_value")
    outer = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    local = with_block(valued, group, seq, cuts).withColumn(out, highest(keys))
    carry = _carried(valued.select(*group, seq, "_value"), group, seq, cuts, F.max("_value"), F.max("_n").over(outer))
    return local.join(carry, keys, "left").withColumn(out, F.greatest(F.col(out), F.col("_carry"))).drop(BLOCK, "_value", "_carry")


def last_known(
    df: DataFrame,
    group: list[str],
    seq: str,
    values: dict[str, Column],
    inclusive: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add, for each named value, its latest non-null one before this row (an as-of lookup)."""
    hidden = {name: f"_v{i}" for i, name in enumerate(values)}
    keys = [*group, BLOCK]
    valued, cuts = df.withColumns({hidden[n]: c for n, c in values.items()}), find_cuts(df, group, seq, block_rows)

    def latest_of(rows: DataFrame, inside: list[str]) -> DataFrame:
        window = Window.partitionBy(*inside).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return rows.withColumns({n: F.last(h, ignorenulls=True).over(window) for n, h in hidden.items()})

    if cuts is None:
        return latest_of(valued, group).drop(*hidden.values())
    outer = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    local = latest_of(with_block(valued, group, seq, cuts), keys)
    latest = F.struct(*[F.max_by(h, F.when(F.col(h).isNotNull(), F.col(seq))).alias(h) for h in hidden.values()])
    known = F.struct(*[F.last(f"_n.{h}", ignorenulls=True).over(outer).alias(h) for h in hidden.values()])
    carry = _carried(valued.select(*group, seq, *hidden.values()), group, seq, cuts, latest, known)
    return (
        local.join(carry, keys, "left")
        .withColumns({n: F.coalesce(F.col(n), F.col(f"_carry.{h}")) for n, h in hidden.items()})
        .drop(BLOCK, *hidden.values(), "_carry")
    )


def joined_text(
    df: DataFrame,
    group: list[str],
    seq: str,
    texts: dict[str, Column],
    sep: str = "",
    firsts: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
) -> DataFrame:
    """Concatenate each text column in ``seq`` order per group, in one aggregation.

    ``firsts`` and ``lasts`` are columns of which the first or last non-null value is kept alongside. A group's text is one
    value, so groups are to be chosen such that one fits into a task, for instance as parts of bounded size.
    """
    firsts, lasts = firsts or {}, lasts or {}
    columns = {**texts, **firsts, **lasts}
    cells = df.select(*group, seq, *[c.alias(n) for n, c in columns.items()])
    quoted = sep.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    present = {n: F.when(F.col(n).isNotNull(), F.col(seq)) for n in columns}
    return cells.groupBy(*group).agg(
        *[F.expr(f"listagg(`{n}`, '{quoted}') within group (order by `{seq}`)").alias(n) for n in texts],
        *[F.min_by(n, present[n]).alias(n) for n in firsts],
        *[F.max_by(n, present[n]).alias(n) for n in lasts],
    )


def joined_parts(
    df: DataFrame, group: list[str], seq: str, text: Column, sep: str, part_chars: int, out: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The joined text of each group in parts of ``part_chars`` characters, the last shorter: group, ``part``, ``out``.

    The parts one after the other are the whole text, so no value holds more than a part, however many or large the rows
    are. Where a row's text begins is a running sum; a row gives each part it reaches into its share.
    """
    texts = df.select(*group, seq, text.alias("_text")).where("_text is not null")
    placed = running_sum(texts, group, seq, F.length("_text").cast("bigint") + len(sep), "_begin", inclusive=False, block_rows=block_rows)
    begin, led = F.col("_begin"), F.when(F.col("_begin") == 0, F.col("_text")).otherwise(F.concat(F.lit(sep), F.col("_text")))
    placed = placed.withColumns({"_text": led, "_begin": F.when(begin == 0, begin).otherwise(begin - len(sep))})
    last = F.greatest(F.col("_begin"), F.col("_begin") + F.length("_text") - 1)
    parts = placed.withColumn("part", F.explode(F.sequence(F.floor(F.col("_begin") / part_chars), F.floor(last / part_chars))))
    cut = F.expr(f"substring(_text, cast(greatest(part * {part_chars} - _begin, 0L) + 1 as int), cast(least((part + 1) * {part_chars} - _begin, {part_chars}L) as int))")
    return joined_text(parts.withColumn("_cut", cut), [*group, "part"], seq, {out: F.col("_cut")})
