"""A Merkle manifest of documents: leaves, a root per group (language), one root of all, and proofs that fold back to it.

A leaf is the digest of a row's fields. Leaves of a group ascend by doc_id and are combined in pairs, level by level, to
the group's root; the roots of the groups, in the order of the groups, are combined likewise.

Where a leaf stands is answered by *bitmap rank*, not by sorting leaves. Per group, the ids present are kept as compressed
bitmaps: a container covers 4096 ids and holds its non-empty 64-bit words only, each with the number of rows in the words
before it (the popcount directory of the container); the containers, written in ranges of (group, container), hold the
number of rows before them (the directory of the group). Words are or-ed inside the tasks that read the table and merged
afterwards, so a group of any size is spread over all tasks. The rank of an id is the two directory entries plus the
popcount of the lower bits of its word.

Ranks are cut into tiles of 1024 slots. A tile is one keyed slot array: every leaf is put into its slot, the array is
reduced ten levels at once, and what is left goes to a slot of the tile above. A table of N leaves thus takes log1024(N)
rounds, and no task sees more than a tile. Proofs are read off the same arrays on the way back down.

Defined results: null fields are part of a leaf as ``-``; a null doc_id counts as the smallest id. Rows of equal group and
doc_id stand next to each other in the order of their leaves, equal rows each have a slot and a proof of their own. Null
is a group, before all others. A text of any length is hashed whole, in one task. An empty table gives no rows. Only the
named fields are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanmill.llm.common import stored
from gleanmill.operators import ordering

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

WORD_BITS = 6
CONTAINER_BITS = 12
TILE_LEVELS = 10
TILE = 1 << TILE_LEVELS
DIGEST = 32


def node(*children: bytes) -> bytes:
    """The digest of digests, which enter as hex text."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


def leaf_digest(values: dict[str, Column]) -> Column:
    """Hex sha256 over the fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for value in values.values():
        text = value.cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, altered: Column | None = None, group: str = "lang") -> DataFrame:
    """grp, place, doc_id, leaf, shown of every row.

    ``shown`` is the leaf as it is presented to a verifier: where ``altered`` holds, that of the row with one added to
    n_chars. Groups are keyed by ``=`` and their name, null by the empty string, which comes first.
    """
    fields = {name: docs[name] for name in FIELDS}
    leaf = F.unhex(leaf_digest(fields))
    added = {**fields, "n_chars": docs["n_chars"].cast("decimal(20,0)") + 1}
    shown = leaf if altered is None else F.when(altered & docs["n_chars"].isNotNull(), F.unhex(leaf_digest(added)))
    name = docs[group].cast("string")
    rows = docs.select(
        F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name)).alias("grp"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("place"),
        docs["doc_id"].cast("long").alias("doc_id"), leaf.alias("leaf"), shown.alias("shown"),
    )
    return rows.withColumn("shown", F.coalesce("shown", "leaf"))


def _bit(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")


def _word(place: Column) -> Column:
    """Which of its container's words an id is in."""
    return F.shiftright(place, WORD_BITS).bitwiseAND(F.lit((1 << (CONTAINER_BITS - WORD_BITS)) - 1)).cast("int")


class Ranks(NamedTuple):
    """``containers``: grp, high, words, bits, inside, before; ``repeated``: grp, place of ids with several rows;
    ``sizes``: grp, total."""

    containers: DataFrame
    repeated: DataFrame
    sizes: DataFrame


def rank_index(rows: DataFrame) -> Ranks:
    """The compressed bitmaps of stored ``rows`` (grp, place) with their directories."""
    spark = rows.sparkSession
    place = F.col("place")
    words = rows.groupBy("grp", F.shiftright(place, CONTAINER_BITS).alias("high"), _word(place).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(place & {(1 << WORD_BITS) - 1} as int))")).alias("bits"), F.count(F.lit(1)).alias("n"))
    # At most 64 words to a container.
    containers = words.groupBy("grp", "high").agg(
        F.array_sort(F.collect_list(F.struct("word", "bits", "n"))).alias("w"), F.sum("n").alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = containers.repartitionByRange(parts, "grp", "high").withColumn("part", F.spark_partition_id())
    # Stored, so that the parts are the same ones whenever they are read.
    ranged = stored(ranged, "merkle-bitmaps")
    totals = ranged.groupBy("grp", "part").agg(F.sum("n").alias("part_n"))
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("grp", "part", F.coalesce(F.sum("part_n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("grp", "part").orderBy("high").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bases, ["grp", "part"])
    directory = F.expr("transform(w, (x, i) -> aggregate(slice(w, 1, i), 0L, (s, y) -> s + y.n))")
    containers = placed.select(
        "grp", "high", F.col("w.word").alias("words"), F.col("w.bits").alias("bits"), directory.alias("inside"),
        (F.col("before") + F.col("base")).alias("before"),
    )
    crowded = ranged.select("grp", "high", F.explode("w").alias("w")).where("w.n > bit_count(w.bits)").select(
        "grp", "high", F.col("w.word").alias("word"))
    sizes = totals.groupBy("grp").agg(F.sum("part_n").alias("total"))
    keyed = rows.select("grp", "place", F.shiftright(place, CONTAINER_BITS).alias("high"), _word(place).alias("word"))
    repeated = (
        keyed.join(crowded, ["grp", "high", "word"], "left_semi").groupBy("grp", "place").agg(F.count(F.lit(1)).alias("rows"))
        .where("rows > 1")
    )
    return Ranks(containers, stored(repeated, "merkle-repeated"), stored(sizes, "merkle-sizes"))


def ranked(rows: DataFrame, index: Ranks) -> DataFrame:
    """``rows`` with ``rank``, from 0, inside their group, and the group's ``total``."""
    keyed = rows.withColumns({"high": F.shiftright("place", CONTAINER_BITS), "word": _word(F.col("place")), "bit": _bit(F.col("place"))})
    single = keyed.join(index.repeated, ["grp", "place"], "left_anti").withColumns({"copies": F.lit(1).cast("long"), "offset": F.lit(0).cast("long")})
    # Rows of one id are few, if any; equal ones are counted, different ones are ordered by their leaves.
    several = keyed.join(index.repeated.select("grp", "place"), ["grp", "place"]).groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("copies"))
    several = several.withColumn("_order", F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long"))
    several = ordering.running_sum(several, ["grp", "place"], "_order", F.col("copies"), "offset", inclusive=False).drop("_order")
    # Repeated ids that come earlier in the same word have more rows than bits.
    extra = index.repeated.groupBy(
        "grp", F.shiftright("place", CONTAINER_BITS).alias("high"), _word(F.col("place")).alias("word")
    ).agg(F.collect_list(F.struct(_bit(F.col("place")).alias("bit"), (F.col("rows") - 1).alias("more"))).alias("extra"))
    together = single.unionByName(several.select(single.columns)).join(index.containers, ["grp", "high"]).join(extra, ["grp", "high", "word"], "left")
    at = F.array_position("words", F.col("word")).cast("int")
    lower = F.expr("element_at(bits, cast(array_position(words, word) as int)) & ~shiftleft(-1L, bit)")
    more = F.expr("aggregate(filter(coalesce(extra, array()), x -> x.bit < bit), 0L, (s, x) -> s + x.more)")
    rank = F.col("before") + F.element_at("inside", at) + F.bit_count(lower) + more + F.col("offset")
    placed = together.select("grp", "doc_id", "leaf", "shown", "copies", rank.alias("rank"))
    alone = placed.where("copies = 1")
    copies = placed.where("copies > 1").withColumn("rank", F.explode(F.expr("sequence(rank, rank + copies - 1)")))
    return alone.unionByName(copies).drop("copies").join(index.sizes, "grp")


def levels(count: int) -> int:
    """How many times ``count`` nodes are halved until one is left."""
    return max(0, count - 1).bit_length()


def _reduced(slots: list[bytes], times: int) -> list[list[bytes]]:
    """The slot array and the arrays that it is reduced to."""
    arrays = [slots]
    for _ in range(times):
        below = arrays[-1]
        arrays.append([node(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return arrays


TILE_SCHEMA = "grp string, tile long, n int, remaining long, doc_ids array<bigint>, slots binary, shown binary, top binary"


def tiles(nodes: DataFrame, label: str) -> DataFrame:
    """One row per tile, stored, of ``nodes`` (grp, rank, doc_id, leaf, shown, total): its slots and the node above them.

    ``remaining`` is the number of nodes of the group on this level.
    """

    def fill(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        grp, tile, total = (k.as_py() for k in key)
        n = rows.num_rows
        order = rows.column("slot").to_pylist()
        slots: list[bytes] = [b""] * n
        shown: list[bytes] = [b""] * n
        docs: list[int | None] = [None] * n
        columns = (rows.column(c).to_pylist() for c in ("leaf", "shown", "doc_id"))
        for slot, leaf, given, doc in zip(order, *columns, strict=True):
            slots[slot], shown[slot], docs[slot] = leaf, given, doc
        top = _reduced(slots, min(TILE_LEVELS, levels(total)))[-1]
        made = {"grp": grp, "tile": tile, "n": n, "remaining": total, "doc_ids": docs, "slots": b"".join(slots),
                "shown": b"".join(shown), "top": top[0]}
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({k: pa.array([v], kind) for (k, v), kind in zip(made.items(), kinds, strict=True)})

    keyed = nodes.withColumns({
        "tile": F.shiftright("rank", TILE_LEVELS), "slot": F.col("rank").bitwiseAND(F.lit(TILE - 1)).cast("int")})
    return stored(keyed.groupBy("grp", "tile", "total").applyInArrow(fill, TILE_SCHEMA), label)


def _above(level: DataFrame) -> DataFrame:
    """The nodes that a level of tiles leaves for the next."""
    total = F.expr(f"(remaining + {TILE - 1}) div {TILE}")
    return level.select(
        "grp", F.col("tile").alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.col("top").alias("leaf"),
        F.col("top").alias("shown"), total.alias("total"))


def _tree(nodes: DataFrame, label: str, most: int) -> list[DataFrame]:
    """The levels of tiles over groups of at most ``most`` nodes, up to one tile a group."""
    found = [tiles(nodes, f"{label}-0")]
    while (most := -(-most // TILE)) > 1:
        found.append(tiles(_above(found[-1]), f"{label}-{len(found)}"))
    return found


NODE_SCHEMA = "grp string, rank long, doc_id long, leaf binary, shown binary, path binary"


def _with_paths(level: DataFrame, upper: DataFrame) -> DataFrame:
    """The nodes of a level with their siblings from there upwards, given ``upper`` (grp, tile, above)."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                n, slots, shown = row["n"], row["slots"], row["shown"]
                arrays = _reduced([slots[DIGEST * i : DIGEST * (i + 1)] for i in range(n)], min(TILE_LEVELS, levels(row["remaining"])))
                paths = []
                for i in range(n):
                    path, at = [], i
                    for array in arrays[:-1]:
                        if at ^ 1 < len(array):
                            path.append(array[at ^ 1])
                        at >>= 1
                    paths.append(b"".join(path) + row["above"])
                first = row["tile"] << TILE_LEVELS
                given = [shown[DIGEST * i : DIGEST * (i + 1)] for i in range(n)]
                columns = [[row["grp"]] * n, range(first, first + n), row["doc_ids"], arrays[0], given, paths]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return level.join(upper, ["grp", "tile"]).mapInArrow(expand, NODE_SCHEMA)


def _down(tree: list[DataFrame], upper: DataFrame) -> DataFrame:
    """The nodes of the lowest level with whole paths; ``upper`` has the path of each group's top tile."""
    for level in reversed(tree[1:]):
        upper = _with_paths(level, upper).select("grp", F.col("rank").alias("tile"), F.col("path").alias("above"))
    return _with_paths(tree[0], upper)


def folded(leaf: bytes, path: bytes, places: list[tuple[int, int]]) -> bytes:
    """The root that ``leaf`` leads to with the siblings in ``path``, through trees given by (place, number of leaves)."""
    current, used = leaf, 0
    for at, count in places:
        while count > 1:
            if at ^ 1 < count:
                sibling = path[used : used + DIGEST]
                used += DIGEST
                current = node(sibling, current) if at & 1 else node(current, sibling)
            else:
                current = node(current)
            at, count = at >> 1, (count + 1) >> 1
    if used != len(path):
        raise ValueError("the proof has more siblings than its place has levels")
    return current


SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verified(docs: DataFrame, altered: Column | None = None, group: str = "lang") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    The proof of a row is folded from its leaf as presented (see :func:`leaves`); it verifies if that gives the root.
    """
    rows = stored(leaves(docs, altered, group), "merkle-leaves")
    index = rank_index(rows)
    most = index.sizes.agg(F.max("total")).first()[0] or 0
    tree = _tree(ranked(rows, index), "merkle-tiles", most)
    # One row per group from here on.
    by_name = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tree[-1].select("grp", F.col("top").alias("subroot")).select(
        "grp", "subroot", (F.row_number().over(by_name) - 1).cast("long").alias("group_rank"),
        F.count(F.lit(1)).over(everything).alias("groups"))
    tops = stored(tops, "merkle-groups")
    group_nodes = tops.select(
        F.lit("").alias("grp"), F.col("group_rank").alias("rank"), F.lit(None).cast("long").alias("doc_id"),
        F.col("subroot").alias("leaf"), F.col("subroot").alias("shown"), F.col("groups").alias("total"))
    group_tree = _tree(group_nodes, "merkle-group-tiles", index.sizes.count())
    root = group_tree[-1].select("grp", "tile", F.lit(b"").alias("above"), F.col("top").alias("root"))
    group_paths = _down(group_tree, root.drop("root")).join(root.select("grp", "root"), "grp").select(
        F.col("rank").alias("group_rank"), F.col("path").alias("above"), "root")
    facts = stored(tops.join(group_paths, "group_rank").join(index.sizes, "grp"), "merkle-facts")
    found = _down(tree, facts.select("grp", F.lit(0).cast("long").alias("tile"), "above"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("rank", "total", "group_rank", "groups", "leaf", "shown", "path", "root")
            columns = {"proof_sha256": [], "folded_root": [], "verified": []}
            for rank, total, g, groups, leaf, shown, path, root in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                top = folded(shown, path, [(rank, total), (g, groups)])
                columns["proof_sha256"].append(sha256(path.hex().encode()).hexdigest())
                columns["folded_root"].append(top.hex())
                columns["verified"].append(top == root)
            hexed = {c: [v.hex() for v in batch.column(c).to_pylist()] for c in ("leaf", "subroot", "root")}
            made = {"doc_id": batch.column("doc_id"), **hexed, **columns}
            yield pa.RecordBatch.from_pydict(made)

    return found.join(facts.drop("above"), "grp").mapInArrow(fold, SCHEMA)
