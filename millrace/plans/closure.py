"""Recursion without a level limit: rows from rows until nothing new comes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.errors import PipelineError
from millrace.plans.merging import Merged, merged, taken
from millrace.session import shared_folder, written_table

Step = Callable[[DataFrame, DataFrame], DataFrame]

#: Nodes of a block.
BLOCK = 4096


def fixpoint(seed: DataFrame, step: Step, max_rounds: int | None = None) -> DataFrame:
    """All rows that follow from ``seed``, as with ``WITH RECURSIVE ... UNION``.

    ``step(fresh, known)`` derives rows from those of the last round and all so far; only
    rows not known yet go into the next round, so cycles end. A step that joins ``fresh``
    to ``known`` on both sides doubles the reach of every round. Each round is written to
    the shared folder: the next one starts from files, and plans stay short however many
    rounds there are. ``max_rounds`` raises when it is passed.
    """
    spark, columns, schema = seed.sparkSession, seed.columns, seed.schema
    folder = f"{shared_folder(spark)}/millrace-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"

    def written(rows: DataFrame, turn: int) -> DataFrame:
        path = f"{folder}/round={turn}"
        rows.select(*columns).write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    def known() -> DataFrame:
        return spark.read.schema(schema).option("basePath", folder).parquet(f"{folder}/round=*").select(*columns)

    fresh, turn = written(seed.distinct(), 0), 0
    while not fresh.isEmpty():
        turn += 1
        if max_rounds is not None and turn > max_rounds:
            raise PipelineError(f"no end after {max_rounds} rounds")
        fresh = written(step(fresh, known()).select(*columns).subtract(known()), turn)
    return known()


def reachable(edges: DataFrame, start: str, end: str, measures: dict[str, Merged] | None = None) -> DataFrame:
    """(start, end) once for every pair connected by a path of one edge or more.

    Nodes that only lead on to one another form chains; a node reaches all that come later
    in its chain. What is left of the graph connects whole chains, and its closure says
    which chain reaches all of which. Both are kept in blocks of nodes, and pairs are only
    put together, block by block, as they are read: they are neither shuffled nor written.
    NULL ends belong to no edge.

    With ``measures`` of ``end``, pairs are put together where blocks are: ``start`` comes once for
    its own block and once for all others it reaches, with the measures of those pairs. Every pair
    counts in one of these rows, so they are to be merged again by ``start``.
    """
    given = edges.select(F.col(start).alias("start"), F.col(end).alias("end")).dropna().distinct()
    kind = given.select("start").union(given.select("end")).schema[0].dataType
    given = written_table(given.select(*[F.col(c).cast(kind).alias(c) for c in given.columns]))
    # An edge from a node to itself adds that one pair, whatever else there is.
    loops, ahead = given.filter("start = end"), given.filter("start <> end")
    one_out = ahead.groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.min("end").alias("end")).filter("n = 1")
    one_in = ahead.groupBy("end").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start")).filter("n = 1")
    links = one_out.select("start", "end").intersect(one_in.select("start", "end"))
    placed = _placed(ahead, links)
    head_of = placed.select("node", "head")
    between = ahead.join(links, ["start", "end"], "left_anti")
    for side in ("start", "end"):
        between = between.withColumnRenamed(side, "node").join(head_of, "node").drop("node").withColumnRenamed("head", side)
    rings = placed.filter("ring").select(F.col("head").alias("start"), F.col("head").alias("end"))
    chains = _closed(between.union(rings.select(*between.columns)))
    in_ring = chains.filter("start = end").select(F.col("start").alias("head"))
    alone = loops.join(placed.join(in_ring, "head").select(F.col("node").alias("start")), "start", "left_anti").select("start", "end")
    names, types = (start, end), [edges.schema[n].dataType for n in (start, end)]
    if measures is not None:
        # A node that only starts edges may not be of the type of an end, and is part of no pair as such.
        typed = [frame.withColumn(end, F.col(c).try_cast(types[1])) for frame, c in ((placed, "node"), (alone, "end"))]
        at_end = _measured(typed[0], chains, in_ring, measures).unionByName(typed[1].groupBy("start").agg(*taken(measures)))
        return at_end.select(F.col("start").cast(types[0]).alias(start), *measures)

    blocks = written_table(
        placed.groupBy("head", F.floor(F.col("place") / BLOCK).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("listed"))
        .select("head", "block", F.col("listed.node").alias("nodes"))
    )
    keys = blocks.select("head", "block")
    counts = keys.groupBy("head").agg(F.max("block").alias("last"))
    later = keys.join(counts.join(in_ring, "head", "left_anti"), "head").select(
        "head", "block", F.col("head").alias("to_head"), F.explode(F.sequence("block", "last")).alias("to_block"), F.lit(True).alias("onward")
    )
    whole = (
        chains.withColumnRenamed("start", "head").join(keys, "head")
        .join(keys.select(F.col("head").alias("end"), F.col("block").alias("to_block")), "end")
        .select("head", "block", F.col("end").alias("to_head"), "to_block", F.lit(False).alias("onward"))
    )
    ends = blocks.select(F.col("head").alias("to_head"), F.col("block").alias("to_block"), F.col("nodes").alias("to_nodes"))
    both = later.union(whole).join(blocks, ["head", "block"]).join(ends, ["to_head", "to_block"])
    # A number of its own: by their few bytes, AQE would put all blocks into one task.
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(width, "head", "block", "to_head", "to_block")
    each = both.select("to_nodes", (F.col("onward") & (F.col("block") == F.col("to_block"))).alias("own"), F.posexplode("nodes").alias("at", "start"))
    reached = F.when(F.col("own"), F.slice("to_nodes", F.col("at") + 2, F.lit(BLOCK))).otherwise(F.col("to_nodes"))
    pairs = each.select("start", F.explode(reached).alias("end"))
    return pairs.union(alone).select(*[F.col(c).cast(kind).alias(n) for c, n, kind in zip(("start", "end"), names, types, strict=True)])


def _measured(placed: DataFrame, chains: DataFrame, in_ring: DataFrame, measures: dict[str, Merged]) -> DataFrame:
    """(start, measures) of the nodes that come later in ``start``'s block, and of all in other blocks it reaches."""
    placed = placed.withColumn("__block", F.floor(F.col("place") / BLOCK))
    by_block = written_table(placed.groupBy("head", "__block").agg(*taken(measures)))

    def later(rows: DataFrame, keys: list[str], order: str, of: dict[str, Column]) -> DataFrame:
        """``rows`` outside rings with ``of`` over those that come later; the last of ``keys`` has none."""
        back = Window.partitionBy(*keys).orderBy(F.desc(order))
        past = {out: m.over(back.rowsBetween(Window.unboundedPreceding, -1)) for out, m in of.items()}
        return rows.join(in_ring, "head", "left_anti").withColumns({"__turn": F.row_number().over(back)} | past).filter("__turn > 1")

    inside = later(placed, ["head", "__block"], "place", {out: m.of for out, m in measures.items()}).select(F.col("node").alias("start"), *measures)
    onward = later(by_block, ["head"], "__block", {out: m.again(out) for out, m in measures.items()})
    by_chain = by_block.groupBy(F.col("head").alias("end")).agg(*merged(measures))
    whole = chains.join(by_chain, "end").groupBy(F.col("start").alias("head")).agg(*merged(measures))
    whole = by_block.select("head", "__block").join(whole, "head")
    columns = ["head", "__block", *measures]
    others = onward.select(*columns).union(whole.select(*columns)).groupBy("head", "__block").agg(*merged(measures))
    return inside.union(placed.join(others, ["head", "__block"]).select(F.col("node").alias("start"), *measures))


def _placed(edges: DataFrame, links: DataFrame) -> DataFrame:
    """(node, head, place, ring) of every node: its chain along ``links``, by the node the chain
    starts with, and how many links it comes after that. A closed ring starts with its least node.

    Each round doubles how far back a node looks, so there are about log n of them.
    """
    nodes = edges.select(F.col("start").alias("node")).union(edges.select("end")).distinct()
    back = links.select(F.col("end").alias("node"), F.col("start").alias("up"))
    here = F.struct("node", F.lit(0).cast("long").alias("far"))
    first = F.when(F.col("up").isNull(), here).otherwise(F.least(here, F.struct(F.col("up").alias("node"), F.lit(1).cast("long").alias("far"))))
    looked = written_table(
        nodes.join(back, "node", "left").select(
            "node", F.coalesce("up", "node").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("far"),
            F.col("up").isNull().alias("done"), first.alias("least"),
        )
    )
    for _ in range(looked.count().bit_length()):
        going = looked.filter("NOT done")
        if going.isEmpty():
            break
        further = looked.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("done").alias("done2"), F.col("least").alias("least2"))
        beyond = F.struct(F.col("least2.node").alias("node"), (F.col("least2.far") + F.col("far")).alias("far"))
        moved = going.join(further, "up").select(
            "node", F.col("up2").alias("up"), (F.col("far") + F.col("far2")).alias("far"), F.col("done2").alias("done"), F.least("least", beyond).alias("least")
        )
        looked = written_table(looked.filter("done").union(moved))
    # Who still has no start after looking back over as many links as there are nodes went round a ring.
    return looked.select(
        "node", F.when(F.col("done"), F.col("up")).otherwise(F.col("least.node")).alias("head"),
        F.when(F.col("done"), F.col("far")).otherwise(F.col("least.far")).alias("place"), (~F.col("done")).alias("ring"),
    )


def _closed(edges: DataFrame) -> DataFrame:
    """The closure of any graph, with (start, end) once for every pair.

    Every shortest path of more than ``reach`` edges, and no more than twice as many, is one
    of just ``reach`` edges and one that is known; so on a tree a pair is found once.
    """
    reach = 1

    def step(fresh: DataFrame, known: DataFrame) -> DataFrame:
        nonlocal reach
        first = fresh.filter(F.col("steps") == reach).select("start", F.col("end").alias("mid"), "steps")
        second = known.select(F.col("start").alias("mid"), "end", F.col("steps").alias("more"))
        reach *= 2
        found = first.join(second, "mid").groupBy("start", "end").agg(F.min(F.col("steps") + F.col("more")).alias("steps"))
        return found.join(known, ["start", "end"], "left_anti")

    return fixpoint(edges.select("start", "end", F.lit(1).cast("long").alias("steps")), step).select("start", "end")
