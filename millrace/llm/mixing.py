"""Mixing sources to target weights by Pareto order sampling (operator 7, native).

Sources in code point order, the one without a name last, weigh 5, 2, 1, repeating, and
share ``share`` times all words. No target exceeds ``limit`` times its source's words; what
is over goes to the others by weight until none is above.

Within a source, a document's expected copies grow with its size class (the bit length
of its number of words): ``level * (BASE + class)``, at most ``limit``, with the level at which the
expected words make the target. Whole copies are certain. For the fraction p that is
left, documents are ranked by random odds over inclusion odds, u/(1-u) / (p/(1-p)), and
the sample of fixed size, in words, is the head of that order; the document at its edge
is taken or not, whichever ends nearer to the target, and then one more document is
taken or left out if that brings the sum nearer still. Only whole documents are taken.
Equal rows share a rank and are counted together; of those at the edge as many are taken
as come nearest.

The order is cut by counting words in ever finer stretches of the rank, so no source is
sorted in one task. Random numbers are hashes of the id and text, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import cut, n_words, table

SHARE, LIMIT = 1.5, 2
WEIGHTS = (5, 2, 1)
BASE = 8
#: Stretches that a source's order is cut into, three times over.
STRETCHES = 256
#: Ways that a source's rows are dealt when they meet their source's figures.
SALTS = 64


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, its place in code point order from 0, NULL last.

    Rows are cut into ranges of names, so no task sorts them all.
    """
    ranged = cut(sources.repartitionByRange("missing", "source").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    # one row for each partition of the ranges
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy("missing", "source")) - 1
    return ranged.join(F.broadcast(before), "part").select("missing", "source", "words", (F.col("before") + inner).alias("place"))


def targets(sized: DataFrame, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(missing, source, words, target) for each source of ``sized`` (source, size)."""
    sources = sized.groupBy(F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("size").alias("words"))
    weights = F.array(*map(F.lit, WEIGHTS))
    weighed = cut(_ranked(sources).withColumn("weight", F.element_at(weights, (F.col("place") % len(WEIGHTS) + 1).cast("int"))))
    total = weighed.agg(F.sum("words")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        # sources at their limit at this level; the rest share what these leave
        over = F.col("weight") * F.lit(level) > limit * F.col("words")
        at_limit, held, weight = weighed.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("words"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))
        ).first()
        if at_limit == full or not weight:
            break
        full, level = at_limit, (share * total - limit * held) / weight
    target = F.least(F.col("weight") * F.lit(level), (limit * F.col("words")).cast("double"))
    return weighed.select("missing", "source", "words", target.alias("target"))


def _levels(classes: DataFrame, limit: int) -> DataFrame:
    """The level of each source, from its words by size class (at most 64 rows a source)."""
    by_class = classes.groupBy("missing", "source").agg(F.first("target").alias("target"), F.sort_array(F.collect_list(F.struct("class", "held")), asc=False).alias("c"))
    # the largest classes reach the limit first: try 0, 1, ... of them at the limit
    tried = F.transform(
        F.sequence(F.lit(0), F.size("c") - 1),
        lambda k: F.struct(
            k.alias("k"),
            (
                (F.col("target") - limit * F.aggregate(F.slice("c", 1, k), F.lit(0).cast("long"), lambda a, x: a + x["held"]))
                / F.aggregate(F.slice("c", k + 1, F.size("c")), F.lit(0).cast("long"), lambda a, x: a + x["held"] * (BASE + x["class"]))
            ).alias("level"),
        ),
    )
    fits = F.filter(tried, lambda t: t["level"] * (BASE + F.element_at("c", t["k"] + 1)["class"]) <= limit)
    # if rounding leaves none, all are at the limit
    return by_class.select("missing", "source", F.coalesce(F.try_element_at(fits, F.lit(1))["level"], F.lit(float(limit))).alias("level"))


def _with(rows: DataFrame, figures: DataFrame, *keys: str) -> DataFrame:
    """Rows joined to their source's figures, a source's rows dealt ``SALTS`` ways."""
    keys = ("missing", "source", *keys)
    salted = figures.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, [*keys, "salt"])


def mix(docs: DataFrame, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """Rows (row, size, source_size, target, taken): each row of ``docs`` whole, as a struct.

    ``docs`` has doc_id, text and source. NULL or empty text has size 0 and is never taken.
    Equal rows (doc_id, text and source) are documents of their own; where some of them
    are taken and some not, they are numbered by input partition. An empty table gives an
    empty one.
    """
    random = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.md5("text"), F.lit("-"))))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("source").isNull().alias("missing"),
        F.coalesce("source", F.lit("")).alias("source"),
        n_words(F.col("text")).alias("size"),
        F.conv(F.substring(random, 1, 13), 16, 10).cast("long").alias("draw"),
        F.pmod(F.conv(F.substring(random, 20, 8), 16, 10).cast("long"), F.lit(SALTS)).cast("int").alias("salt"),
        F.conv(F.substring(random, 14, 13), 16, 10).cast("long").alias("tie"),
    )
    light = rows.groupBy("missing", "source", "size", "draw", "tie", "salt").agg(F.count("*").alias("n"))
    light = cut(light.withColumn("class", F.length(F.bin("size"))).withColumn("all", F.col("size") * F.col("n")))
    goal = cut(targets(light.select(F.when(~F.col("missing"), F.col("source")).alias("source"), F.col("all").alias("size")), share, limit))
    held = light.where("size > 0").groupBy("missing", "source", "class").agg(F.sum("all").alias("held"))
    figures = goal.join(_levels(held.join(goal, ["missing", "source"]), limit), ["missing", "source"], "left")

    def planned(df: DataFrame) -> DataFrame:
        copies = F.when(F.col("size") > 0, F.least(F.coalesce("level", F.lit(0.0)) * (BASE + F.length(F.bin("size"))), F.lit(float(limit)))).otherwise(0.0)
        u = (F.col("draw") + 0.5) / F.lit(float(1 << 52))
        p = F.col("copies") - F.col("sure")
        # the rank as a number below 1: odds / (1 + odds), cut to 48 bits
        odds = u / (1 - u) / (p / (1 - p))
        return df.withColumn("copies", copies).withColumn("sure", F.floor("copies")).withColumn(
            "rank", F.when((F.col("size") > 0) & (p > 0), F.floor(odds / (1 + odds) * (1 << 48)).cast("long"))
        )

    plan = cut(planned(_with(light, figures)).select("missing", "source", "size", "n", "all", "sure", "rank", "tie", "salt", "target"))
    state = plan.groupBy("missing", "source").agg(F.first("target").alias("target"), F.sum(F.col("sure") * F.col("all")).alias("sure_words"))
    state = cut(state.select("missing", "source", (F.col("target") - F.col("sure_words")).alias("left"), F.lit(0).cast("long").alias("low")))
    step = STRETCHES
    for turn in range(3):
        # words of each stretch between the borders; the one in which the target lies goes on
        size = (1 << 48) // step ** (turn + 1)
        inside = _with(plan.where("rank IS NOT NULL"), state).where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.lit(size * step)))
        words = inside.groupBy("missing", "source", F.floor((F.col("rank") - F.col("low")) / size).alias("at")).agg(F.sum("all").alias("held"))
        upto = F.sum("held").over(Window.partitionBy("missing", "source").orderBy("at"))
        edge = (
            words.withColumn("upto", upto)
            .join(state, ["missing", "source"])
            .where("upto > left")
            .groupBy("missing", "source")
            .agg(F.min(F.struct("at", (F.col("upto") - F.col("held")).alias("before"))).alias("edge"))
        )
        state = cut(
            state.join(edge, ["missing", "source"], "left").select(
                "missing",
                "source",
                (F.col("left") - F.coalesce(F.col("edge.before"), F.lit(0))).alias("left"),
                # without an edge all are taken
                F.when(F.col("edge").isNull(), F.lit(1 << 49)).otherwise(F.col("low") + F.col("edge.at") * size).cast("long").alias("low"),
            )
        )
    last = (1 << 48) // step**3
    # the few rows of the last stretch, in order; the first to reach the target is the edge
    few = _with(plan.where("rank IS NOT NULL"), state).where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + last))
    order = Window.partitionBy("missing", "source").orderBy("rank", "tie", "size")
    row = F.struct("rank", "tie", "size")
    reached = few.withColumn("upto", F.sum("all").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("missing", "source").agg(
        F.max("upto").alias("upto"),
        F.min(F.when(F.col("upto") >= F.col("left"), F.struct("rank", "tie", "size", "n", (F.col("upto") - F.col("all")).alias("before")))).alias("edge"),
    )
    some = F.greatest(F.lit(0), F.least(F.col("edge.n"), F.round((F.col("left") - F.col("edge.before")) / F.col("edge.size")).cast("long")))
    # where nothing reaches the target the whole stretch is taken
    state = cut(
        state.join(reached, ["missing", "source"], "left").withColumn("m", some).select(
            "missing", "source", "low",
            (F.col("left") - F.coalesce(F.col("edge.before") + F.col("m") * F.col("edge.size"), "upto", F.lit(0))).alias("left"),
            F.struct("edge.rank", "edge.tie", "edge.size").alias("edge"), F.col("edge").isNull().alias("whole"), F.col("edge.n").alias("e_n"), "m",
        )
    )
    at_edge = F.coalesce(row == F.col("edge"), F.lit(False)) & ~F.col("whole")
    full = F.coalesce((F.col("rank") < F.col("low")) | ((F.col("rank") < F.col("low") + last) & (F.col("whole") | (row < F.col("edge")))), F.lit(False))
    # one document more, or one less, if that comes nearer
    taken = F.when(full, F.col("n")).when(at_edge, F.col("m")).otherwise(0)
    more = F.when(taken < F.col("n"), F.struct(F.abs(F.col("left") - F.col("size")).alias("off"), F.lit(1).alias("by")))
    less = F.when(taken > 0, F.struct(F.abs(F.col("left") + F.col("size")).alias("off"), F.lit(-1).alias("by")))
    closing = (
        _with(plan.where("rank IS NOT NULL"), state)
        .withColumn("best", F.least(more, less))
        .where(F.col("best.off") < F.abs("left"))
        .groupBy("missing", "source")
        .agg(F.min(F.struct("best.off", "rank", "tie", "size", "n", (taken + F.col("best.by")).alias("quota"))).alias("c"))
    )
    state = state.join(closing, ["missing", "source"], "left").select(
        "missing", "source", "low", "edge", "whole", "e_n", "m", F.struct("c.rank", "c.tie", "c.size").alias("closing"), F.col("c.n").alias("c_n"), F.col("c.quota").alias("c_quota")
    )
    state = cut(figures.join(state, ["missing", "source"]))
    closes = F.coalesce(row == F.col("closing"), F.lit(False)) & F.col("c_n").isNotNull()
    n = F.when(closes, F.col("c_n")).when(at_edge, F.col("e_n")).otherwise(1)
    quota = F.when(closes, F.col("c_quota")).when(at_edge, F.col("m")).otherwise(full.cast("long"))
    out = planned(_with(rows, state)).withColumn("n", n).withColumn("quota", quota)

    def finished(df: DataFrame, chosen: Column) -> DataFrame:
        copies = F.col("sure") + chosen.cast("long")
        return df.select("row", "size", F.col("words").alias("source_size"), "target", (copies * F.col("size")).cast("long").alias("taken"))

    parted = F.coalesce(((F.col("c_quota") > 0) & (F.col("c_quota") < F.col("c_n"))) | ((F.col("m") > 0) & (F.col("m") < F.col("e_n"))), F.lit(False))
    if state.where(parted).isEmpty():
        return finished(out, F.col("quota") > 0)
    split = (F.col("quota") > 0) & (F.col("quota") < F.col("n"))
    equal = _numbered(out.where(split), ["missing", "source", "rank", "tie", "size"])
    return finished(out.where(~split), F.col("quota") > 0).unionByName(finished(equal, F.col("number") <= F.col("quota")))


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``number``, from 1 among those of equal ``keys``: partition after partition, so none gathers them."""
    parts = cut(rows.withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy(*keys, "part").agg(F.count("*").alias("held"))
    before = sizes.withColumn("before", F.sum("held").over(Window.partitionBy(*keys).orderBy("part")) - F.col("held")).drop("held")
    inner = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(F.lit(0)))
    return parts.withColumn("inner", inner).join(before, [*keys, "part"]).withColumn("number", F.col("before") + F.col("inner")).drop("inner", "before", "part")


def op7(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(docs)
    return mixed.select(F.col("row.doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, with the columns it came with."""
    mixed = mix(docs).where("taken > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.floor(F.col("taken") / F.col("size"))))).select("row.*")
