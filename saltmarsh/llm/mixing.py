"""Mixing sources to target weights, with DataFrame functions only.

Every source is cut into blocks of some ``BLOCK_DOCS`` documents by a hash, and
its blocks are put into a random order, also by a hash. A source takes all its
blocks as often as its target holds its size, and of what is left of the target
the blocks that come first; of the block at the edge it takes the documents that
fill the target best. That fixes how many blocks each source gives: its quota.

A tree splits the quotas among the output shards. A node halves its draws: how
many of them come from each source follows the multivariate hypergeometric
distribution, drawn source after source. The leaves are shards whose quotas add
up exactly, and a shard's share of a source is a run of the permuted blocks that
no other shard has. A shard is then shuffled locally.

Random numbers are hashes, so reruns agree. Blocks are ranked inside buckets of
some hundred, then shifted, so a source that holds most rows is never in one
task. The table of sources (one row each) is handled as one small table.

Null texts have size 0; the null source comes last. Rows equal in key, source and
text are one unit: they share its fate, and all are returned. Null keys are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from saltmarsh.functions.values import let
from saltmarsh.operators.rows import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2.0
SEED = 20_011
BLOCK_DOCS = 64
BUCKET_BLOCKS = 256
SHARD_BLOCKS = 256
# Levels of the splitting tree that one task may go through alone.
LEVELS_ALONE = 6


def word_count(text: Column) -> Column:
    """Runs of anything but blanks and the control characters 9 to 13; null has none."""
    marked = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def unit_random(*parts: Column) -> Column:
    """Between 0 and 1, without the ends, from a hash of the parts."""
    return (F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: float = MOST_REPEATS
) -> DataFrame:
    """Targets of sources (source, source_size): ``share`` of all sizes by weight, filled up to the caps.

    Taken by rising cap per weight, a source is capped as long as the rest of the
    total, shared among it and those behind it, lies above its cap.
    """
    everything = W.partitionBy()
    order = W.orderBy(F.col("source").asc_nulls_last())
    behind = W.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    listed = sizes.withColumn("sid", F.row_number().over(order) - 1)
    listed = listed.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights)))
    listed = listed.withColumn("cap", repeats * F.col("source_size"))
    filled = listed.withColumns(
        {
            "total": share * F.sum("source_size").over(everything),
            "all_weight": F.sum("weight").over(everything),
            "cap_before": F.coalesce(F.sum("cap").over(behind), F.lit(0.0)),
            "weight_before": F.coalesce(F.sum("weight").over(behind), F.lit(0.0)),
        }
    )
    level = (F.col("total") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    filled = filled.withColumn("capped", F.col("cap") / F.col("weight") <= level)
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(rest / open_weight * F.col("weight"))
    return filled.withColumn("target", target).drop("total", "all_weight", "cap_before", "weight_before", "cap", "capped")


def hypergeometric(everything: Column, good: Column, drawn: Column, random: Column) -> Column:
    """How many of ``drawn`` out of ``everything`` are among the ``good``, by inversion.

    Outcomes are walked from the likeliest upward, then downward, as far as
    fourteen standard deviations; what lies beyond weighs less than a double resolves.
    """

    def walk(low: Column, high: Column, start: Column, spread: Column) -> Column:
        top = F.least(high, start + spread)
        bottom = F.greatest(low, start - spread)
        ups = F.sequence(start, top)
        downs = F.when(start > bottom, F.sequence(start - 1, bottom)).otherwise(F.array().cast("array<bigint>"))

        def rise(k: Column) -> Column:
            return (good - k) * (drawn - k) / ((k + 1) * (everything - good - drawn + k + 1).cast("double"))

        def fall(k: Column) -> Column:
            return (k + 1) * (everything - good - drawn + k + 1) / ((good - k) * (drawn - k)).cast("double")

        def step(limit: Column, up: bool):
            # Going up, w belongs to k and is moved on after it; going down it is moved first.
            def take(s: Column, k: Column) -> Column:
                w = s["w"] if up else s["w"] * fall(k)
                found = (s["sum"] + w >= limit) & (s["pick"] < 0)
                return F.struct(
                    (w * rise(k) if up else w).alias("w"),
                    (s["sum"] + w).alias("sum"),
                    F.when(found, k).otherwise(s["pick"]).alias("pick"),
                )

            return take

        def state(total: Column) -> Column:
            return F.struct(F.lit(1.0).alias("w"), total.alias("sum"), F.lit(-1).cast("long").alias("pick"))

        never = F.lit(float("inf"))
        up_sum = F.aggregate(ups, state(F.lit(0.0)), step(never, True), lambda s: s["sum"])
        all_sum = let(up_sum, lambda half: F.aggregate(downs, state(half), step(never, False), lambda s: s["sum"]))

        def choose(limit: Column) -> Column:
            above = F.aggregate(ups, state(F.lit(0.0)), step(limit, True))
            return let(
                above,
                lambda s: F.when(s["pick"] >= 0, s["pick"]).otherwise(
                    F.aggregate(downs, state(s["sum"]), step(limit, False), lambda t: F.when(t["pick"] >= 0, t["pick"]).otherwise(start))
                ),
            )

        return let(all_sum * random, choose)

    low = F.greatest(F.lit(0).cast("long"), drawn + good - everything)
    high = F.least(good, drawn)
    mode = F.floor((good + 1) * ((drawn + 1) / (everything + 2).cast("double"))).cast("long")
    variance = drawn * (good / F.greatest(everything, F.lit(1)).cast("double")) * (1 - good / F.greatest(everything, F.lit(1)).cast("double"))
    spread = F.ceil(14 * F.sqrt(variance) + 14).cast("long")
    bounds = F.struct(low.alias("low"), high.alias("high"), F.least(high, F.greatest(low, mode)).alias("start"), spread.alias("spread"))
    return let(bounds, lambda b: walk(b["low"], b["high"], b["start"], b["spread"]))


def split_quotas(quotas: DataFrame, levels: int) -> DataFrame:
    """(sid, shard, draws) from quotas (sid, draws), through ``levels`` halvings."""
    item = F.struct("sid", "draws")
    nodes = quotas.agg(F.array_sort(F.collect_list(item)).alias("counts")).select(F.lit(0).cast("long").alias("shard"), "counts")
    for level in range(levels):
        if level and level % LEVELS_ALONE == 0:
            nodes = nodes.repartition("shard")
        everything = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c["draws"])

        def split(total: Column, level: int = level) -> Column:
            start = F.struct(
                total.alias("rest"), F.floor(total / 2).cast("long").alias("room"), F.array().cast("array<bigint>").alias("left")
            )

            def one(s: Column, c: Column) -> Column:
                random = unit_random(F.lit(level), F.col("shard"), c["sid"])
                return let(
                    hypergeometric(s["rest"], c["draws"], s["room"], random),
                    lambda x: F.struct(
                        (s["rest"] - c["draws"]).alias("rest"), (s["room"] - x).alias("room"), F.concat(s["left"], F.array(x)).alias("left")
                    ),
                )

            return F.aggregate("counts", start, one, lambda s: s["left"])

        halved = nodes.select("shard", "counts", let(everything, split).alias("left"))

        def side(shard: Column, draws) -> Column:
            return F.struct(
                shard.alias("shard"),
                F.zip_with("counts", "left", lambda c, x: F.struct(c["sid"].alias("sid"), draws(c, x).alias("draws"))).alias("counts"),
            )

        halves = F.array(
            side(F.col("shard") * 2, lambda c, x: x), side(F.col("shard") * 2 + 1, lambda c, x: c["draws"] - x)
        )
        nodes = halved.select(F.explode(halves).alias("half")).select("half.shard", "half.counts")
    return nodes.select("shard", F.inline("counts"))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: float = MOST_REPEATS,
) -> DataFrame:
    """Per row of docs: key, source, unit, size, source_size, target, taken and draws.

    ``draws`` lists the shard of every time the document is taken; ``unit`` is a
    hash that, with key and source, leads back to the row's text.
    """
    rows = docs.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        F.xxhash64(F.lit(SEED), F.col(source), F.col(key), F.col(text)).alias("unit"),
        word_count(F.col(text)).alias("size"),
    )
    units = materialise(rows.groupBy("key", "source", "unit", "size").agg(F.count(F.lit(1)).alias("copies")), "units")
    words = F.col("size") * F.col("copies")
    sizes = units.groupBy("source").agg(F.sum(words).alias("source_size"), F.count(F.lit(1)).alias("units"))
    sources = source_targets(sizes, weights, share, repeats)
    sources = sources.withColumn("n_blocks", F.ceil(F.col("units") / BLOCK_DOCS).cast("long"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    sources = materialise(sources, "sources")
    placed = units.alias("u").join(sources.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source")))
    placed = placed.select(
        "u.*", "sid", "source_size", "target", "n_blocks", "passes", "rest", F.pmod(F.xxhash64("unit", F.lit(SEED)), "n_blocks").alias("block")
    )
    placed = materialise(placed, "placed")

    # Blocks in the random order of their source: ranks and words before them.
    blocks = placed.groupBy("sid", "block").agg(
        F.sum(words).alias("words"), *[F.first(c).alias(c) for c in ("n_blocks", "passes", "rest")]
    )
    blocks = blocks.withColumn("order", unit_random(F.col("sid"), F.col("block")))
    blocks = blocks.withColumn("bucket", F.floor(F.col("order") * F.ceil(F.col("n_blocks") / BUCKET_BLOCKS)).cast("long"))
    inside = W.partitionBy("sid", "bucket").orderBy("order", "block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.withColumns(
        {"rank": F.count(F.lit(1)).over(inside), "before": F.coalesce(F.sum("words").over(inside), F.lit(0))}
    )
    blocks = materialise(blocks, "blocks")
    earlier = W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = blocks.groupBy("sid", "bucket").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n"))
    buckets = buckets.select(
        "sid", "bucket",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ranks_before"),
        F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("words_before"),
    )
    blocks = blocks.join(buckets, ["sid", "bucket"]).select(
        "sid", "block", "words", "n_blocks", "passes", "rest",
        (F.col("rank") + F.col("ranks_before")).alias("rank"),
        (F.col("before") + F.col("words_before")).alias("before"),
    )
    whole = F.col("before") + F.col("words") <= F.col("rest")
    edge = ~whole & (F.col("before") < F.col("rest"))
    blocks = blocks.withColumns({"whole": whole, "edge": edge, "gap": F.col("rest") - F.col("before")})
    blocks = materialise(blocks, "ranked")

    # The block at the edge of a source: documents by falling size, as long as they fit, and one
    # more if that comes nearer.
    item = F.struct(words.alias("words"), F.col("unit"), F.col("key"))
    edges = placed.join(blocks.filter("edge").select("sid", "block", "gap"), ["sid", "block"])
    edges = edges.groupBy("sid", "block").agg(F.first("gap").alias("gap"), F.sort_array(F.collect_list(item), asc=False).alias("items"))

    def fit(state: Column, i: Column) -> Column:
        fits = i["words"] <= state["gap"]
        return F.struct(
            F.when(fits, state["gap"] - i["words"]).otherwise(state["gap"]).alias("gap"),
            F.when(fits, F.concat(state["picked"], F.array(i["unit"]))).otherwise(state["picked"]).alias("picked"),
            # The last that did not fit is the least of them.
            F.when(fits, state["over"]).otherwise(i).alias("over"),
        )

    nothing = F.struct(
        F.col("gap"), F.array().cast("array<bigint>").alias("picked"), F.lit(None).cast("struct<words:bigint,unit:bigint,key:string>").alias("over")
    )

    def finish(state: Column) -> Column:
        nearer = state["over"]["words"] - state["gap"] < state["gap"]
        return F.when(nearer, F.concat(state["picked"], F.array(state["over"]["unit"]))).otherwise(state["picked"])

    item_text = F.transform("items", lambda i: F.struct(i["words"].alias("words"), i["unit"].alias("unit"), i["key"].cast("string").alias("key")))
    edges = edges.select("sid", "block", F.aggregate(item_text, nothing, fit, finish).alias("picked"))
    edges = materialise(edges, "edges")

    # Draws of every block and the quota of every source.
    drawn = blocks.join(edges, ["sid", "block"], "left")
    last = F.col("whole") | (F.size(F.coalesce("picked", F.array().cast("array<bigint>"))) > 0)
    drawn = drawn.withColumn("times", F.col("passes") + last.cast("long"))
    drawn = materialise(drawn.filter("times > 0"), "drawn")
    quotas = materialise(drawn.groupBy("sid").agg(F.sum("times").alias("draws")), "quotas")
    total = quotas.agg(F.sum("draws")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(1, total) / SHARD_BLOCKS)))
    along = W.partitionBy("sid").orderBy("shard")
    runs = split_quotas(quotas, levels).withColumn("high", F.sum("draws").over(along)).withColumn("low", F.col("high") - F.col("draws"))
    # A cell of a source holds as many draws as a shard has of it on average.
    cell = F.greatest(F.lit(1), F.floor(F.col("quota") / (1 << levels))).cast("long")
    of_source = quotas.select("sid", F.col("draws").alias("quota"))
    runs = runs.filter("draws > 0").join(of_source, "sid").withColumn("width", cell)
    runs = runs.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / F.col("width")), F.floor((F.col("high") - 1) / F.col("width")))))
    runs = materialise(runs.select("sid", "shard", "low", "high", "cell"), "runs")
    draws = drawn.join(of_source, "sid").withColumn("width", cell).select(
        "sid", "block", "passes", "picked", "width", "n_blocks", "rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("turn")
    )
    draws = draws.withColumn("draw", F.col("turn") * F.col("n_blocks") + F.col("rank"))
    draws = materialise(draws.withColumn("cell", F.floor(F.col("draw") / F.col("width"))), "draws")
    owned = draws.join(runs, ["sid", "cell"]).filter("draw >= low and draw < high")
    per_block = owned.groupBy("sid", "block").agg(
        F.array_sort(F.collect_list(F.struct("turn", "shard"))).alias("draws"), F.first("picked").alias("picked"), F.first("passes").alias("p")
    )
    per_block = materialise(per_block, "shards")

    result = placed.join(per_block, ["sid", "block"], "left")
    on_edge = F.col("picked").isNotNull() & ~F.array_contains("picked", F.col("unit"))
    kept = F.filter("draws", lambda d: ~(on_edge & (d["turn"] == F.col("p"))))
    result = result.withColumn("draws", F.coalesce(F.transform(kept, lambda d: d["shard"]), F.array().cast("array<bigint>")))
    return result.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        F.col("key").alias(key), "source", "unit", "size", "source_size", "target", (F.size("draws") * F.col("size")).cast("long").alias("taken"), "draws"
    )


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The documents as often as the mix takes them, with the columns of docs, shuffled inside their shards."""
    plan = mix(docs, key, source, text, **options).filter(F.size("draws") > 0)
    plan = plan.select(F.col(key).alias("key"), "source", "unit", "draws").distinct().alias("plan")
    # Columns of docs travel in one struct, whatever their names are.
    unit = F.xxhash64(F.lit(SEED), F.col(source), F.col(key), F.col(text))
    rows = docs.select(unit.alias("unit"), F.col(key).alias("key"), F.col(source).alias("source"), F.struct(*docs.columns).alias("row")).alias("docs")
    same = (F.col("docs.unit") == F.col("plan.unit")) & F.col("docs.key").eqNullSafe(F.col("plan.key"))
    same = same & F.col("docs.source").eqNullSafe(F.col("plan.source"))
    taken = rows.join(plan, same).select("docs.unit", "docs.row", F.explode("plan.draws").alias("shard"))
    ordered = taken.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(SEED), F.col("shard"), F.col("unit")))
    return ordered.select("row.*")
