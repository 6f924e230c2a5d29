"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target over its size is the number of copies that each of its documents should get. The
whole part is granted; the fractional part is rounded so that the words taken hardly move: two
documents at a time, words are moved from one to the other, at random in one of the two directions and with
probabilities that keep every document's expected copies, until one of the two is whole. The one
that stays fractional meets the next. Groups of a source reduce to one fractional document each, the
groups' survivors to fewer, and so on up a tree whose root holds one document a source; only that
one is rounded on its own, to the nearer side, so a source misses its target by half a document at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_key, size_words, written

#: Documents that meet in one group of the tree, on average.
FAN_IN = 64
#: Targets repeat these by the order of the sources; fixed by the contract, as are the two numbers below.
WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) a source, source null once at most.

    Targets are proportional to weights, up to limit times the source's size, whose excess goes to
    the others by weight. With sources in the order of size over weight, those that are full come
    first: a source is full exactly if the share that is left when all before it are full would
    overfill it too. Sums are of whole numbers, so reruns agree to the bit.
    """
    # One row a source, not a document: the order of the sources is a rank over all of them.
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % n + 1).cast("int")).cast("bigint"))
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every)
    left = F.lit(share) * total - F.lit(limit) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = ranked.withColumn("level", left / weight_left).withColumn("full", F.col("level") * F.col("weight") >= F.lit(limit) * F.col("source_size"))
    # All that come before the first source that is not full are full; its level holds for the rest.
    place = F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    shared = F.min_by("level", F.when(~F.col("full"), place)).over(every)
    target = F.when(F.col("full"), (F.lit(limit) * F.col("source_size")).cast("double")).otherwise(shared * F.col("weight"))
    return level.select("source", "source_size", F.least(target, (F.lit(limit) * F.col("source_size")).cast("double")).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _pivot(group: Column) -> Column:
    """Fold a group's items (key_a, key_b, words, part, draw) to items whose part is 0 or 1, and one that may stay between.

    The array that comes out has the decided items and, last, the open one.
    """
    eps = 1e-12
    item = "struct<key_a:bigint,key_b:bigint,words:bigint,part:double,draw:double>"

    def with_part(x: Column, part: Column) -> Column:
        # Close to whole is whole: what rounding of doubles leaves must not stay open.
        exact = F.when(part < eps, F.lit(0.0)).when(part > 1 - eps, F.lit(1.0)).otherwise(part)
        return F.struct(x["key_a"].alias("key_a"), x["key_b"].alias("key_b"), x["words"].alias("words"), exact.alias("part"), x["draw"].alias("draw"))

    def step(acc: Column, x: Column) -> Column:
        held = acc["open"]
        a, b = held["part"] * held["words"], x["part"] * x["words"]
        # Words that can go from x to held, and the other way.
        up = F.least((1 - held["part"]) * held["words"], b)
        down = F.least(a, (1 - x["part"]) * x["words"])
        rise = x["draw"] * (up + down) < down
        moved = F.when(rise, up).otherwise(-down)
        new_held = with_part(held, (a + moved) / held["words"])
        new_x = with_part(x, (b - moved) / x["words"])
        held_whole = (new_held["part"] == 0) | (new_held["part"] == 1)
        done = F.when(held_whole, new_held).otherwise(new_x)
        still = F.when(held_whole, new_x).otherwise(new_held)
        return F.struct(F.array_append(acc["done"], done).alias("done"), still.alias("open"))

    start = F.struct(F.array().cast(f"array<{item}>").alias("done"), group[0].cast(item).alias("open"))
    return F.aggregate(F.slice(group, 2, F.size(group)), start, step, lambda acc: F.array_append(acc["done"], acc["open"]))


def _round(open_items: DataFrame, level: int, groups: Column, seed: int) -> DataFrame:
    """One level of the tree: items meet in `groups` groups a source; returns all items with a new part."""
    bucket = F.when(groups <= 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("key_a", F.lit(seed), F.lit(level)), groups))
    item = F.struct("key_a", "key_b", "words", "part", _uniform(F.col("key_a"), F.col("key_b"), F.lit(seed), F.lit(level + 1000)).alias("draw"))
    met = open_items.withColumn("bucket", bucket).groupBy("source_key", "n", "bucket").agg(F.array_sort(F.collect_list(item)).alias("group"))
    return met.select("source_key", "n", F.explode(_pivot(F.col("group"))).alias("x")).select("source_key", "n", "x.key_a", "x.key_b", "x.words", "x.part")


def copies(items: DataFrame, seed: int = 1) -> DataFrame:
    """(key_a, key_b, extra): the rounded fractional part of every item, 0 or 1.

    items: key_a, key_b, source_key, words (over 0), part (0 to 1, neither whole). Each level is
    written before the next reads it; a level's groups hold FAN_IN items on average and, being dealt
    by a hash, hardly more than twice that, however large a source is.
    """
    n = items.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
    open_items = items.join(n, "source_key").select("source_key", "n", "key_a", "key_b", "words", "part")
    most = n.agg(F.max("n")).first()[0] or 0
    decided, level, width = [], 0, 1
    while True:
        width *= FAN_IN
        groups = F.ceil(F.col("n") / F.lit(width))
        met = written(_round(open_items, level, groups, seed))
        decided.append(met.where("part = 0 or part = 1").select("key_a", "key_b", F.col("part").cast("bigint").alias("extra")))
        open_items = met.where("part > 0 and part < 1")
        level += 1
        if width >= most:
            break
    last = open_items.select("key_a", "key_b", (F.col("part") >= 0.5).cast("bigint").alias("extra"))
    return reduce(DataFrame.union, [*decided, last])


def mix_sources(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: int = 1) -> DataFrame:
    """A row for each row of documents: id, size, source, source_size, target, times (copies that the mix takes) and taken (size * times).

    Also key_a and key_b, which identify a row by its id, source and text. Defined results: null and empty texts have size 0
    and are taken 0 times; a null source is a source of its own, the last; rows that repeat id,
    source and text are decided together, as one item of their summed words; an empty table gives none.
    """
    read = documents.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), F.col(text_column).alias("text"))
    docs = written(read.select("doc_id", "source", size_words("text").alias("size"), *row_key("doc_id", "source", "text")))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, limit).withColumn("source_key", F.xxhash64(F.col("source").isNull(), "source"))
    targets = written(targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))))
    keyed = docs.withColumn("source_key", F.xxhash64(F.col("source").isNull(), "source"))
    rated = keyed.join(targets.select("source_key", "source_size", "target", "rate"), "source_key")
    part = F.col("rate") - F.floor("rate")
    items = rated.where((F.col("size") > 0) & (part > 0)).groupBy("key_a", "key_b").agg(F.first("source_key").alias("source_key"), F.sum("size").alias("words"), F.first(part).alias("part"))
    rounded = copies(items, seed)
    times = F.when(F.col("size") > 0, F.floor("rate") + F.coalesce("extra", F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    found = rated.join(rounded, ["key_a", "key_b"], "left").withColumn("times", times)
    return found.select("key_a", "key_b", "doc_id", "source", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each row as often as mix_sources takes it, with the columns of documents.

    A row of size 0 is never taken. Options are those of mix_sources.
    """
    names = [options.get(k, v) for k, v in (("id_column", "doc_id"), ("source_column", "source"), ("text_column", "text"))]
    plan = mix_sources(documents, **options).where("times > 0").groupBy("key_a", "key_b").agg(F.first("times").alias("mix_times"))
    held = documents.columns
    inner = documents.toDF(*(f"in_{k}" for k in range(len(held))))
    keyed = inner.select("*", *row_key(*(f"in_{held.index(c)}" for c in names)))
    taken = keyed.join(plan, ["key_a", "key_b"]).withColumn("mix_times", F.explode(F.sequence(F.lit(1), F.col("mix_times"))))
    return taken.select(*(F.col(f"in_{k}").alias(c) for k, c in enumerate(held)))
