"""Fuzzy line dedup across a corpus, in DataFrame operations only.

Lines are compared in lower case without blanks at either end. Equal lines are first brought down to one,
with the place of the first. A line is the set of its character shingles; MinHash values of the set, taken
as the smallest shingle hash after flipping a fixed pattern of bits, are joined to bands, and lines that share
a band's value are candidates, if enough of all their values agree. A candidate link counts if the Jaccard similarity of the two
sets, computed from the texts, reaches the threshold. Of each connected component of links the line that comes first stays.

A bucket of SMALL lines or fewer is compared whole. In a larger one every line is compared with HUBS members first, chosen by
hashes; a large group of near copies mostly becomes one component that way, at a few comparisons a line. In a larger
bucket that is then still in more than one component lines outside the largest one meet some of its members, and what is still outside
is held against all lines of the bucket by bounds that lose no pair. Where more than OUTSIDERS lines are outside, the bucket's lines
go on to blocks of lines that share one of their rarest shingles instead: lines that reach the threshold share one, so comparing each block's
lines with those of its other components leaves no pair of a bucket over. Every line is sent by its hash, never by
its document, equal lines are counted before they are sent, and tables that joins look things up in are written first, so that Spark
splits what joins on a frequent value.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, delete, released, written
from .components import components

#: Characters of a shingle (UTF-16 units: one beyond the basic plane counts as two); a shorter line is one shingle.
SHINGLE = 10
#: Bands of a line and MinHash values of a band: of pairs at the threshold one in 460 is missed.
BANDS, ROWS = 6, 2
#: Values that must agree, of all: of pairs at the threshold one in 1,700 has fewer.
AGREE = 5
THRESHOLD = 0.8
#: 64-bit words of the parities that bound how many shingles two lines differ in.
WORDS = 8
#: Largest bucket that is compared whole, and members of a larger one that all others are compared with first.
SMALL, HUBS = 64, 4
#: Members of a larger bucket's largest component that lines of its others meet before blocks are made, and how many of these a line is compared with.
MEMBERS, BEST = 8, 3
#: Lines outside a bucket's largest component that all of its lines are then held against by sizes and parities, which up to about so many takes less than a line's shingles do.
OUTSIDERS = 2048
#: Words of the bits that tell keys of over two lines.
FILTER_WORDS = 1 << 20
#: What line ends leave at a line's ends.
BLANKS = " \t\r\f\x0b"
UNIT = 2  # bytes of a UTF-16 unit
#: Bits kept of each MinHash value to see whether it agrees, and values in a 64-bit number.
LANE, LANES = 16, 4


def lines_of(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, doc_key, line_no from 0, norm, id): every line with a character that isn't blank; id is a hash of norm."""
    read = documents.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("doc_key"), F.posexplode(F.split(text_column, "\n")).alias("line_no", "line"))
    # Few lines have blanks to cut, which takes long to try on whole lines.
    open_ = F.ascii("line") <= 32
    for blank in BLANKS:
        open_ = open_ | F.endswith("line", F.lit(blank))
    bare = F.when(open_, F.btrim("line", F.lit(BLANKS))).otherwise(F.col("line"))
    return read.select("doc_id", "doc_key", "line_no", F.lower(bare).alias("norm")).where("norm <> ''").withColumn("id", F.xxhash64("norm"))


def place(kind: str) -> Column:
    """Where a line stands in the corpus, as one value with an order: documents by id (null last), lines by number. kind: the id's type; whole numbers compare faster in one."""
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col("line_no").alias("line"))
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit("9223372036854775808").cast("decimal(20,0)"))
    return (doc * F.lit(1 << 32).cast("decimal(11,0)") + F.col("line_no")).cast("decimal(38,0)")


class _Buckets:
    """A table written in hash buckets of its id, so that joins on it move the other side only; dropped at the end."""

    def __init__(self, df: DataFrame, scratch: Scratch) -> None:
        self.spark: SparkSession = df.sparkSession
        self.name = f"fluxmere_lines_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = scratch.folder()
        df.write.format("parquet").option("compression", "zstd").option("path", self.folder).bucketBy(n, "id").saveAsTable(self.name)

    def __enter__(self) -> DataFrame:
        return self.spark.table(self.name)

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.folder)


def _wide(norm: str) -> Column:
    """The line with two bytes for each unit, so that any shingle is reached at once."""
    return F.encode(F.col(norm), "UTF-16BE")


def _places(wide: Column) -> Column:
    """Where shingles start, in bytes from 1."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(wide) - (SHINGLE * UNIT - 1), F.lit(1)).cast("int"), F.lit(UNIT))


def _shingle(wide: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(wide, at, F.lit(SHINGLE * UNIT)))


def _exploded(lines: DataFrame, *kept: str) -> DataFrame:
    """(kept, at, h): the hash of every shingle of the rows (kept, norm), and where it starts. Rows beat arrays here: the code for them is compiled."""
    wide = lines.select(*kept, _wide("norm").alias("wide"))
    return wide.select(*kept, "wide", F.explode(_places(F.col("wide"))).alias("at")).select(*kept, "at", _shingle(F.col("wide"), F.col("at")).alias("h"))


def signatures(lines: DataFrame) -> DataFrame:
    """(id, keys, lanes): of every row (id, norm) a 64-bit key for each band, and the low bits of all MinHash values."""
    # Odd multiples of a constant whose bits are spread evenly.
    flips = [((k + 1) * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63) for k in range(BANDS * ROWS)]
    least = _exploded(lines, "id").groupBy("id").agg(*(F.min(F.col("h").bitwiseXOR(F.lit(x))).alias(f"m{k}") for k, x in enumerate(flips)))
    keys = [F.xxhash64(F.lit(b), *(F.col(f"m{b * ROWS + r}") for r in range(ROWS))) for b in range(BANDS)]
    low = [F.shiftleft(F.col(f"m{k}").bitwiseAND(F.lit((1 << LANE) - 1)), LANE * (k % LANES)) for k in range(BANDS * ROWS)]
    lanes = []
    for k in range(0, len(low), LANES):
        one = low[k]
        for x in low[k + 1 : k + LANES]:
            one = one.bitwiseOR(x)
        lanes.append(one.alias(f"lane_{k // LANES}"))
    return least.select("id", F.array(*keys).alias("keys"), F.struct(*lanes).alias("lanes"))


def _agreeing(a: str, b: str) -> Column:
    """How many MinHash values of two lines agree."""
    found = F.lit(0)
    for k in range(BANDS * ROWS):
        lane, at = f"lane_{k // LANES}", LANE * (k % LANES)
        differ = F.col(f"{a}.{lane}").bitwiseXOR(F.col(f"{b}.{lane}"))
        found = found + F.when(F.shiftright(differ, at).bitwiseAND(F.lit((1 << LANE) - 1)) == 0, 1).otherwise(0)
    return found


def _hashes(norm: str) -> Column:
    """Hashes of a line's shingles as an array. The bytes are bound to a variable: read from the row they would be copied for every shingle."""
    return F.get(F.transform(F.array(_wide(norm)), lambda wide: F.transform(_places(wide), lambda at: _shingle(wide, at))), F.lit(0))


def _looked_up(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, norm) of the lines in pairs: their ids are looked up in the streamed lines, whose texts are neither sorted nor sent."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return ids.hint("shuffle_hash").join(lines.select("id", "norm"), "id")


def _sides(table: DataFrame, *columns: str) -> list[DataFrame]:
    """The table once for either line of a pair."""
    return [table.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns)) for x in "ab"]


def _shingles(held: DataFrame, *kept: str) -> DataFrame:
    """(kept, size, h): a row for each shingle of the rows (kept, norm), once, and how many these are."""
    arrays = held.select(*kept, F.array_distinct(_hashes("norm")).alias("all"))
    return arrays.select(*kept, F.size("all").alias("size"), F.explode("all").alias("h"))


def _parities(rows: DataFrame) -> DataFrame:
    """(id, size, words): for each bit of WORDS numbers, whether an odd number of the line's shingles (id, size, h), each there once, hash to it.

    A bit in which two lines differ takes a shingle that only one of them has, so lines that differ in more bits than the
    threshold allows shingles can't reach it. Nothing that reaches it is lost.
    """
    bit, word = F.expr("shiftleft(1L, cast(h & 63 as int))"), F.shiftright("h", 6).bitwiseAND(F.lit(WORDS - 1))
    return rows.groupBy("id", "size").agg(F.struct(*(F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"w{k}") for k in range(WORDS))).alias("words"))


def _differing() -> Column:
    """In how many parities a pair's lines differ."""
    return reduce(Column.__add__, (F.bit_count(F.col(f"words_a.w{k}").bitwiseXOR(F.col(f"words_b.w{k}"))) for k in range(WORDS)))


def _close(threshold: float) -> Column:
    """Whether sizes and parities of a pair allow it to reach the threshold."""
    sized = F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-6
    return sized & (_differing() <= (1 - threshold) / (1 + threshold) * (F.col("size_a") + F.col("size_b")) + 1e-6)


def verified(pairs: DataFrame, lines: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose lines are similar enough, compared by all shingles.

    Texts travel to their pairs and are hashed there: compressed, they are smaller than even a fourth of their shingles' hashes.
    """
    texts = released(scratch.written(_looked_up(pairs, lines)))
    sides = _sides(texts, "norm")
    # Arrays first, sets of them in an operation of its own, and the filter on what is written: each is computed once and, but for the first, compiled.
    arrays = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", _hashes("norm_a").alias("x"), _hashes("norm_b").alias("y"))
    shared, either = F.size(F.array_intersect("x", "y")).alias("shared"), F.size(F.array_union("x", "y")).alias("either")
    compared = scratch.written(arrays.select("a", "b", shared, either))
    scratch.drop(texts)
    return released(compared).where(F.col("shared") >= threshold * F.col("either") - 1e-9).select("a", "b")


def linked_pairs(pairs: DataFrame, lines: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(id, component) of the lines that links among the pairs (a, b, agree) join.

    Every line meets the one before it that agrees with it in most values first. Pairs inside a component that these links make
    change nothing more; of the others those are compared that sizes and parities leave.
    """
    best = scratch.written(pairs.groupBy("b").agg(F.max_by("a", F.struct("agree", "a")).alias("a")).select("a", "b"))
    linked = components(verified(best, lines, threshold, scratch))
    of = [linked.select(F.col("id").alias(x), F.col("component").alias(f"component_{x}")) for x in "ab"]
    apart = F.coalesce("component_a", "a") != F.coalesce("component_b", "b")
    rest = scratch.written(pairs.select("a", "b").join(of[0], "a", "left").join(of[1], "b", "left").where(apart).select("a", "b").join(best, ["a", "b"], "left_anti"))
    sides = _sides(scratch.written(_parities(_shingles(_looked_up(rest, lines), "id"))), "size", "words")
    near = released(scratch.written(rest.join(sides[0], "a").join(sides[1], "b").where(_close(threshold)).select("a", "b")))
    more = verified(near, lines, threshold, scratch)
    return linked if more.isEmpty() else joined(linked, more)


def joined(linked: DataFrame, more: DataFrame) -> DataFrame:
    """(id, component) after further links (a, b)."""
    return components(linked.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")).union(more))


def _pairs_of(ids: str) -> Column:
    """All pairs (a, b) of a sorted array, as an array of structs; arrays are of bounded length."""
    return F.flatten(F.transform(F.col(ids), lambda a, k: F.transform(F.slice(F.col(ids), k + 2, F.size(ids)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def _perhaps_among(keys: DataFrame, shared: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows (id, key) whose key is among those of shared, and some others: a broadcast table of bits, FILTER_WORDS 64-bit words at most, keeps most keys of one or two lines from being sent."""
    word, bit = F.shiftright("key", 6).bitwiseAND(F.lit(FILTER_WORDS - 1)), F.expr("shiftleft(1L, cast(key & 63 as int))")
    bits = scratch.written(shared.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")))
    return keys.join(F.broadcast(bits), word == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0).select("id", "key")


def candidates(found: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b, agree), a < b: the pairs to compare first, from signatures, with how many values agree; and (key, id) of the buckets of over SMALL lines."""
    keys = found.select("id", F.explode("keys").alias("key"))
    # Most shared keys are those of two lines, which their ends tell.
    counted = released(scratch.written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n > 1")))
    shared = scratch.written(counted.where("n > 2").select("key", "n"))
    held = released(scratch.written(_perhaps_among(keys, shared, scratch).join(shared, "key").select("key", "id", "n")))
    small = held.where(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    crowded = held.where(F.col("n") > SMALL)
    picks = [F.min("id"), F.max("id"), *(F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(HUBS - 2))]
    hubs = scratch.written(crowded.groupBy("key").agg(F.array_distinct(F.array(*picks)).alias("hubs")))
    spokes = crowded.join(hubs, "key").select("id", F.explode("hubs").alias("hub")).where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    pairs = counted.where("n = 2").select("a", "b").union(small.select(F.explode(_pairs_of("ids")).alias("p")).select("p.a", "p.b")).union(spokes).distinct()
    lanes = [found.select(F.col("id").alias(x), F.col("lanes").alias(f"lanes_{x}")) for x in "ab"]
    agreed = pairs.join(lanes[0], "a").join(lanes[1], "b").select("a", "b", _agreeing("lanes_a", "lanes_b").alias("agree")).where(F.col("agree") >= AGREE)
    out = released(scratch.written(agreed))
    scratch.drop(counted, shared, hubs)
    return out, crowded.select("key", "id")


def _mixed(crowded: DataFrame, linked: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, id, component) of the lines in crowded buckets that aren't one component; a line that links to none is its own."""
    own = scratch.written(crowded.join(linked, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
    several = scratch.written(own.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key"))
    return scratch.written(own.join(several, "key"))


def _with_main(mixed: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, id, component) with the largest component of the bucket, main, and the number of lines outside it, outsiders."""
    counts = mixed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("outsiders"))
    return scratch.written(mixed.join(scratch.written(main), "key"))


def member_pairs(mixed: DataFrame, words: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: every line of the buckets (key, id, component) that isn't of a bucket's largest component, and the BEST of MEMBERS of that one's lines by sizes and parities (id, size, words).

    Most lines that link to a large component link to many of its lines, so a few comparisons leave few of them to the blocks,
    where they would meet all of its lines.
    """
    held = _with_main(mixed, scratch)
    picks = [F.min_by("id", F.xxhash64("id", "key", F.lit(k))) for k in range(MEMBERS)]
    members = scratch.written(held.where("component = main").groupBy("key").agg(F.array_distinct(F.array(*picks)).alias("members")))
    met = held.where("component <> main").join(members, "key").select(F.col("id").alias("a"), F.explode("members").alias("b")).distinct()
    sides = _sides(words, "size", "words")
    near = met.join(sides[0], "a").join(sides[1], "b").where(_close(threshold)).select("a", F.struct((_differing() / (F.col("size_a") + F.col("size_b"))).alias("far"), "b").alias("one"))
    # At most MEMBERS for each of a line's bands.
    best = near.groupBy("a").agg(F.slice(F.array_sort(F.collect_list("one")), 1, BEST).alias("best")).select("a", F.explode("best.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def outsider_pairs(held: DataFrame, words: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: every two lines of a bucket (key, id, component, main) in different components that may reach the threshold by sizes and parities (id, size, words)."""
    # A line's buckets, BANDS at most, tell which is the first that two lines share; only there they are a pair.
    buckets = held.groupBy("id").agg(F.collect_set("key").alias("keys"))
    told = scratch.written(held.join(buckets, "id").join(words, "id"))
    a, b = (told.select("key", "main", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "keys", "size", "words"))) for x in "ab")
    once = (F.col("component_b") == F.col("main")) | (F.col("id_a") < F.col("id_b"))
    first = F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key")
    met = a.where("component_a <> main").join(b.drop("main"), "key").where((F.col("component_a") != F.col("component_b")) & once & _close(threshold) & first)
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def _prefixes(left: DataFrame, rows: DataFrame, words: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(h, id, component, size, at, first, words): of the lines (id, component) with shingles (id, size, h) the rarest ones, as many as leave too few others to reach the threshold.

    at is a shingle's place in the line's order from rare to frequent, which is the same order for all lines; ones that no
    other line has are left out. first tells those that are enough to meet a line that is no smaller. words: see _parities.
    """
    often = scratch.written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("often")).where("often > 1"))
    by_line = rows.join(often, "h").groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("often", "h"))).alias("order"))
    # A little less than the products, whose rounding must not shorten a prefix.
    last, first = (F.col("size") - F.ceil(share * F.col("size") - 1e-6) for share in (threshold, 2 * threshold / (1 + threshold)))
    rare = F.col("size") - F.size("order")
    # What the prefix doesn't reach is cut off before rows are made of it.
    prefix = F.slice("order", F.lit(1), F.greatest(last - rare + 1, F.lit(0)).cast("int"))
    ranked = by_line.select("id", "size", rare.alias("rare"), first.alias("first"), F.posexplode(prefix).alias("k", "one"))
    at = F.col("rare") + F.col("k")
    kept = ranked.select(F.col("one.h").alias("h"), "id", "size", at.alias("at"), (at <= F.col("first")).alias("first"))
    return kept.join(words.select("id", "words").join(left, "id"), "id")


def block_pairs(left: DataFrame, rows: DataFrame, words: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: every two of the lines (id, component), of shingles (id, size, h) and parities, in different components that may reach the threshold.

    Of two lines that reach it the first shingle in both prefixes is the first that they share, so sizes and its places bound
    what they share. The smaller line needs a shorter prefix only, so shingles that most lines share, which come late, meet nothing.
    Parities of all shingles bound what they don't share.
    """
    rows = scratch.written(_prefixes(left, rows, words, threshold, scratch))
    counts = rows.groupBy("h", "component").agg(F.count(F.lit(1)).alias("n"))
    # Lines of a block's largest component meet the others only, so that near copies already linked aren't paired.
    blocks = scratch.written(counts.groupBy("h").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("components")).where("components > 1").select("h", "main"))
    held = scratch.written(rows.join(blocks, "h"))
    a, b = (held.select("h", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "component", "size", "at", "first", "main", "words"))) for x in "ab")
    a = a.where("component_a <> main_a")
    shared = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    enough = shared >= threshold / (1 + threshold) * (F.col("size_a") + F.col("size_b")) - 1e-6
    once = (F.col("component_b") == F.col("main_b")) | (F.col("id_a") < F.col("id_b"))
    larger = (F.col("size_a") > F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("id_a") > F.col("id_b")))
    meet = (F.col("component_a") != F.col("component_b")) & once & enough & _close(threshold)
    met = a.where("first_a").join(b, "h").where(~larger & meet).select("id_a", "id_b").union(a.join(b.where("first_b"), "h").where(larger & meet).select("id_a", "id_b"))
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def line_components(lines: DataFrame, threshold: float = THRESHOLD, scratch: Scratch | None = None, exact: bool = False) -> DataFrame:
    """(id, component) of the lines (id, norm) that link to others. exact: every line goes through the blocks of rare shingles, without bands."""
    if scratch is None:
        with Scratch(lines.sparkSession) as own:
            return line_components(lines, threshold, own, exact)
    if exact:
        rows = scratch.written(_shingles(lines.select("id", "norm"), "id"))
        words = scratch.written(_parities(rows))
        pairs = scratch.written(block_pairs(lines.select("id", F.col("id").alias("component")), rows, words, threshold, scratch))
        return components(verified(pairs, lines, threshold, scratch))
    with _Buckets(signatures(lines), scratch) as found:  # so that only pairs travel to the values they are told by
        pairs, crowded = candidates(found, scratch)
    linked = linked_pairs(pairs, lines, threshold, scratch)
    if crowded.isEmpty():
        return linked
    mixed = _mixed(crowded, linked, scratch)
    if mixed.isEmpty():
        return linked
    words = scratch.written(_parities(_shingles(mixed.select("id").distinct().hint("shuffle_hash").join(lines.select("id", "norm"), "id"), "id")))
    more = verified(scratch.written(member_pairs(mixed, words, threshold, scratch)), lines, threshold, scratch)
    if not more.isEmpty():
        linked = joined(linked, more)
        mixed = _mixed(mixed.select("key", "id"), linked, scratch)
        if mixed.isEmpty():
            return linked
    held = _with_main(mixed, scratch)
    pairs = scratch.written(outsider_pairs(held.where(F.col("outsiders") <= OUTSIDERS), words, threshold, scratch))
    left = scratch.written(held.where(F.col("outsiders") > OUTSIDERS).select("id", "component").distinct())
    if not left.isEmpty():
        rows = scratch.written(_shingles(left.select("id").hint("shuffle_hash").join(lines.select("id", "norm"), "id"), "id"))
        pairs = scratch.written(pairs.union(block_pairs(left, rows, words, threshold, scratch)).distinct())
    more = verified(released(pairs), lines, threshold, scratch)
    return linked if more.isEmpty() else joined(linked, more)


def removed_lines(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """(doc_id, doc_key, removed): for every document that loses lines their numbers, from 0, in order.

    doc_key is xxhash64 of the text; with the id it tells rows apart.
    """
    every = lines_of(documents, id_column, text_column)
    at = place(dict(every.dtypes)["doc_id"])
    distinct = every.groupBy("id").agg(F.min(at).alias("place"), F.count(F.lit(1)).alias("n"), F.first("norm").alias("norm"))
    with Scratch(documents.sparkSession) as scratch, _Buckets(distinct, scratch) as held:
        lines = released(held)
        found = line_components(lines, threshold, scratch, exact)
        firsts = lines.select("id", "place", "n")
        kept = scratch.written(firsts.join(found, "id").groupBy("component").agg(F.min("place").alias("kept")))
        linked = found.join(kept, "component").select("id", "kept")
        # Lines that occur once and link to none stay where they are.
        touched = scratch.written(firsts.join(linked, "id", "left").where("n > 1 or kept is not null").select("id", F.coalesce("kept", "place").alias("kept")))
        out = every.select("id", "doc_id", "doc_key", "line_no").join(touched, "id").where(at != F.col("kept"))
        return written(out.groupBy("doc_id", "doc_key").agg(F.array_sort(F.collect_set("line_no")).alias("removed")))


def dedup_lines(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, exact: bool = False, drop_emptied: bool = False) -> DataFrame:
    """The columns of documents, the text without lines that repeat an earlier one or nearly so.

    Defined results: blank lines, null and empty texts stay as they are; documents come in the order of
    their ids, of any type with an order, null last; lines at the same place of rows that repeat an id are told apart by neither, and
    both stay. exact finds links without bands. drop_emptied leaves out documents that had lines and have lost them all.
    """
    names = documents.columns
    renamed = documents.toDF(*(f"in_{k}" for k in range(len(names))))
    text, key = f"in_{names.index(text_column)}", f"in_{names.index(id_column)}"
    removed = removed_lines(documents, id_column=id_column, text_column=text_column, threshold=threshold, exact=exact)
    joined = renamed.join(removed, F.col(key).eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("doc_key")), "left")
    # Bound to a variable, the text is split once.
    left = F.get(F.transform(F.array(F.split(text, "\n")), lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed")), lambda k: F.get(lines, k))), F.lit(0))
    out = joined.withColumn("left_text", F.when(F.col("removed").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")))
    if drop_emptied:
        out = out.where(F.col("removed").isNull() | (F.btrim("left_text", F.lit(BLANKS + "\n")) != ""))
    return out.select(*(F.col("left_text" if c == text_column else f"in_{k}").alias(c) for k, c in enumerate(names)))


def line_report(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of documents: id, n_lines (0 for a null text), n_kept and removed_lines (numbers from 0)."""
    removed = removed_lines(documents, id_column=id_column, text_column=text_column, threshold=threshold)
    breaks = F.octet_length(text_column) - F.octet_length(F.replace(F.col(text_column), F.lit("\n"), F.lit("")))
    counted = documents.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("key"), F.coalesce(breaks + 1, F.lit(0)).cast("bigint").alias("n_lines"))
    joined = counted.join(removed, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("doc_key")), "left")
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select(F.col("id").alias(id_column), "n_lines", (F.col("n_lines") - F.size(gone)).alias("n_kept"), gone.alias("removed_lines"))
