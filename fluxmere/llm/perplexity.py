"""Quality classifier: interpolated modified Kneser-Ney over byte n-grams, trained on trusted text.

Counts of the trusted texts live in a table sharded by hash. Continuation counts, context totals and
discounts are aggregates of it, and the probability of every known n-gram comes from joins of n-grams with
their contexts and with the n-grams one byte shorter. Documents are scored by joining the counts of their n-grams with that table,
backing off a byte at a time where it has none; a table of up to MOST_ROWS rows is broadcast instead and looked up where
texts are read, which gives the same code lengths and moves no n-grams. A document's perplexity is compared with a quantile of
the trusted texts of its language that the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .backoff import Coder, Table, gram_counts
from .common import GROUP_CHARS, Scratch, bounded_batches, give_back, groups_of, written

#: Longest context in bytes.
ORDER = 4
#: A document goes if its perplexity is over this quantile of unseen trusted texts of its language.
QUANTILE = 0.99
#: Fewer unseen texts than 1 / (1 - quantile) have none beyond it: their largest, which tells too little, is taken times FEW.
FEW = 1.6
#: Bytes of average trusted text that each document is taken to have besides its own: a few words alone tell little.
PRIOR = 16
#: Bytes of a text whose n-grams are counted at once.
CHUNK = 1 << 20
#: Rows of the tables of n-grams and contexts that are broadcast; some 30 bytes each. Larger ones are joined.
MOST_ROWS = 4_000_000
#: Words of the bits that tell texts that can't be trusted; at 60 million bits, 4 million ids leave some 6 of 100 others in.
FILTER_WORDS = 1 << 20


def _adjusted(counts: DataFrame, order: int) -> DataFrame:
    """(model, size, gram, c): raw counts for the longest n-grams; for others, how many bytes stand before them, 1 at least."""
    out = counts.where(F.col("size") == order + 1).select("model", "size", "gram", F.col("n").alias("c"))
    for size in range(1, order + 1):
        mask = F.lit((1 << (8 * size)) - 1)
        before = counts.where(F.col("size") == size + 1).groupBy("model", F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count(F.lit(1)).alias("before"))
        own = counts.where(F.col("size") == size).select("model", "size", "gram")
        out = out.union(own.join(before, ["model", "gram"], "left").select("model", "size", "gram", F.coalesce("before", F.lit(1)).alias("c")))
    return out


def _discounts(adjusted: DataFrame) -> DataFrame:
    """(model, size, d1, d2, d3) from how many n-grams have adjusted counts of 1 to 4."""
    n = [F.sum(F.when(F.col("c") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))

    def d(k: int):
        # Tables too small to tell get half the count's last unit.
        exact = k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0))
        return F.greatest(F.lit(0.05), F.least(F.coalesce(exact, F.lit(k - 0.5)), F.lit(k - 0.05))).alias(f"d{k}")

    return adjusted.groupBy("model", "size").agg(*n).select("model", "size", d(1), d(2), d(3))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(model, size, gram, bits) of all known n-grams and (model, size, context, bits) of leaving their contexts."""
    adjusted = written(_adjusted(counts, order))
    discounted = adjusted.join(written(_discounts(adjusted)), ["model", "size"])
    off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    own = discounted.withColumn("context", F.shiftright("gram", 8)).withColumn("off", off)
    contexts = written(own.groupBy("model", "size", "context").agg(F.sum("c").alias("total"), (F.sum("off") / F.sum("c")).alias("leave")))
    joined = written(own.join(contexts, ["model", "size", "context"]).select("model", "size", "gram", ((F.col("c") - F.col("off")) / F.col("total")).alias("p"), "leave"))
    grams = below = None
    for size in range(1, order + 2):
        at = joined.where(F.col("size") == size)
        if below is None:
            at = at.withColumn("lower", F.lit(1 / 256))
        else:
            at = at.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << (8 * (size - 1))) - 1))).join(below.select("model", F.col("gram").alias("short"), F.col("q").alias("lower")), ["model", "short"])
        below = written(at.select("model", "size", "gram", (F.col("p") + F.col("leave") * F.col("lower")).alias("q")))
        grams = below if grams is None else grams.union(below)
    return grams.select("model", "size", "gram", (-F.log2("q")).alias("bits")), contexts.select("model", "size", "context", (-F.log2("leave")).alias("bits"))


def coders(grams: pa.Table, contexts: pa.Table, order: int) -> dict[str, Coder]:
    """A coder for each model."""
    out = {}
    columns = [{c: t.column(c).to_numpy(zero_copy_only=False) for c in t.column_names} for t in (grams, contexts)]
    for model in sorted(set(columns[0]["model"])):
        g, c = ({k: v[t["model"] == model] for k, v in t.items()} for t in columns)
        coder = Coder([model], np.array([8.0]))
        for size in range(1, order + 2):
            own = g["size"] == size
            coder.grams.append(Table.of(g["gram"][own], g["bits"][own][:, None]))
            at = c["size"] == size
            coder.leave.append(Table.of(c["context"][at], c["bits"][at][:, None]))
            if size == 1:
                # The empty context is always there: a byte never seen costs leaving it and one of 256.
                coder.base = np.array([8.0 + (c["bits"][at][0] if at.any() else 0.0)])
                coder.leave[0] = None
        out[model] = coder
    return out


def score(documents: DataFrame, models: dict[str, Coder], *, text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """documents without the text, with model, n_bytes and bits: the code length by the model of the document's language.

    A document of no language, or of one without a model, takes the model with the shortest code. Texts without a byte have null bits.
    """
    kept = [c for c in documents.columns if c != text_column]
    held = documents.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = held.value
        for batch in batches:
            place = batch.schema.get_field_index
            texts, langs = batch.column(place(text_column)).to_pylist(), batch.column(place(lang_column)).to_pylist()
            for a, b in groups_of(texts, GROUP_CHARS):
                raw = [x.encode("utf-8", "surrogatepass") if x else b"" for x in texts[a:b]]
                best: list = [None] * (b - a)
                bits = np.full(b - a, np.inf)
                for name, coder in models.items():
                    own = np.array([k for k, lang in enumerate(langs[a:b]) if raw[k] and (lang == name or lang not in models)], np.int64)
                    if len(own):
                        found = coder.costs([raw[k] for k in own])[:, 0]
                        for k in own[found < bits[own]].tolist():
                            best[k] = name
                        bits[own] = np.minimum(bits[own], found)
                part = batch.slice(a, b - a)
                columns = [part.column(place(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.string()), pa.array(list(map(len, raw)), pa.int64()), pa.array([x if np.isfinite(x) else None for x in bits.tolist()], pa.float64())], names=[*kept, "model", "n_bytes", "bits"])
        give_back()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields if f.name in kept)
    return bounded_batches(documents).mapInArrow(run, f"{fields}, model string, n_bytes bigint, bits double")


def _own_grams(documents: DataFrame, order: int) -> DataFrame:
    """(row, size, gram, n): how often each n-gram of order + 1 bytes, fewer at a text's start, stands in a row's text; summed for each text before it is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int64) if text else np.zeros(0, np.int64)
                for a in range(0, len(data), CHUNK):
                    key = data[max(0, a - order) : a + CHUNK]
                    back, whole = min(a, order), key
                    for k in range(1, order + 1):
                        whole = whole.copy()
                        whole[k:] += key[:-k] << (8 * k) if len(key) > k else 0
                    size = np.minimum(np.arange(back, len(key)) + (a - back), order) + 1
                    grams, n = np.unique(np.stack((size, whole[back:])), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row, np.int64)), pa.array(grams[0]), pa.array(grams[1]), pa.array(n)], names=["row", "size", "gram", "n"])
        give_back()

    return bounded_batches(documents).select("row", "text").mapInArrow(run, "row bigint, size bigint, gram bigint, n bigint")


def score_by_joins(documents: DataFrame, grams: DataFrame, contexts: DataFrame, scratch: Scratch, *, text_column: str = "text", lang_column: str = "lang", order: int = ORDER) -> DataFrame:
    """What score() gives, by joins: counted n-grams of the texts meet the table, what it doesn't know pays for leaving its context and comes back a byte shorter."""
    kept = [c for c in documents.columns if c != text_column]
    rows = scratch.written(documents.withColumn("row", F.monotonically_increasing_id()))
    models = scratch.written(grams.select("model").distinct())  # a row for each language
    texts = rows.select("row", F.col(text_column).alias("text"))
    own = rows.select("row", F.col(lang_column).alias("lang")).join(F.broadcast(models.withColumn("lang", F.col("model")).withColumnRenamed("model", "known")), "lang", "left")
    every = F.broadcast(models.agg(F.collect_list("model").alias("models")))
    asked = scratch.written(own.join(every).select("row", F.explode(F.when(F.col("known").isNotNull(), F.array("known")).otherwise(F.col("models"))).alias("model")))
    counted = scratch.written(_own_grams(texts, order).groupBy("row", "size", "gram").agg(F.sum("n").alias("n")).join(asked, "row"))
    cost = F.col("bits").cast("decimal(38,9)") * F.col("n")
    paid, left = [], None
    for size in range(order + 1, 0, -1):
        at = counted.where(F.col("size") == size).select("row", "model", "gram", "n")
        if left is not None:
            at = at.union(left).groupBy("row", "model", "gram").agg(F.sum("n").alias("n"))
        met = scratch.written(at.join(grams.where(F.col("size") == size).select("model", "gram", "bits"), ["model", "gram"], "left"))
        paid.append(met.where("bits is not null").select("row", "model", cost.alias("cost")))
        unknown = met.where("bits is null").select("row", "model", "gram", "n", F.shiftright("gram", 8).alias("context"))
        leave = unknown.join(contexts.where(F.col("size") == size).select("model", "context", "bits"), ["model", "context"], "left").select("row", "model", "gram", "n", F.coalesce("bits", F.lit(0.0)).alias("bits"))
        paid.append(leave.select("row", "model", cost.alias("cost")))
        left = unknown.select("row", "model", F.col("gram").bitwiseAND(F.lit((1 << (8 * (size - 1))) - 1)).alias("gram"), "n")
    # A byte that the model never saw: one of 256.
    paid.append(left.select("row", "model", (F.lit(8) * F.col("n")).cast("decimal(38,9)").alias("cost")))
    sums = scratch.written(reduce(DataFrame.union, [x.groupBy("row", "model").agg(F.sum("cost").alias("cost")) for x in paid]).groupBy("row", "model").agg(F.sum("cost").cast("double").alias("bits")))
    best = sums.groupBy("row").agg(F.min(F.struct("bits", "model")).alias("best"))
    found = rows.join(best, "row", "left")
    length = F.coalesce(F.octet_length(text_column), F.lit(0)).cast("bigint")
    return found.select(*kept, F.col("best.model").alias("model"), length.alias("n_bytes"), F.col("best.bits").alias("bits"))


def unseen(id_column: str):
    """Trusted texts that thresholds are taken from: a fifth, by the id's crc32."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _maybe_trusted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, text, ...) without most of those whose id isn't among ids, so that few texts are sent to the join.

    A bounded table of bits, FILTER_WORDS 64-bit words, one bit set by the hash of each id, is broadcast; it lets some rows more
    through, and none of ids out. Types that may be equal without equal hashes pass whole.
    """
    kind = dict(rows.dtypes)["id"]
    if dict(ids.dtypes)["trusted_id"] != kind or kind not in ("string", "tinyint", "smallint", "int", "bigint", "date"):
        return rows

    def word(c: str) -> Column:
        return F.pmod(F.shiftright(F.xxhash64(c), 6), F.lit(FILTER_WORDS))

    def bit(c: str) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.xxhash64(c).bitwiseAND(F.lit(63)).cast("int"))

    bits = written(ids.groupBy(word("trusted_id").alias("word")).agg(F.bit_or(bit("trusted_id")).alias("bits")))
    return rows.join(F.broadcast(bits), word("id") == F.col("word")).where(F.col("bits").bitwiseAND(bit("id")) != 0).drop("word", "bits")


def _trusted(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows (id, text, ...) whose id is among ids, which are distinct. Not a semi-join, which Spark would put before the filter by bits."""
    return _maybe_trusted(rows, ids).join(ids, F.col("id") == F.col("trusted_id")).drop("trusted_id")


def classify(documents: DataFrame, trusted: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", order: int = ORDER, quantile: float = QUANTILE, prior: int = PRIOR, most_rows: int = MOST_ROWS) -> DataFrame:
    """A row for each row of documents: id, lang, model, n_bytes, perplexity (a byte), judged (the same with the prior), threshold and kept.

    trusted: one column, the ids of trusted documents. Defined results: a null or empty text has a null perplexity
    and isn't kept; without any trusted text, or without unseen ones of a language, nothing of
    it is known and every text with a byte is kept; repeated rows get equal results; null ids are never trusted.
    """
    ids = written(trusted.toDF("trusted_id").where("trusted_id is not null").distinct())
    rows = documents.select(F.col(id_column).alias("id"), F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    fit = _trusted(rows.where(~unseen("id") & F.col("lang").isNotNull() & (F.col("text") != "")), ids).select(F.col("lang").alias("model"), "text")
    with Scratch(documents.sparkSession) as scratch:
        grams, contexts = (scratch.written(x) for x in kneser_ney(scratch.written(gram_counts(fit, order)), order))
        if grams.count() + contexts.count() <= most_rows:
            scored = score(rows, coders(grams.toArrow(), contexts.toArrow(), order))
        else:
            scored = score_by_joins(rows, grams, contexts, scratch, order=order)
        rate = F.when(F.col("bits").isNotNull(), F.pow(F.lit(2.0), F.col("bits") / F.col("n_bytes")))
        scored = written(scored.withColumn("perplexity", rate))
    seen = scored.where(unseen("id") & F.col("perplexity").isNotNull()).join(ids, F.col("id") == F.col("trusted_id"), "left_semi")
    # Sums of doubles depend on their order; of decimals they don't.
    usual = written(seen.groupBy("model").agg((F.sum(F.col("bits").cast("decimal(28,6)")) / F.sum("n_bytes")).cast("double").alias("usual")))

    def judged(df: DataFrame) -> DataFrame:
        smooth = (F.col("bits") + prior * F.col("usual")) / (F.col("n_bytes") + prior)
        return df.join(usual, "model", "left").withColumn("judged", F.pow(F.lit(2.0), smooth))

    few = F.when(F.count("judged") * (1 - quantile) < 1 - 1e-9, F.lit(FEW)).otherwise(F.lit(1.0))
    limits = written(judged(seen).groupBy("model").agg((F.percentile_approx("judged", quantile, 10_000) * few).alias("threshold")))
    kept = (F.col("n_bytes") > 0) & F.coalesce(F.col("judged") <= F.col("threshold"), F.lit(True))
    return judged(scored).join(limits, "model", "left").select(F.col("id").alias(id_column), F.col("lang").alias(lang_column), "model", "n_bytes", "perplexity", "judged", "threshold", kept.alias("kept"))
