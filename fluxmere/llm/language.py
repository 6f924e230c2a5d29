"""Language identification by prediction by partial matching over bytes.

Every language has a context tree of up to ORDER bytes. In a context of n occurrences with d
different successors, a known byte that came c times has probability c / (n + d), and d / (n + d) is
that of an escape to the context shortened by its first byte, where the bytes already ruled out are
excluded; below the empty context stand the bytes never seen, all alike. Statistics are frozen after
training, so a text's code length is a sum over its positions. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .backoff import Coder, Table, bounded_sample, gram_counts
from .common import GROUP_CHARS, bounded_batches, give_back, groups_of

#: Longest context in bytes.
ORDER = 4
#: Texts of every language that the trees are fitted on, at most (about); a bounded sample chosen by a hash of the id.
SAMPLE = 1000
UNKNOWN = "und"


def ppm_coder(counts: pa.Table, order: int = ORDER) -> Coder:
    """Full costs of all n-grams that any language has, with exclusion, from (model, size, gram, n)."""
    models = sorted(set(counts.column("model").to_pylist()))
    place = {m: k for k, m in enumerate(models)}
    of = np.array([place[m] for m in counts.column("model").to_pylist()], np.int64)
    size, gram, n = (counts.column(c).to_numpy() for c in ("size", "gram", "n"))
    coder = Coder(models, np.zeros(len(models)))
    full_keys, full = np.zeros(0, np.int64), np.zeros((0, len(models)))
    below_keys, below_n = np.zeros(0, np.int64), np.zeros((0, len(models)))
    below_total = below_kinds = np.zeros((0, len(models)))
    below_contexts = np.zeros(0, np.int64)
    for k in range(order + 1):
        mine = size == k + 1
        keys = np.unique(gram[mine])
        seen = np.zeros((len(keys), len(models)))
        seen[np.searchsorted(keys, gram[mine]), of[mine]] = n[mine]
        contexts, group = np.unique(keys >> 8, return_inverse=True)
        total, kinds, ruled_out = (np.zeros((len(contexts), len(models))) for _ in range(3))
        np.add.at(total, group, seen)
        np.add.at(kinds, group, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            if k == 0:
                # An escape from the empty context leads to the bytes never seen.
                coder.base = np.log2(256 - kinds[0]).clip(0) - np.log2(kinds[0] / (total[0] + kinds[0])) if len(contexts) else np.full(len(models), 8.0)
                leave = None
            else:
                short = keys & ((1 << (8 * k)) - 1)
                at = np.searchsorted(below_keys, short)
                np.add.at(ruled_out, group, np.where(seen > 0, below_n[at], 0))
                c = np.searchsorted(below_contexts, contexts & ((1 << (8 * (k - 1))) - 1))
                room = below_total[c] + below_kinds[c]
                leave = np.where(total > 0, -np.log2(kinds / (total + kinds)) + np.log2((room - ruled_out) / room), 0.0)
            own = -np.log2(seen / (total + kinds)[group])
        if k == 0:
            full = np.where(seen > 0, own, coder.base)
        else:
            full = np.where(seen > 0, own, leave[group] + full[np.searchsorted(full_keys, short)])
        full_keys = keys
        coder.grams.append(Table.of(keys, full))
        coder.leave.append(None if leave is None else Table.of(contexts, leave))
        below_keys, below_n, below_contexts, below_total, below_kinds = keys, seen, contexts, total, kinds
    return coder


def fit(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", order: int = ORDER, sample: int = SAMPLE) -> Coder | None:
    """Trees from the rows of documents with a text and a language; None if there are none.

    At most about `sample` texts of a language are used, whole; what comes to the driver are the
    n-gram counts of that sample.
    """
    rows = documents.where(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull() & (F.col(text_column) != ""))
    rows = rows.select(F.col(id_column).alias("id"), F.col(lang_column).alias("model"), F.col(text_column).alias("text"))
    counts = gram_counts(bounded_sample(rows, "model", "id", sample), order).toArrow()
    return ppm_coder(counts, order) if counts.num_rows else None


def identify(documents: DataFrame, coder: Coder | None, *, text_column: str = "text") -> DataFrame:
    """documents with lang_pred, score (0 to 1) and lang_bits, the code's bits for a byte of the text.

    score: the predicted language's share when every language weighs two to the power of minus its
    code length. Null texts, empty texts and those without a letter get `und`, score 0 and null
    lang_bits, as does every text if nothing was learned; ties go to the language that sorts first.
    Only the text is read.
    """
    kept = documents.columns
    model = documents.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model.value
        for batch in batches:
            texts = batch.column(kept.index(text_column)).to_pylist()
            for a, b in groups_of(texts, GROUP_CHARS):
                part = batch.slice(a, b - a)
                names, scores, rates = [UNKNOWN] * (b - a), np.zeros(b - a), [None] * (b - a)
                own = [k for k, x in enumerate(texts[a:b]) if x and coder and any(map(str.isalpha, x))]
                if own:
                    raw = [texts[a + k].encode("utf-8", "surrogatepass") for k in own]
                    bits = coder.costs(raw)
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(own)), best]
                    share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
                    for k, m, p, total, x in zip(own, best.tolist(), share.tolist(), least.tolist(), raw, strict=True):
                        names[k], scores[k], rates[k] = coder.models[m], p, total / len(x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(rates, pa.float64())], names=[*kept, "lang_pred", "score", "lang_bits"])
        give_back()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return bounded_batches(documents).mapInArrow(run, f"{fields}, lang_pred string, score double, lang_bits double")


def held_out(id_column: str = "doc_id"):
    """Documents that no model is fitted on: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict_languages(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", order: int = ORDER, sample: int = SAMPLE) -> DataFrame:
    """id, held_out, lang_pred, score and lang_bits of every row, by trees fitted on the rows that aren't held out."""
    coder = fit(documents.where(~held_out(id_column)), id_column=id_column, text_column=text_column, lang_column=lang_column, order=order, sample=sample)
    found = identify(documents.select(id_column, text_column), coder, text_column=text_column)
    return found.select(id_column, held_out(id_column).alias("held_out"), "lang_pred", "score", "lang_bits")


def reject_unknown(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", order: int = ORDER, sample: int = SAMPLE) -> DataFrame:
    """documents without those of no language: `und`, or no language's code is shorter than the raw text (8 bits a byte).

    A null language is filled with the predicted one; columns stay as they are otherwise.
    """
    coder = fit(documents.where(~held_out(id_column)), id_column=id_column, text_column=text_column, lang_column=lang_column, order=order, sample=sample)
    keep = documents.columns
    found = identify(documents.toDF(*(f"in_{k}" for k in range(len(keep)))), coder, text_column=f"in_{keep.index(text_column)}")
    kept = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_bits") < 8))
    return kept.select(*(F.coalesce(f"in_{k}", "lang_pred").alias(c) if c == lang_column else F.col(f"in_{k}").alias(c) for k, c in enumerate(keep)))
