"""The pipeline's stages on each other's results, each against a slow version of its own."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest

import corpus_pipeline
import test_lines
import test_simhash
from fluxmere.llm.common import words, written
from fluxmere.llm.language import UNKNOWN, predict_languages

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, sizes = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA))
        sizes.append(docs.count())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == names
    assert sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] <= sizes[2] and sizes[5] == sizes[4]
    assert {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(docs.columns)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_stages_like_slow_versions(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    held = [sorted(map(tuple, docs.collect()), key=repr)]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA))
        held.append(sorted(map(tuple, docs.select([c for c in docs.columns if c not in ("ids",)]).collect()), key=repr))
    names = spark.read.parquet(f"{DATA}/documents.parquet").columns
    at = {c: k for k, c in enumerate(names)}

    # Language ID: documents of no language go, no other does.
    unknown = {r.doc_id for r in predict_languages(spark.read.parquet(f"{DATA}/documents.parquet")).where(f"lang_pred = '{UNKNOWN}'").collect()}
    assert {r[at["doc_id"]] for r in held[0]} - {r[at["doc_id"]] for r in held[1]} <= unknown

    # Line dedup: every line that repeats an earlier one or nearly, and documents without a line left, go.
    rows = [(r[at["doc_id"]], r[at["text"]]) for r in held[1]]
    gone = test_lines.expected(rows)
    want = {}
    for doc, text in rows:
        left = [x for no, x in enumerate((text or "").split("\n")) if (doc, no) not in gone]
        if any(x.strip() for x in left) or not any((doc, no) in gone for no in range(len((text or "").split("\n")))):
            want[doc] = "\n".join(left) if text is not None else None
    found = {r[at["doc_id"]]: r[at["text"]] for r in held[2]}
    assert sum(found.get(k) == v for k, v in want.items()) >= 0.99 * len(want) and found.keys() <= want.keys()
    assert all(r[at["n_chars"]] == len(r[at["text"]]) for r in held[2] if r[at["text"]] is not None)

    # SimHash near-dedup: the smallest id of each component of fingerprints stays.
    prints = {r[at["doc_id"]]: test_simhash.slow_fingerprint(r[at["text"]]) for r in held[2]}
    values = sorted(set(prints.values()))
    root = test_simhash.union_find(values, [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 4])
    least = {}
    for doc, value in prints.items():
        least[root[value]] = min(doc, least.get(root[value], doc))
    assert sorted(r[at["doc_id"]] for r in held[3]) == sorted(least.values())

    # Mixing: words come near the targets, no document more than twice, none changed.
    size = lambda r: len(words(r[at["text"]]))
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in held[3]:
        sizes[r[at["source"]]] += size(r)
        most[r[at["source"]]] = max(most[r[at["source"]]], size(r))
    for r in held[4]:
        taken[r[at["source"]]] += size(r)
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: (3, 1, 2)[k % 3] for k, x in enumerate(order)}
    full = {}
    while True:
        free = [x for x in order if x not in full]
        left = 1.5 * sum(sizes.values()) - sum(full.values())
        target = {x: left * weight[x] / sum(weight[y] for y in free) for x in free}
        over = [x for x in free if target[x] > 2 * sizes[x]]
        if not over:
            break
        full |= {x: 2.0 * sizes[x] for x in over}
    for x, t in (full | target).items():
        assert abs(taken[x] - t) <= most[x]
    copies = Counter(held[4])
    assert set(copies) <= set(held[3]) and max(copies.values()) <= 2

    # BPE: what the library gives.
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.no_truncation()
    whole.no_padding()
    names = [c for c in docs.columns if c != "ids"]
    texts = {r[at["doc_id"]]: r[at["text"]] or "" for r in held[4]}
    for r in held[5]:
        row = dict(zip(names, r, strict=True))
        ids = whole.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, ""))
    assert docs.count() == 0
