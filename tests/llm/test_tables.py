"""WARC, BPE, top-k and mixing."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from fluxmere.llm import bpe, warc
from fluxmere.llm.mixing import mix_sources, mixed, source_targets
from fluxmere.llm.topk import search, top_k

# WARC.

PAGES = [(1, "http://a/", "<p>é</p>"), (2, "http://b/\r\nX: y", "<p>é</p>"), (3, None, None), (4, "http://d/", ""), (5, "http://e/", "x" * 300_000), (6, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n"), (6, "u", "twice"), (6, "u", "twice"), (None, "n", "<p>é</p>"), (None, "n", "alone")]


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id bigint, url string, html string, record_type string").repartition(3)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=repr)
    kinds = {2: ("revisit", 1), 4: ("revisit", 3)}
    want = [(i, len((h or "").encode()), b32(h), *(kinds.get(i, ("response", None)) if i is not None else (("revisit", 1) if h == "<p>é</p>" else ("response", None)))) for i, _, h in PAGES]
    assert got == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("compress", ["gzip", "none"])
@pytest.mark.parametrize("split", [200, 5000, 1 << 25])
def test_ranges_find_every_record_once(spark, tmp_path, compress, split):
    rng = random.Random(3)
    rows = [(k, f"http://x/{k}", "".join(rng.choices("abc <>\r\n", k=rng.randint(0, 900)))) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(2)
    path = str(tmp_path / "w")
    warc.write_archives(warc.archived(df), path, compress=compress)
    got = warc.read_archives(spark, path, split=split, verify="true")
    assert sorted((int(r.row_id), bytes(r.payload).decode()) for r in got.select("row_id", "payload").collect()) == [(k, h) for k, _, h in rows]


def test_revisits_name_their_record(spark, tmp_path):
    """By the standard's own headers, so that other readers find it; ids may be any text."""
    rows = [("p/ü 1", "http://x/1", "same"), ("p%20\r\n2", "http://x/2", "same"), ("q", None, "same"), ("r", "http://x/4", "other")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archives(warc.archived(df), path)
    got = {r.row_id: r for r in warc.read_archives(spark, path).collect()}
    assert set(got) == {i for i, _, _ in rows}
    first = min(i for i, _, h in rows if h == "same")
    uri = dict((i, u) for i, u, _ in rows)[first]
    for i, _, h in rows:
        if h == "same" and i != first:
            assert (got[i].record_type, got[i].refers_to, got[i].refers_to_row_id) == ("revisit", got[first].record_id, first)
            assert (got[i].headers["warc-refers-to-target-uri"], got[i].headers["warc-refers-to-date"]) == (uri, got[first].date)
    assert warc.read_archives(spark, path).where(F.col("row_id") == "p%20\r\n2").count() == 1
    assert sorted(r.page_id for r in warc.round_trip(df).collect()) == sorted(i for i, _, _ in rows)


def test_predicates_skip_payloads(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(k, f"http://x/{k}", f"page {k % 3}") for k in range(12)], "page_id bigint, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    warc.write_archives(warc.archived(df), path)
    every = warc.read_archives(spark, path)
    assert every.where("record_type = 'revisit'").count() == 9
    assert every.where("target_uri like 'http://x/1%' and record_type in ('response')").select("row_id").collect() == [("1",)]
    assert warc.read_archives(spark, path, types="response", payload="false").where("payload is null").count() == 3
    # In the reader itself: what fails is skipped without inflating it.
    reader = warc.WarcReader({"path": path, "types": "revisit"}, None)
    parts = reader.partitions()
    monkeypatch.setattr(warc._Gzip, "_rest", lambda *a, **k: pytest.fail("inflated"))
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 9


def test_foreign_gzip(spark, tmp_path):
    """Members without the length in their header."""
    import gzip

    data = b"".join(gzip.compress(warc.record(str(k), "response", "u", b"p" * k, None, "d")) for k in (1, 70_000, 3))
    (tmp_path / "f.warc.gz").write_bytes(data)
    got = warc.read_archives(spark, str(tmp_path / "f.warc.gz"), verify="true").collect()
    assert sorted(r.payload_bytes for r in got) == [1, 3, 70_000]
    assert isinstance(warc.file_system("file:///tmp")[0], pafs.LocalFileSystem)


# BPE.

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(3)
    return [
        "", None, " ", "<|endoftext|>", "a<|startoftext|>B  c<|endoftext|>", "é" * 300, "don't we'll I'd " * 50, "'ll'll'd''" * 60, "x" * 1500, "".join(rng.choice("abcdefghij klmno'") for _ in range(900)), "ß" * 700 + " Aé1" * 99,
        "İ" * 200, "".join(rng.choice("etaoin") for _ in range(2500)), "日本語" * 300, "　 \x1c\x85 a​b" * 60, "1234567890" * 90, "#$%&!!!***" * 90, "ΑΣ Σ ς", "é x", "the the the", "the the the",
    ]


@pytest.mark.parametrize(("piece", "word"), [(64, 16), (300, 100), (4096, 4096)])
def test_bpe_like_library(piece, word):
    coder = bpe.TreeEncoder(PATH, piece, word)
    texts = odd_texts()
    for text, (ids, decoded) in zip(texts, coder.encode_decode(texts), strict=True):
        want = coder.whole.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded.decode("utf-8", "surrogatepass") == coder.whole.decode(want, skip_special_tokens=False)


def test_a_window_that_disagrees_grows(monkeypatch):
    """Where the outermost ids of a window are not those of the side, it reaches further; a join that never looked would be wrong."""
    coder = bpe.TreeEncoder(PATH, 64)
    text = " ".join(f"word{k} und{k}so" for k in range(60))
    seen = []
    agree = bpe.TreeEncoder._agree

    def reluctant(self, one, other):
        seen.append(len(seen))
        return len(seen) > 3 and agree(self, one, other)

    monkeypatch.setattr(bpe.TreeEncoder, "_agree", reluctant)
    assert coder.encode([text])[0].tolist() == coder.whole.encode(text, add_special_tokens=False).ids
    assert len(seen) > 3


def test_word_joins_compare_tokens():
    """Pieces cut at any place join to what the whole word gives; gluing them together wouldn't."""
    coder = bpe.TreeEncoder(PATH, 4096, 16)
    word = "internationalisierung" * 12
    assert coder.encode([word])[0].tolist() == coder.whole.encode(word, add_special_tokens=False).ids
    glued = [i for k in range(0, len(word), 16) for i in coder.whole.encode(word[k : k + 16], add_special_tokens=False).ids]
    assert glued != coder.whole.encode(word, add_special_tokens=False).ids


def test_cuts_do_not_walk_the_memory(monkeypatch):
    """What a cut costs doesn't grow with the runs that are remembered, and runs across cuts are learnt with the batch."""

    class Watched(dict):
        walks = 0

        def keys(self):
            self.walks += 1
            return super().keys()

        def __iter__(self):
            self.walks += 1
            return super().__iter__()

    coder = bpe.TreeEncoder(PATH, 64)
    coder.memory = Watched()
    learn, late = bpe.TreeEncoder._learn, []

    def watched(self, runs, keep=False):
        late.extend(runs if keep else [])
        learn(self, runs, keep)

    monkeypatch.setattr(bpe.TreeEncoder, "_learn", watched)
    text = " ".join(f"wort{k}stamm{k}" for k in range(700))
    assert coder.encode([text])[0].tolist() == coder.whole.encode(text, add_special_tokens=False).ids
    assert coder.memory.walks <= 2
    assert late == []


def test_added_token_flags_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        config = json.load(f)
    config["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(config))
    with pytest.raises(ValueError, match="added tokens"):
        bpe.TreeEncoder(str(tmp_path / "t.json"))


def test_tokenize(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(odd_texts())], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r for r in bpe.tokenize(df, PATH).collect()}
    coder = bpe.TreeEncoder(PATH)
    for k, t in enumerate(odd_texts()):
        ids = coder.whole.encode(t or "", add_special_tokens=False).ids
        assert (got[k].n_tokens, got[k].ids) == (len(ids), ids)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    with pytest.raises(ValueError, match="blanks"):
        bpe.TreeEncoder(tokenizers.path("byte_bpe_50k.json"))


# Top-k.


def test_search_like_sort():
    rng = np.random.default_rng(0)
    for n, dims, block, top in ((500, 8, 64, 30), (50, 4, 16, 2), (10, 3, 4, 5), (1, 2, 4, 5), (60, 3, 7, 1 << 40)):
        rows, ids = rng.integers(-top, top, (n, dims)), np.arange(n) * 3 - 7
        q = np.flatnonzero(ids % 5 == 0)
        of, found, score, _ = search(ids[q], rows[q], ids, ids, rows, 20, block)
        for k, i in enumerate(q):
            dots = [sum(int(a) * int(b) for a, b in zip(rows[i], r, strict=True)) for r in rows]
            if max(map(abs, dots)) < 1 << 62:
                assert [(-int(s), int(v)) for s, v in zip(score[of == k], found[of == k], strict=True)] == sorted((-dots[j], int(ids[j])) for j in range(n) if j != i)[:20]


@pytest.mark.parametrize("sizes", [{}, {"block": 8, "blocks": 4, "batch": 5}])
def test_top_k(spark, sizes):
    """All of it in one range, and over ten ranges and four batches; rows that repeat an id are rows of their own."""
    rng = random.Random(1)
    vectors = [(k, [rng.uniform(-1, 1) for _ in range(6)]) for k in range(200)] + [(k, [0.5] * 6) for k in range(200, 290)]
    odd = [(300, None), (320, [None] * 6), (340, [float("nan")] + [0.0] * 5), (360, [float("inf")] * 6), (380, []), (None, [1.0] * 6), (0, [rng.uniform(-1, 1) for _ in range(6)]), (7, [0.25] * 6), (7, [0.25] * 6)]
    df = spark.createDataFrame([(*r, "x") for r in vectors + odd], "vec_id bigint, embedding array<float>, score string").repartition(3)
    got = sorted(map(tuple, top_k(df, **sizes).collect()))
    kept = []
    for i, v in vectors + odd:
        v32 = np.array(v, np.float32).astype(float) if v is not None and None not in v else None
        if i is not None and v32 is not None and np.isfinite(v32).all():
            kept.append((i, np.floor(64 * v32).astype(int).tolist()))
    want = []
    for n, (q, w) in enumerate(kept):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(w, x, strict=False)), j) for m, (j, x) in enumerate(kept) if m != n)[:20]
            want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert top_k(df.limit(0)).count() == 0


def test_blocks_are_pruned():
    """Blocks of rows about other things than the query aren't visited, nor is anything below a kth score from elsewhere."""
    rng = np.random.default_rng(3)
    rows = np.zeros((400, 40), np.int64)
    for k in range(400):
        rows[k, 4 * (k // 40) : 4 * (k // 40) + 4] = rng.integers(1, 50, 4)
    ids = np.arange(400)
    of, found, score, visits = search(ids[:40], rows[:40], ids, ids, rows, 5, 20)
    full = rows[:40] @ rows.T
    for q in range(40):
        best = sorted((-full[q, j], j) for j in range(400) if j != q)[:5]
        assert [(-s, i) for i, s in zip(found[of == q].tolist(), score[of == q].tolist(), strict=True)] == best
    assert visits <= 40 * 3  # of 20 blocks each
    floor = np.full(40, 10 * full.max())
    assert search(ids[:40], rows[:40], ids, ids, rows, 5, 20, floor)[3] == 0


# Mixing.


def test_targets(spark):
    def slow(sizes):
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
        full, total = {}, 1.5 * sum(sizes.values())
        while True:
            free = [s for s in names if s not in full]
            left = total - sum(full.values())
            made = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = [s for s in free if made[s] > 2 * sizes[s]]
            if not over:
                return full | made
            full |= {s: 2.0 * sizes[s] for s in over}

    for sizes in ({"a": 100, "b": 7, "c": 900, None: 50}, {"x": 10}, {"a": 1, "b": 1, "c": 1}, {f"s{k}": (k * 37) % 101 + 1 for k in range(23)}, {"a": 0, "b": 5}):
        got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
        assert got == pytest.approx(slow(sizes))


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for k in range(900)]
    return spark.createDataFrame([(*r, 1, 2) for r in [*rows, (5000, None, "a"), (5001, "", "b"), (5002, "x y", "c"), (5002, "x y", "c"), (None, "n n n", "b")]], "doc_id bigint, text string, source string, size int, times int")


def test_mix(documents):
    got = mix_sources(documents).collect()
    assert len(got) == documents.count()
    by = {}
    for r in got:
        assert r.taken == r.size * r.times <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 61
    assert len({r.times for r in got if r.doc_id == 5002}) == 1
    again = mix_sources(documents.repartition(9)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_expected_copies(documents):
    """Over many seeds each document's copies average its source's rate."""
    small = documents.where("doc_id < 60").cache()
    sums, rate = {}, {}
    n = 12
    for seed in range(n):
        for r in mix_sources(small, seed=seed).collect():
            if r.size:
                sums[r.doc_id] = sums.get(r.doc_id, 0) + r.times
                rate[r.doc_id] = r.target / r.source_size
    off = [sums[k] / n - rate[k] for k in sums]
    assert abs(sum(off) / len(off)) < 0.1 and max(map(abs, off)) < 0.75


def test_mixed(spark, documents):
    plan = {r.doc_id: r.times for r in mix_sources(documents).collect() if r.doc_id is not None}
    got = mixed(documents)
    assert got.columns == documents.columns
    count = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert all(count.get(k, 0) == n * (2 if k == 5002 else 1) for k, n in plan.items())
    assert mixed(documents.limit(0)).count() == 0 and mix_sources(documents.limit(0)).count() == 0
    text = mix_sources(documents)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Arrow", "Pandas"))
    assert F is not None and pa is not None
