"""Line dedup against all pairs."""

import random
from collections import Counter, defaultdict

import pytest

from fluxmere.llm import lines as lines_module
from fluxmere.llm.common import Scratch
from fluxmere.llm.lines import BLANKS, SHINGLE, dedup_lines, line_report

WORDS = [f"{a}{b}{c}" for a in "bdkmt" for b in "aeiou" for c in ("", "n", "r", "st")]


def shingles(s):
    return {s[k : k + SHINGLE] for k in range(max(1, len(s) - SHINGLE + 1))}


def expected(rows, threshold=0.8):
    """(doc_id, line) that go."""
    first, seen = {}, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for no, line in enumerate((text or "").split("\n")):
            norm = line.strip(BLANKS).lower()
            if norm:
                first.setdefault(norm, (doc, no))
                seen.append((norm, (doc, no)))
    lines = list(first)
    sets, index, parent = [shingles(x) for x in lines], defaultdict(list), list(range(len(lines)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in index[g]).items():
            if n / (len(s) + len(sets[j]) - n) >= threshold:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            index[g].append(i)
    kept = {n: first[lines[find(i)]] for i, n in enumerate(lines)}
    return {at for n, at in seen if kept[n] != at}


def corpus():
    rng = random.Random(5)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(3, 70))) for _ in range(150)]
    rows = []
    for k in range(220):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = rng.choice(base).split() if rng.random() < 0.6 else rng.choices(WORDS, k=30)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            lines.append(" ".join(words).capitalize() + rng.choice(["", " ", "\r"]))
            lines += [""] * rng.randint(0, 1)
        rows.append((k, "\n".join(lines)))
    # A group of near copies of one line, a third of all.
    words = rng.choices(WORDS, k=60)
    for k in range(220, 330):
        own = list(words)
        own[rng.randrange(60)] = rng.choice(WORDS)
        rows.append((k, " ".join(own)))
    return rows


def test_like_brute_force(spark):
    rows = corpus()
    found = line_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    gone = {(r.doc_id, k) for r in found.collect() for k in r.removed_lines}
    want = expected(rows)
    assert len(gone & want) >= 0.995 * len(want)
    assert gone <= want


def test_families_of_one_template(spark):
    """Many lines of one template share buckets; the near copies among them are few and far between."""
    rng = random.Random(11)
    template = rng.choices(WORDS, k=75)
    rows = []
    for k in range(300):
        own = template + rng.choices(WORDS, k=18)
        near = list(own)
        near[rng.randrange(75, 93)] = "other"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(near))]
    found = line_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    # Lines of different families reach 0.7 at most.
    assert {(r.doc_id, k) for r in found.collect() for k in r.removed_lines} == {(2 * k + 1, 0) for k in range(300)}


def test_crowded_buckets(spark):
    """2,000 twins among lines that share a boilerplate: strangers at 0.65 to 0.7 fill the buckets."""
    rng = random.Random(13)
    boiler = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=330))
    rows = []
    for k in range(2000):
        own = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=72))
        rows += [(2 * k, boiler + own), (2 * k + 1, boiler + own + "!")]
    found = line_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    gone = {r.doc_id for r in found.collect() for k in r.removed_lines}
    assert len(gone & set(range(1, 4000, 2))) >= 0.995 * 2000
    assert gone <= set(range(1, 4000, 2))


def test_few_pairs_are_compared(spark, monkeypatch):
    """Of 60 near copies, and of 60 strangers at 0.65 to 0.7, only a few of all 1,770 pairs each are compared by all shingles."""
    rng = random.Random(17)
    letters = "abcdefghijklmnopqrstuvwxyz "
    copy, boiler = ("".join(rng.choices(letters, k=330)) for _ in range(2))
    rows = [(k, copy[:150] + rng.choice(letters) + copy[150:] + rng.choice(letters) * (k % 7)) for k in range(60)]
    rows += [(100 + k, boiler + "".join(rng.choices(letters, k=72))) for k in range(60)]
    compared, compare = [], lines_module.verified

    def counted(pairs, *more):
        compared.append(pairs.count())
        return compare(pairs, *more)

    monkeypatch.setattr(lines_module, "verified", counted)
    found = line_report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    gone = {r.doc_id for r in found.collect() for k in r.removed_lines}
    assert gone == set(range(1, 60))
    assert sum(compared) < 500


def test_outsiders_of_a_large_group(spark, monkeypatch):
    """A large group of copies at 0.8 and less to each other is mostly linked by a few members before all of it meets what is outside."""
    rng = random.Random(23)
    letters = "abcdefghijklmnopqrstuvwxyz "
    copy = "".join(rng.choices(letters, k=400))
    rows = []
    for k in range(400):
        own = list(copy)
        for at in rng.sample(range(400), rng.randint(1, 7)):
            own[at] = rng.choice(letters)
        rows.append((k, "".join(own)))
    want = {doc for doc, _ in expected(rows)}
    made, meet = [], lines_module.outsider_pairs

    def counted(*args):
        out = meet(*args)
        made.append(out.count())
        assert made[-1] == out.distinct().count()
        return out

    monkeypatch.setattr(lines_module, "outsider_pairs", counted)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)

    def gone():
        return {r.doc_id for r in line_report(df).collect() if r.removed_lines}

    direct = gone()
    assert 0 < sum(made) < 3000  # 3,707 where all of it met in blocks at once
    monkeypatch.setattr(lines_module, "OUTSIDERS", 0)  # by blocks
    assert direct <= want and gone() <= want and len(direct) >= 0.995 * len(want)


def test_outsiders_meet_in_their_first_bucket(spark):
    """Every pair of a bucket in different components is met once, however many buckets it shares."""
    rng = random.Random(29)
    text = "".join(rng.choices("abcdefgh ", k=300))
    lines = spark.createDataFrame([(k, text + "x" * k) for k in range(12)], "id bigint, norm string")
    words = lines_module._parities(lines_module._shingles(lines, "id"))
    buckets = {1: range(8), 2: range(4, 12), 3: range(2, 10)}
    component = {k: 0 if k < 5 else k for k in range(12)}
    rows = [(key, k, component[k], 0, 0) for key, ids in buckets.items() for k in ids]
    held = spark.createDataFrame(rows, "key bigint, id bigint, component bigint, main bigint, outsiders bigint")
    with Scratch(spark) as scratch:
        found = [(r.a, r.b) for r in lines_module.outsider_pairs(held, words, 0.8, scratch).collect()]
    want = {(a, b) for ids in buckets.values() for a in ids for b in ids if a < b and component[a] != component[b]}
    assert sorted(found) == sorted(want)


def test_parities_lose_no_pair(spark):
    """Bounds from sizes and parities hold for lines with repeated shingles, just at the threshold and far from it."""
    rng = random.Random(19)
    pairs = [("a" * 12 + "b", "a" * 300 + "b"), ("a" * 40, "a" * 15), ("short", "short"), ("ab" * 90, "ab" * 99), ("x" * 19, "y" * 19)]
    for k in range(300):
        line = "".join(rng.choices("abcde ", k=rng.randint(10, 600)))
        line += line[: rng.choice([0, 0, 40])]
        pairs.append((line, line[: max(1, len(line) * (70 + k % 31) // 100)]))
    rows = [(2 * k + j, x) for k, p in enumerate(pairs) for j, x in enumerate(p)]
    table = lines_module._parities(lines_module._shingles(spark.createDataFrame(rows, "id bigint, norm string"), "id"))
    sides = lines_module._sides(table, "size", "words")
    both = sides[0].join(sides[1], sides[1].b == sides[0].a + 1).where("a % 2 = 0")
    close = {r.a // 2 for r in both.where(lines_module._close(0.8)).collect()}
    alike = {k for k, (x, y) in enumerate(pairs) if len(shingles(x) & shingles(y)) >= 0.8 * len(shingles(x) | shingles(y))}
    assert alike <= close and len(alike) > 100 and len(close) < len(pairs) - 50


def test_exact_needs_no_bands(spark):
    rows = corpus()[:150]
    found = dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), exact=True)
    kept = {r.doc_id: r.text for r in found.collect()}
    gone = expected(rows)
    want = {doc: "\n".join(x for no, x in enumerate((text or "").split("\n")) if (doc, no) not in gone) for doc, text in rows}
    assert kept == want


def test_edges(spark):
    rows = [(2, "Same line here\nunique one\n\nsame line here  "), (1, "same LINE here"), (None, "same line here\nlast words"), (3, None), (4, ""), (5, "\n\n"), (6, "ß"), (7, "ß\nSS"), (7, "ß\nSS"), (8, "x" * 30_000), (9, "x" * 30_000)]
    df = spark.createDataFrame([(*r, "a", 1, "c") for r in rows], "doc_id bigint, text string, source string, removed int, in_0 string")
    out = sorted(map(tuple, dedup_lines(df).collect()), key=repr)
    texts = [(r[0], r[1]) for r in out]
    assert dict(texts[:1]) == {1: "same LINE here"}
    assert (2, "unique one\n") in texts and (None, "last words") in texts
    assert {(3, None), (4, ""), (5, "\n\n"), (9, "")} <= set(texts)
    assert texts.count((7, "SS")) == 2  # rows that repeat an id and a text are decided alike
    assert dedup_lines(df).columns == df.columns
    left = {r.doc_id for r in dedup_lines(df, drop_emptied=True).collect()}
    assert 9 not in left and {3, 4, 5} <= left
    report = {r.doc_id: (r.n_lines, r.n_kept) for r in line_report(df.where("doc_id is not null and doc_id <> 7")).collect()}
    assert report[3] == (0, 0) and report[2] == (4, 2)


@pytest.mark.parametrize("make", [dedup_lines, line_report])
def test_empty_table(spark, make):
    assert make(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_no_python_in_the_plan(spark):
    plan = dedup_lines(spark.createDataFrame([(1, "a\nb")], "doc_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
