"""Repetition, main text, language and perplexity."""

import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from fluxmere.llm import perplexity
from fluxmere.llm.common import size_words, words
from fluxmere.llm.html import extract, main_text
from fluxmere.llm.language import UNKNOWN, fit, identify, predict_languages, ppm_coder, reject_unknown
from fluxmere.llm.perplexity import classify
from fluxmere.llm.repetition import profile, repeat_lengths, repetition_rules

ODD = ["", None, " \n\t", "a", "a a", "a b a b a b", "x\x1cy \x85 z", "w " * 3000, "é" * 9000, "l1\nl2\n\nl1\n", "\U0001f600 ok"]


# Repetition.


def slow_lengths(ids):
    n = len(ids)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and ids[i + k] == ids[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_longest_repeats():
    rng = random.Random(4)
    for n in (0, 1, 2, 5, 40, 90):
        for kinds in (1, 2, 5, 50):
            ids = [rng.randrange(kinds) for _ in range(n)]
            assert repeat_lengths(np.array(ids, np.int64)).tolist() == slow_lengths(ids)


def slow_windows(text, size):
    w = words(text)
    count = Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    return len({k + j for k in range(len(w) - size + 1) if count[tuple(w[k : k + size])] > 1 for j in range(size)})


def test_profile_like_windows():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 120))) for _ in range(40)] + ODD
    found = profile(texts, 8, 0.3, 0.2)
    assert found["n_repeat_words"] == [slow_windows(t, 3) for t in texts]
    assert found["n_spans_words"] == [slow_windows(t, 8) for t in texts]


def test_rules(spark):
    rng = random.Random(8)
    fresh = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))
    passage = " ".join(f"p{k}" for k in range(150))
    rows = [(0, fresh), (1, fresh + "\n" + passage + "\nother words\n" + passage), (2, "same words here " * 60), (3, "too short"), (4, None), (5, "one #*$ line\n\none #*$ line\n" + fresh)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, kept string")
    got = {r.doc_id: r for r in repetition_rules(df).collect()}
    assert [got[k].kept for k in range(6)] == [True, False, False, False, False, True]
    assert [got[k].base_failed for k in range(6)] == [False, False, True, True, True, False]
    assert (got[5].n_symbols, got[5].n_dup_lines, got[1].longest_repeat) == (6, 1, 150)
    assert got[4].n_words == got[4].word_chars == 0
    assert repetition_rules(df.limit(0)).count() == 0


def test_words(spark):
    got = [r.n for r in spark.createDataFrame([(t,) for t in ODD], "text string").select(size_words("text").alias("n")).collect()]
    assert sorted(got) == sorted(len(words(t)) for t in ODD)


# Main text.

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, a lot of them, really.</p></div>
<div id="main"><div class="post-content"><h1>The  title</h1><p>First para&shy;graph, with <b>bold</b> and <a href="x">a link</a>, of some length &amp; commas.</p>
<p>Second<br>paragraph &lt;here&gt;,
 over lines.<ul><li>One item</li><li>Another</li></ul><p>Unclosed one, too</div>
<div class="comments"><p>A reader comments at length, with many, many, commas, and so on, and on, and on.</p></div></div>
<aside><p>Sidebar text, quite long, with commas, to tempt the scorer, again and again.</p></aside><form><p>Sign up, now</p></form><footer><p>&copy; us, 2024</p></footer></body></html>"""


def test_main_text():
    assert main_text(PAGE).split("\n") == ["The title", "First para\xadgraph, with bold and a link, of some length & commas.", "Second paragraph <here>, over lines.", "One item", "Another", "Unclosed one, too"]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<article>only <i>this</i></article><footer>x</footer>", "only this"),
        ("<p>1 < 2 & 3 > 2</p>", "1 < 2 & 3 > 2"), ("<p>open <a href='x", "open"), ("<script>never closed <p>x</p>", ""), ("<!-- <p>no</p> --><p>yes</p>", "yes"),
        ("<div><div><p>" * 400 + "deep" + "</p></div></div>" * 400, "deep"), ("<p title='a>b'>quoted</p>", "quoted"), ("<ul><li><a>1</a><li><a>2</a><li><a>3</a></ul><p>text, here</p>", "text, here"),
    ],
)
def test_odd_pages(html, text):
    assert main_text(html) == text


def slow_points(root):
    """Points by the rule's words: every block's text, without that of blocks in it, to its ancestors."""
    from fluxmere.llm import html

    every = []

    def walk(node):
        every.append(node)
        for c in node.children:
            if isinstance(c, html.Node) and not c.dropped:
                walk(c)

    def pieces(node, inside):
        for c in node.children:
            if isinstance(c, str):
                yield c, inside or node.tag == "a"
            elif not c.dropped and (c.tag not in html.BLOCKS):
                yield from pieces(c, inside or node.tag == "a")

    def everything(node, inside):
        for c in node.children:
            if isinstance(c, str):
                yield c, inside or node.tag == "a"
            elif not c.dropped:
                yield from everything(c, inside or node.tag == "a")

    walk(root)
    points = {id(x): 0.0 for x in every}
    letters = lambda parts: sum(len(t.replace(" ", "").replace("\n", "")) for t in parts)
    for x in every:
        if x.tag in html.BLOCKS and x.tag not in html.HEADINGS or x is root:
            own, whole = [t for t, _ in pieces(x, False)], list(everything(x, False))
            size = letters(t for t, _ in whole)
            if sum(map(len, own)) and size:
                share = letters(t for t, link in whole if link) / size
                worth = (1 + "".join(own).count(",") + min(sum(map(len, own)) / 100, 3)) * (1 - share) * (html.DISCOUNT if x.doubtful else 1)
                up = x if x.tag in ("article", "main", "section", "body", "div", "#root", "td") else x.parent
                while up is not None and worth:
                    points[id(up)] += worth
                    up, worth = up.parent, worth / 2 if worth else 0
    return every, points


def test_points_like_the_rule(monkeypatch):
    from fluxmere.llm import html

    monkeypatch.setattr(html, "LEAST_SHARE", 0.0)
    rng = random.Random(12)

    def made(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "p", "section", "b", "span", "article", "h2", "td", 'div class="hidden-gem"'])
            inner = made(depth - 1) if depth else rng.choice(["", " ", "some text, and more", "words " * 40, "<a>a link</a> here"])
            out.append(f"<{tag}>{inner}</{tag.split()[0]}>")
        return "".join(out)

    for _ in range(60):
        root = html.parse(f"<body>{made(3)}</body>")
        html.score(root)
        every, points = slow_points(root)
        assert [x.points for x in every] == pytest.approx([points[id(x)] for x in every])


def test_words_among_others_cost_no_text():
    long = "A paragraph of the article, long enough, with commas, to be worth a lot of points. " * 3
    page = f'<body><article><h1>T</h1><p>{long}</p><div class="hidden-gem"><p>A gem.</p></div><div class="post-tags-intro">Intro.</div><p class="search-results-note">A note.</p><div class="related-posts"><p>Others, too, are good.</p></div></article></body>'
    found = main_text(page).split("\n")
    assert found[0] == "T" and found[2:] == ["A gem.", "Intro.", "A note."]
    two = f"<body><main><article><p>{long * 4}</p></article><article><p>A short one.</p></article></main></body>"
    assert main_text(two).split("\n")[1] == "A short one."


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x" + "</span>" * 20_000, "<b>" + "<div>" * 20_000 + "x" + "</b>" * 20_000, "<span>" * 30_000 + "<h1>t<h2>u" * 3_000, "<li>" * 30_000, "<b>x" * 40_000, "<header>" + "<div>" * 20_000 + "<h1>x" * 5_000])
def test_broken_pages_take_no_longer(page):
    import time

    start = time.perf_counter()
    main_text(page)
    main_text("<article>" + page)
    assert time.perf_counter() - start < 5


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, "x"), (2, None, None, "x")], "page_id bigint, url string, html string, text string")
    got = extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r.n_chars for r in got.collect()) == [0, 0, len(main_text(PAGE))]
    assert extract(df.limit(0)).count() == 0


# Language and perplexity.


def babble(lang, rng, n):
    parts = {"aa": ["ba", "do", "ki", "mu"], "bb": ["sch", "ein", "ung", "ü"], "cc": ["xo", "qui", "zé", "ya"]}[lang]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(9)
    rows = [(k, babble(lang, rng, rng.randint(5, 80)), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 60)]
    return spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !!", "bb"), (902, "", None), (903, babble("aa", rng, 9), None), (None, babble("bb", rng, 30), "bb")], "doc_id bigint, text string, lang string")


def test_language(tongues):
    got = {r.doc_id: r for r in predict_languages(tongues).collect()}
    truth = {r.doc_id: r.lang for r in tongues.collect()}
    held = [k for k in got if k is not None and got[k].held_out and k < 900]
    assert held and all(got[k].lang_pred == truth[k] for k in held)
    assert all(got[k].lang_pred == UNKNOWN and got[k].score == 0 for k in (900, 901, 902))
    assert got[903].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())


def test_rejects(spark, tongues):
    odd = tongues.withColumn("lang_pred", tongues.lang)
    kept = reject_unknown(odd)
    assert kept.columns == odd.columns
    got = {r.doc_id: r.lang for r in kept.collect()}
    assert got[903] == "aa" and not {900, 901, 902} & set(got)
    assert reject_unknown(odd.limit(0)).count() == 0
    assert identify(tongues.limit(3), None).select("lang_pred").distinct().collect() == [(UNKNOWN,)]


def slow_ppm(texts, text, order):
    """Bits of a text by the definition, with exclusions."""
    counts = Counter()
    for t in texts:
        for k in range(len(t)):
            for n in range(min(order, k) + 1):
                counts[t[k - n : k], t[k]] += 1
    after = {}
    for (c, s), n in counts.items():
        after.setdefault(c, {})[s] = n
    bits = 0.0
    for k, s in enumerate(text):
        out = set()
        for n in range(min(order, k), -1, -1):
            c = text[k - n : k]
            if c not in after:
                continue
            left = {x: m for x, m in after[c].items() if x not in out}
            room = sum(left.values()) + len(after[c])
            if s in left:
                bits -= np.log2(left[s] / room)
                break
            bits -= np.log2(len(after[c]) / room)
            out |= set(after[c])
        else:
            bits += np.log2(256 - len(out))
    return bits


def test_exact_code_lengths(spark):
    rng = random.Random(2)
    train = {"aa": [babble("aa", rng, 20) for _ in range(3)], "bb": [babble("bb", rng, 20) for _ in range(3)]}
    df = spark.createDataFrame([(k, t, lang) for lang, own in train.items() for k, t in enumerate(own)], "doc_id bigint, text string, lang string")
    coder = fit(df, order=3)
    texts = [babble("aa", rng, 6), babble("cc", rng, 6), "a", "ü", train["bb"][0]]
    found = coder.costs([t.encode() for t in texts])
    want = [[slow_ppm([x.encode() for x in train[m]], t.encode(), 3) for m in coder.models] for t in texts]
    assert np.allclose(found, want, rtol=1e-4)
    assert ppm_coder is not None


def test_quality(spark):
    rng = random.Random(7)
    clean = [(k, babble("aa" if k % 2 else "bb", rng, 60), "aa" if k % 2 else "bb") for k in range(120)]
    junk = [(k, "".join(rng.choice("#@%&QXZ019") for _ in range(200)), "aa" if k % 2 else "bb") for k in range(200, 230)]
    df = spark.createDataFrame([*clean, *junk, (300, None, "aa"), (301, "", None), (302, babble("bb", rng, 40), None), (303, babble("bb", rng, 2), "zz")], "doc_id bigint, text string, lang string")
    trusted = spark.createDataFrame([(k,) for k in range(0, 100)] + [(None,)], "doc_id bigint")
    got = {r.doc_id: r for r in classify(df, trusted).collect()}
    assert all(got[k].kept for k, _, _ in clean)
    assert not any(got[k].kept for k, _, _ in junk)
    assert (got[300].kept, got[301].kept, got[300].perplexity) == (False, False, None)
    assert got[302].kept and got[302].model == "bb" and got[303].kept
    assert len(got) == df.count()
    none = classify(df, trusted.limit(0)).collect()
    assert all(r.kept == bool(r.n_bytes) for r in none)


def test_few_untrusted_texts_are_sent(spark):
    """Rows that can't be trusted go before the join; no trusted one does, and ids of another type pass whole."""
    rows = spark.range(3000).selectExpr("id - 1000 as id", "'x' as text")
    ids = rows.where("id % 60 = 0").select(F.col("id").alias("trusted_id"))
    left = {r.id for r in perplexity._maybe_trusted(rows, ids).collect()}
    assert {k for k in range(-1000, 2000) if k % 60 == 0} <= left and len(left) < 100
    names = rows.selectExpr("concat('d', id) as id", "text")
    assert {r.id for r in perplexity._maybe_trusted(names, names.where("id like '%7'").select(F.col("id").alias("trusted_id"))).collect()} >= {f"d{k}" for k in range(7, 2000, 10)}
    assert perplexity._maybe_trusted(rows, ids.selectExpr("cast(trusted_id as string) as trusted_id")) is rows
    # The filter stays below the join that sends texts.
    found = perplexity._trusted(rows, ids)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert len(joins) == 2 and "trusted_id" in joins[0] and "word" in joins[1]
    assert {r.id for r in found.collect()} == {r.trusted_id for r in ids.collect()}


def test_quality_by_the_quantile_of_unseen_texts(spark):
    """With 100 unseen trusted texts or more the quantile alone decides: texts with one letter in twenty changed go."""
    from fluxmere.llm.perplexity import unseen

    rng = random.Random(8)
    clean = [(k, babble("aa", rng, 60), "aa", 1) for k in range(700)]
    low = [(k, "".join(rng.choice("etaoin") if rng.random() < 0.05 else c for c in babble("aa", rng, 60)), "aa", 0) for k in range(700, 740)]
    df = spark.createDataFrame([*clean, *low], "doc_id bigint, text string, lang string, quality int")
    got = classify(df.drop("quality"), df.where("quality = 1").select("doc_id")).withColumn("unseen", unseen("doc_id")).collect()
    held = [r for r in got if r.doc_id < 700 and r.unseen]
    assert len(held) >= 100 and got[0].threshold <= max(r.judged for r in held)
    assert sum(not r.kept for r in held) <= 0.01 * len(held) + 1
    assert not any(r.kept for r in got if r.doc_id >= 700)
    assert min(r.judged for r in got if r.doc_id >= 700) < 1.6 * got[0].threshold


def test_quality_counts_all_trusted_texts(spark, monkeypatch):
    from fluxmere.llm import perplexity

    rows, counted = [], perplexity.gram_counts
    monkeypatch.setattr(perplexity, "gram_counts", lambda fit, order: rows.append(fit.count()) or counted(fit, order))
    df = spark.range(2000).selectExpr("id AS doc_id", "concat('text number ', id) AS text", "'aa' AS lang")
    assert classify(df, df.select("doc_id")).count() == 2000
    assert rows == [df.where(~perplexity.unseen("doc_id")).count()]


class SlowKneserNey:
    """Interpolated modified Kneser-Ney over bytes by its definition."""

    def __init__(self, texts, order):
        raw = [Counter(t[i : i + k] for t in texts for i in range(len(t) - k + 1)) for k in range(order + 2)]
        self.c = [{}] + [raw[k] if k == order + 1 else {g: max(1, sum(1 for b in range(256) if bytes([b]) + g in raw[k + 1])) for g in raw[k]} for k in range(1, order + 2)]
        self.order, self.off, self.total, self.leave = order, [None], [None], [None]
        for k in range(1, order + 2):
            n = [sum(1 for v in self.c[k].values() if v == m) for m in range(5)]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
            d = [0.0] + [max(0.05, min(m - 0.05, m - (m + 1) * y * n[m + 1] / n[m] if y is not None and n[m] else m - 0.5)) for m in (1, 2, 3)]
            self.off.append({g: d[min(3, v)] for g, v in self.c[k].items()})
            total, off = Counter(), Counter()
            for g, v in self.c[k].items():
                total[g[:-1]] += v
                off[g[:-1]] += self.off[k][g]
            self.total.append(total)
            self.leave.append({x: off[x] / total[x] for x in total})

    def p(self, g):
        if not g:
            return 1 / 256
        k, context = len(g), g[:-1]
        if context not in self.total[k]:
            return self.p(g[1:])
        own = max(0.0, self.c[k].get(g, 0) - self.off[k].get(g, 0.0)) / self.total[k][context]
        return own + self.leave[k][context] * self.p(g[1:])

    def perplexity(self, text):
        bits = -sum(np.log2(self.p(text[max(0, i - self.order) : i + 1])) for i in range(len(text)))
        return 2 ** (bits / len(text))


@pytest.mark.parametrize("most_rows", [10**6, 0])
def test_perplexity_like_the_definition(spark, most_rows):
    """By the broadcast table and by joins."""
    from fluxmere.llm.perplexity import unseen

    rng = random.Random(9)
    rows = [(k, babble("aa" if k % 2 else "bb", rng, 12), "aa" if k % 2 else "bb") for k in range(24)] + [(30, "zq \xff\u4e2d", "aa"), (31, babble("aa", rng, 5), None), (32, "", "aa"), (33, None, "bb"), (33, "e", "bb")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    trusted = df.where("doc_id < 24").select("doc_id")
    seen = {r.doc_id for r in trusted.where(~unseen("doc_id")).collect()}
    models = {m: SlowKneserNey([t.encode() for k, t, lang in rows if k in seen and lang == m], 4) for m in ("aa", "bb")}
    want = []
    for k, t, lang in rows:
        raw = (t or "").encode()
        want.append((k, len(raw), min(models[m].perplexity(raw) for m in ([lang] if lang else models)) if raw else -1.0))
    got = sorted((r.doc_id, r.n_bytes, -1.0 if r.perplexity is None else r.perplexity) for r in classify(df, trusted, most_rows=most_rows).collect())
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in sorted(want)], rel=1e-4)


def test_kneser_ney_sums_to_one(spark):
    from fluxmere.llm.backoff import gram_counts
    from fluxmere.llm.perplexity import coders, kneser_ney

    rng = random.Random(1)
    df = spark.createDataFrame([("m", babble("aa", rng, 30)) for _ in range(5)], "model string, text string")
    coder = coders(*(x.toArrow() for x in kneser_ney(gram_counts(df, 2), 2)), 2)["m"]
    for context in (b"", b"a", b"ba", b"k ", b"\xff\xff", b"zb"):
        whole = coder.costs([context + bytes([b]) for b in range(256)])[:, 0] - (coder.costs([context])[0, 0] if context else 0)
        assert abs(np.exp2(-whole).sum() - 1) < 1e-3


@pytest.mark.parametrize(
    ("attributes", "kept"),
    [("class='post-comments'", False), ("class='article-sidebar'", False), ("id='main' class='content with-sidebar'", True), ("class='commentList'", False), ("class='has-comments entry'", True), ("role='navigation'", False), ("class='ad-slot'", False), ("class='reader'", True), ("style='display:none'", False), ("hidden", False)],
)
def test_boilerplate_by_attributes(attributes, kept):
    page = f"<body><div class='story'><p>Main text, of a length, that counts, here and there.</p></div><div {attributes}><p>{'More text, with commas, and so on. ' * 8}</p></div></body>"
    assert ("More text" in main_text(page)) is kept
