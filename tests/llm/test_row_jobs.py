"""Operators that work row by row: extraction, classifier, rules, pieces."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cadastre.llm import html_extract, pieces, quality, rules
from cadastre.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice">We use cookies on this site, do you agree to that?</div>
<main><article><h1>Head &amp; line</h1><p>First   paragraph with <b>bold</b>
words.<p>Second&nbsp;one with <a href=x>a link</a>, 1 &lt; 2.<ul><li>point<li>other</ul></article></main>
<aside class="sidebar"><p>Something else that is long enough to be taken for text by its length alone, or so it seems.</p></aside>
<section id="comments"><p>What a fine article, thank you for that, I will read it to all of my friends at once.</p></section>
<form><label>Mail</label><input name=m></form><footer>&copy; 2020 Site</footer><script>if (a<b) x("</p>")</script></body></html>"""


def test_extraction(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "no markup & all"), (5, "u", "<p>open <b>tags<p>and <i"), (1, "u", PAGE), (None, "u", "<!-- x -->")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    want = "Head & line\n\nFirst paragraph with bold words.\n\nSecond one with a link, 1 < 2.\n\npoint\n\nother"
    assert [r.text for r in got] == [want, "", "", "no markup & all", "open tags\n\nand <i", want, ""]
    assert all(r.n_chars == len(r.text) for r in got)


def test_extraction_of_a_very_long_page():
    page = "<body>" + "<nav><a href=x>menu</a></nav>" + "".join(f"<p>paragraph number {i} of the story" for i in range(5000)) + "<footer>imprint</footer>"
    assert html_extract.main_text(page).count("\n\n") == 4999


LONG = "A paragraph that goes on for a while and tells of this and of that, as paragraphs of an article do. "


def test_the_cut_turns_labels():
    # a paragraph that is one link, between long ones; a short line without a link, between menu entries
    page = f"<body><div><a href=a>Home</a></div><div>Menu</div><div><a href=b>News</a></div><section><p>{LONG * 3}<p><a href=c>All of it in the archive of the town</a><p>{LONG * 3}</section>"
    blocks = html_extract.read_blocks(page)
    price = html_extract.costs(blocks, {})
    side = html_extract.minimum_cut([p[0] for p in price], [p[1] for p in price], html_extract.edges(blocks))
    assert [p[0] > 0 for p in price] == [False, True, False, True, False, True]
    assert side == [False, False, False, True, True, True]
    assert html_extract.main_text(page) == "\n\n".join([(LONG * 3).strip(), "All of it in the archive of the town", (LONG * 3).strip()])


def test_clear_marks_are_not_turned():
    page = f"<main class=content><article><header><h1>Title</h1></header><p>{LONG}<div class=ad><p>{LONG}</div><p>{LONG}<div class=x hidden><p>{LONG}</div><p><a href=x>link</a></article></main><footer>{LONG}</footer>"
    assert html_extract.main_text(page).split("\n\n") == ["Title", LONG.strip(), LONG.strip(), "link"]


def test_marked_pages_teach_the_classifier(spark):
    """What marks say of 200 pages is found on pages without marks by the text alone."""
    import random

    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["stone", "river", "of", "a", "the", "town", "light"]) for _ in range(n)).capitalize()

    def page(marked):
        notes = [words(rng.randint(5, 9)) for _ in range(3)]
        story = [words(rng.randint(20, 60)) + "." for _ in range(4)]
        a, b, c, d = ("article", "/article", "aside", "/aside") if marked else ("div", "/div", "div", "/div")
        return f"<{c}>" + "".join(f"<div>{x}</div>" for x in notes) + f"<{d}><{a}>" + "".join(f"<p>{x}</p>" for x in story) + f"<{b}>", "\n\n".join(story)

    model = html_extract.fit(spark.createDataFrame([(page(True)[0],) for _ in range(200)], "html string").repartition(3))
    tests = [page(False) for _ in range(50)]
    assert sum(html_extract.main_text(x, model) == want for x, want in tests) >= 49
    assert sum(html_extract.main_text(x) == want for x, want in tests) < 10


@pytest.mark.parametrize(
    "page, tail",
    [
        ("<ul>" + "<li><a href=x>entry</a>" * 20_000 + "</ul><p>" + LONG * 9, (LONG * 9).strip()),
        (f"<p>{LONG * 9}" + "<a " * 100_000, None),
        (f"<p>{LONG * 9}" + '<a b="' * 100_000 + ">", None),
        ("<div>" * 50_000 + f"<p>{LONG * 9}", (LONG * 9).strip()),
        ("<b><div>" * 50_000 + f"<p>{LONG * 9}" + "</b>" * 50_000, (LONG * 9).strip()),
        ("<noscript><![CDATA[" * 50_000 + f"<p>{LONG * 9}", (LONG * 9).strip()),
        ("<div>word" * 30_000 + f"<p>{LONG * 9}", None),
    ],
    ids=["menu", "open tags", "open quotes", "depth", "inline", "endless", "deep text"],
)
def test_time_grows_with_the_page(page, tail):
    import time

    start = time.perf_counter()
    text = html_extract.main_text(page)
    assert time.perf_counter() - start < 10
    assert LONG.strip() in text
    assert tail is None or text.endswith(tail)


@pytest.mark.parametrize("seed", range(30))
def test_minimum_cut_is_minimal(seed):
    import itertools
    import random

    rng = random.Random(seed)
    n = rng.randint(1, 7)
    source = [rng.choice([0, rng.random() * 4]) for _ in range(n)]
    sink = [0 if s else rng.random() * 4 for s in source]
    links = [(a, b, rng.random() * 2) for a in range(n) for b in range(a) if rng.random() < 0.5]
    price = lambda side: sum(s for s, x in zip(source, side) if not x) + sum(t for t, x in zip(sink, side) if x) + sum(c for a, b, c in links if side[a] != side[b])
    best = min(price(side) for side in itertools.product((False, True), repeat=n))
    assert price(html_extract.minimum_cut(source, sink, links)) == pytest.approx(best)


def measures(text):
    w = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_rules(spark, cluttered, rows):
    extra = [(900, "la " * 50, None, None, 0), (901, " ".join(f"a{i}***" for i in range(40)), None, None, 0), (902, "A B\n" * 40, None, None, 0)]
    df = cluttered.select("doc_id", "text", "key").unionByName(spark.createDataFrame([(a, b, "") for a, b, *_ in extra], "doc_id long, text string, key string"))
    got = rules.judge(df).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key)
    assert have == sorted(((r[0], *measures(r[1])) for r in rows + extra), key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    # the cascade keeps what no rule rejects
    failed = Counter((r.doc_id, tuple(r.failed)) for r in rules.failures(df).collect())
    bad = Counter(i for i, _ in failed.elements())
    rejected = Counter(r.doc_id for r in got if not r.kept and not r.base_failed)
    assert all(rejected[i] <= bad[i] for i in rejected)
    assert all(i not in bad or any(r.base_failed for r in got if r.doc_id == i) for i in {r.doc_id for r in got if r.kept} if sum(r.doc_id == i for r in got) == 1)
    verdict = {r.doc_id: r for r in got}
    assert (901, ("symbols",)) in failed and not verdict[901].kept and verdict[900].base_failed and verdict[0].kept
    backwards = rules.judge(df, rules.RULES[::-1]).collect()
    assert Counter(backwards) == Counter(got)


def test_rule_order_puts_rejections_per_second_first(spark):
    import time

    slow = rules.Rule("slow", lambda t, rows: (time.sleep(0.05), t.n_words[rows] > 0)[1])
    fast = rules.Rule("fast", lambda t, rows: t.n_words[rows] > 0)
    never = rules.Rule("never", lambda t, rows: t.n_words[rows] < 0)
    df = spark.createDataFrame([(i, "a b") for i in range(40)], "doc_id long, text string")
    assert [n for n, *_ in rules.order_rules(df, (never, slow, fast))] == ["fast", "slow", "never"]


def test_rules_on_nothing(spark, nothing):
    assert rules.judge(nothing).collect() == []


def test_classifier_learns_and_is_steady(spark):
    import random

    rng = random.Random(1)
    good = [" ".join(rng.choice("alpha beta gamma delta of the".split()) for _ in range(40)) for _ in range(150)]
    bad = [" ".join(rng.choice("alpha*** BETA!! | buy buy".split()) for _ in range(40)) for _ in range(50)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(500, ""), (501, None), (None, good[0]), (3, good[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(0)).withColumn("label", F.lit(1))
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(200)] + [(7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    again = quality.quality_scores(docs, labels).collect()
    assert sorted(got, key=str) == sorted(again, key=str) and len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert held and all(r.predicted == int(r.doc_id < 150) for r in held)
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality.quality_scores(docs, flipped).collect(), key=str) == sorted(got, key=str)


def test_classifier_without_labels(spark, documents, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality_scores(documents, none).collect()} == {0.5}
    assert quality.quality_scores(nothing, none).collect() == []


def test_pieces_round_trip(spark, cluttered, rows):
    coded = pieces.encode(cluttered, tokenizer_path())
    assert [c for c in coded.columns if c != "pieces"] == [c for c in cluttered.columns if c != "pieces"] + ["pieces_lossless"]
    back = pieces.decode(coded, tokenizer_path()).select("doc_id", "text", "decoded", "pieces", "pieces_lossless").collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.decoded == r.text
        assert (r.pieces is None and r.pieces_lossless is None) if r.text is None else r.pieces_lossless
    once = {(r.doc_id, r.text): r.pieces for r in back}
    again = pieces.encode(cluttered.repartition(5), tokenizer_path()).select("doc_id", "text", "pieces").collect()
    assert all(once[(r.doc_id, r.text)] == r.pieces for r in again)


def test_pieces_are_drawn_by_their_weights(spark):
    """Shares of the segmentations of one word over many keys are near their exact chances."""
    vocabulary = pieces.Vocabulary.load(tokenizer_path())
    lattice = pieces.Lattice(vocabulary, 1.0)
    name = {p: i for i, p in enumerate(vocabulary.pieces) if p is not None and i not in set(vocabulary.byte_ids)}
    word = b" then"

    def ways(at):
        if at == len(word):
            yield ()
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in name:
                for rest in ways(end):
                    yield (name[word[at:end]], *rest)

    weight = {w: float(2.718281828 ** sum(lattice.weight[i] for i in w)) for w in ways(0)}
    total = sum(weight.values())
    n = 4000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("then").alias("text"))
    seen = Counter(tuple(r.pieces) for r in pieces.encode(docs, tokenizer_path()).select("pieces").collect())
    for w, x in weight.items():
        assert abs(seen[w] / n - x / total) < 0.03


def test_pieces_of_nothing(spark, nothing):
    assert pieces.encode(nothing, tokenizer_path()).collect() == []
