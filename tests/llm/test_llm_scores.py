"""Quality, toxicity and language on held-out rows, decontamination and extraction on small cases."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from paywright.llm import decontaminate, html_main, lang_profile, quality, toxicity
from paywright.llm.common import table

SF = "/root/testdata/sf0.01"


def accuracy(scored, labels, label):
    rows = scored.where("held_out").join(labels, "doc_id").groupBy(label, "predicted").count().collect()
    return {(r[label], r["predicted"]): r["count"] for r in rows}


def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = accuracy(quality.score(docs, labels), labels, "quality")
    assert got.get((1, 0), 0) <= 0.03 * got[(1, 1)]
    assert got[(0, 0)] >= 0.7 * (got[(0, 0)] + got.get((0, 1), 0))


def test_toxicity_on_held_out_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = accuracy(toxicity.score(docs, labels), labels, "toxic")
    assert got.get((0, 1), 0) <= 0.02 * got[(0, 0)]
    assert got[(1, 1)] >= 0.8 * (got[(1, 1)] + got.get((1, 0), 0))


def test_language_on_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    rows = lang_profile.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert rows.where("lang <> lang_pred").count() <= 0.02 * rows.count()


def test_labels_are_no_inputs(docs_of, spark):
    rows = [(i, "good words here " * 5 if i % 2 else "bad ### junk *** " * 5) for i in range(200)]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    held = labels.where((F.crc32(F.col("doc_id").cast("string")) % 5 == 0) | (F.crc32(F.col("doc_id").cast("string")) % 4 == 2))
    other = labels.join(held.select("doc_id"), "doc_id", "left_anti").unionByName(held.select("doc_id", (1 - F.col("quality")).alias("quality"), (1 - F.col("toxic")).alias("toxic")))
    for module, fold in ((quality, "crc32(cast(doc_id as string)) % 5 = 0"), (toxicity, "crc32(cast(doc_id as string)) % 4 = 2")):
        mixed = labels.where(f"not ({fold})").unionByName(other.where(fold))
        assert sorted(module.score(docs, labels).collect()) == sorted(module.score(docs, mixed).collect())


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_of_odd_rows(docs_of, spark, module):
    rows = [(1, None), (1, None), (2, ""), (None, "x"), (3, "word " * 50_000)]
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, None), (1, None, 1), (2, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for labels in (empty, odd):
        got = module.score(docs_of(rows), labels).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
        assert module.score(docs_of(rows).limit(0), labels).count() == 0


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    fire = np.array([[0.01, 0.7], [0.02, 0.6], [0.3, 0.3], [0.01, 0.5]])
    votes = (rng.random((4000, 4)) < np.where(y[:, None], fire[:, 1], fire[:, 0])).astype(float)
    model = toxicity.LabelModel(votes, 0.2)
    gain = np.log(model.fire[1] / model.fire[0])
    assert gain[2] < 1 < min(gain[[0, 1, 3]])
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.9


def test_language_corner_cases(docs_of, spark):
    rows = [(1, None), (2, "12 34 !!"), (3, ""), (None, "the house"), (4, "the house " * 30_000)]
    got = {r["doc_id"]: r["lang_pred"] for r in lang_profile.identify(docs_of(rows)).collect()}
    assert (got[1], got[2], got[3], got[4]) == ("und", "und", "und", "en")
    assert lang_profile.identify(docs_of(rows).limit(0)).count() == 0


def test_rank_order_distance():
    model = lang_profile.RankModel({"aa": [5, 6, 7], "bb": [7, 6, 5]}, top=3)
    assert model.far == 3 and model.ranks[0, 7] == 2 and model.ranks[1, 9] == 3
    row, key, count = lang_profile.counted(["abab", "", "b"])
    assert row.tolist() == sorted(row.tolist()) and count[row == 0].tolist() == sorted(count[row == 0].tolist(), reverse=True)


def test_common_words():
    def plain(a, b):
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        return m[-1][-1]

    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 6, size=rng.integers(0, 30)).tolist() for _ in range(2))
        assert decontaminate.common_words(a, b) == plain(a, b)


def test_benchmark_passages_are_found(docs_of, spark, rnd, monkeypatch):
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(2000)]
    para = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(i, f"{para(18)}. {para(8)}.") for i in range(60)]
    rows, want = [(i, para(rnd.randint(0, 300))) for i in range(200)], set()
    for i in range(200, 260):
        item = items[i % 60][1].split(" ")
        for _ in range(i % 4):
            item[rnd.randrange(18)] = rnd.choice(words)
        rows.append((i, f"{para(rnd.randint(0, 200))} {' '.join(item).upper() if i % 3 == 0 else ' '.join(item)} {para(40)}"))
        want.add((i, i % 60))
    rows += [(900, None), (901, ""), (None, items[5][1])]
    want.add((None, 5))
    bench = spark.createDataFrame([*items, (None, None), (70, "")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "ITEMS", 25)
    monkeypatch.setattr(decontaminate, "RANK", 8)
    monkeypatch.setattr(decontaminate, "LONG", 1000)
    got = decontaminate.contaminated(docs_of(rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert decontaminate.contaminated(docs_of(rows).limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs_of(rows), bench.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"<p>"}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="ad">Buy this now, it is cheap, really.</div><div id="cookie-notice">We use cookies, accept them, please, thank you.</div>
<article><h1>Big &amp; small</h1><p><b>First one, with commas, and   more
words &lt;here&gt;.<br>next<p>Second&nbsp;paragraph is unclosed, too, and long enough.<ul><li>point a<li>point b</ul>
<form><input value="x>y"><button>Send</button></form><section class="comments"><p>Nice, very nice, I like it a lot, really.</p></section>
<script>var t="</p>";</script><!-- <p>gone</p> --></article><aside><p>Other stories, more, and more, and more text here.</p></aside><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_main.main_text(PAGE) == "Big & small\nFirst one, with commas, and more words <here>. next\nSecond paragraph is unclosed, too, and long enough.\npoint a\npoint b"


def test_main_text_without_an_article_element():
    para = "Some text with a comma, and another, that goes on for a while."
    page = f"<body><div><a href=x>{para}</a></div><div class='sidebar'><p>{para * 5}</p></div><div id=main><h2>Head</h2><p>{para}</p><p>{para}</p></div></body>"
    assert html_main.main_text(page) == f"Head\n{para}\n{para}"


@pytest.mark.parametrize("page, want", [(None, ""), ("", ""), ("<p>", ""), ("a < b", "a < b"), ("plain &eacute; text", "plain é text"), ("<article><p>Ti.</p></article><div>x</div>", "Ti."), ("<div><!-- open", "")])
def test_odd_pages(page, want):
    assert html_main.main_text(page) == want


def test_hard_markup_ends_soon():
    start = time.monotonic()
    for page in ("<" * 100_000, "<a '" * 30_000, '<a b="' + "x" * 200_000, "<div>" * 20_000 + "deep", "<p a='1" * 20_000, '<a ">" ' * 20_000,
                 "<div>x" * 20_000 + "</p>" * 20_000, "<b>" * 20_000 + "</i>" * 20_000, "<a '\">\"" * 20_000):
        html_main.main_text(page)
    assert time.monotonic() - start < 20


@pytest.mark.parametrize("part", ["<p class='legal'>{}</p>", "<div class='side-by-side'>{}</div>", "<section id='related-work'><p>{}</p></section>",
                                  "<p id='search-results-show'>{}</p>", "<p class='note'>{}</p>", "<div class='reply-to-critics'>{}</div>"])
def test_one_word_of_a_class_drops_nothing(part):
    text = "A sentence that belongs to the article, whatever its class says."
    first = "The first paragraph of it, with a comma, and another one."
    assert html_main.main_text(f"<body><article><p>{first}</p>{part.format(text)}</article></body>") == f"{first}\n{text}"


@pytest.mark.parametrize("part", ["<div class='ad-slot'>{}</div>", "<section class='comments'><p>{}</p></section>", "<div id='cookie_notice'>{}</div>", "<ul class='share-buttons top'><li>{}</li></ul>",
                                  "<div class='x newsletter-signup'><p>{}</p></div>", "<p hidden>{}</p>", "<div role=navigation>{}</div>"])
def test_what_is_around_goes_from_inside_an_article(part):
    first = "The first paragraph of it, with a comma, and another one."
    assert html_main.main_text(f"<body><article><p>{first}</p>{part.format('Not of the article, at all, or so.')}</article></body>") == first


def test_words_inside_a_sentence_stay():
    page = "<article><p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> and a <label>named thing</label>, in one sentence.</p></article>"
    assert html_main.main_text(page) == "Energy E=m and a named thing, in one sentence."


def test_extract_frame(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None)], "page_id long, url string, html string, text int")
    got = html_main.extract(pages).collect()
    assert sorted((r["n_chars"] == len(r["text"]), bool(r["text"])) for r in got) == [(True, False), (True, True), (True, True)]
    assert html_main.extract(pages.limit(0)).count() == 0
