import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.llm import extraction, queries
from factlake.llm.common import table
from factlake.llm.html_blocks import blocks_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def field(spark):
    return extraction.fit(table(spark, SF, "pages"), sample_pages=40)


def article(page):
    """The plain reading of the given pages' one template."""
    inside = page.split("<article>")[1].split("</article>")[0]
    parts = re.split(r"</?(?:p|h1)>", inside)
    parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in parts]
    return "\n".join(x for x in parts if x)


def test_given_pages(spark, field):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    rows = pages.select("html", extraction.main_text(F.col("html"), field).alias("text")).collect()
    assert all(row["text"] == article(row["html"]) for row in rows)


def test_held_out_variants(spark, field):
    rng = np.random.default_rng(9)
    wrong = total = 0
    for row in table(spark, "/root/testdata/sf0.01", "pages").limit(150).collect():
        blocks = blocks_of(row["html"])
        page, labels = extraction.variant(blocks, extraction.own_labels(blocks), rng)
        found = field.decode(extraction.features_of(page))
        wrong += sum(a != b for a, b in zip(found, labels))
        total += len(labels)
    assert wrong <= 0.02 * total


def test_blocks():
    page = """<!doctype html><title>no</title><script>var x = "</p><p>no";</script>
      <style>no</style><!-- no <p>no --><nav><a href="a>b">Link</a></nav>
      <p>One &amp; two&nbsp;&#33; <b>bold<i>er</b></i><br>next
      <p>Second<ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table></div>tail &am
      <script>closed</script >"""
    texts = [b.text for b in blocks_of(page)]
    assert texts == ["Link", "One & two ! bolder next", "Second", "x", "y", "c1", "c2", "tail &am"]
    assert blocks_of("") == [] and blocks_of("<<<>>> a < b")[0].text.endswith("a < b")


@pytest.mark.parametrize(
    "inner, want",
    [
        ('<p>One</p><svg class="i"/><p>Two</p>', "One|Two"),
        ("<p>One</p><template-card>x</template-card><p>Two</p>", "One|x|Two"),
        ("<p>One</p><math-field></math-field><title-bar>t</title-bar><p>Two</p>", "One|t|Two"),
        ("<p>One</p><iframe/><p>Two</p>", "One|Two"),
        ('<p>One</p><iframe src="a>b">no</iframe><p>Two</p><style>no', "One|Two|no"),
        ('<p>One</p><svg><path d="M0"/><text>no</text></svg ><p>Two</p>', "One|Two"),
        ("<p>One</p><math/><math><mi>x</mi></math><p>Two</p>", "One|Two"),
    ],
)
def test_raw_elements_take_nothing_else(inner, want):
    assert [b.text for b in blocks_of(f"<article>{inner}</article>")] == want.split("|")


def test_many_unended_elements_take_linear_time():
    page = "<p>a<svg><title>" * 40_000
    start = time.perf_counter()
    assert len(blocks_of(page)) == 40_000
    assert time.perf_counter() - start < 20


SENTENCES = [
    "The council met on Tuesday to discuss the new harbour wall and its cost.",
    "Residents had asked for a decision since the storm of last winter.",
    "Engineers presented three designs, and the cheapest was turned down.",
    "Work should begin in spring, once the fishing season is over.",
    "The mayor said that the town could not wait for another flood.",
    "A final vote is expected before the end of the month.",
]
ITEMS = ["Two gates of steel", "A wall of 300 metres", "New pumps", "Four years of work"]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in SENTENCES)
LIST = "<ul>" + "".join(f"<li>{x}</li>" for x in ITEMS) + "</ul>"
TABLE = "<table><tr><th>Design<th>Cost</tr><tr><td>Steel<td>40 million</tr></table>"
TABLE_TEXT = ["Design", "Cost", "Steel", "40 million"]
MENU = "<nav><ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/c>Contact</a></ul></nav>"
FOOT = "<footer><p>© 2024 The Daily Page</p><a href=/i>Imprint</a></footer>"
AD = '<div class="ad">Buy new boots today, half price.</div>'
HEAD = "<h1>Town plans a new harbour wall</h1>"
LAYOUTS = {
    "list in article": (f"{MENU}<article>{HEAD}{PARAGRAPHS}{LIST}</article>{FOOT}", [HEAD[4:-5], *SENTENCES, *ITEMS]),
    "list in the middle": (
        f"{MENU}<article>{HEAD}<p>{SENTENCES[0]}</p>{LIST}<p>{SENTENCES[1]}</p></article>{FOOT}",
        [HEAD[4:-5], SENTENCES[0], *ITEMS, SENTENCES[1]],
    ),
    "table in article": (f"{MENU}<article>{HEAD}{PARAGRAPHS}{TABLE}<p>{SENTENCES[0]}</p></article>{FOOT}", [HEAD[4:-5], *SENTENCES, *TABLE_TEXT, SENTENCES[0]]),
    "quote and headings": (
        f"{MENU}<main>{HEAD}<p>{SENTENCES[0]}</p><h2>Costs</h2><p>{SENTENCES[1]}</p><blockquote><p>{SENTENCES[4]}</p></blockquote><p>{SENTENCES[5]}</p></main>{FOOT}",
        [HEAD[4:-5], SENTENCES[0], "Costs", SENTENCES[1], SENTENCES[4], SENTENCES[5]],
    ),
    "aside inside": (
        f"{MENU}<article>{HEAD}<p>{SENTENCES[0]}</p><aside><p>More about harbours and walls in our special.</p></aside><p>{SENTENCES[1]}</p>{AD}<p>{SENTENCES[2]}</p></article>{FOOT}",
        [HEAD[4:-5], *SENTENCES[:3]],
    ),
    "content by id": (f'{MENU}<div id="content">{HEAD}{PARAGRAPHS}</div>{FOOT}', [HEAD[4:-5], *SENTENCES]),
    "content by id, last": (f'{MENU}<div id="content">{HEAD}{PARAGRAPHS}</div>', [HEAD[4:-5], *SENTENCES]),
    "plain body": (f"{HEAD}{PARAGRAPHS}", [HEAD[4:-5], *SENTENCES]),
    "post with comments": (
        f'<header><a href=/>Site</a></header><div class="post">{HEAD}{PARAGRAPHS}{LIST}</div><section class="comments"><h3>Comments</h3><p>I think it is far too expensive for us.</p><p>Finally they do something about it!</p></section>{FOOT}',
        [HEAD[4:-5], *SENTENCES, *ITEMS],
    ),
    "newsletter form inside": (
        f'{MENU}<article>{HEAD}<p>{SENTENCES[0]}</p><form class="newsletter"><p>Get our letter every Friday.</p><input><button>Subscribe</button></form><p>{SENTENCES[3]}</p></article>{FOOT}',
        [HEAD[4:-5], SENTENCES[0], SENTENCES[3]],
    ),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_hand_written_layouts(field, name):
    """Pages of other sites, none of them used in training."""
    page, want = LAYOUTS[name]
    blocks = blocks_of(f"<html><head><title>x</title></head><body>{page}</body></html>")
    labels = field.decode(extraction.features_of(blocks))
    assert [b.text for b, label in zip(blocks, labels) if label] == want


def test_clashing_names_and_repeated_pages(spark, field):
    page = LAYOUTS["list in article"]
    df = spark.createDataFrame([(1, page[0]), (1, page[0]), (2, page[0])], "page_id int, html string")
    for name in ("text", "labels", "sample", "url"):
        df = df.withColumn(name, F.lit("theirs"))
    out = df.select("page_id", "text", extraction.main_text(F.col("html"), field).alias("found")).collect()
    assert [(r["page_id"], r["text"], r["found"]) for r in out] == [(k, "theirs", "\n".join(page[1])) for k in (1, 1, 2)]


def test_a_sample_is_never_empty(spark):
    from factlake.llm.common import sampled

    ids = spark.range(100_000)
    for rows in (10, 10**12):
        assert ids.where(sampled("id", 200, rows)).count() == (100_000 if rows == 10 else 0)
    # The bound itself: 200 of 10^15 rows is a positive number of hash values.
    assert int(200 / 10**15 * 2**63) > 10**6
    assert 100 < ids.where(sampled("id", 200, 100_000)).count() < 320


def test_decoding_is_the_best_labelling():
    rng = np.random.default_rng(0)
    names = list("abcde")
    for _ in range(40):
        field = extraction.Field(
            {n: tuple(rng.normal(size=2)) for n in names}, rng.normal(size=(2, 2))
        )
        page = [list(rng.choice(names, 2)) for _ in range(6)]

        def worth(labels):
            own = sum(field.weights[n][y] for names_, y in zip(page, labels) for n in names_)
            return own + sum(field.moves[a, b] for a, b in zip(labels, labels[1:]))

        every = [[k >> j & 1 for j in range(6)] for k in range(64)]
        assert worth(field.decode(page)) == pytest.approx(max(map(worth, every)))


def test_odd_pages(spark, field):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", "<p>" + "word " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = pages.select("html", extraction.main_text(F.col("html"), field).alias("text")).collect()
    assert [r["text"] for r in out[:3]] == ["", "", ""]
    assert out[3]["text"] in ("", " ".join(["word"] * 50_000))
    assert pages.limit(0).select(extraction.main_text(F.col("html"), field)).collect() == []
    with pytest.warns(UserWarning, match="no page"):
        assert extraction.fit(pages).decode([["always"]]) == [0]


def test_query_columns(spark):
    out = queries.op5_extraction(spark, SF)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert out.count() == table(spark, SF, "pages").count()
