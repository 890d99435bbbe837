"""Main texts of small pages; defined cases of the page operator."""

import re
import time
from html.parser import HTMLParser

from attnlens.llm import htmltext
from attnlens.llm.queries import queries

PAGE = ("<html><head><title>t</title><script>var a = '<p>no</p>';</script></head><body><nav><a href='/'>Home</a> <a href='/b'>News</a></nav>"
        "<article><h1>A  title</h1><p>The first paragraph has many words, &amp; it goes on for a while about one thing.</p>"
        "<p>The second paragraph\n also has many words, and it ends the article in a quiet way.</p></article>"
        "<footer>All rights reserved</footer></body></html>")


def test_article_is_kept_whole_and_the_rest_goes(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", PAGE) for k in range(20)], "page_id bigint, url string, html string")
    got = htmltext.extract(pages).collect()
    assert len(got) == 20
    for r in got:
        assert r["text"].endswith("about one thing. The second paragraph also has many words, and it ends the article in a quiet way.")
        assert "&amp;" not in r["text"] and "reserved" not in r["text"] and "Home" not in r["text"] and "var a" not in r["text"]
        assert r["n_chars"] == len(r["text"])


def test_nulls_empty_tables_and_other_columns(spark):
    pages = spark.createDataFrame([(1, None, None, "a"), (2, "u", "", "b"), (2, "u", "", "b"), (None, "u", "<p>", "c")], "page_id bigint, url string, html string, text string")
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in htmltext.extract(pages).collect())
    assert got == [(0, "", 0), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_markup_in_scripts_and_comments_of_readers_stay_out(spark):
    w, pair = htmltext.train([r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect() if r["html"]])
    words = "Some words of the text, one after the other. " * 6
    assert htmltext.main_text(f"<script>if (i <n ) {{ // don't ...}}</script><p>{words}it's fine</p>", w, pair) == words + "it's fine"
    assert htmltext.main_text(f"<main><p>{words}</p><section class='post-comments'><p>Reader says hi, {words}</p></section></main>", w, pair) == words.strip()
    three = f"<p>{words}</p>" * 3
    assert htmltext.main_text(f"<body><div>{three}</div><div class='comments'><p>Reader says hi, {words}</p></div></body>", w, pair) == " ".join([words.strip()] * 3)


def test_long_and_broken_pages_take_time_in_proportion():
    w, pair = htmltext.train([])
    began = time.time()
    for part, n in (("<" + "a" * 1_000_000, 1), ("<a '", 250_000), ('<a href="x', 100_000), ("x<", 500_000), ("<p class='", 100_000), ("<!--", 250_000), ("<div>", 20_000), ("</p>", 250_000)):
        htmltext.main_text("<p>before</p>" + part * n, w, pair)
    assert time.time() - began < 30


def test_pages_that_name_nothing_are_told_by_their_texts(spark):
    """Potentials of some pages, held against others without article, main and such tags, classes and ids."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    w, pair = htmltext.train(pages[:150])
    right, count, inside = 0, 0, 0
    for source in pages[150:]:
        y = htmltext.labelled(htmltext.Page(source))
        bare = htmltext.Page(source, named=False)
        blocks = bare.blocks()
        keep = htmltext.marginals(bare.parent, bare.features(blocks) @ w, pair) > 0.5
        nodes = sorted({n for n, _, _ in blocks})
        right, count, inside = right + (keep[nodes] == y[nodes]).sum(), count + len(nodes), inside + y[nodes].sum()
    assert right / count > 0.9 and right / count > max(inside, count - inside) / count + 0.2


WORDS = "Some words of the text, one after the other, as an article has them. " * 4
#: Pages and their main text, labelled by hand.
BY_HAND = [
    ("Just plain text without any tag.", "Just plain text without any tag."),
    ("<html><body>Plain text in the body.<br>And a second line.</body></html>", "Plain text in the body. And a second line."),
    (f"<b>Bold start</b> {WORDS}<p>{WORDS}</p>", f"Bold start {WORDS.strip()} {WORDS.strip()}"),
    (f"<article><p>{WORDS}</p><p>Before <span class='ad'>Buy our <span>red</span> shoes today!</span> after it, in a sentence.</p></article>", f"{WORDS.strip()} Before after it, in a sentence."),
    (f"<article><p>{WORDS}</p><custom-ad>Buy our shoes today!</custom-ad><p>{WORDS}</p></article>", f"{WORDS.strip()} {WORDS.strip()}"),
    (f"<article><p>{WORDS}<svg><text>Icon label</text></svg></p></article>", WORDS.strip()),
    (f"<article><p>{WORDS}</p><div class='warning'><p>Do not touch the hot plate, {WORDS}</p></div><blockquote class='message'>{WORDS}</blockquote></article>",
     f"{WORDS.strip()} Do not touch the hot plate, {WORDS.strip()} {WORDS.strip()}"),
    (f"<body><div>Home | About | Contact</div><div><p>{WORDS}</p><p>{WORDS}</p></div></body>", f"{WORDS.strip()} {WORDS.strip()}"),
    (f"<body><div class='cookie-notice'><p>We use cookies. {WORDS}</p></div><main><h1>A title</h1><p>{WORDS}</p></main><aside><p>{WORDS}</p></aside></body>", f"A title {WORDS.strip()}"),
    (f"<article><p>{WORDS}</p><ul><li>one thing</li><li>another thing</li></ul></article>", f"{WORDS.strip()} one thing another thing"),
    (f"<article><p>{WORDS} <em>stressed</em> and <span class='note'>noted</span> words &lt;here&gt;.</p></article>", f"{WORDS} stressed and noted words <here>."),
]


def test_pages_labelled_by_hand(spark):
    w, pair = htmltext.train([r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r["html"]])
    got = [(" ".join(htmltext.main_text(h, w, pair).split()), " ".join(want.split())) for h, want in BY_HAND]
    assert [x for x in got if x[0] != x[1]] == []


def brute_force(pages):
    """What the markup says, by the standard library's parser: blocks inside article or main, outside what is marked."""
    out = {}
    for page_id, source in pages:
        class Reader(HTMLParser):
            def __init__(self):
                super().__init__(convert_charrefs=True)
                self.stack, self.blocks, self.now, self.raw = [], [], [], 0

            def flush(self):
                text = " ".join("".join(self.now).split())
                self.now = []
                if text and any(t in ("article", "main") for t, _ in self.stack) and not any(bad for _, bad in self.stack):
                    self.blocks.append(text)

            def handle_starttag(self, tag, attrs):
                if tag in htmltext.RAW:
                    self.flush()
                    self.raw += 1
                elif tag in htmltext.BLOCK:
                    self.flush()
                    words = {w for k, v in attrs if k in ("class", "id", "role") for w in re.split("[^a-z]+", (v or "").lower())}
                    named = {k for k, some in enumerate(htmltext.KEYWORDS) if words & set(some)}
                    self.stack.append((tag, tag in htmltext.BAD or bool(named & htmltext.BAD_WORDS)))
                elif tag in ("br", "hr"):
                    self.flush()

            def handle_endtag(self, tag):
                if tag in htmltext.RAW:
                    self.raw -= 1
                elif tag in htmltext.BLOCK:
                    self.flush()
                    at = max((k for k, (t, _) in enumerate(self.stack) if t == tag), default=None)
                    if at is not None:
                        del self.stack[at:]

            def handle_data(self, data):
                if not self.raw:
                    self.now.append(data)

        reader = Reader()
        reader.feed(source)
        reader.flush()
        out[page_id] = " ".join(reader.blocks)
    return out


def test_the_query_matches_another_parser(spark):
    """On pages whose tags are closed and whose markup says where the article is."""
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect() if r["html"]]
    want = brute_force(rows)
    got = {r["page_id"]: r["text"] for r in queries()["op10_tree_model_html_text"](spark, "/root/testdata/sf0.001").collect()}
    same = sum(got[k] == v for k, v in want.items())
    assert same >= 0.95 * len(want)
