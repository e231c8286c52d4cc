import random

from tablewash.llm import extraction

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/">no</a></li></ul></nav><header>no no</header><div class="ad">no advert</div>
<article><h1>A &amp; B</h1><p>first <b>bo</b>ld   text&nbsp;here</p><div class="cookie-notice">no</div><p>second&#33;<br>line</p><form>no</form></article>
<aside>no</aside><div id="comments"><p>no comment</p></div><footer>no</footer></body></html>"""
SCHEMA = "page_id bigint, url string, html string, text string, id string, n_chars string"


def test_article_without_the_rest(spark):
    rows = [(i, f"u{i}", PAGE, "", "", "") for i in range(20)]
    rows += [(20, None, None, "", "", ""), (21, "u", "", "", "", ""), (21, "u", "", "", "", ""), (None, "u", "plain words only", "", "", ""),
             (22, "u", "<p>open " + "long words " * 20_000, "", "", ""), (23, "u", "<script>never closed", "", "", "")]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = extraction.extract_text(pages, extraction.learn_weights(pages)).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert {text[i] for i in range(20)} == {"A & B first bold text here second! line"}
    assert text[20] == text[21] == text[23] == "" and text[None] == "plain words only"
    assert text[22] == "open " + " ".join(["long words"] * 20_000)
    assert all(r.n_chars == len(r.text) for r in got)


def test_region_has_the_largest_sum():
    rng = random.Random(8)
    for _ in range(200):
        weights = {"word": 1.0, "p": -rng.randint(1, 4), "div": -rng.randint(1, 5), "li": -rng.randint(1, 3)}
        parts = [rng.choice(["<p>", "</p>", "<div>", "<li>", "w" * (i + 1) + " ", f"v{i} x{i} "]) for i in range(rng.randint(1, 25))]
        tokens = extraction.page_tokens("".join(parts))
        value = [weights[n] if n else len(t.split()) for n, t, _ in tokens]
        sums = {(a, b): sum(value[a:b]) for a in range(len(value)) for b in range(a + 1, len(value) + 1)}
        most = max(sums.values(), default=0)
        largest = [(a, -b) for (a, b), x in sums.items() if x == most and all(sums[a, c] > 0 for c in range(a + 1, b))]
        begin, end = min(largest, default=(0, 0))
        end = -end
        want = " ".join(" ".join(t if not n else " " for n, t, _ in tokens[begin:end]).split()) if most > 0 else ""
        got = extraction.main_text("".join(parts), weights)
        assert got.split() == want.split()


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert extraction.extract_text(none, extraction.learn_weights(none)).count() == 0
