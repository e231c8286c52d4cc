import re
import string

from tablewash.llm.license_texts import PHRASES, TEMPLATES
from tablewash.llm.licenses import scan_licenses

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def base(text):
    w = WORD.findall((text or "").translate(LOW))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_and_templates(spark, small_texts):
    mit = TEMPLATES["mit"].split()
    rows = [*small_texts, (900, "See the GNU  General Public\nLicense, or CC BY; mit-license! MIT LICENSE"), (901, "mit licenses é" + "cc by"),
            (902, "intro " + TEMPLATES["bsd"] + " outro"), (903, " ".join([*mit[:40], "inserted", "words", *mit[40:60], *mit[63:]])),
            (904, " ".join(mit[:20])), (905, "apache"), (906, "license apache license")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, row string").repartition(3)
    got = scan_licenses(docs).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(
        ((i, *base(t)) for i, t in rows), key=key)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[902].labels, by_id[902].spans[0].lo, by_id[902].score) == ("bsd", 1, 1.0)
    assert by_id[903].labels == "mit" and 0.9 < by_id[903].score < 1
    assert by_id[904].labels == "" and by_id[904].score == 0
    assert by_id[900].labels == "cc-by,gpl,mit" and by_id[900].score == 1
    assert all(0 <= r.score <= 1 for r in got)


def test_empty_table(no_docs):
    assert scan_licenses(no_docs).collect() == []


def brute_spans(text, k=4, votes=6, gap=8):
    """Spans by counting every pair of equal grams of the text and of a template."""
    split = lambda t: WORD.findall((t or "").translate(LOW))
    w, out = split(text), []
    for label, template in TEMPLATES.items():
        t = split(template)
        hits = [(i - j, i) for i in range(len(w) - k + 1) for j in range(len(t) - k + 1) if w[i:i + k] == t[j:j + k]]
        groups = []
        for d, i in sorted(hits):
            if not groups or d - groups[-1][-1][0] > gap:
                groups.append([])
            groups[-1].append((d, i))
        for g in groups:
            lo, hi = min(i for _, i in g), max(i for _, i in g) + k
            short = len(t) < 20
            inside = w[lo:hi] if short else w[max(0, lo - gap):hi + gap]
            table = [[0] * (len(t) + 1)]
            for x in inside:
                row = [0]
                for j, y in enumerate(t):
                    row.append(table[-1][j] + 1 if x == y else max(row[-1], table[-1][j + 1]))
                table.append(row)
            share = table[-1][-1] / len(t)
            if len(g) >= min(votes, max(1, -(-(len(t) - k + 1) // 2))) and share >= (1 if short else 0.5):
                out.append((label.split(":")[0], lo, hi, len(g), share))
    return sorted(out)


def test_spans_like_a_count_of_all_diagonals(spark):
    notices = [t for t in TEMPLATES.values()]
    rows = [(i, f"Some text {i}. {t} More text.") for i, t in enumerate(notices)]
    rows += [(100, "This work is licensed under the GNU General Public License, version 2."), (101, "Licensed under CC BY 4.0."),
             (102, notices[0] + " and " + notices[3] + " and " + notices[0]), (103, "released under the mit license " * 3), (104, "licensed under the apache license")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, text in rows:
        assert sorted(tuple(s) for s in got[i].spans) == brute_spans(text), text
    assert got[100].labels == "gpl" and "gpl-3.0" in got[list(TEMPLATES).index("gpl-3.0")].labels
    assert got[101].labels == "cc-by" and got[list(TEMPLATES).index("cc-by-nc-4.0")].labels == "cc-by,cc-by-nc-4.0"
