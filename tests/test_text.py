"""Every text function against its plain definition, on edge strings and documents."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import clean as C

EDGE = ["", " ", "a", "İstanbul Σίσυφος", "x\x85y z q\x1cw", "ﬁn ﬂow ＡＢ", "a‍b­c\x07d", "one\n\nOne \n two\r\nTWO\ttwo\n", "  lead  and trail \f\n\n x ", "é", "水門 は 閉じ", "la la la la la la", "A\nB\nA\n\nA\nb", "🌱 plants"]


def key(line):
    return " ".join(line.split()).strip().lower() if False else _collapse(line).strip().lower()


def _collapse(line):
    import re

    return re.sub(r"\s+", " ", line)


def repeated(text):
    seen, out = set(), []
    for line in text.splitlines():
        k = key(line)
        if k and k in seen:
            continue
        seen.add(k)
        out.append(line)
    return "\n".join(out)


def collapse(text):
    import re

    out = [re.sub(r"[ \t\f\v]+", " ", x).strip() for x in text.split("\n")]
    return "\n".join(x for x in out if x)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(list(enumerate(EDGE)) + [(99, None)], "doc_id int, text string")


def check(frame, column, definition):
    got = {r[0]: r[1] for r in frame.select("doc_id", column.alias("v")).collect()}
    assert {k: got[k] for k in range(len(EDGE))} == {k: definition(t) for k, t in enumerate(EDGE)}


def test_lines(frame):
    check(frame, T.lines("text"), str.splitlines)


def test_controls(frame):
    gone = lambda t: "".join(c for c in t if unicodedata.category(c)[0] != "C" or c in "\n\r\t")
    check(frame, T.remove_controls("text"), gone)
    check(frame, T.count_controls("text"), lambda t: len(t) - len(gone(t)))


def test_repeated_lines(frame):
    check(frame, T.remove_repeated_lines("text"), repeated)


def test_collapse(frame):
    check(frame, T.collapse_whitespace("text"), collapse)


def test_forms(frame):
    for form in ("NFC", "NFKC"):
        check(frame, T.unicode_form("text", form), lambda t, f=form: unicodedata.normalize(f, t))


def test_normalize(frame):
    def whole(t):
        t = unicodedata.normalize("NFKC", t)
        t = "".join(c for c in t if unicodedata.category(c)[0] != "C" or c in "\n\r\t")
        return collapse(repeated(t)).strip()

    check(frame, T.normalize("text"), whole)


def test_ratios(frame):
    letters = lambda t: sum(c.isalpha() for c in t)
    check(frame, T.alphabetic_ratio("text"), lambda t: letters(t) / max(sum(not c.isspace() for c in t), 1))
    latin = lambda t: sum(c.isalpha() and "LATIN" in unicodedata.name(c, "") for c in t)
    check(frame, T.latin_ratio("text"), lambda t: latin(t) / letters(t) if letters(t) else 0.0)

    def dup(t):
        k = [key(x) for x in t.splitlines() if key(x)]
        return (len(k) - len(set(k))) / len(k) if len(k) > 1 else 0.0

    check(frame, T.duplicate_line_ratio("text"), dup)


def test_tokens(frame):
    import re

    words = lambda t: re.findall(r"\w+", t.lower())
    check(frame, T.word_tokens("text"), words)
    check(frame, T.estimated_tokens("text"), lambda t: max(1, round(len(t) / 4)) if t else 0)
    check(frame, T.byte_tokens("text"), lambda t: [b + 2 for b in t.encode()])
    grams = lambda t, n: {" ".join(words(t)[k : k + n]) for k in range(max(1, len(words(t)) - n + 1))} if words(t) else set()
    check(frame, F.array_sort(T.shingles(T.word_tokens("text"), 2)), lambda t: sorted(grams(t, 2)))
    check(frame, F.array_sort(T.ngrams(T.word_tokens("text"), 3)), lambda t: sorted(grams(t, 3)) if len(words(t)) >= 3 else [])
    check(frame, T.repetition_ratio("text"), lambda t: 1 - len({tuple(t.lower().split()[k : k + 4]) for k in range(len(t.split()) - 3)}) / (len(t.split()) - 3) if len(t.split()) > 3 else 0.0)


def test_html(spark):
    page = "<html><head><title>x</title></head><body><script>var a = 1 < 2;</script><h1>Title</h1><p>One &amp; two<br>three</p><!-- no --><ul><li>a</li><li>b</li></ul></body></html>"
    got = spark.createDataFrame([(page,)], "html string").select(T.html_text("html")).first()[0]
    assert got == "Title\nOne & two\nthree\na\nb"


def test_quality_reasons(spark):
    words = "word " * 60
    rows = [words, "short", "1234 " * 60, "\n".join(["same line here"] * 30 + ["x" * 200]), words + "See our Cookie Policy", "水門は閉じ" * 60, None, "  "]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")
    got = {r.doc_id: list(r.reasons) for r in C.clean(d).collect()}
    assert got == {0: [], 1: ["too_short"], 2: ["low_alphabetic_ratio", "language_filter"], 3: ["high_duplicate_line_ratio"], 4: ["boilerplate_phrase"], 5: ["language_filter"]}
    assert {r.reason: r.n for r in C.discard_counts(C.clean(d)).collect()}["language_filter"] == 2
    assert C.clean(d.limit(0)).count() == 0
    assert got[0] == [] and [r.doc_id for r in C.rejected_samples(C.clean(d), n=2).collect()] == [1, 2]
