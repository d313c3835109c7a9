"""Column functions on text: normalization, lines, ratios, tokens, shingles, hashes.

Everything here is an expression over built-in functions, so it stays inside the JVM.  The one
exception is the Unicode form, which has no built-in: it runs as an Arrow function and only on rows
that are not plain ASCII.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F

# Character classes as Java patterns that agree with the text model of the pipeline.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
NOT_SPACE = r"[^\t-\r\x1c-\x20\x85\xa0  -     　]"
NEWLINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
WORD = r"[\p{L}\p{N}_]+"
CONTROL = r"[\p{C}&&[^\n\r\t]]"

Text = Column | str


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body names it.

    The optimizer inlines columns into lambdas, where they would be computed for every element; a
    lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Text) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Text) -> Column:
    return ~F.coalesce(F.regexp_like(col(c), F.lit(NOT_SPACE)), F.lit(False))


def lines(c: Text) -> Column:
    """The lines of a text; a final line end opens no further line; an empty text has none."""
    return let(F.split(col(c), NEWLINE, -1), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def line_key(line: Text) -> Column:
    return F.lower(strip(F.regexp_replace(col(line), f"{SPACE}+", " ")))


def duplicate_line_ratio(c: Text) -> Column:
    keys = F.filter(F.transform(lines(c), line_key), lambda k: k != "")
    return let(keys, lambda k: F.when(F.size(k) <= 1, F.lit(0.0)).otherwise((F.size(k) - F.size(F.array_distinct(k))) / F.size(k)))


def remove_controls(c: Text) -> Column:
    return F.regexp_replace(col(c), CONTROL, "")


def count_controls(c: Text) -> Column:
    return F.regexp_count(col(c), F.lit(CONTROL))


def remove_repeated_lines(c: Text) -> Column:
    """Keeps the first of lines with one key; blank lines stay; all separators become line feeds.

    Sorting (key, position) brings equal keys together, so the cost is n log n in the lines.
    """
    entries = F.array_sort(F.transform(lines(c), lambda x, i: F.struct(line_key(x).alias("k"), i.alias("i"), x.alias("x"))))

    def first_of_key(e: Column) -> Column:
        # Neighbours by zipping with the entries shifted by one: constant cost a line.
        before = F.concat(F.array(F.lit(None).cast("string")), F.transform(F.slice(e, 1, F.greatest(F.size(e) - 1, F.lit(0))), lambda x: x["k"]))
        pairs = F.zip_with(e, before, lambda x, k: F.struct(x["i"].alias("i"), x["x"].alias("x"), ((x["k"] == "") | k.isNull() | (x["k"] != k)).alias("keep")))
        return F.array_join(F.transform(F.array_sort(F.filter(pairs, lambda p: p["keep"])), lambda p: p["x"]), "\n")

    return let(entries, first_of_key)


def collapse_whitespace(c: Text) -> Column:
    """Runs of blanks in a line become one space; lines are stripped, empty ones dropped."""
    parts = F.transform(F.split(col(c), "\n", -1), lambda x: strip(F.regexp_replace(x, r"[ \t\f\x0b]+", " ")))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def normalize(c: Text, form: str | None = "NFKC") -> Column:
    """The cleaning order: Unicode form, controls, repeated lines, white space, strip."""
    base = unicode_form(c, form) if form else col(c)
    return strip(collapse_whitespace(remove_repeated_lines(remove_controls(base))))


def unicode_form(c: Text, form: str) -> Column:
    c = col(c)

    @F.arrow_udf("string")
    def normal(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize(form, x) for x in v.to_pylist()], pa.string())

    return F.when(F.octet_length(c) == F.length(c), c).otherwise(normal(c))


def alphabetic_ratio(c: Text) -> Column:
    """Letters among the characters that are not white space; 0 without any."""
    return F.coalesce(F.try_divide(F.regexp_count(col(c), F.lit(r"\p{L}")), F.regexp_count(col(c), F.lit(NOT_SPACE))), F.lit(0.0))


def latin_ratio(c: Text) -> Column:
    """Latin letters among the letters; 0 without any."""
    return F.coalesce(F.try_divide(F.regexp_count(col(c), F.lit(r"[\p{L}&&\p{IsLatin}]")), F.regexp_count(col(c), F.lit(r"\p{L}"))), F.lit(0.0))


def estimated_tokens(c: Text) -> Column:
    """A quarter of the characters, half to even, at least 1; 0 for an empty text."""
    n = F.length(col(c))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), F.bround(n / 4).cast("long")))


def content_hash(c: Text) -> Column:
    return F.sha2(col(c), 256)


def stable_id(source: Text, key: Text) -> Column:
    return F.substring(F.sha2(F.concat(col(source), F.lit("\n"), col(key)), 256), 1, 24)


def dedup_key(c: Text) -> Column:
    """White space runs as one space, stripped, lower case."""
    return F.lower(F.trim(F.regexp_replace(col(c), f"{SPACE}+", " ")))


def answer_key(c: Text) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9 ]", " "), " +", " "))


def word_tokens(c: Text) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD), F.lit(0))


def windows(tokens: Column, size: int | Column) -> Column:
    """Every run of ``size`` tokens, joined by spaces; one run of all of them if there are fewer."""
    return let(
        F.struct(tokens.alias("w"), (F.lit(size) if isinstance(size, int) else size).alias("k")),
        lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.size(s["w"]) - s["k"] + 1, F.lit(1))), lambda i: F.array_join(F.slice(s["w"], i, s["k"]), " ")),
    )


def shingles(tokens: Column, size: int) -> Column:
    """The set of runs; empty without tokens."""
    return let(tokens, lambda w: F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(windows(w, size))))


def ngrams(tokens: Column, size: int | Column) -> Column:
    """The set of runs; empty with fewer tokens than ``size``."""
    return let(tokens, lambda w: F.when(F.size(w) < size, F.array().cast("array<string>")).otherwise(F.array_distinct(windows(w, size))))


def effective_ngram(tokens: Column, size: int) -> Column:
    """The run length for a text: ``size``, or all its tokens if at least three, else 0."""
    n = F.size(tokens)
    return F.when(n >= size, F.lit(size)).when(n >= 3, n).otherwise(F.lit(0))


def repetition_ratio(c: Text, size: int = 4) -> Column:
    tokens = F.filter(F.split(F.lower(strip(c)), f"{SPACE}+"), lambda x: x != "")
    return let(tokens, lambda w: F.when(F.size(w) < size, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(windows(w, size))) / (F.size(w) - size + 1)))


def lexical_drift(a: Text, b: Text) -> Column:
    """One less the Jaccard similarity of the lower-case tokens; 0 if both are empty."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(strip(v)), f"{SPACE}+"), lambda t: t != "")) for v in (a, b))
    both = F.struct(x.alias("x"), y.alias("y"))
    return let(both, lambda s: F.when((F.size(s["x"]) == 0) & (F.size(s["y"]) == 0), F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(s["x"], s["y"])) / F.size(F.array_union(s["x"], s["y"]))))


def byte_tokens(c: Text) -> Column:
    """UTF-8 bytes plus 2; 0 pads and 1 ends, so the vocabulary has 258 ids."""
    c = col(c)

    @F.arrow_udf("array<int>")
    def encode(v: pa.Array) -> pa.Array:
        import numpy as np

        v = v.cast(pa.binary()) if v.null_count == 0 else v.fill_null("").cast(pa.binary())
        offsets = np.frombuffer(v.buffers()[1], np.int32, len(v) + 1, v.offset * 4)
        data = np.frombuffer(v.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.int32) + 2
        return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(data))

    return F.when(c.isNull(), F.lit(None)).otherwise(encode(c))


# HTML elements whose content is no text, and elements that end a line.
_DROPPED = r"(?is)<(script|style|noscript|template|svg|head)\b.*?</\1\s*>|<!--.*?-->"
_BLOCK = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|main|blockquote|pre)\b[^>]*>"


def html_text(c: Text) -> Column:
    """The text of an HTML page: scripts, styles and comments out, blocks as lines, entities decoded."""
    x = F.regexp_replace(col(c), _DROPPED, " ")
    x = F.regexp_replace(F.regexp_replace(x, _BLOCK, "\n"), r"<[A-Za-z/!][^>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return collapse_whitespace(x)
