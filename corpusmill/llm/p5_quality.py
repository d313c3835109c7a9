"""Problem 5: statistics of the quality of each text, and which texts are not prose.

Counts and ratios of words, symbols, lines and common words, with repetition statistics: shares of
duplicate lines and paragraphs, and the share of the characters that the dominant word n-gram
covers.  A text is told from lists, tables and junk by combined rules over its lines and sentences.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter

from pyspark.sql import DataFrame

from . import p10_residue
from .common import Durable, arrow_map, flat, fold, words

NGRAM = 3
#: Words of a phrase whose repetition counts wherever it stands.
PHRASE = 5
#: Words that a line or sentence of prose has at least, and a sentence at most.
LINE_WORDS, SENTENCE_WORDS, SENTENCE_MOST = 7, 4, 60
#: Share of common words in prose, at least.
COMMON_SHARE = 0.1
#: A text is prose if at least this share of its words is in prose lines or sentences.
PROSE_SHARE = 0.5
#: Duplicate sentences, lines or phrases, or one n-gram's characters, above this share make a text repetition.
REPEAT_SHARE = 0.5

# Function words that frequency lists of single words often lack.
FUNCTION_WORDS = frozenset(
    "its without every any must never cannot no than what who how each should can may be only above below against near beside"
    " sa ses leur leurs aux ces cette cet si même entre contre sous chez dont où ne tout tous"
    " einer eines einem einen bei beim vom ins oder wenn wie nur noch über unter nach zwei"
    " lo le les este esta estos estas hay muy ni ya sobre otro otra".split()
)
#: Symbols among the visible characters of prose, at most.
SYMBOL_SHARE = 0.35
#: Share of the lines of prose without punctuation, broken anywhere, that end in a function word.
BROKEN_SHARE = 0.08
#: Words in a cell below which a line with several cells is a row of a table.
CELL_WORDS = 2.5

#: Share of common words below which a text is in none of the listed languages; of its words those
#: that are short and come again, at least; letters of a sentence without spaces, at least.
UNLISTED_SHARE, AGAIN_SHARE, SPACELESS_LETTERS = 0.05, 0.06, 6

# The patterns see folded text.
_SPACELESS = re.compile(r"[^。!?।]+[。!?।]")
_MARK = re.compile(r"\s*(?:[-*•–—·>]+|\[[ x]?\]|\(?\d{1,3}[.)]|[a-z][.)])\s+")
_LEADER = re.compile(r"\.{4,}|_{4,}|(?: \.){4,}")
_CELLS = re.compile(r"\t+|\||\s{3,}")
_FIELD = re.compile(r"\s*[\"']?[^\W\d_][\w .\-]{0,30}[\"']?\s*[:=]\s*\S")
_CODE = re.compile(r"\s*(?:def|class|return|import|from|if|for|while|elif|else|try|public|private|static|void|function|var|let|const|#include|select)\b.*(?:\(.*\)|[:;{])\s*$|\s*return \w+\s*$|\s*\w+ = .+|.*[;{}]\s*$")
_LOG = re.compile(r"\W*\d{4}-\d\d-\d\d[t ]\d\d:\d\d.*\b(?:info|debug|warn|trace|error)\b")
_OTHER_BREAKS = "\r\v\f\x1c\x1d\x1e\x85\u2028\u2029"
_BLANKS = " \n\t\r\v\f\x1c\x1d\x1e\x1f"
# The marks that end sentences, in several scripts.
_MARKS = (".", "!", "?", "…", "。", "।", "؟", "۔")
_CLOSERS = " \t\r\f\v\xa0\"'”»“«)]"
_CODE_SIGNS = re.compile(r"[(=;{}:#]|return")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»“«)\]]*\s+")


def _ends(text: str) -> bool:
    """Whether the text ends in a sentence's mark, quotes and brackets aside."""
    return text.rstrip(_CLOSERS)[-1:] in _MARKS


def _odd_line(line: str, n: int) -> bool:
    """Whether a line by its form belongs to a table, a list with leaders, a log or code."""
    if "...." in line or "____" in line or ". . . ." in line:
        if _LEADER.search(line):
            return True
    if ("\t" in line or "|" in line or "   " in line) and (cells := len(_CELLS.findall(line.strip()))) >= 2:
        return n < CELL_WORDS * (cells + 1) or "|" in line and line.count("|") >= 3
    if " " not in line.strip() and line.count(";") + line.count(",") >= 2:
        return True
    if line[:1].isdigit() and _LOG.match(line):
        return True
    return bool(_CODE_SIGNS.search(line) and _CODE.match(line)) and not _ends(line)


def _prosy(w: list[str], common) -> bool:
    """Whether the words read like prose: common words, few bare numbers."""
    n = len(w)
    c = sum(map(common.__contains__, w))
    return c > 0 and c >= COMMON_SHARE * n and sum(map(str.isalpha, w)) >= 0.6 * n


def _unlisted(w: list[str], lines: list[str], common) -> float | None:
    """The share of prose of a text in a language of which no common words are listed; None if it may be in a listed one.

    Prose of any language has ended sentences of some words, among them short ones that come again
    and again; in scripts that leave no space between words, ended sentences of some letters.
    """
    if len(w) < SENTENCE_WORDS or sum(map(common.__contains__, w)) > UNLISTED_SHARE * len(w):
        return None
    letters = sum(map(len, w))
    if letters > 12 * len(w):
        ended = 0
        for line in lines:
            for s in _SPACELESS.findall(line):
                size = sum(map(str.isalpha, s))
                ended += size if size >= SPACELESS_LETTERS else 0
        return ended / max(letters, 1)
    counts = Counter(w)
    again = sum(n for x, n in counts.items() if n > 1 and len(x) <= 4 and x.isalpha())
    if again < AGAIN_SHARE * len(w) or len(counts) < 0.3 * len(w):
        return 0.0
    prose = 0
    for s in _SENTENCE.split(" ".join(lines)):
        x = flat(s).split()
        short = sum(len(y) <= 3 for y in x)
        if LINE_WORDS <= len(x) <= SENTENCE_MOST and _ends(s) and s.count(",") <= 0.25 * len(x) and 0.08 * len(x) <= short <= 0.7 * len(x) and sum(map(str.isalpha, x)) >= 0.8 * len(x):
            prose += len(x)
    return prose / len(w)


def _prose_words(lines: list[str], found: list[list[str]], common) -> int:
    """Words in prose.

    By lines of some length first; where they make up less than half, by sentences over line
    breaks.  Marked short lines are list items and break sentences, as do odd lines.
    """
    total = sum(map(len, found))
    by_line, runs, run = 0, [], []
    for line, w in zip(lines, found):
        n = len(w)
        if not n:
            continue
        marked = _MARK.match(line)
        if _odd_line(line, n) or marked and n < LINE_WORDS and not _ends(line):
            runs.append(run)
            run = []
            continue
        run.append((line[marked.end() :] if marked else line, w))
        if n >= LINE_WORDS and line.count(",") <= 0.25 * n and _prosy(w, common):
            by_line += n
    runs.append(run)
    if by_line >= PROSE_SHARE * total:
        return by_line
    prose = 0
    for run in filter(None, runs):
        joined = " ".join(x for x, _ in run)
        inner = run[:-1]
        broken = sum(w[-1] in common for _, w in inner) >= BROKEN_SHARE * len(inner) if len(inner) > 1 else False
        for s in _SENTENCE.split(joined):
            w = flat(s).split()
            n = len(w)
            if n < SENTENCE_WORDS or s.count(",") > 0.25 * n or not _prosy(w, common):
                continue
            ended = _ends(s)
            if ended and n <= SENTENCE_MOST or len(run) == 1 and n >= LINE_WORDS or broken:
                prose += n
    return max(prose, by_line)


def _repeat_share(folded: str) -> float:
    """Share of the characters in sentences and lines that repeat an earlier one."""
    seen: set[str] = set()
    again = total = 0
    for part in folded.replace("\n", ".").replace("!", ".").replace("?", ".").split("."):
        part = part.strip()
        total += len(part)
        if len(part) > 10:
            if part in seen:
                again += len(part)
            seen.add(part)
    return again / max(total, 1)


def _top_share(w: list[str]) -> float:
    """Share of the characters that the n-gram covers that covers most; occurrences may overlap."""
    counts = Counter(zip(*(w[k:] for k in range(NGRAM))))
    most = max((c * sum(map(len, g)) for g, c in counts.items() if c > 1), default=0)
    return min(1.0, most / max(sum(map(len, w)), 1))


def _again_share(parts: list[tuple]) -> float:
    """Share of the characters of the words in lines, or paragraphs, that repeat an earlier one."""
    if len(set(parts)) == len(parts):
        return 0.0
    seen: set[tuple] = set()
    again = total = 0
    for key in parts:
        size = sum(map(len, key))
        total += size
        if key in seen:
            again += size
        seen.add(key)
    return again / max(total, 1)


def _paragraphs(folded: str, spaced: str) -> list[tuple]:
    """The words of each paragraph; blank lines are between them."""
    out: list[tuple] = []
    now: list[str] = []
    for line, plain in zip(folded.split("\n"), spaced.split("\n")):
        if line and not line.isspace():
            now += plain.split()
        elif now:
            out.append(tuple(now))
            now = []
    return [*out, tuple(now)] if now else out


def _phrase_share(w: list[str]) -> float:
    """Share of the characters in phrases of PHRASE words that repeat an earlier one; each word counts once.

    Longer phrases that repeat consist of such.
    """
    grams = list(zip(*(w[k:] for k in range(PHRASE))))
    # A share needs as many repeated phrases, at least one for each PHRASE words it covers.
    if len(set(grams)) == len(grams):
        return 0.0
    seen: set[tuple] = set()
    again = end = 0
    for k, g in enumerate(grams):
        if g in seen:
            again += sum(map(len, w[max(k, end) : k + PHRASE]))
            end = k + PHRASE
        else:
            seen.add(g)
    return again / max(sum(map(len, w)), 1)


def measure(text: str | None, common, folded: str | None = None, spaced: str | None = None, every: bool = True) -> dict | None:
    """The statistics of one text; None if it is null, empty or blank.

    ``folded`` and ``spaced`` are ``fold(text)`` and ``flat(folded)``, where the caller has them.
    Without ``every``, repetition is left out where it cannot decide: text that repeats more than
    REPEAT_SHARE leaves less than the rest, and one occurrence, to different words.
    """
    if not text or text.isspace():
        return None
    if folded is None:
        folded = fold(text)
        spaced = flat(folded)
    if any(c in folded for c in _OTHER_BREAKS):
        folded = "\n".join(folded.splitlines())
        spaced = flat(folded)
    lines, found = [], []
    for line, plain in zip(folded.split("\n"), spaced.split("\n")):
        if line and not line.isspace():
            lines.append(line), found.append(plain.split())
    w = list(itertools.chain.from_iterable(found))
    n, size = len(w), max(len(w), 1)
    letters = len(spaced) - spaced.count(" ") - spaced.count("\n")
    graph = len(folded) - sum(map(folded.count, _BLANKS)) if folded.isascii() else sum(map(len, folded.split()))
    different = set(w)
    fields = sum(bool(_FIELD.match(x)) for x in lines if ":" in x or "=" in x) if len(lines) > 2 else 0
    record = fields > 0.7 * len(lines) and n < 14 * len(lines)
    out = {
        "n_words": n,
        "mean_word_length": letters / size,
        "symbol_ratio": max(graph - letters, 0) / max(graph, 1),
        "n_lines": len(lines),
        "line_end_share": sum(map(_ends, lines)) / max(len(lines), 1) if every else None,
        "common_share": sum(map(common.__contains__, w)) / size if every else None,
        "unique_share": len(different) / size,
        "number_share": sum(map(str.isdigit, w)) / size if every else None,
        "prose_share": 0.0 if record else min(1.0, _prose_words(lines, found, common) / size),
    }
    if out["prose_share"] < PROSE_SHARE and not record and (share := _unlisted(w, lines, common)) is not None:
        out["prose_share"] = max(out["prose_share"], min(1.0, share))
    left = (1 - REPEAT_SHARE) * letters
    if every or len(different) < n and sum(map(len, different)) - NGRAM * max(map(len, different)) <= left:
        for name, share in (
            ("dup_line_share", lambda: _again_share(list(map(tuple, found)))), ("dup_paragraph_share", lambda: _again_share(_paragraphs(folded, spaced))),
            ("repeat_share", lambda: _repeat_share(folded)), ("top_ngram_share", lambda: _top_share(w)), ("phrase_share", lambda: _phrase_share(w)),
        ):
            out[name] = share()
            if out[name] > REPEAT_SHARE and not every:
                break
    return out


def is_prose(m: dict | None) -> bool | None:
    """Whether most of a text is natural prose, by its statistics; None without any."""
    if m is None:
        return None
    return m["n_words"] > 0 and m["prose_share"] >= PROSE_SHARE and m["symbol_ratio"] <= SYMBOL_SHARE and max(m.get(k, 0.0) for k in REPETITION) <= REPEAT_SHARE


REPETITION = ("dup_line_share", "dup_paragraph_share", "top_ngram_share", "phrase_share", "repeat_share")
COLUMNS = {
    "n_words": "long", "mean_word_length": "double", "symbol_ratio": "double", "n_lines": "long", "line_end_share": "double",
    "common_share": "double", "unique_share": "double", "number_share": "double", "dup_line_share": "double", "dup_paragraph_share": "double",
    "top_ngram_share": "double", "phrase_share": "double", "prose_share": "double", "repeat_share": "double",
}


def common_words(rows: DataFrame) -> set[str]:
    """The folded words of the table of frequent words, a fixed table, with the function words."""
    return {x for r in rows.select("word").toLocalIterator() for x in words(r.word)} | FUNCTION_WORDS


def statistics(docs: DataFrame, common: set[str]) -> DataFrame:
    """One row a document, with every statistic; null, empty and blank texts have nulls.

    Input columns doc_id and text; whole texts are measured, whatever their length.
    """
    schema = ", ".join(["doc_id long", *(f"{k} {v}" for k, v in COLUMNS.items()), "prose boolean"])

    def each(batch):
        out: dict[str, list] = {"doc_id": batch.column(0), "prose": []} | {k: [] for k in COLUMNS}
        for text in batch.column(1).to_pylist():
            m = measure(text, common)
            for k in COLUMNS:
                out[k].append(m and m[k])
            out["prose"].append(is_prose(m))
        return out

    return arrow_map(docs.select("doc_id", "text").where("doc_id is not null"), each, schema)


def not_prose(docs: DataFrame, common: set[str]) -> DataFrame:
    """(doc_id) of the texts that are mostly no prose; texts of problem 10 are left to it.

    ``docs`` has doc_id, text and host.
    """
    work = Durable(docs.sparkSession)
    lexicon = p10_residue.filler_lexicon(docs, common)

    def each_text(text, folded, spaced):
        if is_prose(measure(text, common, folded, spaced, every=False)) is False and not p10_residue.verdict(text, lexicon, spaced.split()):
            return "other", text

    scanned = p10_residue.scan(docs, work, each_text)
    found = scanned.where("doc_id is not null")
    # Of these, the ones whose residual is a case of problem 10; their texts stand in the scan.
    cases = p10_residue.residual_kinds(found.select("doc_id", "text", "h"), p10_residue.recurrent(scanned, work), lexicon)
    ids = found.select("doc_id")
    return ids if cases is None else ids.join(cases, "doc_id", "left_anti")
