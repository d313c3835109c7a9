"""Problem 7: passages of evaluation items inside the corpus.

The normalised items become passages of eight consecutive words (all words, of a shorter item) in
one Aho-Corasick automaton; every document is scanned once.  Offsets of a hit are mapped back to
the original text through the word spans.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

from pyspark.sql import DataFrame, functions as F

from .common import _INVISIBLE, arrow_map, fold, word_pattern, words

PASSAGE_WORDS = 8
#: Characters of passages in one automaton; more items than fit are scanned in further blocks.
BLOCK_CHARS = 64 << 20


def items(surface: DataFrame, application: DataFrame, recall: DataFrame) -> DataFrame:
    """(item_id, text) of the held-out fields: surface text, application question, recall answer."""
    return (
        surface.select(F.col("id").alias("item_id"), "text")
        .unionByName(application.select(F.col("id").alias("item_id"), F.col("question").alias("text")))
        .unionByName(recall.select(F.col("id").alias("item_id"), F.col("answer").alias("text")))
    )


def passages(rows, size: int = PASSAGE_WORDS) -> dict[str, list[str]]:
    """Passage to the items that hold it; an item without words has none."""
    out: dict[str, set[str]] = defaultdict(set)
    for item_id, text in rows:
        w = words(text)
        if w and item_id is not None:
            for i in range(max(1, len(w) - size + 1)):
                out[f" {' '.join(w[i : i + size])} "].add(item_id)
    return {k: sorted(v) for k, v in out.items()}


def blocks(found: dict[str, list[str]], chars: int = BLOCK_CHARS):
    now, size = {}, 0
    for k, v in sorted(found.items()):
        if now and size + len(k) > chars:
            yield now
            now, size = {}, 0
        now[k] = v
        size += len(k)
    if now:
        yield now


_BUILT: dict[int, object] = {}


def automaton(found: dict[str, list[str]], key: int):
    """The automaton of a block, built once a worker."""
    if key not in _BUILT:
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, v in found.items():
            a.add_word(k, (len(k), v))
        a.make_automaton()
        _BUILT.clear()
        _BUILT[key] = a
    return _BUILT[key]


def spans(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) with offsets in the original text.

    Folding may change lengths, so the text is folded in pieces that start at a character which
    neither composes with the one before nor is invisible; each folded character carries the
    offsets of its piece.
    """
    chars, begin, end = [], [], []
    at, n = 0, len(text)
    while at < n:
        to = at + 1
        while to < n and (unicodedata.combining(text[to]) or _INVISIBLE.match(text[to])):
            to += 1
        for c in fold(text[at:to]):
            chars.append(c), begin.append(at), end.append(to)
        at = to
    return [(m.group(), begin[m.start()], end[m.end() - 1]) for m in word_pattern().finditer("".join(chars))]


def _scan(docs: DataFrame, held_out: DataFrame, with_spans: bool, size: int, chars: int) -> DataFrame:
    # The held-out tables are the query set: of fixed size, read by the driver and sent once a block.
    found = passages(((r.item_id, r.text) for r in held_out.toLocalIterator()), size)
    spark = docs.sparkSession
    schema = "doc_id long, item_id string" + (", start int, end int" if with_spans else "")
    out = None
    for block in blocks(found, chars) if found else [{}]:
        shared = spark.sparkContext.broadcast(block)
        key = hash(frozenset(block)) ^ id(shared)

        def each(batch, shared=shared, key=key):
            a = automaton(shared.value, key) if shared.value else None
            got: dict[str, list] = {"doc_id": [], "item_id": [], "start": [], "end": []}
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or a is None:
                    continue
                line = f" {' '.join(words(text))} "
                hits: dict[str, list[tuple[int, int]]] = defaultdict(list)
                for at, (length, ids) in a.iter(line):
                    for item in ids:
                        hits[item].append((at - length + 1, at))
                if hits and with_spans:
                    where = spans(text)
                    for item, places in hits.items():
                        first = [line.count(" ", 0, p) for p, _ in places]
                        last = [line.count(" ", 0, q) - 1 for _, q in places]
                        # Overlapping passages of one item are one leaked stretch.
                        k = 0
                        while k < len(first):
                            stop = last[k]
                            m = k
                            while m + 1 < len(first) and first[m + 1] <= stop + 1:
                                m += 1
                                stop = max(stop, last[m])
                            got["doc_id"].append(i), got["item_id"].append(item)
                            got["start"].append(where[first[k]][1]), got["end"].append(where[stop][2])
                            k = m + 1
                else:
                    for item in hits:
                        got["doc_id"].append(i), got["item_id"].append(item)
            return got

        part = arrow_map(docs.select("doc_id", "text").where("doc_id is not null"), each, schema)
        out = part if out is None else out.unionByName(part)
    return out if len(found) == 0 or with_spans else out.distinct()


def leaks(docs: DataFrame, held_out: DataFrame, size: int = PASSAGE_WORDS, chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id), once a pair.  Null and empty texts or items take no part."""
    return _scan(docs, held_out, False, size, chars)


def leak_spans(docs: DataFrame, held_out: DataFrame, size: int = PASSAGE_WORDS, chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end): the stretches of the original text, in characters."""
    return _scan(docs, held_out, True, size, chars)
