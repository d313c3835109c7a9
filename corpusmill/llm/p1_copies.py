"""Problem 1: records that differ only in layout, collapsed and counted.

The canonical bytes of a text are its folded words in order and, of a record of named fields, its
fields sorted by name besides; a class is the union of both, so that equal words always meet.  They
are partitioned by radix: prefixes are counted, and a bucket that is
too large is split by twice as many further bytes until each fits or holds one single text.  Each
bucket is then counted in a trie of byte strings with terminal counters.  Equal texts of one input
batch are merged before the shuffle, so a text that a third of all rows share reaches its bucket as
one row a batch.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Durable, arrow_map, digest, join_unique, words
from .p3_versions import SENT, components

FIRST_BYTES = 4
BUCKET_ROWS = 50_000
BUCKET_BYTES = 16 << 20
_FIELD = re.compile(r"\s*[\"']?([^\W\d_][\w .\-]{0,39}?)[\"']?\s*[:=]\s*(\S.*?|)\s*\Z", re.S)
_SPLITS = (re.compile(r"[;\n\r]+").split, lambda s: s.split("|"), lambda s: s.split(","))


def _leaves(value, path: str = ""):
    """(path, value) of the leaves of a JSON value; names and places are the path."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _leaves(v, f"{path} {k}" if path else str(k))
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from _leaves(v, f"{path} {k}")
    else:
        yield path, "" if value is None else str(value)


def fields_of(text: str) -> list[tuple[str, str]] | None:
    """The (name, value) pairs of a text that is a record of named fields, else None.

    A record is a JSON object, of which the leaves are the fields, or at least two parts, split at
    line ends and semicolons, else at bars, else at commas, each of them ``name: value`` or
    ``name=value`` with different names.
    """
    s = text.strip()
    if s[:1] == "{" and s[-1:] == "}":
        try:
            got = json.loads(s, parse_float=str, parse_int=str, parse_constant=str)
        except (ValueError, RecursionError):
            got = None
        if isinstance(got, dict) and got:
            return list(_leaves(got))
    for split in _SPLITS:
        out = []
        parts = [x for x in split(s) if x.strip()]
        if len(parts) < 2:
            continue
        for part in parts:
            m = _FIELD.match(part)
            if not m:
                break
            out.append(m.groups())
        else:
            if len({" ".join(words(k)) for k, _ in out}) == len(out):
                return out
    return None


def canonical(text: str | None) -> bytes | None:
    """Canonical bytes; None where a text has no words (null, empty, blank, only signs)."""
    if not text:
        return None
    if (":" in text or "=" in text) and (got := fields_of(text)):
        return ("R" + "\n".join(sorted(" ".join(words(k)) + "\t" + " ".join(words(v)) for k, v in got))).encode()
    got = words(text)
    return ("T" + " ".join(got)).encode() if got else None


def canon_table(docs: DataFrame) -> DataFrame:
    """(doc_id, canon, digest, record) of the documents that have words.

    A row by the words of each, with the digest of its fields in ``record`` if it is a record, and
    of a record a row by its fields, which has no doc_id but its own in ``holder``.
    """

    def each(batch):
        ids, out, key, record, holder = [], [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            c = canonical(text)
            if c is None:
                continue
            fields = None
            if c[:1] == b"R":
                fields = digest(c)
                ids.append(None), out.append(c), key.append(fields), record.append(None), holder.append(i)
                c = ("T" + " ".join(words(text))).encode()
            ids.append(i), out.append(c), key.append(digest(c)), record.append(fields), holder.append(i)
        return {"doc_id": ids, "canon": out, "digest": key, "record": record, "holder": holder}

    return arrow_map(docs.select("doc_id", "text").where("doc_id is not null"), each, "doc_id long, canon binary, digest binary, record binary, holder long")


class Trie:
    """Byte strings on edges; a node that ends a text counts its copies and keeps the least id."""

    __slots__ = ("edges", "label", "count", "first")

    def __init__(self, label: bytes = b""):
        self.edges: dict[int, Trie] = {}
        self.label, self.count, self.first = label, 0, None

    def add(self, text: bytes, count: int, first: int) -> None:
        node, at, end = self, 0, len(text)
        while at < end:
            below = node.edges.get(text[at])
            if below is None:
                below = node.edges[text[at]] = Trie(text[at:])
                at = end
            elif text.startswith(below.label, at):
                at += len(below.label)
            else:
                label, same = below.label, 1
                most = min(len(label), end - at)
                while same < most and label[same] == text[at + same]:
                    same += 1
                middle = node.edges[text[at]] = Trie(label[:same])
                below.label = label[same:]
                middle.edges[below.label[0]] = below
                below = middle
                at += same
            node = below
        node.count += count
        node.first = first if node.first is None else min(node.first, first)

    def items(self):
        """(text, count, first) of every text, in byte order."""
        stack = [(self, b"")]
        while stack:
            node, before = stack.pop()
            text = before + node.label
            if node.count:
                yield text, node.count, node.first
            stack.extend((node.edges[k], text) for k in sorted(node.edges, reverse=True))


def oversized(canon: DataFrame, rows: int, size: int, first_bytes: int) -> dict[int, set[bytes]]:
    """By length, the prefixes of the buckets that do not fit.

    One distributed count a length over the rows still in an oversized bucket; only the prefixes
    above the limits come back, at most total / limit of them.  A bucket whose texts are all the
    prefix itself ends there: it is one text.
    """
    found: dict[int, set[bytes]] = {}
    length, left = first_bytes, canon.select("canon")
    while True:
        counted = (
            left.where(F.octet_length("canon") > length)
            .groupBy(F.substring("canon", 1, length).alias("prefix"))
            .agg(F.count("*").alias("n"), F.sum(F.octet_length("canon")).alias("size"),
                 F.min("canon").alias("least"), F.max("canon").alias("most"))
            .where((F.col("n") > rows) | (F.col("size") > size))
            .where(F.col("least") != F.col("most"))
        )
        big = {bytes(r.prefix) for r in counted.select("prefix").toLocalIterator()}
        if not big:
            return found
        found[length] = big
        session = canon.sparkSession
        keys = session.createDataFrame([(bytearray(p),) for p in sorted(big)], "prefix binary")
        left = left.join(F.broadcast(keys), F.substring("canon", 1, length) == F.col("prefix"), "left_semi")
        length *= 2


def copy_classes(canon: DataFrame, rows: int = BUCKET_ROWS, size: int = BUCKET_BYTES, first_bytes: int = FIRST_BYTES) -> DataFrame:
    """(digest, first_id, copies, record) of each different text, counted in a trie for each radix bucket."""
    large = oversized(canon, rows, size, first_bytes)

    def bucket(text: bytes) -> bytes:
        length = first_bytes
        while length in large and text[:length] in large[length]:
            length *= 2
        return text[:length]

    def merge(batch):
        seen: dict[bytes, list] = {}
        for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if c in seen:
                seen[c][0] += 1
                seen[c][1] = min(seen[c][1], i)
            else:
                seen[c] = [1, i]
        return {"bucket": [bucket(c) for c in seen], "canon": list(seen), "n": [v[0] for v in seen.values()], "first": [v[1] for v in seen.values()]}

    merged = arrow_map(canon.select("holder", "canon"), merge, "bucket binary, canon binary, n long, first long")

    def count(batches):
        def out(trie):
            rows = list(trie.items())
            return pa.RecordBatch.from_arrays(
                [pa.array([digest(t) for t, _, _ in rows], pa.binary()), pa.array([f for _, _, f in rows], pa.int64()), pa.array([n for _, n, _ in rows], pa.int64()), pa.array([t[:1] == b"R" for t, _, _ in rows], pa.bool_())],
                ["digest", "first_id", "copies", "record"],
            )

        now, trie = None, Trie()
        for batch in batches:
            for b, c, n, f in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if b != now:
                    if now is not None:
                        yield out(trie)
                    now, trie = b, Trie()
                trie.add(c, n, f)
        if now is not None:
            yield out(trie)

    # A fixed number, so that adaptive coalescing cannot put the Python work into a few tasks.
    parts = int(canon.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return merged.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "digest binary, first_id long, copies long, record boolean")


def united(canon: DataFrame, classes: DataFrame, work: Durable) -> DataFrame:
    """(digest, first_id, copies, weight) of each different sequence of words, by the class it ends in.

    Classes of equal words that hold records of equal fields are one; ``weight`` is the number of
    documents of the words alone.
    """
    plain = classes.where("not record").drop("record")
    fields = classes.where("record and copies > 1").select(F.col("digest").alias("record"), F.col("first_id").alias("b"), F.col("copies").alias("weight"))
    held = join_unique(canon.where("record is not null").select("digest", "record"), fields, "record", "weight")
    firsts = plain.select("digest", F.col("first_id").alias("a"), F.col("copies").alias("weight"))
    edges = work.keep(join_unique(held, firsts, "digest", "weight").select("a", "b").where("a <> b").distinct(), "edges")
    if not edges.head(1):
        return plain.withColumn("weight", F.col("copies"))
    roots = components(edges, work, "united").select(F.col("id").alias("first_id"), "root")
    met = plain.join(roots, "first_id", "left").select("digest", F.coalesce("root", "first_id").alias("first_id"), F.col("copies").alias("own"))
    sums = met.groupBy("first_id").agg(F.sum("own").alias("copies"), F.count("*").alias("weight"))
    return join_unique(met, sums, "first_id", "weight").select("digest", "first_id", "copies", F.col("own").alias("weight"))


def copies(docs: DataFrame, work: Durable | None = None, **limits) -> DataFrame:
    """(doc_id, first_id, copies) of every document whose text has words.

    Input columns doc_id and text; further columns are ignored.  Null, empty and blank texts, and
    texts of signs only, give no row, nor do rows without doc_id.  Ties go to the smallest doc_id; an empty table gives an
    empty result.
    """
    classes, canon = _classed(docs, work, limits)
    return join_unique(canon, classes, "digest", "weight").select("doc_id", "first_id", "copies")


def repeated(docs: DataFrame, work: Durable | None = None, **limits) -> DataFrame:
    """(first_id, doc_id) of every copy but the first of its class."""
    classes, canon = _classed(docs, work, limits)
    got = join_unique(canon, classes.where("copies > 1"), "digest", "weight")
    return got.where("doc_id <> first_id").select("first_id", "doc_id")


def firsts(docs: DataFrame, work: Durable) -> DataFrame:
    """(doc_id, text) of the first document of each class, the text as its folded words with a space between."""
    classes, canon = _classed(docs, work, {}, "doc_id", F.expr("substring(cast(canon as string), 2)").alias("text"))
    again = work.keep(join_unique(canon.select("doc_id", "digest"), classes.where("copies > 1"), "digest", "weight").where("doc_id <> first_id").select("doc_id"), "again")
    if again.count() <= SENT:
        return canon.join(F.broadcast(again), "doc_id", "left_anti").select("doc_id", "text")
    return work.keep(canon.join(again, "doc_id", "left_anti").select("doc_id", "text"), "firsts")  # else each reader shuffles the texts


def _classed(docs: DataFrame, work: Durable | None, limits: dict, *columns) -> tuple[DataFrame, DataFrame]:
    """The classes of the sequences of words, and (doc_id, digest) of each document, or more of it."""
    work = work or Durable(docs.sparkSession)
    canon = work.keep(canon_table(docs), "canon")
    classes = work.keep(united(canon, work.keep(copy_classes(canon, **limits), "counted"), work), "classes")
    return classes, canon.where("doc_id is not null").select("digest", *(columns or ("doc_id",)))
