"""Problem 3: groups of edited versions of a text.

All texts put the shingles in one order, the rarest first by a table of counts that all texts fill.
Of two sets that have a share of ``threshold`` of their union in common, the first shingles in this
order, as many as could miss the rest, must meet (prefix filter): they are the keys of candidate
buckets.  The first shingle that two sets share has all others behind it in both, so there the
shorter rest bounds what they share (positional filter).  No pair can be missed, whatever the order.
Candidates are verified by bitmaps that bound the difference of two sets from below, then by the
exact similarity of their shingle sets; groups are the connected components under alternating
large-star and small-star.

Only buckets of at most ``SMALL`` members are expanded into their pairs.  In a larger one, first each
member meets only the bucket's least member.  Only where it still holds several components are
members of different components compared, as blocks of bitmaps of bounded size, and only pairs whose
bitmaps and rests allow it go on.  So every pair that shares a bucket and can be similar by its rests
ends in one component or has been compared.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import Durable, arrow_map, join_unique, words

SHINGLE = 5
LEAST_WORDS = 40
#: Cells of the table that tells frequent shingles, at most (0: none is told) and at least, and cells of a row of it.
FREQUENT, FEW = 1 << 27, 1 << 20
SLICE = 1 << 16
#: Members of a bucket that is expanded into its pairs, and ids that are sent to every task, at most.
SMALL, SENT = 32, 1 << 20
#: Bits of a shingle, above which a set in order has its level; bytes of text and words that are hashed at once.
HASH, PART, CHUNK = 56, 1 << 22, 1 << 15
#: Bits of a bitmap.
BITS = 1024
BLOCK = 512


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    """64-bit hash by word, bounded."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1 << 20:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return got


_HASH = _WordHash()


def _word_hashes(texts: pa.Array, split) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and the hashes of all words; a hash is made once for each different word."""
    if split is None:
        each = pc.split_pattern(texts, " ")
        counts, flat = pc.list_value_length(each).to_numpy().astype(np.int64), each.flatten()
    else:
        each = [split(t) for t in texts.to_pylist()]
        counts, flat = np.array([len(w) for w in each]), pa.array(list(chain.from_iterable(each)), pa.large_string())
    coded = flat.dictionary_encode()
    known = np.fromiter(map(_HASH.__getitem__, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return counts, known[coded.indices.to_numpy()]


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of the run of ``size`` words that begins at each word; the last runs, which are cut short, mean nothing."""
    out = np.empty_like(h)
    for lo in range(0, len(h), CHUNK):
        run = h[lo : lo + CHUNK].copy()
        for k in range(1, size):
            run *= np.uint64(0x9E3779B97F4A7C15)
            more = h[lo + k : lo + k + CHUNK]
            run[: len(more)] += more
        out[lo : lo + CHUNK] = _mix(run) >> np.uint64(64 - HASH)
    return out


def shingles(texts: pa.Array, size: int = SHINGLE, least: int = LEAST_WORDS, split=words, known: np.ndarray = np.zeros(0, np.uint8)):
    """(places, sizes, members) of the sets of runs of ``size`` words, of some texts of a column at a time.

    The places are those of texts of ``least`` words and more, the members of their sets stand one set
    after the other, each in order.  A member is the hash, and above it its level by ``known``, if any.
    """
    length = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    places = np.flatnonzero(length)
    for at in np.split(places, np.flatnonzero(np.diff(np.cumsum(length[places]) // PART)) + 1):
        counts, h = _word_hashes(texts.take(pa.array(at)), split)
        long = counts >= max(least, 1)
        at, begin, counts = at[long], (np.cumsum(counts) - counts)[long], counts[long]
        if not len(at):
            continue
        run = _runs(h, size)
        for b, n in zip(begin[counts < size].tolist(), counts[counts < size].tolist()):
            run[b] = _runs(h[b : b + n], n)[0]
        n = np.maximum(counts - size + 1, 1)
        ends = np.cumsum(n)
        members = run[np.arange(ends[-1]) + (begin - ends + n).repeat(n)]
        if len(known):
            members |= known[_cell(members, len(known))].astype(np.uint64) << np.uint64(HASH)
        for i, j in zip((ends - n).tolist(), ends.tolist()):
            members[i:j].sort()
        new = np.concatenate([[True], members[1:] != members[:-1]])
        new[ends[:-1]] = True
        yield at, np.add.reduceat(new, ends - n, dtype=np.int64), members[new]


def _cell(s: np.ndarray, cells: int) -> np.ndarray:
    return (s >> np.uint64(HASH + 1 - cells.bit_length())).astype(np.int64)


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte, in their order: exact under 16, then by twelfths of a power of two."""
    high = 16 + 12 * np.log2(np.maximum(counts, 16) / 16)
    return np.where(counts < 16, counts, np.minimum(high, 255)).astype(np.uint8)


def frequent(docs: DataFrame, size: int, least: int, split=words) -> tuple[int, list[tuple[int, bytes]]]:
    """In how many texts shingles are, as levels in cells by the first bits of the shingle, packed; none where ``FREQUENT`` is 0.

    A cell holds all shingles that begin as it does, so a count can be too high and never too low.
    There are about as many cells as shingles, or ``FREQUENT``.
    """
    if not FREQUENT:
        return 0, []
    size_of = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(FREQUENT, max(FEW, 1 << (size_of // 4).bit_length()))

    def packed(held):
        cell = np.sort(np.concatenate(held))
        ends = np.searchsorted(cell, np.arange(0, cells + 1, SLICE)).tolist()
        step = np.diff(cell % SLICE, prepend=np.int64(0))
        rows = []
        for at, i, j in zip(range(0, cells, SLICE), ends, ends[1:]):
            if i < j:
                step[i] = cell[i] - at
                rows.append((at, j - i, pa.compress(step[i:j].astype(np.uint16).tobytes(), "zstd", asbytes=True)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], ["at", "n", "held"])

    def each(batches):
        held = []
        for batch in batches:
            for _, _, members in shingles(batch.column(0), size, least, split):
                held.append(_cell(members, cells))
                if sum(map(len, held)) > 1 << 22:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    def add(batches):
        sums = {}
        for batch in batches:
            for at, n, held in zip(*(c.to_pylist() for c in batch.columns)):
                step = np.frombuffer(pa.decompress(held, 2 * n, "zstd", asbytes=True), np.uint16)
                np.add.at(sums.setdefault(at, np.zeros(SLICE, np.uint32)), np.cumsum(step, dtype=np.int64), np.uint32(1))
        for at, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([pa.compress(_levels(total).tobytes(), "zstd", asbytes=True)], pa.binary())], ["at", "held"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("text").mapInArrow(each, "at long, n int, held binary").repartition(parts, "at").mapInArrow(add, "at long, held binary")
    return cells, [(r.at, bytes(r.held)) for r in rows.collect()]  # a byte a cell at most, whatever the data


def _table(cells: int, rows: list[tuple[int, bytes]]) -> np.ndarray:
    out = np.zeros(cells, np.uint8)
    for at, held in rows:
        out[at : at + SLICE] = np.frombuffer(pa.decompress(held, SLICE, "zstd", asbytes=True), np.uint8)
    return out


def prefix(sizes: np.ndarray, members: np.ndarray, threshold: float, known: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, shingle, rest) of the first members of sets in order, so many that a similar set has one of them among its own.

    A rest is the number of shingles from this one to the last.  Shingles of no other text are left out.
    """
    n = np.minimum(sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1, sizes)
    whose = np.arange(len(sizes)).repeat(n)
    at = np.arange(len(whose)) - (np.cumsum(n) - n)[whose]
    first = members[(np.cumsum(sizes) - sizes)[whose] + at]
    if known:
        told = np.flatnonzero(first >> np.uint64(HASH) > 1)
        whose, at, first = whose[told], at[told], first[told]
    return whose, first & np.uint64((1 << HASH) - 1), sizes[whose] - at


def _signatures(sizes: np.ndarray, members: np.ndarray) -> np.ndarray:
    """A row of bytes for each set: four of its size, then a bitmap of its members."""
    bits = np.zeros((len(sizes), BITS), bool)
    bits[np.arange(len(sizes)).repeat(sizes), (members % np.uint64(BITS)).astype(np.int64)] = True
    return np.concatenate([sizes.astype("<u4").view(np.uint8).reshape(-1, 4), np.packbits(bits, axis=1)], axis=1)


def _reach(n: np.ndarray, m: np.ndarray, rest: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles can be similar that share at most ``rest`` of them."""
    return rest * (1 + threshold) >= threshold * (n + m) - 1e-6


def buckets(docs: DataFrame, threshold: float, size: int, least: int, split=words, small: int = SMALL) -> DataFrame:
    """(key, a, b, rest, sig) with three kinds of rows, told by what is null.

    (a, sig): a text and its bitmap.  (a, b): a pair of a bucket that can be similar by its rests, of
    one over ``small`` members only the pairs with the least.  (key, a, rest): a member of such a bucket.
    The keys of a batch are 44 bits of a shingle and cut by the first twelve; each part is one row.
    Sizes and rests are at most 65,535, which for longer sets leaves in more pairs and none out.
    """
    told = docs.sparkSession.sparkContext.broadcast(frequent(docs, size, least, split))
    names = ["key", "a", "b", "rest", "sig"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def rows(n, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names)

    def cut(batches):
        known = _table(*told.value)
        for batch in batches:
            every, held = batch.column(0).to_numpy().astype(np.int64), []
            for at, sizes, members in shingles(batch.column(1), size, least, split, known):
                whose, first, rest = prefix(sizes, members, threshold, len(known) > 0)
                held.append((every[at], _signatures(sizes, members), every[at][whose], sizes[whose], first, rest))
            if not held:
                continue
            ids, signs, owner, n, key, rest = (np.concatenate(x) for x in zip(*held))
            order, base = np.argsort(key), int(ids.min())
            wide = int(ids.max()) - base >= 1 << 32
            owner = (owner if wide else (owner - base).astype(np.uint32))[order]
            n, rest, key = *(np.minimum(x, 65535).astype(np.uint16)[order] for x in (n, rest)), key[order]
            part = (key >> np.uint64(HASH - 12)).astype(np.int32)
            ends = np.flatnonzero(np.diff(part, append=-1)) + 1
            at = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
            low = (key >> np.uint64(HASH - 44)).astype(np.uint32)
            cells = [pa.array([x[i:j].tobytes() for i, j in at], pa.binary()) for x in (low, owner, n, rest)]
            yield pa.RecordBatch.from_arrays([pa.array(part[ends - 1]), pa.array([base] * len(at), pa.int64()), *cells], ["part", "base", "keys", "owners", "sizes", "rests"])
            sign = [pa.array([x], pa.binary()) for x in (signs.tobytes(), ids.tobytes(), b"", b"")]
            yield pa.RecordBatch.from_arrays([pa.array([-1 - base % 4096], pa.int32()), pa.array([0], pa.int64()), *sign], ["part", "base", "keys", "owners", "sizes", "rests"])

    def met(held):
        key, owner, n, rest = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((owner, key))
        key, owner, n, rest = (x[order] for x in (key, owner, n, rest))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        weight = np.diff(first, append=len(key))
        head, weight = np.repeat(first, weight), np.repeat(weight, weight)
        large = np.flatnonzero(weight > small)
        if len(large):
            yield rows(len(large), key=key[large], a=owner[large], rest=rest[large].astype(np.int32))
        near = [(head[large], large)]
        few = np.flatnonzero((weight > 1) & (weight <= small))
        for step in range(1, small):
            x, y = few[:-step], few[step:]
            same = key[x] == key[y]
            if not same.any():
                break
            near.append((x[same], y[same]))
        x, y = (np.concatenate(c) for c in zip(*near))
        keep = _reach(n[x], n[y], np.minimum(rest[x], rest[y]), threshold) & (owner[x] != owner[y])
        a, b = owner[x[keep]], owner[y[keep]]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
        yield rows(int(new.sum()), a=a[new], b=b[new])

    def gather(batches):
        now, count, held = None, 0, []
        for batch in batches:
            for part, base, key, owner, n, rest in zip(*(c.to_pylist() for c in batch.columns)):
                if part < 0:
                    ids, step = np.frombuffer(owner, np.int64), 4 + BITS // 8
                    yield rows(len(ids), a=ids, sig=[key[k : k + step] for k in range(0, len(key), step)])
                    continue
                if part != now and count > 1 << 18:  # several parts at once, as one may be small
                    yield from met(held)
                    count, held = 0, []
                now = part
                key = np.frombuffer(key, np.uint32).astype(np.int64) | (part << 32)
                owner = np.frombuffer(owner, np.int64 if len(owner) == 8 * len(key) else np.uint32).astype(np.int64) + base * (len(owner) == 4 * len(key))
                held.append((key, owner, np.frombuffer(n, np.uint16).astype(np.int64), np.frombuffer(rest, np.uint16).astype(np.int64)))
                count += len(key)
        if held:
            yield from met(held)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(cut, "part int, base long, keys binary, owners binary, sizes binary, rests binary")
    return got.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(gather, "key long, a long, b long, rest int, sig binary")


def _laid(column) -> np.ndarray:
    """A column of bitmaps as rows of 32-bit words, the first of which is the size."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), 1 + BITS // 32)


def _possible(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of such sizes and bitmaps can be similar: each bit that differs is a member of one of them alone."""
    n, m = x[..., 0].astype(np.float64), y[..., 0].astype(np.float64)
    differ = np.bitwise_count(x[..., 1:] ^ y[..., 1:]).sum(axis=-1, dtype=np.int64)
    return (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-6) & (differ * (1 + threshold) <= (1 - threshold) * (n + m) + 1e-6)


# --- components ------------------------------------------------------------------------------


def _weighted(edges: DataFrame, group: DataFrame, key: str) -> DataFrame:
    return join_unique(edges, group, key, "weight")


def components(edges: DataFrame, work: Durable, name: str) -> DataFrame:
    """(id, root) of every node of the edges (a, b): the least id of its connected component.

    Alternating large-star and small-star: each node hands its larger, then its smaller neighbours
    to the least one it knows, until only stars are left.  Groups are never collected: a node's least
    neighbour is an aggregate that joins back to its edges, hot nodes dealt over several tasks.
    """
    edges = work.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    turn = 0
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("weight"))
        large = _weighted(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = work.keep(large, f"{name}-l{turn}")
        small_least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("weight"))
        joined = _weighted(large, small_least, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small_least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        turn += 1
        now = work.keep(small, f"{name}-{turn}")
        work.drop(f"{name}-{turn - 1}"), work.drop(f"{name}-l{turn - 1}")
        edges = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one alone, which has none itself: components, all of them."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
    met = ends.groupBy("id").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return met.where("leaf > 1 or leaf = 1 and centre = 1").isEmpty()


# --- candidates ------------------------------------------------------------------------------


def _verify(pairs: DataFrame, sigs: DataFrame, docs: DataFrame, threshold: float, size: int, least: int, work: Durable, name: str, split=words) -> DataFrame:
    """Of distinct pairs (a, b), those whose shingle sets are similar enough; bitmaps first."""
    pairs = work.keep(pairs, f"{name}-pairs")
    by_a = sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa"))
    by_b = sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb"))
    count_a = pairs.groupBy("a").agg(F.count("*").alias("weight"))
    count_b = pairs.groupBy("b").agg(F.count("*").alias("weight"))
    both = join_unique(join_unique(pairs, by_a.join(count_a, "a"), "a", "weight"), by_b.join(count_b, "b"), "b", "weight")

    def likely(batch):
        keep = pa.array(_possible(_laid(batch.column(2)), _laid(batch.column(3)), threshold))
        return {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    near = work.keep(arrow_map(both.select("a", "b", "sa", "sb"), likely, "a long, b long"), f"{name}-near")
    wanted = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    if wanted.count() <= SENT:  # else the texts of all are shuffled for the sake of these
        wanted = F.broadcast(wanted)

    def sets(batch):
        ids, out = batch.column(0).to_numpy(), {}
        for at, sizes, members in shingles(batch.column(1), size, least, split):
            ends = np.cumsum(sizes)
            out |= {i: members[j:k].tobytes() for i, j, k in zip(ids[at].tolist(), (ends - sizes).tolist(), ends.tolist())}
        return {"doc_id": list(out), "set": list(out.values())}

    held = work.keep(arrow_map(docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi"), sets, "doc_id long, set binary"), f"{name}-sets")
    count_a = near.groupBy("a").agg(F.count("*").alias("weight"))
    count_b = near.groupBy("b").agg(F.count("*").alias("weight"))
    a = held.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")).join(count_a, "a")
    b = held.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")).join(count_b, "b")
    both = join_unique(join_unique(near, a, "a", "weight"), b, "b", "weight")

    def exact(batch):
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            same = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(same >= threshold * (len(x) + len(y) - same))
        keep = pa.array(keep, pa.bool_())
        return {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    links = work.keep(arrow_map(both.select("a", "b", "sa", "sb"), exact, "a long, b long"), f"{name}-links")
    for part in ("pairs", "near", "sets"):
        work.drop(f"{name}-{part}")
    return links


def _across(members: DataFrame, sigs: DataFrame, roots: DataFrame, threshold: float, block: int) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that can be similar by their bitmaps and rests.

    A bucket's members are cut into blocks; a task compares two blocks, so it holds at most
    2 * block bitmaps whatever the bucket's size.
    """
    known = members.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    open_keys = (
        known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("weight"))
        .where("lo < hi").select("key", "weight", F.ceil(F.col("weight") / block).cast("int").alias("blocks"))
    )
    left = join_unique(known, open_keys, "key", "weight")
    count = left.groupBy("doc_id").agg(F.count("*").alias("weight"))
    left = join_unique(left, sigs.select("doc_id", "sig").join(count, "doc_id"), "doc_id", "weight")
    left = left.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # Block pairs (own, other): a member takes part in each pair of blocks that includes its own.
    spread = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "root", "rest", "sig"
    )

    def compare(table: pa.Table) -> pa.Table:
        own = table.column("own").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        ids, root, rest = (table.column(c).to_numpy() for c in ("doc_id", "root", "rest"))
        sig = _laid(table.column("sig"))
        first, second = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = [], []
        for x in first:
            y = second[(root[second] != root[x]) & ((ids[second] > ids[x]) if i == j else True)]
            y = y[_reach(np.minimum(sig[y, 0], 65535.0), min(sig[x, 0], 65535.0), np.minimum(rest[y], rest[x]), threshold)]
            y = y[_possible(sig[y], sig[x], threshold)] if len(y) else y
            a.append(np.minimum(ids[y], ids[x])), b.append(np.maximum(ids[y], ids[x]))
        return pa.table({"a": np.concatenate(a) if a else np.zeros(0, np.int64), "b": np.concatenate(b) if b else np.zeros(0, np.int64)})

    return spread.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def groups(docs: DataFrame, threshold: float = 0.8, size: int = SHINGLE, least: int = LEAST_WORDS, block: int = BLOCK, work: Durable | None = None, split=words) -> DataFrame:
    """(id, root) of every document that is in a group of at least two; root is the least doc_id.

    Input columns doc_id (unique) and text; others are ignored.  Texts that are null, empty or
    under ``least`` words take no part.  No pair of the threshold, which is above 0, is left out.
    ``split`` gives the words of a text; None stands for texts that are folded words already, with one space between.
    """
    work = work or Durable(docs.sparkSession)
    met = work.keep(buckets(docs, threshold, size, least, split, min(SMALL, block)), "members")
    made = met.where("sig is not null").select(F.col("a").alias("doc_id"), "sig")
    links = _verify(met.where("b is not null").select("a", "b").distinct(), made, docs, threshold, size, least, work, "star", split)
    out = components(links, work, "first")
    members = met.where("key is not null").select("key", F.col("a").alias("doc_id"), "rest")
    if not members.isEmpty():
        more = _verify(_across(members, made, out, threshold, block), made, docs, threshold, size, least, work, "cross", split)
        out = components(out.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more), work, "all")
    work.drop("members")
    return out
