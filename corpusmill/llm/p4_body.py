"""Problem 4: the main body of captured pages.

The captures are text, so the tree of a page is built from its layout: the page, its sections (a
stretch of lines of one kind: recurrent lines, entries below a recurrent heading, free lines) and
their lines.  Lines are the nodes that are classified, by boosted trees over features of density,
tokens, depth, position and siblings, and over how many pages of the site and how many sites share
the line.  The training labels are weak: rules that hold for clear lines of a bounded sample of
pages.  Decoding goes down the tree: a page without body text has no body, and a section of entries
is kept or dropped as a whole, so that no line contradicts its ancestors.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Durable, arrow_map, bounded_sample, flat, fold, join_unique, words
from .trees import Boosted

#: Pages that the classifier is fitted on, at most, taken by hash order.
SAMPLE_PAGES = 3000
_DIGITS = re.compile(r"\d+")
_ENDS = re.compile(r"[.!?…:;][\"'”»)\]]*$")
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)])\s+")
_CRUMB = re.compile(r"\s(?:[>»›/|·→]|::)\s")
SENTENCE, SHORT = 6, 9  # words of a sentence at least, of an entry or heading at most


def site_name(site: str | None) -> str:
    """The words of a host's first label, without numbers: how a site names itself in its lines."""
    return re.sub(r"\d+", "", (site or "").split(".")[0]).replace("-", " ").strip().lower()


def _hash(*parts: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest("\x1f".join(parts).encode()) - (1 << 63)


#: What a line tells by itself, computed once.
OWN = "words chars ends item commas digits upper common_case crumb crumb_tail name bar_count own_name".split()
_UPPER = dict.fromkeys(range(65, 91))
_NUMERALS = dict.fromkeys(range(48, 58))


def _count(line: str, drop: dict, test) -> int:
    return len(line) - len(line.translate(drop)) if line.isascii() else sum(map(test, line))


def _line(raw: str, site: str, name: str) -> tuple:
    """(key, gkey, plain words, the words after its last crumb or None, its own features but the crumb's tail)."""
    low = fold(raw)
    w = flat(low).split()
    n, chars, named = len(w), max(len(low), 1), len(name) > 2
    crumb = _CRUMB.split(low) if _CRUMB.search(low) else None
    spaced = " ".join(low.split())
    masked = _DIGITS.sub("0", spaced.replace(name, "@") if named else spaced)
    own = (
        n, len(low), bool(_ENDS.search(raw)), bool(_ITEM.match(raw)), low.count(",") / max(n, 1), _count(low, _NUMERALS, str.isdigit) / chars,
        _count(raw, _UPPER, str.isupper) / chars, raw[:1].isupper(), crumb is not None, False, named and name in low, low.count("|") + low.count("·") + low.count("›"),
        named and low.startswith(name + ":"),
    )
    return _hash(site, masked), _hash(masked), " ".join(w), crumb and " ".join(words(crumb[-1])), own


_TAIL = OWN.index("crumb_tail")


def page_table(pages: DataFrame) -> DataFrame:
    """(capture_id, site_h, url_h, lines, own) of each page: its lines that are not blank, and what each tells by itself.

    ``lines`` has line_no, key, gkey and run, which is how many short lines without a sentence's end
    follow directly; ``own`` is a matrix of OWN, a row a line.
    """

    def each(batch):
        out: dict[str, list] = {c: [] for c in ("capture_id", "site_h", "url_h", "own")}
        flat_lines: dict[str, list] = {c: [] for c in ("line_no", "key", "gkey", "run")}
        ends = [0]
        # Most lines of a page stand on other pages of its site as well.
        seen: dict[tuple[str, str], tuple] = {}
        for i, site, url, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            site = site or ""
            name, numbers, got = site_name(site), [], []
            for no, raw in enumerate((text or "").split("\n"), 1):
                raw = raw.strip()
                if raw:
                    line = seen.get((site, raw))
                    if line is None:
                        line = seen[site, raw] = _line(raw, site, name)
                    numbers.append(no), got.append(line)
            if not got:
                continue
            own = np.array([x[4] for x in got], np.float32)
            if own[:, _TAIL - 1].any():
                heads = {x[2] for x in got}
                own[:, _TAIL] = [x[3] is not None and x[3] in heads for x in got]
            run = [0] * len(got)
            open_ = ((own[:, 0] > 1) & (own[:, 0] <= SHORT) & (own[:, 2] == 0) & (own[:, 3] == 0)).tolist()
            for k in range(len(got) - 1, 0, -1):
                run[k - 1] = run[k] + 1 if open_[k] else 0
            out["capture_id"].append(i), out["own"].append(own.tobytes())
            out["site_h"].append(_hash("site", site)), out["url_h"].append(_hash("url", url or f"#{i}"))
            flat_lines["line_no"].extend(numbers), flat_lines["run"].extend(run)
            flat_lines["key"].extend(x[0] for x in got), flat_lines["gkey"].extend(x[1] for x in got)
            ends.append(ends[-1] + len(got))
        types = {"line_no": pa.int32(), "key": pa.int64(), "gkey": pa.int64(), "run": pa.int32()}
        inner = pa.StructArray.from_arrays([pa.array(flat_lines[c], t) for c, t in types.items()], fields=[pa.field(c, t) for c, t in types.items()])
        return out | {"lines": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)}

    schema = "capture_id long, site_h long, url_h long, lines array<struct<line_no: int, key: long, gkey: long, run: int>>, own binary"
    return arrow_map(pages.select("capture_id", "site", "url", "text").where("capture_id is not null"), each, schema)


def line_statistics(lines: DataFrame) -> DataFrame:
    """(key, df, pages, sites, run, weight): of each line of a site, the site's pages that hold it and
    that there are, the sites that hold it, and the mean run after it.  Pages count once however often captured."""
    by_key = lines.groupBy("key").agg(
        F.countDistinct("url_h").alias("df"), F.avg("run").alias("run"), F.count("*").alias("weight"), F.min("gkey").alias("gkey"), F.min("site_h").alias("site_h")
    )
    pages = lines.groupBy("site_h").agg(F.countDistinct("url_h").alias("pages"))
    sites = by_key.groupBy("gkey").agg(F.count("*").alias("sites"))
    on_site = by_key.groupBy("site_h").agg(F.count("*").alias("weight"))
    met = join_unique(by_key.withColumnRenamed("weight", "rows"), pages.join(on_site, "site_h"), "site_h", "weight")
    met = join_unique(met, sites.withColumn("weight", F.col("sites")), "gkey", "weight")
    return met.select("key", "df", "pages", "sites", "run", F.col("rows").alias("weight"))


FEATURES = (
    "log_df share log_sites run words chars ends item commas digits upper common_case crumb crumb_tail name bar_count at_top at_bottom relative "
    "lines prose_before prose_after since_recurrent head_share head_run head_words prev_words prev_share next_words next_share next_ends prev_ends "
    "section_words section_share section_lines page_share"
).split()


class Pages:
    """The lines of the pages of a batch with their statistics, sections and features, as flat arrays.

    ``own`` and ``stats`` (line_no, df, pages, sites, run) have a row a line, in order; ``counts``
    is the number of lines of each page.
    """

    def __init__(self, counts: np.ndarray, own: np.ndarray, stats: list[np.ndarray]):
        total = int(counts.sum())
        self.line_no = stats[0]
        df, pages, sites, run = (x.astype(float) for x in stats[1:])
        n_words, chars, ends, item, commas, digits, upper, cased, crumb, tail, named, bars, own_name = (own[:, k].astype(float) for k in range(len(OWN)))
        ends, item = ends > 0, item > 0
        self.page = page = np.repeat(np.arange(len(counts)), counts)
        start = (np.cumsum(counts) - counts)[page]
        many = counts[page]
        index = np.arange(total)
        at = index - start
        first, last = at == 0, at == many - 1
        self.df = df
        # Beyond one page, a page's own copy tells nothing: the share leaves it out.
        share = np.where(pages > 1, (df - 1) / np.maximum(pages - 1, 1), 0.0)
        self.recurrent = recurrent = (
            (own_name > 0) | ((share >= 0.1) & (df >= 3)) | ((sites >= 3) & (df >= 2) & (share >= 0.05)) | ((share >= 0.5) & (df >= 2)) | ((pages < 4) & (sites >= 3))
        )
        self.crumb, self.tail = (crumb > 0) & ~ends, tail > 0
        self.prose = prose = (n_words >= SENTENCE) & ends & ~recurrent
        self.n_words, self.ends = n_words, ends

        def before(v, fill):
            return np.where(first, fill, np.concatenate([[fill], v[:-1]]) if total else v)

        def after(v, fill):
            return np.where(last, fill, np.concatenate([v[1:], [fill]]) if total else v)

        self.after = after
        # Entries: runs of short open lines directly below a recurrent line, their heading.
        short = (n_words > 1) & (n_words <= SHORT) & ~ends & ~item & ~recurrent & ~self.crumb
        begins = short & ~(before(short, False) > 0)
        begun = np.maximum.accumulate(np.where(begins, index, 0)) if total else index
        headed = begins & (before(recurrent, False) > 0)
        self.head = head = np.where(short & headed[begun], begun - 1, -1) if total else index
        self.since = since = np.where(head >= 0, index - head, 0)
        # Sections: stretches of recurrent lines, of entries, or of free lines.
        change = first | (before(recurrent, 0) != recurrent) | (before(head >= 0, 0) != (head >= 0))
        self.section = section = np.cumsum(change) - 1
        in_section = np.bincount(section, minlength=1)
        done = np.cumsum(prose)
        self.seen = seen = done - prose - (np.concatenate([[0], done])[start] if total else 0)
        all_prose = np.bincount(page, prose, len(counts))[page]
        self.any_prose = all_prose > 0

        def mean(v):
            return (np.bincount(section, v, len(in_section)) / np.maximum(in_section, 1))[section]

        def pick(v):
            return np.where(head >= 0, v[np.maximum(head, 0)], -1.0) if total else v

        self.x = np.column_stack([
            np.log1p(df), share, np.log1p(sites), run, n_words, chars, ends, item, commas, digits, upper, cased, crumb, tail, named, bars,
            at, many - 1 - at, at / np.maximum(many - 1, 1), many, seen, all_prose - seen - prose, since, pick(share), pick(run), pick(n_words),
            before(n_words, 0), before(share, 0), after(n_words, 0), after(share, 0), after(ends, 0), before(ends, 0),
            mean(n_words), mean(share), in_section[section] if total else at, (np.bincount(page, share, len(counts)) / np.maximum(counts, 1))[page],
        ])

    def weak_labels(self) -> np.ndarray:
        """1 body, 0 not, -1 not clear, of each line."""
        following = self.after(self.head >= 0, 0) > 0
        entry = (self.seen > 0) | (self.since > 1) | following
        # Entries below a heading after the text began; before it, a line above the text is its headline.
        entries = np.where(entry, 0, np.where(self.after(self.prose, 0) > 0, 1, -1))
        return np.select(
            [self.recurrent | self.crumb & self.tail, self.df > 2, self.prose, ~self.any_prose, self.head >= 0, (self.n_words <= SHORT) & ~self.ends],
            [0, -1, 1, 0, entries, 1], -1,
        )

    def outside(self, odds: np.ndarray) -> np.ndarray:
        """Whether each line is outside the body, from the log odds of the lines, down the tree."""
        keep = odds > 0
        # The page: without a line of text that is kept, nothing else is the body of anything.
        keep &= (np.bincount(self.page, keep & self.prose, self.page.max(initial=0) + 1) > 0)[self.page]
        # Sections of entries stand or fall together; a single line under a recurrent one decides itself.
        inside = self.head >= 0
        size = np.bincount(self.section[inside], minlength=self.section.max(initial=0) + 1)
        mean = np.bincount(self.section[inside], odds[inside], len(size)) / np.maximum(size, 1)
        whole = inside & (size[self.section] > 1)
        keep[whole] = (mean[self.section] > 0)[whole]
        return ~keep


def with_statistics(pages: DataFrame, work: Durable) -> DataFrame:
    """(capture_id, own, stats): what each line of a page tells by itself, and the statistics of its lines."""
    held = work.keep(page_table(pages), "held")
    lines = held.select("capture_id", "site_h", "url_h", F.inline("lines"))
    stats = work.keep(line_statistics(lines), "stats")
    met = join_unique(lines.select("capture_id", "line_no", "key"), stats, "key", "weight")
    # A page's own lines, so bounded by the page.
    by_page = met.groupBy("capture_id").agg(F.collect_list(F.struct("line_no", "df", "pages", "sites", "run")).alias("stats"))
    return work.keep(held.select("capture_id", "own").join(by_page, "capture_id"), "pages")


def _laid_out(batch) -> tuple[np.ndarray, Pages]:
    """The capture_ids of a batch and its pages; statistics come in any order and are sorted by line."""
    stats = batch.column(2)
    counts = np.diff(stats.offsets.to_numpy())
    inner = stats.flatten()
    columns = [inner.field(k).to_numpy(zero_copy_only=False) for k in range(5)]
    order = np.lexsort((columns[0], np.repeat(np.arange(len(counts)), counts)))
    own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, len(OWN))
    return batch.column(0).to_numpy(zero_copy_only=False), Pages(counts, own, [c[order] for c in columns])


def fit(ready: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Boosted:
    """Trees over the weakly labelled lines of a bounded sample of pages."""

    def each(batch):
        _, pages = _laid_out(batch)
        label = pages.weak_labels()
        return {"x": [pages.x[label >= 0].astype(np.float32).tobytes()], "y": [label[label >= 0].astype(np.int8).tobytes()]}

    sample = bounded_sample(ready, "capture_id", sample_pages)
    rows = arrow_map(sample, each, "x binary, y binary").collect()
    x = np.concatenate([np.zeros((0, len(FEATURES)), np.float32), *(np.frombuffer(r.x, np.float32).reshape(-1, len(FEATURES)) for r in rows)])
    y = np.concatenate([np.zeros(0, np.int8), *(np.frombuffer(r.y, np.int8) for r in rows)])
    # Tasks return in any order; the fit is the same for the same rows.
    order = np.lexsort((*x.T, y))
    return Boosted().fit(x[order], y[order])


def outside(pages: DataFrame, work: Durable | None = None, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(capture_id, line_no) of each line that is not blank and not of the main body.

    ``pages`` has capture_id (unique), site, url and text; other columns are ignored.  Null and empty
    texts give no rows; a null url counts as a page of its own, null sites as one site.
    """
    work = work or Durable(pages.sparkSession)
    ready = with_statistics(pages, work)
    model = pages.sparkSession.sparkContext.broadcast(fit(ready, sample_pages))

    def each(batch):
        ids, pages = _laid_out(batch)
        off = pages.outside(model.value.score(pages.x))
        return {"capture_id": pa.array(ids[pages.page[off]], pa.int64()), "line_no": pa.array(pages.line_no[off], pa.int32())}

    return arrow_map(ready, each, "capture_id long, line_no int")


def bodies(pages: DataFrame, work: Durable | None = None) -> DataFrame:
    """(capture_id, body): each page with its main body only, empty where it has none."""
    off = outside(pages, work).groupBy("capture_id").agg(F.collect_set("line_no").alias("off"))
    met = pages.select("capture_id", "text").join(off, "capture_id", "left")
    kept = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, k: ~F.coalesce(F.array_contains("off", k + 1), F.lit(False)))
    return met.select("capture_id", F.array_join(F.filter(kept, lambda x: F.trim(x) != ""), "\n").alias("body"))
