"""Shared pieces of the training-data operators: words, durable tables, skew-proof joins.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import atexit
import functools
import hashlib
import re
import tempfile
import unicodedata
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A key that more rows than this carry is hot: its rows are spread over several tasks.
HOT_ROWS = 2000
#: The most frequent keys that are spread, at most, and the tasks that one key is spread over, at
#: most.  A key beyond the first SPREAD has at most rows / SPREAD rows, so no task holds more of
#: one key than that, or HOT_ROWS.
SPREAD = 4096

_CONTROL = re.compile("[\x00-\x08\x0e-\x1b\x7f]")
#: Characters without a glyph: controls, soft hyphen, zero-width and direction marks, variation
#: selectors, and the dot that case folding splits off a capital dotted I.
_INVISIBLE = re.compile(
    "[\x00-\x08\x0e-\x1b\x7f\x80-\x84\x86-\x9f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f"
    "\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\u0307"
    "\U000e0000-\U000e0fff]"
)


def fold(text: str) -> str:
    """Case, width, composition and invisible characters removed; everything else as it was."""
    if text.isascii():
        return _CONTROL.sub("", text).lower()
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return _INVISIBLE.sub("", text).replace("ı", "i")


# Signs of ASCII become spaces; the line feed stays.
_SIGNS = {c: " " for c in range(128) if not chr(c).isalnum() and c != 10}
_SIGN_BYTES = bytes(32 if c in _SIGNS else c for c in range(256))


@functools.lru_cache(1 << 14)
def _sign(c: str) -> int:
    """0 for a letter or digit, 1 for a mark that belongs to the letter before it, 2 for any other."""
    return 0 if c.isalnum() else 1 if unicodedata.category(c) in ("Mn", "Mc") else 2


@functools.lru_cache(1)
def word_pattern() -> re.Pattern:
    """Words with marks, such as the vowel signs of scripts that have no composed letters for them."""
    marks = "".join(c for c in map(chr, range(0x300, 0x1F000)) if unicodedata.category(c) in ("Mn", "Mc"))
    return re.compile(f"[^\\W_](?:[^\\W_]|[{marks}])*")


def flat(folded: str) -> str:
    """Folded text with a space for all that is not part of a word; line feeds stay."""
    if folded.isascii():
        return folded.translate(_SIGNS)
    marked = False
    for c in set(folded):
        if c > "\x7f":
            sign = _sign(c)
            if sign == 2:
                folded = folded.replace(c, " ")
            elif sign:
                marked = True
    if marked:
        find = word_pattern().findall
        return "\n".join(" ".join(find(line)) for line in folded.split("\n"))
    return folded.encode("utf-8", "replace").translate(_SIGN_BYTES).decode()


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, with their marks, of the folded text; null gives no words."""
    return flat(fold(text)).split() if text else []


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- durable intermediate tables -------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of its own only where one machine is all there is."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="corpusmill-")
        sc.setCheckpointDir(where)
        spark.conf.set("spark.corpusmill.checkpoint.own", where)
        where = sc._jsc.sc().getCheckpointDir().get()
    return str(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder; a missing one is no error."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may already be gone at exit
        pass


class Durable:
    """Tables written to the shared folder, so a lost executor costs no recomputation.

    ``keep`` writes and reads back; ``drop`` deletes what later steps no longer read.  What the
    returned frame still reads is removed when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/corpusmill-{uuid.uuid4().hex}"
        atexit.register(remove, spark, self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.root}/{name}")


# --- skew ------------------------------------------------------------------------------------


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: str, hot_rows: int = HOT_ROWS, spread: int = SPREAD) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row a key and, in ``weight``, how many
    rows of ``left`` carry it.

    The rows of a hot key are dealt over several tasks by their hash, and its one row of ``right``
    goes to each of these.  Only the names of the ``spread`` most frequent keys are broadcast, of
    payloads nothing.  ``weight`` is dropped.
    """
    hot = right.where(F.col(weight) > hot_rows).select(key, F.least(F.ceil(F.col(weight) / hot_rows), F.lit(spread)).cast("int").alias("_deal"))
    hot = F.broadcast(hot.orderBy(F.desc("_deal"), key).limit(spread))
    dealt = left.join(hot, key, "left").withColumn("_at", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_deal")).cast("int"), F.lit(0)))
    given = right.drop(weight).join(hot, key, "left").withColumn("_at", F.explode(F.sequence(F.lit(0), F.coalesce("_deal", F.lit(1)) - 1)))
    return dealt.drop("_deal").join(given.drop("_deal"), [key, "_at"]).drop("_at")


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows at most, taken by the hash of the key; the same rows however partitioned.

    The share follows from a count, so no task sorts or gathers more than the sample.
    """
    n = df.count()
    return df if n <= rows else df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * rows / n))


# --- arrow -----------------------------------------------------------------------------------


def arrow_map(df: DataFrame, each, schema: str) -> DataFrame:
    """``each(batch) -> dict of columns`` over Arrow batches; one Python call a batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            columns = each(batch)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip((columns[f.name] for f in out), out)],
                schema=out,
            )

    return df.mapInArrow(run, schema)
