"""Sources of documents: text and Markdown files, JSONL, CSV, Parquet, captured pages, configured rows.

Each reader gives the raw document row: source_id, doc_key, path, position, text and the record's
other fields as JSON.  Corpus order is (source, path, position); ``sequence`` numbers it once.
The formats keep their own rules for null and empty texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T

SUFFIXES = (".txt", ".md", ".jsonl", ".csv", ".parquet")
RAW = "source_id string, doc_key string, path string, position long, text string, extras string"


@dataclass(frozen=True)
class Source:
    """A configured source: where it lies and how it is labelled."""

    source_id: str
    path: str
    role: str = "domain"
    group: str = "unspecified"
    license: str | None = None
    text_field: str = "text"
    id_field: str | None = "id"
    options: dict = field(default_factory=dict)


def _files(spark: SparkSession, source: Source) -> list[str]:
    """Files of the source by whitelisted suffix, in order of their path components."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(source.path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, it = [], fs.listFiles(root, True)
    while it.hasNext():
        p = it.next().getPath().toString()
        if p.lower().endswith(SUFFIXES):
            out.append(p)
    return sorted(out, key=lambda p: p.split("/"))


def read_text(spark: SparkSession, source: Source, files: list[str]) -> DataFrame:
    """One document a file; every line end becomes a line feed; an empty file is an error."""
    df = spark.read.text(files, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    checked = F.when(T.is_blank("text"), F.raise_error(F.concat(F.lit("empty document: "), F.col("path")))).otherwise(F.col("text"))
    return df.select(F.lit(source.source_id).alias("source_id"), F.col("path").alias("doc_key"), "path", F.lit(0).cast("long").alias("position"), checked.alias("text"), F.lit("{}").alias("extras"))


def read_jsonl(spark: SparkSession, source: Source, files: list[str]) -> DataFrame:
    """One document a line that is not blank; broken JSON, a missing field or a blank text are errors.

    JSON null becomes the text "None", as text of any value does; the key falls back to the line
    number, which counts blank lines.  Lines are numbered within the blocks a file is read by, and
    the lines of the blocks before are added, so a large file is read by many tasks.
    """
    lines = spark.read.text(files).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    counts = lines.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = counts.select("path", "block", F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"))
    inside = F.row_number().over(W.partitionBy("path", "block").orderBy("at")) - 1
    rows = lines.withColumn("inside", inside).join(before, ["path", "block"]).select("path", (F.col("before") + F.col("inside")).alias("k"), "line").where(~T.is_blank("line"))
    rec = rows.withColumn("v", F.try_parse_json("line")).withColumn("m", F.from_json("line", "map<string,string>"))
    at = F.concat(F.col("path"), F.lit(":"), (F.col("k") + 1).cast("string"))
    has = F.map_contains_key(F.col("m"), F.lit(source.text_field))
    value = F.coalesce(F.col("m")[source.text_field], F.lit("None"))
    text = (
        F.when(F.col("v").isNull() | F.col("m").isNull(), F.raise_error(F.concat(F.lit("invalid JSON at "), at)))
        .when(~has, F.raise_error(F.concat(F.lit(f"no field {source.text_field} at "), at)))
        .when(T.is_blank(value), F.raise_error(F.concat(F.lit("empty document at "), at))).otherwise(value)
    )
    key = F.coalesce(F.col("m")[source.id_field or ""], (F.col("k") + 1).cast("string"))
    extras = F.to_json(F.map_filter("m", lambda k, v: ~k.isin(source.text_field)))
    return rec.select(F.lit(source.source_id).alias("source_id"), F.concat_ws("#", "path", key).alias("doc_key"), "path", F.col("k").cast("long").alias("position"), text.alias("text"), extras.alias("extras"))


def _table_rows(source: Source, df: DataFrame) -> DataFrame:
    """Rows of a table: blank texts are skipped; a configured but missing id is the word None."""
    if source.text_field not in df.columns:
        raise ValueError(f"{source.source_id}: no column {source.text_field}")
    has_id = source.id_field in df.columns if source.id_field else False
    key = F.coalesce(F.col(f"`{source.id_field}`").cast("string"), F.lit("None")) if has_id else F.lit("None") if source.id_field else F.col("_pos").cast("string")
    rest = [c for c in df.columns if c not in (source.text_field, "_path", "_pos")]
    extras = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rest))) if rest else F.lit("{}")
    text = F.coalesce(F.col(f"`{source.text_field}`").cast("string"), F.lit(""))
    return df.where(~T.is_blank(text)).select(F.lit(source.source_id).alias("source_id"), F.concat_ws("#", "_path", key).alias("doc_key"), F.col("_path").alias("path"), F.col("_pos").cast("long").alias("position"), text.alias("text"), extras.alias("extras"))


def read_csv(spark: SparkSession, source: Source, files: list[str]) -> DataFrame:
    """Rows with a header, quotes and quoted line ends; all columns are strings."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(files)
    return _table_rows(source, df.withColumns({"_path": F.col("_metadata.file_path"), "_pos": F.monotonically_increasing_id()}))


def read_parquet(spark: SparkSession, source: Source, files: list[str]) -> DataFrame:
    df = spark.read.parquet(*files)
    return _table_rows(source, df.withColumns({"_path": F.col("_metadata.file_path"), "_pos": F.col("_metadata.row_index")}))


def read_pages(pages: DataFrame, source: Source) -> DataFrame:
    """Captured HTML: the text of each page; pages without text are skipped."""
    df = pages.select(F.col("url").alias("path"), T.html_text("html").alias("text")).where(~T.is_blank("text"))
    return df.select(F.lit(source.source_id).alias("source_id"), F.col("path").alias("doc_key"), "path", F.lit(0).cast("long").alias("position"), "text", F.lit("{}").alias("extras"))


READERS = {".txt": read_text, ".md": read_text, ".jsonl": read_jsonl, ".csv": read_csv, ".parquet": read_parquet}


def read(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """All configured sources as one table; an empty configuration gives an empty table."""
    out = spark.createDataFrame([], RAW)
    for k, s in enumerate(sources):
        by: dict = {}
        for f in _files(spark, s):
            by.setdefault(READERS["." + f.lower().rsplit(".", 1)[1]], []).append(f)
        for reader, files in by.items():
            df = reader(spark, s, files).withColumns({"source_index": F.lit(k), "source_role": F.lit(s.role), "source_group": F.lit(s.group), "license": F.lit(s.license).cast("string")})
            out = out.unionByName(df, allowMissingColumns=True)
    return out


def sequence(raw: DataFrame, parts: int = 64) -> DataFrame:
    """``raw`` with ``seq``: its place in corpus order, numbered once.

    Files are ranked, a file's rows are counted, and each file numbers its own rows, so no task
    orders the corpus.
    """
    files = raw.groupBy("source_index", "path").agg(F.count("*").alias("c"))
    order = W.orderBy("source_index", F.split("path", "/"))
    starts = files.withColumn("before", F.coalesce(F.sum("c").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("c")
    inside = F.row_number().over(W.partitionBy("source_index", "path").orderBy("position")) - 1
    return raw.withColumn("_k", inside).join(starts, ["source_index", "path"]).withColumn("seq", F.col("before") + F.col("_k")).drop("before", "_k")


def inline_prompts(spark: SparkSession, prompts: list[str], task: str = "qualitative") -> DataFrame:
    """Configured prompts as evaluation rows."""
    return spark.createDataFrame([(f"{task}:prompt_{k:03d}", task, p) for k, p in enumerate(prompts)], "example_id string, task_id string, prompt string")


# The fields of an evaluation record that hold its text, its prompt and its answer, in
# order of preference.
TEXT_FIELDS = ("text", "content", "passage", "question", "prompt")
PROMPT_FIELDS = ("prompt", "question", "instruction", "input", "cloze", "context")
ANSWER_FIELDS = ("answer", "expected", "target", "output", "reference", "completion")


def eval_files(spark: SparkSession, task: str, kind: str, path: str) -> DataFrame:
    """Evaluation examples of a folder of text, Markdown, JSONL and CSV files: example_id, task_id, kind, prompt, answer, text.

    The text is the first text field that is not blank, else the filled prompt fields and the answer
    by lines; prompt and answer are the first filled ones.  Records without any text are dropped.
    """
    source = Source(task, path)
    by: dict = {}
    for f in _files(spark, source):
        by.setdefault(f.lower().rsplit(".", 1)[1], []).append(f)
    out = spark.createDataFrame([], "key string, m map<string,string>")
    plain = by.get("txt", []) + by.get("md", [])
    if plain:
        whole = spark.read.text(plain, wholetext=True).select(F.col("_metadata.file_path").alias("key"), F.create_map(F.lit("text"), F.regexp_replace("value", "\r\n?", "\n")).alias("m"))
        out = out.unionByName(whole)
    if by.get("jsonl"):
        lines = spark.read.text(by["jsonl"]).where(~T.is_blank("value")).select(F.concat_ws("#", F.col("_metadata.file_path"), F.md5("value")).alias("key"), "value", F.from_json("value", "map<string,string>").alias("m"))
        bad = F.raise_error(F.concat(F.lit("invalid JSON: "), F.substring("value", 1, 80))).cast("map<string,string>")
        out = out.unionByName(lines.select("key", F.when(F.col("m").isNull() & ~T.is_blank("value"), bad).otherwise(F.col("m")).alias("m")))
    if by.get("csv"):
        rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(by["csv"])
        names = rows.columns
        m = F.map_filter(F.create_map(*(x for c in names for x in (F.lit(c), F.col(f"`{c}`")))), lambda k, v: v.isNotNull())
        out = out.unionByName(rows.select(F.concat_ws("#", F.col("_metadata.file_path"), F.md5(F.to_json(m))).alias("key"), m.alias("m")))
    first = lambda names: F.coalesce(*(F.when(~T.is_blank(F.coalesce(F.col("m")[n], F.lit(""))), F.col("m")[n]) for n in names))
    filled = F.array_compact(F.array(*(F.when(~T.is_blank(F.coalesce(F.col("m")[n], F.lit(""))), F.col("m")[n]) for n in PROMPT_FIELDS), first(ANSWER_FIELDS)))
    text = F.coalesce(first(TEXT_FIELDS[:3]), F.when(F.size(filled) > 0, F.array_join(filled, "\n")))
    found = out.select(F.coalesce(F.col("m")["id"], F.col("key")).alias("key"), first(PROMPT_FIELDS).alias("prompt"), first(ANSWER_FIELDS).alias("answer"), text.alias("text"))
    return found.where("text is not null").select(F.concat(F.lit(task + ":"), "key").alias("example_id"), F.lit(task).alias("task_id"), F.lit(kind).alias("kind"), "prompt", "answer", "text")


def small_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A tree of text files as rows (id, text): stripped, empty ones skipped, numbered by file before skipping."""
    files = [f for f in _files(spark, Source("small", path)) if f.lower().endswith((".txt", ".md"))]
    if not files:
        return spark.createDataFrame([], "id string, text string")
    numbers = spark.createDataFrame([(f.split(":", 1)[-1].lstrip("/"), k) for k, f in enumerate(files)], "p string, k long")
    df = spark.read.text(files, wholetext=True).select(F.regexp_replace("_metadata.file_path", "^[a-z]+:/+", "").alias("p"), T.strip(F.regexp_replace("value", "\r\n?", "\n")).alias("text"))
    return df.join(F.broadcast(numbers), "p").where("text <> ''").select(F.format_string("doc-%05d", "k").alias("id"), "text")


METRIC_ROW = "id long, created_at string, stage string, step long, name string, value double, unit string, config_hash string, metadata_json string"
ARTIFACT_EVENT = "id long, created_at string, stage string, event_type string, config_hash string, metadata_json string"


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, sha256, category) of the files of a run directory."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    p = F.lower("path")
    category = (
        F.when(F.contains(p, F.lit("manifest")), "manifest").when(F.contains(p, F.lit("report")), "report").when(p.rlike(r"\.(parquet|jsonl|csv)$"), "data")
        .when(p.rlike(r"\.(ya?ml)$"), "config").when(p.rlike(r"\.json$"), "metadata").otherwise("other")
    )
    return df.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), category.alias("category"))
