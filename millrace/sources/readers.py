"""Sources: result trees, JSON lines, XML pairs, Markdown folders, file inventories, manifests, paged services."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Grading record of a run, its timing file, and a figure manifest's records.
GRADING = """expectations array<struct<text:string,passed:boolean,evidence:string>>, summary struct<passed:bigint,failed:bigint,total:bigint,pass_rate:double>,
execution_metrics struct<tool_calls:map<string,bigint>,total_tool_calls:bigint,errors_encountered:bigint,output_chars:bigint>, timing struct<total_duration_seconds:double>,
user_notes_summary struct<uncertainties:array<string>,needs_review:array<string>,workarounds:array<string>>"""
TIMING = "total_tokens bigint, total_duration_seconds double"
MANIFEST = "fig_num int, filename string, caption string, page int, width int, height int, clip_rect array<double>, suspect boolean, suspect_reason string"


def _json(spark: SparkSession, path: str, schema: str, glob: str) -> DataFrame:
    """JSON documents with their path; a corrupt one has `corrupt`."""
    read = spark.read.schema(f"{schema}, corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return read.json(path).withColumn("path", F.col("_metadata.file_path"))


def runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(runs, quarantine) of <folder>/[runs/]eval-*/<config>/run-*/grading.json with timing.json beside it.

    Passes come from the record's summary. The timing file counts only where the inline time is 0 or missing; tokens
    are its tokens, else the characters of the output (tokens_source says which).
    """
    place = r"/eval-([^/]+)/([^/]+)/run-([^/]+)/[^/]+$"
    graded = _json(spark, folder, GRADING, "grading.json")
    graded = graded.select("*", F.regexp_extract("path", place, 1).alias("eval"), F.regexp_extract("path", place, 2).alias("config"), F.regexp_extract("path", place, 3).cast("string").alias("run")).where("config <> ''")
    timing = _json(spark, folder, TIMING, "timing.json").where("corrupt is null").select(F.regexp_replace("path", "/[^/]+$", "").alias("folder"), "total_tokens", F.col("total_duration_seconds").alias("side_seconds"))
    good = graded.where("corrupt is null or summary is not null").withColumn("folder", F.regexp_replace("path", "/[^/]+$", "")).join(timing, "folder", "left")
    inline = F.coalesce("timing.total_duration_seconds", F.lit(0.0))
    use = inline == 0.0
    notes = lambda k: F.coalesce(f"user_notes_summary.{k}", F.array().cast("array<string>"))
    out = good.select(
        F.regexp_extract("path", "^(.*/eval-[^/]+)/", 1).alias("folder"),
        F.expr("try_cast(eval as bigint)").alias("eval_id"),
        "config",
        F.expr("try_cast(run as bigint)").alias("run_number"),
        *[F.coalesce(f"summary.{k}", F.lit(0)).alias(k) for k in ("pass_rate", "passed", "failed", "total")],
        F.when(use, F.coalesce("side_seconds", F.lit(0.0))).otherwise(inline).alias("time_seconds"),
        F.coalesce(F.when(use, F.col("total_tokens")), F.col("execution_metrics.output_chars"), F.lit(0)).alias("tokens"),
        F.when(use & F.col("total_tokens").isNotNull(), "timing").otherwise("characters").alias("tokens_source"),
        F.coalesce("execution_metrics.total_tool_calls", F.lit(0)).alias("tool_calls"),
        F.coalesce("execution_metrics.errors_encountered", F.lit(0)).alias("errors"),
        "expectations",
        F.concat(notes("uncertainties"), notes("needs_review"), notes("workarounds")).alias("notes"),
    )
    return out, graded.where("corrupt is not null and summary is null").select("path", "corrupt")


def with_eval_id(runs_: DataFrame, metadata: DataFrame) -> DataFrame:
    """eval_id by metadata (folder, eval_id), else the folder's number, else its place in path order."""
    from pyspark.sql import Window

    place = F.dense_rank().over(Window.orderBy("folder")) - 1  # a row for each folder
    names = runs_.select("folder").distinct().withColumn("_place", place)
    return runs_.join(names, "folder").join(metadata.select("folder", F.col("eval_id").alias("_meta")), "folder", "left").withColumn("eval_id", F.coalesce("_meta", F.expr("try_cast(regexp_extract(folder, 'eval-([0-9]+)$', 1) as bigint)"), F.col("_place").cast("bigint"))).drop("_meta", "_place")


# Folders that are never searched for runs.
SKIPPED = ("node_modules", ".git", "__pycache__", "skill", "inputs")


def run_folders(paths: DataFrame, skip: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Folders that hold an outputs folder; none below another, none below a skipped name."""
    folder = F.regexp_extract("path", r"^(.*?)/outputs(?:/|$)", 1)
    found = paths.select(folder.alias("folder")).where("folder <> ''").distinct()
    return found.where(~F.arrays_overlap(F.split("folder", "/"), F.array(*map(F.lit, skip))))


def inventory(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, suffix, length) of all files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix"), "length")


# Suffixes of files that are shown as text.
TEXTS = ("txt", "md", "json", "csv", "py", "js", "ts", "tsx", "jsx", "yaml", "yml", "xml", "html", "css", "sh", "rb", "go", "rs", "java", "c", "cpp", "h", "hpp", "sql", "r", "toml")
# Suffixes of images.
IMAGES = ("png", "jpg", "jpeg", "gif", "svg", "webp")


def embedded(spark: SparkSession, folder: str) -> DataFrame:
    """Files by kind: text as text, images as data URIs, others as base64."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(suffix.isin(*TEXTS), "text").when(suffix.isin(*IMAGES), "image").when(suffix == "pdf", "pdf").when(suffix.isin("xlsx", "xls"), "sheet").otherwise("binary")
    mime = F.when(suffix == "svg", "image/svg+xml").when(suffix == "jpg", "image/jpeg").otherwise(F.concat(F.lit("image/"), suffix))
    files = files.withColumn("kind", kind)
    return files.select("path", "kind", "length", F.when(F.col("kind") == "text", F.decode("content", "UTF-8")).alias("text"), F.when(F.col("kind") == "image", F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64("content"))).when(F.col("kind") != "text", F.base64("content")).alias("data"))


def qa_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(question, answer) of XML qa_pair elements; one with a missing child is dropped, an empty one stays ''."""
    kept = spark.read.format("xml").schema("question string, answer string").option("rowTag", "qa_pair").option("nullValue", "\0").option("ignoreSurroundingSpaces", True).load(path)
    return kept.where("question is not null and answer is not null")


def json_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of JSON as variants; malformed and blank ones are left out. Works on streams."""
    return lines.withColumn("event", F.try_parse_json(column)).where("event is not null")


def markdown(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(file, text) of Markdown files, whole."""
    read = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", recursive)
    return read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("file"), F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))


def document_lines(texts: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def export_check(files: DataFrame, root: str) -> DataFrame:
    """What keeps a folder (path, suffix, length) from being exported: nested Markdown, no index, budgets."""
    inside = F.regexp_replace("path", f"^.*{root}/?", "")
    per = files.withColumn("inside", inside)
    checks = per.agg(
        F.count_if((F.col("suffix") == ".md") & F.contains("inside", F.lit("/"))).alias("nested"),
        F.count_if(F.col("inside") == "index.md").alias("index"),
        F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("length").alias("largest"),
    )
    problems = F.array_compact(F.array(F.when(F.col("nested") > 0, "nested_markdown"), F.when(F.col("index") == 0, "no_index"), F.when(F.col("files") > 50, "too_many_files"), F.when(F.col("bytes") > 10 * 1024 * 1024, "too_large"), F.when(F.col("largest") > 5 * 1024 * 1024, "file_too_large")))
    return checks.select(F.explode(problems).alias("problem"))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Records of <root>/<paper>/figures/figures_manifest.json with their paper."""
    found = _json(spark, root, MANIFEST, "figures_manifest.json").where("corrupt is null")
    return found.withColumn("paper", F.regexp_extract("path", "([^/]+)/figures/[^/]+$", 1)).drop("corrupt", "path")


def code_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(suffix, files, lines) of a source tree."""
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    return files.groupBy(F.lower(F.regexp_extract(F.col("_metadata.file_path"), r"\.([^./]+)$", 1)).alias("suffix")).agg(F.count("*").alias("files"), F.sum(F.size(F.split("value", "\n"))).alias("lines"))


def grep(lines: DataFrame, pattern: str, order: list[str], limit: int) -> DataFrame:
    """Lines that fit, the first `limit` in a stated order (the limit is the feature)."""
    return lines.where(F.col("line").rlike(pattern)).orderBy(*order).limit(limit)


def images(files: DataFrame) -> DataFrame:
    return files.where(F.col("suffix").isin(*[f".{x}" for x in IMAGES]))


def pdf_spans(files: DataFrame, parse: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """(path, page, block, line, span, x0, y0, x1, y1, size, text) by a parser the caller brings; NULs are taken out of texts."""
    schema = "path string, page int, block int, line int, span int, x0 double, y0 double, x1 double, y1 double, size double, text string"

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = [(path, *rest[:-1], (rest[-1] or "").replace("\x00", "")) for path, content in zip(frame["path"], frame["content"], strict=True) for rest in parse(bytes(content))]
            yield pd.DataFrame(rows, columns=["path", "page", "block", "line", "span", "x0", "y0", "x1", "y1", "size", "text"])

    return files.select("path", "content").mapInPandas(run, schema)


def page_texts(files: DataFrame, parse: Callable[[bytes], Iterator[str]]) -> DataFrame:
    """(path, page, text) of paged files, pages from 1, by a parser the caller brings; NULs are taken out."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                texts = [x.replace("\x00", "") for x in parse(bytes(content))]
                yield pd.DataFrame({"path": path, "page": range(1, len(texts) + 1), "text": texts}).astype({"page": "int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string")


def joined_pages(pages: DataFrame) -> DataFrame:
    """(path, text): a file's pages in order, each below a line with its number."""
    shown = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: F.concat(F.lit("=== PAGE "), p["page"].cast("string"), F.lit(" ===\n"), p["text"], F.lit("\n\n")))
    return pages.groupBy("path").agg(F.array_join(shown, "").alias("text"))


class PagedSource(DataSource):
    """A paged service as a source: option `fetch` names a function module:name(root, cursor) -> (rows, next cursor or None); `roots` are read in parallel."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "root string, item string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(root) for root in self.options["roots"].split(",") if root]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, name = self.options["fetch"].partition(":")
        fetch, cursor = getattr(importlib.import_module(module), name), None
        while True:
            rows, cursor = fetch(partition.value, cursor)
            for row in rows:
                yield partition.value, row
            if cursor is None:
                return


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
