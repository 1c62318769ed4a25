"""Project profiles from file listings: extensions, languages, marker files, ignored folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: extensions, marker files and folders
EXTENSIONS = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "java": "java", "kt": "kotlin", "go": "go", "dart": "dart", "cs": "csharp", "cpp": "cpp", "cc": "cpp", "c": "c", "rb": "ruby",
    "php": "php", "swift": "swift",
}
MARKERS = {
    "Cargo.toml": "rust", "package.json": "javascript", "tsconfig.json": "typescript", "requirements.txt": "python", "pyproject.toml": "python",
    "setup.py": "python", "pom.xml": "java", "build.gradle": "java", "go.mod": "go", "pubspec.yaml": "dart",
}
IGNORED = ("node_modules", "target", ".git", "__pycache__", "dist", "build", ".vscode", ".idea", "vendor")
CONFIG_WEIGHT = 10


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_extension(path: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(file_name(path), r"[^/]\.([^./]+)$", 1)), F.lit(""))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def file_type(path: Column) -> Column:
    lower, ext = F.lower(path), file_extension(path)
    return (
        F.when(F.contains(lower, F.lit("test")) | F.contains(lower, F.lit("spec")), "test")
        .when(F.contains(lower, F.lit("example")) | F.contains(lower, F.lit("demo")), "example")
        .when(ext.isin("md", "rst", "txt", "adoc"), "documentation")
        .when(ext.isin("json", "yaml", "yml", "toml", "ini", "cfg"), "configuration")
        .when(ext.isin(list(EXTENSIONS)), "source")
        .otherwise(F.coalesce(ext, F.lit("other")))
    )


def visible(files: DataFrame, max_depth: int | None = None, column: str = "path") -> DataFrame:
    parts = F.split(F.col(column), "/")
    out = files.where(~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in IGNORED])))
    return out if max_depth is None else out.where(F.size(parts) <= max_depth)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def _mapped(column: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), column)


def languages(files: DataFrame, column: str = "path") -> DataFrame:
    """language, files, weight (files + 10 for each marker file), share of the weights of known languages."""
    rows = visible(files, column=column)
    own = rows.select(_mapped(file_extension(F.col(column)), EXTENSIONS).alias("language"), F.lit(1).alias("files"), F.lit(1).alias("weight"))
    marks = rows.select(_mapped(file_name(F.col(column)), MARKERS).alias("language"), F.lit(0).alias("files"), F.lit(CONFIG_WEIGHT).alias("weight"))
    sums = own.union(marks).where("language is not null").groupBy("language").agg(F.sum("files").alias("files"), F.sum("weight").alias("weight"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("weight").alias("__all")))).withColumn("share", F.col("weight") / F.col("__all")).drop("__all")


def language_score(found: Column, patterns: Column, available: Column, tools: Column) -> Column:
    return F.least(0.6 * F.coalesce(F.try_divide(found, patterns), F.lit(0.0)) + 0.4 * F.coalesce(F.try_divide(available, tools), F.lit(0.0)), F.lit(1.0))


def code_coverage(code: DataFrame, path: str = "path", content: str = "code") -> DataFrame:
    """path, functions, documented, coverage: a function is documented by a comment line above it or a docstring below."""
    lines = F.split(F.col(content), "\n")
    is_function = lambda x: x.rlike(r"^\s*(pub\s+|async\s+|export\s+|public\s+|static\s+)*(fn|def|function|func)\s+\w+")
    rows = code.select(path, F.posexplode(lines).alias("at", "line"), lines.alias("lines"))
    rows = rows.where(is_function(F.col("line")))
    above = F.reverse(F.slice("lines", F.greatest(F.col("at") - 4, F.lit(1)), F.least(F.col("at"), F.lit(5))))
    first = F.get(F.filter(above, lambda x: ~x.rlike(r"^\s*(#\[|@|$)")), 0)
    below = F.get(F.filter(F.slice("lines", F.col("at") + 2, 4), lambda x: F.trim(x) != ""), 0)
    documented = F.coalesce(first.rlike(r"^\s*(///|//!|/\*\*|\*/|\*|//)"), F.lit(False)) | (F.col("line").rlike(r"^\s*(async\s+)?def ") & F.coalesce(below.rlike(r"^\s*[rRuU]?(\"\"\"|''')"), F.lit(False)))
    counted = rows.select(path, documented.alias("d")).groupBy(path).agg(F.count("*").alias("functions"), F.count_if("d").alias("documented"))
    return code.select(path).join(counted, path, "left").na.fill(0, ["functions", "documented"]).withColumn("coverage", F.when(F.col("functions") == 0, 100.0).otherwise(100.0 * F.col("documented") / F.col("functions")))


def repeated_lines(docs: DataFrame, *, id_column: str = "doc_id", column: str = "text", length: int = 10, times: int = 2) -> DataFrame:
    """id, line, n of trimmed lines longer than ``length`` bytes that a document has more than ``times``."""
    rows = docs.select(id_column, F.explode(F.split(F.col(column), "\n")).alias("line")).withColumn("line", F.trim("line"))
    return rows.where(F.octet_length("line") > length).groupBy(id_column, "line").agg(F.count("*").alias("n")).where(F.col("n") > times)
