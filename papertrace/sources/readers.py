"""Readers with explicit schemas: field names are data here, so they are map keys, never inferred columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRUTH = (
    "doc_id string, printed map<string,string>, rows array<struct<key:string,anchor:string,cells:map<string,string>>>, "
    "reconciliation struct<sums:array<struct<name:string,of:array<string>,minus:array<string>,equals:string,tolerance:double>>,"
    "row_rules:array<struct<name:string,of:array<string>,equals:string,cells:array<string>,tolerance:double>>>"
)
IDENTITIES = "identities array<struct<name:string,of:array<string>,equals:string>>"
MANIFEST = "parser string, version string, source string, note string, total_seconds double, records array<struct<doc_id:string,dpi:int,seconds:double,chars:bigint,error:string,text_file:string>>"
INDEX = "n int, dpis array<int>, documents array<struct<doc_id:string,note:string,source:string,text_layer_chars:int,text_layer_source:string,scanned:boolean,files:map<string,struct<png:string,pdf:string,width:int,height:int>>>>"
SOURCES = "doc_id string, file string, page int, note string"
USAGE = "doc_id string, dpi int, model string, input_tokens bigint, output_tokens bigint, stop string"
#: Dollars per million tokens in and out, by model or model prefix.
PRICE = "model string, in_per_mtok double, out_per_mtok double"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names anything, in whatever file system it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def _path() -> Column:
    """The parts of the file's path that a row was read from; Spark gives it as a URI."""
    return F.split(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), "/")


def _json(spark: SparkSession, schema: str, *paths: str, glob: str | None = None, optional: bool = False) -> DataFrame:
    if optional and not any(exists(spark, p) for p in paths):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("multiLine", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).json(list(paths))


def truth(spark: SparkSession, corpus: str, override: str | None = None) -> DataFrame:
    """Label documents of a folder (or of `override`). A document goes by its file's name up to the first dot,
    whatever its doc_id says: that is what runs name it by."""
    df = _json(spark, TRUTH, override or corpus, glob="*.truth.json")
    return df.withColumn("doc_id", F.substring_index(F.element_at(_path(), -1), ".", 1))


def identities(spark: SparkSession, path: str) -> DataFrame:
    """(name, of, equals) of the rules that span documents; a missing file has none."""
    return _json(spark, IDENTITIES, path, optional=True).select(F.inline("identities"))


def manifests(spark: SparkSession, out: str, parser: str | None = None) -> DataFrame:
    """A row per record of each run under `out`: (parser, version, source, doc_id, dpi, seconds, chars, error,
    text_file). The run's folder names the parser; records, not files, say what was read."""
    df = _json(spark, MANIFEST, f"{out}/*/manifest.json").withColumn("parser", F.element_at(_path(), -2))
    df = df.where(F.col("parser") == parser) if parser else df
    return df.select("parser", "version", "source", F.explode_outer("records").alias("r")).select("parser", "version", "source", "r.*")


def texts(spark: SparkSession, out: str) -> DataFrame:
    """(parser, text_file, text): each text file of each run, whole."""
    df = spark.read.text(f"{out}/*/", wholetext=True, pathGlobFilter="*.txt")
    parts = _path()
    return df.select(F.element_at(parts, -2).alias("parser"), F.element_at(parts, -1).alias("text_file"), F.col("value").alias("text"))


def corpus_index(spark: SparkSession, path: str) -> DataFrame:
    """(dpis, doc_id, scanned, files ...): a row per document of a corpus."""
    return _json(spark, INDEX, path).select("dpis", F.explode("documents").alias("d")).select("dpis", "d.*")


def page_sources(spark: SparkSession, path: str) -> DataFrame:
    """The source pages that a corpus is built from; a missing file is an error that says so."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path}: the list of source pages is missing")
    return _json(spark, SOURCES, path)


def present(spark: SparkSession, sources: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """sources whose file is in a folder (or below it), and those whose file is missing, which a build skips
    and names. Files are listed by Spark's reader, contents unread."""
    root = F.lit(folder.rstrip("/") + "/")
    path = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    held = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.element_at(F.split(path, root, 2), -1).alias("file")).distinct()
    return sources.join(held, "file", "left_semi"), sources.join(held, "file", "left_anti")


#: A stored report's page: its key, and verdicts by field.
SCORES = "parser string, doc_id string, dpi int, fields map<string,struct<printed:string,status:string,got:string,distance:int,typed:boolean>>"


def scores(spark: SparkSession, path: str) -> DataFrame | None:
    """Verdicts that sinks.write_scores() stored, as match.verdicts() gave them but for the rows' counts; None
    where nothing is stored, which leaves the check of labels alone."""
    if not exists(spark, path):
        return None
    return spark.read.schema(SCORES).json(path).select("parser", "doc_id", "dpi", F.explode("fields").alias("field", "v")).select("parser", "doc_id", "dpi", "field", "v.*")


def usage(spark: SparkSession, *globs: str) -> DataFrame:
    """(run, doc_id, dpi, model, input_tokens, output_tokens, stop) of all runs; none without files."""
    found = [g for g in globs if exists(spark, g)]
    if not found:
        return spark.createDataFrame([], f"run string, {USAGE}")
    return _json(spark, USAGE, *found).withColumn("run", F.concat_ws("/", F.slice(_path(), -3, 2)))


def prices(spark: SparkSession, rows: list[tuple[str, float, float]]) -> DataFrame:
    """A price list from literal rows."""
    return spark.createDataFrame([(m, float(a), float(b)) for m, a, b in rows], PRICE)


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, bytes, data_url) of page images and PDFs; kind is image, pdf or other, by suffix."""
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    kind = F.when(ext.isin("png", "jpg", "jpeg", "tif", "tiff", "webp"), "image").when(ext == "pdf", "pdf").otherwise("other")
    mime = F.when(kind == "pdf", "application/pdf").otherwise(F.concat(F.lit("image/"), F.when(ext == "jpg", "jpeg").otherwise(ext)))
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select("path", kind.alias("kind"), F.col("length").alias("bytes"), F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64("content")).alias("data_url"))
