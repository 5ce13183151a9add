"""Readers of page layouts and samples kept as JSON, whatever names their fields have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names a field may have, the first that is there counts.
TEXT_KEYS = ("block_content", "text", "rec_text", "content", "label_content")
BOX_KEYS = ("block_bbox", "bbox", "box", "coordinate", "layout_bbox", "rec_box")
SIZE_KEYS = ("input_img_size", "img_size", "image_size", "page_size")
_BLOCK = ", ".join([*(f"{k}: string" for k in TEXT_KEYS), *(f"{k}: string" for k in BOX_KEYS), "block_label: string", "block_id: int", "block_order: int"])
SCHEMA = f"page int, width double, height double, {', '.join(f'{k} array<double>' for k in SIZE_KEYS)}, shape array<double>, parsing_res_list array<struct<{_BLOCK}>>"


def _box(text: Column) -> Column:
    """Numbers of a box printed as JSON, nested one level or flat; an object's edges count too."""
    return F.transform(F.regexp_extract_all(text, F.lit("-?[0-9]+(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(file, page, width, height, parsing_res_list) of JSON Lines layouts with the common field names; a line that is
    no JSON fails the query. A `shape` is height first."""
    d = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)
    size = F.coalesce(*[F.when(F.size(k) >= 2, F.col(k)) for k in SIZE_KEYS], F.when(F.size("shape") >= 2, F.array(F.col("shape")[1], F.col("shape")[0])))
    one = lambda b: F.struct(b["block_id"].alias("block_id"), b["block_order"].alias("block_order"), b["block_label"].alias("block_label"), F.coalesce(*[b[k] for k in TEXT_KEYS]).alias("block_content"), F.coalesce(*[_box(b[k]) for k in BOX_KEYS]).alias("block_bbox"))
    return d.select(F.col("_metadata.file_path").alias("file"), "page", F.coalesce("width", F.get(size, F.lit(0))).alias("width"), F.coalesce("height", F.get(size, F.lit(1))).alias("height"), F.transform("parsing_res_list", one).alias("parsing_res_list"))


def read_samples(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """Profile samples, one JSON object a line, at once or as a stream of files."""
    return (spark.readStream if stream else spark.read).schema(schema).json(path)


#: Folders that hold generated files, and endings of generated names.
GENERATED_FOLDERS, GENERATED_ENDINGS = ("ocr_output", ".ocr_cache", ".ocr"), ("searchable", "ocr")


def is_input(path: Column, suffix: str) -> Column:
    """Whether a path names an input of that suffix: not in a generated folder, not of a generated name."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, "\\.[A-Za-z]+$", "")
    inside = F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, GENERATED_FOLDERS)))
    made = F.element_at(F.split(stem, "_"), -1).isin(*GENERATED_ENDINGS) & F.contains(stem, F.lit("_"))
    return F.endswith(F.lower(name), F.lit(f".{suffix}")) & ~inside & ~made


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """(path, length) of input files in order; generated folders and files are left out. Contents are not read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")
    return f.where(is_input(F.col("path"), pattern.rpartition(".")[2])).orderBy("path")
