"""What kind a file is, by name and by its first bytes; which pictures of a document are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: formats, first bytes and limits
FORMATS = (("pdf", "pdf"), ("docx", "zip"), ("pptx", "zip"), ("hwpx", "zip"), ("hwp", "cfb"))
PDF_WITHIN = 1024
MAX_FILE = 100 * 1024 * 1024
MIN_EDGE, MAX_PIXELS, MAX_IMAGES = 50, 4_000_000, 50
_EXTENSIONS = "|".join(f for f, _ in FORMATS)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "format string, container string")


def supported(name: Column) -> Column:
    """A known extension in any case behind a name that is not empty."""
    return F.lower(F.regexp_extract(name, r"([^/\\]*)$", 1)).rlike(rf"^.+\.({_EXTENSIONS})$")


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, rf"(?is)^(.+)\.({_EXTENSIONS})$", "$1")


def extension(name: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(name, rf"(?i)\.({_EXTENSIONS})$", 1)), F.lit(""))


def container(content: Column) -> Column:
    """pdf, zip, cfb, hwp3 or null by the first bytes; a PDF's mark may stand anywhere in the first 1024."""
    # two hexadecimal digits are a byte, so a match must begin at an even place
    head = F.hex(F.substring(content, 1, PDF_WITHIN))
    pdf = head.rlike("^(?:[0-9A-F]{2}){0,1019}?255044462D")
    return (
        F.when(pdf, "pdf")
        .when(head.startswith("504B0304"), "zip")
        .when(head.startswith("D0CF11E0A1B11AE1"), "cfb")
        .when(head.startswith("48575020446F63756D656E742046696C652056"), "hwp3")
    )


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content, container of the supported files under a path that are not too large."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where((F.col("length") <= MAX_FILE) & supported(F.col("path")))
    return found.select("path", "content", container(F.col("content")).alias("container"))


def image_size(content: Column) -> Column:
    """Struct of kind, width and height from the header of a PNG, GIF or BMP picture; null for others."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).try_cast("long")
    turned = lambda at, n: _little(content, at, n)
    head = F.hex(F.substring(content, 1, 8))
    made = lambda k, w, h: F.struct(F.lit(k).alias("kind"), w.alias("width"), h.alias("height"))
    return (
        F.when(head.startswith("89504E47"), made("png", number(17, 4), number(21, 4)))
        .when(head.startswith("474946"), made("gif", turned(7, 2), turned(9, 2)))
        .when(head.startswith("424D"), made("bmp", turned(19, 4), turned(23, 4)))
    )


def _little(content: Column, at: int, n: int) -> Column:
    """A little-endian number of n bytes."""
    parts = [F.hex(F.substring(content, at + i, 1)) for i in reversed(range(n))]
    return F.conv(F.concat(*parts), 16, 10).try_cast("long")


def kept_images(images: DataFrame, key: str, most: int = MAX_IMAGES) -> DataFrame:
    """Pictures (key, pos, signature, width, height) that are neither too small nor too large, first of each signature,
    ``most`` of a document."""
    good = images.where((F.col("width") >= MIN_EDGE) & (F.col("height") >= MIN_EDGE) & (F.col("width") * F.col("height") <= MAX_PIXELS))
    first = F.row_number().over(Window.partitionBy(key, "signature").orderBy("pos"))
    good = good.withColumn("_n", first).where("_n = 1")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return good.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")
