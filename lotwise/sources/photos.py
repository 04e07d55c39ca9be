"""Binary photos: type by content, size limit and content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col
from ..functions.urls import host_within, public_https

MAX_PHOTO_BYTES = 2 * 1024 * 1024
# Hosts photos may come from.
PHOTO_HOSTS = ("autoscout24.net", "fbcdn.net")


def image_type(content: Column | str) -> Column:
    """MIME type told by leading and trailing bytes; NULL for anything else."""
    c = col(content)
    size = F.octet_length(c)
    head = lambda n: F.substring(c, 1, n)
    hexed = lambda text: F.unhex(F.lit(text))
    tail = lambda n: F.substring(c, -n, n)
    jpeg = (head(3) == hexed("FFD8FF")) & (tail(2) == hexed("FFD9"))
    png = (head(8) == hexed("89504E470D0A1A0A")) & F.contains(F.hex(tail(16)), F.lit("49454E44"))
    # Little-endian length in bytes 5 to 8 plus the eight-byte header is the whole file.
    length = F.conv(F.hex(F.concat(*[F.substring(c, i, 1) for i in (8, 7, 6, 5)])), 16, 10).cast("bigint")
    webp = (size >= 12) & (head(4) == hexed("52494646")) & (F.substring(c, 9, 4) == hexed("57454250")) & (length + 8 == size)
    return F.when(jpeg, "image/jpeg").when(png, "image/png").when(webp, "image/webp")


def approved_url(url: Column | str) -> Column:
    return public_https(url) & host_within(url, PHOTO_HOSTS)


def read_photos(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files under a folder with type, hash and the reason an unusable one is refused."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return judge_photos(files.select("path", "length", "content"))


def judge_photos(files: DataFrame, content: str = "content") -> DataFrame:
    mime = image_type(content)
    size = F.octet_length(content)
    issue = F.when((size == 0) | (size > MAX_PHOTO_BYTES), "too_large").when(mime.isNull(), "invalid_image")
    return files.withColumns({"mime": mime, "byte_count": size.cast("bigint"), "sha": F.sha2(F.col(content), 256), "issue": issue})
