"""Upload intake: validation codes, accepted metadata, publishing, retention.

``content`` is read for its head and length only; it is dropped before any shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idsieve.functions.common import blank_to_null, case, let
from idsieve.functions.fixed import DANGEROUS_PREFIXES, EXTENSION_MIME
from idsieve.settings import DEFAULT, Settings

INTERNAL_COLUMNS = ("compare_values", "_embedding", "raw_value", "full_text", "content")


NAME_SHOWN = 200


def clean_filename(name: Column) -> Column:
    """Base name with unusual characters folded to _, never empty, whole."""
    base = F.regexp_extract(F.coalesce(name, F.lit("")), r"([^/]*)/*$", 1)
    clean = F.regexp_replace(F.regexp_replace(base, r"^\.?$", "upload.bin"), r"(?U)[^\w.\- ()\[\]]+", "_")
    return F.coalesce(blank_to_null(clean), F.lit("upload.bin"))


def safe_filename(name: Column, shown: int = NAME_SHOWN) -> Column:
    """The clean name as it is shown: its first ``shown`` characters. What tells files apart is ``clean_filename``."""
    return F.left(clean_filename(name), F.lit(shown))


def extension(safe_name: Column) -> Column:
    """Lower-case suffix with its dot; a leading dot alone starts no suffix."""
    return F.lower(F.regexp_extract(safe_name, r"^.+(\.[^.]+)$", 1))


def head(content: Column) -> Column:
    """First 64 bytes as single-byte text, leading white space removed."""
    text = F.decode(F.substring(content, 1, 64), "ISO-8859-1")
    return F.regexp_replace(text, r"^[ \t\n\r\f\x0B]+", "")


def is_dangerous(content: Column) -> Column:
    """Does the head start like an executable, a script or a web page?"""
    starts = "|".join(rf"\Q{p}\E" for p in DANGEROUS_PREFIXES)
    return head(content).rlike(f"^(?:{starts})")


def sniff(content: Column) -> Column:
    """PNG, JPEG, WEBP or PDF by the leading bytes; null when unknown or under 12 bytes."""
    return let(F.hex(F.substring(content, 1, 12)), lambda hx: F.when(F.length(hx) >= 24, case(
        (hx.startswith("89504E470D0A1A0A"), "PNG"),
        (hx.startswith("FFD8FF"), "JPEG"),
        (hx.startswith("52494646") & hx.endswith("57454250"), "WEBP"),
        (hx.startswith("25504446"), "PDF"),
    )))


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height read from the PNG header."""

    def number(start: int) -> Column:
        return F.conv(F.hex(F.substring(content, start, 4)), 16, 10).cast("long")

    return number(17), number(21)


def webp_size(content: Column) -> tuple[Column, Column]:
    """Width and height read from the first chunk of a WEBP file: lossy, lossless or extended."""

    def number(start: int, size: int) -> Column:
        digits = [F.hex(F.substring(content, start + i, 1)) for i in reversed(range(size))]
        return F.conv(F.nullif(F.concat(*digits), F.lit("")), 16, 10).cast("long")

    kind = F.hex(F.substring(content, 13, 4))
    packed = number(22, 4)
    low = F.lit((1 << 14) - 1).cast("long")
    return (case((kind == "56503820", number(27, 2).bitwiseAND(low)), (kind == "5650384C", packed.bitwiseAND(low) + 1),
                 (kind == "56503858", number(25, 3) + 1)),
            case((kind == "56503820", number(29, 2).bitwiseAND(low)), (kind == "5650384C", F.shiftright(packed, 14).bitwiseAND(low) + 1),
                 (kind == "56503858", number(28, 3) + 1)))


#: Markers of JPEG frame headers (start of frame; not tables, arithmetic coding or extensions), and those without a length.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
BARE = frozenset(range(0xD0, 0xD8)) | {0x01}


def jpeg_frame(data: memoryview) -> tuple[int, int] | None:
    """(width, height) of a JPEG by walking its segments to the frame header; None if the walk does not get there.

    Only the heads of segments are looked at; image data is never reached.
    """
    at, n = 2, len(data)
    while at + 4 <= n and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
        elif kind in BARE:
            at += 2
        elif kind in FRAMES:
            if at + 9 > n:
                return None
            return int.from_bytes(data[at + 7:at + 9], "big"), int.from_bytes(data[at + 5:at + 7], "big")
        elif kind in (0xD9, 0xDA):
            return None
        else:
            size = int.from_bytes(data[at + 2:at + 4], "big")
            if size < 2:
                return None
            at += 2 + size
    return None


SIZE = T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())])


def jpeg_size(content: Column) -> Column:
    """struct(width, height) of JPEG bytes, null where there is no frame header; null bytes are passed over."""

    def run(bytes_of: pa.Array) -> pa.Array:
        found = [jpeg_frame(memoryview(x.as_buffer()).cast("B")) if x.is_valid else None for x in bytes_of]
        return pa.array([None if f is None else {"width": f[0], "height": f[1]} for f in found], pa.struct([("width", pa.int64()), ("height", pa.int64())]))

    return F.arrow_udf(run, SIZE)(content)


def header_code(settings: Settings = DEFAULT) -> Column:
    """Rejection code from name and bytes alone, null when none applies. First match wins."""
    c = F.col("content")
    facts = F.struct(
        F.coalesce(F.length(c), F.lit(0)).alias("size"), is_dangerous(c).alias("danger"),
        F.col("ext").alias("ext"), F.col("sniffed").alias("kind"))

    def code(x: Column) -> Column:
        ext, kind = x["ext"], x["kind"]
        pairs = case(
            (kind == "JPEG", ext.isin(".jpg", ".jpeg")), (kind == "PNG", ext == ".png"),
            (kind == "WEBP", ext == ".webp"), (kind == "PDF", ext == ".pdf"),
        )
        return case(
            (x["size"] == 0, "EMPTY_FILE"),
            (x["size"] > settings.max_upload_bytes, "FILE_TOO_LARGE"),
            (x["danger"], "DANGEROUS_CONTENT"),
            (~ext.isin(*settings.extensions), "BAD_EXTENSION"),
            (kind.isNull(), "BAD_SIGNATURE"),
            (~pairs, "MIME_MISMATCH"),
            ((kind == "PDF") & F.lit(not settings.allow_pdf), "PDF_DISABLED"),
        )

    return let(facts, code)


def with_header(files: DataFrame) -> DataFrame:
    """files(filename, content, ...) with safe name, extension and sniffed kind."""
    return (
        files.withColumn("full_name", clean_filename(F.col("filename")))
        .withColumn("safe_name", F.left("full_name", F.lit(NAME_SHOWN)))
        .withColumn("ext", extension(F.col("safe_name")))
        .withColumn("sniffed", sniff(F.col("content")))
    )


def validate(files: DataFrame, settings: Settings = DEFAULT,
             decoded: DataFrame | None = None, key: str = "path") -> DataFrame:
    """Add ``code`` (null when accepted), ``width`` and ``height``.

    PNG and WEBP sizes stand in the header, JPEG sizes in the frame header, which is found by walking the segments
    before it. With ``decoded(key, width, height)``, the image source, sizes of PNG and JPEG come from there,
    and what has no row there did not decode; it reads no WEBP.
    """
    f = with_header(files)
    png, webp, jpeg = (F.col("sniffed") == k for k in ("PNG", "WEBP", "JPEG"))
    (pw, ph), (ww, wh) = png_size(F.col("content")), webp_size(F.col("content"))
    if decoded is None:
        f = f.withColumn("_jpeg", jpeg_size(F.when(jpeg, F.col("content"))))
        f = f.withColumns({"width": F.when(png, pw).when(webp, ww).when(jpeg, F.col("_jpeg.width")),
                           "height": F.when(png, ph).when(webp, wh).when(jpeg, F.col("_jpeg.height"))}).drop("_jpeg")
        unreadable = (png | webp | jpeg) & (F.col("width").isNull() | F.col("height").isNull())
    else:
        f = f.join(decoded.select(key, F.col("width").alias("_w"), F.col("height").alias("_h")), key, "left")
        f = f.withColumns({"width": F.when(webp, ww).otherwise(F.col("_w")), "height": F.when(webp, wh).otherwise(F.col("_h"))}).drop("_w", "_h")
        unreadable = (F.col("sniffed") != "PDF") & (F.col("width").isNull() | F.col("height").isNull())
    size = F.struct(unreadable.alias("bad"), (F.col("width") * F.col("height")).alias("pixels"))
    by_size = let(size, lambda x: case(
        (x["bad"], "CORRUPT_IMAGE"), (x["pixels"] <= 0, "BAD_DIMENSIONS"),
        (x["pixels"] > settings.max_image_pixels, "TOO_MANY_PIXELS")))
    return f.withColumn("code", F.coalesce(header_code(settings), by_size))


def accepted_metadata(validated: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Metadata of accepted uploads; bytes are not carried on."""
    mime = case(*[(F.col("ext") == e, m) for e, m in EXTENSION_MIME.items()],
                otherwise="application/octet-stream")
    return validated.filter("code IS NULL").select(
        *[c for c in validated.columns if c not in
          ("filename", "content", "safe_name", "ext", "sniffed", "code", "width", "height")],
        F.col("safe_name").alias("filename"), mime.alias("mime_type"),
        F.length("content").alias("size_bytes"), "width", "height",
        F.when(F.col("sniffed") == "PDF", F.lit("PDF")).otherwise(F.lit("IMAGE")).alias("source_format"),
        F.lit(settings.retain_uploads).alias("retained"), F.lit("ACCEPTED").alias("status"),
    )


def public_projection(df: DataFrame, preview: int | None = 500) -> DataFrame:
    """Drop internal columns; of the full text a preview of so many characters is shown, all of it for None."""
    if "full_text" in df.columns:
        df = df.withColumn("text_preview", F.col("full_text") if preview is None else F.left("full_text", F.lit(preview)))
    return df.drop(*INTERNAL_COLUMNS)


def retention_split(files: DataFrame, now: Column, ttl_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(kept, purged) by age of ``modified``; a TTL of 0 or less purges nothing."""
    if ttl_seconds <= 0:
        return files, files.filter(F.lit(False))
    age = F.expr("timestampdiff(MICROSECOND, modified, _now)") / 1e6
    aged = files.withColumn("_now", now).withColumn("_old", age > ttl_seconds)
    # Hidden files are not purged.
    old = F.col("_old") & ~F.col("name").startswith(".")
    return aged.filter(~old).drop("_now", "_old"), aged.filter(old).drop("_now", "_old")
