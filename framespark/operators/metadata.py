"""Image metadata as tables: XMP and typed text parsed by expressions, tag names, display forms, inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: XMP tags, the metadata field each fills, and in which order (later ones win).
XMP_FIELDS = [
    ("tiff:Make", "Make"), ("tiff:Model", "Model"), ("exif:ExposureTime", "ExposureTime"), ("exif:FNumber", "FNumber"),
    ("exif:ISOSpeedRatings", "ISOSpeedRatings"), ("exif:FocalLength", "FocalLength"),
    ("exif:DateTimeOriginal", "DateTimeOriginal"), ("xmp:CreateDate", "DateTime"), ("xmp:CreatorTool", "Software"),
    ("aux:Lens", "LensModel"), ("exifEX:LensModel", "LensModel"), ("exif:Flash", "Flash"),
    ("exif:WhiteBalance", "WhiteBalance"), ("dc:description", "ImageDescription"), ("dc:creator", "Artist"),
    ("dc:rights", "Copyright"), ("exif:ShutterSpeedValue", "ShutterSpeedValue"), ("exif:ApertureValue", "ApertureValue"),
    ("exif:ExposureBiasValue", "ExposureBiasValue"), ("exif:MaxApertureValue", "MaxApertureValue"),
    ("exif:MeteringMode", "MeteringMode"), ("exif:ExposureMode", "ExposureMode"),
    ("exif:SceneCaptureType", "SceneCaptureType"),
]
#: Tag numbers of the image file formats.
TAG_IDS = {
    270: "ImageDescription", 271: "Make", 272: "Model", 305: "Software", 306: "DateTime", 315: "Artist", 33432: "Copyright",
    33434: "ExposureTime", 33437: "FNumber", 34855: "ISOSpeedRatings", 36867: "DateTimeOriginal", 37386: "FocalLength",
    42036: "LensModel",
}
RATIONAL_FIELDS = ("ExposureTime", "FNumber", "FocalLength")


def parse_xmp(rows: DataFrame, key: str, col: str = "xmp") -> DataFrame:
    """(key, field, value, num, den): every field that a text sets. An element's value wins over an attribute's, the
    last attribute over earlier ones, a later tag of the list over an earlier one. Values are typed by their field.
    """
    tags = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("tag"), F.lit(f).alias("field")) for i, (t, f) in enumerate(XMP_FIELDS))))
    each = rows.select(key, F.col(col).alias("text"), tags.alias("t")).select(key, "text", "t.*")
    found = F.expr("regexp_extract_all(text, concat(tag, '=\"([^\"]+)\"'), 1)")
    element = F.expr("trim(BOTH ' \n\t' FROM regexp_extract(text, concat('(?s)<', tag, '>(.*?)</', tag, '>'), 1))")
    raw = F.coalesce(F.nullif(element, F.lit("")), F.when(F.size(found) > 0, F.element_at(found, -1)))
    valued = each.withColumn("raw", raw).filter("raw is not null")
    last = valued.groupBy(key, "field").agg(F.max_by("raw", "i").alias("raw"))
    return last.select(key, "field", *typed_value(F.col("field"), F.col("raw")))


def typed_value(field: Column, raw: Column) -> list[Column]:
    """value, num, den of a field's text: rationals are split, the first list item is a speed, ISO times get colons."""
    rational = field.isin(*RATIONAL_FIELDS)
    parts = F.split(raw, "/")
    fraction = rational & (F.size(parts) == 2)
    num, den = parts[0].try_cast("long"), parts[1].try_cast("long")
    number = F.coalesce(raw.try_cast("double"), F.lit(0.0)).cast("string")
    item = F.regexp_extract(raw, "<rdf:li>([^<]+)</rdf:li>", 1)
    time = F.when(raw.contains("T"), F.regexp_replace(F.regexp_replace(raw, "T", " "), "-", ":")).otherwise(raw)
    value = (
        F.when(fraction, raw)
        .when(rational, number)
        .when(field == "ISOSpeedRatings", F.coalesce(F.nullif(item, F.lit("")), raw))
        .when(field.isin("DateTime", "DateTimeOriginal"), time)
        .otherwise(raw)
    )
    return [value.alias("value"), F.when(fraction, num).alias("num"), F.when(fraction, den).alias("den")]


def parse_typed_text(text: Column) -> Column:
    """(kind, value, num, den, items) of text that begins with the name of its type; other text is as it is."""
    kind = F.regexp_extract(text, "^(RATIONAL|INT|FLOAT|STRING|BYTES|ARRAY):", 1)
    rest = F.when(kind == "", text).otherwise(F.regexp_replace(text, "^[A-Z]+:", ""))
    rational = (kind == "RATIONAL") & rest.rlike(r"^\s*-?\d+/-?\d+\s*$")
    num = F.when(rational, F.split(rest, "/")[0].try_cast("long"))
    den = F.when(rational, F.split(rest, "/")[1].try_cast("long"))
    items = F.when(kind == "ARRAY", F.transform(F.split(rest, ","), lambda x: F.trim(x)))
    return F.struct(
        F.when(kind == "", "TEXT").otherwise(kind).alias("kind"), rest.alias("value"), num.alias("num"), den.alias("den"),
        items.alias("items"),
    )


def normalize_tags(rows: DataFrame, col: str = "tag") -> DataFrame:
    """Tag names without their prefixes, numbers as names; tags of the container format alone are dropped."""
    names = F.create_map(*(F.lit(v) for pair in TAG_IDS.items() for v in (str(pair[0]), pair[1])))
    named = F.coalesce(F.try_element_at(names, F.col(col)), F.col(col))
    prefixed = rows.withColumn("tag_name", named)
    own = ~F.col("tag_name").startswith("PNG_") | F.col("tag_name").startswith("PNG_EXIF_")
    return prefixed.filter(own).withColumn("tag_name", F.regexp_replace("tag_name", "^(PNG_EXIF_|EXIF_)", ""))


def format_value(field: Column, value: Column, num: Column, den: Column) -> Column:
    """How a value is shown: f/2.8, 1/250 s, ISO 100, 50.0 mm, day/month/year."""
    number = F.coalesce(num / den, value.try_cast("double"))
    ratio = F.concat(num.cast("string"), F.lit("/"), den.cast("string"))
    aperture = F.when(den == 0, "f/>1024").when(number.isNotNull(), F.format_string("f/%.1f", number)).otherwise(value)
    short = F.when(num.isNotNull(), ratio).otherwise(F.concat(F.lit("1/"), F.round(1 / number).cast("long").cast("string")))
    exposure = F.when(number.isNull(), value).when(number >= 0.5, F.format_string("%.1f s", number)).otherwise(F.concat(short, F.lit(" s")))
    day = F.regexp_replace(value, r"^(\d+):(\d+):(\d+) (.*)$", "$3/$2/$1 $4")
    speed = F.when(value.try_cast("long").isNotNull(), F.concat(F.lit("ISO "), value.try_cast("long").cast("string"))).otherwise(value)
    length = F.when(number.isNotNull(), F.format_string("%.1f mm", number)).otherwise(value)
    return (
        F.when(field.isin("FNumber", "ApertureValue", "MaxApertureValue"), aperture)
        .when(field.isin("ExposureTime", "ShutterSpeedValue"), exposure)
        .when(field.isin("DateTime", "DateTimeOriginal", "DateTimeDigitized"), day)
        .when(field == "ISOSpeedRatings", speed)
        .when(field == "FocalLength", length)
        .when(num.isNotNull(), ratio)
        .otherwise(value)
    )


def format_name(field: Column) -> Column:
    """CamelCase split to words."""
    return F.regexp_replace(field, "(?<=[a-zA-Z])(?=[A-Z][a-z])", " ")


def choose_metadata_source(frames: DataFrame, raw: list[str]) -> DataFrame:
    """(stack_id, path): the file whose metadata an output takes: the first with the first file's extension, else the
    first that is not raw, else the first."""
    first = F.min_by("ext", "path").over(Window.partitionBy("stack_id"))
    rank = F.when(F.col("ext") == F.col("want"), 0).when(~F.col("ext").isin(raw), 1).otherwise(2)
    ranked = frames.withColumn("want", first).withColumn("rank", rank)
    return ranked.groupBy("stack_id").agg(F.min(F.struct("rank", "path"))["path"].alias("path"))


def inherit_metadata(outputs: DataFrame, sources: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every output with the metadata rows of its stack's source; outputs without any stay."""
    chosen = sources.select("stack_id", F.col("path").alias("source"))
    rows = metadata.withColumnRenamed("path", "source")
    return outputs.join(chosen, "stack_id", "left").join(rows, "source", "left")
