"""Column functions over ids, years, times, sizes, states and links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Eras by their first year past the end.
ERAS = ((1990, "80s及更早"), (2000, "90s"), (2010, "2000s"), (2020, "2010s"))
LAST_ERA, NO_ERA = "2020s", "未知"


def year_to_era(year: Column) -> Column:
    y = year.cast("double")
    out = F.when(y.isNull() | (y <= 0), F.lit(NO_ERA))
    for end, name in ERAS:
        out = out.when(y < end, F.lit(name))
    return out.otherwise(F.lit(LAST_ERA))


def valid_year(year: Column, now: int, ahead: int = 1) -> Column:
    return F.coalesce(year.between(1900, now + ahead), F.lit(False))


def stable_id(c: Column, prefix: str) -> Column:
    """prefix and the first 12 hex digits of the SHA-1 of a path or of bytes."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(c), 1, 12))


def djb2(c: Column) -> Column:
    """The 32-bit hash h * 33 + code, in hex without leading zeros."""
    start = F.lit(5381).cast("long")
    step = lambda a, x: F.pmod(a * 33 + F.ascii(x), F.lit(1 << 32))
    return F.lower(F.hex(F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), start, step)))


def normalize_status(c: Column) -> Column:
    """Any wording as waiting, success, error or downloading; the order of the tests matters."""
    s = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return (
        F.when((s == "") | s.rlike("wait|queue|pending|等待|排队"), F.lit("waiting"))
        .when(s.rlike("success|成功|完成|done|finish"), F.lit("success"))
        .when(s.rlike("error|fail|失败|错误"), F.lit("error"))
        .when(s.rlike("download|下载|running|progress|进行"), F.lit("downloading"))
        .otherwise(F.lit("waiting"))
    )


def public_status(c: Column) -> Column:
    return F.when(c == "downloading", F.lit("running")).otherwise(F.coalesce(F.nullif(c, F.lit("")), F.lit("waiting")))


def best_encoding(names: Column) -> Column:
    """Of an array of encodings, that with the highest number at its end, lossless before lossy, then the first."""
    def ranked(x: Column, i: Column) -> Column:
        rate = F.coalesce(F.nullif(F.regexp_extract(x, r"(\d{3,4})\s*$", 1), F.lit("")).cast("int"), F.lit(0))
        return F.struct(rate.alias("rate"), x.rlike("(?i)flac|ape|wav|lossless").alias("lossless"), (-i).alias("at"), x.alias("name"))

    return F.coalesce(F.array_max(F.transform(names, ranked))["name"], F.lit(""))


def to_millis(c: Column) -> Column:
    """Seconds, milliseconds or a date as text, in milliseconds; 0 if unreadable."""
    s = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    number = F.expr("try_cast(null as bigint)")
    number = F.when(s.rlike(r"^\d{1,18}$"), s.cast("long")).otherwise(number)
    millis = F.when(number < 1_000_000_000_000, number * 1000).otherwise(number)
    return F.greatest(F.coalesce(F.when(s.rlike(r"^\d+$"), millis).otherwise(F.unix_millis(F.try_to_timestamp(s))), F.lit(0)), F.lit(0)).cast("long")


def elapsed_seconds(start: Column, end: Column) -> Column:
    a, b = to_millis(start), to_millis(end)
    return F.when((a == 0) | (b == 0) | (b < a), F.lit(0)).otherwise(F.floor((b - a) / 1000 + 0.5)).cast("long")


def estimated_bytes(kbps: Column, seconds: Column) -> Column:
    return F.floor(F.coalesce(kbps, F.lit(0)) * 1000 / 8 * F.coalesce(seconds, F.lit(0)) + 0.5).cast("long")


def progress(c: Column, status: Column) -> Column:
    """100 when done, else within 0 to 99."""
    n = F.coalesce(c.try_cast("double"), F.lit(0.0))
    return F.when(status == "success", F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(99.0), n)))


def mask_account(c: Column) -> Column:
    s = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    short = F.concat(F.substring(s, 1, 1), F.lit("*"))
    return F.when(s == "", s).when(F.char_length(s) <= 2, short).otherwise(F.concat(F.substring(s, 1, 2), F.lit("****"), F.right(s, F.lit(1))))


def response_verdict(status: Column, body: Column) -> Column:
    """ok, httpError, parseError or businessError of a logged response."""
    parsed = F.try_parse_json(F.coalesce(body, F.lit("")))
    code = F.get_json_object(body, "$.code").try_cast("double")
    error = F.coalesce(F.get_json_object(body, "$.error"), F.lit(""))
    failed = F.coalesce(code != 200, F.lit(False)) | ~error.isin("", "false", "0")
    ok = F.coalesce((status >= 200) & (status < 300), F.lit(False))
    return F.when(parsed.isNull(), F.lit("parseError")).when(failed, F.lit("businessError")).when(~ok, F.lit("httpError")).otherwise(F.lit("ok"))


def is_busy(status: Column, message: Column) -> Column:
    return F.coalesce(message, F.lit("")).rlike("(?i)busy|try again|rate limit|too many") | F.coalesce(status >= 500, F.lit(False))


def lookup(c: Column, table: Mapping[str, str], other: str) -> Column:
    """A value's entry in a small fixed table."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(other))


# Audio formats and media types by file extension.
FORMATS = {
    "mp3": "MP3", "flac": "FLAC", "ogg": "OGG", "oga": "OGG", "opus": "OGG", "m4a": "M4A", "mp4": "M4A", "m4b": "M4A", "aac": "AAC", "wav": "WAV",
    "wma": "WMA", "ape": "APE",
}
MEDIA_TYPES = {
    "mp3": "audio/mpeg", "flac": "audio/flac", "m4a": "audio/mp4", "mp4": "audio/mp4", "m4b": "audio/mp4", "ogg": "audio/ogg", "oga": "audio/ogg",
    "opus": "audio/ogg", "wav": "audio/wav", "wma": "audio/x-ms-wma", "aac": "audio/aac", "ape": "audio/ape",
}


def format_of(extension: Column) -> Column:
    return lookup(F.lower(extension), FORMATS, "UNKNOWN")


def media_type_of(extension: Column) -> Column:
    return lookup(F.lower(extension), MEDIA_TYPES, "")


def sized_link(url: Column, size: int, hosts: Sequence[str]) -> Column:
    """The link with a size parameter, on hosts that scale images; else as it is."""
    bare = F.get(F.split(url, "[?]"), 0)
    return F.when(url.rlike("(?i)^https?://[^/]*(" + "|".join(h.replace(".", "[.]") for h in hosts) + ")"), F.concat(bare, F.lit(f"?param={size}y{size}"))).otherwise(url)


def is_real_cover(cover: Column) -> Column:
    return F.coalesce(cover.startswith("al-"), F.lit(False))


def sniff_image(content: Column) -> Column:
    """struct(mime, width, height) from the first bytes of an image; sizes of PNG only, JPEG when in doubt."""
    head = F.hex(F.substring(content, 1, 24))
    number = lambda at: F.conv(F.substring(head, at, 8), 16, 10).cast("int")
    png, webp = head.startswith("89504E470D0A1A0A") & (F.length(head) >= 48), head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250")
    mime = F.when(png, F.lit("image/png")).when(webp, F.lit("image/webp")).otherwise(F.lit("image/jpeg"))
    return F.struct(mime.alias("mime"), F.when(png, number(33)).otherwise(0).alias("width"), F.when(png, number(41)).otherwise(0).alias("height"))
