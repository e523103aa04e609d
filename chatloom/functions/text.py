"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space characters that clients strip.
JS_WS = "[\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
JS_WS_SQL = "[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
UNKNOWN_TALKER = "未知"
DEFAULT_CATEGORY = "联系人"
CONFUSED_SECOND = "获了人友闭"


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, JS_WS, "")


def norm_content(c: Column) -> Column:
    """Key under which two contents count as equal: no white space, lower case; null as empty."""
    return F.lower(without_space(F.coalesce(c, F.lit(""))))


def collapsed(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, JS_WS + "+", " "))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9\\u4e00-\\u9fa5]", "_")


KEY_CHARS = 50
"""Characters of a content that count in the keys of the caches."""


def dedup_key(room: Column, sender: Column, content: Column) -> Column:
    """The cache key as text, for display: parts that hold its separator may look alike, so keys are compared by their parts."""
    return F.concat_ws(":", room, sender, F.substring(F.coalesce(content, F.lit("")), 1, KEY_CHARS))


def text_mode_key(target: Column, content: Column) -> Column:
    return F.concat_ws("|", target, F.lit(UNKNOWN_TALKER), F.substring(F.coalesce(content, F.lit("")), 1, KEY_CHARS))


def fuzzy_match(text: Column, target: Column) -> Column:
    """Does recognised text name a tab, allowing for the usual confusions?"""
    bare = without_space(text)
    group = (target == "群聊") & bare.rlike(f"^群[{CONFUSED_SECOND}]")
    contact = (target == "联系人") & bare.startswith("联系")
    function = (target == "功能") & bare.startswith("功能")
    return bare.contains(target) | group | contact | function


def run_id(ms: Column) -> Column:
    """The last six digits of an epoch in milliseconds."""
    return F.right(ms.cast("string"), F.lit(6))


def csv_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def targets(c: Column) -> Column:
    """``"name|category, ..."`` as array<struct<name, category>>; a missing category is a contact, names must not be empty."""

    def parse(item: Column) -> Column:
        parts = F.split(item, "\\|")
        category = F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
        return F.struct(F.trim(parts[0]).alias("name"), F.when(category == "", DEFAULT_CATEGORY).otherwise(category).alias("category"))

    return F.filter(F.transform(csv_list(c), parse), lambda t: t["name"] != "")


LOG_LINE = "^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})\\s*\\[(\\w+)\\]:\\s*(.+)"


def log_record(line: Column) -> Column:
    """struct<time, level, message>, or null if the line isn't a log record."""
    parts = [F.regexp_extract(line, LOG_LINE, i) for i in (1, 2, 3)]
    return F.when(line.rlike(LOG_LINE), F.struct(parts[0].alias("time"), F.lower(parts[1]).alias("level"), parts[2].alias("message")))


def markers(content: Column) -> Column:
    """struct<kind, label, size> of the first picture or file marker in a content."""
    picture, file = "【图片(?:：([^】]*))?】", "【文件\\|([^|】]*)\\|([^】]*)】"
    return F.when(content.rlike(file), F.struct(F.lit("file").alias("kind"), F.regexp_extract(content, file, 1).alias("label"), F.regexp_extract(content, file, 2).alias("size"))).when(
        content.rlike(picture), F.struct(F.lit("picture").alias("kind"), F.regexp_extract(content, picture, 1).alias("label"), F.lit("").alias("size"))
    )


def all_markers(content: Column) -> Column:
    """array<struct<kind, label, size>> of every picture and file marker in a content, in order."""
    found = F.regexp_extract_all(content, F.lit("(【图片(?:：[^】]*)?】|【文件\\|[^|】]*\\|[^】]*】)"), F.lit(1))
    return F.transform(found, markers)


def truncated(c: Column, most: int) -> Column:
    """The first characters, for display."""
    return F.substring(c, 1, most)


def random_delay(low: int, high: int, seed: int | None = None) -> Column:
    """A whole number from ``low`` to ``high``, both included; it differs between runs unless seeded."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("long")


def js_round(c: Column) -> Column:
    return F.floor(c + 0.5)
