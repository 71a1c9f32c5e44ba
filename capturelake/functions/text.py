"""Values in text: rates and times in names and logs, paths, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns' meaning is given with each function.
MSPS_TOKENS = r"(\d+(?:\.\d*)?(?:[mM][sS][pP][sS])?)"
LOG_DURATION = r"(?i)duration[:= \t\n\f\r]*([0-9.]+)"
CAPTURE_BASE = r"(?s)^(.*?[0-9]{4}\.[0-9]{2}\.[0-9]{2}_[0-9]{2}\.[0-9]{2}\.[0-9]{2})"
#: Bytes of a log that are read.
LOG_BYTES = 64 << 10
MOST_U64 = 18446744073709551615


def msps(path: Column) -> Column:
    """The first positive number directly before ``msps``, in any case.

    Numbers are taken from left to right, digits with at most one point, so
    that ``1.2.3msps`` is 1.2 and then 3.
    """
    tokens = F.filter(F.regexp_extract_all(path, F.lit(MSPS_TOKENS), F.lit(1)), lambda t: F.lower(t).endswith("msps"))
    numbers = F.transform(tokens, lambda t: F.substring(t, F.lit(1), F.length(t) - 4).try_cast("double"))
    return F.get(F.filter(numbers, lambda x: x > 0), F.lit(0))


def log_duration(text: Column) -> Column:
    """The seconds after the first ``duration`` that a number follows."""
    found = F.transform(F.regexp_extract_all(text, F.lit(LOG_DURATION), F.lit(1)), lambda t: t.try_cast("double"))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def log_head(content: Column) -> Column:
    """The first LOG_BYTES bytes as text; a character cut at the end is replaced."""
    return F.make_valid_utf8(F.substring(content, 1, LOG_BYTES).cast("string"))


def capture_base(stem: Column) -> Column:
    """The name up to its first time stamp (YYYY.MM.DD_HH.MM.SS), else all of it."""
    base = F.regexp_extract(stem, CAPTURE_BASE, 1)
    return F.when(base == "", stem).otherwise(base)


def path_dir(path: Column) -> Column:
    """What is before the last slash: '/' of a file in the root, '' without a slash."""
    at = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when((at == "") & path.startswith("/"), F.lit("/")).otherwise(at)


def path_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def path_stem(path: Column) -> Column:
    """The name without its last extension; a leading point does not begin one."""
    name = path_name(path)
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]*$", "$1")


def path_ext(path: Column) -> Column:
    """What is after the last point; null without one (or only a leading one)."""
    ext = F.regexp_extract(path_name(path), r"(?s)^.+\.([^.]*)$", 1)
    return F.when(path_name(path).rlike(r"(?s)^.+\.[^.]*$"), ext)


def flac_file(path: Column) -> Column:
    """Whether a dropped path is taken: its name ends in .flac, in any case."""
    return F.lower(path).endswith(".flac")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def truncate_utf8(text: Column, size: int) -> Column:
    """As much of the text as fits in ``size`` bytes with a final zero byte,
    without cutting a character."""
    data, n = text.cast("binary"), size - 1
    # a UTF-8 character has at most three bytes after its first: step back over them

    def starts(k: int) -> Column:
        # whether a character starts at byte k (from 0), or the text ends there
        return F.conv(F.hex(F.substring(data, k + 1, 1)), 16, 10).cast("int").bitwiseAND(0xC0) != 0x80

    cut = F.lit(max(0, n - 3))
    for back in (2, 1, 0):
        if n - back >= 0:
            cut = F.when(starts(n - back), F.lit(n - back)).otherwise(cut)
    cut = F.when(starts(n), F.lit(n)).otherwise(cut)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.substring(data, F.lit(1), cut).cast("string"))


def parse_u64(text: Column) -> Column:
    """An unsigned 64-bit number: digits with at most a leading plus, in range;
    null otherwise.  As DECIMAL(20,0)."""
    value = F.when(text.rlike(r"^\+?[0-9]+$"), F.regexp_replace(text, r"^\+?0*(?=[0-9])", ""))
    value = F.when(F.length(value) <= 20, value).try_cast("decimal(20,0)")
    return F.when(value <= F.lit(str(MOST_U64)).cast("decimal(20,0)"), value)


def parse_f64(text: Column) -> Column:
    """A floating-point number as it is written in decimal, or inf or nan; null otherwise."""
    number = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    special = F.regexp_extract(F.lower(text), r"^([+-]?)(?:inf(?:inity)?|nan)$", 0)
    return F.when(special.endswith("nan"), F.lit(float("nan"))).when(special.startswith("-"), F.lit(float("-inf"))).when(special != "", F.lit(float("inf"))).otherwise(number)


def tag(tags: Column, name: str) -> Column:
    """The first value of a tag, by name in any case; null if there is none."""
    return F.get(F.filter(tags, lambda t: F.upper(t["k"]) == name.upper()), F.lit(0))["v"]


def join_warnings(*warnings: Column) -> Column:
    """The warnings that are not null, in order, joined by '; '."""
    return F.concat_ws("; ", *warnings)


def output_name(where: Column, stem: Column, ext: Column, n: Column | int = 1) -> Column:
    """``dir/stem-cut.ext``, or ``-cut-n`` from the second on; ``flac`` without
    an extension, ``.`` without a directory."""
    n = F.lit(n) if isinstance(n, int) else n
    where = F.when(where == "", F.lit("./")).when(where == "/", where).otherwise(F.concat(where, F.lit("/")))
    suffix = F.when(n > 1, F.concat(F.lit("-cut-"), n.cast("string"))).otherwise(F.lit("-cut"))
    return F.concat(where, stem, suffix, F.lit("."), F.coalesce(ext, F.lit("flac")))
