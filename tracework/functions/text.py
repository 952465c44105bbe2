"""Scalar text operators as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import literals
from . import patterns as P


def blank(s: Column) -> Column:
    """Null or white space only."""
    return s.isNull() | s.rlike(r"(?U)\A\s*\z")


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)\A\s+|\s+\z", "")


def scrub(s: Column) -> Column:
    """Secrets replaced by their kind; null becomes empty."""
    return literals.replaced(F.coalesce(s, F.lit("")), P.SECRETS)


def clip(s: Column, n: int) -> Column:
    """Scrubbed, cut at ``n``, with an ellipsis after the cut."""
    s = scrub(s)
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("…"))).otherwise(s)


def truncate(s: Column, n: int, mark: str = "...") -> Column:
    """At most ``n`` characters, the mark included."""
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(max(n - len(mark), 0))), F.lit(mark))).otherwise(s)


def words(s: Column) -> Column:
    """White-space separated words without empty ones."""
    return F.filter(F.split(s, r"(?U)\s+"), lambda w: w != "")


def words_leading(s: Column) -> Column:
    """Words as a split keeps them that drops trailing empty parts but not a leading one."""
    parts = F.split(s, r"[ \t\n\x0B\f\r]+")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def n_words(s: Column) -> Column:
    return F.size(words(F.coalesce(s, F.lit("")))).cast("long")


def tokens(s: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded up."""
    return F.ceil(F.length(F.coalesce(s, F.lit(""))) / 4).cast("long")


def too_short(s: Column, least: int = 200) -> Column:
    return tokens(s) < least


def byte_marker(s: Column) -> Column:
    return F.concat(F.lit("["), F.octet_length(F.coalesce(s, F.lit(""))).cast("string"), F.lit(" bytes]"))


def prompt_marker(s: Column) -> Column:
    s = F.coalesce(s, F.lit(""))
    return F.concat(F.lit("["), F.octet_length(s).cast("string"), F.lit(" bytes, sha="), F.substring(F.sha2(s, 256), 1, 12), F.lit("]"))


def prompt_hash(s: Column) -> Column:
    return F.when(~blank(s), F.substring(F.sha1(s), 1, 12))


def normalise_prompt(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^a-z0-9 ]+", " "), " +", " "))


def n_lines(s: Column) -> Column:
    """Newlines, and one for a last line without one."""
    newlines = F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    return (newlines + F.when((F.length(s) > 0) & ~s.endswith("\n"), 1).otherwise(0)).cast("long")


def occurrences(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern)).cast("long")


def extension(path: Column) -> Column:
    """With its dot; a name that only starts with dots has none."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$|^", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def top_component(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def to_int(s: Column) -> Column:
    """The leading whole number of a text, else 0."""
    return F.coalesce(F.regexp_extract(F.coalesce(s, F.lit("")), r"^\s*([-+]?\d+)", 1).try_cast("long"), F.lit(0)).cast("long")


def truthy(s: Column) -> Column:
    """False for null, empty and the usual words for false."""
    return F.coalesce(~s.isin("", "0", "f", "F", "false", "FALSE", "off", "OFF"), F.lit(False))


def caps_ratio(s: Column) -> Column:
    """Capitals among letters; null without letters."""
    return F.try_divide(F.regexp_count(s, F.lit(r"\p{Lu}")).cast("double"), F.regexp_count(s, F.lit(r"\p{L}")).cast("double"))


def charged(s: Column) -> Column:
    """Swears, exclaims twice, or shouts two words that aren't usual abbreviations."""
    shouts = F.filter(F.regexp_extract_all(s, F.lit(P.SHOUT), F.lit(0)), lambda w: ~w.isin(*P.CAPS_ALLOWED))
    return s.rlike(P.FRUSTRATION) | (F.length(s) - F.length(F.replace(s, F.lit("!"), F.lit(""))) >= 2) | (F.size(shouts) >= 2)


def first_line_matching(s: Column, pattern: str) -> Column:
    """The first line with a match, stripped; null if none. A match may need the line's own end."""
    lines = F.transform(F.split(s, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"), lambda x: F.concat(x, F.lit("\n")))
    return strip(F.try_element_at(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(1)))


def or_null(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


# --- display ---


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def dollars(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, 2))


def short_tokens(n: Column, billions: bool = True) -> Column:
    """950, 1.2k, 104.2M, 2.0B (without ``billions`` 2000.0M); halves that are exact go to the even digit. Use it on aggregated rows."""
    from .numeric import round_even

    large = (n >= 1_000_000_000) & F.lit(billions)
    unit = F.when(large, 1e9).when(n >= 1_000_000, 1e6).otherwise(1e3)
    mark = F.when(large, "B").when(n >= 1_000_000, "M").otherwise("k")
    return F.when(n >= 1_000, F.concat(F.format_string("%.1f", round_even(n / unit, 1)), mark)).otherwise(n.cast("string"))


def duration(seconds: Column) -> Column:
    """1h 02m, 3m 05s, 7s."""
    s = F.floor(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(s >= 3600, F.format_string("%dh %02dm", h, m)).when(s >= 60, F.format_string("%dm %02ds", m, s % 60)).otherwise(F.format_string("%ds", s))
