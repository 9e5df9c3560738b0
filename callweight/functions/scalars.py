"""Names, paths, severities, byte formats, search ranks and other per-row expressions."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

WARN, CRITICAL = 1024, 4096


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bare(key: Column | str) -> Column:
    """The part of a key before its first @."""
    return F.substring_index(col(key), "@", 1)


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def stem(path: Column | str) -> Column:
    """File name without directory and last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def normal_path(path: Column | str, fold: bool = False) -> Column:
    """Backslashes to slashes; lower case too where the file system folds case."""
    p = F.translate(col(path), "\\", "/")
    return F.lower(p) if fold else p


def severity(peak: Column | str, warn: int = WARN, critical: int = CRITICAL) -> Column:
    """unknown (null), ok (<= warn), warn (<= critical), critical."""
    p = col(peak)
    return F.when(p.isNull(), "unknown").when(p <= warn, "ok").when(p <= critical, "warn").otherwise("critical")


def severity_rank(peak: Column | str, warn: int = WARN, critical: int = CRITICAL) -> Column:
    """3 critical, 2 warn, 1 ok, 0 unknown."""
    p = col(peak)
    return F.when(p.isNull(), 0).when(p <= warn, 1).when(p <= critical, 2).otherwise(3)


def bytes_short(n: Column | str, missing: str | None = "?") -> Column:
    """512B, 1.5KB; ties of the last digit go to even, null gives `missing`."""
    v = col(n)
    out = F.when(v < 1024, F.concat(v.cast("string"), F.lit("B"))).otherwise(F.format_string("%.1fKB", F.bround(v / 1024, 1)))
    return F.when(v.isNull(), F.lit(missing)).otherwise(out)


def bytes_long(n: Column | str, missing: str = "—") -> Column:
    """512 B, 1.5 KB, 1.25 MB; ties of the last digit go up, null gives a dash."""
    v = col(n)
    out = F.when(v < 1024, F.concat(v.cast("string"), F.lit(" B"))).when(v < 1024 * 1024, F.format_string("%.1f KB", v / 1024)).otherwise(F.format_string("%.2f MB", v / (1024 * 1024)))
    return F.when(v.isNull(), F.lit(missing)).otherwise(out)


def search_rank(name: Column | str, query: str) -> Column:
    """0 equal, 1 prefix, 2 contained, null no match; case does not count."""
    n, q = F.lower(col(name)), query.lower()
    return F.when(n == q, 0).when(n.startswith(q), 1).when(n.contains(q), 2)


def matches_text(query: str, *cols: Column | str) -> Column:
    """Whether any column holds the query, case aside; the empty query matches all."""
    out = F.lit(not query)
    for c in cols:
        out = out | F.coalesce(F.lower(col(c)).contains(query.lower()), F.lit(False))
    return out


def highlight(text: Column | str, query: str, left: str = "[", right: str = "]") -> Column:
    """Text with the first occurrence of the query marked."""
    t = col(text)
    at = F.locate(query.lower(), F.lower(t))
    n = len(query)
    marked = F.concat(F.substring(t, F.lit(1), at - 1), F.lit(left), F.substring(t, at, F.lit(n)), F.lit(right), F.substring(t, at + n, F.length(t)))
    return F.when((at > 0) & F.lit(n > 0), marked).otherwise(t)


def glob_pattern(patterns: list[str]) -> str | None:
    """One regular expression for case-normalised globs in which * also crosses slashes."""
    if not patterns:
        return None
    return "|".join(f"(?:{fnmatch.translate(p.replace(chr(92), '/')).replace(chr(92) + 'Z', '$').replace(chr(92) + 'z', '$')})" for p in patterns)


def matches_globs(path: Column | str, patterns: list[str]) -> Column:
    rx = glob_pattern(patterns)
    return F.coalesce(normal_path(path).rlike(f"^(?:{rx})"), F.lit(False)) if rx else F.lit(False)


def csv_field(c: Column | str) -> Column:
    """Quoted only where a comma, quote or line end asks for it."""
    v = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.when(v.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def html_text(c: Column | str) -> Column:
    v = F.coalesce(col(c).cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def colour_slot(file: Column | str, slots: int = 16) -> Column:
    """abs of the 32-bit hash 31 * h + code unit, modulo the number of colours."""
    codes = F.transform(F.filter(F.split(col(file), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    wrap = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    signed = F.when(wrap >= 1 << 31, wrap - (1 << 32)).otherwise(wrap)
    return (F.abs(signed) % slots).cast("int")


def pill(frame: Column, peak: Column, bounded: Column, recursive: Column, is_root: Column, unbound: Column, via: Column) -> Column:
    """Inline summary of a function; parts that do not apply are left out."""
    return F.concat_ws(
        " · ",
        F.when(is_root, F.lit("root")),
        F.when(unbound, F.lit("unbound")),
        F.when(~is_root & via.isNotNull(), F.concat(F.lit("via "), via)),
        F.when(recursive, F.lit("recursive")),
        F.when(frame.isNotNull(), F.concat(F.lit("f:"), bytes_short(frame, None))),
        F.when(F.coalesce(peak, F.lit(0)) != 0, F.concat(F.lit("p:"), bytes_short(peak, None), F.when(bounded, F.lit("+")).otherwise(F.lit("")))),
    )


_VAR = re.compile(r"\$\{([^}]*)\}")


def expand_vars(value: str, workspace: str | None = None, folders: Mapping[str, str] | None = None, home: str | None = None, env: Mapping[str, str] | None = None, config: Mapping[str, str] | None = None) -> str:
    """${workspaceFolder[:N]}, ${userHome}, ${pathSeparator}, ${/}, ${env:N} (missing: empty),
    ${config:k}; folders and settings that are missing or null and anything else stay as they are.
    Driver side."""
    env = os.environ if env is None else env

    def one(m: re.Match) -> str:
        kind, _, arg = m.group(1).partition(":")
        if kind == "workspaceFolder":
            at = (folders or {}).get(arg) if arg else workspace
            return m.group(0) if at is None else at
        if m.group(1) == "userHome":
            return os.path.expanduser("~") if home is None else home
        if m.group(1) in ("pathSeparator", "/"):
            return os.sep
        if kind == "env":
            return env.get(arg, "")
        if kind == "config":
            got = (config or {}).get(arg)
            return m.group(0) if got is None else str(got)
        return m.group(0)

    return _VAR.sub(one, value)


def expand_vars_column(value: Column | str, known: Mapping[str, str]) -> Column:
    """The same for a column, with the values of known variables given; missing env gives ''."""
    v = col(value)
    for k, x in known.items():
        v = F.replace(v, F.lit("${" + k + "}"), F.lit(x))
    return F.regexp_replace(v, r"\$\{env:[^}]*\}", "")
