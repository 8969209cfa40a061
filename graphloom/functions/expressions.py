"""Column expressions for code text: languages, globs, names, imports, durations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension.
EXTENSIONS = {
    "typescript": ("ts",), "tsx": ("tsx",), "javascript": ("js", "jsx", "mjs", "cjs"), "python": ("py",), "rust": ("rs",), "go": ("go",),
    "c": ("c", "h"), "cpp": ("cpp", "hpp", "cc", "hh", "cxx", "hxx"), "java": ("java",),
}
# Names that count as built in, whatever the language.
BUILTINS = (
    "print", "println", "len", "panic",
    "range", "int", "str", "float", "list", "dict", "set", "tuple", "bool", "type", "isinstance", "getattr", "setattr", "hasattr",
    "eprintln", "format", "vec", "assert", "assert_eq", "assert_ne", "dbg", "todo", "unimplemented", "unreachable",
    "console", "log", "error", "warn", "parseInt", "parseFloat", "isNaN", "setTimeout", "setInterval", "clearTimeout", "clearInterval",
    "JSON", "Promise", "Array", "Object", "String", "Number", "Boolean", "Math", "Date", "RegExp", "Map", "Set", "WeakMap", "WeakSet", "Symbol",
    "cap", "make", "new", "append", "copy", "delete", "recover", "fmt", "strings", "strconv", "os", "io", "sort", "sync", "context",
)


def language_of(path: Column) -> Column:
    """Language by the lower-cased extension of the last path part; null if unknown. A name that only starts with a dot has no extension."""
    extension = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    return F.create_map(*[F.lit(x) for name, all_ in EXTENSIONS.items() for e in all_ for x in (e, name)])[extension]


def line_count(text: Column) -> Column:
    """Number of line feeds."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def contains_like(column: Column, part: str) -> Column:
    """Case-insensitive LIKE %part%; % and _ in part are wildcards, a backslash is itself."""
    return F.lower(column).like(f"%{part.lower()}%".replace("\\", "\\\\"))


def glob_regex(glob: str) -> str:
    """Anchored pattern of a glob: "**" with a slash after it, if any, is any run; "*" a run without "/"; "?" any character."""
    shapes = {"**/": ".*", "**": ".*", "*": "[^/]*", "?": "."}
    return "(?s)^" + "".join(shapes.get(x) or re.escape(x) for x in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob)) + "$"


def matches_glob(path: Column, glob: str) -> Column:
    return path.rlike(glob_regex(glob))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def search_tokens(text: Column) -> Column:
    """Case-folded runs of letters and digits, without diacritics that combine."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{M}+", "")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _quoted(text: Column) -> Column:
    double, single = r'"([^"]*)"', r"'([^']*)'"
    return F.when(text.rlike(double), F.regexp_extract(text, double, 1)).when(text.rlike(single), F.regexp_extract(text, single, 1)).otherwise(strip(text))


def parse_import(text: Column) -> Column:
    """(kind, module, names) of the text of an import statement, in any of the languages."""
    none = F.array().cast("array<string>")
    t = strip(text)
    parsed = lambda kind, module, names=none: F.struct(F.lit(kind).alias("kind"), module.alias("module"), names.alias("names"))
    used = strip(F.regexp_replace(F.substring(t, 5, 1 << 30), ";+$", ""))
    py = r"(?s)^from (.*?) import (.*)$"
    py_module, py_names = strip(F.regexp_extract(t, py, 1)), F.regexp_extract(t, py, 2)
    listed = F.filter(F.transform(F.split(py_names, ","), strip), lambda n: (n != "") & (n != "*"))
    rest = F.substring(t, 8, 1 << 30)
    source = _quoted(F.regexp_extract(t, "(?s)^.*? from (.*)$", 1))
    braces = F.regexp_extract(t, r"(?s)\{([^}]*)\}", 1)
    braced = F.filter(F.transform(F.split(braces, ","), lambda n: F.regexp_extract(n, r"\S+", 0)), lambda n: n != "")
    default = strip(F.regexp_extract(t, "(?s)^import (.*?) from ", 1))
    whole = strip(F.regexp_replace(rest, ";+$", ""))
    return (
        F.when(t.startswith("use ") & used.endswith("::*"), parsed("Wildcard", F.regexp_replace(used, r"(::\*)+$", "")))
        .when(t.startswith("use "), parsed("Use", used, F.array(F.element_at(F.split(used, "::"), -1))))
        .when(t.rlike(py) & (strip(py_names) == "*"), parsed("Wildcard", py_module))
        .when(t.rlike(py), parsed("Named", py_module, listed))
        .when(t.rlike("""(?s)^import ["'].*"[^"]*"|^import "[^"]*\""""), parsed("Named", F.regexp_extract(rest, '"([^"]*)"', 1)))
        .when(t.rlike("(?s)^import .*") & t.contains(" from ") & t.rlike(r"(?s)\{[^}]*\}"), parsed("Named", source, braced))
        .when(t.rlike("(?s)^import .*") & t.contains(" from ") & t.contains("* as"), parsed("Wildcard", source))
        .when(t.rlike("(?s)^import .*") & t.contains(" from ") & (default != ""), parsed("Default", source, F.array(default)))
        .when(t.rlike("(?s)^import .*") & t.contains(" from "), parsed("Named", source))
        .when(t.startswith("import "), parsed("Named", whole, F.array(whole)))
        .otherwise(parsed("Named", t))
    )


def two_decimals(value: Column) -> Column:
    """A number as text with two decimals, rounded by its exact binary value, as printf does; format_string() rounds the shortest decimal text that stands for it."""
    whole = F.floor(value)
    # Both factors fit: a fraction of a number of 1/16 or more is a multiple of 2**-56, and none below is half-way between two hundredths.
    bits = ((value - whole) * float(1 << 56)).cast("long") * 100
    cents, rest = F.shiftright(bits, 56), bits % F.lit(1 << 56)
    up = (rest > F.lit(1 << 55)) | ((rest == F.lit(1 << 55)) & (cents % 2 == 1))
    cents = cents + up.cast("int")
    text = F.concat((whole + F.floor(cents / 100)).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when((value >= 0) & (value < 1e15), text).otherwise(F.format_string("%.2f", value))


def format_ns(ns: Column) -> Column:
    """A duration in nanoseconds with two decimals in the largest unit that it fills."""
    shown = lambda unit, name: F.concat(two_decimals(ns / unit), F.lit(name))
    return F.when(ns >= 1e9, shown(1e9, "s")).when(ns >= 1e6, shown(1e6, "ms")).when(ns >= 1e3, shown(1e3, "µs")).otherwise(shown(1.0, "ns"))
