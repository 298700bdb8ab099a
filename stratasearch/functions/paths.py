"""Path expressions: segments, names, stems, suffixes, and the ranking's path penalties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Path patterns and factors of the ranking.
TEST_FILE = (
    r"(?:^|/)(?:"
    r"test_[^/]*\.py|[^/]*_test\.py|[^/]*_test\.go|[^/]*Tests?\.java|[^/]*Test\.php|[^/]*_spec\.rb|[^/]*_test\.rb|"
    r"[^/]*\.test\.[jt]sx?|[^/]*\.spec\.[jt]sx?|[^/]*Tests?\.kt|[^/]*Spec\.kt|[^/]*Tests?\.swift|[^/]*Spec\.swift|[^/]*Tests?\.cs|"
    r"test_[^/]*\.cpp|[^/]*_test\.cpp|test_[^/]*\.c|[^/]*_test\.c|[^/]*Spec\.scala|[^/]*Suite\.scala|[^/]*Test\.scala|"
    r"[^/]*_test\.dart|test_[^/]*\.dart|[^/]*_spec\.lua|[^/]*_test\.lua|test_[^/]*\.lua|test_helpers?[^/]*\.\w+"
    r")$"
)
TEST_DIRECTORY = r"(?:^|/)(?:tests?|__tests__|spec|testing)(?:/|$)"
COMPAT_DIRECTORY = r"(?:^|/)(?:compat|_compat|legacy)(?:/|$)"
EXAMPLES_DIRECTORY = r"(?:^|/)(?:_?examples?|docs?_src)(?:/|$)"
TYPE_STUB = r"\.d\.ts$"
REEXPORT_NAMES = ("__init__.py", "package-info.java")
STRONG, MODERATE, MILD = 0.3, 0.5, 0.7


def segments(path: Column | str) -> Column:
    """Path segments, without empty ones and ``.``."""
    return F.filter(F.split(col(path), "/"), lambda s: (s != "") & (s != "."))


def name_of(path: Column | str) -> Column:
    """The last segment, empty where there is none."""
    return F.coalesce(F.try_element_at(segments(path), F.lit(-1)), F.lit(""))


def suffix_of(path: Column | str) -> Column:
    """The part from the last dot of the name on; dots at its start don't count."""
    return F.regexp_extract(name_of(path), r"^\.*[^.].*?(\.[^.]+)$", 1)


def stem_of(path: Column | str) -> Column:
    """The name without its suffix."""
    name = name_of(path)
    return F.substr(name, F.lit(1), F.length(name) - F.length(suffix_of(path)))


def parent_name(path: Column | str) -> Column:
    """The directory that holds the file, empty at the root and for ``..``."""
    parent = F.coalesce(F.try_element_at(segments(path), F.lit(-2)), F.lit(""))
    return F.when(parent == "..", "").otherwise(parent)


def last_directories(path: Column | str, n: int = 3) -> Column:
    """The last directories above the file, joined by spaces."""
    parts = segments(path)
    above = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.array_join(F.slice(above, F.greatest(F.size(above) - (n - 1), F.lit(1)), F.lit(n)), " ")


def location(path: Column | str, start: Column | str, end: Column | str) -> Column:
    """``path:start-end``."""
    return F.format_string("%s:%d-%d", col(path), col(start), col(end))


def path_penalty(path: Column | str) -> Column:
    """Product of the factors that apply to a path."""
    path = col(path)
    plain = F.replace(path, F.lit("\\"), F.lit("/"))

    def factor(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(1.0))

    return (
        factor(F.rlike(plain, F.lit(TEST_FILE)) | F.rlike(plain, F.lit(TEST_DIRECTORY)), STRONG)
        * factor(name_of(path).isin(*REEXPORT_NAMES), MODERATE)
        * factor(F.rlike(plain, F.lit(COMPAT_DIRECTORY)), STRONG)
        * factor(F.rlike(plain, F.lit(EXAMPLES_DIRECTORY)), STRONG)
        * factor(F.rlike(plain, F.lit(TYPE_STUB)), MILD)
    )


def same_file(path: Column, target: Column) -> Column:
    """Whether two paths are equal or one is a suffix of the other at a segment."""
    a, b = F.replace(path, F.lit("\\"), F.lit("/")), F.replace(target, F.lit("\\"), F.lit("/"))
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))
