"""What source files import, by language: `imports(project_id, path, pos, module)`."""

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quarry.functions.text import suffix

# How imports look, and the Go packages known without a slash.
PYTHON_LINE = r"(?mdU)^\s*(?:from|import)\s+([\w.]+)"
SCRIPT_IMPORT = r"""(?dU)(?:import\s+.*?\s+from\s+|import\s*\(|require\s*\()\s*['"]([^'"]+)['"]"""
SCRIPT_EXPORT = r"""(?dU)export\s+.*?\s+from\s+['"]([^'"]+)['"]"""
GO_STRING = r'"([^"]+)"'
GO_PACKAGES = ("fmt", "os", "io", "net", "log", "sync", "math", "sort")
SCRIPT_ENDINGS = (".js", ".ts", ".jsx", ".tsx")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def script_imports(text: str) -> Column:
    """Imports and requires in order, then re-exports."""
    return F.concat(_all(F.col(text), SCRIPT_IMPORT), _all(F.col(text), SCRIPT_EXPORT))


def go_imports(text: str) -> Column:
    """Every quoted string with a slash, or that names one of the known packages."""
    return F.filter(_all(F.col(text), GO_STRING), lambda v: F.contains(v, F.lit("/")) | v.isin(*GO_PACKAGES))


def python_line_imports(text: str) -> Column:
    """The first module of each import line; for files that do not parse."""
    return _all(F.col(text), PYTHON_LINE)


def modules_of(source: str) -> list[str] | None:
    """Modules a Python source imports at any depth, breadth first, or None when it does not parse. `from . import x` names none."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out: list[str] = []
    for node in ast.walk(tree):
        match node:
            case ast.Import():
                out.extend(alias.name for alias in node.names)
            case ast.ImportFrom(module=str(name)) if name:
                out.append(name)
    return out


@F.pandas_udf(ArrayType(StringType()))
def _python_modules(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for content in parts:
        yield content.map(lambda c: None if c is None else modules_of(c))


def file_imports(files: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row per import: key, `pos` (from 0), `module`. Other languages and null contents import nothing."""
    key = key or ["project_id", "path"]
    ending = F.lower(suffix("file_name"))
    rows = files.where("content is not null").withColumn("_ending", ending)
    python = rows.where("_ending = '.py'").select(*key, "content", _python_modules("content").alias("parsed"))
    parts = [
        python.select(*key, F.coalesce("parsed", python_line_imports("content")).alias("modules")),
        rows.where(F.col("_ending").isin(*SCRIPT_ENDINGS)).select(*key, script_imports("content").alias("modules")),
        rows.where("_ending = '.go'").select(*key, go_imports("content").alias("modules")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(*key, F.posexplode("modules").alias("pos", "module"))
