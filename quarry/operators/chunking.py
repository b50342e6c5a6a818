"""Source files cut into chunks, by language.

Python goes through its parser (Arrow batches in `mapInPandas`, for no built-in parses Python);
everything else is split by a pattern in the JVM, with line numbers from a running sum.
"""

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import line_count, split_words, strip, suffix  # noqa: F401

# Where a file is split, by family of languages, and how a part is named.
SCRIPT_SPLIT = r"(?U)\n(?=(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)\s)"
C_SPLIT = r"(?U)\n(?=(?:public|private|protected|static|virtual|async)?\s*(?:class|struct|enum|interface|func|fn)\s|\w+[\s*&]+\w+\s*\()"
OTHER_SPLIT = r"\n(?=def |class |function |const |export |module\.exports)"
NAMED = (r"(?U)(?:def|function|class|struct|enum|interface)\s+(\w+)", r"(?U)(?:const|let|var)\s+(\w+)")
SCRIPT_ENDINGS, C_ENDINGS = (".js", ".ts", ".jsx", ".tsx"), (".java", ".cpp", ".c", ".h", ".go", ".rs")

#: Shorter parts, after stripping, are left out; so are shorter Python nodes.
PART_CHARS, NODE_CHARS = 50, 30

SCHEMA = "content string, type string, name string, start_line int, end_line int"


def first_line(text: str | Column) -> Column:
    return strip(F.substring_index(text, "\n", 1))


def infer_name(text: str | Column) -> Column:
    """What a part defines, by its first line; else the line's first 40 characters."""
    line = first_line(text)
    named = [F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in NAMED]
    return F.coalesce(*named, F.left(line, F.lit(40)))


def split_parts(files: DataFrame, key: list[str], pattern: str) -> DataFrame:
    """Parts of `content` with running lines: key, `content` (stripped), `type`, `name`, `start_line`, `end_line`.

    Parts of 50 characters or fewer are dropped after they have counted for the lines. A file
    without a part left, but longer than that, is one chunk of type `file`.
    """
    parts = files.select(*key, "file_name", F.posexplode(F.split("content", pattern, -1)).alias("pos", "part"))
    before = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = 1 + F.coalesce(F.sum(line_count("part")).over(before), F.lit(0))
    placed = parts.withColumn("start_line", start.cast("int")).withColumn("stripped", strip("part"))
    kept = placed.where(F.length("stripped") > PART_CHARS).select(
        *key, "file_name", F.col("stripped").alias("content"), F.lit("chunk").alias("type"), infer_name("stripped").alias("name"),
        "start_line", (F.col("start_line") + line_count("part") - 1).cast("int").alias("end_line"),
    )
    whole = files.where(F.length(strip("content")) > PART_CHARS).join(kept.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(whole_files(whole, key))


def whole_files(files: DataFrame, key: list[str]) -> DataFrame:
    """Each file as one chunk of type `file`."""
    return files.select(
        *key, "file_name", "content", F.lit("file").alias("type"), F.col("file_name").alias("name"), F.lit(1).alias("start_line"), line_count("content").cast("int").alias("end_line")
    )


def _spans(tree: ast.Module) -> list[tuple[int, int, str, str, bool]]:
    """(first line, last line, name, kind, at top level) of functions, classes and their methods, decorators included."""
    found = []
    for owner in [tree, *(n for n in tree.body if isinstance(n, ast.ClassDef))]:
        top = owner is tree
        for n in owner.body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) or top and isinstance(n, ast.ClassDef):
                name = n.name if top else f"{owner.name}.{n.name}"
                found.append((min(x.lineno for x in (n, *n.decorator_list)), n.end_lineno, name, type(n).__name__, top))
    return found


def _outside(spans: list[tuple[int, int]], last: int) -> Iterator[tuple[int, int]]:
    """The stretches of lines 1..last that no span holds."""
    after = 1
    for a, b in sorted(spans):
        if after < a:
            yield after, a - 1
        after = max(after, b + 1)
    if after <= last:
        yield after, last


def python_chunks(content: str, file_name: str) -> list[tuple[str, str, str, int, int]] | None:
    """(content, type, name, first line, last line) of a Python file's definitions; None when it does not parse.

    Top-level functions and classes, and besides each class its methods; then the lines outside
    all of these, without blank and comment lines, as the module.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            spans = _spans(ast.parse(content))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = content.split("\n")
    whole = (file_name, 1, len(lines))
    cut = [("\n".join(lines[a - 1 : b]), kind, name, a, b, top) for a, b, name, kind, top in spans]
    cut = [c for c in cut if len(c[0].strip()) >= NODE_CHARS]
    rest = [x for a, b in _outside([c[3:5] for c in cut if c[5]], len(lines)) for x in lines[a - 1 : b]]
    module = "\n".join(x for x in rest if x.strip() and not x.strip().startswith("#"))
    out = [c[:5] for c in cut] + ([(module, "module", *whole)] if len(module) > NODE_CHARS else [])
    return out or ([(content, "file", *whole)] if len(content.strip()) > NODE_CHARS else [])


def python_files(files: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Chunks of the Python files that parse, and the files that do not (for the pattern split)."""
    from pyspark.sql.types import BooleanType, StructField, StructType, _parse_datatype_string

    keys = [f for f in files.schema.fields if f.name in key]
    schema = StructType([*keys, StructField("file_name", files.schema["file_name"].dataType), *_parse_datatype_string(SCHEMA).fields, StructField("parsed", BooleanType())])
    names = schema.names

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch[[f.name for f in keys] + ["file_name", "content"]].itertuples(index=False, name=None):
                *ids, file_name, content = row
                chunks = python_chunks(content, file_name)
                if chunks is None:
                    out.append((*ids, file_name, content, None, None, None, None, False))
                else:
                    out += [(*ids, file_name, *c, True) for c in chunks]
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"start_line": "Int32", "end_line": "Int32"})

    done = files.select(*[f.name for f in keys], "file_name", "content").mapInPandas(cut, schema)
    return done.where("parsed").drop("parsed"), done.where("not parsed").select(*key, "file_name", "content")


def chunk_files(files: DataFrame, key: list[str] | None = None) -> DataFrame:
    """All files cut by their language: key, `file_name`, `content`, `type`, `name`, `start_line`, `end_line`.

    `files(key..., file_name, content)`; the ending decides, whatever its case. Null contents give no chunk.
    """
    key = key or ["project_id", "path"]
    rows = files.where("content is not null").withColumn("_ending", F.lower(suffix("file_name")))
    python, script, c_like = F.col("_ending") == ".py", F.col("_ending").isin(*SCRIPT_ENDINGS), F.col("_ending").isin(*C_ENDINGS)
    parsed, broken = python_files(rows.where(python), key)
    columns = [*key, "file_name", "content"]
    other = rows.where(~python & ~script & ~c_like).select(*columns).unionByName(broken.select(*columns))
    out = parsed
    for part, pattern in ((rows.where(script), SCRIPT_SPLIT), (rows.where(c_like), C_SPLIT), (other, OTHER_SPLIT)):
        out = out.unionByName(split_parts(part.select(*columns), key, pattern))
    return out
