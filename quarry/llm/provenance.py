"""Problem 5: files nobody wrote by hand: generated, minified, vendored, or data saved as code.

Merkle hashes are computed bottom-up over each repository's directory tree: a file hashes its
text, a directory the multiset of its children's hashes (names left out, for copies are renamed;
a directory with one child hashes as that child). Two kinds of nodes are vendored, and with them
every file below each of their copies: a node of which some copy lies under a vendor folder, has a
versioned name or carries a library's banner; and a directory of three files or more that
unrelated repositories share. Header and layout rules find the rest. A copied single file without such
evidence is judged like its original.
"""

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.syntax import LANGUAGES, defect
from quarry.plans.scratch import written

ENDINGS = (".py", ".js", ".ts", ".java", ".go", ".css")
#: Texts shorter than this are alike by chance and prove no common origin.
SHARED_CHARS = 64
#: Files of a directory that make it a library when unrelated repositories share it; fewer are copied files, which are judged like their originals.
SHARED_FILES = 3
#: Minimum hashes of a repository's texts; of two related ones (forks, mirrors: most texts in common) at least so many agree.
SKETCH, RELATED = 16, 9

# Folders under which each subfolder is a library, and the wordings of generators and banners.
VENDOR_FOLDERS = ("vendor", "_vendor", "third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "external", "extern", "deps", "site-packages", "Godeps")
_VENDORED_PATH = rf"(?:^|/)(?:{'|'.join(VENDOR_FOLDERS)})/[^/]+/"
_VERSIONED_NAME = r"(?:^|/)[A-Za-z][A-Za-z0-9_]*-v?\d+\.\d+(?:\.\d+)+\.[a-z]+$"
_MARK = re.compile(
    r"(?im)^[ \t]*(?:#|//|/\*+!?|\*|--|<!--)[ \t]*(?:code generated by .*do not edit|@generated\b|<auto-generated|auto-?generated (?:file|with|by|from|code)|"
    r"(?:this (?:file|code) (?:was|is|has been) )?(?:automatically|auto|machine)[- ]?(?:generated|produced|made|created|written)\b|do not (?:modify|edit)(?: by hand)?[ :;,.!-]+.*(?:output|generat|produced|built)|"
    r"generated (?:by|from|with|using)\b|(?:this (?:file|code) (?:was|is) )?generated\b.*(?:do not|changes)|.*changes (?:will|may) be (?:lost|overwritten)|.*\bregenerate (?:using|with|by)\b)"
)
_RIGHTS = re.compile(r"(?i)licen[cs]e|copyright|\(c\)|redistribut|upstream|imported from|vendored from|contributors|all rights reserved|copied from")
_VERSION = re.compile(r"(?i)\b[a-z][\w.-]*(?:\s+-\s+version|\s+version|,)?\s+v?\d+\.\d+(?:\.\d+)+|@version\s+\d")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|-?\b(?:0x[\da-fA-F]+|\d[\w.]*)")
_NAME = re.compile(r"[^\W\d]\w*")
_LOGIC = re.compile(r"\b(?:if|for|while|return|def|function|func|switch|try|lambda|new)\b|=>")
_TOP_COMMENT = re.compile(r"\s*/\*[\s\S]*?\*/")
_COMMENT_LINE = re.compile(r"(?:#|//|/?\*|\"\"\"|'''|--)")


def _header(text: str) -> str:
    """The comments and blank lines at the top, up to the first line of code."""
    out, inside = [], False
    for line in text.lstrip("\ufeff").split("\n"):
        s = line.strip()
        if s and not inside and not _COMMENT_LINE.match(s):
            break
        out.append(line)
        inside = "*/" not in s if inside else s.startswith("/*") and "*/" not in s[2:]
    return "\n".join(out)


def layout(text: str, file_name: str) -> str | None:
    """What header and layout say: 'minified', 'data', 'generated', or 'banner' (a library's notice), or nothing."""
    body = text.lstrip("﻿")
    lines = [s for s in (x.strip() for x in body.split("\n")) if s]
    if not lines:
        return None
    size = sum(map(len, lines))
    literal = sum(len(m) for m in _LITERAL.findall(body))
    top = _TOP_COMMENT.match(body)  # code may follow a notice on the same line
    code = [x for x in (y.strip() for y in body[top.end() :].split("\n")) if x and not _COMMENT_LINE.match(x)] if top else [x for x in lines if not _COMMENT_LINE.match(x)]
    rest = _NAME.sub("", _LITERAL.sub("", body)) if literal > 0.3 * size else body
    bare = _LITERAL.sub(" ", body) if literal > 0.3 * size else body
    logic = len(_LOGIC.findall(bare))
    name = file_name.lower()
    spaces = body.count(" ") + body.count("\t")
    if code and name.endswith((".js", ".ts", ".css")) and literal < 0.6 * size:
        dense = sum(map(len, code)) / len(code)
        if dense >= 100 and spaces < 0.13 * size or dense >= 80 and spaces < 0.03 * size:
            return "minified"
    shapes = Counter(_NAME.sub("i", _LITERAL.sub("0", x)) for x in code) if len(code) >= 3 else Counter()
    common = sum(n for _, n in shapes.most_common(2)) / len(code) if code else 0.0
    marks = len(re.findall(r"[^\s\[\](){},:;=+]", rest)) if literal > 0.3 * size else size
    if logic == 0 and not name.endswith(".css") and literal >= 0.45 * size and marks < 0.2 * size and size >= 100:
        return "data"
    if logic <= 2 and not name.endswith(".css") and literal >= 0.8 * size and size >= 200:
        return "data"
    if _MARK.search(_header(text)) or _MARK.search("\n".join(lines[-3:])):
        return "generated"
    if common >= 0.75 and len(code) >= 5 and not name.endswith(".css") and literal < 0.4 * size:
        return "generated"
    head = _header(text)
    if _RIGHTS.search(head) and _VERSION.search(head):
        return "banner"
    return None


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for content, name in zip(batch.content, batch.file_name):
            text = content.replace("\r\n", "\n").replace("\r", "\n")
            ending = "." + name.lower().rpartition(".")[2]
            broken = defect(content, LANGUAGES[ending]) if ending in LANGUAGES else None
            out.append((layout(text, name), broken is None))
        yield pd.concat([batch[["doc_id", "project_id", "path", "chars", "node"]], pd.DataFrame(out, columns=["layout", "valid"], index=batch.index)], axis=1)


def _mixed(children: DataFrame) -> DataFrame:
    """Parents of (project_id, path, hash) rows with the hash of their children's multiset."""
    h = F.xxhash64("hash", F.lit("child"))
    sums = children.groupBy("project_id", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("parent")).agg(
        F.count("*").alias("n"), F.min("hash").alias("only"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"),
        F.sum("files").alias("files"), F.min("least").alias("least"), F.max("most").alias("most"), F.max("long").alias("long"),
    )
    own = F.when(F.col("n") == 1, F.col("only")).otherwise(F.xxhash64("n", "low", "high"))
    return sums.select("project_id", F.col("parent").alias("path"), own.alias("hash"), "files", "least", "most", "long")


def _depth(path: str | Column) -> Column:
    return F.size(F.split(path, "/"))


def subtrees(leaves: DataFrame) -> DataFrame:
    """Merkle nodes of every directory, bottom-up: `project_id`, `path`, `hash`, `files`, `least` and `most` (its texts' hashes), `long` (whether a text is)."""
    deepest = leaves.agg(F.max(_depth("path")).alias("d")).first().d or 0
    level, out = leaves.where(F.lit(False)), None
    for d in range(deepest, 1, -1):
        level = written(_mixed(level.unionByName(leaves.where(_depth("path") == d))), "merkle")
        out = level if out is None else out.unionByName(level)
    return leaves.where(F.lit(False)) if out is None else out


def _shared(dirs: DataFrame, leaves: DataFrame) -> DataFrame:
    """`hash` of the directories of SHARED_FILES files or more, not all alike nor all short, that unrelated repositories share."""
    held = dirs.where((F.col("path") != "") & (F.col("files") >= SHARED_FILES) & (F.col("least") < F.col("most")) & F.col("long")).select("hash", "project_id").distinct()
    several = held.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    sketch = leaves.groupBy("project_id").agg(F.array(*[F.min(F.xxhash64("hash", F.lit(i))) for i in range(SKETCH)]).alias("sketch"))
    # One holder of each hash is compared with all others: no pairs of repositories are formed.
    held = held.join(several, "hash", "left_semi").join(sketch, "project_id")
    first = held.groupBy("hash").agg(F.min(F.struct("project_id", "sketch"))["sketch"].alias("first"))
    alike = F.aggregate(F.zip_with("sketch", "first", lambda a, b: (a == b).cast("int")), F.lit(0), lambda x, y: x + y)
    return held.join(first, "hash").where(alike < RELATED).select("hash").distinct()


def vendored(leaves: DataFrame) -> DataFrame:
    """`doc_id` of the files below a vendored node. `leaves(doc_id, project_id, path, hash, long, evidence)`."""
    own = leaves.select("project_id", "path", "hash", F.lit(1).cast("long").alias("files"), F.col("hash").alias("least"), F.col("hash").alias("most"), "long")
    dirs = subtrees(own)
    # A short file is alike by chance: alone it is nobody's copy, but it counts by its text inside a directory.
    evident = leaves.where("evidence and long").select("hash").union(dirs.where(F.col("long") & F.col("path").rlike(rf"(?:^|/)(?:{'|'.join(VENDOR_FOLDERS)})/[^/]+$")).select("hash"))
    marked = evident.union(_shared(dirs, own)).distinct()
    by_text = leaves.where("long").join(marked, "hash", "left_semi").select("doc_id")
    copied = dirs.where("long").join(marked, "hash", "left_semi").select("project_id", F.col("path").alias("folder"))
    parts = F.split("path", "/")
    above = leaves.select("doc_id", "project_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("folder"))
    by_folder = above.join(copied, ["project_id", "folder"], "left_semi").select("doc_id")
    return by_text.union(by_folder).union(leaves.where("evidence").select("doc_id")).distinct()


def not_handwritten(documents: DataFrame) -> DataFrame:
    """Files that nobody wrote by hand: `doc_id`, `project_id`, `path`, `kind`, `valid` (its syntax).

    One kind per file, the first of minified, data, generated, vendored. Rows without an id, a
    path, a file name or content, and other endings, are left out. Null projects form one repository.
    """
    files = documents.where("doc_id is not null and path is not null and file_name is not null and content is not null").where(
        F.lower("file_name").rlike(r"\.(?:" + "|".join(e[1:] for e in ENDINGS) + ")$")
    )
    text = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), r"^\x{feff}|[ \t]+(?=\n)", "")), r"\s+$", "")
    rows = files.select("doc_id", F.coalesce("project_id", F.lit("")).alias("project_id"), "path", "file_name", "content", F.length("content").alias("chars"), F.xxhash64(text).alias("node"))
    judged = written(rows.mapInPandas(_judged, "doc_id long, project_id string, path string, chars int, node long, layout string, valid boolean"), "judged")
    located = F.col("path").rlike(_VENDORED_PATH) | F.col("path").rlike(_VERSIONED_NAME)
    evidence = F.coalesce(located | (F.col("layout") == "banner"), F.lit(False))
    copies = vendored(judged.select("doc_id", "project_id", "path", F.col("node").alias("hash"), (F.col("chars") >= SHARED_CHARS).alias("long"), evidence.alias("evidence")))
    kind = F.when(F.col("layout") != "banner", F.col("layout")).when(F.col("copied"), F.lit("vendored"))
    out = judged.join(copies.withColumn("copied", F.lit(True)), "doc_id", "left").select("doc_id", "project_id", "path", kind.alias("kind"), "valid")
    return out.where("kind is not null")
