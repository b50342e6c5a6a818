"""Problem 7: items over a size limit cut at natural boundaries, by recursive bisection.

A text is cut at the strongest boundary near its middle, and each half again while it is longer
than the limit less the overlap. Only then does each piece take up to `overlap` characters from
the end of the one before. A line that fits the limit is never cut.
"""

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1600
OVERLAP = 160

_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?;。！？][\"')\]]*\s+|[,:{}]\s+")
_GAP = re.compile(r"\s+")


def _line_strength(text: str, at: int) -> int:
    """How good it is to cut after the newline that ends at `at`: by blank lines and by the indent that follows."""
    rest = text[at : at + 200]
    body = rest.lstrip("\n")
    indent = len(body) - len(body.lstrip(" \t"))
    blank = text[at - 2 : at - 1] in ("\n", "")
    closes = body[:1] in (")", "]", "}")
    return (6 if blank else 3) + (3 if indent == 0 else 2 if indent <= 2 else 1 if indent <= 4 else 0) - (3 if closes else 0)


def _cut(text: str, start: int, end: int, room: int, limit: int) -> int | None:
    """Where to cut text[start:end], or None when it may stay whole. Cuts inside a line only when the line is over the limit."""
    if end - start <= room:
        return None
    middle, reach = (start + end) / 2, (end - start) / 2
    # In the middle half, so that both sides shrink whatever the text; where a long line fills it, at the nearest line end before or after.
    quarter = (end - start) // 4
    lines = [m.end() for m in _LINE.finditer(text, start + quarter, min(end - quarter, end - 1))]
    lines = lines or [p + 1 for p in (text.rfind("\n", start, start + quarter), text.find("\n", end - quarter, end - 1)) if p >= 0]
    if lines:
        return max(lines, key=lambda p: (_line_strength(text, p) - 9 * abs(p - middle) / reach, -p))
    if end - start <= limit:
        return None
    if text[end - 1] == "\n" and end - start - 1 <= limit:
        return end - 1
    low, high = int(middle - reach / 2), int(middle + reach / 2)
    for rule in (_SENTENCE, _GAP):
        at = [m.end() for m in rule.finditer(text, low, high)]
        if at:
            return min(at, key=lambda p: (abs(p - middle), p))
    return int(middle)


def cores(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The pieces without overlap, as offsets that follow each other and cover the text."""
    out, todo = [], [(0, len(text))]
    while todo:
        start, end = todo.pop()
        at = _cut(text, start, end, limit - overlap, limit)
        if at is None:
            out.append((start, end))
        else:
            todo += [(at, end), (start, at)]
    return out


def _overlap_start(text: str, before: int, start: int, end: int, limit: int, overlap: int) -> int:
    """From where the piece start..end repeats the one before, which began at `before`: a line's or word's start where there is one."""
    room = min(overlap, limit - (end - start), start - before)
    if room <= 0:
        return start
    low = start - room
    if low == 0 or text[low - 1] == "\n":
        return low
    at = text.find("\n", low, start - 1)
    if at >= 0:
        return at + 1
    gap = _GAP.search(text, low, start)
    return gap.end() if gap and gap.end() < start else low


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """The pieces of a text: (from with overlap, from without, to)."""
    out, before = [], 0
    for start, end in cores(text, limit, overlap):
        out.append((_overlap_start(text, before, start, end, limit, overlap) if out else start, start, end))
        before = start
    return out


_KEPT = ("project_id", "path", "file_name", "type", "name")
_PIECES = "chunk_id long, piece int, pieces int, content string, start_line int, end_line int, overlap int, inside boolean, " + ", ".join(f"{c} string" for c in _KEPT)


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Only the chunks over the limit, as pieces of at most `limit` code points.

    `piece` counts from 0, `overlap` characters at its start repeat the piece before, `inside`
    says that its end cuts a line. Lines are the chunk's first line plus the line ends before;
    they stay null where the chunk's is null. Chunks without an id are left out. Without overlaps the pieces of a chunk make its content.
    """
    columns = ["chunk_id", "content", "start_line", *_KEPT]
    long = chunks.where(F.col("chunk_id").isNotNull() & (F.length("content") > limit)).select(*[c if c in chunks.columns else F.lit(None).cast("string").alias(c) for c in columns])
    names = [c.split()[0] for c in _PIECES.split(", ")]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for chunk, text, first, *kept in batch[columns].itertuples(index=False, name=None):
                ends = [m.start() for m in _LINE.finditer(text)]
                parts = pieces(text, limit, overlap)
                for k, (a, start, end) in enumerate(parts):
                    inside = end < len(text) and text[end - 1] != "\n" and text[end] != "\n"
                    lines = (None, None) if pd.isna(first) else (int(first) + bisect_right(ends, a - 1), int(first) + bisect_right(ends, max(a, end - 1) - 1))
                    out.append((chunk, k, len(parts), text[a:end], *lines, start - a, inside, *kept))
            frame = pd.DataFrame(out, columns=names)
            yield frame.astype({"start_line": "Int32", "end_line": "Int32"})

    return long.mapInPandas(split, _PIECES)


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All chunks: those within the limit unchanged as one piece, the others as their pieces. Null content stays one piece."""
    short = chunks.where(F.col("chunk_id").isNotNull() & (F.coalesce(F.length("content"), F.lit(0)) <= limit))
    columns = ["chunk_id", "piece", "pieces", "content", "start_line", "end_line", "overlap", *_KEPT]
    same = short.withColumns({"piece": F.lit(0), "pieces": F.lit(1), "overlap": F.lit(0)}).select(*columns)
    return same.unionByName(split_oversized(chunks, limit, overlap).select(*columns))


def cut_kinds(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Each chunk over the limit: `chunk_id`, `cut` ('lines', or 'inside' when a line had to be cut)."""
    found = split_oversized(chunks, limit).groupBy("chunk_id").agg(F.max("inside").alias("inside"))
    return found.select("chunk_id", F.when(F.col("inside"), "inside").otherwise("lines").alias("cut"))
