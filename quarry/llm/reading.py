"""Problem 10: the reading level of each document.

Graded texts tell when a word is acquired: the grade by which a quarter of its use, as a share of
each grade's texts, is reached. Words that too few texts have are unknown and take no part. A
sentence's grade is calibrated on the graded texts from quantiles of its known words' grades and
its length; a document's grade is the mean of its sentences'. A document is basic or advanced if
nearly all its sentences are graded so: the calibrated quantile of its sentence grades decides.
"""

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.pairs import _COMMON
from quarry.plans.scratch import written

#: Graded rows the model is fitted on, at most about so many (chosen by a hash of doc_id).
LABEL_ROWS = 20_000
#: A word is known if at least this share of the texts has it, so known words are at most a text's mean number of different words / KNOWN_SHARE.
KNOWN_SHARE = 1e-4
GRADES = (1, 2, 3, 4, 5)
#: The part of a word's use that makes it acquired.
ACQUIRED = 0.25
#: Grades below which a sentence is basic, and from which it is advanced.
BASIC, ADVANCED = 2.25, 4.25
#: The share of sentences that makes a document of one sort, and the sentences it needs.
NEARLY_ALL = 0.78
SENTENCES = 8
QUANTILES = (0.5, 0.75, 0.9)

_FENCE = re.compile(r"```.*?(?:```|\Z)|<pre\b.*?</pre>|<code\b.*?</code>", re.S | re.I)
_MARKUP = re.compile(r"<[^<>\n]{1,200}>|`[^`\n]*`|https?://\S+|&[a-z]+;")
_BLOCK = re.compile(r"\n\s*\n|\n(?=\s*(?:[-*•+>]|\d+[.)]|#+|==+)\s)")
_LEAD = re.compile(r"^(?:(?:[-*•+>]|\d+[.)])\s+)+")
_END = re.compile(r"(?<=[.!?])[\"'”’)\]*_]*\s+")
_ENDED = re.compile(r"[.!?][\"'”’)\]*_]*$")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence, in lower case. Code, markup, headings and page furniture have none."""
    if not text:
        return []
    text = _MARKUP.sub(" ", _FENCE.sub("\n\n", text.replace("\r\n", "\n")))
    out = []
    for block in _BLOCK.split(text):
        block = _LEAD.sub("", " ".join(block.split()))
        for s in _END.split(block):
            if _ENDED.search(s) and s[:1] not in "#=|":
                ws = _WORD.findall(s.lower())
                if len(ws) >= 2:
                    out.append(ws)
    return out


def is_english(found: list[list[str]]) -> bool:
    """Whether most of the common words in the sentences are English ones."""
    counts = Counter(w for s in found for w in s)
    hits = {k: sum(counts[w] for w in common) for k, common in _COMMON.items()}
    return hits["en"] > 0 and hits["en"] >= max(v for k, v in hits.items() if k != "en")


def _quantile(ordered: list[float], q: float) -> float:
    x = q * (len(ordered) - 1)
    i = int(x)
    return ordered[i] if i + 1 == len(ordered) else ordered[i] + (ordered[i + 1] - ordered[i]) * (x - i)


class Model:
    """Grades of the known words, and the calibration."""

    def __init__(self, grades: dict[str, float], rows: list[tuple[list[float], float]] | None = None):
        self.grades = grades
        x = np.array([r[0] for r in rows or []], dtype=float).reshape(-1, 2 + len(QUANTILES))
        y = np.array([r[1] for r in rows or []], dtype=float)
        # Ridge towards the mean of the quantiles, so that a handful of graded texts cannot bend it.
        prior = np.array([0.0, *[0.9 / len(QUANTILES)] * len(QUANTILES), 0.1])
        ridge = np.diag([1e-3, *[5.0] * (1 + len(QUANTILES))])
        self.weights = (prior + np.linalg.solve(x.T @ x + ridge, x.T @ (y - x @ prior))).tolist()

    def features(self, s: list[str]) -> list[float] | None:
        """A sentence's, or None where fewer than two of its words are known."""
        known = self.grades
        grades = sorted([known[w] for w in s if w in known])
        return [1.0, *[_quantile(grades, q) for q in QUANTILES], math.log2(len(s))] if len(grades) >= 2 else None

    def described(self, found: list[list[str]]) -> list[float] | None:
        """A document's features: the mean of its sentences', for the calibration is linear."""
        rows = [x for x in map(self.features, found) if x]
        return np.mean(rows, axis=0).tolist() if rows else None

    def sentence_grades(self, found: list[list[str]]) -> list[float]:
        w = self.weights
        return [sum(a * b for a, b in zip(w, x)) for x in map(self.features, found) if x]

    def grade(self, found: list[list[str]]) -> float | None:
        grades = self.sentence_grades(found)
        return min(5.0, max(1.0, sum(grades) / len(grades))) if grades else None

    def level(self, text: str | None) -> tuple[float | None, str | None, int, float, float]:
        """(grade 1..5, level, sentences, share of basic ones, share of advanced ones)."""
        found = sentences(text)
        grades = self.sentence_grades(found) if found and is_english(found) else []
        if not grades:
            return None, None, len(found), 0.0, 0.0
        n, grade = len(found), min(5.0, max(1.0, sum(grades) / len(grades)))
        basic, advanced = sum(g < BASIC for g in grades) / n, sum(g >= ADVANCED for g in grades) / n
        level = "other"
        if n >= SENTENCES:
            level = "basic" if basic >= NEARLY_ALL else "advanced" if advanced >= NEARLY_ALL else "other"
        return grade, level, n, basic, advanced


def _word_grades(grade_of: Callable[[list[list[str]], float | None], int | None]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """How many texts of each grade hold each word, and under the empty word how many texts there are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[tuple[str, int]] = Counter()
        for batch in batches:
            for text, grade in zip(batch.text, batch.grade):
                found = sentences(text)
                g = grade_of(found, grade) if found and is_english(found) else None
                if g is not None:
                    counts.update((w, g) for w in {w for s in found for w in s})
                    counts["", g] += 1
            if len(counts) > 300_000:
                yield pd.DataFrame([(w, g, n) for (w, g), n in counts.items()], columns=["word", "grade", "n"])
                counts.clear()
        yield pd.DataFrame([(w, g, n) for (w, g), n in counts.items()], columns=["word", "grade", "n"])

    return count


def _collected(counts: DataFrame, least: int) -> tuple[dict[str, dict[int, int]], dict[int, int]]:
    """The counts of the known words, and the texts of each grade."""
    summed = written(counts.groupBy("word").pivot("grade", list(GRADES)).agg(F.sum("n")), "words")
    total = sum((F.coalesce(F.col(str(g)), F.lit(0)) for g in GRADES), F.lit(0))
    texts = summed.where("word = ''").first()
    if texts is None:
        return {}, {}
    texts = {g: texts[str(g)] or 0 for g in GRADES}
    rows = summed.where((F.col("word") != "") & (total >= max(least, KNOWN_SHARE * sum(texts.values())))).collect()
    return {r.word: {g: r[str(g)] or 0 for g in GRADES} for r in rows}, texts


def acquired(counts: dict[str, dict[int, int]], texts: dict[int, int]) -> dict[str, float]:
    """The grade by which a quarter of a word's use (its share of each grade's texts) is reached, interpolated.

    A grade with few texts says little: five more texts that hold no word are counted with each.
    """
    out = {}
    for w, by in counts.items():
        share = [by.get(g, 0) / (texts.get(g, 0) + 5) for g in GRADES]
        whole, below = sum(share), 0.0
        for g, x in zip(GRADES, share):
            if below + x >= ACQUIRED * whole:
                out[w] = g - 0.5 + (ACQUIRED * whole - below) / x
                break
            below += x
    return out


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """The model from graded English prose; without grades it knows no word.

    A few graded texts hold few of the words, so a second round takes every prose text with the
    grade the first model gives it and learns the words' grades anew from all of them.
    """
    graded = labels.where("grade is not null and doc_id is not null").select("doc_id", F.least(F.greatest("grade", F.lit(1)), F.lit(5)).cast("int").alias("grade"))
    n = graded.count()
    if not n:
        return Model({})
    graded = graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // LABEL_ROWS))) == 0)
    # The graded rows are few and bounded: they go to the documents, not the documents through a shuffle.
    texts = written(documents.where("text is not null").select("doc_id", "text").join(F.broadcast(graded), "doc_id"), "graded")
    counted = "word string, grade int, n long"
    first = Model(acquired(*_collected(texts.mapInPandas(_word_grades(lambda found, grade: int(grade)), counted), 2)))

    def calibrated(model: Model) -> Model:
        def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [(sentences(t), g) for t, g in zip(batch.text, batch.grade)]
                rows = [(model.described(f), float(g)) for f, g in found if f and is_english(f)]
                yield pd.DataFrame([r for r in rows if r[0]], columns=["x", "grade"])

        rows = texts.mapInPandas(described, "x array<double>, grade double").collect()
        return Model(model.grades, [(list(r.x), r.grade) for r in rows])

    first = calibrated(first)
    prose = documents.where("text is not null")
    prose = prose.where("path is null") if "path" in documents.columns else prose

    def given(found: list[list[str]], _: object) -> int | None:
        grade = first.grade(found)
        return None if grade is None else round(grade)

    all_texts = prose.select("text", F.lit(0).alias("grade"))
    return calibrated(Model(acquired(*_collected(all_texts.mapInPandas(_word_grades(given), counted), 3))))


def levels(documents: DataFrame, labels: DataFrame, prose_only: bool = True) -> DataFrame:
    """`doc_id`, `grade` (1..5, comparable over documents), `level`, `sentences`, `basic`, `advanced` (shares of sentences).

    Grade and level are null for texts without an English sentence of known words. Rows without an id are left
    out; with `prose_only` files (rows with a path) are, too. No documents, no rows.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))
    rows = documents.where("doc_id is not null")
    if prose_only and "path" in documents.columns:
        rows = rows.where("path is null")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = model.value
        for batch in batches:
            out = [(d, *known.level(t)) for d, t in zip(batch.doc_id, batch.text)]
            yield pd.DataFrame(out, columns=["doc_id", "grade", "level", "sentences", "basic", "advanced"])

    return rows.select("doc_id", "text").mapInPandas(judge, "doc_id long, grade double, level string, sentences int, basic double, advanced double")
