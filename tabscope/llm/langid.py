"""Language identification: known words first, character n-grams for the rest.

A known word is scored by its log frequency in each language. An unseen word falls back
to character n-grams: at each place the longest known n-gram that starts there counts,
from n = 4 down to 1, and the word scores the mean of its places. The scores of all words of a text
add up; the language with the greatest sum wins, and the score is its share after a
soft maximum over the sums divided by the square root of the number of words.

The model is learned from labelled texts: word counts by language from a hash sample of
a documented size, the most frequent entries of them, and n-gram counts from those words.
Its size is bounded by those parameters, whatever the corpus.

Defined cases: null texts and texts without a letter are "und" with score 0; so is
everything where no text was labelled; words without a letter count for nothing;
equal sums go to the language that sorts first; repeated rows get equal answers; an
empty table gives no rows; further columns are passed through.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tabscope.llm.common import map_columns, saved, text_of

#: Labelled texts of the fit at most (on average over the hash), and entries of the model.
SAMPLE_TEXTS, ENTRIES = 20_000, 100_000
LONGEST = 4
SMOOTHING = 0.5
UNKNOWN = "und"
MARKS = ".,;:!?\"'()[]{}<>*_-|#%&$+=/\\0123456789"
#: Words that a worker remembers, and scores of them: with many languages fewer words.
REMEMBERED, REMEMBERED_SCORES = 131_072, 1_048_576


class Scores:
    """Log frequencies by language, one row of a matrix for each word or n-gram.

    It travels as one string and one matrix; a worker makes the row numbers of the keys.
    """

    def __init__(self, keys: list[str], matrix: np.ndarray):
        self.matrix = matrix
        self.rows = {k: i for i, k in enumerate(keys)}

    def __reduce__(self):
        return _scores, ("\n".join(self.rows), self.matrix)  # words of letters and marks have no line break


def _scores(keys: str, matrix: np.ndarray) -> Scores:
    return Scores(keys.split("\n") if len(matrix) else [], matrix)


@dataclass
class Model:
    languages: list[str]
    words: Scores
    grams: Scores

    def unseen(self, word: str) -> np.ndarray:
        """Mean over the places of a word of its longest known n-gram's log frequencies."""
        marked, rows, found = f"^{word}$", self.grams.rows, []
        for at in range(len(marked) - 1):
            for n in range(LONGEST, 0, -1):
                row = rows.get(marked[at : at + n])
                if row is not None:
                    found.append(row)
                    break
        return self.grams.matrix[found].sum(axis=0) / len(found) if found else np.zeros(len(self.languages))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", texts: int = SAMPLE_TEXTS, entries: int = ENTRIES) -> Model:
    """The model from rows of ``docs`` with a language. The caller leaves out what is held out."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = labelled.count()
    share = min(1.0, texts / n) if n else 1.0
    part = F.pmod(F.xxhash64(F.lit("fit"), F.col(text)), F.lit(1_000_000)) < int(share * 1_000_000)
    word = F.explode(F.split(F.lower(text_of(text)), r"[^\p{L}\p{M}]+"))
    counted = labelled.where(part).select(F.col(lang).alias("lang"), word.alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    rows = _most_frequent(saved(counted, "words"), entries)
    languages = sorted({r["lang"] for r in rows})
    at = {x: i for i, x in enumerate(languages)}
    words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    for r in rows:
        words[r["word"]][at[r["lang"]]] += r["n"]
        marked = f"^{r['word']}$"
        weight = math.sqrt(r["n"])  # a frequent word must not fill the n-grams
        for i in range(len(marked)):
            for k in range(1, LONGEST + 1):
                if i + k <= len(marked):
                    grams[marked[i : i + k]][at[r["lang"]]] += weight
    return Model(languages, _logs(words, len(languages)), _logs(grams, len(languages)))


def _most_frequent(counted: DataFrame, entries: int) -> list:
    """The entries above the least frequency at which no more than ``entries`` are left.

    The frequency comes from the number of entries of each frequency; no task sorts or
    sends more than its part of the chosen entries. If the greatest frequency alone is
    shared by more, that many of them are taken in the order of words.
    """
    left, least = entries, None
    for r in counted.groupBy("n").agg(F.count("*").alias("many")).orderBy(F.desc("n")).collect():
        if r["many"] > left:
            break
        left, least = left - r["many"], r["n"]
    if least is None:
        return counted.orderBy(F.desc("n"), "word", "lang").limit(entries).collect()
    return counted.where(F.col("n") >= least).collect()


def _logs(counts: dict[str, np.ndarray], languages: int) -> Scores:
    """Smoothed log frequencies; each language counts as large as the others."""
    if not counts:
        return Scores([], np.zeros((0, languages)))
    total = sum(counts.values())
    scale = total.sum() / len(total) / np.maximum(total, 1e-9)
    size = SMOOTHING * len(counts) + total.sum() / len(total)
    return Scores(list(counts), np.log((np.array(list(counts.values())) * scale + SMOOTHING) / size))


class Memory:
    """Scores of words seen, as rows of one matrix; row 0 is for words without a letter."""

    def __init__(self, model: Model):
        self.model, self.rows = model, {}
        self.most = min(REMEMBERED, REMEMBERED_SCORES // max(1, len(model.languages)))
        self.scores = np.zeros((1024, len(model.languages)))

    def place(self, raw: str) -> int:
        bare = raw.strip(MARKS)
        row = self.model.words.rows.get(bare)
        if row is None and not any(map(str.isalpha, bare)):
            at = 0
        else:
            at = len(self.rows) + 1
            if at >= len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[at] = self.model.unseen(bare) if row is None else self.model.words.matrix[row]
        self.rows[raw] = at
        return at

    def places(self, words) -> np.ndarray:
        rows = self.rows
        if len(rows) > self.most:
            rows.clear()
        return np.array([rows[w] if w in rows else self.place(w) for w in words], np.int64)


def identify(text: str, model: Model, memory: Memory | None = None) -> tuple[str, float]:
    """(language, score). ``memory`` keeps the scores of words between texts."""
    memory = memory or Memory(model)
    counts = Counter(text.lower().split())
    at = memory.places(counts)
    many = np.fromiter(counts.values(), np.float64, len(counts)) * (at > 0)
    n = many.sum()
    if not n or not model.languages:
        return UNKNOWN, 0.0
    total = many @ memory.scores[at]
    best = int(total.argmax())
    shares = np.exp((total - total[best]) / math.sqrt(n))
    return model.languages[best], float(1 / shares.sum())


_MEMORY: list = []


def memory_of(shared: Broadcast) -> Memory:
    """One memory for each worker process and model; it stays warm between tasks.

    What was remembered for another model goes before the new one is loaded.
    """
    if not _MEMORY or _MEMORY[0] is not shared:
        _MEMORY.clear()
        _MEMORY[:] = [shared, Memory(shared.value)]
    return _MEMORY[1]


def identify_languages(docs: DataFrame, model: Model, text: str = "text", carried: list[str] | None = None) -> DataFrame:
    """(``_doc``, lang_pred, score); ``_doc`` holds the ``carried`` columns of ``docs``, by default all."""
    names = docs.columns if carried is None else carried
    wide = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(f"`{text}`").cast("string").alias("_text")
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the entries of the fit

    def run(batch, state) -> dict:
        found = [identify(t.as_py() or "", state.model, state) for t in batch.column(1)]
        return {"_doc": batch.column(0), "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

    schema = StructType([wide.schema["_doc"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return map_columns(wide, run, schema, lambda: memory_of(shared))
