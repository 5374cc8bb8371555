"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Labelled texts are examples; a text is scored by the votes of its nearest examples,
weighed by their similarity, and those examples are its evidence. The terms are all
words of the examples and their beginnings. A term weighs its frequency in the text, its
inverse document frequency over all documents, and the square root of the chi-square by
which its presence goes with the label in the examples: what tells nothing about the
label moves a vector little, and no term is cut off.

Examples lie in an inverted index by term. The postings of a frequent term are written
out, a number for each entry, and summed for many texts together; those of the others
are summed text by text. All are summed, so the search is exact. (Bounds of blocks of
128 of the at most 4,000 entries excluded half of the postings, but took longer than
the postings that they saved.) Texts are cut together, and the terms of each of their
distinct words are looked up once. Examples
with equal vectors are one entry with several votes, so copies and ties are all counted.
Votes are scaled back to the shares of the labels in the whole labelled table, as
examples are drawn evenly from both labels. Words that no example has meet no posting:
they lengthen a query's vector, but change neither ranks nor votes, which are relative
to the nearest example.

Defined cases: a text without a term of any example, null and empty ones too, scores the
share of toxic labels and has no evidence; labels that are null teach nothing; a
document with several labels counts as toxic if one says so; without examples every
score is 0; repeated rows get equal scores; null ids get scores and teach nothing; an
empty table gives no rows; further columns are passed through.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tabscope.llm.common import map_columns, texts
from tabscope.llm.simhash import set_links, shingle_hashes

#: Examples of each label (the bound of the fit), and neighbours.
EXAMPLES, NEIGHBOURS = 2_000, 15
#: A term that more than one in ``DENSE`` entries have is frequent. Texts searched together.
DENSE, TOGETHER = 20, 128
#: Weight of the prior share among the votes; power of similarities.
PRIOR, SHARPNESS = 0.05, 8
#: Lengths of word beginnings that count as terms.
STEMS = (4, 5)
#: Words of a shingle, and the least similarity of the shingle sets of near copies.
COPY_WORDS, COPY_LEAST = 5, 0.8
MARKS = ".,;:!?\"'()[]{}<>*_-"
#: Characters of texts that are cut together, about. Scored texts that a worker remembers; more only start it afresh.
TOGETHER_CHARS, SCORED = 4_000_000, 20_000


def word_terms(word: str) -> tuple[str, ...]:
    """A lower-case word without the marks around it, and its beginnings.

    A beginning ("word~") lets an unseen ending of a known stem count.
    """
    bare = word.strip(MARKS)
    return (bare, *(bare[:k] + "~" for k in STEMS if len(bare) > k)) if bare else ()


def terms_of(text: str) -> Counter:
    """How often each term comes."""
    out: Counter = Counter()
    for word, n in Counter(text.lower().split()).items():
        for term in word_terms(word):
            out[term] += n
    return out


def relevance(examples: list[tuple[np.ndarray, int]], distinct: list[int], size: int) -> np.ndarray:
    """The square root of each term's chi-square with the label, over the ``distinct`` examples.

    An example is the places of its terms and its label. Terms that only copies of
    distinct examples have count as seen once.
    """
    seen, toxic = np.zeros(size), np.zeros(size)
    for k in distinct:
        places, y = examples[k]
        seen[places] += 1
        toxic[places] += y
    for places, y in examples:
        new = places[seen[places] == 0]
        seen[new], toxic[new] = 1, y
    n, pos = len(distinct), sum(examples[k][1] for k in distinct)
    over = toxic * n - seen * pos
    return np.sqrt(n * over * over / np.maximum(1.0, seen * (n - seen) * pos * (n - pos)))


def distinct_examples(examples: list[tuple[str, int]]) -> list[int]:
    """Places of the examples without near copies: one of each group of alike texts of one label."""
    sets = [np.unique(shingle_hashes(t.encode("utf-8", "surrogatepass"), COPY_WORDS)) for t, _ in examples]
    if not sets:
        return []
    sets = [s if len(s) else np.zeros(1, np.uint64) for s in sets]  # texts without a word are alike
    copies = {row for row, _ in set_links(sets, [y for _, y in examples], np.ones(len(sets), bool), COPY_LEAST)}
    return [k for k in range(len(examples)) if k not in copies]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Index:
    """Vectors of entries (distinct examples) as postings by term and block."""

    terms: dict[str, int]
    weights: np.ndarray  # of each term: idf times relevance
    starts: np.ndarray  # of each term's postings, and their end
    owner: np.ndarray  # of each posting, by (term, entry): its entry
    value: np.ndarray  # its part of the entry's unit vector
    toxic: np.ndarray  # votes of each entry, scaled
    clean: np.ndarray
    evidence: np.ndarray  # an example id of each entry
    share: float

    @cached_property
    def layout(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the search reads, made where it runs: the rows alone are larger than all postings."""
        n = len(self.evidence)
        # postings of a frequent term: a full row
        many = np.diff(self.starts)
        often = many * DENSE > n
        term = np.repeat(np.arange(len(many)), many)
        row = np.where(often, np.cumsum(often) - 1, -1)
        full = often[term]
        rows = np.zeros((int(often.sum()), n))
        rows[row[term[full]], self.owner[full]] = self.value[full]
        # those of the others; indices of numpy's own width are not converted at each use
        rare_owner, rare = self.owner[~full].astype(np.intp), self.value[~full]
        rare_starts = np.concatenate([[0], np.cumsum(np.where(often, 0, many))])
        return row, rows, rare_owner, rare, rare_starts

    def __reduce__(self):
        # the layout is made anew from the postings, which are much smaller
        return Index, tuple(getattr(self, f.name) for f in fields(self))

    def vector(self, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return unit((1 + np.log(counts)) * self.weights[places])

    def frequent(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The similarity of each query to each entry by frequent terms alone."""
        row_of, rows, *_ = self.layout
        dense = np.zeros((len(queries), len(rows)))
        for q, (places, weights) in zip(dense, queries):
            row = row_of[places]
            q[row[row >= 0]] = weights[row >= 0]
        return dense @ rows

    def nearest(self, places: np.ndarray, query: np.ndarray, k: int, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries and similarities of the k nearest and of all that tie with the k-th.

        ``sims`` is the query's row of ``frequent``, which is completed. Entries that share
        no term with the query are not among the nearest.
        """
        *_, owner, value, starts = self.layout
        first = starts[places]
        sizes = starts[places + 1] - first
        rare = sizes > 0
        first, sizes = first[rare], sizes[rare]
        at = _ranges(first, sizes)
        sims += np.bincount(owner[at], np.repeat(query[rare], sizes) * value[at], len(sims))
        near = np.flatnonzero((sims >= kth(sims, k) - 1e-9) & (sims > 0))
        return near, sims[near]

    def score(self, places: np.ndarray, query: np.ndarray, k: int, sims: np.ndarray) -> tuple[float, list[int]]:
        at, sims = self.nearest(places, query, k, sims)
        if not len(at):
            return self.share, []
        # relative to the nearest: how far the examples lie must not favour the prior
        weights = (sims / sims.max()) ** SHARPNESS
        toxic, clean = float(weights @ self.toxic[at]), float(weights @ self.clean[at])
        score = (toxic + PRIOR * self.share) / (toxic + clean + PRIOR)
        best = at[np.lexsort((self.evidence[at], -sims))[:3]]
        # texts are searched together in any order: the last digits of sums may differ
        return round(min(1.0, max(0.0, score)), 12), self.evidence[best].tolist()

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[float, list[int]]]:
        """(score, evidence) of texts given by the places and counts of their terms."""
        out = []
        for start in range(0, len(texts), TOGETHER):
            queries = [(places, self.vector(places, counts)) for places, counts in texts[start : start + TOGETHER]]
            out += [self.score(p, q, k, sims) for (p, q), sims in zip(queries, self.frequent(queries))]
        return out


def kth(sims: np.ndarray, k: int) -> float:
    """The k-th greatest, or 0 if there are fewer."""
    return float(np.partition(sims, len(sims) - k)[len(sims) - k]) if len(sims) > k else 0.0


def unit(v: np.ndarray) -> np.ndarray:
    size = np.sqrt(v @ v)
    return v / size if size else v


def _strings(values: Iterable[str]) -> pa.Array:
    # what is no valid text meets no word
    return pa.array([v.encode("utf-8", "surrogatepass") for v in values], pa.large_binary()).cast(pa.large_string(), safe=False)


class Memory:
    """The places of terms. Many texts are cut together, and each of their distinct words is looked up once."""

    def __init__(self, terms: dict[str, int]):
        self.terms, self.none = terms, len(terms)  # none: the place of an unknown term
        self.last = np.zeros(len(terms) + 1, np.int64)
        # (length of the beginning or None, what is looked up, its places); a beginning goes without its mark
        stems = [(k, {t[:-1]: at for t, at in terms.items() if len(t) == k + 1 and t[-1] == "~"}) for k in STEMS]
        self.known = [(k, _strings(found), np.array([*found.values(), self.none])) for k, found in [(None, terms), *stems]]

    def rows(self, words: pa.Array) -> np.ndarray:
        """The places of each word's terms (``word_terms``), with ``none`` for unknown ones."""
        bare = pc.utf8_trim(words, MARKS)
        size = pc.utf8_length(bare)
        columns = []
        for k, found, places in self.known:
            at = pc.index_in(bare if k is None else pc.utf8_slice_codeunits(bare, 0, k), value_set=found)
            if k is not None:
                at = pc.if_else(pc.greater(size, k), at, None)
            columns.append(places[at.fill_null(len(found)).to_numpy(zero_copy_only=False)])
        return np.stack(columns, axis=1)

    def cut(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The places of the terms of each text, as often as they come, unknown ones too."""
        group, size = [], 0
        for text in texts:
            group.append(text.lower().split())
            size += len(text)
            if size > TOGETHER_CHARS:
                yield from self._cut(group)
                group, size = [], 0
        yield from self._cut(group)

    def _cut(self, group: list[list[str]]) -> Iterator[np.ndarray]:
        words = pa.array([w for text in group for w in text], pa.large_string()).dictionary_encode()
        rows, codes, start = self.rows(words.dictionary), words.indices.to_numpy(), 0
        for text in group:
            end = start + len(text)
            yield rows.take(codes[start:end], axis=0).ravel()
            start = end

    def own(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of equal places the last one is left. Also the number of the last for each."""
        number = np.arange(len(places))
        self.last[places] = number
        last = self.last[places]
        return last == number, last

    def distinct(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The places of each text's terms, maybe with ``none``."""
        for places in self.cut(texts):
            yield places[self.own(places)[0]]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return next(self.all_counts([text]))

    def all_counts(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The places of each text's terms, and how often each comes."""
        for places in self.cut(texts):
            places = places[places < self.none]
            own, last = self.own(places)
            yield places[own], np.bincount(last, minlength=len(places))[own].astype(np.float64)


def labelled_examples(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, each: int) -> DataFrame:
    """(id, y, text): up to ``each`` labelled documents of either label, by hash of the id."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("_id"))
        .agg(F.max((F.col(label) > 0).cast("int")).alias("_y"))
    )
    order = F.xxhash64("_id")
    chosen = [known.where(F.col("_y") == y).orderBy(order, "_id").limit(each) for y in (0, 1)]
    few = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * each rows of two numbers
    found = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).join(few, "_id")
    # repeated documents of one id: any of them, the least text, is the example
    return found.groupBy("_id").agg(F.first("_y").alias("y"), F.min("_text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text="text", label="toxic", each: int = EXAMPLES) -> Index:
    """The index of the examples; shares of the labels and term counts cover all rows."""
    shares = labels.where(F.col(label).isNotNull()).agg(F.count("*").alias("n"), F.count_if(F.col(label) > 0).alias("pos")).first()
    found = sorted(
        (r["_id"], r["y"], r["text"] or "")
        for r in labelled_examples(docs, labels, id_col, text, label, each).collect()  # bounded by 2 * each
    ) if shares["n"] else []
    return build(found, shares["n"], shares["pos"], lambda terms: document_counts(docs, text, terms))


def build(
    examples: list[tuple[int, int, str]], n: int, pos: int, frequencies: Callable[[dict[str, int]], tuple[int, np.ndarray]]
) -> Index:
    """The index of (id, label, text) rows, drawn from ``n`` labelled rows of which ``pos`` are toxic.

    ``frequencies`` gives the number of documents, and of those with each term.
    """
    share = pos / n if n else 0.0
    terms: dict[str, int] = {}
    sparse = []
    for _, _, text in examples:  # one text's words at a time: those of all texts fill the driver
        c = terms_of(text)
        at = np.fromiter((terms.setdefault(t, len(terms)) for t in c), np.int64, len(c))
        order = np.argsort(at)
        sparse.append((at[order], np.fromiter(c.values(), np.float64, len(c))[order]))
    total, with_term = frequencies(terms)
    # only one of several near copies with one label speaks for a term
    distinct = distinct_examples([(t, y) for _, y, t in examples])
    told = relevance([(at, y) for (at, _), (_, y, _) in zip(sparse, examples)], distinct, len(terms))
    weights = (np.log((total + 1) / (with_term + 1)) + 1) * told
    drawn = sum(y for _, y, _ in examples)
    up = {1: pos / drawn if drawn else 0.0, 0: (n - pos) / (len(examples) - drawn) if len(examples) > drawn else 0.0}
    entries: dict[bytes, list] = {}
    for (id_, y, _), (at, many) in zip(examples, sparse):
        v = unit((1 + np.log(many)) * weights[at])
        at, v = at[v > 0], v[v > 0]
        if len(at):
            e = entries.setdefault(at.tobytes() + v.tobytes(), [at, v, 0.0, 0.0, id_])
            e[3 - y] += up[y]
    # entries of one strongest term lie together
    kept = sorted(entries.values(), key=lambda e: (e[0][e[1].argmax()], -e[1].max(), e[4]))
    sizes = np.array([len(e[0]) for e in kept], np.int64)
    term = np.concatenate([e[0] for e in kept]) if kept else np.zeros(0, np.int64)
    value = np.concatenate([e[1] for e in kept]) if kept else np.zeros(0)
    order = np.argsort(term, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))])
    return Index(
        terms, weights, starts, np.repeat(np.arange(len(kept), dtype=np.int32), sizes)[order], value[order],
        np.array([e[2] for e in kept]), np.array([e[3] for e in kept]), np.array([e[4] for e in kept], np.int64), share,
    )


def document_counts(docs: DataFrame, text: str, terms: dict[str, int]) -> tuple[int, np.ndarray]:
    """Documents, and documents with each term, over the whole table."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # bounded by the examples

    def run(batches):
        memory = memory_of(shared.value)
        found, n = np.zeros(memory.none + 1, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for places in memory.distinct(texts(batch, text)):
                found[places] += 1
        at = np.flatnonzero(found[:-1])
        # place -1 counts the documents
        yield pa.RecordBatch.from_pydict({"term": np.append(at, -1), "n": np.append(found[at], n)})

    parts = docs.select(text).mapInArrow(run, "term long, n long")
    rows = parts.groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # one row a term
    found = np.zeros(len(terms) + 1)
    found[rows["term"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return int(found[-1]), found[:-1]


_MEMORY: list = [None, None]


def memory_of(terms: dict[str, int]) -> Cutter:
    """One memory for each worker process and vocabulary; it stays between tasks."""
    if _MEMORY[0] is not terms:
        _MEMORY[:] = [terms, Memory(terms)]
    return _MEMORY[1]


OWN = [
    StructField("score", DoubleType()),
    StructField("predicted", IntegerType()),
    StructField("evidence", ArrayType(LongType())),
]


def score_toxicity(docs: DataFrame, index: Index, text: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """(``_doc``, score, predicted, evidence): ids of the up to three nearest examples."""
    wide = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{text}`").cast("string").alias("_text")
    )
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the examples

    def run(batch, state) -> dict:
        known, index, memory = state
        if len(known) > SCORED:
            known.clear()
        keys, new = [], {}
        for places, counts in memory.all_counts(texts(batch, "_text")):
            key = hashlib.blake2b(places.tobytes() + counts.tobytes(), digest_size=16).digest()
            keys.append(key)
            if key not in known:
                new[key] = places, counts
        known.update(zip(new, index.scores(list(new.values()), neighbours)))
        scores, evidence = zip(*map(known.get, keys))
        return {"_doc": batch.column(0), "score": scores, "predicted": [int(s >= 0.5) for s in scores], "evidence": evidence}

    def setup():
        return {}, shared.value, memory_of(shared.value.terms)

    return map_columns(wide, run, StructType([wide.schema["_doc"], *OWN]), setup)
