"""Language identification, word first with backoff to ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom._ship import by_value
from byteloom.llm.common import below, small

by_value(__name__)

LETTERS = re.compile(r"[^\W\d_]+")

#: Labelled documents that the tables are fitted on, about, as many of each language; LEAST of a language, or all it has, also where that makes more together.
MAX_LABELLED, LEAST = 4000, 25
LONGEST = 5
#: A known word weighs 1, an unseen word that n-grams stand for this much.
BACKOFF_WEIGHT = 0.5
#: A document whose share of evidence from words and n-grams of two and more letters is lower has no known language.
MIN_KNOWN = 0.2
UNKNOWN = "und"


def words(text: str) -> list[str]:
    """Runs of letters; digits next to them say nothing about a language."""
    return LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


def _posteriors(counts: dict[str, Counter], langs: list[str], alpha: float) -> dict[str, tuple[float, ...]]:
    """For each key the log of its languages' share, from its smoothed frequency in each."""
    keys = set().union(*counts.values()) if counts else set()
    totals = [sum(counts[x].values()) + alpha * len(keys) for x in langs]
    out = {}
    for k in keys:
        p = [(counts[x][k] + alpha) / t for x, t in zip(langs, totals)]
        s = sum(p)
        out[k] = tuple(math.log(x / s) for x in p)
    return out


def fit(rows: list[tuple[str, str]]) -> dict:
    """Tables from pairs of language and text: for each word seen twice, and each n-gram of the words' types, a log share by language."""
    langs = sorted({x for x, _ in rows})
    seen: dict[str, Counter] = {x: Counter() for x in langs}
    for x, text in rows:
        seen[x].update(w for w in words(text) if w.isalpha())
    total = Counter()
    for c in seen.values():
        total.update(c)
    known = {x: Counter({w: n for w, n in c.items() if total[w] > 1}) for x, c in seen.items()}
    tables = {"langs": langs, "words": _posteriors(known, langs, 0.1)}
    for n in range(1, LONGEST + 1):
        by: dict[str, Counter] = defaultdict(Counter)
        for x in langs:
            for w in seen[x]:
                by[x].update(grams(w, n))
        tables[n] = _posteriors({x: by[x] for x in langs}, langs, 0.5)
    return tables


def word_scores(model: dict, word: str) -> tuple[tuple[float, ...], float]:
    """The word's log share by language and how well it's known: 1 by itself or by n-grams of two letters or more, else 0.

    An unseen word has the mean over its n-grams of the greatest length at which half of them are known."""
    hit = model["words"].get(word)
    if hit:
        return hit, 1.0
    for n in range(LONGEST, 0, -1):
        every = grams(word, n)
        found = [model[n][g] for g in every if g in model[n]]
        if found and 2 * len(found) >= len(every):
            k = BACKOFF_WEIGHT / len(found)
            return tuple(k * sum(col) for col in zip(*found)), float(n > 1)
    return (0.0,) * len(model["langs"]), 0.0


def _hashes(letters: np.ndarray, n: int) -> np.ndarray:
    """Of each place the hash of the ``n`` letters from it on."""
    h = np.full(len(letters) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ letters[k : len(letters) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _letters(own: list[str], marked: bool) -> np.ndarray:
    return np.frombuffer("".join(f"<{w}>" if marked else w for w in own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def packed(model: dict) -> dict:
    """The tables as arrays, n-grams by their sorted hashes, to be sent to executors."""
    k, tables = len(model["langs"]), {}
    for n in range(1, LONGEST + 1):
        keys = list(model[n])
        h = _hashes(_letters(keys, False), n)[::n] if keys else np.zeros(0, np.uint64)  # each n-gram has n letters
        order = np.argsort(h)
        tables[n] = h[order], np.array([model[n][g] for g in keys], np.float64).reshape(len(keys), k)[order]
    return {"langs": model["langs"], "words": list(model["words"]), "shares": np.array(list(model["words"].values()), np.float64).reshape(len(model["words"]), k), "tables": tables}


class Scorer:
    """``word_scores`` of many words at once, by the packed tables, and the scores of the words met so far."""

    LIMIT = 200_000

    def __init__(self, packed: dict):
        self.langs, self.k = packed["langs"], len(packed["langs"])
        self.words, self.shares = {w: i for i, w in enumerate(packed["words"])}, packed["shares"]
        self.tables = packed["tables"]
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, self.k + 2))

    def _unseen(self, own: list[str]) -> np.ndarray:
        out = np.zeros((len(own), self.k + 1))
        todo = np.arange(len(own))
        lens = np.array([len(w) for w in own], np.int64)
        for n in range(LONGEST, 0, -1):
            keys, shares = self.tables[n]
            edge = 2 * (n > 1)
            todo_n = todo[lens[todo] + edge >= n]
            if not len(todo_n) or not len(keys):
                continue
            h = _hashes(_letters([own[i] for i in todo_n], n > 1), n)
            size = lens[todo_n] + edge
            count = size - n + 1
            starts = np.cumsum(count) - count
            at = np.arange(count.sum()) + np.repeat(np.cumsum(size) - size - starts, count)
            h = h[at]
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            found = np.add.reduceat(hit.astype(np.int64), starts)
            sums = np.add.reduceat(np.where(hit[:, None], shares[place], 0.0), starts, axis=0)
            ok = (found > 0) & (2 * found >= count)
            out[todo_n[ok], : self.k] = BACKOFF_WEIGHT * sums[ok] / found[ok, None]
            out[todo_n[ok], self.k] = n > 1
            todo = np.setdiff1d(todo, todo_n[ok], assume_unique=True)
        return out

    def _add(self, fresh: list[str]) -> None:
        rows = np.zeros((len(fresh), self.k + 2))
        unseen = []
        for i, w in enumerate(fresh):
            if w.isalpha():
                hit = self.words.get(w)
                if hit is None:
                    unseen.append(i)
                else:
                    rows[i, : self.k], rows[i, self.k] = self.shares[hit], 1
                rows[i, self.k + 1] = 1
        if unseen and self.k:
            rows[unseen, : self.k + 1] = self._unseen([fresh[i] for i in unseen])
        self.rows = np.concatenate([self.rows, rows])

    def identify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and confidence (share of the best language by mean word) of each text; no evidence, or a tie of all languages, is UNKNOWN with 0."""
        named, sure = [], []
        for i in range(0, len(texts), 500):
            if len(self.at) > self.LIMIT:
                self.clear()
            at, known = self.at, len(self.at)
            idx = [np.array([at.setdefault(w, len(at)) for w in words(t)], np.int64) if t else np.zeros(0, np.int64) for t in texts[i : i + 500]]
            if len(at) > known:
                self._add(list(at)[known:])
            for own in idx:
                s, k = self.rows[own].sum(axis=0), self.k
                if k and s[k + 1] and s[k] >= MIN_KNOWN * s[k + 1] and (k == 1 or s[:k].max() > s[:k].min()):
                    best = int(s[:k].argmax())
                    named.append(self.langs[best])
                    sure.append(float(1 / np.exp((s[:k] - s[best]) / s[k + 1]).sum()))
                else:
                    named.append(UNKNOWN)
                    sure.append(0.0)
        return named, sure


def in_parts(batches, rows: int = 500):
    """The batches in parts, so that few texts are Python strings at a time."""
    for b in batches:
        yield from pa.Table.from_batches([b]).to_batches(max_chunksize=rows)


def fit_on(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_labelled: int = MAX_LABELLED) -> dict:
    """Fits on about ``max_labelled`` labelled documents, chosen by a hash of their ids and texts, as many of each language: at least LEAST, or all that it has.

    Every language with a labelled document is in the model, however rare it is; documents without a label don't count. Rows that repeat id and text are drawn once."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t is not null and l is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return fit([])
    each = max(LEAST, max_labelled / len(counts))
    bounds = docs.sparkSession.createDataFrame([(x, below(min(1.0, each / n))) for x, n in counts.items()], f"l {rows.schema['l'].dataType.simpleString()}, bound bigint")
    drawn = rows.join(small(bounds, len(counts), 64), "l").where(F.xxhash64("i", "t") <= F.col("bound")).select("i", "l", "t").distinct()
    drawn = [(r.l, r.t) for r in drawn.select("l", "t").collect()]
    # repeated rows share a hash, so of a language that has few others none may be drawn
    if left := list(counts.keys() - {x for x, _ in drawn}):
        drawn += [(r.l, r.t) for r in rows.where(F.col("l").isin(left)).groupBy("l").agg(F.min("t").alias("t")).collect()]
    return fit(drawn)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(id, language, confidence, rejected) of every row.

    A document is rejected where nothing in it speaks for a language: null or empty text, no letters, only unknown scripts, or a tie of all languages.
    Where two languages have the same sum the alphabetically first is named, unless all have it. Long texts are read whole.
    Repeated rows each have a row; a null id stays null; other columns are ignored; an empty table, or one without labels, rejects all it has."""
    model = fit_on(docs, id_col, text_col, lang_col, max_labelled)
    shared = docs.sparkSession.sparkContext.broadcast(packed(model))  # bounded by max_labelled
    spark_id = docs.schema[id_col]

    def run(batches):
        scorer = Scorer(shared.value)
        for b in in_parts(batches):
            named, sure = scorer.identify(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(named, pa.string()), pa.array(sure, pa.float64()), pa.array([x == UNKNOWN for x in named], pa.bool_())], ["doc_id", "language", "confidence", "rejected"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {spark_id.dataType.simpleString()}, language string, confidence double, rejected boolean")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` without the rows that ``detect`` rejects, decided row by row where the row lies; nothing is shuffled.

    So rows with null or empty texts, or without letters, go, and so do all rows where no document has a label; of repeated rows each stays or goes as the others; ids and ties
    don't matter, all columns stay as they are, and an empty table stays empty."""
    model = fit_on(docs, id_col, text_col, lang_col, max_labelled)
    shared = docs.sparkSession.sparkContext.broadcast(packed(model))
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(shared.value)
        for b in in_parts(batches):
            named, _ = scorer.identify(b.column(at).to_pylist())
            yield b.filter(pa.array([x != UNKNOWN for x in named], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
