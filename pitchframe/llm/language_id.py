"""Language identification: known words first, then shorter and shorter character n-grams.

A word's score in a language is minus the log10 of its relative frequency there, or a
penalty if that language does not list it.  A word that no language lists is scored by its
character n-grams of the greatest length of which at least one is listed; a text's score is
the mean over its words, and the smallest mean wins.

The lists come from a bounded sample: at most about ``SAMPLE_DOCS`` documents a language,
drawn by a hash of doc_id, of which the ``WORDS`` most frequent words and the ``NGRAMS``
most frequent n-grams of each length are kept.  So the model's size does not grow with the
corpus; predictions cover whole texts of all rows.

A text's score is a share among the learned languages and cannot say that it is in none of
them.  ``known`` can, however many there are: the mean over its words of 1 for a word that
the winning language lists, and else the share of the word's n-grams of ``TELLING``
characters that it lists.  An item met as rarely as the rarest of a long list does not
count, so that a sampled text does not vouch for itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from math import log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchframe.llm.common import settle, text_or_empty

SAMPLE_DOCS = 2_000
WORDS = 20_000
NGRAMS = 5_000
LENGTHS = (1, 2, 3, 4, 5)
TELLING = 4
FEW = 1_000  # items of a list up to which all of them count as known
PENALTY = 7.0
CACHE_WORDS = 300_000
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def remainder(key: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def words_of(text: str) -> list[str]:
    return [w for w in LETTERS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def draw(labelled: DataFrame, most: int) -> DataFrame:
    """Of every language all documents, or about ``most`` of them by a hash of doc_id."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("of"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # One row per language.
    return labelled.join(F.broadcast(sizes), "lang").where(part * F.col("of") < most).select("lang", "text")


def train(
    labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, words: int = WORDS, ngrams: int = NGRAMS
) -> list[tuple[str, int, str, float]]:
    """(lang, length, item, score) of ``labelled`` (doc_id, lang, text); length 0 stands for words.

    At most (words + ngrams * lengths) rows a language.
    """

    def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for word in words_of(text.as_py()):
                    counts[lang, word] = counts.get((lang, word), 0) + 1
            langs, found = zip(*counts) if counts else ((), ())
            arrays = [pa.array(langs, pa.string()), pa.array(found, pa.string()), pa.array(counts.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "word", "n"])

    counted = draw(labelled, sample_docs).mapInArrow(count_words, "lang string, word string, n long")
    listed = settle(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))

    def pieces(n: int) -> DataFrame:
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))
        cut = F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))
        rows = listed.select("lang", F.lit(n).alias("length"), F.explode(cut).alias("item"), "n")
        return rows.where(F.length("item") == n)

    words_alone = listed.select("lang", F.lit(0).alias("length"), F.col("word").alias("item"), "n")
    items = reduce(DataFrame.unionByName, [words_alone, *[pieces(n) for n in LENGTHS]])
    totals = items.groupBy("lang", "length", "item").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("lang", "length")
    most = F.when(F.col("length") == 0, words).otherwise(ngrams)
    ranked = totals.withColumn("of", F.sum("n").over(group)).withColumn(
        "place", F.row_number().over(group.orderBy(F.desc("n"), "item"))
    )
    rows = ranked.where(F.col("place") <= most).select("lang", "length", "item", "n", "of").toArrow().to_pylist()
    return [(r["lang"], r["length"], r["item"], -log10(r["n"] / r["of"])) for r in rows]


class Backoff:
    """The model: of each length the items' places in a table of scores by language.

    It is broadcast as it is, so that a worker holds one copy for all tasks.
    """

    def __init__(self, rows: list[tuple[str, int, str, float]]):
        self.langs = sorted({r[0] for r in rows})
        column = {lang: n for n, lang in enumerate(self.langs)}
        self.lists: dict[int, dict[str, int]] = {}
        for _, length, item, _ in rows:
            own = self.lists.setdefault(length, {})
            own.setdefault(item, len(own))
        self.tables = {length: np.full((len(own), len(self.langs)), PENALTY) for length, own in self.lists.items()}
        for lang, length, item, score in rows:
            self.tables[length][self.lists[length][item], column[lang]] = min(score, PENALTY)
        sizes = np.zeros((max(LENGTHS) + 1, len(self.langs)), dtype=np.int64)
        rarest = np.zeros(sizes.shape)
        for lang, length, _, score in rows:
            sizes[length, column[lang]] += 1
            rarest[length, column[lang]] = max(rarest[length, column[lang]], score)
        self.below = np.where(sizes > FEW, np.minimum(rarest, PENALTY) - 1e-9, PENALTY)
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.words: list[str] = []
        self.scores = np.zeros((1024, len(self.langs)))
        # Shares known of a word, by language; NaN where nobody asked yet.
        self.told = np.full((1024, len(self.langs)), np.nan)

    def listed(self, length: int, items: list[str]) -> np.ndarray:
        """The scores (item x language) of those ``items`` that any language lists."""
        places = [*map(self.lists.get(length, {}).get, items)]
        there = [p for p in places if p is not None]
        return self.tables[length][there] if there else np.zeros((0, len(self.langs)))

    def known(self, word: str) -> np.ndarray:
        """By language 1 if it knows the word, else the share of its n-grams that it knows."""
        padded = f" {word} "
        length = min(TELLING, len(padded))
        grams = [padded[i : i + length] for i in range(len(padded) - length + 1)]
        shares = (self.listed(length, grams) < self.below[length]).sum(axis=0) / len(grams)
        whole = self.listed(0, [word])
        return np.where(whole[0] < self.below[0], 1.0, shares) if len(whole) else shares

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, known) of a text."""
        rows = self.rows(text)
        lang, score = self.winner(rows)
        if lang == UNKNOWN:
            return lang, score, 0.0
        at = self.langs.index(lang)
        new = rows[np.isnan(self.told[rows, at])]
        for row in np.unique(new).tolist():
            self.told[row] = self.known(self.words[row])
        return lang, score, float(self.told[rows, at].mean())

    def score(self, word: str) -> np.ndarray:
        known = self.listed(0, [word])
        if len(known):
            return known[0]
        padded = f" {word} "
        for length in sorted(self.lists, reverse=True):
            if length:
                found = self.listed(length, [padded[i : i + length] for i in range(len(padded) - length + 1)])
                if len(found):
                    return found.mean(axis=0)
        return np.full(len(self.langs), PENALTY)

    def row(self, word: str) -> int:
        n = self.place[word] = len(self.place)
        self.words.append(word)
        if n == len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.told = np.concatenate([self.told, np.full_like(self.told, np.nan)])
        self.scores[n] = self.score(word)
        return n

    def rows(self, text: str | None) -> np.ndarray:
        """The rows of a text's words, in order."""
        if len(self.place) > CACHE_WORDS:
            self.forget()
        place = self.place
        return np.array([place[w] if w in place else self.row(w) for w in words_of(text or "")], dtype=np.int64)

    def winner(self, rows: np.ndarray) -> tuple[str, float]:
        if not len(rows) or not self.langs:
            return UNKNOWN, 0.0
        means = self.scores[rows].mean(axis=0)
        odds = np.exp((means.min() - means) * log(10))
        return self.langs[int(means.argmin())], float(1 / odds.sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.winner(self.rows(text)) if self.langs else (UNKNOWN, 0.0)


def predict(docs: DataFrame, model: list[tuple[str, int, str, float]], keep: list[str], with_known: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score (0 to 1; and known), from ``text`` alone.

    A null text, or one without letters, is ``und`` with score 0, and so is every text if
    nothing was learned; level languages go to the first by code point.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Backoff(model))
    judge = Backoff.judge if with_known else Backoff.predict
    names = ["lang_pred", "score", "known"][: 2 + with_known]
    types = [pa.string(), pa.float64(), pa.float64()][: 2 + with_known]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [judge(own, t.as_py()) for t in batch.column(source)]
            columns = [batch.column(k) for k in keep]
            columns += [pa.array([f[n] for f in found], kind) for n, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *names])
        # Workers live on after a step: remembered words and what Arrow keeps for later use go back.
        own.forget()
        pa.default_memory_pool().release_unused()

    # Where the text is kept as it is, it goes to the workers once.
    source = "text" if "text" in keep and docs.schema["text"].dataType.simpleString() == "string" else "_text"
    rows = docs.select(*keep, *([F.col("text").cast("string").alias("_text")] if source == "_text" else []))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"]
    return rows.mapInArrow(run, ", ".join([*fields, "lang_pred string", *[f"{n} double" for n in names[1:]]]))


def learnable(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """(doc_id, lang, text) of the rows with both, but for the held-out ones."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if held_out is not None:
        rows = rows.where(~held_out)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))


def identify_languages(docs: DataFrame, folds: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from rows whose crc32(doc_id as text) modulo ``folds`` is not 0; the others are
    held out.  A null doc_id counts as empty text and is held out.  Repeated rows are
    predicted each; other columns are ignored; an empty table gives no rows.
    """
    held_out = remainder(folds=folds) == 0
    model = train(learnable(docs, held_out))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])
