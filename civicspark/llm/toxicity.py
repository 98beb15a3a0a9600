"""Toxicity by multiple-instance learning: sentences answer for their document by a noisy-or."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.llm.common import share_package
from civicspark.llm.gam import learning_rows
from civicspark.session import materialize

#: Labelled rows that the model is fitted on, at most.
TRAIN_ROWS = 12_000
#: Term hashes of theirs that it may see.
TRAIN_TERMS = 10_000_000
#: Terms are known by 32-bit hashes; those in fewer training documents carry no weight.
LEAST_DOCS, LEAST_G2 = 4, 30.0

SENTENCE = re.compile(r"[^.!?\n]+")
TERM = re.compile(r"[^\W_]+")


def _hash(term: str) -> int:
    from zlib import crc32

    return crc32(term.encode())


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence that holds a term."""
    return [m.span() for m in SENTENCE.finditer(text or "") if TERM.search(m.group())]


def terms(sentence: str) -> set[str]:
    """The distinct terms of a sentence, lowered."""
    return set(TERM.findall(sentence.lower()))


class NoisyOr:
    """P(document) = 1 - (1 - leak) * product over sentences of (1 - P(sentence)).

    A sentence's chance is logistic in its known terms; a sentence without any has none. The
    weights are learnt from document labels alone, by gradient steps on the likelihood.
    """

    def __init__(self, weights: dict[int, float] | None = None, bias: float = -3.0, leak: float = 0.0):
        self.weights, self.bias, self.leak = weights or {}, bias, leak

    def fit(self, documents: list[list[np.ndarray]], y: np.ndarray, steps: int = 300, ridge: float = 0.02) -> NoisyOr:
        y = np.asarray(y, float)
        if not len(y):
            return self
        vocabulary = self._choose(documents, y)
        place = {t: i for i, t in enumerate(vocabulary)}
        rows, columns, owners = [], [], []
        for d, doc in enumerate(documents):
            for sentence in doc:
                known = [place[t] for t in sentence.tolist() if t in place]
                if known:
                    rows.extend([len(owners)] * len(known))
                    columns.extend(known)
                    owners.append(d)
        rows, columns, owners = (np.array(a, np.int64) for a in (rows, columns, owners))
        # w, bias and the leak's logit, by Adam on the mean loss.
        theta = np.zeros(len(vocabulary) + 2)
        theta[-2], theta[-1] = -1.0, np.log((y.mean() * 0.2 + 1e-3) / (1 - y.mean() * 0.2))
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            w, bias, leak = theta[:-2], theta[-2], theta[-1]
            z = bias + np.bincount(rows, w[columns], len(owners)) if len(owners) else np.zeros(0)
            p = 1 / (1 + np.exp(-z))
            leak_p = 1 / (1 + np.exp(-leak))
            none = np.log1p(-leak_p) - np.bincount(owners, np.logaddexp(0, z), len(y))  # log chance of no offence
            some = np.maximum(-np.expm1(none), 1e-12)
            # d loss / d none, and d none / d z = -p.
            slope = np.where(y > 0, np.exp(none) / some, -1.0) / len(y)
            grad = np.zeros_like(theta)
            dz = -slope[owners] * p
            grad[:-2] = np.bincount(columns, dz[rows], len(w)) + ridge * w / len(y)
            grad[-2] = dz.sum()
            grad[-1] = -(slope * leak_p).sum()
            first = 0.9 * first + 0.1 * grad
            second = 0.99 * second + 0.01 * grad**2
            theta -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
            # ``slope`` is d loss / d none; the loss of a toxic document falls as none falls.
        self.weights = dict(zip(vocabulary, theta[:-2].tolist(), strict=True))
        self.bias, self.leak = float(theta[-2]), float(1 / (1 + np.exp(-theta[-1])))
        return self

    @staticmethod
    def _choose(documents: list[list[np.ndarray]], y: np.ndarray) -> list[int]:
        """Terms that toxic documents hold significantly more often than others."""
        seen = [np.unique(np.concatenate(d)) if d else np.zeros(0, np.int64) for d in documents]
        sizes = np.array([len(s) for s in seen])
        if not sizes.sum():
            return []
        every, place = np.unique(np.concatenate(seen), return_inverse=True)
        bad = np.bincount(place, np.repeat(y, sizes), len(every))
        docs = np.bincount(place, minlength=len(every))
        n, toxic = len(y), y.sum()
        table = [bad, docs - bad, toxic - bad, n - toxic - docs + bad]
        expected = [docs * toxic / n, docs * (n - toxic) / n, (n - docs) * toxic / n, (n - docs) * (n - toxic) / n]
        g2 = 2 * sum(o * np.log(np.maximum(o, 1e-12) / np.maximum(e, 1e-12)) for o, e in zip(table, expected, strict=True))
        keep = (docs >= LEAST_DOCS) & (g2 >= LEAST_G2) & (bad > expected[0])
        return every[keep].tolist()

    def sentence(self, hashes) -> float:
        """The chance that a sentence with these terms offends."""
        known = [self.weights[h] for h in hashes if h in self.weights]
        return 1 / (1 + np.exp(-(self.bias + sum(known)))) if known else 0.0


def _parsed(batches):
    for rows in batches:
        lists, sizes = [], []
        for text in rows["text"]:
            found = [sorted({_hash(t) for t in terms(text[a:b])}) for a, b in sentences(text)]
            lists.append([h for s in found for h in s])
            sizes.append([len(s) for s in found])
        yield pd.DataFrame({"label": rows["label"], "terms": lists, "sizes": sizes, "n_terms": list(map(len, lists))})


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> NoisyOr:
    """A model of ``label`` from a bounded number of documents; their term hashes reach the driver.

    At most ``TRAIN_TERMS`` hashes do: documents are taken in the order of the hash of their terms as
    long as the bound holds them, so a very long one may be left out of the learning.
    """
    share_package(docs.sparkSession)
    parsed = materialize(
        learning_rows(docs, labels, label, rows).mapInPandas(
            _parsed, "label int, terms array<long>, sizes array<int>, n_terms long"
        )
    )
    # One task adds up the sizes of at most ``rows`` documents.
    order = Window.orderBy(F.xxhash64("terms", "label"))
    fits = parsed.filter(F.col("n_terms") <= TRAIN_TERMS // 10).withColumn("_upto", F.sum("n_terms").over(order))
    found = fits.filter(F.col("_upto") <= TRAIN_TERMS).select("label", "terms", "sizes").toArrow()
    y = found.column("label").to_numpy()
    documents = []
    for hashes, sizes in zip(found.column("terms"), found.column("sizes"), strict=True):
        flat = hashes.values.to_numpy()
        documents.append(np.split(flat, np.cumsum(sizes.values.to_numpy())[:-1]) if len(flat) else [])
    order = np.lexsort(([sum(map(len, d)) for d in documents], y))
    return NoisyOr().fit([documents[i] for i in order], y[order])


def toxicity(docs: DataFrame, labels: DataFrame, offence: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` and ``offending``: the sentences with a chance of ``offence`` or more.

    ``offending`` is an array of (start, end, chance, sentence), in code points from 0. Empty
    and null texts have no sentence: their score is the model's leak, the chance of a toxic
    label without any sign of it in the text. Without labelled rows all scores are the same.
    Repeated rows are scored alike. Columns of ``docs`` with those names are replaced.
    """
    share_package(docs.sparkSession)
    model = train(docs, labels)

    @F.pandas_udf("score double, offending array<struct<start: int, end: int, chance: double, sentence: string>>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        known = {}
        scores, found = [], []
        for text in texts:
            clean, spans = 1 - model.leak, []
            for a, b in sentences(text):
                hits = []
                for term in terms(text[a:b]):
                    h = known.get(term)
                    if h is None:
                        if len(known) > 200_000:
                            known.clear()
                        h = _hash(term)
                        known[term] = h = h if h in model.weights else -1
                    if h >= 0:
                        hits.append(h)
                if hits:
                    p = model.sentence(sorted(hits))
                    clean *= 1 - p
                    if p >= offence:
                        spans.append({"start": a, "end": b, "chance": p, "sentence": text[a:b]})
            scores.append(1 - clean)
            found.append(spans)
        return pd.DataFrame({"score": scores, "offending": found})

    return docs.withColumn("_judged", judge(F.col("text").cast("string"))).withColumns(
        {"score": F.col("_judged.score"), "offending": F.col("_judged.offending")}
    ).drop("_judged")
