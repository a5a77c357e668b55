"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts and unlabelled texts are learnt from. With class prior p, a share of the unlabelled
texts is toxic, so every estimate about clean text is corrected by it: first the clean rate of each word feature,
(u - p * t) / (1 - p), floored at zero, then the risk of a logistic classifier,
p * R_t(+) + max(0, R_u(-) - p * R_t(-)), whose second term is kept from going negative.

Defined results: a null text counts as empty; an empty text gets the score of a text without any toxic feature; with
no confirmed toxic text to learn from, every score is 0; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from seasonflow.llm.common import added_up, drawn_rows, is_held_out, unit_hash

WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)
LEAST_WEIGHT = 1.5
LEAST_TEXTS = 3
CACHED_WORDS = 200_000


def features_of(word: str) -> list[str]:
    """The word itself and its prefixes, by which inflected and compounded forms share evidence."""
    return [f"={word}"] + [word[:n] for n in PREFIXES if len(word) >= n]


def doc_features(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text.lower())) for f in features_of(w)}


def hits(texts: list[str], among: dict | None = None) -> dict[str, int]:
    """The number of texts with each feature; with among, only of its keys."""
    out: dict[str, int] = {}
    for t in texts:
        own = doc_features(t)
        for f in own if among is None else own & among.keys():
            out[f] = out.get(f, 0) + 1
    return out


def corrected_weights(toxic: dict[str, int], n_toxic: int, unlabelled: dict[str, int], n_unlabelled: int, prior: float) -> dict[str, float]:
    """log(toxic rate / clean rate) by feature, where the clean rate is what the prior leaves of the unlabelled rate.

    Both rates are taken one standard error low, so that features of a few texts don't outweigh common ones.
    """
    floor, out = 0.5 / (n_unlabelled + 1), {}
    for f, n in toxic.items():
        low, m = (n - np.sqrt(n)) / n_toxic, unlabelled.get(f, 0)
        clean = (m - np.sqrt(m)) / n_unlabelled - prior * n / n_toxic
        if low > 0 and (w := float(np.log(low / max(clean / (1 - prior), floor)))) >= LEAST_WEIGHT:
            out[f] = w
    return out


def summary(weights: list[float], n_words: int) -> list[float]:
    """What the classifier sees of a text: its strongest word weights, their sum, and their share of the text."""
    top = sorted(weights, reverse=True)[:3]
    top += [0.0] * (3 - len(top))
    total = sum(w for w in weights if w >= 2 * LEAST_WEIGHT)
    return [*top, float(np.log1p(total)), len(weights) / np.sqrt(1.0 + n_words)]


class Summariser:
    """Maps texts to summaries under fixed word weights; remembers the words it has weighed."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.known = weights, {}

    def weigh(self, token: str) -> float:
        get = self.weights.get
        v = max((get(f, 0.0) for w in WORD.findall(token) for f in features_of(w)), default=0.0)
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        self.known[token] = v
        return v

    def __call__(self, text: str) -> list[float]:
        tokens, found, known = set(text.lower().split()), [], self.known
        for t in tokens:
            v = known.get(t)
            if v is None:
                v = self.weigh(t)
            if v:
                found.append(v)
        return summary(found, len(tokens))


def corpus_hits(docs: DataFrame, features: list[str]) -> tuple[dict[str, int], int]:
    """The number of documents with each of features, and of all documents; features go to every task."""
    at = docs.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(features)})

    def count(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        out, place, known = np.zeros(len(features) + 1, np.int64), at.value, {}
        for b in batches:
            out[-1] += len(b)
            for t in b["text"]:
                seen: set[int] = set()
                for token in set(t.lower().split()) if isinstance(t, str) else ():
                    own = known.get(token)
                    if own is None:
                        if len(known) >= CACHED_WORDS:
                            known.clear()
                        own = known[token] = tuple({place[f] for w in WORD.findall(token) for f in features_of(w) if f in place})
                    seen.update(own)
                out[list(seen)] += 1
        return out

    n = added_up(docs.select("text"), count, len(features) + 1)
    return dict(zip(features, n.tolist())), int(n[-1])


def fit_nnpu(x: np.ndarray, is_toxic: np.ndarray, prior: float, steps: int = 600, rate: float = 0.3, decay: float = 1e-3) -> np.ndarray:
    """Logistic weights (bias last) by gradient steps on the non-negative risk.

    Where the corrected risk of the clean class falls below zero, the step undoes that excess only.
    """
    x = np.hstack([x, np.ones((len(x), 1))])
    xt, xu, w = x[is_toxic], x[~is_toxic], np.zeros(x.shape[1])
    for k in range(steps):
        zt, zu = xt @ w, xu @ w
        st, su = 1 / (1 + np.exp(-zt)), 1 / (1 + np.exp(-zu))
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zt).mean()
        g_toxic = prior * ((st - 1)[:, None] * xt).mean(0)
        g_clean = (su[:, None] * xu).mean(0) - prior * (st[:, None] * xt).mean(0)
        g = g_toxic + g_clean if clean >= 0 else -0.1 * g_clean
        w -= rate / (1 + k / 200) * (g + decay * np.append(w[:-1], 0))
    return w


def train(
    docs: DataFrame, labels: DataFrame, most_toxic: int = 2000, most_unlabelled: int = 5000, prior: float | None = None, most_bytes: int = 1 << 26
) -> dict:
    """Fit on about most_toxic confirmed texts, drawn by a hash of the id and then of the row, and on all texts as unlabelled ones.

    The features of the confirmed texts are counted over all documents; only the weights of the logistic classifier,
    six numbers, come from a sample of about most_unlabelled texts. Either sample holds about most_bytes at most. Rows whose crc32(doc_id) is divisible by 5 are
    never used. prior defaults to the toxic share of the labelled rows outside the held-out fold. Labels are reduced
    to one row per doc_id, toxic if any of its rows says so.
    """
    own = labels.where(~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    tally = own.agg(F.count("toxic").alias("n"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0)).alias("t")).first()
    rows = docs.where(~is_held_out()).select("doc_id", "text")
    if prior is None:
        prior = tally.t / tally.n if tally.n else 0.0
    if not tally.t or rows.isEmpty():
        return unfitted(prior)
    prior = min(max(prior, 1e-3), 0.9)
    toxic_ids = own.where((F.col("toxic") == 1) & (unit_hash("doc_id") < most_toxic / tally.t)).select("doc_id")
    # about most_toxic ids; twice that many rows leave room where ids don't repeat
    confirmed = drawn_rows(rows.join(F.broadcast(toxic_ids), "doc_id", "left_semi"), "text", 2 * most_toxic, most_bytes, 3)
    toxic = [r.text or "" for r in confirmed.collect()]
    drawn = [r.text or "" for r in drawn_rows(rows, "text", most_unlabelled, most_bytes, 1).collect()]
    features = sorted(f for f, n in hits(toxic).items() if n >= LEAST_TEXTS)
    return fit(toxic, drawn, *corpus_hits(rows, features), prior)


def unfitted(prior: float) -> dict:
    return {"weights": {}, "w": None, "mean": None, "std": None, "prior": prior}


def fit(toxic: list[str], drawn: list[str], counts: dict[str, int], n_docs: int, prior: float) -> dict:
    """The model of confirmed toxic texts and of unlabelled ones, of which a share of prior is toxic.

    counts: of n_docs unlabelled texts, those with each feature; drawn: some of these texts.
    """
    if not toxic or not drawn:
        return unfitted(prior)
    toxic, drawn = sorted(toxic), sorted(drawn)
    halves = [toxic[::2], toxic[1::2]]
    seen = [hits(x, counts) for x in halves]
    x, y = [], []
    for part in (0, 1):  # words are weighed on one half of the confirmed texts and summed up on the other
        s = Summariser(corrected_weights(seen[1 - part], len(halves[1 - part]) or 1, counts, n_docs, prior))
        for texts, flag in ((halves[part], True), (drawn[part::2], False)):
            x += [s(t) for t in texts]
            y += [flag] * len(texts)
    x, y = np.array(x), np.array(y)
    mean, std = x.mean(0), x.std(0) + 1e-9
    whole = {f: seen[0].get(f, 0) + seen[1].get(f, 0) for f in counts}
    return {
        "weights": corrected_weights(whole, len(toxic), counts, n_docs, prior), "w": fit_nnpu((x - mean) / std, y, prior), "mean": mean,
        "std": std, "prior": prior
    }


def score_texts(model: dict, texts: list[str], summarise: Summariser | None = None) -> np.ndarray:
    if model["w"] is None:
        return np.zeros(len(texts))
    s = summarise or Summariser(model["weights"])
    x = np.array([s(t) for t in texts]).reshape(len(texts), 5)
    return 1 / (1 + np.exp(-(((x - model["mean"]) / model["std"]) @ model["w"][:-1] + model["w"][-1])))


def score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "tox_score") -> DataFrame:
    """docs with a column of toxicity scores in [0, 1]; other columns, of any name, stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        s = Summariser(own["weights"])
        for b in batches:
            yield pd.Series(score_texts(own, b.fillna("").tolist(), s), dtype="float64")

    return docs.withColumn(out, scored(F.col(text_col)))
