"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters look at a text and vote "toxic" or abstain. Lexicon voters: each word of the fixed lexicons. Pattern voters: words
that begin with, or are, a certain stem, chosen for their association with the label in the labelled rows; an insult in a text
that also addresses someone; insults out of two lexicons. Labels choose voters and the mixture of the sample, nothing else:
no voter and no starting value sees the label of a row.

The label model is generative. Of voters that vote alike (correlation of ALIKE or more) one counts. Voters linked by a
correlation of LINKED or more depend on each other through a hidden cause of their own (one dialect of abuse, say), which is
present in a text or not; a text is toxic if any cause is present. Given its cause, each voter has a rate of voting where it is
present and one where it is absent. Expectation-maximisation estimates the rates, hence accuracies, and how frequent
each cause is, from the votes alone, starting from texts with two votes of a group. A voter without any correlated
one has no accuracy that votes alone could tell, and is left out.

Posteriors become soft labels of a ridge logistic regression on the words and prefixes that go with them.

The fit takes at most SAMPLE labelled rows (half of each label); every row of the table is scored.
Defined results: a null text is scored like an empty one; without labelled rows, or where no voters are correlated, all scores
come from the fixed lexicons alone; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import WIDE, WORD, features
from .linear import SparseModel, labelled_sample, logistic, remainder, score_documents
from .shared import lean

SAMPLE, STEMS, ROUNDS, PENALTY = 6000, 150, 60, 1e-4
#: Log-likelihood ratios from which a stem is a voter and a feature is used by the classifier.
STRONG, USED = 30.0, 12.0
#: Correlations from which two voters count as one, and from which they share a cause; the fewest votes that make a voter.
ALIKE, LINKED, FEWEST = 0.9, 0.2, 3
KINDS, PREFIXES = (WORD,), (4, 5, 6)
#: Lexicon voters.
LEXICONS = {
    "mind": ["idiot", "idiots", "moron", "moronic", "stupid", "dumb", "imbecile", "dummkopf", "idiota", "imbécil", "estúpido", "crétin", "débile", "blöd"],
    "worth": ["worthless", "pathetic", "loser", "losers", "useless", "versager", "wertlos", "perdedor", "inútil", "minable", "nul"],
    "disgust": ["disgusting", "scum", "trash", "garbage", "vermin", "filth", "abschaum", "dreck", "basura", "escoria", "ordure", "racaille"],
    "mockery": ["clown", "clowns", "joke", "freak", "creep", "witzfigur", "payaso", "bouffon"],
}
#: Words of address.
ADDRESS = ["you", "you're", "your", "du", "dich", "ihr", "tu", "vous", "usted", "eres"]
_MARKS = ",.;:!?"


def lexicon_buckets(words: list[str]) -> np.ndarray:
    """The word buckets of a lexicon, with the marks that may follow a word."""
    forms = [w + m for w in words for m in ("", *_MARKS)]
    return np.unique(np.concatenate([b for _, _, _, b in features(pa.array(forms), KINDS, (), WIDE)]))


def _association(a: np.ndarray, c: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio of each feature's counts in toxic (a of n1) and clean rows (c of n0); 0 if it leans to clean."""
    part = lambda x, n, p: x * np.log(np.maximum(x, 1e-9) / np.maximum(n * p, 1e-9)) + (n - x) * np.log(np.maximum(n - x, 1e-9) / np.maximum(n * (1 - p), 1e-9))
    p = (a + c) / (n1 + n0)
    return np.where(a * n0 > c * n1, 2 * (part(a, n1, p) + part(c, n0, p)), 0.0)


def _counts(rows: list[np.ndarray], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of all rows, sorted, and for each the weight of the rows that have it, and of the rest of them."""
    names, at = np.unique(np.concatenate(rows), return_inverse=True)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return names, np.bincount(at, weight[of], len(names)), np.bincount(at, 1 - weight[of], len(names))


def _has(rows: list[np.ndarray], sets: list[np.ndarray]) -> np.ndarray:
    """rows x sets: whether a row has a feature of a set."""
    bucket = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    by = np.argsort(bucket, kind="stable")
    bucket, of = bucket[by], of[by]
    out = np.zeros((len(rows), len(sets)), bool)
    for i, r in enumerate(rows):
        low, high = np.searchsorted(bucket, r), np.searchsorted(bucket, r, "right")
        for a, b in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True):
            out[i, of[a:b]] = True
    return out


def stems(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The features that make voters: the strongest in their association with the label."""
    names, toxic, clean = _counts(rows, labels * 1.0)
    strength = _association(toxic, clean, labels.sum(), (1 - labels).sum())
    best = np.argsort(-strength, kind="stable")[:STEMS]
    return names[best[strength[best] > STRONG]]


def votes(rows: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """rows x voters: lexicon words, ``chosen`` stems, an insult with an address, insults of two kinds."""
    words = [lexicon_buckets([w]) for kind in LEXICONS.values() for w in kind]
    kind = np.repeat(np.arange(len(LEXICONS)), [len(w) for w in LEXICONS.values()])
    seen = _has(rows, [*words, lexicon_buckets(ADDRESS), *chosen[:, None]])
    insult, address, stem = seen[:, : len(words)], seen[:, len(words)], seen[:, len(words) + 1 :]
    kinds = np.stack([insult[:, kind == k].any(1) for k in range(len(LEXICONS))], 1)
    return np.concatenate([insult, stem, (insult.any(1) & address)[:, None], (kinds.sum(1) > 1)[:, None]], 1)


def _correlations(votes: np.ndarray) -> np.ndarray:
    rest = votes - votes.mean(0)
    sd = np.sqrt((rest**2).sum(0)) + 1e-12
    return rest.T @ rest / sd[:, None] / sd


@dataclass
class LabelModel:
    """``voters``: those that count. Of each: its group, its rates of voting without and with the group's cause, its accuracy
    (how often its votes fall on toxic texts); of each group how frequent its cause is."""

    voters: np.ndarray
    group: np.ndarray
    rates: np.ndarray
    accuracy: np.ndarray
    frequent: np.ndarray
    correlations: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability that a row is toxic, from its votes."""
        clean = np.ones(len(votes))
        for g in range(len(self.frequent)):
            mine = self.group == g
            clean *= 1 - _cause(votes[:, self.voters[mine]].astype(float), self.rates[:, mine], self.frequent[g])
        return 1 - clean


def _cause(votes: np.ndarray, rates: np.ndarray, frequent: float) -> np.ndarray:
    absent, present = rates
    total = np.log(frequent / (1 - frequent)) + votes @ np.log(present / absent) + (1 - votes) @ np.log((1 - present) / (1 - absent))
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def label_model(votes: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Groups, rates, accuracies and frequencies from the votes (rows x voters) alone."""
    v = votes.astype(float)
    some = np.flatnonzero(v.sum(0) >= FEWEST)
    corr = _correlations(v[:, some])
    kept: list[int] = []
    for j in np.argsort(-v[:, some].sum(0), kind="stable").tolist():
        if not kept or corr[j, kept].max() < ALIKE:
            kept.append(j)
    kept.sort()
    voters, corr = some[kept], corr[np.ix_(kept, kept)]
    group = np.arange(len(voters))
    while True:  # each voter takes the smallest group that it is linked to
        least = np.where(corr >= LINKED, group[None, :], len(voters)).min(1, initial=len(voters))
        least = np.minimum(least, group)
        if (least == group).all():
            break
        group = least
    names, group, size = np.unique(group, return_inverse=True, return_counts=True)
    linked = size[group] > 1
    voters, corr = voters[linked], corr[np.ix_(linked, linked)]
    _, group = np.unique(group[linked], return_inverse=True)
    groups = int(group.max(initial=-1)) + 1
    rates, frequent, causes = np.zeros((2, len(voters))), np.zeros(groups), []
    for g in range(groups):
        w = v[:, voters[group == g]]
        q = np.where(w.sum(1) >= 2, 0.9, 0.05)
        for _ in range(rounds):
            here = np.stack([((1 - q) @ w + 0.05) / ((1 - q).sum() + 1), (q @ w + 0.2) / (q.sum() + 1)])
            part = float(np.clip(q.mean(), 1e-4, 0.5))
            before, q = q, _cause(w, here, part)
            if np.abs(q - before).max(initial=0) < 1e-4:
                break
        rates[:, group == g], frequent[g] = here, part
        causes.append(q)
    model = LabelModel(voters, group, rates, np.zeros(len(voters)), frequent, corr)
    q = model.posterior(votes)
    model.accuracy = (q @ v[:, voters] + 0.5) / (v[:, voters].sum(0) + 1)
    return model


def _lexicon_model() -> SparseModel:
    keys = lexicon_buckets([w for words in LEXICONS.values() for w in words])
    return SparseModel(keys, np.full(len(keys), 4.0), -2.0, KINDS, PREFIXES)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> SparseModel:
    if len(set(labels.tolist())) < 2:
        return _lexicon_model()
    cast = votes(rows, stems(rows, labels))
    posterior = label_model(cast).posterior(cast)
    if not 0 < (posterior > 0.5).mean() < 1:
        return _lexicon_model()
    toxic, clean = posterior.sum(), (1 - posterior).sum()
    names, with_toxic, with_clean = _counts(rows, posterior)
    used = np.union1d(names[_association(with_toxic, with_clean, toxic, clean) > USED], lexicon_buckets([w for words in LEXICONS.values() for w in words]))
    kept = [np.intersect1d(r, used, assume_unique=True) for r in rows]
    weight = np.where(posterior > 0.5, 0.5 / toxic, 0.5 / clean) * len(rows)
    keys, w, bias = logistic(kept, posterior, weight, PENALTY)
    return SparseModel(keys, w, float(bias), KINDS, PREFIXES)


def toxicity_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> SparseModel:
    """Rows whose crc32(doc_id) mod 5 is 0 are never learnt from."""
    return fit(*labelled_sample(docs, labels, "toxic", remainder("doc_id", 5) != 0, sample, KINDS, PREFIXES, WIDE))


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    return score_documents(docs, toxicity_model(docs, labels, sample), remainder("doc_id", 5) == 0)


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below 0.5."""
    model = docs.sparkSession.sparkContext.broadcast(toxicity_model(docs, labels, sample))

    def run(batches):
        for b in batches:
            clean = [score < 0.5 for _, _, score in model.value.scores(b.column("text"))]
            yield b.filter(pa.array(np.concatenate(clean) if clean else np.zeros(0, bool)))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(lean(run), docs.schema)
