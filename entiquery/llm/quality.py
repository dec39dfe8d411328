"""Quality classifier: a support vector machine on naive Bayes features.

Each n-gram indicator is scaled by its log-count ratio between the classes; rows are brought to unit
length; a linear hinge-loss model is fitted by dual coordinate descent and, as usual for this model, mixed
with its mean absolute weight on all features. A margin m becomes the score 1 / (1 + exp(-SCALE m)).

The fit takes at most SAMPLE labelled rows (half of each label); every row of the table is scored.
Defined results: a null text is scored like an empty one; without labelled rows, or with one class only,
all scores are 0.5 or that class; repeated rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .features import BUCKETS, PAIR, REPEAT, SHAPE, WORD
from .linear import Model, dual_coordinate_descent, labelled_sample, remainder, score_documents

SAMPLE, COST, EPOCHS, MIX, SMOOTH, SCALE = 6000, 1.0, 6, 0.25, 1.0, 6.0
KINDS = (WORD, PAIR, SHAPE, REPEAT)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    if len(set(labels.tolist())) < 2:
        bias = 0.0 if not len(labels) else (1.0 if labels[0] else -1.0)
        return Model(np.zeros(BUCKETS, np.float32), bias, SCALE, None, KINDS)
    counts = [np.full(BUCKETS, SMOOTH) for _ in range(2)]
    for r, label in zip(rows, labels, strict=True):
        counts[label][r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[(counts[0] + counts[1]) <= 2 * SMOOTH] = 0  # never seen in the sample: says nothing
    values = [ratio[r] for r in rows]
    length = np.array([np.sqrt(x @ x + 1) for x in values])
    values = [x / n for x, n in zip(values, length, strict=True)]
    y = 2.0 * labels - 1
    cost = COST * np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
    w, bias = dual_coordinate_descent(rows, values, 1 / length, y, cost, EPOCHS)
    seen = ratio != 0
    mean = np.abs(w[seen]).mean() if seen.any() else 0.0
    w = w + MIX * mean * seen
    return Model((w * ratio).astype(np.float32), float(bias), SCALE, (ratio**2).astype(np.float32), KINDS)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted); rows whose crc32(doc_id) mod 3 is 1 are never learnt from."""
    rows, y = labelled_sample(docs, labels, "quality", remainder("doc_id", 3) != 1, sample, KINDS)
    return score_documents(docs, fit(rows, y), remainder("doc_id", 3) == 1)
