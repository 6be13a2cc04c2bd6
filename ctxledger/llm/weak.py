"""Weak supervision: labellers vote or abstain, expectation-maximisation weighs them.

A vote is 1 (good), -1 (bad) or 0 (abstains). Documents enter the fit only as
counts of their vote patterns, at most 3**m rows for m labellers whatever the
corpus size, so the fit sees every document and the driver a bounded table.
"""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 3**MOST patterns is the bound of what is gathered and broadcast.
MOST = 10


#: Where the fit starts, and what its pseudo-counts say: P(bad vote | bad), P(bad vote | good), each of a labeller that votes; P(good).
BELIEF = (0.3, 0.05, 0.85)
#: Pseudo-documents behind each of these beliefs; a constant, so that data outweigh them.
STRENGTH = 10.0


@dataclasses.dataclass
class VoteModel:
    """Class prior P(good) and each labeller's P(bad vote | it votes, class), columns class bad, good."""

    prior: float
    rates: np.ndarray  # (labellers, 2)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good | votes) for rows of votes; an abstention says nothing."""
        bad = np.log(self.rates[:, 1] / self.rates[:, 0])
        good = np.log((1 - self.rates[:, 1]) / (1 - self.rates[:, 0]))
        odds = np.log(self.prior / (1 - self.prior)) + (votes < 0) @ bad + (votes > 0) @ good
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracies(self) -> np.ndarray:
        """P(a vote is right | class) of each labeller, columns class bad, good."""
        return np.stack([self.rates[:, 0], 1 - self.rates[:, 1]], axis=1)


def fit_votes(votes: np.ndarray, counts: np.ndarray, rounds: int = 1000) -> VoteModel:
    """Maximum a posteriori fit by expectation-maximisation on distinct vote patterns.

    Given the class, votes are independent. The E-step takes each pattern's
    posterior, the M-step each labeller's share of bad votes among the votes it casts
    in either class, and the share of good documents. ``STRENGTH`` pseudo-documents
    hold ``BELIEF``: they fix which class is which and give a defined result on an
    empty table. A labeller that cries bad alone, where the others agree on good,
    is found to be wrong there and outvoted; labellers that agree on bad are believed.
    """
    m = votes.shape[1]
    bad, voted = (votes < 0).astype(float), (votes != 0).astype(float)
    believed = np.array(BELIEF[:2])
    model = VoteModel(BELIEF[2], np.repeat(believed[None], m, axis=0))
    good = model.posterior(votes)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])  # (class, pattern)
        rates = (weight @ bad + STRENGTH * believed[:, None]) / (weight @ voted + STRENGTH)
        model = VoteModel(float((weight[1].sum() + STRENGTH * BELIEF[2]) / (counts.sum() + STRENGTH)), rates.T)
        new = model.posterior(votes)
        if np.abs(new - good).max(initial=0.0) < 1e-9:
            break
        good = new
    return model


def pattern(votes: list[Column]) -> Column:
    """Votes as one base-3 number."""
    code = F.lit(0)
    for v in votes:
        code = code * 3 + (F.coalesce(v, F.lit(0)) + 1)
    return code.cast("long")


def unpack(codes: np.ndarray, m: int) -> np.ndarray:
    return np.stack([(codes // 3 ** (m - 1 - j)) % 3 - 1 for j in range(m)], axis=1).astype(np.int64)


def label(votes: DataFrame, m: int) -> tuple[DataFrame, VoteModel, dict[int, tuple[int, float]]]:
    """``votes`` (with a column pattern of m votes) plus its column posterior; the model; {pattern: (documents, posterior)}."""
    if m > MOST:
        raise ValueError(f"at most {MOST} labellers")
    rows = votes.groupBy("pattern").count().collect()  # at most 3**MOST rows
    codes = np.array(sorted(r["pattern"] for r in rows), np.int64)
    by = {r["pattern"]: r["count"] for r in rows}
    counts = np.array([by[c] for c in codes.tolist()], float)
    model = fit_votes(unpack(codes, m), counts)
    good = model.posterior(unpack(codes, m)) if len(codes) else np.zeros(0)
    found = {int(c): (int(n), float(p)) for c, n, p in zip(codes, counts, good, strict=True)}
    spark = votes.sparkSession
    lookup = spark.createDataFrame([(c, p) for c, (_, p) in found.items()], "pattern long, posterior double")
    return votes.join(F.broadcast(lookup), "pattern"), model, found
