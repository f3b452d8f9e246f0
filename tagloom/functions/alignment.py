"""Look-alike substitutions in an edit alignment."""

from __future__ import annotations

from tagloom.config import CONFUSABLE_PAIRS

_LOOKALIKES = frozenset("".join(CONFUSABLE_PAIRS))


def confusion_pairs(prediction: str, truth: str) -> list[tuple[str, str]]:
    """(true, predicted) of each substitution of one look-alike character by another, in order.

    The alignment turns the truth into the prediction and is read back from the ends; of equally good steps a
    deletion comes first, then a match or substitution, then an insertion.
    """
    n, m = len(truth), len(prediction)
    cost = [[i + j for j in range(m + 1)] if not i else [i] + [0] * m for i in range(n + 1)]
    for i, t in enumerate(truth, 1):
        for j, p in enumerate(prediction, 1):
            cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (t != p))
    out, i, j = [], n, m
    while i or j:
        if i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
        elif i and j and cost[i][j] == cost[i - 1][j - 1] + (truth[i - 1] != prediction[j - 1]):
            i, j = i - 1, j - 1
            if truth[i] != prediction[j] and truth[i] in _LOOKALIKES and prediction[j] in _LOOKALIKES:
                out.append((truth[i], prediction[j]))
        else:
            j -= 1
    return out[::-1]
