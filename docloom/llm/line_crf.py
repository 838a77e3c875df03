"""A linear-chain conditional random field over the lines of a document, with two states: good (1) and bad (0).

Emissions are linear in the features of a line and of its two neighbours; transitions are a 2 x 2 table. It is fitted by gradient
ascent on the conditional likelihood of a bounded labelled sample. Documents carry labels, lines don't: every line of a
good document is taken as good; in a bad document a logistic model first tells which lines look like those of good ones.

All routines run over many chains at once: step t handles the t-th line of every chain that has one, so a chain may be as
long as it likes and needs memory in proportion to its lines only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Character classes of a UTF-8 byte.
LOWER, UPPER, DIGIT, SPACE, SYMBOL, STOP, MARK, OTHER, LEAD, TAIL = range(10)
CLASSES = 10
CUES = ("license", "licence", "copyright", "all rights reserved", "cookie", "subscribe", "click here", "terms of", "privacy policy")


def _byte_classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for chars, cls in (("abcdefghijklmnopqrstuvwxyz", LOWER), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), ("0123456789", DIGIT), (" \t\r\v\f\n", SPACE), ("#*$%&|<>", SYMBOL), (".,;:", STOP), ("!?", MARK)):
        out[[ord(c) for c in chars]] = cls
    out[0x80:0xC0], out[0xC0:] = TAIL, LEAD
    return out


BYTE_CLASS = _byte_classes()
#: Bytes that are counted in one go.
PART = 1 << 20
OWN = 18
#: Own features, those of the previous and of the next line, first and last flags.
FEATURES = 3 * OWN + 2


@dataclass
class Lines:
    """Lines of some documents: x[line, feature], start[document] (one more at the end), chars[line] in code points."""

    x: np.ndarray
    start: np.ndarray
    chars: np.ndarray


def lines_of(texts: list[str]) -> Lines:
    """Features of every line of every text. An empty text is one empty line."""
    split = [t.split("\n") for t in texts]
    start = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
    n = int(start[-1])
    data = "\n".join(texts).encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    ends = np.append(np.flatnonzero(raw == 10), len(raw))
    begins = np.append(0, ends[:-1] + 1)
    size = ends - begins
    counts, line = np.zeros((n, CLASSES)), 0
    for at in range(0, len(raw), PART):
        part = raw[at : at + PART]
        feeds = part == 10
        of = np.cumsum(feeds) - feeds
        k = int(of[-1]) + 1
        counts[line : line + k] += np.bincount(of * CLASSES + BYTE_CLASS[part], minlength=k * CLASSES).reshape(k, CLASSES)
        line += int(feeds.sum())
    counts[: n - 1, SPACE] -= 1  # the line feeds themselves
    words, distinct, again, dup, cue = (np.zeros(n) for _ in range(5))
    at = 0
    for lines in split:
        seen: set[str] = set()
        for line in lines:
            w = line.split()
            words[at], distinct[at] = len(w), len(set(w))
            if len(w) - distinct[at] > 2:
                again[at] = sum(a == b for a, b in zip(w, w[1:]))
            if w:
                dup[at] = line in seen
                seen.add(line)
                if len(w) < 40:
                    low = line.lower()
                    cue[at] = any(c in low for c in CUES)
            at += 1
    chars = size - counts[:, TAIL]
    total, some = np.maximum(chars, 1), np.maximum(words, 1)
    letters = np.maximum(counts[:, LOWER] + counts[:, UPPER] + counts[:, LEAD], 1)
    last = raw[np.maximum(ends - 1, 0)] if len(raw) else np.zeros(n, np.uint8)
    own = np.stack([
        np.log1p(chars) / 8, np.log1p(words) / 6, counts[:, UPPER] / letters, counts[:, DIGIT] / total, np.minimum(5 * counts[:, SYMBOL] / total, 1), np.minimum(8 * counts[:, MARK] / total, 1),
        counts[:, STOP] / some, counts[:, OTHER] / some, counts[:, LEAD] / total, counts[:, SPACE] / total, np.minimum(chars / some / 20, 1), distinct / some * (words > 0), np.minimum(2 * again / some, 1),
        words == 0, words < 4, dup, cue, np.isin(last, np.frombuffer(b".!?", np.uint8)) & (size > 0),
    ], axis=1)
    x = np.zeros((n, FEATURES))
    x[:, :OWN] = own
    first, final = start[:-1], start[1:] - 1
    x[1:, OWN : 2 * OWN], x[: n - 1, 2 * OWN : 3 * OWN] = own[:-1], own[1:]
    x[first, OWN : 2 * OWN], x[final, 2 * OWN : 3 * OWN] = 0, 0
    x[first, -2], x[final, -1] = 1, 1
    return Lines(x, start, chars)


@dataclass
class Crf:
    """w and b give a line's log-odds of good; moves[i, j] scores state j after state i; a and c calibrate a document's share."""

    w: np.ndarray
    b: float
    moves: np.ndarray
    calibration: np.ndarray

    def node(self, lines: Lines) -> np.ndarray:
        return lines.x @ self.w + self.b


def _order(start: np.ndarray):
    """Chains from the longest down, and for each step how many are still going."""
    length = np.diff(start)
    order = np.argsort(-length, kind="stable")
    steps = int(length.max(initial=0))
    going = len(length) - np.searchsorted(np.sort(length), np.arange(steps), side="right")
    return start[:-1][order], going


def marginals(node: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward: P(good) of each line, the expected number of each move, and the sum of log partition functions."""
    first, going = _order(start)
    emit = np.stack([np.zeros_like(node), node], axis=1)
    alpha, beta = emit.copy(), np.zeros_like(emit)
    for t in range(1, len(going)):
        at = first[: going[t]] + t
        alpha[at] += np.logaddexp(alpha[at - 1, 0][:, None] + moves[0], alpha[at - 1, 1][:, None] + moves[1])
    for t in range(len(going) - 1, 0, -1):
        at = first[: going[t]] + t
        after = emit[at] + beta[at]
        beta[at - 1] = np.logaddexp(moves[:, 0] + after[:, :1], moves[:, 1] + after[:, 1:])
    log_z = np.logaddexp(alpha[:, 0] + beta[:, 0], alpha[:, 1] + beta[:, 1])
    good = np.exp(alpha[:, 1] + beta[:, 1] - log_z)
    inner = np.ones(len(node), bool)
    inner[start[:-1]] = False
    at = np.flatnonzero(inner)
    pair = np.exp(alpha[at - 1][:, :, None] + moves + (emit[at] + beta[at])[:, None, :] - log_z[at][:, None, None])
    return good, pair.sum(axis=0), float(log_z[start[:-1]].sum())


def viterbi(node: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The likeliest state of every line; a tie goes to good."""
    first, going = _order(start)
    best = np.stack([np.zeros_like(node), node], axis=1)
    back = np.zeros(best.shape, np.int8)
    for t in range(1, len(going)):
        at = first[: going[t]] + t
        ways = best[at - 1][:, :, None] + moves
        back[at] = ways[:, 1] >= ways[:, 0]
        best[at] += ways.max(axis=1)
    state = (best[:, 1] >= best[:, 0]).astype(np.int8)
    for t in range(len(going) - 1, 0, -1):
        at = first[: going[t]] + t
        state[at - 1] = back[at, state[at]]
    return state


def weighted_share(good: np.ndarray, lines: Lines) -> np.ndarray:
    """For each document the mean over lines, weighted by their code points (an empty line weighs as one)."""
    weight = np.maximum(lines.chars, 1.0)
    return np.add.reduceat(good * weight, lines.start[:-1]) / np.add.reduceat(weight, lines.start[:-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Newton's method; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], labels: list[int], ridge: float = 1.0, rounds: int = 150) -> Crf:
    """Fit to labelled documents. With fewer than two classes every line leans to the class there is (none: good)."""
    y_doc = np.asarray(labels, float)
    if len(y_doc) == 0 or y_doc.min() == y_doc.max():
        lean = 3.0 if len(y_doc) == 0 or y_doc[0] == 1 else -3.0
        return Crf(np.zeros(FEATURES), lean, np.zeros((2, 2)), np.array([4.0, -2.0]))
    lines = lines_of(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(lines.start))
    share = np.maximum(lines.chars, 1.0)
    share /= np.add.reduceat(share, lines.start[:-1])[doc]  # a document's lines weigh 1 together
    const = np.column_stack([lines.x, np.ones(len(doc))])
    flat = _logistic(const, y_doc[doc], share, ridge)
    # Lines of bad documents that look good are good; the worst one of each stays bad.
    odds = const @ flat
    worst = np.minimum.reduceat(odds, lines.start[:-1])[doc]
    y = np.where(y_doc[doc] == 1, 1.0, (odds > 1.0) & (odds > worst))
    w, b, moves = flat[:-1].copy(), float(flat[-1]), np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[lines.start[:-1]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    theta = np.concatenate([w, [b], moves.ravel()])
    mean, var, n = np.zeros_like(theta), np.zeros_like(theta), len(y)
    for k in range(1, rounds + 1):  # Adam on the conditional likelihood
        w, b, moves = theta[:FEATURES], theta[FEATURES], theta[FEATURES + 1 :].reshape(2, 2)
        good, expected, _ = marginals(lines.x @ w + b, moves, lines.start)
        gap = y - good
        grad = np.concatenate([lines.x.T @ gap - ridge * w, [gap.sum()], (seen - expected).ravel() - ridge * moves.ravel()]) / n
        mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        theta = theta + 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(var / (1 - 0.99**k)) + 1e-8)
    w, b, moves = theta[:FEATURES].copy(), float(theta[FEATURES]), theta[FEATURES + 1 :].reshape(2, 2).copy()
    good, _, _ = marginals(lines.x @ w + b, moves, lines.start)
    s = weighted_share(good, lines)
    calibration = _logistic(np.column_stack([s, np.ones(len(s))]), y_doc, np.ones(len(s)), 0.01)
    return Crf(w, b, moves, calibration)


def document_scores(model: Crf, texts: list[str]) -> np.ndarray:
    """Quality from 0 to 1 of each text: forward-backward marginals, weighted by length, then calibrated."""
    lines = lines_of(texts)
    good, _, _ = marginals(model.node(lines), model.moves, lines.start)
    z = model.calibration[0] * weighted_share(good, lines) + model.calibration[1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def content_shares(model: Crf, texts: list[str]) -> np.ndarray:
    """Share of each text's code points that Viterbi puts in content lines."""
    lines = lines_of(texts)
    return weighted_share(viterbi(model.node(lines), model.moves, lines.start).astype(float), lines)
