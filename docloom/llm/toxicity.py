"""Toxicity: a support vector machine over a gap-weighted subsequence string kernel, with Nyström landmarks.

The kernel compares two words by the subsequences of three and of four letters that they share; each counts L ** span, where the span is the distance from its
first to its last letter in the text, so gaps and inserted characters weaken a match but don't break it. A subsequence reaches
over REACH letters at most. Words are folded first (lower case, composed, digits that stand for letters), a mark before the first letter and one after the last
count as letters, and characters that are no letters keep their places as gaps. Letters of every alphabet, with their accents, are told apart:
a subsequence is hashed from its code points to one of BUCKETS numbers. A run of single characters ("i d i o t") is read as one word.

Nyström: k(x, landmarks) times the inverse root of the landmarks' own kernel matrix is the feature vector of x, and a linear
support vector machine is trained on it. Its decision is linear in the subsequences of x, so after training the landmarks are folded into one
weight for each bucket; scoring gives the same numbers as evaluating the kernel against every landmark.

Training: labelled documents are cut into sentences, which take over their document's label. A word costs as much on the toxic side as there are toxic
sentences with it and as much on the clean side as there are clean ones, so its decision nears the difference of the two shares. In the next round a
sentence of a toxic document counts as clean if no word in it is on the toxic side, unless it is the document's worst. Copies of surely toxic
words with a letter put in are learnt too, so that altered insults are found. A document's score follows from how its worst words go beyond
what chance finds in clean texts of as many words: one sure insult, or several words each of which a clean document may well have. Some labelled
documents are kept back from the machine for this calibration.

Nulls and edge cases: a null or empty text, or one without letters, has no word and gets the score of a clean one; a null doc_id is kept and
counts as held out; repeated rows are scored each on their own; equal decisions are interchangeable, and worst_word is the least of the worst; an
empty table gives an empty result; input columns stay in the struct `row`. Nothing is shuffled; a worker remembers a bounded number of words.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, labelled_sample, map_texts, packed

#: The fit reads at most so many labelled documents, each of at most so many bytes. Scoring has no such bounds.
FIT_ROWS, FIT_BYTES = 3500, 65536
DECAY = 0.8
REACH = 4
LENGTHS = (3, 4)
BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
LANDMARKS = 400
#: Strength of the machine's penalty.
RIDGE = 0.3
#: Words of few sentences from which the fit draws, beside all that are in more.
RARE = 15_000
#: Costs of the toxic side against the clean one.
BALANCE = 5.0
#: A word of no clean sentence is taken as surely toxic if so many toxic ones have it.
CERTAIN = 5
#: So many letters, beside the doubled one, are put in at each inner place of such a word.
SURE_LETTERS = 4
#: Altered words that a round learns at most, and altered documents that the calibration sees.
ALTERED = 6_000
#: An altered form costs its word's costs divided by this.
ALTERED_SHARE = 1.0
#: The worst words of a document that make its score.
WORST = 8
#: One labelled document in so many is kept for the calibration.
KEPT_BACK = 4
#: Decisions at which shares of clean words are kept.
LEVELS = np.linspace(-1.0, 1.25, 226)
#: What the calibration's documents with one altered insult weigh, against those that are toxic. With DECAY, chosen on folds of the rows that may be learnt from: of the settings that
#: caught 0.91 of insults with a letter inserted, the one that flagged the fewest clean documents.
PUT_IN = 0.55
#: A longer word is read in overlapping pieces of this length; the worst one counts.
PIECE = 24
REMEMBER = 300_000

# Digits and signs that stand for letters inside a word.
STAND_INS = str.maketrans("013457@$", "oieastas")
_LETTER, _OTHER = re.compile(r"[^\W\d_]"), re.compile(r"[\W\d_]")
_RUN = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def fold(word: str) -> str:
    """Letters in lower case, and a blank for any other character."""
    word = word.lower()
    if word.isascii() and word.isalpha():
        return word
    if not word.isascii():
        word = unicodedata.normalize("NFC", word)
    if _LETTER.search(word):
        word = word.translate(STAND_INS)
    return _OTHER.sub(" ", word).strip()


def units(text: str) -> set[str]:
    """The distinct words of a text as they stand, and runs of single characters as one word."""
    found = set(text.split())
    if _RUN.search(text):
        found.update(m.replace("\t", " ") for m in _RUN.findall(text))
    return found


def _buckets(letters: list[np.ndarray]) -> np.ndarray:
    """The bucket of each sequence of code points (unsigned 32-bit), one array for each place in it."""
    with np.errstate(over="ignore"):
        h = np.full_like(letters[0], len(letters))
        for x in letters:
            h = (h ^ x) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        return (h * np.uint32(0x85EBCA6B) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket, weight) of all subsequences of folded words with their marks; a pair occurs as often as it is found."""
    letters = ["<" + w.replace(" ", "") + ">" for w in words]
    out: list[tuple] = []
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(letters):
        if len(w) >= 4:
            by_length.setdefault(len(w), []).append(i)
    for n, index in by_length.items():
        raw = np.frombuffer("".join(letters[i] for i in index).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        place = np.tile(np.arange(n, dtype=np.int32), (len(index), 1))
        for k, i in enumerate(index):
            if " " in words[i]:
                at = [p + 1 for p, c in enumerate(words[i]) if c != " "]
                place[k] = [at[0] - 1, *at, at[-1] + 1]
        for size in LENGTHS:
            picked = [(a, *rest) for a in range(n) for rest in itertools.combinations(range(a + 1, min(a + REACH + 1, n)), size - 1)]
            if picked:
                at = np.array(picked).T
                weight = DECAY ** (place[:, at[-1]] - place[:, at[0]] + 1.0)
                out.append((np.repeat(np.array(index), len(picked)), _buckets([raw[:, i] for i in at]).ravel(), weight.ravel()))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def profile(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As codes(), each pair once, with weights of length 1 for each word: dot products of profiles are normalised kernel values."""
    word, code, weight = codes(words)
    key, at = np.unique(word.astype(np.int64) * BUCKETS + code, return_inverse=True)
    total = np.bincount(at, weights=weight, minlength=len(key))
    word, code = key // BUCKETS, key % BUCKETS
    norm = np.sqrt(np.bincount(word, weights=total**2, minlength=len(words)))
    return word, code, total / norm[word]


def pieces(word: str) -> list[str]:
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


@dataclass
class Machine:
    """weights[bucket] and bias make a word's decision; calibration turns the evidence of a document's worst words into a probability, tail the share of clean words at each of LEVELS."""

    weights: np.ndarray
    bias: float
    tail: np.ndarray
    calibration: np.ndarray

    def decisions(self, words: list[str]) -> np.ndarray:
        """Of folded words; the worst piece of a long one. A word of fewer than two letters has the bias."""
        flat = [(i, p) for i, w in enumerate(words) for p in pieces(w)]
        word, code, weight = profile([p for _, p in flat])
        value = np.bincount(word, weights=weight * self.weights[code], minlength=len(flat))
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, np.array([i for i, _ in flat], np.int64), value)
        return np.where(np.isfinite(out), out, 0) + self.bias

    def probability(self, worst: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of documents, from rows of their WORST worst decisions and their numbers of distinct words."""
        z = evidence(worst, size, self.tail) @ self.calibration[:-1] + self.calibration[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def evidence(worst: np.ndarray, size: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Of documents: how far their worst words go beyond what chance finds in a clean text of as many words.

    tail[i] is the log share of clean documents' words from LEVELS[i] on. k words from a level on, where e are expected, have a chance of about
    e ** k / k!; minus its log counts, for the number k of worst words that makes it greatest, and for the worst word alone.
    """
    k = np.arange(1, WORST + 1)
    level = np.clip(np.searchsorted(LEVELS, worst, side="right") - 1, 0, len(LEVELS) - 1)
    expected = np.log(np.maximum(size, 1))[:, None] + tail[level]
    surprise = np.cumsum(np.log(k)) - k * expected
    return np.column_stack([np.maximum(surprise.max(axis=1), 0), np.maximum(surprise[:, 0], 0)])


def _tail(decisions: np.ndarray) -> np.ndarray:
    """The log share of decisions from each of LEVELS on; one that none reaches counts as a tenth of one."""
    above = len(decisions) - np.searchsorted(np.sort(decisions), LEVELS, side="left")
    return np.log((above + 0.1) / (len(decisions) + 0.1))


def _spread(words: list[str], ranked: np.ndarray, n: int, near: float = 0.4, crowd: int = 12, tried: int = 4000) -> np.ndarray:
    """Up to n of ranked, from the first on, of which no more than `crowd` are near each other: every kind of insult gets landmarks, however rare it is."""
    table = np.zeros((BUCKETS, n), np.float32)
    taken: list[int] = []
    for i in ranked[:tried].tolist():
        if len(taken) == n:
            break
        _, code, weight = profile([words[i]])
        if len(code) and (weight @ table[code, : len(taken)] > near).sum() < crowd:
            table[code, len(taken)] = weight
            taken.append(i)
    return np.array(taken, np.int64)


def _features(words: list[str], table: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Normalised kernel of words with the landmarks whose profiles are the columns of table, times root, and a last column of ones."""
    out = np.zeros((len(words), table.shape[1] + 1), np.float32)
    for at in range(0, len(words), 1000):
        word, code, weight = profile(words[at : at + 1000])
        if len(word):
            first = np.flatnonzero(np.append(True, np.diff(word) > 0))
            out[at + word[first], :-1] = np.add.reduceat(weight[:, None].astype(np.float32) * table[code], first, axis=0) @ root
    out[:, -1] = 1
    return out


def _linear_svm(x: np.ndarray, cost: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine in the primal, by Newton steps over the active rows, some at a time.

    Each row stands on both sides, toxic at cost[:, 0] and clean at cost[:, 1]; x ends with a column of ones.
    """
    w, ridge = np.zeros(x.shape[1]), RIDGE * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        left, right = ridge.copy(), np.zeros(x.shape[1])
        for at in range(0, len(x), 4000):
            part = x[at : at + 4000].astype(np.float64)
            z = part @ w
            for side, y in ((0, 1.0), (1, -1.0)):
                c = cost[at : at + 4000, side] * (y * z < 1)
                left += (part * c[:, None]).T @ part
                right += part.T @ (c * y)
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def _harmless() -> Machine:
    return Machine(np.zeros(BUCKETS), -0.9, np.zeros(len(LEVELS)), np.array([1.0, 0.0, -3.0]))


def _top(decisions: np.ndarray, bias: float) -> np.ndarray:
    """The WORST greatest decisions, from the worst on; what is missing has the bias."""
    top = np.sort(decisions)[::-1][:WORST]
    return np.append(top, np.full(WORST - len(top), bias))


def train(texts: list[str], labels: list[int], landmarks: int = LANDMARKS, rounds: int = 2) -> Machine:
    """Fit to labelled documents. Without toxic ones (or without clean ones) nothing can be learnt and every word is clean."""
    y = np.asarray(labels, int)
    if len(y) == 0 or y.min() == y.max():
        return _harmless()
    kept = _distinct(texts)
    texts, y = [texts[i] for i in kept], y[kept]
    held = np.arange(len(y)) % KEPT_BACK == KEPT_BACK - 1
    kept_back, y_back = [t for t, h in zip(texts, held) if h], y[held]
    texts, y = [t for t, h in zip(texts, held) if not h], y[~held]
    number: dict[str, int] = {}
    folded: dict[str, list[int]] = {}
    doc_of, sentences = [], []
    for d, text in enumerate(texts):
        for sentence in _SENTENCE.split(text):
            ids: set[int] = set()
            for u in sorted(units(sentence)):  # words get their numbers in one order in every process
                if (known := folded.get(u)) is None:
                    known = folded[u] = [number.setdefault(f, len(number)) for f in pieces(fold(u)) if len(f.replace(" ", "")) >= 2]
                ids.update(known)
            if ids:
                doc_of.append(d)
                sentences.append(np.array(sorted(ids), np.int64))
    del folded
    words = list(number)
    if not words:
        return _harmless()
    size = np.array([len(s) for s in sentences])
    flat, owner = np.concatenate(sentences), np.repeat(np.arange(len(sentences)), size)
    first, doc_of = np.cumsum(size) - size, np.array(doc_of)
    of_toxic = y[doc_of] == 1
    toxic, rng, decision = of_toxic.copy(), np.random.default_rng(7), None
    machine, hard = _harmless(), np.zeros(0, np.int64)
    for _ in range(rounds):
        a = np.bincount(flat[toxic[owner]], minlength=len(words)).astype(float)
        b = np.bincount(flat[~toxic[owner]], minlength=len(words)).astype(float)
        lift = np.log((a + 0.5) / (toxic.sum() + 1)) - np.log((b + 0.5) / ((~toxic).sum() + 1))
        gain = a * np.maximum(lift, 0)
        certain = np.flatnonzero((a >= CERTAIN) & (b == 0))
        certain = certain[np.argsort(-a[certain], kind="stable")]
        often = np.flatnonzero((a >= 2) | (b >= 3))
        rare = np.setdiff1d(np.arange(len(words)), often)
        drawn = rng.choice(rare, min(RARE, len(rare)), replace=False)
        rows = np.concatenate([often, drawn])
        scale = np.repeat([1.0, len(rare) / max(1, len(drawn))], [len(often), len(drawn)])
        suspects = _spread(words, np.argsort(-gain, kind="stable")[: int((gain > 0).sum())], landmarks // 2)
        if not len(suspects):
            break
        # Clean landmarks: those that the round before found most toxic, and others as often as they occur.
        clean = np.flatnonzero((b > 0) & (lift <= 0))
        worst_clean = clean[np.argsort(-decision[clean], kind="stable")[: landmarks // 8]] if decision is not None else clean[:0]
        hard = np.union1d(hard, worst_clean).astype(np.int64)
        drawn_clean = rng.choice(clean, min(landmarks // 4, len(clean)), replace=False, p=b[clean] / b[clean].sum()) if len(clean) else clean
        marks = np.unique(np.concatenate([suspects, hard, drawn_clean]))
        # Altered forms of surely toxic words.
        altered, cost = [], []
        for i in certain:
            forms = _altered(words[i], rng, SURE_LETTERS)
            if len(altered) + len(forms) > ALTERED:
                break
            altered += forms
            cost += [a[i] / ALTERED_SHARE] * len(forms)
        cost = np.array(cost)
        extra = [altered[i] for i in rng.choice(len(altered), min(landmarks // 4, len(altered)), replace=False, p=cost / cost.sum())] if altered else []
        table = np.zeros((BUCKETS, len(marks) + len(extra)), np.float32)
        word, code, weight = profile([*(words[i] for i in marks), *extra])
        table[code, word] = weight
        value, vector = np.linalg.eigh((table.T @ table).astype(np.float64))
        root = (vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T  # inverse root of the landmarks' kernel matrix
        x = _features([*(words[i] for i in rows), *altered], table, root.astype(np.float32))
        sides = np.concatenate([np.stack([BALANCE * a[rows] * scale, b[rows] * scale], axis=1), np.stack([BALANCE * cost, 0 * cost], axis=1)])
        w, bias = _linear_svm(x, sides)
        machine = Machine(table @ (root @ w), bias, machine.tail, machine.calibration)
        decision = np.concatenate([machine.decisions(words[i : i + 20_000]) for i in range(0, len(words), 20_000)])
        # A sentence's decision is that of its worst word.
        of_sentence = np.maximum.reduceat(decision[flat], first)
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, doc_of, of_sentence)
        toxic = of_toxic & ((of_sentence > 0) | (of_sentence == best[doc_of]))
    if decision is None:
        return machine
    # Calibration sees documents whose labels the machine hasn't seen, and clean ones with one altered insult.
    scorer = Scorer(machine)
    worst, size = scorer.worst(kept_back), scorer.sizes
    of_clean = [machine.decisions([fold(w) for w in units(t)]) for t, k in zip(kept_back, y_back) if k == 0]
    machine.tail = _tail(np.concatenate([*of_clean, np.full(1, machine.bias)]))
    more, weight = np.zeros(0, np.int64), np.zeros(0)
    if altered and (plain := np.flatnonzero(y_back == 0)).size:
        more = rng.choice(plain, len(altered))
        added = np.column_stack([machine.decisions(altered), worst[more, : WORST - 1]])
        worst, size = np.concatenate([worst, np.sort(added, axis=1)[:, ::-1]]), np.concatenate([size, size[more] + 1])
        weight = PUT_IN * cost * max(1, (y_back == 1).sum()) / cost.sum()
    target = np.concatenate([y_back, np.ones(len(more), int)])
    if len(target) and target.min() < target.max():
        machine.calibration = _platt(evidence(worst, size, machine.tail), target, np.concatenate([np.ones(len(y_back)), weight]))
    return machine


def _distinct(texts: list[str], sketches: int = 2) -> list[int]:
    """Training rows without near copies, which would make one document's words look frequent: one of each equal least shingle hash."""
    seen, kept = set(), []
    for i, t in enumerate(texts):
        w = t.lower().split()
        shingles = {" ".join(w[k : k + 3]).encode() for k in range(max(1, len(w) - 2))}
        keys = {(s, min(zlib.crc32(x, s * 0x9E3779B1 & 0xFFFFFFFF) * 0x85EBCA6B & 0xFFFFFFFF for x in shingles)) for s in range(1, sketches + 1)}
        if not keys & seen:
            kept.append(i)
        seen |= keys
    return kept


def _altered(word: str, rng: np.random.Generator, letters: int) -> list[str]:
    """A word with its letter doubled and with so many other letters put in, each alone, at every inner place."""
    out = []
    for at in range(1, len(word)):
        put = [chr(97 + int(c)) for c in rng.choice(26, letters, replace=False)]
        out += [word[:at] + c + word[at:] for c in dict.fromkeys([word[at - 1], *put])]
    return out


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic calibration of weighted rows with softened targets, by Newton's method; the constant is last."""
    up, down = (weight * y).sum(), (weight * (1 - y)).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], 0.1), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (t - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    slope = w[:-1] / spread
    return np.append(slope, w[-1] - slope @ middle)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Machine:
    """Train on a bounded sample of the labelled rows that aren't held out."""
    return train(*labelled_sample(docs, labels, "toxic", fit_rows, fit_bytes))


class Scorer:
    """A machine in a worker, with a bounded memory of the words it has judged."""

    def __init__(self, machine: Machine):
        self.machine, self.young, self.old, self.words, self.sizes = machine, {}, {}, [], np.zeros(0)

    def worst(self, texts: list[str]) -> np.ndarray:
        """The WORST worst decisions of each text; what is missing has the bias."""
        bags = [units(t) for t in texts]
        young, old, missing, bias = self.young, self.old, [], self.machine.bias
        for w in set().union(*bags):
            if w not in young:
                if (d := old.get(w)) is not None:
                    young[w] = d
                else:
                    missing.append(w)
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            young.update(zip(part, self.machine.decisions([fold(w) for w in part]).tolist()))
        found = [heapq.nlargest(WORST, map(young.__getitem__, b)) for b in bags]
        self.sizes = np.array([len(b) for b in bags], float)
        self.words = [min(w for w in b if young[w] == d[0]) if d and d[0] > 0 else "" for b, d in zip(bags, found)]
        if len(young) > REMEMBER:
            self.old, self.young = {w: d for w, d in young.items() if len(w) <= 64}, {}
        return np.array([d + [bias] * (WORST - len(d)) for d in found]).reshape(len(texts), WORST)


_SCORERS: dict[str, Scorer] = {}

ADDED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("worst_word", T.StringType())])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """row, doc_id, held_out, score (0 to 1), predicted (1 from 0.7 on) and worst_word ('' unless one is on the toxic side) for every row of docs."""
    key = hashlib.sha256(machine.weights.tobytes() + repr((machine.bias, machine.tail.tolist(), machine.calibration.tolist())).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # BUCKETS numbers

    def compute(texts: list[str]) -> dict:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        scorer = _SCORERS[key]
        return {"score": scorer.machine.probability(scorer.worst(texts), scorer.sizes), "worst_word": scorer.words}

    out = map_texts(packed(docs), compute, ADDED, ("row", "doc_id"))
    return out.select("row", "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "worst_word")
