"""Toxicity: a support vector machine over a gap-weighted subsequence kernel, with Nyström landmarks.

Examples are the sentences of labelled documents, each with its document's label, learnt as bags of windows (multiple
instances): a toxic sentence counts by its worst window, a clean one by all. Landmarks are windows drawn from these
sentences. A document scores by how unlikely its words' margins are among the words of clean documents.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.llm.common import arrow_map, keep, release, slices, small_batches, smallest

#: Subsequences of up to this many letters count, each place that one skips by this factor.
ORDER, DECAY = 3, 0.9
#: Sharpness of the kernel; similarities below FLOOR count as none.
WIDTH, FLOOR = 8.0, 0.01
#: Letters of the shortest and the longest beginning of a word that is a window; the rest of longer words is cut into
#: windows of the latter length that overlap by half.
SHORT, LONG = 4, 8
#: Landmarks: at most so many that lean to toxic sentences, and clean ones (the likest to these, and the commonest).
LANDMARKS, CLEAN_LANDMARKS = 512, 24
#: A window leans to toxic sentences if it is over its share there by this many standard deviations in either half of the
#: documents. It becomes a landmark if at least SEVERAL toxic sentences, and TENTH of its own, hold none that leans more.
LEAN, SEVERAL, TENTH = 4.0, 3, 0.1
#: No two clean landmarks are as like as this.
ALIKE = 0.9
#: At most so many documents of either label, and sentences of these, are learnt from: those with the smallest hashes.
DOCUMENTS, SENTENCES = 4_000, 60_000
#: Words after which a sentence that no mark ends is cut for teaching, and characters after which an unbroken run is.
SENTENCE_WORDS, RUN = 60, 512
#: Rounds of choosing worst windows and fitting.
ROUNDS = 4
#: Weight of landmarks with a letter inserted, as further (virtual) toxic examples, against that of the sentences.
VIRTUAL = 0.1
#: Landmarks of smaller weight are left out.
LIGHT = 0.02
#: A clean document of its make shows as much evidence as one that scores 0.5 at most so often.
CHANCE = 1 / 50
#: Characters of the tokens a worker remembers (it then starts anew).
CACHE = 8_000_000
FOLDS = 5
START = "^"
WORD = re.compile(r"[^\W\d_]+")
#: Runs of single letters with marks or spaces between: a word spelt out.
SPELT = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[\W_]{1,3}[^\W\d_](?![^\W\d_])){2,}")
MARKED = re.compile(r"[^\W\d_]+(?:(?:[^\w\s|]|[\d_])+[^\W\d_]+)+")
GAP = re.compile(r"[\W\d_]+")
EDGES = ".,;:!?()[]{}<>\"'-*_"


def _cut(word: str) -> list[str]:
    n = len(word)
    out = [START + word[:k] for k in range(SHORT, min(n, LONG + 1))]
    if n <= LONG:
        out.append(START + word)
    out += [word[i : i + LONG] for i in range(LONG // 2, n - LONG // 2, LONG // 2)]
    return out


def token_windows(token: str) -> list[str]:
    """The windows of what stands between white space: those of its words, and of the word that marks, digits or underscores
    between letters break up. A window that a word begins with starts with a mark, which counts as a letter."""
    if token.isalpha():
        return _cut(token) if len(token) >= ORDER else []
    found = WORD.findall(token)
    if len(found) > 1 and MARKED.search(token):
        found += [GAP.sub("", x) for x in MARKED.findall(token)]
    return [x for w in found if len(w) >= ORDER for x in _cut(w)]


def tokens(text: str, distinct: bool = False) -> list[str]:
    """What stands between white space, in lower case and order, without marks at its ends, then words spelt out letter by
    letter. Runs of more than RUN characters come in pieces that overlap by LONG. distinct: mostly once each, in any order."""
    text = text.lower()
    found = text.split()
    found = [t.strip(EDGES) for t in (set(found) if distinct else found)] + [GAP.sub("", x) for x in SPELT.findall(text)]
    if len(text) > RUN and max(map(len, found), default=0) > RUN:
        found = [t[i : i + RUN] for t in found for i in range(0, max(1, len(t) - LONG), RUN - LONG)]
    return found


def windows(text: str) -> set[str]:
    return {w for t in tokens(text) for w in token_windows(t)}


def _codes(words: list[str], width: int) -> np.ndarray:
    return np.array([w.ljust(width, "\0") for w in words], f"<U{width}").view(np.uint32).reshape(len(words), width)


def _by_length(words: list[str], tile: int = 4096):
    """Places of the words of each length, some at a time."""
    lengths = np.array([len(w) for w in words], int)
    for n in np.unique(lengths[lengths > 0]).tolist():
        at = np.nonzero(lengths == n)[0]
        for i in range(0, len(at), tile):
            yield n, at[i : i + tile]


class Landmarks:
    """The marks' subsequences, spelt out: by letters (letter, pair, triple) the weight of each mark's occurrences.

    The kernel of a word with all marks is then the sum, over the word's own subsequences, of their weight times that
    row. Subsequences no mark has are row 0, so words that share little with any cost little.
    """

    def __init__(self, marks: list[str]):
        self.marks = marks
        self.letters = np.unique(np.array([ord(c) for m in marks for c in m], np.uint32))
        size = len(self.letters) + 1
        self.one, self.two = np.arange(size), np.zeros((size, size), np.int32)
        rows: dict[tuple, dict[int, float]] = {(): {}}
        three: dict[tuple, int] = {}
        for m, mark in enumerate(marks):
            c = self._ids(_codes([mark], len(mark)))[0].tolist()
            n = len(c)
            for i in range(n):
                for key, w in [((c[i],), 1.0)] + [((c[i], c[j]), DECAY ** (j - i - 1)) for j in range(i + 1, n)] + [((c[i], c[j], c[k]), DECAY ** (k - i - 2)) for j in range(i + 1, n) for k in range(j + 1, n)]:
                    row = rows.setdefault(key, {})
                    row[m] = row.get(m, 0.0) + w
        at = {key: i for i, key in enumerate(rows)}
        self.weights = np.zeros((len(rows), len(marks)), np.float32)
        for key, row in rows.items():
            for m, w in row.items():
                self.weights[at[key], m] = w
        pairs = [k for k in at if len(k) == 2]
        self.one = np.zeros(size, np.int32)
        self.pair = np.zeros((size, size), np.int32)  # number of the pair, from 1
        self.two, self.three = np.zeros(len(pairs) + 1, np.int32), np.zeros((len(pairs) + 1, size), np.int32)
        for i, k in enumerate(pairs, 1):
            self.pair[k], self.two[i] = i, at[k]
        for k, row in at.items():
            if len(k) == 1:
                self.one[k[0]] = row
            elif len(k) == 3:
                self.three[self.pair[k[0], k[1]], k[2]] = row
        self.own = self_kernel(marks)

    def _ids(self, codes: np.ndarray) -> np.ndarray:
        """Number of each letter among the marks' letters, from 1; 0 for others."""
        at = np.minimum(np.searchsorted(self.letters, codes), max(0, len(self.letters) - 1))
        return np.where(self.letters[at] == codes, at + 1, 0) if len(self.letters) else np.zeros(codes.shape, int)

    def kernel(self, words: list[str]) -> np.ndarray:
        """Gap-weighted subsequence kernel of each word with each mark, all orders up to ORDER summed.

        Subsequences are added by the place they end at, so that a word's beginnings, where they are words here too, are
        done on the way."""
        out = np.zeros((len(words), len(self.marks)), np.float32)
        order = sorted(range(len(words)), key=words.__getitem__)
        whole = list(order)  # of each word in order, the longest that begins with it
        for i in range(len(order) - 2, -1, -1):
            if words[order[i + 1]].startswith(words[order[i]]):
                whole[i] = whole[i + 1]
        longest = np.unique(np.array(whole, int))
        lengths, order, whole = np.array([len(w) for w in words], int), np.array(order, int), np.searchsorted(longest, whole)
        for n, part in _by_length([words[k] for k in longest]):
            row = np.full(len(longest), -1)
            row[part] = np.arange(len(part))
            inside = np.nonzero(row[whole] >= 0)[0] if len(part) < len(longest) else np.arange(len(whole))
            s = self._ids(_codes([words[longest[k]] for k in part], n))
            total = np.zeros((len(part), len(self.marks)), np.float32)

            def add(rows: np.ndarray, weight: float) -> None:
                hit = np.nonzero(rows)[0]
                if len(hit):
                    total[hit] += np.float32(weight) * self.weights[rows[hit]]

            pairs: list[list[np.ndarray]] = []
            for k in range(n):
                add(self.one[s[:, k]], 1.0)
                pairs.append([self.pair[s[:, i], s[:, k]] for i in range(k)])
                for i in range(k):
                    add(self.two[pairs[k][i]], DECAY ** (k - i - 1))
                    for j in range(i + 1, k):
                        add(self.three[pairs[j][i], s[:, k]], DECAY ** (k - i - 2))
                done = inside[lengths[order[inside]] == k + 1]
                out[order[done]] = total[row[whole[done]]]
        return out

    def similar(self, words: list[str]) -> np.ndarray:
        """A Gaussian of the distance in the subsequence kernel's feature space: again a kernel, and one that parts words
        which only share a few letters from those that share a stem. What comes out below FLOOR is set to 0."""
        out = np.zeros((len(words), len(self.marks)), np.float32)
        if not words or not self.marks:
            return out
        least = 1 + np.log(FLOOR) / WIDTH
        k = self.kernel(words)
        # a word's kernel with itself is at least the sum of its occurrences' squared weights, which only its length tells
        low = np.array([1.0] + [_least_self(n) for n in range(1, max(len(w) for w in words) + 1)])[[len(w) for w in words]]
        at = np.nonzero((k / np.sqrt(low[:, None] * self.own[None, :])).max(axis=1) >= least)[0]
        close = [words[i] for i in at]
        sharp = np.exp(WIDTH * (k[at] / np.sqrt(self_kernel(close)[:, None] * self.own[None, :]) - 1))
        out[at] = np.where(sharp >= FLOOR, sharp, 0)
        return out


    def close(self, words: list[str], tile: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
        """The places of words that are like any mark, and their similarities: some words at a time."""
        at, rows = [np.zeros(0, np.int64)], [np.zeros((0, len(self.marks)), np.float32)]
        for i in range(0, len(words), tile):
            part = self.similar(words[i : i + tile])
            some = np.nonzero(part.any(axis=1))[0]
            at.append(some + i)
            rows.append(part[some])
        return np.concatenate(at), np.concatenate(rows)


def _least_self(n: int) -> float:
    d = DECAY**2
    return n + sum((n - g) * d ** (g - 1) for g in range(1, n)) + sum((n - g) * (g - 1) * d ** (g - 2) for g in range(2, n))


def self_kernel(words: list[str]) -> np.ndarray:
    """Kernel of each word with itself. common holds, for places i and j of the word, the weight of the common subsequences
    of q letters that end there; the next order lengthens them by a letter, each place skipped on either side costing DECAY."""
    out = np.ones(len(words), np.float32)
    for n, part in _by_length(words):
        d = np.arange(n)[:, None] - np.arange(n)[None, :]
        step = np.where(d > 0, DECAY ** np.maximum(d - 1, 0), 0).astype(np.float32)
        s = _codes([words[k] for k in part], n)
        same = (s[:, :, None] == s[:, None, :]).astype(np.float32)
        common, total = same, 0
        for q in range(ORDER):
            if q:
                common = same * (step @ common @ step.T)
            total = total + common.sum(axis=(1, 2))
        out[part] = total
    return out


@dataclass
class Machine:
    landmarks: Landmarks
    weights: np.ndarray  # of the kernels with the marks: the machine's weights by Nyström's map
    bias: float
    cuts: np.ndarray  # margins that words of clean documents reach, in order
    shares: np.ndarray  # by place among these, the share of such words that reach as much
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, words: list[str]) -> np.ndarray:
        return self.landmarks.similar(words) @ self.weights + self.bias

    def rarity(self, margin: np.ndarray) -> np.ndarray:
        """Share of the words of clean documents with at least this margin."""
        return self.shares[np.searchsorted(self.cuts, margin, side="left")]

    def evidence(self, shares: list[float], n: int) -> float:
        """How unlikely it is that k of n words are as rare as the k-th rarest here: the largest, over k, of the Chernoff
        exponent of that binomial tail (Berk and Jones)."""
        best = 0.0
        for k, p in enumerate(sorted(shares), 1):
            mean = n * p
            if k > mean:
                best = max(best, k * np.log(k / mean) - k + mean)
        return best

    def calibrate(self, evidence: np.ndarray, toxic: np.ndarray) -> None:
        """Fit the curve from evidence to score; 0.5 isn't reached by evidence that clean documents show oftener than CHANCE."""
        self.slope, offset = _calibrate(evidence, toxic)
        self.offset = min(offset, self.slope * np.log(CHANCE))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        """0 where nothing speaks for toxicity."""
        return np.where(evidence > 0, 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -60, 60))), 0.0)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1000.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton's steps, halved until the loss falls."""
    x1 = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    del x
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x1.shape[1])
    loss = lambda w: 0.5 * w @ ridge @ w + 0.5 * c * (weight * np.maximum(0, 1 - y * (x1 @ w)) ** 2).sum()
    now = loss(w)
    for _ in range(rounds):
        inside = y * (x1 @ w) < 1
        a = x1[inside] * weight[inside, None]
        step = np.linalg.solve(ridge + c * a.T @ x1[inside], c * a.T @ y[inside]) - w
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        now, before = loss(w), now
        if before - now <= 1e-9 * max(1.0, before):
            break
    return w[:-1], float(w[-1])


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's logistic curve of the evidence, fitted to smoothed labels."""
    yes, no = y.sum(), (~y).sum()
    t = np.where(y, (yes + 1) / (yes + 2), 1 / (no + 2))
    a = np.column_stack([x, np.ones(len(x))])
    w = np.array([0.5, -4.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (t - p))
        w = w + step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return max(0.05, float(w[0])), float(w[1])


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different values of x, a temporary array, in order."""
    x.sort()
    return x[np.diff(x, prepend=x[:1] - 1) != 0]


def _largest(values: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each group of neighbouring values (starts: where they begin, owner: each value's group): the largest and its place."""
    top = np.maximum.reduceat(values, starts)
    at = np.nonzero(values == top[owner])[0]
    first = np.full(len(starts), len(values))
    np.minimum.at(first, owner[at], at)
    return top, first


def train(rows: Iterable[tuple[int, int, str]]) -> Machine | None:
    """rows: a number for the document, its label, and a sentence of it. None where no window tells the labels apart.

    A sentence that documents of both labels hold counts as clean, equal sentences once.
    """
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    clean_set = {s for _, y, s in rows if y == 0}
    kept = {s: (d, y) for d, y, s in rows if y == 0 or s not in clean_set}
    del rows
    if not clean_set or all(y == 0 for _, y in kept.values()):
        return None
    del clean_set
    ids: dict[str, int] = {"": 0}
    sent, prev, tok, doc, label = (array("q") for _ in range(5))
    for n, (s, (d, y)) in enumerate(kept.items()):
        doc.append(d)
        label.append(y)
        before = 0
        for t in tokens(s):
            i = ids.setdefault(t, len(ids))
            sent.append(n)
            prev.append(before)
            tok.append(i)
            before = i
    if not tok:
        return None
    del kept
    sent, prev, tok, doc, label = (np.frombuffer(x, np.int64) for x in (sent, prev, tok, doc, label))
    # windows of each token, those of one token together
    names: dict[str, int] = {"": 0}
    of_tok, of_win = array("i"), array("i")
    for t, i in ids.items():
        for w in sorted(token_windows(t)) or [""]:
            of_tok.append(i)
            of_win.append(names.setdefault(w, len(names)))
    of_tok, of_win, win, words = np.array(of_tok, np.int32), np.array(of_win, np.int32), list(names), len(ids)
    del ids, names
    tok_starts = np.nonzero(np.diff(of_tok, prepend=-1))[0]
    # how many sentences hold each window, and how many different words it follows: words of copied texts keep their neighbours
    half = doc[sent] & 1
    group = label[sent] * 2 + half
    lean = np.full(len(win), np.inf)
    for unit in (sent, prev):
        seen = _distinct((group * max(words, len(label)) + unit) * words + tok)
        kind, what = seen // words // max(words, len(label)), seen % words
        count = np.zeros((4, len(win)))
        for g in range(4):
            c = np.bincount(what[kind == g], minlength=words).astype(float)
            count[g] = np.bincount(of_win, weights=c[of_tok], minlength=len(win))
        if unit is sent:
            good = count[0] + count[1]
        for h in (0, 1):
            both, share = count[h] + count[2 + h], (kind == 2 + h).sum() / max(1, (kind % 2 == h).sum())
            with np.errstate(divide="ignore", invalid="ignore"):
                lean = np.minimum(lean, np.nan_to_num((count[2 + h] - both * share) / np.sqrt(both * share * (1 - share)), nan=0.0, posinf=0.0))
    lean[0] = 0
    del seen, kind, what, count, half, group
    lean = lean * (1 + 0.03 * np.array([len(w) for w in win]))  # of windows that tell alike, the longest
    order = np.nonzero(lean >= LEAN)[0]
    order = order[np.lexsort((order, -lean[order]))]
    rank = np.full(len(win), -1)
    rank[order] = np.arange(len(order))
    # the toxic sentences that hold each of them
    some = rank[of_win] >= 0
    first, last = np.searchsorted(of_tok[some], [tok, tok + 1])
    bad = (label[sent] == 1) & (last > first)
    at = np.repeat(first[bad], (last - first)[bad]) + np.concatenate([np.arange(n) for n in (last - first)[bad]] or [np.zeros(0, int)])
    pairs = _distinct(rank[of_win[some][at]] * len(label) + np.repeat(sent[bad], (last - first)[bad]))
    marks, told, bounds = [], np.zeros(len(label), bool), np.searchsorted(pairs, np.arange(len(order) + 1) * len(label))
    for k, i in enumerate(order.tolist()):
        holds = pairs[bounds[k] : bounds[k + 1]] % len(label)
        if (~told[holds]).sum() >= max(SEVERAL, TENTH * len(holds)) and len(marks) < LANDMARKS:
            marks.append(win[i])
            told[holds] = True
    if not marks:
        return None
    insults = len(marks)
    near = np.zeros(len(win), np.float32)
    some, like = Landmarks(marks).close(win)
    near[some] = like.max(axis=1)
    plain = np.nonzero((lean <= 0) & (good > 0))[0]
    plain = plain[plain > 0]
    hard = plain[np.argsort(-near[plain] * np.sqrt(good[plain]), kind="stable")][: 40 * CLEAN_LANDMARKS]
    often = plain[np.argsort(-good[plain], kind="stable")][: 4 * CLEAN_LANDMARKS]
    marks += [m for m in _unlike([win[i] for i in hard], CLEAN_LANDMARKS * 3 // 4) + _unlike([win[i] for i in often], CLEAN_LANDMARKS // 4) if m not in marks]
    marks = list(dict.fromkeys(marks))
    landmarks = Landmarks(marks)
    values, vectors = np.linalg.eigh(landmarks.similar(marks).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    some, x = landmarks.close(win)
    place = np.zeros(len(win), np.int64)  # row of a window among those like any mark; 0: like none
    place[some] = np.arange(1, len(some) + 1)
    z = np.vstack([np.zeros((1, len(marks)), np.float32), x @ root.astype(np.float32)])
    no = np.bincount(place, weights=good, minlength=len(z))
    spoilt = [(i, (m[:k] + "\0" + m[k:])[: LONG + 1]) for i, m in enumerate(marks[:insults]) for k in range(2, len(m))]
    virtual, of_mark = landmarks.similar([m for _, m in spoilt]) @ root, np.array([i for i, _ in spoilt], int)
    told_by = set(marks[:insults])
    named = {w: i for i, w in enumerate(win) if w in told_by}
    names_at = np.array([named[m] for m in marks[:insults]])
    # sentences' distinct tokens, those of one sentence together
    pairs = _distinct(sent * words + tok)
    p_sent, p_tok = (pairs // words).astype(np.int32), (pairs % words).astype(np.int32)
    p_owner = np.cumsum(np.diff(p_sent, prepend=p_sent[:1]) > 0, dtype=np.int32)
    del pairs
    p_starts = np.nonzero(np.diff(p_sent, prepend=-1))[0]
    s_label, s_doc = label[p_sent[p_starts]], doc[p_sent[p_starts]]
    docs, s_owner = np.unique(s_doc, return_inverse=True)
    f_win = np.where(lean >= LEAN, lean, 0)  # the first worst windows: those that lean most
    w = None
    for _ in range(ROUNDS):
        f_tok, at_tok = _largest(f_win[of_win], tok_starts, of_tok)
        f_sent, at = _largest(f_tok[p_tok], p_starts, p_owner)
        witness = place[of_win[at_tok[p_tok[at]]]]
        # sentences of toxic documents that hold nothing teach nothing
        active = (s_label == 1) & (f_sent > 0)
        if not active.any():
            return None
        yes = np.bincount(witness[active], minlength=len(z)).astype(float) / active.sum()
        copies = VIRTUAL * yes[place[names_at]][of_mark] / np.maximum(1, np.bincount(of_mark, minlength=insults))[of_mark]
        held, free, spoils = np.nonzero(yes)[0], np.nonzero(no)[0], np.nonzero(copies)[0]
        weight = np.concatenate([yes[held], copies[spoils], no[free] / no.sum()])
        y = np.concatenate([np.ones(len(held) + len(spoils)), -np.ones(len(free))])
        w, bias = _svm(np.vstack([z[held], virtual[spoils], z[free]]), y, weight)
        f_win = (z @ w + bias)[place]
    weights = root @ w
    light = np.abs(weights) < LIGHT
    machine = Machine(Landmarks([k for k, x in zip(marks, light) if not x]), weights[~light].astype(np.float32), bias, np.zeros(0), np.zeros(1))
    f_win = np.concatenate([[bias], x[:, ~light] @ machine.weights + bias])[place]
    f_tok, _ = _largest(f_win[of_win], tok_starts, of_tok)
    # what margins words of clean documents reach
    pairs = _distinct(np.searchsorted(docs, doc[sent]) * words + tok)
    d_doc, d_tok = pairs // words, pairs % words
    toxic = np.zeros(len(docs), bool)
    toxic[s_owner[s_label == 1]] = True
    reach = np.sort(f_tok[d_tok[~toxic[d_doc]]])
    machine.cuts, first = np.unique(reach, return_index=True)
    machine.shares = np.concatenate([len(reach) - first + 0.5, [0.5]]) / (len(reach) + 1)
    hit = f_tok[d_tok] > 0
    found: list[list[float]] = [[] for _ in docs]
    for d, p in zip(d_doc[hit].tolist(), machine.rarity(f_tok[d_tok[hit]]).tolist()):
        found[d].append(p)
    size = np.bincount(d_doc, minlength=len(docs))
    machine.calibrate(np.array([machine.evidence(p, n) for p, n in zip(found, size.tolist())]), toxic)
    return machine


def _unlike(words: list[str], most: int) -> list[str]:
    """The first so many words of which none is as like as ALIKE to one before."""
    out: list[str] = []
    own: list[float] = []
    for i in range(0, len(words), 64):
        if len(out) >= most:
            break
        part = words[i : i + 64]
        near = Landmarks(out + part)
        cosine = near.kernel(part) / np.sqrt(near.own[len(out) :][:, None] * near.own[None, :])
        chosen = list(range(len(out)))
        for k, word in enumerate(part):
            if len(out) < most and (not chosen or cosine[k, chosen].max() < ALIKE):
                chosen.append(len(near.marks) - len(part) + k)
                out.append(word)
    return out


#: The worker's scorer: its memory outlasts a task.
_scorers: dict[bytes, _Scorer] = {}


def _scorer(machine: Machine) -> _Scorer:
    key = machine.weights.tobytes() + "\n".join(machine.landmarks.marks).encode("utf-8", "surrogatepass")
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = _Scorer(machine)
    return _scorers[key]


class _Scorer:
    """Evidence of texts; remembers which tokens it has met, and how rare those above the machine's threshold are."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.forget()

    def forget(self) -> None:
        self.plain: set[str] = set()
        self.rare: dict[str, float] = {}
        self.size = 0

    def learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            ws = [token_windows(t) for t in part]
            names = sorted(set().union(*ws))
            margin = dict(zip(names, self.machine.margins(names).tolist())) if names else {}
            worst = [max([margin[w] for w in x], default=0.0) for x in ws]
            self.plain.update(t for t, f in zip(part, worst) if f <= 0)
            hit = [(t, f) for t, f in zip(part, worst) if f > 0]
            self.rare.update(zip([t for t, _ in hit], self.machine.rarity(np.array([f for _, f in hit])).tolist()))
            self.size += sum(map(len, part))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Evidence of each text, from its different words."""
        found = [set(tokens(x or "", distinct=True)) for x in texts]
        self.learn([t for t in set().union(*found) if t not in self.plain and t not in self.rare])
        rare = self.rare
        out = np.array([self.machine.evidence([rare[t] for t in x & rare.keys()], len(x)) for x in found], float)
        if self.size > CACHE:
            self.forget()
        return out


def held_out(id_col: Column) -> Column:
    """Whether the id's hash puts it in the fold that labels are never learnt from; a null id, which has no label, isn't."""
    return id_col.isNotNull() & (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", documents: int = DOCUMENTS, sentences: int = SENTENCES) -> Machine | None:
    """Learn from sentences of labelled documents outside the held-out fold; then set the scores' scale by these documents'
    whole texts.

    documents and sentences bound what of either label is learnt from (the smallest hashes). A document with labels of both
    kinds counts as toxic; other values than 0 and 1, null ids and null texts teach nothing. None if nothing can be learnt.
    """
    told = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    told = told.filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    told = keep(told, "labels")
    count = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    some = [smallest(told.filter(F.col("label") == k), ["id"], documents, count.get(k, 0)) for k in (0, 1)]
    told = F.broadcast(some[0].unionAll(some[1]))  # 2 * documents rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    rows = keep(rows.join(told, "id").select(F.xxhash64("id").alias("doc"), "label", "text"), "taught")
    split = rows.select("doc", "label", F.explode(F.split("text", r"[.!?\n]+")).alias("s")).withColumn("w", F.split(F.trim("s"), r"\s+"))
    split = split.select("doc", "label", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(SENTENCE_WORDS)), lambda i: F.array_join(F.slice("w", i + 1, SENTENCE_WORDS), " "))).alias("s"))
    split = split.filter(F.length("s") >= ORDER)
    parts = [split.filter(F.col("label") == k).orderBy(F.xxhash64("s"), "s", "doc").limit(sentences).toArrow() for k in (1, 0)]
    machine = train(r for p in parts for b in p.to_batches(1000) for r in zip(*(b.column(k).to_pylist() for k in range(3))))
    del parts
    release()  # the driver's share of this
    if machine is not None:
        seen = _evidence(rows, machine, "label").toArrow()
        machine.calibrate(seen["evidence"].to_numpy(), seen["label"].to_numpy() == 1)
    return machine


def _evidence(rows: DataFrame, machine: Machine, carry: str) -> DataFrame:
    """carry (a long or int column) and the evidence of the text."""

    def step(batch: pa.RecordBatch, scorer: _Scorer) -> dict:
        return {carry: batch.column(0), "evidence": scorer(batch.column(1).to_pylist())}

    return arrow_map(rows.select(F.col(carry).cast("long"), "text"), step, f"{carry} long, evidence double", {carry: pa.int64(), "evidence": pa.float64()}, lambda: _scorer(machine))


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, held_out, score, predicted for every row, repeated rows included, whatever other columns there are.

    Texts are taken whole, very long ones too. Null, empty and wordless texts score 0, and so does every text where nothing
    could be learnt or nothing speaks for toxicity; an empty table gives none. A null id stays null and isn't held out."""
    if machine is None:
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(0.0).alias("score"))
    else:

        def step(batch: pa.RecordBatch, scorer: _Scorer) -> dict:
            return {"id": batch.column(0), "score": machine.probability(scorer(batch.column(1).to_pylist()))}

        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        rows = arrow_map(rows, step, "id long, score double", {"id": pa.int64(), "score": pa.float64()}, lambda: _scorer(machine))
    return rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, machine: Machine | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs, with all their columns, but for rows whose text scores threshold or more. Null and empty texts score 0 and stay;
    repeated rows share their fate; where nothing could be learnt (machine is None) all rows stay."""
    if machine is None:
        return docs
    small_batches(docs.sparkSession)

    def run(batches):
        scorer = _scorer(machine)
        for batch in slices(batches):
            yield batch.filter(pa.array(machine.probability(scorer(batch.column(text_col).to_pylist())) < threshold))

    return docs.mapInArrow(run, docs.schema)
