"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibrate import Isotonic
from .common import in_training_fold, labelled_sample

#: The bound of what is learned from: labelled rows of each label, and bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 5000, 8 << 20
#: Lexicon entries are words and beginnings of words of these lengths.
STEM_LENGTHS = range(3, 9)
LEXICON_SIZE, MIN_TOXIC_DOCS = 400, 4
NEAR_WORDS = 5
CACHE_WORDS = 400_000
THRESHOLD = 0.7

# Second-person words of the four languages, and characters that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})

_EDGE = re.compile(r"^\W+|\W+$")
_ODD = re.compile(r"[^\W\d_][\d@$!*._-]+[^\W\d_]|[\d@$][^\W\d_]{2}")
FEATURES = (
    "strong_density strong_count strong_kinds weight_density max_weight second_person near_second_person capitals caps_words punctuation exclamations digits obfuscated obfuscated_hits stretched word_length words"
).split()


def _stems(word: str) -> list[str]:
    """The lexicon keys of a word: the whole word, and its beginnings, which end with a dash."""
    return [word, *(word[:k] + "-" for k in STEM_LENGTHS if len(word) > k)]


class KeyTable:
    """The lexicon keys that each text of a sample has, as pairs of numbers, so that counts over any part of it are exact.

    Keys that fewer than MIN_TOXIC_DOCS of the toxic texts have, which no part can learn, are left out. Work goes by
    blocks of texts, so memory is bounded by the sample's.
    """

    def __init__(self, texts: list[str], y: list[int]):
        self.y = np.array(y, bool)
        words: dict[str, int] = {}
        token: dict[str, int] = {}  # a word as it stands, with its marks: the number of the bare word, -1 for none
        own: list[np.ndarray] = []  # numbers of the words of each text
        for text in texts:
            found = set()
            for t in text.lower().split():
                k = token.get(t)
                if k is None:
                    w = _EDGE.sub("", t)
                    k = token[t] = words.setdefault(w, len(words)) if w else -1
                found.add(k)
            found.discard(-1)
            own.append(np.fromiter(found, np.int64, len(found)))
        names = list(words)
        toxic = np.zeros(len(names), bool)
        for k in np.flatnonzero(self.y):
            toxic[own[k]] = True
        keys: dict[str, int] = {}
        for k in np.flatnonzero(toxic).tolist():
            for s in _stems(names[k]):
                keys.setdefault(s, len(keys))
        # words of other texts alone count as well where they have a key of a toxic text's word
        flat: list[int] = []
        edges = [0]
        for w in names:
            flat += [k for s in _stems(w) if (k := keys.get(s)) is not None]
            edges.append(len(flat))
        flat_keys, edges = np.array(flat, np.int64), np.array(edges)
        self.keys = list(keys)
        toxic_only = self._pairs([own[k] for k in np.flatnonzero(self.y)], flat_keys, edges, np.ones(len(keys), bool))[1]
        kept = np.bincount(toxic_only, minlength=len(keys)) >= MIN_TOXIC_DOCS
        self.text, self.key = self._pairs(own, flat_keys, edges, kept)

    @staticmethod
    def _pairs(own: list[np.ndarray], flat: np.ndarray, edges: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(own), 256):
            part = own[at : at + 256]
            word = np.concatenate(part) if part else np.empty(0, np.int64)
            text = np.repeat(np.arange(at, at + len(part)), [len(p) for p in part])
            n = edges[word + 1] - edges[word]
            if not n.sum():
                continue
            first = np.repeat(edges[word] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            key, text = flat[first + np.arange(n.sum())], np.repeat(text, n)
            pair = np.unique((text * len(kept) + key)[kept[key]])
            texts.append(pair // len(kept))
            keys.append(pair % len(kept))
        return np.concatenate(texts), np.concatenate(keys)

    def counts(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the chosen toxic texts, and of the chosen others, have each key."""
        own = chosen[self.text]
        toxic = self.y[self.text]
        return tuple(np.bincount(self.key[own & (toxic == t)], minlength=len(self.keys)) for t in (True, False))


def learn_lexicon(table: KeyTable, chosen: np.ndarray) -> dict[str, float]:
    """Entries by log odds of their document frequencies in toxic and other chosen texts, the most telling first; an entry that a longer or shorter one explains as well is left out."""
    n1, n0 = int((chosen & table.y).sum()), int((chosen & ~table.y).sum())
    toxic, other = table.counts(chosen)
    scored = []
    for k in np.flatnonzero(toxic >= MIN_TOXIC_DOCS).tolist():
        c, d = int(toxic[k]), int(other[k])
        odds = math.log((c + 0.5) / (n1 + 1)) - math.log((d + 0.5) / (n0 + 1))
        if odds >= 1.5:
            scored.append(((c / n1 - d / max(1, n0)) * odds, table.keys[k], odds))
    scored.sort(key=lambda x: (-x[0], len(x[1]), x[1]))
    out: dict[str, float] = {}
    for _, key, odds in scored:
        stem = key.rstrip("-")
        if not any(stem.startswith(k[:-1]) for k in out if k.endswith("-")):
            out[key] = odds
        if len(out) >= LEXICON_SIZE:
            break
    return out


_CAPS = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b")
_PUNCT = re.compile(r"[!-/:-@\[-`{-~]")
_DIGIT = re.compile(r"[0-9]")
_STRETCH = re.compile(r"([^\W\d_])\1\1")
#: Marks that stand before and after words, all of them punctuation and none that stands for a letter within a word.
_MARKS = "\"'(),.:;?!"
#: What is known of a word: weight, whether it is strong, strong by undone look-alikes, second person, and counts of the rest.
_FACTS = 11


class _Words(dict):
    """Numbers of words, each worked out when it is first met; row k of `facts` is what is known of word k."""

    def __init__(self, facts_of):
        super().__init__()
        self.facts_of, self.facts = facts_of, np.zeros((4096, _FACTS))

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k == len(self.facts):
            self.facts = np.concatenate((self.facts, np.zeros_like(self.facts)))
        self.facts[k] = self.facts_of(word)
        self[word] = k
        return k


class FeatureMaker:
    """The features of a text as sums over its words, whose own facts are worked out once for each distinct word.

    No pattern here matches across white space, so a text's counts are its words'. The words of one text are never
    cut; the cache is emptied between texts when it is full.
    """

    def __init__(self, lexicon: dict[str, float], strong: float = 3.0):
        self.lexicon, self.strong = lexicon, strong
        #: No word that begins otherwise has an entry.
        self.heads = {k.rstrip("-")[:3] for k in lexicon}
        self.words = _Words(self._facts)

    def _entry(self, bare: str) -> float:
        if bare[:3] not in self.heads:
            return 0.0
        return max(self.lexicon.get(k, 0.0) for k in _stems(bare))

    def weight(self, word: str) -> float:
        """The largest weight of the entries of a word in lower case; negative if it is only met with look-alike characters undone."""
        best = self._entry(_EDGE.sub("", word))
        if not best and _ODD.search(word):
            best = -self._entry(_EDGE.sub("", word.translate(LOOKALIKES)))
        return best

    def _facts(self, word: str) -> tuple:
        core = word.strip(_MARKS)
        if core.isalpha():  # letters between marks, as most words are: no digits and nothing obfuscated
            lower = core.lower()
            w = self._entry(lower if core.isascii() else _EDGE.sub("", lower))
            marks = len(word) - len(core)
            upper = 0 if core == lower else sum(map(str.isupper, core))
            you = lower in SECOND_PERSON and (not marks or word.lower().strip(".,!?;:") == lower)
            shouts = word.count("!") if marks else 0
            return w, w >= self.strong, False, you, upper, len(_CAPS.findall(core)) if upper > 1 else 0, marks, shouts, 0, 0, len(_STRETCH.findall(lower))
        lower = word.lower()
        w = self.weight(lower)
        return (
            abs(w),
            abs(w) >= self.strong,
            w <= -self.strong,
            lower in SECOND_PERSON or lower.strip(".,!?;:") in SECOND_PERSON,
            sum(map(str.isupper, word)),
            len(_CAPS.findall(word)),
            len(_PUNCT.findall(word)),
            word.count("!"),
            len(_DIGIT.findall(word)),
            len(_ODD.findall(lower)),
            len(_STRETCH.findall(lower)),
        )

    def __call__(self, text: str) -> list[float]:
        words = text.split()
        n, chars = len(words), len(text)
        if not n:
            return [0.0] * len(FEATURES)
        if len(self.words) >= CACHE_WORDS:
            self.words = _Words(self._facts)
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, n)
        total, top, hits, you = np.zeros(_FACTS), 0.0, [], []
        for k in range(0, n, 1 << 15):
            facts = self.words.facts[at[k : k + (1 << 15)]]
            total += facts.sum(0)
            top = max(top, float(facts[:, 0].max()))
            hits.append(np.flatnonzero(facts[:, 1]) + k)
            you.append(np.flatnonzero(facts[:, 3]) + k)
        hits, you = np.concatenate(hits), np.concatenate(you)
        weight, _, obfuscated, _, upper, caps, punct, shouts, digits, odd, stretched = total.tolist()
        near = 0.0
        if len(hits) and len(you):
            k = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(you[np.minimum(k, len(you) - 1)] - hits), np.abs(you[np.maximum(k - 1, 0)] - hits))
            near = float((gap <= NEAR_WORDS).mean())
        kinds = len({words[i].lower() for i in hits.tolist()})
        return [
            100.0 * len(hits) / n,
            math.log1p(len(hits)),
            math.log1p(kinds),
            weight / n,
            top,
            len(you) / n,
            near,
            upper / chars,
            caps / n,
            punct / chars,
            shouts / n,
            digits / chars,
            odd / n,
            100.0 * obfuscated / n,
            stretched / n,
            (chars - n + 1) / n,
            math.log1p(n),
        ]


class BoostedTrees:
    """Gradient boosting of the logistic loss by histogram trees of fixed depth, deterministic."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, leaf: float = 8.0, l2: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.leaf, self.l2 = trees, depth, rate, bins, leaf, l2
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.column_stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)])
        p = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
        self.start = math.log(p / (1 - p))
        score = np.full(n, self.start)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            g, h = weight * (y - prob), weight * prob * (1 - prob)
            at = np.zeros(n, int)
            feature, threshold = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                base, wide = 2**level - 1, 2**level
                best = np.full(wide, 1e-6)
                pick_f, pick_b = np.zeros(wide, int), np.full(wide, -1)
                for j in range(f):
                    b = len(cuts[j]) + 1
                    if b < 2:
                        continue
                    key = (at - base) * b + binned[:, j]
                    gs = np.bincount(key, g, wide * b).reshape(wide, b)
                    hs = np.bincount(key, h, wide * b).reshape(wide, b)
                    gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                    gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hl < self.leaf / 8) | (ht - hl < self.leaf / 8)] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(wide), k]
                    better = top > best
                    best[better], pick_f[better], pick_b[better] = top[better], j, k[better]
                for node in range(wide):
                    if pick_b[node] >= 0:
                        feature[base + node] = pick_f[node]
                        threshold[base + node] = cuts[pick_f[node]][pick_b[node]]
                at = 2 * at + 1 + (x[np.arange(n), feature[at]] >= threshold[at])
            leaf = at - (2**self.depth - 1)
            gs, hs = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            value = self.rate * gs / (hs + self.l2)
            score += value[leaf]
            self.nodes.append((feature, threshold, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in self.nodes:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] >= threshold[at])
            out += value[at - (2**self.depth - 1)]
        return out


@functools.lru_cache(maxsize=2)
def maker_for(lexicon: tuple[tuple[str, float], ...]) -> FeatureMaker:
    """One maker for a lexicon in each Python worker, so that what it knows of words outlives a task."""
    return FeatureMaker(dict(lexicon))


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: BoostedTrees
    scale: Isotonic

    def scores(self, texts: list[str], maker: FeatureMaker | None = None) -> np.ndarray:
        maker = maker or FeatureMaker(self.lexicon)
        if not texts:
            return np.empty(0)
        return self.scale(self.trees.raw(np.array([maker(t) for t in texts])))


def fit(sample: list[tuple[str, int]], counts: dict[int, int], folds: int = 3) -> ToxicityModel:
    """The model from all of the sample, each part learned as it will be used.

    Features of a fold come from the lexicon of the other folds, so the trees see how far an entry carries beyond the
    texts that it was found in; the calibration sees each fold's scores by trees of the others. The lexicon and trees
    of the model are then those of the whole sample. Weights restore the labels' real shares.
    """
    sample = list(sample)
    random.Random(6).shuffle(sample)
    texts, labels = [t for t, _ in sample], [y for _, y in sample]
    y = np.array(labels, float)
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(set(labels)) < 2:
        return ToxicityModel({}, BoostedTrees(), Isotonic(np.empty(0), np.empty(0), prior=rate))
    fold = np.arange(len(sample)) % folds
    share = {k: counts.get(k, 1) / labels.count(k) for k in (0, 1)}
    w = np.array([share[k] for k in labels])
    w /= w.mean()
    x = np.zeros((len(sample), len(FEATURES)))
    table = KeyTable(texts, labels)
    for k in range(folds):
        maker = FeatureMaker(learn_lexicon(table, fold != k))
        for i in np.flatnonzero(fold == k).tolist():
            x[i] = maker(texts[i])
    raw = np.zeros(len(sample))
    for k in range(folds):
        own = fold == k
        raw[own] = BoostedTrees().fit(x[~own], y[~own], w[~own]).raw(x[own])
    return ToxicityModel(learn_lexicon(table, fold >= 0), BoostedTrees().fit(x, y, w), Isotonic(raw, y, w, rate))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; score: the probability that labels.toxic is 1.

    Learned from a bounded sample of the training fold (sample_rows of each label, sample_bytes of their texts). Every
    text is scored whole; a null text counts as an empty one, whose features are all zero. Null ids are in the
    training fold but teach nothing; repeated rows score alike; an empty table gives no rows; without labels every
    score is the base rate, 0.
    """
    model = fit(*labelled_sample(docs, labels, "toxic", sample_rows, sample_bytes, id_col, text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), (~in_training_fold(F.col(id_col))).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = maker_for(tuple(sorted(model.lexicon.items())))
        for batch in batches:
            x = np.empty((batch.num_rows, len(FEATURES)))
            for k, t in enumerate(batch.column(2)):
                x[k] = maker(t.as_py())
            p = model.scale(model.trees.raw(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
