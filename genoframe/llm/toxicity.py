"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word is its own bucket and the buckets of its character n-grams; a text is the
average of its words' vectors, and a linear softmax maps it to two classes.
Embeddings and softmax are trained jointly with numpy on a bounded sample of
labelled texts, so a misspelt word is near the word it shares n-grams with.

Because the softmax is linear in the average, each word adds a scalar; executors
remember that scalar by word. The average is taken over passages of ``PASSAGE``
words, in which a repeated word counts once, and a text's score is that of its
strongest passage: a few toxic lines are not thinned out by a long text around
them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cached_property
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.3
#: Labelled texts the model is fitted on, at most: those of least hash of their id.
TRAIN_ROWS = 6_000
#: Of them, with no more than so many characters in all.
TRAIN_CHARS = 24_000_000
PASSAGE = 12
BUCKETS = 1 << 17
DIM = 8
NGRAMS = (3, 5)
#: Beginnings of words, in bytes with the mark: stems with an ending of any kind share them.
STEMS = (6, 7, 8)
CACHE_WORDS = 100_000
#: With fewer texts of a label than this, all are trained on and calibration is by parts.
SCARCE, FOLDS = 1_000, 3
#: Words whose buckets are made at a time, and characters and texts that are scored together.
WORDS_AT_ONCE = 20_000
CHARS_AT_ONCE, TEXTS_AT_ONCE = 500_000, 1_000
_MASK, _WIDE = BUCKETS - 1, 1 << 32

#: Letters and digits, with other marks only inside: ``st*pid`` is a word.
_WORD = re.compile(r"\w+(?:[*@$#'’+-]+\w+)*")


def words_of(text: str | None) -> list[str]:
    """Words in lower case; bare numbers are left out, as they carry no tone."""
    return [w for w in _WORD.findall(text.lower()) if not w.isdigit()] if text else []


def buckets_of(word: str) -> list[int]:
    """The word's bucket and those of its byte n-grams between marks, and of its beginnings."""
    marked = b"<%b>" % word.encode()
    found = [crc32(marked) & _MASK]
    found += [crc32(marked[:n]) & _MASK for n in STEMS if len(marked) > n]
    for n in NGRAMS:
        found += [crc32(marked[i : i + n]) & _MASK for i in range(len(marked) - n + 1)]
    return found


class ToxicityModel:
    """``weight`` of each bucket: its embedding times the difference of the softmax's rows."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.array(self.strengths(texts)) + self.bias, -30, 30)))

    @cached_property
    def logits(self) -> "_Logits":
        return _Logits(self.weight)

    def __getstate__(self) -> dict:
        return {"weight": self.weight, "bias": self.bias}

    def calibrated(self, texts: list[str | None], labels: list[int]) -> "ToxicityModel":
        """Scale and shift, fitted on texts that the model was not trained on (one weak pseudo-example a class)."""
        return self.fitted_to(self.strengths(texts), labels)

    def strengths(self, texts: list[str | None]) -> list[float]:
        found: list[float] = []
        for own in _batches(texts):
            found += self.logits.strongest([words_of(t) for t in own]).tolist()
        return found

    def fitted_to(self, strengths: list[float], labels: list[int]) -> "ToxicityModel":
        """Scale and shift by logistic regression of labels on strengths."""
        x = np.array([*strengths, 0.0, max([0.0, *strengths])])
        y = np.array([*labels, 0, 1], float)
        a, b, unit = 1.0, self.bias, max(1.0, float(np.abs(x).max()))
        x = x / unit
        a *= unit
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            grad = np.array([((p - y) * x).sum() + 1e-3 * a, (p - y).sum()])
            hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum()]])
            step = np.clip(np.linalg.solve(hess, grad), -5, 5)
            a, b = a - step[0], b - step[1]
        if a <= 0:
            return self
        return ToxicityModel((self.weight * (a / unit)).astype(np.float32), float(b))


def _batches(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about ``CHARS_AT_ONCE`` characters."""
    own, chars = [], 0
    for t in texts:
        own.append(t)
        chars += len(t or "")
        if chars >= CHARS_AT_ONCE or len(own) >= TEXTS_AT_ONCE:
            yield own
            own, chars = [], 0
    if own:
        yield own


class _Logits(dict):
    """Numbers of words, and what each adds to the class difference."""

    def __init__(self, weight: np.ndarray):
        super().__init__()
        self.weight, self.values = weight.astype(float), np.zeros(1024)

    def learn(self, words: list[str]) -> None:
        """Number new words: the average weight of a word's buckets that have one."""
        for at in range(0, len(words), WORDS_AT_ONCE):
            part, k = words[at : at + WORDS_AT_ONCE], len(self)
            buckets, owner = _all_buckets(part)
            weight = self.weight[buckets]
            known = np.bincount(owner, weight != 0, len(part))
            sums = np.bincount(owner, weight, len(part))
            if k + len(part) > len(self.values):
                self.values = np.concatenate([self.values[:k], np.zeros(k + 2 * len(part))])
            self.values[k : k + len(part)] = sums / np.maximum(1, known)
            self.update(zip(part, range(k, k + len(part))))

    def strongest(self, texts: list[list[str]]) -> np.ndarray:
        """For each text's words, the largest sum over a passage's different words, by its length; 0 without words."""
        out = np.zeros(len(texts))
        flat = [w for words in texts for w in words]
        if not flat:
            return out
        if len(self) > CACHE_WORDS:
            self.clear()
        self.learn([w for w in dict.fromkeys(flat) if w not in self])
        ids = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        n = np.array([len(words) for words in texts])
        own = np.flatnonzero(n)
        n = n[own]
        k = np.maximum(1, np.rint(n / PASSAGE).astype(np.int64))
        first = np.cumsum(k) - k
        at = (np.arange(k.sum()) - np.repeat(first, k)) * np.repeat(n, k) // np.repeat(k, k) + np.repeat(np.cumsum(n) - n, k)
        size = np.diff(np.append(at, len(ids)))
        pair = np.sort(np.repeat(np.arange(len(at)), size) * _WIDE + ids)
        pair = pair[np.diff(pair, prepend=-1) != 0]
        sums = np.bincount(pair // _WIDE, self.values[pair % _WIDE], len(at)) / size
        out[own] = np.maximum.reduceat(sums, first)
        return out


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def _all_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`buckets_of` finds, for many words at once, and the number of the word of each; a byte further in each step."""
    marked = [b"<%b>" % w.encode() for w in words]
    whole = np.fromiter(map(crc32, marked), np.int64, len(marked)) & _MASK
    data = np.frombuffer(b"".join(marked), np.uint8)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))  # bytes of the word from here on
    begins = np.repeat(np.cumsum(size) - size, size) == np.arange(len(data))
    at, state = np.arange(len(data)), np.full(len(data), 0xFFFFFFFF, np.uint32)
    found, owners = [whole], [np.arange(len(words))]
    for n in range(1, max(*NGRAMS, *STEMS) + 1):
        wanted = left[at] >= n
        if n > max(NGRAMS):
            wanted &= begins[at]
        at, state = at[wanted], state[wanted]
        state = _CRC[(state ^ data[at + n - 1]) & np.uint32(255)] ^ (state >> np.uint32(8))
        for take in [np.s_[:]] * (n in NGRAMS) + [begins[at] & (left[at] > n)] * (n in STEMS):
            found.append((~state[take]).astype(np.int64) & _MASK)
            owners.append(owner[at[take]])
    return np.concatenate(found), np.concatenate(owners)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words one after the other, and how many each has."""
    found = [buckets_of(w) for w in words]
    size = np.array([len(f) for f in found], np.int32)
    return np.fromiter((b for f in found for b in f), np.int32, int(size.sum())), size


def _added(index: np.ndarray, values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``values[at]`` added up by ``index``, a slice at a time so that no array as long as all pairs is made."""
    out = np.zeros(n)
    for k in range(0, len(index), 1 << 20):
        out += np.bincount(index[k : k + (1 << 20)], values[at[k : k + (1 << 20)]], n)
    return out


def _passages(n: int) -> np.ndarray:
    """Starts of passages of about ``PASSAGE`` words, none much shorter unless alone."""
    k = max(1, round(n / PASSAGE))
    return (np.arange(k) * n) // k


def train(texts: list[str | None], labels: list[int], *, dim: int = DIM, rounds: int = 120, seed: int = 7) -> ToxicityModel:
    """Fit embeddings and softmax jointly, by Adam on whole passes.

    All passages of a text with label 0 are examples of 0; of a text with label 1
    the passages share one example of 1 by their strength, as the model stands, so
    that the share moves to the passages that are like each other. Buckets that only
    one text has are not fitted and left out of a word's average. Without labels of both classes
    the score is near that class everywhere.
    """
    y = np.array(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), -20.0 if share == 0 else 20.0)
    number: dict[str, int] = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in words_of(t) or [""]], np.int32) for t in texts]
    texts_with = np.bincount(np.concatenate([np.unique(r) for r in rows]), minlength=len(number))
    # Buckets of one text only say nothing of other texts: a word is the average of its others.
    words = list(number)
    del number
    n_texts = np.zeros(BUCKETS)
    for at in range(0, len(words), WORDS_AT_ONCE):
        grams, size = _grams(words[at : at + WORDS_AT_ONCE])
        n_texts += np.bincount(grams, np.repeat(texts_with[at : at + WORDS_AT_ONCE], size), BUCKETS)
    kept, sizes = array("i"), []
    for at in range(0, len(words), WORDS_AT_ONCE):
        grams, size = _grams(words[at : at + WORDS_AT_ONCE])
        shared = n_texts[grams] > 1
        kept.frombytes(grams[shared].tobytes())
        sizes.append(np.bincount(np.repeat(np.arange(len(size)), size)[shared], minlength=len(size)).astype(np.int32))
    grams, size = np.frombuffer(kept, np.int32), np.concatenate(sizes)
    del words, sizes, n_texts, texts_with
    compact = np.where(size > 0, np.cumsum(size > 0) - 1, -1).astype(np.int32)
    size = size[size > 0]
    if not len(size):
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    lengths = [len(r) for r in rows]
    token = compact[np.concatenate(rows)].astype(np.int32)
    del rows
    n = sum(lengths)
    starts = [_passages(k) + at for k, at in zip(lengths, np.cumsum(lengths) - lengths)]
    start = np.concatenate(starts)
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    text_start = np.searchsorted(owner, np.arange(len(texts)))
    length = np.diff(np.append(start, n)).astype(np.float32)
    firsts, seconds = [], []
    for at in range(0, len(start), 20_000):  # a word counts once in a passage
        size_of = length[at : at + 20_000].astype(np.int64)
        own = token[start[at] : start[at] + int(size_of.sum())]
        passage = np.repeat(np.arange(at, at + len(size_of)), size_of)
        pair = np.unique(passage[own >= 0] * np.int64(_WIDE) + own[own >= 0])
        firsts.append((pair // _WIDE).astype(np.int32))
        seconds.append((pair % _WIDE).astype(np.int32))
    p_of, w_of = np.concatenate(firsts), np.concatenate(seconds)
    del firsts, seconds, token
    used = np.flatnonzero(np.bincount(grams, minlength=BUCKETS))
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    for k in range(0, len(grams), 1 << 20):
        grams[k : k + (1 << 20)] = place[grams[k : k + (1 << 20)]]
    # Words in slices of about a million buckets: (first and last word, first and last bucket).
    ends = np.cumsum(size)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, int(ends[-1]), 1 << 20)), len(size)))
    slices = [(a, b, int(ends[a] - size[a]), int(ends[b - 1])) for a, b in zip(cuts, cuts[1:])]

    rng = np.random.default_rng(seed)
    emb = (rng.normal(size=(len(used), dim)) * 0.1).astype(np.float32)
    out = (rng.normal(size=(2, dim)) / np.sqrt(2)).astype(np.float32)  # a row for each class
    bias = np.array([1.5, -1.5], np.float32)
    values = [emb, out, bias]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    scale = np.float32(PASSAGE)  # an average over a passage is small: let one word count
    positive = y[owner] == 1
    for t in range(1, rounds + 1):
        # The softmax is linear, so averages of vectors are taken after the product.
        turn = out[1] - out[0]
        gram_logit = emb @ turn
        sums = [np.add.reduceat(gram_logit[grams[i:j]], ends[a:b] - size[a:b] - i) for a, b, i, j in slices]
        word_logit = np.concatenate(sums) / size
        logit = _added(p_of, word_logit, w_of, len(start)) / length * scale + bias[1] - bias[0]
        chance = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        strong = np.exp(np.minimum(logit - np.maximum.reduceat(logit, text_start)[owner], 0))
        strong /= np.add.reduceat(strong, text_start)[owner]
        g = np.where(positive, strong * (chance - 1), 0.2 * chance) / len(texts)
        g_word = _added(w_of, g / length, p_of, len(size)) * scale / size
        g_gram = np.zeros(len(used))
        for a, b, i, j in slices:
            g_gram += np.bincount(grams[i:j], np.repeat(g_word[a:b], size[a:b]), len(used))
        g_gram = g_gram.astype(np.float32)
        pull = emb.T @ g_gram
        grads = [g_gram[:, None] * turn + 1e-6 * emb, np.stack([-pull, pull]), np.array([-g.sum(), g.sum()], np.float32)]
        for value, grad, (m, v) in zip(values, grads, moments):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = (emb @ (out[1] - out[0])) * scale
    return ToxicityModel(weight, float(bias[1] - bias[0]))


def fit(texts: list[str | None], labels: list[int]) -> ToxicityModel:
    """Train, and calibrate on texts that were not trained on.

    With many labels one of eight texts is put aside for that. With fewer than ``SCARCE``
    of a label every text counts: each of ``FOLDS`` parts is scored by a model of the
    others, and those scores calibrate the model of all.
    """
    order = np.random.default_rng(11).permutation(len(texts)).tolist()
    pick = lambda own: ([texts[k] for k in own], [labels[k] for k in own])
    if min(sum(labels), len(labels) - sum(labels)) >= SCARCE:
        aside, rest = order[: len(order) // 8], order[len(order) // 8 :]
        return train(*pick(rest)).calibrated(*pick(aside))
    model = train(*pick(order))
    scores, truth = [], []
    for k in range(FOLDS):
        part = train(*pick([t for n, t in enumerate(order) if n % FOLDS != k]))
        own = order[k::FOLDS]
        scores += part.strengths([texts[t] for t in own])
        truth += [labels[t] for t in own]
    return model.fitted_to(scores, truth) if {0, 1} <= set(truth) and model.weight.any() else model


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, *, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS
) -> ToxicityModel:
    """Fit on labelled documents whose crc32(doc_id as text) mod 4 is not 2.

    The bound of what the driver holds: of each label about half of ``train_rows``, those
    of least hash of their id, or fewer where they have more than about ``train_chars``
    characters together. The bias is then set right for the labels' true shares. Null
    labels and ids are left out; of rows that repeat an id one text (the least) is taken,
    and one toxic label among an id's labels makes it toxic.
    """
    own = labels.select(F.col("doc_id").alias("i"), (F.col("toxic") > 0).cast("int").alias("y")).filter("i is not null and y is not null")
    own = own.filter(F.crc32(F.col("i").cast("string").cast("binary")) % 4 != 2).withColumn("h", F.pmod(F.xxhash64("i"), F.lit(1 << 30)))
    docs = documents.select(F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("x"))

    def sample(shares: list[float], what: Column) -> DataFrame:
        # At most some tens of thousands of different ids: a bounded broadcast.
        limit = F.when(F.col("y") == 1, int((1 << 30) * shares[1])).otherwise(int((1 << 30) * shares[0]))
        ids = own.filter(F.col("h") < limit).groupBy("i", "h").agg(F.max("y").alias("y"))
        return docs.join(F.broadcast(ids), "i").groupBy("i", "h", "y").agg(what)

    def seen(rows: DataFrame) -> list[int]:
        found = dict(tuple(r) for r in rows.groupBy("y").count().collect())
        return [found.get(0, 0), found.get(1, 0)]

    # Only some labels have a document: look at more, then keep the share that is wanted.
    half = train_rows / 2
    shares = [min(1.0, 3 * half / max(1, n)) for n in seen(own)]
    lengths = sample(shares, F.max(F.length("x")).alias("c"))
    sized = {r["y"]: (r["n"], r["c"]) for r in lengths.groupBy("y").agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()}
    there = [sized.get(y, (0, 0))[0] / max(s, 1e-9) for y, s in enumerate(shares)]
    for y, (n, chars) in sized.items():
        shares[y] *= min(1.0, half / n, train_chars / 2 / max(1, chars))
    kept = sample(shares, F.min("x").alias("x")).select("h", "x", "y").toPandas().sort_values(["h", "x", "y"], kind="stable")
    model = fit(kept["x"].tolist(), kept["y"].tolist())
    n1, n0 = int((kept["y"] == 1).sum()), int((kept["y"] == 0).sum())
    if n0 and n1:
        model.bias += float(np.log(there[1] / there[0]) - np.log(n1 / n0))
    return model


def score_toxicity(documents: DataFrame, model: ToxicityModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """Every row with ``score`` and ``predicted`` (1 if score >= ``threshold``) added.

    The score depends on the text alone; null and empty texts get the score of no
    words. Columns of those names are replaced, all others stay.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in texts:
            yield pd.Series(model.scores(batch.tolist()), dtype=float)

    return documents.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
