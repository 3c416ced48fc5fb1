"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear support vector machine over sentences.

The kernel compares two strings by the triples of symbols that they share in order, gaps allowed: a triple that spans
``s`` places weighs ``DECAY ** s``, up to ``SPAN`` places. So ``idiot``, ``id-iot``, ``idxiot`` and ``i.d.i.o.t`` are near
each other. Symbols are a unit's start, letters, digits that stand for letters, and classes of other letters; anything else only widens gaps. The kernel is normalised: a string's value with itself is 1.

Training sentences carry their document's label; a sentence in documents of both kinds is toxic, and equal sentences count
once. A sentence is a bag of units: words, with runs of single letters taken together; a longer unit is read in overlapping
windows, all of them. A toxic sentence is toxic by some of its units, which the labels don't name, so training takes turns
(multiple-instance learning): the machine says which unit of every toxic sentence is its witness, if any, and is trained
anew on witnesses against units of clean sentences. The first turn's decision is the difference of the mean embeddings of
toxic and clean sentences in the kernel's own space, in units of what chance gives it, where that exceeds ``CHANCE``.

Kernel values against the landmarks, times the inverse root of the landmarks' own kernel matrix, are the features; Newton
steps fit a squared-hinge machine, weighing both classes alike. As the machine is linear, its decision is a sum over
triples, so landmarks fold into one weight per triple and a unit is scored without them; that is the same number. A
logistic curve over some of a document's best units (``RANKS``) and the number of its units turns them into its score: where
toxic words are made of common syllables, one of them may be chance and five are not.

Bounds of the training sample, each a parameter: ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` documents, the first by a hash of
their ids, as far as ``SAMPLE_CHARS`` characters in all go (but for the first of each kind, whole documents); ``WITNESSES`` strings of
toxic and ``CLEAN_UNITS`` of clean sentences in the machine, of clean ones those in most sentences, some by chance, and in
each turn those that the machine takes most for toxic. Every document is scored over its whole text.

Defined results: null text is empty, and an empty text has the score of a document without any unit; labels that are null
or of unknown documents aren't used; a document with labels of both kinds counts as toxic; of rows with one id, the greatest text is learnt from; repeated rows are scored each
on its own; without a document of each kind all scores are 0; other columns are not looked at, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.whole import as_text, kinds, restored

DECAY, SPAN, WINDOW, STEP = 0.6, 8, 20, 10
SYMBOLS, START = 65, 64
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1500, 3000, 20_000_000
LANDMARKS, WITNESSES, CLEAN_UNITS = 256, 3000, 6000
CHANCE, TURNS = 4.0, 4
#: How many times likelier in toxic sentences a witness is than others, and what share of clean sentences' units its value exceeds, at first and later.
LIFT, FIRST, LATER = 3.0, 0.995, 0.999
CACHE = 200_000
#: Places (from 0) of a document's units, best first, whose decision values make its score.
RANKS = np.array([0, 1, 2, 4, 7, 12, 20, 33, 54])

#: Digits that stand for letters.
LEET = str.maketrans("013457", "oieast")
_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "¡¿«»„“”‘’…–—"
_SINGLE = re.compile(r"(?:(?<=\s)|^)\w(?:\s+\w(?=\s|$)){2,}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n")
_WEIGHT = DECAY ** np.arange(SPAN + 1, dtype=float)


def _symbol(c: str) -> int:
    """Code of a character; 0 matches nothing."""
    c = c.translate(LEET)
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % 37 if c >= "\x80" and c.isalpha() else 0


@functools.cache
def _table() -> np.ndarray:
    """The codes of the first 65536 characters."""
    return np.array([_symbol(chr(c)) for c in range(1 << 16)], np.int32)


def coded(strings: list[str]) -> np.ndarray:
    """A row of codes for each string: its start, its characters, and zeros."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _table()[np.minimum(flat, 65535)]
    for at in np.flatnonzero(flat > 65535):
        codes[at] = _symbol(chr(flat[at]))
    out = np.zeros((len(strings), int(lengths.max(initial=0)) + 1), np.int32)
    out[:, 0] = START
    out[np.repeat(np.arange(len(strings)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1] = codes
    return out


def units(text: str) -> set[str]:
    """The distinct units of a text: lower-case words without outer punctuation, and runs of single letters as one."""
    low = text.lower()
    found = {w.strip(_EDGE) for w in set(low.split())}
    for m in _SINGLE.finditer(low):
        found.add("".join(m[0].split()))
    found.discard("")
    return found


def windows(unit: str) -> list[str]:
    if len(unit) <= WINDOW:
        return [unit]
    return [unit[i : i + WINDOW] for i in range(0, len(unit) - WINDOW + STEP, STEP)]


class Features:
    """Strings as rows of a sparse matrix: ``code`` and ``value`` of triples, normalised; row ``i`` is ``starts[i]:starts[i + 1]``."""

    __slots__ = ("code", "row", "rows", "value")

    def __init__(self, strings: list[str]) -> None:
        codes = coded(strings)
        length = codes.shape[1]
        steps = [(i, j, k) for i in range(length) for j in range(i + 1, min(length, i + SPAN - 1)) for k in range(j + 1, min(length, i + SPAN))]
        self.rows = len(strings)
        if not steps:
            self.code, self.row, self.value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            return
        i, j, k = np.array(steps).T
        a, b, c = codes[:, i], codes[:, j], codes[:, k]
        # a triple and its span in one number, so that a row's equal triples lie together once sorted
        packed = np.where((a > 0) & (b > 0) & (c > 0), (((a * SYMBOLS + b) * SYMBOLS + c) << 4) | (k - i + 1), 0)
        packed.sort(axis=1)
        row, at = np.nonzero(packed)
        flat = packed[row, at]
        code = flat >> 4
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])) if len(code) else np.zeros(0, np.int64)
        value = np.add.reduceat(_WEIGHT[flat & 15], first) if len(code) else np.zeros(0)
        self.code, self.row = code[first].astype(np.int64), row[first]
        norm = np.sqrt(np.bincount(self.row, value**2, self.rows))
        self.value = value / np.maximum(norm, 1e-12)[self.row]

    def dot(self, table: np.ndarray) -> np.ndarray:
        """The sums of each row's values times the table's weights."""
        return np.bincount(self.row, table[self.code] * self.value, self.rows)


def batches_of(strings: list[str], size: int = 512) -> Iterator[tuple[np.ndarray, Features]]:
    """All strings, in batches of about one length each, and their places."""
    order = np.argsort([len(s) for s in strings], kind="stable")
    for lo in range(0, len(order), size):
        at = order[lo : lo + size]
        yield at, Features([strings[i] for i in at])


def unit_scores(strings: list[str], table: np.ndarray) -> np.ndarray:
    """Decision values of strings: their normalised triples times their weights in ``table``."""
    out = np.zeros(len(strings))
    for at, f in batches_of(strings):
        out[at] = f.dot(table)
    return out


def kernel(left: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel values, strings by landmarks."""
    own = Features(landmarks)
    used, column = np.unique(own.code, return_inverse=True)
    dense = np.zeros((len(used) + 1, len(landmarks)), np.float32)  # the last row stands for triples of no landmark
    dense[column, own.row] = own.value
    place = np.full(SYMBOLS**3, len(used), np.int32)
    place[used] = np.arange(len(used))
    out = np.zeros((len(left), len(landmarks)))
    for at, f in batches_of(left, 32):
        if len(f.row):
            held, starts = np.unique(f.row, return_index=True)
            part = dense[place[f.code]]
            part *= f.value[:, None].astype(np.float32)
            out[at[held]] = np.add.reduceat(part, starts, axis=0)
    return out


#: Rows of features that are made, or enter a Newton step, together.
BLOCK = 1024


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 300.0) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on its active rows; ``x`` is never copied whole."""
    w = np.zeros(x.shape[1] + 1)
    reg = np.eye(len(w))
    reg[-1, -1] = 1e-3
    for _ in range(40):
        left, right = reg.copy(), np.zeros(len(w))
        for lo in range(0, len(x), BLOCK):
            at = slice(lo, lo + BLOCK)
            active = y[at] * (x[at] @ w[:-1] + w[-1]) < 1
            rows = np.hstack([x[at][active], np.ones((int(active.sum()), 1))])
            a = rows * (weight[at][active] * c)[:, None]
            left += a.T @ rows
            right += a.T @ y[at][active]
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            w = new
            break
        w = new
    return w[:-1], float(w[-1])


def machine(strings: list[str], labels: np.ndarray, weight: np.ndarray, landmarks: list[str]) -> tuple[np.ndarray, float]:
    """A support vector machine on Nystroem features, folded to one weight per triple, and its bias."""
    own = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-4 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = np.empty((len(strings), root.shape[1]))
    for lo in range(0, len(strings), BLOCK):
        x[lo : lo + BLOCK] = kernel(strings[lo : lo + BLOCK], landmarks) @ root
    w, bias = _svm(x, labels, weight)
    f = Features(landmarks)
    return np.bincount(f.code, f.value * (root @ w)[f.row], SYMBOLS**3), bias


#: Units whose windows are looked at together.
UNITS = 16_384


def evidence(units_: list[str], toxic: np.ndarray, every: np.ndarray, share: float) -> np.ndarray:
    """For each triple, how far its sum over toxic sentences exceeds their share of all, in standard deviations of chance.

    ``toxic`` and ``every`` are the numbers of toxic and of all sentences that hold a unit.
    """
    seen, spread = np.zeros(SYMBOLS**3), np.zeros(SYMBOLS**3)
    for lo in range(0, len(units_), UNITS):
        parts = [(i, w) for i, u in enumerate(units_[lo : lo + UNITS], lo) for w in windows(u)]
        at = np.array([p[0] for p in parts])
        for rows, f in batches_of([p[1] for p in parts]):
            unit = at[rows][f.row]
            seen += np.bincount(f.code, f.value * (toxic - share * every)[unit], len(seen))
            spread += np.bincount(f.code, f.value**2 * every[unit], len(seen))
    return seen / np.sqrt(share * (1 - share) * spread + 1.0)


def best_windows(units_: list[str], table: np.ndarray, bias: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Each unit's highest decision value over its windows, and which window has it."""
    best, which = np.full(len(units_), -np.inf), np.zeros(len(units_), np.int32)
    for lo in range(0, len(units_), UNITS):
        parts = [(i, n, w) for i, u in enumerate(units_[lo : lo + UNITS], lo) for n, w in enumerate(windows(u))]
        value = unit_scores([p[2] for p in parts], table) + bias
        for (i, n, _), v in zip(parts, value.tolist(), strict=True):
            if v > best[i]:
                best[i], which[i] = v, n
    return best, which


def doc_features(units_of: list[set[str]], table: np.ndarray, bias: float, cache: dict[str, float]) -> np.ndarray:
    """Decision values of the units at ``RANKS``, within the margins (-1 where there are fewer), and the log of the number of units."""
    new = list({u for us in units_of for u in us if u not in cache})
    if len(cache) + len(new) > CACHE:
        cache.clear()
        new = list({u for us in units_of for u in us})
    if new:
        cache.update(zip(new, best_windows(new, table, bias)[0].tolist(), strict=True))
    out = np.full((len(units_of), len(RANKS) + 1), -1.0)
    for i, us in enumerate(units_of):
        top = np.sort(np.fromiter(map(cache.__getitem__, us), float, len(us)))[::-1]
        held = top[RANKS[RANKS < len(top)]]
        out[i, : len(held)] = np.clip(held, -1.0, 1.0)
        out[i, -1] = np.log1p(len(us))
    return out


def probabilities(x: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ curve[:-1] + curve[-1], -30, 30)))


def train(texts: list[str], toxic: list[int], *, seed: int = 7) -> dict:
    """A model from documents and their labels: ``table`` (a weight per triple), ``bias``, ``curve``."""
    rng = np.random.default_rng(seed)
    y = np.array(toxic)
    none = {"table": None, "bias": 0.0, "curve": None}
    if not (y == 1).any() or not (y == 0).any():
        return none
    place: dict[str, int] = {}
    held = (array("q"), array("q"))  # for each unit, the numbers of clean and of toxic sentences that hold it
    bags, starts = array("i"), array("q")  # toxic sentences as places of their units, one after the other
    sentences, seen = [0, 0], set()
    for label in (1, 0):  # toxic ones first: a sentence of both kinds is toxic
        for i in np.flatnonzero(y == label):
            for s in _SENTENCE.split(texts[i]):
                key = hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                us = units(s) if key not in seen else ()
                if not us:
                    continue
                seen.add(key)
                sentences[label] += 1
                if label:
                    starts.append(len(bags))
                for u in us:
                    at = place.setdefault(u, len(place))
                    if at == len(held[0]):
                        held[0].append(0)
                        held[1].append(0)
                    held[label][at] += 1
                    if label:
                        bags.append(at)
    del seen
    share = sentences[1] / max(1, sum(sentences))
    if not 0 < share < 1:
        return none
    # places in the order of names, whatever the order of texts and of sets
    names = sorted(place)
    order = np.fromiter(map(place.__getitem__, names), np.int64, len(names))
    moved = np.empty(len(names), np.int32)
    moved[order] = np.arange(len(names), dtype=np.int32)
    in_clean, in_toxic = (np.array(own, float)[order] for own in held)
    toxic_units, first = moved[np.array(bags, np.int32)], np.array(starts, np.int64)
    of = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(first, append=len(toxic_units)))
    toxic_units = toxic_units[np.lexsort((toxic_units, of))]
    del bags, starts, place, held, moved, order
    z = evidence(names, in_toxic, in_toxic + in_clean, share)
    best, window = best_windows(names, np.where(z > CHANCE, z, 0.0))

    def above(share_: float) -> float:
        """The value that this share of what clean sentences hold does not exceed."""
        order = np.argsort(best)
        passed = np.cumsum(in_clean[order]) / in_clean.sum()
        return max(0.0, float(best[order[min(len(order) - 1, int(np.searchsorted(passed, share_)))]]))

    floor = above(FIRST)
    negatives = np.flatnonzero(in_clean > 0)
    common = negatives[np.argsort(-in_clean[negatives], kind="stable")][: CLEAN_UNITS // 3]
    pool = set(common.tolist()) | set(rng.permutation(negatives)[: CLEAN_UNITS // 3].tolist())
    model = None
    for _ in range(TURNS):
        highest = np.maximum.reduceat(best[toxic_units], first)
        top = np.flatnonzero(best[toxic_units] == highest[of])
        top = toxic_units[top[np.unique(of[top], return_index=True)[1]]]
        found, since, times = np.unique(top[highest > floor], return_index=True, return_counts=True)
        by_times = np.lexsort((since, -times))
        witness = dict(zip(found[by_times].tolist(), times[by_times].tolist(), strict=True))
        # a unit that is common in clean sentences, too, tells nothing
        chosen = [u for u in witness if in_toxic[u] * (1 - share) >= LIFT * share * in_clean[u]][:WITNESSES]
        if not chosen:
            break
        hard = negatives[np.argsort(-best[negatives], kind="stable")][: CLEAN_UNITS // 3]
        pool |= set(hard.tolist())
        clean = sorted(pool - {u for u in chosen if in_toxic[u] > in_clean[u]})
        if not clean:
            break
        pos, neg = np.array([witness[u] for u in chosen], float), np.sqrt(in_clean[clean])
        weight = np.concatenate([pos / pos.sum(), neg / neg.sum()])
        some = list(dict.fromkeys(chosen[: LANDMARKS // 4] + [chosen[i] for i in rng.permutation(len(chosen))[: LANDMARKS // 4]]))
        some += [clean[i] for i in rng.permutation(len(clean))[: LANDMARKS - len(some)]]
        strings = [windows(names[u])[window[u]] for u in chosen + clean]
        table, bias = machine(strings, np.array([1.0] * len(chosen) + [-1.0] * len(clean)), weight, list(dict.fromkeys(windows(names[u])[window[u]] for u in some)))
        model = {"table": table, "bias": bias}
        best, window = best_windows(names, table, bias)
        floor = above(LATER)
    if model is None:
        return none
    del toxic_units, of
    cache = dict(zip(names, best.tolist(), strict=True))  # sentences have all units but runs of letters over a sentence's end
    x = np.concatenate([doc_features([units(t) for t in texts[i : i + 256]], model["table"], model["bias"], cache) for i in range(0, len(texts), 256)])
    told = x[:, -1] > 0  # a text without units tells nothing about the score of others
    model["curve"] = _logistic(x[told], y[told]) if (y[told] == 1).any() and (y[told] == 0).any() else _logistic(x, y)
    model["table"] = model["table"].astype(np.float32)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic curve, by Newton steps. A better unit never lowers a score: where the curve would have it
    so, its column is left out. Toxic documents, which are fewer, weigh the square root of how many times fewer."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    of = np.where(y == 1, np.sqrt((y == 0).sum() / (y == 1).sum()), 1.0)
    free = np.arange(x1.shape[1])
    while True:
        own, w = x1[:, free], np.zeros(len(free))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            h = own.T @ (own * (of * (p * (1 - p) + 1e-6))[:, None]) + 0.1 * np.eye(len(w))
            step = np.linalg.solve(h, own.T @ (of * (p - y)) + 0.1 * w)
            w = w - step
            if np.abs(step).max() < 1e-7:
                break
        if not ((w < 0) & (free < len(RANKS))).any():
            out = np.zeros(x1.shape[1])
            out[free] = w
            return out
        free = free[(w >= 0) | (free >= len(RANKS))]


def held_out(doc_id: Column) -> Column:
    """Whether a document is of the fifth that no label may be learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def _trim() -> None:
    """Give what training has freed back to the system, where the C library can: a driver keeps it else for all its later work."""
    gc.collect()
    if os.name == "posix" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """Train on a bounded sample of the labelled documents that aren't held out."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).filter("_y IS NOT NULL AND _id IS NOT NULL").filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    order = F.xxhash64(F.lit("toxicity"), "_id")
    few = known.filter("_y = 1").orderBy(order, "_id").limit(SAMPLE_TOXIC).unionByName(known.filter("_y = 0").orderBy(order, "_id").limit(SAMPLE_CLEAN))
    few = F.broadcast(few.withColumn("_order", order))  # SAMPLE_TOXIC + SAMPLE_CLEAN rows at most
    plain = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = plain.join(few, "_id").groupBy("_id", "_y", "_order").agg(F.max("_text").alias("_text"))
    # whole documents, in the order of the hash, as far as the characters go
    before = Window.partitionBy("_y").orderBy("_order", "_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum(F.char_length("_text").cast("long")).over(before), F.lit(0))).filter(F.col("_before") < SAMPLE_CHARS // 2)
    rows = rows.select("_y", "_text", "_order", "_id").orderBy("_y", "_order", "_id").toPandas()
    texts, toxic = rows["_text"].tolist(), rows["_y"].astype(int).tolist()
    del rows
    model = train(texts, toxic)
    del texts
    _trim()
    return model


def score(docs: DataFrame, model: dict, *, doc_id: str = "doc_id", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """``doc_id, score`` and the columns of ``keep``; the model travels as one array of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [doc_id, *keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, cache = shared.value, {}
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                if m["table"] is None:
                    p = np.zeros(len(part))
                else:
                    p = probabilities(doc_features([units(t) for t in part["_text"]], m["table"], m["bias"], cache), m["curve"])
                out = part[names].copy()
                out["score"] = p
                yield out

    rows = docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return restored(as_text(rows).mapInPandas(run, f"{kinds(docs.select(*names))}, score double"), docs.select(*names))
