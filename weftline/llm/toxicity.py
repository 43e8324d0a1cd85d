"""Toxicity: a logistic classifier of words, regularised by counterfactuals.

Features are the words of a text and their beginnings, present or not. Which words mark toxic
texts is counted; the weights of those that do are fitted by Newton's method. A classifier that
only follows its labels learns that naming a group is toxic wherever toxic texts name it more
often. So each identity term in a sentence of the labelled texts is swapped, for the other
terms of its kind and for a neutral one, and the square of the change of the score is added to the
loss: what remains of a term's weight is what it shares with neutral words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, quoted, sliced, tidy, unused

#: Terms that name people by group, by kind; the first of each kind is neutral.
IDENTITY = {
    "people": ("people", "women", "men", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "foreigners", "blacks", "whites", "asians", "africans", "arabs", "mexicans", "gays", "lesbians", "gypsies"),
    "person": ("person", "woman", "man", "girl", "boy", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "immigrant", "refugee", "foreigner", "lesbian"),
    "adjective": ("human", "black", "white", "asian", "african", "american", "european", "arab", "latino", "mexican", "jewish", "islamic", "catholic", "gay", "queer", "bisexual", "transgender", "straight", "female", "male", "disabled", "deaf", "blind", "elderly", "young"),
    "menschen": ("menschen", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "schwarze", "behinderte", "schwule", "lesben"),
    "gens": ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "immigrés", "réfugiés", "noirs", "arabes", "homosexuels", "handicapés"),
    "gente": ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "inmigrantes", "refugiados", "negros", "árabes", "homosexuales", "discapacitados"),
}
STARTS = range(3, 9)
#: Of ASCII texts: what is no letter parts words.
PLAIN = bytes(i if 97 <= i <= 122 else 32 for i in range(256))
LETTERS, SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?\n\r]+")


def words(text: str) -> set[str]:
    """The different words of a text, in small letters."""
    low = text.lower()
    if low.isascii():
        return {w.decode() for w in set(low.encode().translate(PLAIN).split())}
    return set(LETTERS.findall(low))


def features(word: str) -> list[str]:
    """The word, and its beginnings of 3 to 8 letters, marked as such."""
    return [word, *(word[:k] + "-" for k in STARTS if k < len(word))]


class Finder:
    """Numbers of the known features in texts."""

    def __init__(self, names: Sequence[str]) -> None:
        self.number = {f: i for i, f in enumerate(names)}
        self.seen: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            got = self.seen[word] = tuple(self.number[f] for f in features(word) if f in self.number)
        return got

    def of(self, found: set[str]) -> set[int]:
        return {i for w in found for i in self.of_word(w)}


def swaps(identity: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """What each term is swapped for: all others of its kinds."""
    out = defaultdict(list)
    for terms in identity.values():
        for t in terms:
            out[t] += [u for u in terms if u != t]
    return dict(out)


def changes(text: str, finder: Finder, swap: Mapping[str, Sequence[str]]) -> Iterator[tuple]:
    """(features gained, features lost) of each sentence with one of its identity terms swapped."""
    if not any(t in swap for t in words(text)):
        return
    for sentence in SENTENCE.split(text):
        found = words(sentence)
        before = None
        for term in found & swap.keys():
            before = finder.of(found) if before is None else before
            for other in swap[term]:
                after = finder.of((found - {term}) | {other})
                if after != before:
                    yield tuple(sorted(after - before)), tuple(sorted(before - after))


def fit(y: np.ndarray, rows: np.ndarray, cols: np.ndarray, n: int, pairs: Sequence[tuple[tuple, tuple, float]], l2: float, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and offset that minimise the log loss over texts with features (rows, cols), plus l2 / 2
    times the squared weights, plus penalty / 2 times the squared changes of the score by swaps."""
    w, base = np.zeros(n), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    each = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b, _ in pairs])
    at = np.array([i for a, b, _ in pairs for i in (*a, *b)], np.int64)
    sign = np.array([s for a, b, _ in pairs for s in (1.0,) * len(a) + (-1.0,) * len(b)])
    often = np.array([c for *_, c in pairs]) * penalty
    score = lambda w, b: b + np.bincount(rows, w[cols], len(y))

    def swap_product(w: np.ndarray) -> np.ndarray:
        if not len(pairs):
            return np.zeros(n)
        return np.bincount(at, sign * (often * np.bincount(each, sign * w[at], len(pairs)))[each], n)

    def loss(w: np.ndarray, b: float) -> float:
        z = score(w, b)
        return float(np.logaddexp(0, z).sum() - y @ z + w @ (l2 * w + swap_product(w)) / 2)

    now = loss(w, base)
    for _ in range(50):
        p = 1 / (1 + np.exp(-score(w, base)))
        h = np.maximum(p * (1 - p), 1e-6)
        grad, grad_b = np.bincount(cols, (p - y)[rows], n) + l2 * w + swap_product(w), (p - y).sum()
        x, r = np.zeros(n + 1), -np.append(grad, grad_b)
        scale = 1 / np.append(np.bincount(cols, h[rows], n) + l2 + np.bincount(at, (often[each] if len(at) else None), n), h.sum())
        d = scale * r
        rz, first = r @ d, np.sqrt(r @ r)
        for _ in range(60):  # conjugate gradients for the Newton step
            hv = h * score(d[:-1], d[-1])
            q = np.append(np.bincount(cols, hv[rows], n) + l2 * d[:-1] + swap_product(d[:-1]), hv.sum())
            step = rz / max(d @ q, 1e-30)
            x, r = x + step * d, r - step * q
            if np.sqrt(r @ r) < 1e-3 * first:
                break
            z = scale * r
            rz, old = r @ z, rz
            d = z + rz / old * d
        size = 1.0
        while size > 1e-4 and (new := loss(w + size * x[:-1], base + size * x[-1])) > now:
            size /= 2
        if size <= 1e-4:
            break
        w, base = w + size * x[:-1], base + size * x[-1]
        if now - new < 1e-6 * abs(now):
            break
        now = new
    return w, float(base)


def labelled(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """text, y: about `sample` different texts of labelled rows, y being the mean of their labels.

    Texts are told apart and drawn by their own hash; only ids and hashes are joined with the labels.
    """
    y = F.col(label_col).cast("double")
    known = labels.where(F.col(id_col).isNotNull() & y.isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg((y > 0).cast("double")).alias("y"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = docs.where(learn & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"))
    texts = checkpointed(ids.join(known, "id").groupBy("h").agg(F.avg("y").alias("y")))
    n = max(1, texts.count())
    share = min(1.0, sample / n)
    drawn = texts.where(F.pmod(F.xxhash64("h", F.lit("toxic")), F.lit(1 << 30)) < int(share * (1 << 30)) + (share >= 1))
    rows = docs.where(learn & F.col(id_col).isNotNull()).select(text.alias("text"), F.xxhash64(text).alias("h"))
    return checkpointed(rows.join(F.broadcast(drawn), "h").dropDuplicates(["h"]).select("text", "y"))


def learned(sample: DataFrame, *, least: int, most: int, identity: Mapping[str, Sequence[str]], l2: float, penalty: float) -> tuple[list[str], np.ndarray, float]:
    """Names and weights of the features, and the offset."""
    sc = sample.sparkSession.sparkContext
    n, n1 = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    flat = float(np.log((n1 + 0.5) / (n - n1 + 0.5)))
    if n1 <= 0 or n1 >= n:
        return [], np.zeros(0), flat

    def of_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in sliced(batch, 0):
                got = Counter(f for t in some.column(0).to_pylist() for f in {f for w in words(t) for f in features(w)})
                yield pa.RecordBatch.from_arrays([pa.array(list(got)), pa.array(list(got.values()), pa.int64())], ["f", "n"])

    toxic = sample.where("y > 0.5").select("text").mapInArrow(of_toxic, "f string, n long")
    names = sorted(r[0] for r in toxic.groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("f").collect())
    if not names:
        return [], np.zeros(0), flat
    sent = sc.broadcast(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, sums = Finder(sent.value), np.zeros((2, len(sent.value)), np.float64)
        for batch in batches:
            for some in sliced(batch, 0):
                for t, y in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    at = list(finder.of(words(t)))
                    sums[0, at] += y
                    sums[1, at] += 1
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()])], ["sums"])

    total = np.zeros((2, len(names)))
    for r in sample.coalesce(32).mapInArrow(count, "sums binary").toLocalIterator():
        total += np.frombuffer(r[0]).reshape(total.shape)
    sent.destroy()
    ones, zeros = total[0], total[1] - total[0]
    odds = np.log((ones + 0.5) / (n1 - ones + 0.5)) - np.log((zeros + 0.5) / (n - n1 - zeros + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (ones + 0.5) + 1 / (zeros + 0.5))
    terms = {f for ts in identity.values() for t in ts for f in features(t)}
    chosen = {names[i] for i in np.argsort(-z, kind="stable")[:most] if z[i] > 2}
    chosen = sorted(chosen | (terms & set(names)))
    sent, swap = sc.broadcast(chosen), swaps(identity)

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, pairs = Finder(sent.value), Counter()
        for batch in batches:
            for some in sliced(batch, 0):
                texts = some.column(0).to_pylist()
                for t in texts:
                    pairs.update(changes(t, finder, swap))
                at = [sorted(finder.of(words(t))) for t in texts]
                nothing = pa.nulls(len(at), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(1), pa.array(at, pa.list_(pa.int32())), nothing, nothing], ["y", "at", "gained", "lost"])
        if pairs:
            gained, lost = (pa.array([p[k] for p in pairs], pa.list_(pa.int32())) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array([float(c) for c in pairs.values()]), pa.nulls(len(pairs), pa.list_(pa.int32())), gained, lost], ["y", "at", "gained", "lost"])

    t = sample.mapInArrow(design, "y double, at array<int>, gained array<int>, lost array<int>").toArrow()
    sent.destroy()
    texts, pairs = t.filter(t["at"].is_valid()), t.filter(t["at"].is_null())
    lens = texts["at"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    rows, cols = np.repeat(np.arange(len(lens)), lens), texts["at"].combine_chunks().flatten().to_numpy()
    order = np.lexsort((cols, rows))
    found = sorted(zip(map(tuple, pairs["gained"].to_pylist()), map(tuple, pairs["lost"].to_pylist()), pairs["y"].to_pylist(), strict=True))
    w, base = fit(texts["y"].to_numpy(), rows[order], cols[order].astype(np.int64), len(chosen), found, l2, penalty)
    return chosen, w, base


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    *,
    sample: int = 20_000,
    least: int = 5,
    most: int = 4096,
    l2: float = 0.5,
    penalty: float = 100.0,
    identity: Mapping[str, Sequence[str]] = IDENTITY,
    threshold: float = 0.3,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    score_col: str = "score",
    predicted_col: str = "predicted",
) -> DataFrame:
    """docs with score, the chance of label 1, and predicted, 1 if it is at least threshold.

    Learns from the rows of docs where `learn` holds and labels has their id: from about `sample`
    different texts, drawn by hash. Equal texts count once, with the mean of their labels, as do
    ids labelled more than once; null labels and ids don't count. At most `most` features that
    occur in `least` toxic texts or more get a weight. Scores depend on the text alone: equal texts score alike.

    A null text is an empty one; texts without known words get the offset's score. Without labels
    of both kinds every text gets the share of label 1 (a half if there is none). An empty table
    stays empty. Columns stay, those named like the new ones are replaced. Whole texts of any length are read.
    """
    names, w, base = learned(labelled(docs, labels, learn, id_col, text_col, label_col, sample), least=least, most=most, identity=identity, l2=l2, penalty=penalty)
    sent = docs.sparkSession.sparkContext.broadcast((names, w))

    @F.arrow_udf("double")
    def chance(texts: pa.Array) -> pa.Array:
        finder, weights = Finder(sent.value[0]), sent.value[1]
        score = np.array([base + weights[sorted(finder.of(words(t.as_py())))].sum() for t in texts])
        tidy()
        return pa.array(1 / (1 + np.exp(-score)))

    kept = [quoted(c) for c in docs.columns if c.lower() not in (score_col.lower(), predicted_col.lower())]
    p = unused("p", docs.columns)
    found = docs.select(*kept, chance(F.coalesce(F.col(text_col), F.lit(""))).alias(p))
    return found.select(*kept, F.col(p).alias(score_col), (F.col(p) >= threshold).cast("int").alias(predicted_col))
