"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A run of
letters, with a mark before it, is generated by any sequence of pieces that spells it; the
forward algorithm sums over all of them. Piece probabilities are fitted by expectation
maximisation on labelled documents. A text's score is the sum over its runs, so each
distinct run of a batch is segmented once.

Beside the languages stands an outlier model, which draws letters one by one. How far the best
language beats it, with the numbers of letters and runs, tells real text from junk; the
weights of these three are fitted on labelled documents and the same with letters shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, tidy, unused

MARK, SHORT = "▁", 32
LETTERS = regex.compile(r"\p{L}+")


def vocabulary(path: str) -> dict[str, int]:
    """Lower-cased pieces of a sentencepiece file, numbered from 1; 0 is any other character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).lower()
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            found.setdefault(piece, len(found) + 1)
    return found


def letter_runs(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct runs, then for each run of the texts its number and its text's."""
    split = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = split.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy())
    numbers: dict[str, int] = {}
    first, extra = [], []  # most words hold one run
    for w, word in enumerate(flat.dictionary.to_pylist()):
        runs = [word] if word.isalpha() else LETTERS.findall(word)
        first.append(numbers.setdefault(runs[0], len(numbers)) if runs else -1)
        extra += [(w, numbers.setdefault(r, len(numbers))) for r in runs[1:]]
    code = flat.indices.to_numpy().astype(np.int64)
    run = np.array(first, np.int64)[code] if first else np.zeros(0, np.int64)
    doc_of, run_of = [doc[run >= 0]], [run[run >= 0]]
    if extra:  # in order of their words
        word_of, more = np.array(extra, np.int64).T
        n = np.bincount(word_of, minlength=len(first))
        start = np.cumsum(n) - n
        at = np.nonzero(n[code])[0]
        again = np.repeat(at, n[code[at]])
        place = np.arange(len(again)) - np.repeat(np.cumsum(n[code[at]]) - n[code[at]], n[code[at]])
        doc_of.append(doc[again])
        run_of.append(more[start[code[again]] + place])
    return list(numbers), np.concatenate(run_of), np.concatenate(doc_of)


class PieceTable:
    """Numbers of pieces by hash, for many parts of texts at once: two open tables, keys kept
    whole; a seed is taken under which all pieces find a place."""

    BITS = 19

    def __init__(self, pieces: dict[str, int]) -> None:
        for seed in range(1, 100):
            self.factor = np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
            self.keys = np.zeros((2, 1 << self.BITS), np.uint64)
            self.numbers = np.full((2, 1 << self.BITS), -1, np.int32)
            if all(self._put(k, n) for k, n in pieces.items()):
                return
        raise ValueError("no seed found")

    def step(self, h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h ^ code) * self.factor
        return h ^ (h >> np.uint64(29))

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.BITS) - 1)
        return (h & mask).astype(np.int64), ((h >> np.uint64(self.BITS)) & mask).astype(np.int64)

    def _put(self, piece: str, number: int) -> bool:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = self.step(h, np.array([ord(c)], np.uint64))
        for table, at in enumerate(self.places(h)):
            if self.numbers[table, at[0]] < 0:
                self.keys[table, at[0]], self.numbers[table, at[0]] = h[0], number
                return True
        return False

    def get(self, h: np.ndarray, missing: int) -> np.ndarray:
        a, b = self.places(h)
        first = self.keys[0][a] == h
        out = np.where(first, self.numbers[0][a], missing)
        second = np.nonzero(~first & (self.keys[1][b] == h) & (self.numbers[1][b] >= 0))[0]
        out[second] = self.numbers[1][b[second]]
        return out


class Segmenter:
    def __init__(self, pieces: dict[str, int]) -> None:
        self.table = PieceTable(pieces)
        self.size = len(pieces) + 2  # 0: any other character; the last: no piece
        self.longest = max(map(len, pieces), default=1)

    def parts(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Start, end and piece numbers (size - 1 for none) of the parts of runs of one length
        that are a piece in some run, by end; codes: characters x runs."""
        found = []
        for i in range(len(codes)):
            h = np.zeros(codes.shape[1], np.uint64)
            for j in range(i + 1, min(len(codes), i + self.longest) + 1):
                h = self.table.step(h, codes[j - 1])
                number = self.table.get(h, self.size - 1 if j - i > 1 else 0)
                if j - i == 1 or (number < self.size - 1).any():
                    found.append((i, j, number))
        return sorted(found, key=lambda x: x[1])

    def by_length(self, runs: list[str]) -> Iterator[tuple[np.ndarray, list, int]]:
        """Runs of fewer than SHORT letters: which, their parts, their length with the mark."""
        lengths = np.fromiter(map(len, runs), np.int64, len(runs)) + 1
        for n in np.unique(lengths[lengths <= SHORT]):
            at = np.nonzero(lengths == n)[0]
            for k in range(0, len(at), 20_000):
                some = at[k : k + 20_000]
                text = "".join(MARK + runs[i] for i in some).encode("utf-32-le")
                yield some, self.parts(np.frombuffer(text, np.uint32).reshape(len(some), n).T.astype(np.uint64)), int(n)

    def log_p(self, runs: list[str], p: np.ndarray) -> np.ndarray:
        """Log probability of each run (row) in each language (column); p: pieces x languages,
        its last row 0."""
        out = np.zeros((len(runs), p.shape[1]))
        for at, parts, n in self.by_length(runs):
            alpha = np.zeros((n + 1, len(at), p.shape[1]))
            alpha[0] = 1
            for i, j, number in parts:
                alpha[j] += alpha[i] * p[number]
            out[at] = np.log(alpha[n])
        for r in (i for i, x in enumerate(runs) if len(x) + 1 > SHORT):
            out[r] = self.long_sums(self.ending(MARK + runs[r]), p)[-1]
        return out

    def ending(self, run: str) -> np.ndarray:
        """For each end in a run of any length and each length from 1: the piece's number."""
        codes = np.frombuffer(run.encode("utf-32-le"), np.uint32).astype(np.uint64)
        out = np.full((len(codes) + 1, self.longest), self.size - 1, np.int32)
        h = np.zeros(len(codes), np.uint64)
        for k in range(min(self.longest, len(codes))):
            h = self.table.step(h[: len(codes) - k], codes[k:])
            out[k + 1 :, k] = self.table.get(h, self.size - 1 if k else 0)
        return out

    @staticmethod
    def long_sums(ending: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Log of the forward sums at each end: (characters + 1) x languages."""
        longest = ending.shape[1]
        with np.errstate(divide="ignore"):
            log = np.log(p)
            sums = np.full((len(ending) - 1 + longest, p.shape[1]), -np.inf)  # longest - 1 before the start
            sums[longest - 1] = 0
            for j in range(1, len(ending)):
                sums[longest - 1 + j] = np.logaddexp.reduce(sums[j - 1 : longest - 1 + j][::-1] + log[ending[j]], axis=0)
        return sums[longest - 1 :]

    def long_uses(self, run: str, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all parts of a run of any length and how often each language uses them."""
        ending = self.ending(run)
        n, longest = len(ending) - 1, ending.shape[1]
        ahead = self.long_sums(ending, p)
        back = np.full((n + 1 + longest, p.shape[1]), -np.inf)  # longest after the end
        back[n] = 0
        with np.errstate(divide="ignore"):
            log = np.log(p)
        starting = np.full((n, longest), self.size - 1, np.int32)  # by start, not by end
        for k in range(min(longest, n)):
            starting[: n - k, k] = ending[k + 1 :, k]
        for i in range(n - 1, -1, -1):
            back[i] = np.logaddexp.reduce(back[i + 1 : i + 1 + longest] + log[starting[i]], axis=0)
        i, k = np.nonzero(starting < self.size - 1)
        number = starting[i, k]
        return number, np.exp(ahead[i] + log[number] + back[i + k + 1] - ahead[n])

    def fit(self, runs: list[str], counts: np.ndarray, rounds: int, floor: float = 0.02) -> np.ndarray:
        """Piece probabilities by expectation maximisation; counts: runs x languages."""
        size, langs = self.size, counts.shape[1]
        p = np.full((size, langs), 1 / size)
        p[-1] = 0
        short, long = list(self.by_length(runs)), [i for i, r in enumerate(runs) if len(r) + 1 > SHORT]
        for _ in range(rounds):
            expected = np.full((size, langs), floor)
            for at, parts, n in short:
                alpha, beta = np.zeros((n + 1, len(at), langs)), np.zeros((n + 1, len(at), langs))
                alpha[0], beta[n] = 1, 1
                for i, j, number in parts:
                    alpha[j] += alpha[i] * p[number]
                for i, j, number in reversed(parts):
                    beta[i] += beta[j] * p[number]
                weight = counts[at] / alpha[n]
                for i, j, number in parts:
                    use = alpha[i] * p[number] * beta[j] * weight
                    for lang in range(langs):
                        expected[:, lang] += np.bincount(number, use[:, lang], size)
            for r in long:
                number, use = self.long_uses(MARK + runs[r], p)
                for lang in np.nonzero(counts[r])[0]:
                    expected[:, lang] += counts[r, lang] * np.bincount(number, use[:, lang], size)
            expected[0] = expected[1:-1].sum(0) * 1e-6  # characters outside the vocabulary say nothing
            expected[-1] = 0
            p = expected / expected.sum(0)
        return p


class Letters:
    """The outlier model: letters drawn one by one, as often as in the runs learnt from."""

    def __init__(self, runs: list[str], counts: np.ndarray) -> None:
        codes = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)
        weight = np.repeat(counts, np.fromiter(map(len, runs), np.int64, len(runs)))
        self.codes, at = np.unique(codes, return_inverse=True)
        seen = np.bincount(at, weight, len(self.codes)) + 0.5
        self.log = np.log(np.append(seen, 0.5) / (seen.sum() + 0.5))  # the last: any other letter

    def log_p(self, runs: list[str]) -> np.ndarray:
        if not runs:
            return np.zeros(0)
        codes = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        known = self.codes[at] == codes if len(self.codes) else np.zeros(len(codes), bool)
        ends = np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))
        return np.add.reduceat(self.log[np.where(known, at, len(self.codes))], np.concatenate([[0], ends[:-1]]))


def shuffled(runs: list[str], rng: np.random.Generator) -> list[str]:
    """Runs of the same lengths, the letters of all shuffled."""
    letters = list("".join(runs))
    rng.shuffle(letters)
    ends = np.cumsum([len(r) for r in runs])
    return ["".join(letters[e - len(r) : e]) for r, e in zip(runs, ends, strict=True)]


class Identifier:
    MEMO = 100_000

    def __init__(self, langs: list[str], segmenter: Segmenter, p: np.ndarray, letters: Letters, weights: np.ndarray) -> None:
        self.langs, self.segmenter, self.p, self.letters = langs, segmenter, p, letters
        self.weights = weights  # of lead, letters, runs, one in the evidence that a text is real
        self.memo: dict[str, int] = {}
        self.known = np.zeros((0, len(langs) + 2))

    def evidence(self, runs: list[str]) -> np.ndarray:
        """Of each run: log probability in each language, under the outlier model, and its length."""
        own = self.segmenter.log_p(runs, self.p)
        return np.column_stack([own, self.letters.log_p(runs), np.fromiter(map(len, runs), float, len(runs))])

    def remembered(self, runs: list[str], often: np.ndarray) -> np.ndarray:
        """evidence(); of runs that occur more than once it is remembered."""
        if len(self.memo) > self.MEMO:
            self.memo, self.known = {}, self.known[:0]
        at = np.fromiter((self.memo.get(r, -1) for r in runs), np.int64, len(runs))
        new = np.nonzero(at < 0)[0]
        found = self.evidence([runs[i] for i in new])
        out = np.empty((len(runs), len(self.langs) + 2))
        out[at >= 0], out[new] = self.known[at[at >= 0]], found
        again = often[new] > 1
        self.memo.update({runs[i]: len(self.known) + k for k, i in enumerate(new[again])})
        self.known = np.concatenate([self.known, found[again]])
        return out

    def predict(self, texts: pa.Array, most: int = 4_000_000) -> tuple[list[str], np.ndarray]:
        """A language and a score for each text, `most` characters at a time (or one text)."""
        ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
        langs, scores, at = [], [], 0
        while at < len(texts):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            some = self._predict(texts.slice(at, to - at))
            langs += some[0]
            scores.append(some[1])
            at = to
            tidy()
        return langs, np.concatenate(scores or [np.zeros(0)])

    def _predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        runs, run, doc = letter_runs(texts)
        n = np.bincount(doc, minlength=len(texts))
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        each = self.remembered(runs, np.bincount(run, minlength=len(runs)))
        sums = np.stack([np.bincount(doc, each[run, k], len(texts)) for k in range(len(self.langs) + 2)], 1)
        total = sums[:, :-2]
        scaled = (total - total.max(1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
        share = np.exp(scaled)
        share /= share.sum(1, keepdims=True)
        best = total.argmax(1)
        real = 1 / (1 + np.exp(-np.clip(features(sums, n) @ self.weights, -500, 500)))
        return [self.langs[k] if m else "und" for k, m in zip(best, n, strict=True)], np.where(n > 0, share.max(1) * real, 0.0)


def features(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What speaks for a real text: the best language's lead over the outlier model, numbers of
    letters and runs, and one."""
    return np.column_stack([sums[:, :-2].max(1) - sums[:, -2], sums[:, -1], n, np.ones(len(n))])


def calibrated(model: Identifier, texts: list[list[str]], odds: float) -> np.ndarray:
    """Weights of the features: logistic regression on texts (lists of runs) and their beginnings
    of 1, 2, 4, ... runs, against the same with letters shuffled; real texts count odds times."""
    rng = np.random.default_rng(5)
    tried: list[list[str]] = []  # real and shuffled ones in turn
    for runs in texts:
        n = 1
        while runs:
            tried += [runs[:n], shuffled(runs[:n], rng)]
            if n >= len(runs) or n >= 64:
                break
            n *= 2
    if not tried:
        return np.zeros(4)
    words, at = np.unique(np.array([r for t in tried for r in t], object), return_inverse=True)
    each, text = model.evidence(words.tolist()), np.repeat(np.arange(len(tried)), [len(t) for t in tried])
    sums = np.stack([np.bincount(text, each[at, k], len(tried)) for k in range(each.shape[1])], 1)
    x, y = features(sums, np.bincount(text, minlength=len(tried))), 1.0 - np.arange(len(tried)) % 2
    scale, w = np.abs(x).max(0) + 1e-9, np.zeros(4)
    weight = np.where(y > 0, odds, 1.0) / len(y)
    for _ in range(30):  # Newton steps on the slightly shrunk loss
        z = np.clip((x / scale) @ w, -30, 30)
        p = 1 / (1 + np.exp(-z))
        grad = (x / scale).T @ (weight * (y - p)) - 1e-4 * w
        hess = (x / scale).T @ ((weight * p * (1 - p))[:, None] * (x / scale)) + 1e-4 * np.eye(4)
        w = w + np.linalg.solve(hess, grad)
    return w / scale


def fit(
    docs: DataFrame, learns: Column, vocab_path: str, *, text_col: str, lang_col: str, per_lang: int, lang_bytes: int, rounds: int, odds: float
) -> Identifier:
    """Learns from about per_lang different texts of each language, drawn by a hash of the text, fewer
    where they would hold over lang_bytes; whole texts. About 100 of each also calibrate the score."""
    usable = docs.where(learns & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    size = F.octet_length(text_col)
    sizes = usable.groupBy(lang_col).agg(F.approx_count_distinct(text_col), F.avg(size)).collect()
    counts = {r[0]: min(1.0, 1.1 * per_lang / max(1, r[1]), lang_bytes / max(1.0, r[1] * r[2])) for r in sizes}
    langs = sorted(counts)
    segmenter = Segmenter(vocabulary(vocab_path))
    if not langs:
        return Identifier([], segmenter, np.zeros((1, 0)), Letters([], np.zeros(0)), np.zeros(4))
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, counts[k])))
    place = F.pmod(F.xxhash64(F.col(text_col), F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    drawn = usable.where(place < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).distinct().toArrow()
    drawn = drawn.sort_by([("lang", "ascending"), ("text", "ascending")])
    seen: list[Counter] = [Counter() for _ in langs]
    trial: list[list[str]] = []
    for k, lang in enumerate(langs):
        texts = drawn.filter(pc.equal(drawn["lang"], lang))["text"].combine_chunks()
        runs, run, doc = letter_runs(texts)
        seen[k].update(dict(zip(runs, np.bincount(run, minlength=len(runs)).tolist(), strict=True)))
        order = np.argsort(doc, kind="stable")
        first = np.searchsorted(doc[order], np.arange(0, len(texts), max(1, len(texts) // 100)))
        trial += [[runs[i] for i in run[order][a : a + 64][doc[order][a : a + 64] == doc[order][a]]] for a in first if a < len(doc)]
    every = sorted({r for c in seen for r in c})
    table = np.array([[c.get(r, 0) for c in seen] for r in every], float).reshape(len(every), len(langs))
    model = Identifier(langs, segmenter, segmenter.fit(every, table, rounds), Letters(every, table.sum(1)), np.zeros(4))
    model.weights = calibrated(model, trial, odds)
    return model


def identify(
    docs: DataFrame,
    learns: Column,
    *,
    vocab_path: str,
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = 500,
    lang_bytes: int = 8_000_000,
    rounds: int = 4,
    odds: float = 100.0,
    pred_col: str = "lang_pred",
    score_col: str = "score",
) -> DataFrame:
    """docs with pred_col (a learnt language, or und) and score_col (0 to 1) beside its columns.

    Only rows for which learns is true, with text and language, are learnt from. A null text
    or one without a letter is und with score 0, as is every text if nothing could be learnt;
    ties go to the first language by name. Texts of any length are scored whole; rows that
    repeat are predicted alike. score is the chance of the language predicted, tempered by
    the root of the number of runs, times the chance that the text is real and not junk, if
    real texts are odds times as frequent. An empty table stays empty. Columns of docs of
    these two names are replaced; any others stay.
    """
    learnt = fit(docs, learns, vocab_path, text_col=text_col, lang_col=lang_col, per_lang=per_lang, lang_bytes=lang_bytes, rounds=rounds, odds=odds)
    model = docs.sparkSession.sparkContext.broadcast(learnt)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        langs, scores = model.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    kept = [quoted(c) for c in docs.columns if c.lower() not in (pred_col.lower(), score_col.lower())]
    both = unused("found", docs.columns)
    found = docs.select(*kept, predicted(F.col(text_col)).alias(both))
    return found.select(*kept, F.col(both)["lang_pred"].alias(pred_col), F.col(both)["score"].alias(score_col))
