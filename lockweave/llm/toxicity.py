"""Toxicity by a support vector machine over a gapped-subsequence string kernel.

The kernel of two words counts their common subsequences of three characters, each
weighted by ``GAP`` for every character skipped (a subsequence spans five
characters at most), normalised and raised to ``POWER``; so a word
with letters put in stays close to it, and a stem to its inflections.  A word with
signs inside is also taken without them, whichever is closer.  The kernel of two sentences is the sum
over their word pairs.  Its feature space is approximated by Nyström landmarks:
words and word stems chosen for the subsequences and beginnings that set toxic
training documents apart, and frequent words of clean ones.  A linear support vector machine (squared hinge,
Newton steps) is trained on labelled sentences: all sampled sentences of clean
documents, and of each toxic document the sentence that the last model found worst.

Because the machine is linear over a sum, a sentence's margin is a sum of one number
a word, and a worker computes it once for each distinct word it meets.  A document's
score is a logistic curve, fitted on the training documents, over its worst sentence's
margin and the ``WORST`` greatest numbers of its words: insults may be spread over
sentences, and a single word that resembles one doesn't make a document toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockweave.llm.common import bounded, need, tidy

#: Weight of each skipped character; power of the normalised kernel.
GAP, POWER = 0.5, 3
#: The places of a subsequence's second and third character after its first, and its weight.
STEPS = [(a, b, GAP ** (b - 2)) for b in range(2, 5) for a in range(1, b)]
#: Characters of one word window, and how far apart windows of longer words are.
WIDTH, STRIDE = 32, 24
#: Words of a sentence at most; longer ones are cut.
SENTENCE = 32
#: Documents of each label that the model is fitted on, in expectation.
MOST = 2500
#: Sentences of clean documents that the machine is trained on, beside each one's worst.
CLEAN = 8000
#: Landmarks from toxic documents (stems among them at most) and from clean documents.
BAD, STEMS, PLAIN = 128, 48, 32
#: Lengths of the stems.
STEM = range(4, 9)
#: Standard deviations that a subsequence's excess in toxic documents must pass to count for landmarks.
PROOF = 4.0
#: Logarithm of the slots that strings are counted in while landmarks are chosen.
SLOTS = 21
#: Landmarks are no closer to each other than this power of the kernel.
ALIKE = 0.4
#: Kernels up to this are taken as none in training and scoring alike.
FAINT = 0.02
#: Words of a document whose numbers count by themselves; numbers up to ``LITTLE`` count as none.
WORST, LITTLE = 5, 0.02
#: Words remembered by a worker; when full the memory is emptied, which costs time only.
MEMORY = 120_000

_EDGE = re.compile(r"^\W+|\W+$")
_SIGNS = re.compile(r"[\W_]+")
_SPACED = re.compile(r"(?<!\S)(?:\S[^\S\n]+){2,}\S(?!\S)")


def core(word: str) -> str:
    """The word without the signs around it."""
    return word if word.isalnum() else _EDGE.sub("", word)


def tokens(text: str) -> list[str]:
    """Lower-cased words; a line's end is a word of its own, and letters spaced out are also joined to one word."""
    text = text.lower()
    spaced = ["".join(m.split()) for m in _SPACED.findall(text)]
    return [*text.replace("\n", " \0 ").split(), *["\0"] * bool(spaced), *spaced]


def subsequences(words: list[str], steps=STEPS):
    """Of each word window: the word's number, the subsequences' keys and their weights (0: none there)."""
    import numpy as np

    owner, windows = [], []
    for i, w in enumerate(words):
        w = core(w)
        for view in (w,) if w.isalnum() or (bare := _SIGNS.sub("", w)) == w else (w, bare):
            for at in range(0, max(1, len(view) - (WIDTH - STRIDE)), STRIDE):
                owner.append(i)
                windows.append(("\2" if at == 0 else "") + view[at : at + WIDTH])
    n, wide = len(windows), WIDTH + 1
    code = np.zeros((n, wide + 4), np.int64)
    if n:
        flat = np.array(windows, f"U{wide}").view(np.uint32).reshape(n, wide)
        code[:, :wide] = flat
    keys = np.zeros((n, len(steps), wide), np.int64)
    weight = np.zeros((n, len(steps), wide), np.float32)
    for k, (a, b, by) in enumerate(steps):
        third = code[:, b : b + wide]
        keys[:, k] = code[:, :wide] << 42 | code[:, a : a + wide] << 21 | third
        weight[:, k] = np.where(third > 0, by, 0)
    return np.array(owner, np.int64), keys.reshape(n, len(steps) * wide), weight.reshape(n, len(steps) * wide)


@dataclass
class Landmarks:
    """The landmark words' subsequences, as a table that many words are looked up in at once."""

    words: list[str]

    def __post_init__(self):
        import numpy as np

        owner, keys, weight = subsequences(self.words)
        first = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, bool)
        keys, weight = keys[first], weight[first]  # a landmark's first window
        self.norm = np.sqrt((weight**2).sum(1) + 1e-9)
        row, col = np.nonzero(weight)
        self.keys, inverse = np.unique(keys[row, col], return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        self.mark, self.weight = row[order].astype(np.int32), weight[row, col][order]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(inverse, minlength=len(self.keys)))))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys):
        import numpy as np

        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def kernel(self, words: list[str], step: int = 256):
        """Kernel of each word with each landmark; a long word counts by its closest window."""
        import numpy as np

        out = np.zeros((len(words), len(self.words)), np.float32)
        for at in range(0, len(words), step):
            owner, keys, weight = subsequences(words[at : at + step])
            norm = np.sqrt((weight**2).sum(1) + 1e-9)
            row, col = np.nonzero((weight > 0) & self.seen[self._slot(keys)])
            key, w = keys[row, col], weight[row, col]
            place = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            hit = self.keys[place] == key if len(self.keys) else np.zeros(len(key), bool)
            row, w, place = row[hit], w[hit], place[hit]
            n = self.start[place + 1] - self.start[place] if len(place) else place
            at_pair = np.repeat(self.start[place], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) if len(place) else place
            m = len(self.words)
            dot = np.bincount(np.repeat(row, n) * m + self.mark[at_pair], np.repeat(w, n) * self.weight[at_pair], len(owner) * m).reshape(-1, m)
            near = np.minimum(1, dot / (norm[:, None] * self.norm[None, :])).astype(np.float32)
            near = near * near * near if POWER == 3 else near**POWER
            first = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, bool)
            out[owner[first] + at] = near[first]
            if not first.all():  # further windows and views of a word
                np.maximum.at(out, owner[~first] + at, near[~first])
        return out


def starts_of(ends, docs):
    """Where sentences start, given the words that end one and each word's document."""
    import numpy as np

    n = len(ends)
    new = np.ones(n, bool)
    new[1:] = ends[:-1] | (docs[1:] != docs[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return np.flatnonzero(new | ((np.arange(n) - begin) % SENTENCE == 0))


def greatest(values, docs, n: int):
    """The ``WORST`` greatest values of each of n documents, from the greatest on, 0 where there are fewer."""
    import numpy as np

    out, some = np.zeros((n, WORST)), np.flatnonzero(values > LITTLE)
    order = some[np.lexsort((-values[some], docs[some]))]
    of = docs[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    few = rank < WORST
    out[of[few], rank[few]] = values[order[few]]
    return out


def sum_by_core(counts: dict[str, int]) -> Counter:
    """The counts of words without the signs around them."""
    out: Counter = Counter()
    for w, n in counts.items():
        if n:
            out[core(w)] += n
    return out


def surprise(hits, misses, n_hits: int, n_misses: int):
    """How many standard deviations, beyond ``PROOF``, toxic documents hold a thing too often (root of the likelihood ratio); else 0."""
    import numpy as np

    share = (hits + misses) / (n_hits + n_misses)
    ratio = 2 * (hits * np.log(np.maximum(hits, 1e-9) / (n_hits * share)) + misses * np.log(np.maximum(misses, 1e-9) / (n_misses * share)))
    return np.where(hits > n_hits * share, np.maximum(0, np.sqrt(np.maximum(0, ratio)) - PROOF), 0.0)


def ends_sentence(word: str) -> bool:
    return word[-1:] in ".!?\0"


@dataclass
class Model:
    """What training leaves: landmark words, a weight for each, a bias, and the logistic curve's slopes and shift."""

    words: list[str]
    beta: list[float]
    bias: float
    slopes: list[float]
    shift: float

    def scorer(self):
        """A function from texts to scores that remembers words."""
        import numpy as np

        marks, beta = Landmarks(self.words) if self.words else None, np.array(self.beta, np.float32)
        place: dict[str, int] = {}
        known: dict[str, float] = {}
        value, stops = np.zeros(0), np.zeros(0, bool)

        def score(texts: list[str]) -> list[float]:
            nonlocal value, stops
            if len(place) > MEMORY:
                place.clear()
                known.clear()
                value, stops = np.zeros(0), np.zeros(0, bool)
            lists = [tokens(t) for t in texts]
            news = list({w for ws in lists for w in ws if w not in place})
            if news:
                place.update(zip(news, range(len(value), len(value) + len(news)), strict=True))
                cores = [core(w) for w in news]
                fresh = list({c for c in cores if c not in known})
                if fresh:
                    near = marks.kernel(fresh) if marks else np.zeros((len(fresh), 0), np.float32)
                    known.update(zip(fresh, (np.where(near > FAINT, near, 0) @ beta).tolist(), strict=True))
                value, stops = np.concatenate((value, [known[c] for c in cores])), np.concatenate((stops, [ends_sentence(w) for w in news]))
            most, worst = np.full(len(texts), self.bias), np.zeros((len(texts), WORST))
            if any(lists):
                at = np.array([place[w] for ws in lists for w in ws], np.int64)
                docs = np.repeat(np.arange(len(texts)), [len(ws) for ws in lists])
                begin = starts_of(stops[at], docs)
                np.maximum.at(most, docs[begin], np.add.reduceat(value[at], begin) + self.bias)
                worst = greatest(value[at], docs, len(texts))
            return (1 / (1 + np.exp(-np.clip(np.column_stack((most, worst)) @ self.slopes + self.shift, -50, 50)))).tolist()

        return score


def _svm(x, y, weight, c: float = 10.0, rounds: int = 30):
    """Primal Newton steps of the squared-hinge machine; the last column of x is the bias."""
    import numpy as np

    w, eye = np.zeros(x.shape[1]), np.eye(x.shape[1])
    eye[-1, -1] = 1e-6
    for _ in range(rounds):
        on = y * (x @ w) < 1
        xs = x[on] * weight[on, None]
        new = np.linalg.solve(eye / c + xs.T @ x[on], xs.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


class Bags:
    """Training documents as numbers of their words, one word string being kept once."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.docs: list = []
        self.toxic: list[bool] = []

    def add(self, text: str, toxic: bool) -> None:
        import numpy as np

        place = self.place
        self.docs.append(np.array([place.setdefault(w, len(place)) for w in tokens(text)], np.int32))
        self.toxic.append(toxic)


def _evidence(both: list[str], tox: Counter, plain: Counter, n_tox: int, n_plain: int):
    """For each word the summed surprise of its three-character strings, over the root of their number.

    Strings are counted in ``1 << SLOTS`` hash slots, some words at a time: this only chooses landmarks.
    """
    import numpy as np

    def strings():
        for at in range(0, len(both), 4096):
            part = both[at : at + 4096]
            owner, keys, weight = subsequences(part, STEPS[:1])
            row, col = np.nonzero(weight)
            yield at, part, owner[row], (keys[row, col].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)

    hits, misses = np.zeros(1 << SLOTS, np.float32), np.zeros(1 << SLOTS, np.float32)
    for _, part, owner, slot in strings():
        np.add.at(hits, slot, np.array([tox[w] for w in part], np.float32)[owner])
        np.add.at(misses, slot, np.array([plain[w] for w in part], np.float32)[owner])
    used = np.flatnonzero(hits)
    proof = np.zeros(1 << SLOTS, np.float32)
    proof[used] = surprise(hits[used].astype(float), misses[used].astype(float), n_tox, n_plain)
    out = np.zeros(len(both))
    for at, part, owner, slot in strings():
        n = np.bincount(owner, minlength=len(part))
        out[at : at + len(part)] = np.bincount(owner, proof[slot], len(part)) / np.sqrt(np.maximum(1, n))
    return out


def _stems(tox: Counter, plain: Counter, n_tox: int, n_plain: int) -> list[str]:
    """Beginnings of words that toxic documents have too often, the most surprising first; counted in hash slots."""
    import heapq
    import zlib

    import numpy as np

    slot = lambda s: zlib.crc32(s.encode()) & ((1 << SLOTS) - 1)
    hits, misses = np.zeros(1 << SLOTS, np.float32), np.zeros(1 << SLOTS, np.float32)
    for counts, into in ((tox, hits), (plain, misses)):
        for w, n in counts.items():
            for k in STEM:
                if len(w) > k:
                    into[slot(w[:k])] += n
    used = np.flatnonzero(hits)
    proof = np.zeros(1 << SLOTS, np.float32)
    proof[used] = surprise(hits[used].astype(float), misses[used].astype(float), n_tox, n_plain)
    found = {w[:k]: float(proof[slot(w[:k])]) for w in tox for k in STEM if len(w) > k and proof[slot(w[:k])] > 0}
    return heapq.nlargest(16 * STEMS, found, key=lambda s: (found[s], s))


def _apart(order: list[str], most: int, taken: list[str]) -> list[str]:
    """``taken`` and up to ``most`` of ``order``, in order, none close to one before it."""
    import numpy as np

    near = Landmarks(order).kernel([*taken, *order], step=32)
    blocked, out = near[: len(taken)].max(0, initial=0) > ALIKE, []
    for i, w in enumerate(order):
        if not blocked[i] and len(out) < most:
            out.append(w)
            blocked |= near[len(taken) + i] > ALIKE
    return [*taken, *out]


def train(bags: Bags, seed: int = 7) -> Model:
    """Fit on the documents' sentences.  With one label only, the model is that label for every text."""
    import numpy as np

    y = np.array(bags.toxic, bool)
    if not y.any() or y.all():
        return Model([], [], 0.0, [0.0] * (1 + WORST), 50.0 if len(y) and y.all() else -50.0)
    rng = np.random.default_rng(seed)
    place, lists, names = bags.place, bags.docs, list(bags.place)
    tox, plain = (np.bincount(np.concatenate([np.unique(d) for d, bad in zip(lists, y, strict=True) if bad == want]), minlength=len(names)) for want in (True, False))
    tox, plain = (sum_by_core(dict(zip(names, c.tolist(), strict=True))) for c in (tox, plain))
    vocab = [w for w in tox if tox[w] and 3 <= len(w) <= WIDTH]
    both = list(dict.fromkeys([*vocab, *plain]))
    rank = _evidence(both, tox, plain, y.sum(), (~y).sum())[: len(vocab)]
    rank = rank + surprise(np.array([tox[w] for w in vocab], float), np.array([plain[w] for w in vocab], float), y.sum(), (~y).sum())
    del both
    stems = _stems(tox, plain, y.sum(), (~y).sum())
    chosen = _apart(stems, STEMS, []) if stems else []
    order = [vocab[i] for i in np.argsort(-rank, kind="stable")[: 16 * BAD] if rank[i] > 0]
    if order:
        chosen = _apart(order, BAD - len(chosen), chosen)
    usual = [w for w, _ in plain.most_common(PLAIN)]
    del tox, plain, vocab, rank
    words = list(dict.fromkeys([*chosen, *usual]))
    marks = Landmarks(words)
    gram = marks.kernel(words).astype(np.float64)
    val, vec = np.linalg.eigh((gram + gram.T) / 2)
    keep = val > 1e-3
    white = vec[:, keep] / np.sqrt(val[keep])
    row_of, rows, kept = np.zeros(len(names), np.int32), [np.zeros((1, len(words)), np.float32)], 1
    for i in range(0, len(names), 8192):  # words far from every landmark share a row of zeros
        part = marks.kernel(names[i : i + 8192])
        close = np.flatnonzero(part.max(1) > FAINT)
        row_of[i + close] = np.arange(kept, kept + len(close))
        rows.append(np.where(part[close] > FAINT, part[close], 0).astype(np.float16))
        kept += len(close)
    feature = np.concatenate(rows)
    del rows, place
    stops = np.array([ends_sentence(w) for w in names], bool)
    at = np.concatenate(lists)
    stops, at = stops[at], row_of[at]
    docs = np.repeat(np.arange(len(lists)), [len(ws) for ws in lists])
    begin = starts_of(stops, docs)
    doc_of = docs[begin]
    of_words = lambda by: np.concatenate([feature[i : i + 8192].astype(np.float32) @ by.astype(np.float32) for i in range(0, len(feature), 8192)])
    guess = np.concatenate((np.ones(len(chosen)), np.zeros(len(words) - len(chosen))))
    per_word = of_words(guess)
    margin = np.add.reduceat(per_word[at], begin)
    ends = np.append(begin[1:], len(at))

    def rows_of(sentences):
        """Landmark features of the sentences, whitened, with the bias column."""
        x = np.stack([feature[at[begin[s] : ends[s]]].sum(0, dtype=np.float32) for s in sentences]).astype(np.float64)
        return np.hstack((x @ white, np.ones((len(x), 1))))

    def worst(mask):
        """The sentence with the greatest margin of each document."""
        order = np.lexsort((margin, doc_of))
        last = order[np.append(doc_of[order][1:] != doc_of[order][:-1], True)]
        return last[mask[doc_of[last]]]

    clean = np.flatnonzero(~y[doc_of])
    some = rng.choice(clean, min(len(clean), CLEAN), replace=False)
    for _ in range(4):
        positive, hard = worst(y), worst(~y)
        use = np.concatenate((positive, np.union1d(some, hard)))
        x, t = rows_of(use), np.where(y[doc_of[use]], 1.0, -1.0)
        share = np.where(t > 0, len(t) / (4 * max(1, (t > 0).sum())), 1.0)
        w = _svm(x, t, share)
        beta, bias = white @ w[:-1], float(w[-1])
        margin = np.add.reduceat(of_words(beta)[at], begin)
    top = np.full(len(lists), bias)
    np.maximum.at(top, doc_of, margin + bias)
    slopes, shift = _logistic(np.column_stack((top, greatest(of_words(beta)[at], np.repeat(np.arange(len(lists)), [len(ws) for ws in lists]), len(lists)))), y)
    return Model(words, beta.tolist(), bias, slopes, shift)


def _logistic(x, y, rounds: int = 100):
    """Slopes and shift by Newton steps, with the usual smoothed targets against overconfidence and a slight pull to 0."""
    import numpy as np

    pos, neg = y.sum(), (~y).sum()
    target = np.where(y, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z = np.column_stack((x, np.ones(len(x))))
    a, pull = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [1e-6])
    a[0] = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + pull, z.T @ (target - p) - pull @ a)
        a = a + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return a[:-1].tolist(), float(a[-1])


def held_out(id_col: Column) -> Column:
    """True for a third of the ids, which nothing is learnt from; false for a null id, which has no label either."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> Model:
    """Fit on the labelled documents that aren't held out: all, or of each label ``most`` in expectation, by a hash of the id."""
    # of labels of one id that disagree the greatest counts
    known = need(labels, id_col, "toxic").where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    keep = F.lit(False)
    for label, n in sizes.items():
        keep = keep | ((F.col("toxic") == label) & (F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / n))))
    chosen = F.broadcast(known.where(keep))  # some 2 x most rows of two numbers
    rows = need(docs, id_col, text_col).join(chosen, id_col).select(id_col, F.coalesce(text_col, F.lit("")).alias("text"), "toxic")
    bags = Bags()
    for r in rows.toLocalIterator():
        bags.add(r["text"], r["toxic"] > 0)
    return train(bags)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id_col, held_out, score, predicted for every whole text.

    Defined cases: a null or empty text has the score of a document without words;
    rows with a null or repeated id are scored each; an empty table gives no row;
    further columns are not read; a text of any length is read whole.
    """
    import pyarrow as pa

    src = need(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer([t or "" for t in part.column(1).to_pylist()]), pa.float64())], [id_col, "score"])
        del scorer
        tidy()

    out = src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, score double")
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``; cases as in ``score``."""
    import pyarrow as pa

    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.filter(pa.array([s < threshold for s in scorer([t or "" for t in part.column(at_text).to_pylist()])]))
        del scorer
        tidy()

    return bounded(docs).mapInArrow(run, docs.schema)
