"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text, one ordinary, one toxic.
Both hold the same trained ordinary content; the toxic one also holds, before
it, the passages that toxic texts have in common more often than ordinary texts
that resemble them.  For that, labelled texts are grouped by their byte
frequencies (all, halves, halves of halves), and in each group it is counted in
how many texts of either kind each byte n-gram occurs; what exceeds chance
enters, however many passages there are.  A text
is cut into overlapping windows that cover all of it.  Each window is compressed
with both dictionaries; what the toxic one saves is the window's evidence.  Figures
of a text (the highest savings, the saving per window, and whole passages a KB,
as short passages save few bytes) go through a logistic curve calibrated on the labelled rows, so that 0.3 is the threshold.

The fit reads at most ``MAX_ROWS`` labelled rows of ``MAX_BYTES`` in all, and
trains the ordinary content on the first ``BASE_ROWS`` ordinary ones (documented
bounds of the fit only); scoring reads whole texts.

Defined cases: null and empty texts have no window and no evidence, so they get
the lowest score; without labelled rows of both classes every score is 0; equal
texts have equal scores; rows whose doc_id is null or repeats are scored like
any other (of a repeated doc_id the fit takes the least text); rows are scored
one by one, so ``without_toxic`` never judges a row by another's doc_id; other
columns, whatever their names, are ignored and kept; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import MAX_BYTES, fitted_in_task, keep_rows, labelled, score_texts
from .shingles import band_hashes, shingle_set

#: Bytes of a window, of its step, and of the n-grams.
WINDOW, STEP, GRAMS = 96, 80, (5, 6, 8)
LEVEL, BASE_BYTES = 6, 4096
#: Texts of either class in a group that is compared (and toxic texts that have
#: a gram), how often groups are halved, and what a gram's statistic must have
#: above twice the logarithm of the number of comparisons (grams times groups).
LEAST, DEPTH, CHANCE = 5, 5, 10.0
#: How many times as frequent a gram must be in a group's toxic texts.
RATIO = 2.0
MAX_ROWS = 6000
#: MinHash bands and rows a band that tell copies in the sample: half of the pairs
#: of similarity 0.4 meet, 0.98 of those of 0.6.
COPY_BANDS, COPY_ROWS = 16, 3
#: Ordinary rows whose whole texts the ordinary content is trained on: the trainer
#: needs about ten times their size in memory.
BASE_ROWS = 1000


def _windows(raw: bytes) -> list[bytes]:
    return [raw[i : i + WINDOW] for i in range(0, max(1, len(raw) - WINDOW + STEP), STEP)] if raw else []


def _codes(raw: bytes, size: int) -> np.ndarray:
    """Each ``size`` bytes (8 at most) of a text as one integer, once each."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = len(b) - size + 1
    return np.unique(sum((b[k : n + k] << np.uint64(8 * k) for k in range(size)), np.zeros(n, np.uint64))) if n > 0 else np.empty(0, np.uint64)


def _index(raws: list[bytes], y: np.ndarray, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The grams of ``size`` bytes that ``LEAST`` toxic texts have, and for each
    text the numbers of those it has."""
    # Counted 100 texts at a time, so that memory is bounded by different grams.
    grams, many = np.empty(0, np.uint64), np.empty(0, np.int64)
    toxic = np.flatnonzero(y == 1)
    for low in range(0, len(toxic), 100):
        more = np.concatenate([grams, *(_codes(raws[i], size) for i in toxic[low : low + 100])])
        counts = np.concatenate([many, np.ones(len(more) - len(grams), np.int64)])
        grams, at = np.unique(more, return_inverse=True)
        many = np.bincount(at, counts, len(grams)).astype(np.int64)
    grams = grams[many >= LEAST]
    if not len(grams):
        return grams, [np.empty(0, np.int32)] * len(raws)
    held = []
    for r in raws:
        codes = _codes(r, size)
        at = np.minimum(np.searchsorted(grams, codes), len(grams) - 1)
        held.append(at[grams[at] == codes].astype(np.int32))
    return grams, held


def alike(raws: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    """Groups of texts with similar byte frequencies: all texts, their halves by
    2-means, the halves' halves, while both classes have ``LEAST`` texts; a group
    comes before its parts."""
    shares = np.array([np.sqrt(np.bincount(np.frombuffer(r, np.uint8), minlength=256) / max(1, len(r))) for r in raws]).reshape(-1, 256)
    every = np.array([i for i, r in enumerate(raws) if r], dtype=int)
    todo, out = [(every, 0)], []
    while todo:
        rows, at = todo.pop()
        if at and min((y[rows] == 1).sum(), (y[rows] == 0).sum()) < LEAST:
            continue
        out.append(rows)
        if at == DEPTH or len(rows) < 4 * LEAST:
            continue
        x = shares[rows]
        side = (x - x.mean(axis=0)) @ np.linalg.eigh(np.cov(x.T))[1][:, -1] > 0
        for _ in range(20):
            if side.all() or not side.any():
                break
            a, b = x[side].mean(axis=0), x[~side].mean(axis=0)
            side = x @ (a - b) > (a @ a - b @ b) / 2
        if side.any() and not side.all():
            todo += [(rows[side], at + 1), (rows[~side], at + 1)]
    return out


def _surplus(a: np.ndarray, b: np.ndarray, toxic: int, ordinary: int) -> np.ndarray:
    """Likelihood-ratio statistic of grams RATIO times as frequent in toxic texts; else 0."""
    both = (a + b) / (toxic + ordinary)
    part = lambda k, n, p: np.where(k > 0, k * np.log(np.maximum(k, 1) / n / np.maximum(p, 1e-12)), 0.0)
    g = 2 * (part(a, toxic, both) + part(toxic - a, toxic, 1 - both) + part(b, ordinary, both) + part(ordinary - b, ordinary, 1 - both))
    return np.where(a / toxic >= RATIO * b / ordinary, g, 0.0)


def _common_ratio(held: list[np.ndarray], n: int, y: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """For each gram the ratio of its shares of toxic and ordinary texts, both
    compared within the narrowest group of each text and summed over these groups
    (Mantel and Haenszel's estimate)."""
    narrowest: dict[int, int] = {}
    for g, rows in enumerate(groups):  # parts come after their wholes
        narrowest.update(dict.fromkeys(rows.tolist(), g))
    above, below = np.zeros(n), np.full(n, 1e-9)
    for g in set(narrowest.values()):
        rows = [i for i, own in narrowest.items() if own == g]
        toxic = sum(y[i] == 1 for i in rows)
        counts = np.zeros((2, n))
        for i in rows:
            counts[y[i], held[i]] += 1
        above += counts[1] * (len(rows) - toxic) / len(rows)
        below += counts[0] * toxic / len(rows)
    return above / below


def toxic_passages(raws: list[bytes], y: np.ndarray, choices: list[list[np.ndarray]]) -> list[list[bytes]]:
    """For each choice of groups: the passages that are more frequent in the toxic
    texts of a group than in its ordinary ones, beyond chance among all grams
    compared, and RATIO times as frequent among texts of the same narrowest group
    (else they may only tell languages or kinds of text apart); surest first."""
    best: list[dict[bytes, float]] = [{} for _ in choices]
    for size in GRAMS:  # one size at a time: the index is what takes memory
        grams, held = _index(raws, y, size)
        for found, groups in zip(best, choices, strict=True):
            if not len(grams) or not groups:
                continue
            alike_enough = _common_ratio(held, len(grams), y, groups) >= RATIO
            for rows in groups:
                count = lambda want: np.bincount(np.concatenate([np.empty(0, np.int32), *(held[i] for i in rows if y[i] == want)]).astype(int), minlength=len(grams))  # noqa: B023, E731
                many, rare, n = count(1), count(0), (max(1, int((y[rows] == 1).sum())), max(1, int((y[rows] == 0).sum())))
                g = np.where(alike_enough, _surplus(many, rare, *n), 0.0)
                for core, sure in _chained(grams, many, g, size, 2 * np.log(len(grams) * len(groups)) + CHANCE):
                    found[core] = max(found.get(core, 0.0), sure)
        del grams, held
    out = []
    for found in best:
        cores: list[bytes] = []
        for core in sorted(found, key=lambda c: (-found[c], c)):
            if not any(core.strip() in c or c.strip() in core or _overlap(core, c) or _overlap(c, core) for c in cores):
                cores.append(core)
        out.append(cores)
    return out


def _overlap(a: bytes, b: bytes) -> bool:
    """Whether the end of ``a`` is the start of ``b`` over half of the shorter
    (4 bytes at most): then one is the other with some of its surroundings."""
    short = min(len(a), len(b))
    return any(a[-n:] == b[:n] for n in range(min(4, -(-short // 2)), short))


def _chained(grams: np.ndarray, many: np.ndarray, g: np.ndarray, size: int, least: float) -> list[tuple[bytes, float]]:
    """Grams above ``least``, made longer while nearly as many texts have them."""
    good = np.flatnonzero(g > least)
    good = good[np.argsort(-g[good], kind="stable")]
    spread = {int(grams[i]).to_bytes(size, "little"): (int(many[i]), float(g[i])) for i in good}
    out, used = [], set()
    ahead: dict[bytes, tuple[int, int]] = {}
    behind: dict[bytes, tuple[int, int]] = {}
    for gram, (n, _) in spread.items():
        ahead[gram[:-1]] = max(ahead.get(gram[:-1], (0, 0)), (n, gram[-1]))
        behind[gram[1:]] = max(behind.get(gram[1:], (0, 0)), (n, gram[0]))
    for gram, (n, sure) in spread.items():
        if gram in used:
            continue
        core, more, own = gram, True, {gram}
        while more:
            after, before = ahead.get(core[1 - size :], (0, 0)), behind.get(core[: size - 1], (0, 0))
            longer = core + bytes([after[1]]) if after >= before else bytes([before[1]]) + core
            new = longer[-size:] if after >= before else longer[:size]
            more = max(after, before)[0] >= 0.85 * n and new not in own
            if more:
                core = longer
                own.add(new)
        used |= {core[i : i + size] for i in range(len(core) - size + 1)}
        out.append((core, sure))
    return out


class Scorer:
    def __init__(self, base: bytes, cores: list[bytes], weights: list[float]):
        self.base, self.cores, self.weights, self._pair = base, cores, weights, None

    def state(self) -> tuple:
        return self.base, self.cores, self.weights

    def __getstate__(self):
        return self.state()

    def __setstate__(self, state):
        self.__init__(*state)

    def _compressors(self):
        if self._pair is None:
            def made(content: bytes):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

            # The ordinary content lies at the same distance in both dictionaries.
            self._pair = made(self.base), made(b"\0".join(reversed(self.cores)) + b"\0" + self.base)
        return self._pair

    def evidence(self, text: str | None) -> np.ndarray:
        plain, toxic = self._compressors()
        raw = (text or "").encode("utf-8", "replace")
        saved = np.array([len(plain.compress(w)) - len(toxic.compress(w)) for w in _windows(raw)], dtype=float)
        if not len(saved):
            return np.zeros(4)
        # Short passages save few bytes: whole ones are also counted, a KB.
        whole = sum(raw.count(c) for c in self.cores) / (len(raw) / 1000 + 0.5)
        top = np.sort(saved)[::-1]
        return np.array([min(top[0], 12.0), min(top[:3].mean(), 12.0), np.log1p(np.maximum(saved - 1, 0).mean()), np.log1p(whole)])

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        x = float(self.evidence(text) @ np.array(self.weights[:-1]) + self.weights[-1]) if text else -8.0
        return 1 / (1 + float(np.exp(-np.clip(x, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (bias last) of a ridge logistic fit by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 1e-2 * w
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w)), grad)
    return w


def different(texts: list[str | None]) -> list[int]:
    """The numbers of texts that are no copy or near copy (of about half of the
    3-word shingles) of one before: a text that was copied often is one text."""
    seen: set[int] = set()
    kept = []
    for i, text in enumerate(texts):
        bands = band_hashes(shingle_set(text, 3), COPY_BANDS, COPY_ROWS)
        own = set() if bands is None else set(bands.tolist())
        if seen.isdisjoint(own):
            kept.append(i)
        seen |= own
    return kept


def train(texts: list[str | None], labels: list[int]) -> Scorer:
    """Dictionaries from two thirds of the different texts, calibration on the rest."""
    kept = different(texts)
    texts, labels = [texts[i] for i in kept], [labels[i] for i in kept]
    raws, y = [(t or "").encode("utf-8", "replace") for t in texts], np.asarray(labels)
    half = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0)) % 3 < 2  # of each class alike
    fit = lambda want, rows: [r for r, k, h in zip(raws, y, rows, strict=True) if k == want and h]
    if not fit(1, half) or not fit(0, half) or not fit(1, ~half) or not fit(0, ~half):
        return Scorer(b"", [], [])
    groups = alike(raws, y)
    within = [rows[half[rows]] for rows in groups]
    trial_cores, cores = toxic_passages(raws, y, [within, groups])
    trial = Scorer(_ordinary_content(fit(0, half)), trial_cores, [])
    seen = [i for i in range(len(y)) if not half[i]]
    x = np.array([trial.evidence(texts[i]) for i in seen])
    # Each class weighs as it does in the rows given, both about half.
    w = _logistic(x, y[seen])
    p = np.sort(1 / (1 + np.exp(-np.column_stack([x, np.ones(len(x))]) @ w)))
    cuts = np.append((p[1:] + p[:-1]) / 2, (p[-1] + 1) / 2)  # the last one rejects nothing
    scores = 1 / (1 + np.exp(-np.column_stack([x, np.ones(len(x))]) @ w))
    # The cut that errs least, an ordinary text's error counting three times; it is moved to 0.3.
    loss = [3 * ((scores >= c) & (y[seen] == 0)).sum() + ((scores < c) & (y[seen] == 1)).sum() for c in cuts]
    cut = float(np.clip(cuts[int(np.argmin(loss))], 1e-4, 1 - 1e-4))
    w[-1] += np.log(0.3 / 0.7) - np.log(cut / (1 - cut))
    everything = np.ones(len(y), bool)
    return Scorer(_ordinary_content(fit(0, everything)), cores, w.tolist())


def _ordinary_content(raws: list[bytes]) -> bytes:
    windows = [w for r in raws[:BASE_ROWS] for w in _windows(r)]
    try:
        return zstandard.train_dictionary(BASE_BYTES + 2048, windows, k=64, d=8).as_bytes()[-BASE_BYTES:]
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(windows)[:BASE_BYTES]


def fitted(docs: DataFrame, labels: DataFrame, fold: int = 4, held: int = 2, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Scorer:
    return Scorer(*fitted_in_task(labelled(docs, labels, "toxic", fold, held, max_rows, max_bytes), train))


def toxicity_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id and score (near 1: toxic) of every whole text."""
    return score_texts(docs, fitted(docs, labels, **options).score)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``."""
    scorer = fitted(docs, labels, **options)
    return keep_rows(docs, lambda text: scorer.score(text) < threshold)
