"""Phrase collocations: word sequences whose words occur together more than apart.

Texts are split into pieces at punctuation and pieces into words.  Only the longest
windows are counted: each word with the ``most - 1`` words that follow it in its
piece, as lead columns, padded with nulls at the piece's end.  Every occurrence of a
shorter phrase is the start of exactly one window, so Spark's ROLLUP over the lead
columns sums the windows to the frequencies of all shorter phrases; these are never
taken from the texts.

A pass before that counts words and neighbouring pairs by their hashes, and a filter
of a bounded size (``Maybe``) tells which may be frequent.  A phrase is
frequent only if all its words and pairs are, so windows are cut (padded) at the
first pair that the filter rules out and those of ruled-out words are left out; a
second pass counts what longer phrases then remain, by their hashes, for a second filter
that cuts windows likewise.  That
changes no frequent phrase's frequency; it only keeps the many windows that occur once
or twice from being shuffled.  The filter may pass too much, and what is wrongly passed
is too rare at the end.

Defined cases: a null text has no words; a null lang is ``und``; rows that repeat
count as often as they occur; equal scores are in the order of frequency, then of the
phrase; no rows give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import MAP_BITS, MAPS, small_batches, stored

#: Bytes as they are read: A-Z lower-cased, what ends a piece a line feed, what parts words a space.
_READ = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b for b in range(256))
_TOKENS = re.compile(rb"\n|[^\n ]+")
#: Rows read together, bytes of texts after which what a task holds is counted, and rows sent on together.
ROWS, HELD_BYTES, SENT = 64, 1 << 23, 1 << 16


#: Bits of the hashes that are counted: what two of them share only lets more windows pass.
HASH_BITS = 40


def _mixed(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A hash of two hashes."""
    x = (a ^ (b >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """Texts of one language as numbers of words, -1 where a piece ends."""

    def __init__(self, lang: str):
        self.lang, self.number = lang, {b"\n": -1}
        self.texts: list[np.ndarray] = []

    def add(self, text: str) -> int:
        number = self.number
        raw = text.encode("utf-8", "replace").translate(_READ)
        tokens = _TOKENS.findall(raw)
        self.texts.append(np.fromiter(chain((number.setdefault(t, len(number) - 1) for t in tokens), (-1,)), np.int32, len(tokens) + 1))
        return len(raw)

    def taken(self, width: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words, their hashes, and for each word its window: (n, width) numbers,
        -1 from the piece's end on."""
        words = list(self.number)[1:]
        seed = xxh64_intdigest(self.lang.encode("utf-8", "replace"))
        hashes = _mixed(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)), np.uint64(seed))
        ids = np.concatenate([*self.texts, np.full(width, -1, np.int32)])
        lead = np.stack([ids[k : len(ids) - width + k] for k in range(width)], axis=1)
        lead = lead[lead[:, 0] >= 0]
        for k in range(1, width):
            lead[lead[:, k - 1] < 0, k] = -1
        return words, hashes, lead


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The words of each language, whenever a task holds much and at the end."""
    held: dict[str, Words] = {}
    size = 0
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            rows = batch.slice(at, ROWS)
            for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text"), strict=True):
                size += held.setdefault(lang, Words(lang)).add(text.as_py() or "")
                if size > HELD_BYTES:
                    yield from held.values()
                    held, size = {}, 0
    yield from held.values()


def _order(rows: np.ndarray, values: int) -> np.ndarray:
    """The order of rows of numbers from -1 to values - 1; as many columns as fit are
    sorted as one number."""
    bits = int(values + 1).bit_length()
    each = max(1, 63 // bits)
    keys = []
    for low in range(0, rows.shape[1], each):
        key = np.zeros(len(rows), np.int64)
        for column in rows[:, low : low + each].T:
            key = key << bits | (column + 1)
        keys.append(key)
    return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])


def _pairs(hashes: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(hashes[first], hashes[second] + np.uint64(1))


def _longer(hashes: np.ndarray, lead: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For k from 2 on: k, the windows of more than k words, and the hashes of their first k + 1
    words.  What is cut meanwhile is not in later ones."""
    if lead.shape[1] > 2:
        on = np.flatnonzero(lead[:, 2] >= 0)
        so_far = _pairs(hashes, lead[on, 0], lead[on, 1])
    for k in range(2, lead.shape[1]):
        stay = lead[on, k] >= 0
        on = on[stay]
        so_far = _mixed(so_far[stay], hashes[lead[on, k]] + np.uint64(k))
        yield k, on, so_far


def _cut(hashes: np.ndarray, lead: np.ndarray, may: Maybe, longer: Maybe | None = None) -> np.ndarray:
    """The windows whose first word may be frequent, padded from the first pair on that is ruled
    out, or from the first word on with which the window's start is."""
    lead = lead[may(hashes)[lead[:, 0]]] if len(hashes) else lead
    for k in range(1, lead.shape[1]):
        on = np.flatnonzero(lead[:, k] >= 0)
        out = on[~may(_pairs(hashes, lead[on, k - 1], lead[on, k]))]
        lead[out, k:] = -1
    for k, on, found in _longer(hashes, lead) if longer is not None else ():
        lead[on[~longer(found)], k:] = -1
    return lead


def hash_counts(texts: DataFrame, least: int, name: str, may: Maybe | None = None, most: int = 2) -> DataFrame:
    """A stored table of lang, hash, n: the hashes of words and neighbouring pairs that
    occur ``least`` times (lang null), and all words of each language (hash null).  With
    ``may``, which tells words and pairs, the hashes of longer phrases of up to ``most`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _collected(batches):
            lang = held.lang
            _, hashes, lead = held.taken(most)
            if may is not None:
                every = [h for _, _, h in _longer(hashes, _cut(hashes, lead, may))]
            else:
                inside = lead[lead[:, 1] >= 0]
                every = [hashes[lead[:, 0]], _pairs(hashes, inside[:, 0], inside[:, 1])]
            every = np.concatenate(every)
            found, n = np.unique(every & np.uint64((1 << HASH_BITS) - 1), return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": [lang], "hash": pa.array([None], pa.int64()), "n": [len(lead)]})
            for at in range(0, len(found), SENT):
                part = found[at : at + SENT].view(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.nulls(len(part), pa.string()), "hash": part, "n": n[at : at + SENT]})

    sums = texts.mapInArrow(run, "lang string, hash long, n long").groupBy("lang", "hash").agg(F.sum("n").alias("n"))
    return stored(sums.filter((F.col("n") >= least) | F.col("hash").isNull()), name)


class Maybe:
    """Which hashes may be wanted: one bit for each of at most MAP_BITS * MAPS classes of
    hashes (16 MB), broadcast to the Python workers."""

    def __init__(self, table, bits: int):
        self.table, self.bits = table, bits

    @classmethod
    def of(cls, hashes: DataFrame) -> Maybe:
        bits = 1 << min((MAP_BITS * MAPS).bit_length() - 1, max(15, (hashes.count() * 64).bit_length()))
        place = F.pmod("hash", F.lit(bits))
        maps = hashes.groupBy(F.floor(place / MAP_BITS).cast("int").alias("map")).agg(F.bitmap_construct_agg((place % MAP_BITS).cast("long")).alias("bits"))
        whole = bytearray(bits // 8)
        for row in maps.toLocalIterator():  # at most MAPS rows
            whole[row.map * MAP_BITS // 8 : (row.map + 1) * MAP_BITS // 8] = row.bits
        return cls(hashes.sparkSession.sparkContext.broadcast(bytes(whole)), bits)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & np.uint64(self.bits - 1)
        raw = np.frombuffer(self.table.value, np.uint8)
        return (raw[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def lead_windows(texts: DataFrame, may: Maybe, longer: Maybe | None, most: int) -> DataFrame:
    """lang, w1 to w<most> and n: the longest windows of words, pairs and longer phrases
    that may be frequent, counted over what a task holds at once."""
    names = [f"w{k + 1}" for k in range(most)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _collected(batches):
            lang = held.lang
            words, hashes, lead = held.taken(most)
            lead = _cut(hashes, lead, may, longer)
            lead = lead[_order(lead, len(words))]
            first = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]).any(axis=1)])[: len(lead)])
            n, lead = np.diff(np.append(first, len(lead))), lead[first]
            texts = pa.array([w.decode("utf-8", "replace") for w in words], pa.string())
            for at in range(0, len(n), SENT):
                part = lead[at : at + SENT]
                columns = [texts.take(pa.array(np.where(c >= 0, c, 0), mask=c < 0)) for c in part.T]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), *columns, pa.array(n[at : at + SENT], pa.int64())], ["lang", *names, "n"])

    return texts.mapInArrow(run, ", ".join(f"{c} string" for c in ["lang", *names]) + ", n long")


def phrase_counts(windows: DataFrame, most: int, least: int, name: str) -> DataFrame:
    """A stored table of lang, phrase, size and f: all phrases of up to ``most`` words
    with f >= least.  ROLLUP takes the last words away one by one."""
    names = [f"w{k + 1}" for k in range(most)]
    sums = windows.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("level")).filter(F.col("f") >= least)
    # At the level of k words the last most - k columns are taken away; padded windows are no phrases of k words.
    size = None
    for k in range(1, most + 1):
        size = (F.when if size is None else size.when)((F.col("level") == (1 << (most - k)) - 1) & F.col(names[k - 1]).isNotNull(), k)
    sums = sums.withColumn("size", size).filter(F.col("size").isNotNull())
    return stored(sums.select("lang", F.concat_ws(" ", *names).alias("phrase"), "size", "f"), name)


def _part(start: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), start, count), " ")


def lowest_cuts(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, k, l, r, score of every phrase of two words or more: the cut
    with the lowest score, of equal ones the first."""
    cuts = phrases.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("first", _part(F.lit(1), F.col("k"))).withColumn("rest", _part(F.col("k") + 1, F.col("size") - F.col("k")))
    part = lambda key, out: phrases.select("lang", F.col("phrase").alias(key), F.col("f").alias(out))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("score", F.call_function("div", exact("a") * F.lit(2_000_000).cast("decimal(10,0)"), exact("l") + exact("r")).cast("long"))
    best = F.min(F.struct("score", "k", "l", "r"))
    return cuts.groupBy("lang", "phrase", "a").agg(best.alias("c")).select("lang", "phrase", "a", "c.k", "c.l", "c.r", "c.score")


def inside_longer(phrases: DataFrame) -> DataFrame:
    """lang, phrase and longer: of every phrase of two words or more that lies inside a
    longer one, the largest frequency of such."""
    sizes = F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m")
    inner = phrases.filter("size > 2").select("lang", "phrase", "size", "f", sizes)
    inner = inner.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
    return inner.select("lang", _part(F.col("i"), F.col("m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, most: int = 4, least: int = 30, share: int = 80, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of two to ``most`` words of each language by score
    floor(2000000 a / (l + r)) of their lowest cut: lang, rank, phrase, a, l, r, n and
    score.  Phrases with ``least`` occurrences count, without those that lie inside a
    longer one with ``share`` % of their occurrences."""
    if most < 2:
        raise ValueError("phrases have at least two words")
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    counts = hash_counts(texts, least, "collocation-hashes")
    maybe = Maybe.of(counts.filter("hash IS NOT NULL"))
    longer = None
    if most > 2:
        longer = Maybe.of(hash_counts(texts, least, "collocation-longer", maybe, most).filter("hash IS NOT NULL"))
    phrases = phrase_counts(lead_windows(texts, maybe, longer, most), most, least, "collocation-phrases")
    kept = lowest_cuts(phrases).join(inside_longer(phrases), ["lang", "phrase"], "left")
    kept = kept.filter(F.coalesce(F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share, F.lit(True)))
    # A task sends its first rows of a language only.
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    first = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = counts.filter("hash IS NULL").select("lang", "n")  # one row a language
    return first.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i : i + size - 1], ' '))) AS phrase, size
  FROM words, range(1, 5) AS sizes(size)),
totals AS (SELECT lang, count(*) AS n FROM grams WHERE size = 1 GROUP BY lang),
f AS (SELECT lang, phrase, size, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, phrase, f AS a, size, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1 : size], ' ') AS tail
  FROM f, range(1, 4) AS ks(k) WHERE size > 1 AND k < size),
scored AS (
  SELECT c.lang, c.phrase, a, c.size, k, h.f AS l, t.f AS r, (2000000::HUGEINT * a // (h.f + t.f))::BIGINT AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = head JOIN f t ON t.lang = c.lang AND t.phrase = tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, inner_phrase, max(f) AS longer FROM (
    SELECT lang, f, unnest(list_transform(range(1, size - m + 2), lambda i: array_to_string(string_split(phrase, ' ')[i : i + m - 1], ' '))) AS inner_phrase
    FROM f, range(2, 4) AS ms(m) WHERE size > m)
  GROUP BY ALL)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN totals ON best.lang = totals.lang LEFT JOIN longer ON best.lang = longer.lang AND phrase = inner_phrase
WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
QUALIFY rank <= 2000
"""
