"""Importance resampling, collocations and license scans against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from rastertables.llm import collocations, licenses, resampling

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id long, text string, lang string, source string, score string, rank string, hash string, row string, phrase string"


def table(spark, rows):
    """Rows (doc_id, text, lang) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, "s", "x", "x", "x", "x", "x") for i, t, g in rows], KIND)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def duck(sql, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con.execute(sql).df()


# Importance resampling.


@pytest.mark.parametrize("text", ["", None, "...", "Hello, World 12", "\u00e9 \u00dc \u00dcn\u00ef\u0130 K x", "a" * 3000 + " b c " * 40, " ".join(map(str, range(3000)))], ids=str.__class__)
def test_ngram_crcs_follow_from_two_prefixes(text, monkeypatch):
    ws = words(text)
    want = [zlib.crc32(" ".join(ws[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]
    assert resampling.Prefixes(text).ngrams(1, 3).tolist() == want
    monkeypatch.setattr(resampling, "SLICE", 7)
    assert resampling.Prefixes(text).ngrams(1, 3).tolist() == want


def test_shifts_are_zero_bytes():
    state = np.array([0, 1, 0xDEADBEEF, 0xFFFFFFFF], np.uint32)
    lengths = np.array([0, 1, 5, 70_001])
    crc = lambda raw: zlib.crc32(raw) ^ zlib.crc32(b"\0" * len(raw))  # noqa: E731  the linear part
    raws = [int(s).to_bytes(4, "big") for s in state]
    before = np.array([crc(r) for r in raws], np.uint32)
    assert resampling.shifted(before, lengths).tolist() == [crc(r + b"\0" * int(n)) for r, n in zip(raws, lengths, strict=True)]


def resampled(rows, target, low=1, high=1, buckets=10_000, percent=10):
    grams = lambda t: [" ".join(w[i : i + n]) for w in [words(t)] for n in range(low, high + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(bucket(g) for _, x, _ in rows for g in grams(x)), Counter(bucket(g) for x in target for g in grams(x))
    total, wanted = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets))))
    out = []
    for i, x, _ in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(g)) for g in grams(x))
        out.append([i, len(grams(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)) >= 20])
    drawn = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("sizes", [(1, 1, 10_000), (1, 3, 100_000)])
def test_resampling_against_brute_force(spark, sizes):
    rng = random.Random(1)
    rows = [(i if i % 9 else None, " ".join(rng.choice(["Alpha", "be", "\u00e9t\u00e9", "x1", "zz"]) + rng.choice(" ,-") for _ in range(rng.randrange(60))), "en") for i in range(150)]
    rows += [(7, None, None), (8, "", "en"), (9, "word " * 30_000, "en"), (10, "same text " * 15, "en"), (10, "same text " * 15, "en"), (None, "same text " * 15, "en")]
    target = ["alpha be be", None, "", "x1 \u00e9t\u00e9 zz alpha"]
    docs, wanted = table(spark, rows), spark.createDataFrame([(t, 1) for t in target], "text string, item_id int")
    low, high, buckets = sizes
    got = sorted(map(tuple, resampling.resample(docs, wanted, 30, low, high, buckets).collect()), key=str)
    want = resampled(rows, target, low, high, buckets, 30)
    assert [r[:4] for r in got] == [r[:4] for r in want] and sorted(r[4] for r in got if r[4]) == list(range(1, sum(r[4] is not None for r in want) + 1))
    twice = {10, None}  # rows that repeat may change places
    assert [r for r in got if r[0] not in twice] == [r for r in want if r[0] not in twice]


def test_resampling_without_rows_or_target(spark):
    docs = table(spark, [(1, "a b " * 10, "en"), (2, "c", "en")])
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs.filter("false"), docs).count() == 0
    got = {r.doc_id: (r.weight, r.rank) for r in resampling.resample(docs, none, 100).collect()}
    assert got == {r[0]: (r[2], r[4]) for r in resampled([(1, "a b " * 10, "en"), (2, "c", "en")], [], percent=100)}


def test_resampling_matches_sql(spark):
    read = lambda n: spark.read.parquet(f"{DATA}/{n}.parquet")
    want = duck(resampling.RESAMPLING_SQL, documents=f"{DATA}/documents.parquet", benchmark=f"{DATA}/benchmark.parquet")
    got = resampling.resample(read("documents"), read("benchmark")).toPandas()
    key = lambda d: sorted(d[["doc_id", "n_features", "weight", "score", "rank"]].astype(object).astype(str).replace(r"\.0$", "", regex=True).replace({"<NA>": "nan"}).itertuples(index=False, name=None))
    assert key(got) == key(want)


# Collocations.


def mined(rows, most=4, least=30, share=80, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            f.update((lang or "und", *ws[i : i + k]) for k in range(1, most + 1) for i in range(len(ws) - k + 1))
    known = {p: a for p, a in f.items() if a >= least}
    longer = Counter()
    for p, a in known.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                key = (p[0], *p[i : i + k])
                longer[key] = max(longer[key], a)
    out = []
    for p, a in known.items():
        if len(p) > 2 and not 100 * longer[p] >= share * a:
            cuts = [(2_000_000 * a // (f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
            score, _, left, right = min(cuts)
            out.append((p[0], " ".join(p[1:]), a, left, right, n[p[0]], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(lang, k + 1, *r[1:]) for k, r in enumerate(own)]
    return sorted(ranked)


def text_of(rng, vocabulary, n):
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ", ", "\n", "."]) for _ in range(n))


@pytest.mark.parametrize("held", [collocations.HELD_BYTES, 500])
def test_collocations_against_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(collocations, "HELD_BYTES", held)
    rng = random.Random(2)
    vocabulary = ["New", "york", "the", "\u00c9t\u00e9", "a-b", "\u4e2d\u6587", "x\u00a0y"] + [f"w{i}" for i in range(60)]
    rows = [(i, text_of(rng, vocabulary[: rng.choice([3, 7, 67])], rng.randrange(80)), rng.choice(["en", "de", None, "und"])) for i in range(400)]
    rows += [(900, None, "en"), (901, "", "fr"), (None, "new york " * 3000, "en")] + [(902, "to be or not to be", "de")] * 35
    got = sorted(map(tuple, collocations.collocations(table(spark, rows)).collect()))
    assert got == mined(rows) and len({r[0] for r in got}) == 3
    few = sorted(map(tuple, collocations.collocations(table(spark, rows), 3, 10, 50, 5).collect()))
    assert few == mined(rows, 3, 10, 50, 5)


def test_collocations_match_sql(spark):
    want = sorted(duck(collocations.COLLOCATIONS_SQL, documents=f"{DATA}/documents.parquet")[["lang", "rank", "phrase", "a", "l", "r", "n", "score"]].itertuples(index=False, name=None))
    assert sorted(map(tuple, collocations.collocations(spark.read.parquet(f"{DATA}/documents.parquet")).collect())) == want


def test_collocations_of_nothing(spark):
    docs = table(spark, [(1, "a b", "en")])
    assert collocations.collocations(docs).count() == 0 and collocations.collocations(docs.filter("false")).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(docs, 1)


def test_a_filter_that_passes_everything_changes_nothing(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, text_of(rng, ["a", "b", "c", "d"], 60), "en") for i in range(60)]
    monkeypatch.setattr(collocations.Maybe, "__call__", lambda self, hashes: np.ones(len(hashes), bool))
    assert sorted(map(tuple, collocations.collocations(table(spark, rows)).collect())) == mined(rows)


# License scans.


def base(text):
    ws = words(text)
    at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    return len(ws), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def notice(label, n=0):
    return [t for x, t in licenses.NOTICES if x == label][n]


def covered(text, template):
    """The share of a template's words that runs of equal words cover, on diagonals within the slack of one."""
    ws, ts, k = words(text), words(template), licenses.K
    found = Counter()
    for i in range(len(ws) - k + 1):
        for j in range(len(ts) - k + 1):
            if ws[i : i + k] == ts[j : j + k]:
                found[i - j, j] += 1
    best = 0
    for d in {d for d, _ in found}:
        best = max(best, len({j + x for e, j in found if abs(e - d) <= licenses.SLACK for x in range(k)}))
    return best / len(ts)


def test_license_phrases_and_notices_against_brute_force(spark):
    rng = random.Random(4)
    filler = ["the", "mit", "license", "apache", "General", "public", "LICENSE", "of", "software", "x", "\u212aelvin", "\u0130"]
    texts = [" ".join(rng.choice(filler) + rng.choice([" ", ", ", "\n"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    texts += [notice("mit"), notice("gpl").upper(), "x " * 50 + notice("bsd") + " y " * 50, notice("mit").replace("free of charge", "entirely free of any charge at all"), notice("isc")[: len(notice("isc")) // 2], notice("bsd") + " " + notice("bsd", 1)]
    texts += [None, "", "m\u0130t license", "mit licen\u017fe", "MIT\x00LICENSE", "mit license " * 20_000]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "mit license", None), (None, "mit license", None), (3, texts[3], "en")]
    got = licenses.scan(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in enumerate(texts):
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), t
        if t is None or len(t) < 10_000:
            shares = [(covered(t or "", x), label) for label, x in licenses.NOTICES]
            labels = {label for share, label in shares if share >= licenses.COVER} | set(filter(None, r.base_labels.split(",")))
            assert r.labels == ",".join(sorted(labels)) and abs(r.score - max([1.0 if r.n_base else 0.0, *(s for s, _ in shares)])) < 1e-9, t
    assert [(r.n_base, r.labels) for r in got if r.doc_id is None] == [(1, "mit")] * 2


def test_license_spans_are_where_the_notice_stands(spark):
    text = "a b c " + notice("bsd").replace("source and binary", "source, object and binary") + " d e " + notice("bsd") + " mit license"
    spans = sorted(map(tuple, licenses.scan_spans(table(spark, [(1, text, "en")])).select("label", "first_word", "last_word").collect()))
    n = len(words(notice("bsd")))
    (bsd, first, last), (_, second, end), mit = [s for s in spans if s[0] == "bsd"] + [s for s in spans if s[0] == "mit"]
    assert len(spans) == 3 and 3 <= first < last <= 3 + n and (second, end) == (3 + n + 1 + 2, 3 + n + 1 + 2 + n - 1) and mit == ("mit", end + 1, end + 2)


def test_license_scan_of_nothing(spark):
    docs = table(spark, [(1, "a", "en")])
    assert licenses.scan(docs.filter("false")).count() == 0
    (row,) = licenses.scan(docs).collect()
    assert (row.n_base, row.base_labels, row.labels, row.score, row.first_word) == (0, "", "", 0.0, None)
