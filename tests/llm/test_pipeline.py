"""The corpus pipeline: every stage against plain Python, odd rows, empty tables."""

import random
import re

import pytest

from rastertables.llm import pieces, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
pipeline = pytest.importorskip("corpus_pipeline")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def grams(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {" ".join(words[i : i + min(n, len(words))]) for i in range(max(1, len(words) - n + 1))} if words else set()


def first(rows):
    return min(rows, key=lambda r: (r[0] is None, r[0] or 0))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    text = lambda n, bad=None: " ".join(bad if bad and i % 6 == 5 else rng.choice(vocabulary) for i in range(n))
    rows, labels = [], []
    for i in range(160):
        toxic = i % 4 == 0
        rows.append((i, text(rng.randrange(40, 90), "scumbag" if toxic else None), "en", "abc"[i % 3], 1))
        labels.append((i, int(toxic), 1))
    for i in (1, 2, 3, 5):
        rows.append((1000 + i, rows[i][1].replace(" ", "  ", 3), "en", "a", 1))  # copies
        rows.append((2000 + i, rows[i][1] + " tail", "en", None, 1))  # near copies
    rows += [(None, text(50), "en", "a", 1), (None, rows[7][1] + " more", "en", "b", 1), (9, text(40), "en", "c", 1), (None, None, None, None, None), (5000, "", "en", "a", 0)]
    rows += [(5001, " \n ", "en", "b", 3), (5002, text(30000), "de", "c", 1), (12, rows[12][1], "en", "a", 1), rows[13], rows[13], (None, text(30, "scumbag"), "en", "a", 1), (9, text(30, "scumbag"), "en", "c", 1)]
    path = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_plain_python(spark, folder):
    stages = dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = rows_of(docs)
    scorer = toxicity.fitted(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = stages["toxicity"](spark, docs, folder)
    assert kept.columns == docs.columns and rows_of(kept) == [r for r in before if scorer.score(r[1]) < 0.3]
    bad = [r for r in before if "scumbag" in (r[1] or "")]
    assert len(bad) >= 42 and sum(r in bad for r in rows_of(kept)) <= 1 and len(before) - kept.count() <= len(bad) + 1

    single = stages["exact_dedup"](spark, kept, folder)
    groups = {}
    for r in rows_of(kept):
        groups.setdefault(normal(r[1]), []).append(r)
    assert rows_of(single) == sorted((first(g) for g in groups.values()), key=str)

    near = stages["ngram_jaccard_join"](spark, single, folder)
    rows = rows_of(single)
    sets = [grams(r[1]) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                root[top(i)] = top(j)
    classes = {}
    for i, r in enumerate(rows):
        classes.setdefault(top(i), []).append(r)
    assert rows_of(near) == sorted((first(c) for c in classes.values()), key=str)

    mixed = stages["source_mix"](spark, near, folder)
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    size, taken = {}, {}
    for r in rows_of(near):
        size[r[3]] = size.get(r[3], 0) + words(r)
    for r in rows_of(mixed):
        taken[r[3]] = taken.get(r[3], 0) + words(r)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, target, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, float(sum(size.values()))
    while len(target) < len(names):
        free = [s for s in names if s not in target]
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if 3 * size[s] <= level * weight[s]]
        for s in over or free:
            target[s] = 3.0 * size[s] if over else level * weight[s]
        left -= sum(target[s] for s in over)
    longest = {s: max((words(r) for r in rows_of(near) if r[3] == s), default=0) for s in names}
    assert all(abs(taken.get(s, 0) - target[s]) <= longest[s] for s in names)
    assert set(rows_of(mixed)) <= set(rows_of(near))

    coded = stages["sentencepiece"](spark, mixed, folder)
    vocabulary = pieces.Vocabulary(pieces._model(pieces.MODEL))
    texts = {(r[0], r[3], r[4]): r[1] for r in rows_of(mixed)}
    found = coded.collect()
    assert len(found) == mixed.count() and all(r.exact and vocabulary.decode(r.ids) == (texts[r.doc_id, r.source, r.n_chars] or "") for r in found if r.doc_id is not None)


def test_runs_and_empty_tables(spark, folder, tmp_path):
    out = pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids", "exact"] and out.count() > 50
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, toxic int, quality int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
