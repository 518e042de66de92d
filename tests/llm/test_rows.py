"""No operator loses, adds or confuses rows: nulls, repeats and groups."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from rastertables.llm import common, exact_dedup, fingerprints, mixing, ngram_join, pii, quality, toxicity, warc


def grams(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {" ".join(words[i : i + min(n, len(words))]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_membership_filter_passes_every_wanted_hash(spark):
    wanted = common.stored(spark.range(0, 3000, 3).select(F.xxhash64("id").alias("h")), "wanted")
    marked = common.Likely(wanted, "likely").mark(spark.range(3000), F.xxhash64("id"), "hit")
    assert marked.filter("id % 3 = 0 AND NOT hit").count() == 0 and marked.filter("id % 3 <> 0 AND hit").count() < 200
    none = common.Likely(common.stored(spark.range(0).select(F.xxhash64("id").alias("h")), "wanted"), "likely")
    assert none.mark(spark.range(10), F.xxhash64("id"), "hit").filter("hit").count() == 0


def test_split_join_joins_hot_and_usual_keys(spark):
    rows = common.stored(spark.range(5000).select(F.when(F.col("id") < 2000, -1).otherwise(F.col("id")).alias("k"), "id"), "rows")
    table = common.stored(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "table")
    got = common.split_join(rows, table, "k", "n")
    assert got.count() == 5000 and got.filter("k = -1 AND n = 2000").count() == 2000
    some = common.split_join(rows, table.filter("k = -1 OR k % 2 = 0"), "k", "n", "left")
    assert some.count() == 5000 and some.filter("n IS NULL").count() == 1500


def test_one_of_each_class_goes_by_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (None, a), (None, b + " more"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text or "") for r in ngram_join.one_of_each_class(df).collect())
    assert got == [(0, ""), (1, a), (5, b)]
    classes = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in ngram_join.jaccard_classes(df).collect())
    assert classes == [(0, 0, 0), (0, 1, 2), (0, 5, 1), (1, 1, 2), (5, 1, 2), (5, 5, 1)]


def test_ngram_join_matches_string_ngrams(spark):
    rng = random.Random(5)
    texts = []
    for g in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 5)):
            words = list(base)
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
            texts.append(" ".join(words))
    sets = [grams(t) for t in texts]
    like = [{j for j, b in enumerate(sets) if j != i and a and len(a & b) >= 0.8 * len(a | b)} for i, a in enumerate(sets)]
    root = {}
    for i in range(len(texts)):
        todo = [i] if i not in root else []
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = i
                todo += like[k]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.jaccard_classes(df).collect()}
    assert got == {i: (root[i], len(like[i])) for i in range(len(texts))}


def test_counts_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "COUNTED", 10)
    monkeypatch.setattr(ngram_join, "SALT", 3)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 80, 2)] + [" ".join(base)] * 2
    sets = [grams(t) for t in texts]
    want = {i: sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for i, a in enumerate(sets)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_join.jaccard_classes(df).collect()
    assert {r.doc_id: r.n_links for r in got} == want and {r.class_id for r in got} == {0}


def test_dedup_goes_on_from_its_checkpoint(spark, tmp_path):
    path, checkpoint = f"{tmp_path}/keys", f"{tmp_path}/state"
    schema = "doc_id long, digest binary, row_id long, locator string"
    found = []
    for batch in ([(3, b"a", 0, "f1"), (4, b"b", 1, "f1")], [(1, b"a", 7, "f2"), (9, b"c", 8, "f2")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
        state = exact_dedup.keyed_state(spark.readStream.schema(schema).parquet(path), checkpoint)
        found.append({bytes(r.digest): (r["first"].doc_id, r["first"].locator, r.group_size) for r in state.collect()})
    assert found[0] == {b"a": (3, "f1", 1), b"b": (4, "f1", 1)}
    assert found[1] == {b"a": (1, "f2", 2), b"b": (4, "f1", 1), b"c": (9, "f2", 1)}


def test_dedup_of_a_hot_group_and_repeated_rows(spark):
    rows = [(i, "same  text" if i % 3 == 0 else f"text {i}") for i in range(300)] + [(3, "same text"), (1, "text 1"), (1, "text 1"), (None, "text 2"), (None, "alone")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, k_key string")
    kept = [(r.doc_id, r.text) for r in exact_dedup.drop_copies(df).collect()]
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(re.sub(r"\s+", " ", t), i)
    assert len(kept) == len(first) and {(re.sub(r"\s+", " ", t), i) for i, t in kept} == set(first.items())


def test_toxic_rows_go_one_by_one(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    text = lambda bad: " ".join(rng.choice(vocabulary) if i % 4 else bad for i in range(80))
    toxic, plain = text("scum"), "river " + text("water")
    rows = [(2 * i, text("scum"), "x") for i in range(60)] + [(2 * i + 1, "river " + text("water"), "x") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 1) for i, _, _ in rows], "doc_id long, toxic int, quality int")
    odd = [(1, toxic, "x"), (None, toxic, "x"), (None, plain, "x"), (2, plain, "x"), (7, None, "x"), (8, "", "x")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, score string")
    kept = [(r.doc_id, r.text) for r in toxicity.without_toxic(df, labels).collect()]
    assert (1, toxic) not in kept and (None, toxic) not in kept
    assert {(None, plain), (2, plain), (7, None), (8, "")} <= set(kept) and sum((t or "").startswith("river") for _, t in kept) == 62
    assert toxicity.without_toxic(df, labels).columns == df.columns
    assert toxicity.toxicity_scores(df, labels).count() == len(rows) + len(odd) == quality.quality_scores(df, labels).count()


def test_labelled_rows_are_bounded(spark):
    df = spark.createDataFrame([(i % 50, "t" * (10 + i)) for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    some = quality.labelled(df, labels, "toxic", 4, 2, 20).toPandas()
    assert len(some) <= 20 and some["text"].map(len).max() < 60
    assert quality.labelled(df, labels, "toxic", 4, 2, 20, 100).toPandas()["text"].map(len).sum() <= 100


def brute_mix(rows, weights=(5, 2, 1), most=3, seed="mix"):
    """(source, taken words, target) by water-filling in plain Python."""
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if most * size[s] <= level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s], left = float(most * size[s]), left - most * size[s]
        free -= over
    return size, target


@pytest.mark.parametrize("n", [0, 1, 7, 60])
def test_mix_against_water_filling(spark, n):
    rng = random.Random(n)
    rows = [(rng.choice([None, *range(40)]), rng.choice(["a", "b", "c", "d", None]), rng.choice([None, "", "x " * rng.randrange(1, 60)])) for _ in range(n)]
    rows += rows[: n // 4]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, source string, text string, size string")
    size, target = brute_mix(rows)
    got = mixing.mixed(df.drop("size")).collect()
    assert len(got) == len(rows)
    for s in size:
        own = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, target[s]) and r.source_size == size[s] and 0 <= r.repeats <= 3 for r in own)
        words = sum(r.repeats * r.size for r in own)
        assert abs(words - target[s]) <= max([r.size for r in own], default=0) * (1 + len(rows) // 8)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    planned = sorted((str(r.doc_id), str(r.source), r.size, r.repeats) for r in mixing.mixed(df).collect() if r.repeats)
    taken = sorted((str(r.doc_id), str(r.source), len((r.text or "").split()), r["count"]) for r in mixed.groupBy("doc_id", "source", "text").count().collect())
    merged = {}
    for *k, m in planned:
        merged[tuple(k)] = merged.get(tuple(k), 0) + m
    assert sorted((*k, m) for k, m in merged.items()) == taken


def test_fingerprints_have_a_row_per_row(spark):
    rows = [(1, "a b c d e f"), (1, "other text here now"), (1, "a b c d e f"), (None, "zz yy xx ww"), (5, ""), (None, None), (9, "q" * 40)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, hash string")
    got = fingerprints.fingerprints(df.select("doc_id", "text", "hash")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t or "")) for i, t in rows)
    order = [9, 5]
    edited = {r.doc_id: r.edited_sha256 for r in got}
    assert edited[9] == hashlib.sha256(("q" * 27).encode()).hexdigest() and edited[5] == hashlib.sha256(b"").hexdigest() and order


@pytest.mark.parametrize("n", [20, 32, 64, 200])
def test_fingerprint_order_counts_at_every_length(spark, n):
    rng = random.Random(n)
    rows = []
    for _ in range(15):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        rows.append((" ".join(words), " ".join(words[n // 2 :] + words[: n // 2]), " ".join([*words[:-1], "z"])))
    df = spark.createDataFrame(rows, "a string, b string, c string")
    for c in "abc":
        df = fingerprints.add_signature(df, c, f"s{c}")
    near = lambda x, y: F.avg(fingerprints.likeness(F.col(x), F.col(y)))
    swapped, edited = df.agg(near("sa", "sb"), near("sa", "sc")).first()
    assert swapped < 0.6 and edited > swapped + 0.1


def feistel(values, radixes, key, kind, back=False):
    """The permutation of the operator, and its inverse, in plain Python."""
    half, rounds = len(values) // 2, list(range(pii.ROUNDS))
    values = list(values)
    for r in reversed(rounds) if back else rounds:
        left = r % 2 == 0
        other = ",".join(map(str, values[half:] if left else values[:half]))
        for i in range(len(values)):
            if (i < half) == left:
                noise = int(hashlib.sha256(f"{key}|{kind}|{r}|{i}|{other}".encode()).hexdigest()[:12], 16)
                values[i] = (values[i] - noise if back else values[i] + noise) % radixes[i]
    return values


def test_feistel_against_plain_python(spark):
    rng = random.Random(1)
    for kind, radixes in (("ipv4", [256] * 4), ("date", [189, 773]), ("number", [10] * 15), ("ssn", [898, 99, 9999]), ("one", [26])):
        rows = [([rng.randrange(r) for r in radixes],) for _ in range(20)]
        df = spark.createDataFrame(rows, "v array<int>")
        got = df.select("v", pii.feistel(F.col("v"), F.array(*map(F.lit, radixes)), "key", kind).alias("p")).collect()
        for r in got:
            assert r.p == feistel(r.v, radixes, "key", kind) and feistel(r.p, radixes, "key", kind, True) == r.v


def test_one_day_has_one_pseudonym_in_all_formats(spark):
    rows = [(1, "x 1985-03-25 y 25.03.1985 z 25.3.1985 u 25/03/1985 v 03/25/1985 w 31.02.1999 end"), (2, ""), (3, None), (4, "word " * 100000 + "1985-03-25"), (1, "1985-03-25")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(df, key="k").filter("text <> '1985-03-25' OR text IS NULL").collect() if r.doc_id != 1 or len(r.text) > 20}
    y, m, d = re.search(r"x (\d{4})-(\d\d)-(\d\d) y", got[1].text).groups()
    assert got[1].text == f"x {y}-{m}-{d} y {d}.{m}.{y} z {int(d)}.{int(m)}.{y} u {d}/{m}/{y} v {m}/{d}/{y} w 31.02.1999 end" and (y, m, d) != ("1985", "03", "25")
    assert got[1].n_found == 5 and got[4].text.endswith(f"{y}-{m}-{d}") and got[3].text is None
    assert pii.pseudonymised(df.filter("false")).count() == 0


def test_pseudonyms_need_the_key(spark):
    df = spark.createDataFrame([(1, "10.1.2.3")], "doc_id long, text string")
    one = lambda **k: pii.pseudonymised(df, **k).first().text
    assert one(key="a") == one(key="a") != one(key="b") and one() != one()
    spark.conf.set(pii.KEY_SETTING, "a")
    assert one() == one(key="a")
    spark.conf.unset(pii.KEY_SETTING)


def test_warc_hot_payload_and_repeated_pages(spark):
    big, other = "<p>" + "x" * 1500, "<p>" + "y" * 1500
    rows = [(i, "u", big if i % 2 else f"{other}{i}") for i in range(200)] + [(199, "u", big), (7, "u", "small"), (7, "u", "small")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(df).collect()
    assert len(got) == len(rows) and all(r.payload_bytes is not None for r in got)
    assert sum(r.record_type == "revisit" for r in got) == 99 and {r.refers_to for r in got if r.record_type == "revisit"} == {199}


def test_copies_do_not_make_toxic_passages():
    """Near copies of one toxic text count as one text, and what only tells kinds of
    text apart is no toxic passage."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base = text(120)
    copies = [" ".join(base[:k] + ["scum", f"x{k}"] + base[k:]) for k in range(60)]
    toxic = [" ".join([*text(60), "scum", *text(60)]) for _ in range(60)]
    plain = [" ".join(text(120)) for _ in range(150)] + [" ".join(w + "%%" for w in text(120)) for _ in range(150)]
    texts, labels = copies + toxic + plain, [1] * 120 + [0] * 300
    order = rng.sample(range(len(texts)), len(texts))
    scorer = toxicity.train([texts[i] for i in order], [labels[i] for i in order])
    assert len(toxicity.different(copies)) <= 3 and any(b"scum" in c for c in scorer.cores) and not any(b"%" in c for c in scorer.cores)
    new = [" ".join(text(120)) for _ in range(60)], [" ".join([*text(60), "scum", *text(60)]) for _ in range(60)]
    assert sum(scorer.score(t) >= 0.3 for t in new[0]) <= 3 and sum(scorer.score(t) >= 0.3 for t in new[1]) >= 55 and scorer.score(" ".join(base)) < 0.3


def test_windows_against_zstandard_itself():
    """The evidence of a text is the difference of its windows' compressed sizes."""
    import zstandard

    scorer = toxicity.Scorer(b"some ordinary words that occur", [b" scum ", b" moron "], [])
    made = lambda content: zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
    plain, toxic = made(scorer.base), made(b" moron \0 scum \0" + scorer.base)
    raw = ("you are scum and a moron indeed, " * 9).encode()
    windows = [raw[i : i + toxicity.WINDOW] for i in range(0, len(raw) - toxicity.WINDOW + toxicity.STEP, toxicity.STEP)]
    assert b"".join(w[: toxicity.STEP] for w in windows)[: len(raw)] == raw[: len(b"".join(w[: toxicity.STEP] for w in windows))] and windows[-1][-5:] == raw[-5:]
    saved = sorted((len(plain.compress(w)) - len(toxic.compress(w)) for w in windows), reverse=True)
    got = scorer.evidence(raw.decode())
    assert got[0] == min(saved[0], 12) and abs(got[1] - min(sum(saved[:3]) / 3, 12)) < 1e-9


def test_convolution_against_plain_loops():
    import numpy as np

    net, text = quality.Network(3), "A text of some länge, long enough for two chunks. " * 12
    raw = text.encode()
    count = max(1, -(-(len(raw) - quality.WIDTH) // quality.HOP) + 1)
    outs = []
    for p in range(count):
        part = raw[p * quality.HOP : p * quality.HOP + quality.WIDTH]
        total = net.bias.astype(float).copy()
        for k in range(quality.WIDTH):
            total += net.tables[k][part[k] if k < len(part) else 0]
        outs.append(np.maximum(total, 0))
    halves = [np.max(outs[i : i + quality.POOL], axis=0) for i in range(0, count, quality.POOL)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves
    x = float(np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ net.head + net.base)
    assert abs(net.score(text) - 1 / (1 + math.exp(-x))) < 1e-5


def test_unigram_pieces_against_all_segmentations():
    from sentencepiece import sentencepiece_model_pb2

    from rastertables.llm import pieces

    proto = sentencepiece_model_pb2.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    rng = random.Random(4)
    names = ["<unk>", *pieces.MARK, "a", "b", "c", "ab", "bc", "abc", "ca", "bca", pieces.MARK + "a", pieces.MARK + "ab", "aa", "cab"]
    for name in names:
        piece = proto.pieces.add()
        piece.piece, piece.score, piece.type = name, -rng.random() * 5 - 0.01, 2 if name == "<unk>" else 1
    vocabulary = pieces.Vocabulary(proto.SerializeToString())

    def every(word):
        if not word:
            yield 0.0, ()
        for n in range(1, len(word) + 1):
            i = vocabulary.ids.get(word[:n])
            if i is not None:
                for score, rest in every(word[n:]):
                    yield score + vocabulary.scores[i], (i, *rest)

    for _ in range(60):
        text = " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 3)))
        got = vocabulary.encode([text])[0].tolist()
        best = max(every(pieces.MARK + text.replace(" ", pieces.MARK)))
        assert abs(sum(vocabulary.scores[i] for i in got) - best[0]) < 1e-4 and vocabulary.decode(got) == text


def test_pieces_keep_columns_and_repeats(spark):
    from rastertables.llm import pieces

    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (2, "", None)], "doc_id long, text string, exact string")
    with pytest.raises(ValueError):
        pieces.encode(df)
    got = pieces.encode(df, exact="same").collect()
    assert len(got) == 4 and all(r.same for r in got) and sorted(str(r.exact) for r in got) == ["None", "x", "x", "y"]


@pytest.mark.parametrize("where", ["first", "last", "both classes"])
def test_a_long_text_does_not_empty_the_sample(spark, where):
    """Texts of 52 MB in the order of the fit: all others are learned from as before."""
    marks = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    order = [r.doc_id for r in marks.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    long = {"first": order[:1], "last": order[-1:], "both classes": [next(i for i in order if i % 2 == k) for k in (0, 1)]}[where]
    docs = marks.select("doc_id", F.when(F.col("doc_id").isin(long), F.repeat(F.lit("word "), 10_500_000)).otherwise(F.concat(F.lit("text "), F.col("doc_id").cast("string"))).alias("text"))
    got = quality.labelled(docs, marks, "toxic", 4, 2, 300).toPandas()
    assert sorted(got["doc_id"]) == sorted(set(order) - set(long)) and set(got["label"]) == {0, 1}
    with pytest.warns(UserWarning, match="toxic = 1"):
        assert quality.labelled(docs, marks.filter("toxic = 0"), "toxic", 4, 2, 300).count() > 100


@pytest.mark.parametrize("how", ["inner", "left"])
def test_large_rows_of_hot_keys_are_copied_in_parts(spark, monkeypatch, how):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 10)
    rows = common.stored(spark.range(4000).select(F.when(F.col("id") < 3000, -1).otherwise(F.col("id")).alias("k"), "id"), "rows")
    table = common.stored(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.repeat(F.lit("x"), 100).alias("wide")).filter("k <> 3500"), "table")
    got = common.split_join(rows, table, "k", "n", how)
    assert got.count() == (3999 if how == "inner" else 4000) and got.filter("k = -1 AND length(wide) = 100").count() == 3000
    assert got.select("id").distinct().count() == got.count() and set(got.columns) == {"k", "id", "n", "wide"}


def test_rows_that_repeat_are_spread(spark):
    """90 % of the rows repeat text and (null) identifier."""
    df = spark.createDataFrame([(None, "same  text here", "s")] * 900 + [(i, f"text {i % 60} and more", "s") for i in range(100)], "doc_id long, text string, source string").repartition(5)
    got = exact_dedup.dedup_decisions(df).collect()
    assert len(got) == 1000 and sorted({(r.doc_id, r.group_size) for r in got if r.doc_id is None}) == [(None, 900)] and sum(r.kept for r in got) == 61
    assert exact_dedup.drop_copies(df).count() == 61
    signed = fingerprints.fingerprints(df).collect()
    assert len(signed) == 1000 and len({(r.fingerprint, r.edited_sha256, r.near_next) for r in signed if r.doc_id is None}) == 1
    alone = {tuple(r) for r in fingerprints.fingerprints(df.filter("doc_id IS NOT NULL").union(df.filter("doc_id IS NULL").limit(1))).collect()}
    assert {tuple(r) for r in signed} == alone


def test_columns_of_any_name(spark):
    names = ["k_key", "k_stays", "j_row", "j_likely", "l_h", "m_size", "p_source", "found", "__found", "new", "a b"]
    df = spark.createDataFrame([(i, f"one two three four five six {i // 2} 10.0.0.{i}", "s", *[f"{n} {i}" for n in names]) for i in range(6)], ["doc_id", "text", "source", *names])
    for work in (exact_dedup.drop_copies, ngram_join.one_of_each_class, mixing.mix, lambda d: pii.pseudonymised(d, key="k").drop("n_found")):
        out = work(df)
        assert out.columns == df.columns and out.count() > 0
        assert all(r[n] == f"{n} {r.doc_id}" for r in out.collect() for n in names)
    import corpus_pipeline

    assert set(corpus_pipeline.encode(spark, df.withColumn("ids", F.lit("x")), "").columns) == set(df.columns) - {"text"} | {"ids", "exact"}


def test_telephone_numbers_stay_linked(spark):
    """However a number is spaced, its code stays and the other digits are the same."""
    spelled = ["+49 30 1234567", "+4930 1234567", "+49301234567", "+49-30-1234567"]
    others = ["+1 555 123 4567", "+353 1 234 5678", "+7 495 123-45-67", "+420 601 123 456", "+44 20 7946 0958"]
    rows = spark.createDataFrame([(i, f"call {p} now") for i, p in enumerate([*spelled, *others])], "doc_id long, text string")
    got = [r.text[5:-4] for r in pii.pseudonymised(rows, key="k").orderBy("doc_id").collect()]
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    assert len({digits(p) for p in got[:4]}) == 1 and digits(got[0]) != digits(spelled[0]) and digits(got[0]).startswith("49")
    assert [re.sub("[0-9]", "0", p) for p in got] == [re.sub("[0-9]", "0", p) for p in [*spelled, *others]]
    assert [digits(p)[:n] for p, n in zip(got[4:], (1, 3, 1, 3, 2), strict=True)] == ["1", "353", "7", "420", "44"]
