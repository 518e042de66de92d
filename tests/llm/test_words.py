"""Words of the encoder: where they are cut, which are kept; windows of words that may be frequent."""

from __future__ import annotations

import random

from rastertables.llm import collocations, pieces


def test_words_are_cut_before_punctuation():
    vocabulary = pieces.Vocabulary(pieces._model(pieces.MODEL))
    assert vocabulary.marked("the end. (So)") == ["▁the", "▁end", ".", "▁(So", ")"]
    texts = ["a.b", "x,. y", "\n.\n", " . ", "...", "e.g., (it)!? \"no\"", "“q.”", "1.5%", "", "  two", "ñ.ñ", "don't"]
    for text in texts:
        whole = (pieces.MARK if vocabulary.prefix else "") + text.replace(" ", pieces.MARK)
        assert "".join(vocabulary.marked(text)) == (whole if text else "")
        (_, ids), = vocabulary.encode_words([whole]) if text else [("", b"")]
        assert vocabulary.encode([text])[0].tobytes() == ids


def test_words_seen_before_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 10)
    vocabulary, seen = pieces.Vocabulary(pieces._model(pieces.MODEL)), []
    plain = vocabulary.encode_words
    monkeypatch.setattr(vocabulary, "encode_words", lambda words: plain(seen.extend(words := list(words)) or words))
    for text in ("alpha beta", "alpha gamma", "alpha delta"):
        vocabulary.encode([text])
    assert seen.count("▁alpha") == 1 and len(vocabulary.known) <= 3 and len(vocabulary.older) <= 3


def test_no_pair_of_pieces_is_judged_twice(monkeypatch):
    """More pairs than the cache held before are still judged once each."""
    monkeypatch.setattr(pieces, "CACHE", 0)
    vocabulary, calls = pieces.Vocabulary(pieces._model(pieces.MODEL)), []
    plain = vocabulary.apart
    monkeypatch.setattr(vocabulary, "apart", lambda *pair: calls.append(pair) or plain(*pair))
    some = [name for name in vocabulary.ids if name.isascii() and name.isalpha() and len(name) == 3][:350]
    for _ in range(2):
        for x in some:
            vocabulary.encode([" ".join(x + y for y in some)])
    assert len(set(calls)) > 100_000 and len(calls) == len(set(calls))


def test_neighbours_apart_against_merging(monkeypatch):
    """Merges noted at the edges of two pieces tell what merging their texts gives."""
    vocabulary, rng = pieces.Vocabulary(pieces._model(pieces.MODEL)), random.Random(6)

    def merged(text):
        parts, never = list(text), len(vocabulary.names)
        while len(parts) > 1 and (best := min((vocabulary.ranks.get(x + y, never), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))))[0] < never:
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
        return parts

    whole = [name for name in vocabulary.ids if merged(name) == [name]]
    few = [name for name in whole if len(set(name)) == 1 and 1 < len(name) < 9] + [*"aeinst"] + rng.sample(whole, 150)
    assert all((vocabulary.merges(name) is None) == (merged(name) != [name]) for name in vocabulary.ids)
    found = {vocabulary.apart(vocabulary.ids[x], vocabulary.ids[y]) == (merged(x + y) == [x, y]) for x in few for y in few}
    assert found == {True}
    # forgetting between words changes nothing
    texts = ["".join(rng.choices(whole, k=6)) for _ in range(50)] + ["aaaaaaa aa aaaa", "\u5b57\U0001f642 \ufb01a"]
    before = [ids.tolist() for ids in vocabulary.encode(texts)]
    monkeypatch.setattr(pieces, "PAIRS", 3)
    assert [ids.tolist() for ids in pieces.Vocabulary(pieces._model(pieces.MODEL)).encode(texts)] == before


def test_rare_long_phrases_are_cut_from_windows(spark):
    """Of frequent words and pairs, windows keep only what may be frequent itself."""
    texts = ["a b c d"] * 30 + [f"{x} b c {y}" for x, y in [("e", "f"), ("g", "h")] for _ in range(20)] + ["e b", "g b", "c f", "c h"] * 10
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").coalesce(1)
    may = collocations.Maybe.of(collocations.hash_counts(docs, 30, "hashes").filter("hash IS NOT NULL"))
    longer = collocations.Maybe.of(collocations.hash_counts(docs, 30, "longer", may, 4).filter("hash IS NOT NULL"))
    found = {tuple(w for w in r[1:5] if w) for r in collocations.lead_windows(docs, may, longer, 4).collect()}
    assert ("a", "b", "c", "d") in found and ("b", "c", "d") in found
    assert ("e", "b") in found and not any(w[:3] == ("e", "b", "c") or w[:3] == ("b", "c", "f") for w in found)
    got = {(r.phrase, r.a) for r in collocations.collocations(docs.withColumn("doc_id", docs.lang), share=200).collect()}
    assert {("a b c d", 30), ("e b", 30), ("c f", 30), ("b c", 70)} <= got and not any(p.startswith("e b c") for p, _ in got)
