"""SentencePiece encoding and decoding of a public vocabulary file.

Encoding walks the distinct marked words (runs of the space mark with what
follows) of a batch of texts in sorted order, which is a depth-first walk of
their trie: the forward states of the common prefix with the word before are
kept, and only the rest of the word is scanned.  A forward state is, for one
prefix, the piece its best segmentation ends with, and the longest end of the
prefix that begins a piece, which tells the arcs: the pieces the prefix ends with.

In a unigram vocabulary the best arc has the highest score sum (Viterbi).  In a
BPE vocabulary scores are merge ranks, whose sum means nothing; there, an arc is
admissible only if the last piece of the shorter prefix and the new piece stay
apart when the two are merged by themselves.  Exactly one arc is, since a
segmentation is what merging gives if and only if every two neighbours of it
are; so the forward pass gives exactly the ids that merging gives.  Each piece is
merged once by itself; two neighbours stay apart if no merge across their border
comes before the merges that were noted at their edges.

Defined cases: null and empty texts have no ids; characters outside the
vocabulary become bytes (or the unknown id without byte pieces); U+2581 in a
text is a space, as in the vocabulary's own definition; lone surrogates are
replaced.  Texts of any length are encoded whole; repeated rows give a row each;
other columns are kept; no rows give no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, USER, UNUSED, BYTE = 1, 2, 4, 5, 6
#: Characters of words that are kept with their ids (twice: those seen lately and those before),
#: and pairs of pieces judged and steps between ends, in a Python worker.
CACHE, PAIRS = 1_000_000, 400_000
#: Texts encoded at a time within a batch.
ROWS = 128

#: Changes of a part of a piece at its edge: (rank, new part).
Steps = list[tuple[int, str]]
#: The longest end of a prefix that begins a piece: its text, the ends after a further character, its arcs.
End = tuple[str, dict[str, "End"], list[tuple]]


class Vocabulary:
    """What encoding needs of a model file: pieces, scores, byte ids."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only vocabularies of the identity normaliser are supported")
        self.bpe = proto.trainer_spec.model_type == 2
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.names = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        own = {NORMAL, USER, UNUSED}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in own}
        self.scores = [p.score for p in proto.pieces]
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.sizes = [len(name) for name in self.names]
        self.heads = {name[:i] for name in self.ids for i in range(len(name) + 1)}
        self.words = re.compile(self._cuts())
        order = sorted(self.ids, key=lambda p: -self.scores[self.ids[p]])
        self.ranks = {p: i for i, p in enumerate(order)}
        self.never = len(self.names)
        self.merged: dict[str, tuple[Steps, Steps] | None] = {}
        self._forget()
        #: Ids of the words seen lately and before, and how many characters the former have.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode() if p.type in own else b"" for p in proto.pieces]

    def _cuts(self) -> str:
        """A pattern that cuts marked texts only where no piece spans the cut:
        before marks, at line ends, and before punctuation after a character
        that no piece has before punctuation."""
        if any(MARK in name.lstrip(MARK) for name in self.ids):
            return "(?s).+"
        if any("\n" in name for name in self.ids):
            return f"{MARK}*[^{MARK}]+|{MARK}+"
        marks = ",.;:!?*%&$#|)]}>\"'"
        joined = {x for name in self.ids for x, y in zip(name, name[1:]) if y in marks} - {MARK}
        p, before = re.escape(marks), re.escape("".join(sorted(joined | set(marks))))
        run = f"[^{MARK}\n{p}]"
        return f"\n|{MARK}*(?:{run}+|[{p}]+{run}*)(?:(?<=[{before}])[{p}]+{run}*)*|{MARK}+"

    def _forget(self) -> None:
        """Drop the ends met, and of every piece what may stand before it."""
        self.ends: dict[str, End] = {}
        self.judged: dict[int, dict[int, bool]] = {}
        self.pairs = 0

    def merges(self, piece: str) -> tuple[Steps, Steps] | None:
        """How merging ``piece`` by best score, leftmost first, changes its first
        and its last part: (worst rank since the change before, new part) each,
        ended by a rank that never comes.  None if it does not end with one part."""
        if (known := self.merged.get(piece, False)) is not False:
            return known
        parts, rank, never = list(piece), self.ranks, self.never
        ranks = [rank.get(x + y, never) for x, y in zip(parts, parts[1:])]
        first, last, at_first, at_last = [], [], -1, -1
        while ranks and (best := min(ranks)) != never:
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            at_first, at_last = max(at_first, best), max(at_last, best)
            if i == 0:
                first.append((at_first, parts[0]))
                at_first = -1
            if i == len(parts) - 1:
                last.append((at_last, parts[i]))
                at_last = -1
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], never)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], never)
        found = self.merged[piece] = ([*first, (never, "")], [*last, (never, "")]) if len(parts) == 1 else None
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether merging neighbours of the texts of two pieces, each of which
        merges to itself, by best score, leftmost first, ends with just these two."""
        before, after, rank, never = self.names[left], self.names[right], self.ranks, self.never
        lefts, rights = iter(self.merges(before)[1]), iter(self.merges(after)[0])
        x, y = before[-1], after[0]
        (at_left, next_left), (at_right, next_right) = next(lefts), next(rights)
        while True:
            across = rank.get(x + y, never)
            if at_left != never and at_left <= across and at_left <= at_right:
                x = next_left
                at_left, next_left = next(lefts)
            elif across <= at_right:
                return across == never
            else:
                y = next_right
                at_right, next_right = next(rights)

    def _end(self, text: str) -> End:
        """The end ``text`` of a prefix: where characters lead, and its arcs from
        the shortest on: (size, id, what may stand before it or, in a unigram
        vocabulary, score)."""
        if (known := self.ends.get(text)) is None:
            arcs = [(len(p), self.ids[p]) for i in reversed(range(len(text))) if (p := text[i:]) in self.ids and not (self.bpe and self.merges(p) is None)]
            known = self.ends[text] = text, {}, [(n, i, self.judged.setdefault(i, {-1: True}) if self.bpe else self.scores[i]) for n, i in arcs]
        return known

    def _step(self, end: End, char: str) -> End:
        text = end[0] + char
        while text not in self.heads:
            text = text[1:]
        self.pairs += 1
        found = end[1][char] = self._end(text)
        return found

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """(word, packed ids) in sorted order, forward states shared between neighbours."""
        extend, before, ends, last, total = self._admissible if self.bpe else self._best, "", [self._end("")], [-1], [0.0]
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del ends[shared + 1 :], last[shared + 1 :], total[shared + 1 :]
            extend(word[shared:], ends, last, total)
            before = word
            yield word, array("i", self._ids(word, last)).tobytes()
            if self.pairs > PAIRS:
                self._forget()
                before, ends, last, total = "", [self._end("")], [-1], [0.0]

    def _admissible(self, rest: str, ends: list[End], last: list[int], total: list[float]) -> None:
        """Extend the forward states of a word by the admissible arcs over ``rest``."""
        end = ends[-1]
        for char in rest:
            end = end[1].get(char) or self._step(end, char)
            for size, piece, known in end[2]:
                left = last[-size]
                if (ok := known.get(left)) is None:
                    ok = known[left] = self.apart(left, piece)
                    self.pairs += 1
                if ok:
                    break
            else:
                piece = self.ids.get(char, -1)
            ends.append(end)
            last.append(piece)

    def _best(self, rest: str, ends: list[End], last: list[int], total: list[float]) -> None:
        """Extend the forward states of a word by the arcs of best score sum over ``rest``."""
        end = ends[-1]
        for char in rest:
            end = end[1].get(char) or self._step(end, char)
            best, score = self.ids.get(char, -1), total[-1] - 1e6
            for size, piece, own in end[2]:
                if total[-size] + own > score:
                    best, score = piece, total[-size] + own
            ends.append(end)
            last.append(best)
            total.append(score)

    def _ids(self, word: str, last: list[int]) -> list[int]:
        out, end, sizes = [], len(word), self.sizes
        while end:
            if (i := last[end]) >= 0:
                out.append(i)
                end -= sizes[i]
                continue
            end -= 1
            if self.bytes:
                out.extend(self.bytes[b] for b in reversed(word[end].encode("utf-8", "replace")))
            else:
                out.append(self.unknown)
        return out[::-1]

    def marked(self, text: str) -> list[str]:
        return self.words.findall((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else []

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        split = [self.marked(t or "") for t in texts]
        if self.held > CACHE:
            self.known, self.older, self.held = {}, self.known, 0
        known, older = self.known, self.older
        new = set().union(*split).difference(known)
        self.held += sum(map(len, new)) + 8 * len(new)
        again = older.keys() & new
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        known.update(self.encode_words(new - again))
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in split]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=1)
def _vocabulary(model: bytes) -> Vocabulary:
    """One vocabulary a Python worker, with what it has learnt; its caches are bounded."""
    return Vocabulary(model)


def encode(docs: DataFrame, text: str = "text", path: str = MODEL, ids: str = "ids", exact: str = "exact") -> DataFrame:
    """``docs`` without ``text``, with ``ids`` (array<int>) and ``exact`` (whether
    decoding gives the text back).  Columns of these names in ``docs`` are an
    error: name the results otherwise.  The vocabulary (about 0.5 MB) is read on
    the driver and broadcast."""
    clash = {ids, exact} & (set(docs.columns) - {text})
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist: choose other names for the results")
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(_model(path))
    rest = [c for c in docs.columns if c != text]
    fields = [docs.schema[c] for c in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model.value)
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                rows = batch.slice(low, ROWS)
                texts = [t or "" for t in rows.column(text).to_pylist()]
                found = vocabulary.encode(texts)
                same = [vocabulary.decode(i.tolist()) == t for i, t in zip(found, texts, strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.empty(0, np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rest), lists, pa.array(same, pa.bool_())], [*rest, ids, exact])

    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(exact, T.BooleanType())])
    return docs.select(*[F.col(f"`{c}`") for c in [*rest, text]]).mapInArrow(run, schema)


def decode(rows: DataFrame, ids: str = "ids", out: str = "text", path: str = MODEL) -> DataFrame:
    """``rows`` with the text of column ``ids``; null ids are the empty text."""
    model = rows.sparkSession.sparkContext.broadcast(_model(path))

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = _vocabulary(model.value)
        for part in parts:
            yield pd.Series([vocabulary.decode(i) if i is not None else "" for i in part], dtype=object)

    return rows.withColumn(out, run(ids))
