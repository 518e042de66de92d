"""N-gram Jaccard self-join by MinHash banding.

1. Rows get a number and are stored.  Every text becomes its set of word
   n-grams; a 128-bit digest of the set and one hash per band go into a narrow
   table.  Texts of equal sets form a class that one row represents.
2. Representatives meet on band hashes (the shuffle).  In each bucket all
   members are compared with the bucket's least one on their full n-gram sets
   (unless counts of n-grams by range of hashes already tell that they share too few), which links most of what belongs together with few comparisons.
3. Connected components of these links.  In buckets that still hold more than
   one component, every member outside the commonest is compared with all
   members of other components, block by block, so no candidate pair that could
   join two components goes unverified.
4. Within each component all pairs of representatives are compared block by
   block; only counts leave a block, never the pairs.

No group is gathered in one task: buckets and components are cut into blocks,
the set of a bucket's least member is copied for every SALT comparisons, and
tables by digest, bucket or component are joined by ``split_join``.

Defined cases: null is the empty text; a text without words has no n-grams, a
class of its own and no links; a text of fewer than n words is one n-gram;
repeated rows and copies are in one class and count as each other's links; a
row without a doc_id is compared like any other, but names no class: class_id is
null if no row of the class has a doc_id; other columns are ignored by the
comparison and kept by ``one_of_each_class``; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Likely, small_batches, split_join, stored, with_own_names
from .components import components
from .shingles import band_hashes, choose_bands, shingle_set

NGRAM, SIMILARITY, RECALL, HASHES = 5, 0.8, 0.999, 128
#: Members of a bucket's block; comparisons that share one copy of a set.
BLOCK, SALT = 200, 1024
#: Guests of a block that are compared at a time.
VISITS = 400
#: Members and bytes of n-gram sets of a component's block.
COUNTED, COUNTED_BYTES = 400, 8 << 20
#: Ranges of hashes whose n-grams are counted, and the largest count that is told.
RANGES, MOST_COUNTED = 256, (1 << 16) - 1


def signatures(rows: DataFrame, n: int, bands: int, band_rows: int) -> DataFrame:
    """j_row, doc_id, digest (of the n-gram set; null without n-grams), bands."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests, hashes = [], []
            for text in batch["text"]:
                grams = shingle_set(text, n)
                digests.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                hashes.append(band_hashes(grams, bands, band_rows))
            yield pd.DataFrame({"j_row": batch["j_row"], "doc_id": batch["doc_id"], "digest": digests, "bands": hashes})

    return rows.select("j_row", "doc_id", "text").mapInPandas(run, f"j_row long, doc_id {kind}, digest binary, bands array<long>")


def _gram_sets(rows: DataFrame, n: int) -> DataFrame:
    """rep, n (of n-grams), counts (of n-grams by range of hashes), grams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, n) for t in batch["text"]]
            yield pd.DataFrame({"rep": batch["j_row"], "n": [len(x) for x in sets], "counts": [_counts(x) for x in sets], "grams": [x.tobytes() for x in sets]})

    return rows.select("j_row", "text").mapInPandas(run, "rep long, n long, counts binary, grams binary")


def _counts(grams: np.ndarray) -> bytes:
    found = np.bincount((grams >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64), minlength=RANGES)
    return np.minimum(found, MOST_COUNTED).astype(np.uint16).tobytes()


def _may_be_similar(n_a: np.ndarray, n_b: np.ndarray, counts_a: np.ndarray, counts_b: np.ndarray, similarity: float) -> np.ndarray:
    """Which sets may be at or above ``similarity``: two sets share at most the lesser count of
    every range, so none that is ruled out is similar.  Counts that may be cut rule nothing out."""
    least, most = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    both = np.where(most > MOST_COUNTED, least, np.minimum(counts_a, counts_b).sum(axis=-1, dtype=np.int64))
    return (least >= similarity * most - 1e-6) & (both >= similarity * (n_a + n_b - both) - 1e-6)


def _matrix(counts: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(counts), np.uint16).reshape(-1, RANGES)


def _possible(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b, k) of the rows (a, b, k, n_a, n_b, counts_a, counts_b) that may be similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = _may_be_similar(batch["n_a"].to_numpy(), batch["n_b"].to_numpy(), _matrix(batch["counts_a"]), _matrix(batch["counts_b"]), similarity)
            yield batch.loc[keep, ["a", "b", "k"]]

    return pairs.mapInPandas(run, "a long, b long, k int")


def _verified(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the rows (a, b, grams_a, grams_b) at or above ``similarity``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["grams_a"], batch["grams_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.loc[keep, ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The frames of equal keys from batches sorted by key, one at a time."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        code = batch.groupby(keys, sort=False).ngroup().to_numpy()
        cuts = np.flatnonzero(np.diff(code)) + 1
        parts = np.split(np.arange(len(batch)), cuts)
        for part in parts[:-1]:
            yield batch.iloc[part]
        rest = batch.iloc[parts[-1]]
    if rest is not None and len(rest):
        yield rest


def _similar(left: list[bytes], right: list[bytes], similarity: float) -> np.ndarray:
    """Boolean matrix: whose n-gram sets are at or above ``similarity``."""
    sets = [np.frombuffer(g, np.uint64) for g in [*left, *right]]
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    shared = np.zeros((len(left), len(right)), dtype=np.float32)
    # Sets are sorted: one range of hashes at a time, so that memory is bounded
    # by the incidence matrix of about 4096 n-grams however long the texts are.
    steps = max(1, int(sizes.sum()) // max(4096, 4 * len(sets)))
    at, edges = np.zeros(len(sets), dtype=np.int64), np.linspace(0, 2.0**64, steps + 1)[1:]
    for i, edge in enumerate(edges):
        upto = sizes.astype(np.int64) if i == steps - 1 else np.array([np.searchsorted(s, np.uint64(edge)) for s in sets])
        part = np.concatenate([s[x:y] for s, x, y in zip(sets, at, upto, strict=True)])
        owner, at = np.repeat(np.arange(len(sets)), upto - at), upto
        names, column = np.unique(part, return_inverse=True)
        for low in range(0, len(names), 4096):
            some = (column >= low) & (column < low + 4096)
            dense = np.zeros((len(sets), min(4096, len(names) - low)), dtype=np.float32)
            dense[owner[some], column[some] - low] = 1
            shared += dense[: len(left)] @ dense[len(left) :].T
    total = sizes[: len(left), None] + sizes[None, len(left) :] - shared
    return shared >= similarity * total - 1e-9


def _in_blocks(members: DataFrame, columns: list[str]) -> DataFrame:
    """Members of buckets (bucket, rep, comp, main, size) with ``columns``, dealt out by
    bucket and block: each has a home block, and those outside the bucket's commonest
    component ``main`` visit all blocks as guests."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    home = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    rows = members.withColumn("guest", F.lit(False)).withColumn("block", home)
    guests = members.filter("comp <> main").withColumn("guest", F.lit(True)).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.unionByName(guests).select("bucket", "block", "rep", "comp", "guest", *columns)
    return rows.repartition("bucket", "block").sortWithinPartitions("bucket", "block")


def _visits(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Up to VISITS guests and the members they are compared with."""
    for group in _groups(batches, ["bucket", "block"]):
        stay, visit = group[~group["guest"]], group[group["guest"]]
        for low in range(0, len(visit) if len(stay) else 0, VISITS):
            yield visit.iloc[low : low + VISITS], stay


def _maybe_linked(members: DataFrame, similarity: float) -> DataFrame:
    """bucket, rep of the members that may be similar to one of another component in
    their bucket.  members: bucket, rep, comp, main, size, n, counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for visit, stay in _visits(batches):
            n, counts, rep = stay["n"].to_numpy(), _matrix(stay["counts"]), stay["rep"].to_numpy()
            met = np.zeros(len(stay), dtype=bool)
            guests = []
            for own, comp, size, row in zip(visit["rep"], visit["comp"], visit["n"], _matrix(visit["counts"]), strict=True):
                like = _may_be_similar(size, n, row, counts, similarity) & (stay["comp"].to_numpy() != comp)
                met |= like
                if like.any():
                    guests.append(own)
            yield pd.DataFrame({"bucket": stay["bucket"].iloc[0], "rep": np.unique(np.concatenate([np.array(guests, np.int64), rep[met]]))})

    return _in_blocks(members, ["n", "counts"]).mapInPandas(run, "bucket long, rep long").distinct()


def _cross_links(members: DataFrame, similarity: float) -> DataFrame:
    """Links between components within buckets.  members: bucket, rep, comp,
    main (the bucket's commonest component), size, grams.  For each component
    that a guest is similar to in a block, one link is returned."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for visit, stay in _visits(batches):
            like = _similar(list(visit["grams"]), list(stay["grams"]), similarity)
            like &= visit["comp"].to_numpy()[:, None] != stay["comp"].to_numpy()[None, :]
            i, j = np.nonzero(like)
            found = pd.DataFrame({"a": visit["rep"].to_numpy()[i], "b": stay["rep"].to_numpy()[j], "c": stay["comp"].to_numpy()[j]})
            yield found.drop_duplicates(["a", "c"])[["a", "b"]]

    return _in_blocks(members, ["grams"]).mapInPandas(run, "a long, b long")


def _link_counts(members: DataFrame, similarity: float) -> DataFrame:
    """rep, n: how many documents of other representatives of its component
    are similar.  members: comp, rep, copies, blocks (of the component), grams.
    Every pair of blocks is a group; a set is in as many groups as there are
    blocks, which hold up to COUNTED members and COUNTED_BYTES of sets."""
    home = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rows = members.withColumn("home", home).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    rows = rows.withColumn("i", F.least("home", "other")).withColumn("j", F.greatest("home", "other")).select("comp", "i", "j", "home", "rep", "copies", "grams")
    rows = rows.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["comp", "i", "j"]):
            same = group["i"].iloc[0] == group["j"].iloc[0]
            left = group if same else group[group["home"] == group["i"]]
            right = group if same else group[group["home"] == group["j"]]
            n_left, n_right = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
            for x in range(0, len(left), BLOCK):
                for y in range(x if same else 0, len(right), BLOCK):
                    like = _similar(list(left["grams"].iloc[x : x + BLOCK]), list(right["grams"].iloc[y : y + BLOCK]), similarity).astype(np.int64)
                    if same and x == y:
                        np.fill_diagonal(like, 0)
                    n_left[x : x + BLOCK] += like @ right["copies"].to_numpy()[y : y + BLOCK]
                    if not same or x != y:
                        n_right[y : y + BLOCK] += left["copies"].to_numpy()[x : x + BLOCK] @ like
            if same:
                yield pd.DataFrame({"rep": left["rep"].to_numpy(), "n": n_left + n_right})
            else:
                yield pd.DataFrame({"rep": np.concatenate([left["rep"], right["rep"]]), "n": np.concatenate([n_left, n_right])})

    return rows.mapInPandas(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def _star_pairs(met: DataFrame) -> DataFrame:
    """(a, b, k) of every member b of a bucket and its least one a.  What many others
    are compared with is copied k times, once for about SALT of them, so that they do not
    meet in one task."""
    copies = F.shiftleft(F.lit(1), 1) ** F.ceil(F.log2(F.ceil(F.col("size") / SALT)))
    return met.filter("rep <> low").groupBy(F.col("low").alias("a"), F.col("rep").alias("b")).agg(F.max(copies.cast("int")).alias("k"))


def _with_sets(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (a, b, k), a stored table, with ``columns`` of the sets of both, named by _a and _b."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.col("k")).cast("int"))
    side = lambda x: sets.select(F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    left = pairs.select("a", "k").distinct().join(side("a"), "a")
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return pairs.join(side("b"), "b").join(left, ["a", "k", "salt"]).drop("salt")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with j_row, stored, so that a row's number stays the same."""
    small_batches(docs.sparkSession)
    return stored(docs.withColumn("j_row", F.monotonically_increasing_id()), "ngram-rows")


def classes_of_rows(rows: DataFrame, n: int = NGRAM, similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES, counts: bool = True) -> DataFrame:
    """One row per row of ``rows`` (a table of ``numbered``): j_row, doc_id,
    class_id, n_links (null with ``counts=False``), stays (whether the row
    represents its class: the one of least doc_id, nulls last, then j_row)."""
    bands, band_rows = choose_bands(similarity, recall, hashes)
    signed = stored(signatures(rows, n, bands, band_rows), "ngram-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "j_row")).alias("first")
    classes = signed.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("j_row").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), first)
    classes = stored(classes, "ngram-classes")
    met = classes.select("rep", F.explode("bands").alias("bucket"))
    buckets = stored(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("low")).filter("size > 1"), "ngram-sizes")
    met = stored(split_join(met, buckets, "bucket", "size"), "ngram-buckets")
    # The sets of candidates are made again from their texts, which a bounded
    # filter finds where they are; it may let more rows through than needed.
    likely = Likely(stored(met.select(F.xxhash64("rep").alias("h")).distinct(), "ngram-wanted"), "ngram-likely")
    sets = stored(_gram_sets(likely.mark(rows.select("j_row", "text"), F.xxhash64("j_row"), "j_likely").filter("j_likely"), n), "ngram-sets")
    pairs = stored(_star_pairs(met), "ngram-pairs")
    pairs = stored(_possible(_with_sets(pairs, sets, ["n", "counts"]), similarity), "ngram-possible")
    links = stored(_verified(_with_sets(pairs, sets, ["grams"]).drop("k"), similarity), "ngram-links")
    comps = components(links)
    met = met.filter("size > 2").join(comps, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "size", F.coalesce("component", "rep").alias("comp"))
    met = stored(met, "ngram-members")
    mixed = met.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("bucket")
    mixed = split_join(met, buckets.join(mixed, "bucket", "left_semi").select("bucket", F.col("size").alias("all")), "bucket", "all")
    mixed = stored(mixed.groupBy("bucket").agg(F.mode("comp", True).alias("main"), F.count(F.lit(1)).alias("all")), "ngram-mixed")
    met = stored(split_join(met, mixed, "bucket", "all"), "ngram-mixed-members")
    near = stored(_maybe_linked(met.join(sets.drop("grams"), "rep"), similarity), "ngram-near")
    left = stored(near.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")), "ngram-near-sizes")
    near = split_join(met.drop("size").join(near, ["bucket", "rep"], "left_semi"), left, "bucket", "size")
    more = stored(_cross_links(near.join(sets.select("rep", "grams"), "rep"), similarity), "ngram-more-links")
    if not more.isEmpty():
        comps = components(links.unionByName(more))
    comps = stored(comps, "ngram-components")
    out = classes.join(comps, F.col("rep") == F.col("node"), "left").select("digest", "rep", "copies", "first", F.coalesce("component", "rep").alias("comp"))
    out = stored(out, "ngram-members")
    heads = out.groupBy("comp").agg(F.min("first").alias("head"), F.count(F.lit(1)).alias("size"))
    heads = stored(heads.select("comp", F.col("head.doc_id").alias("class_id"), F.col("head.j_row").alias("head"), "size"), "ngram-heads")
    out = split_join(out, heads, "comp", "size")
    if counts:
        bytes_of = F.octet_length("grams")
        linked = stored(out.filter("size > 1").select("comp", "rep", "copies", "size"), "ngram-linked")
        sized = linked.join(sets.select("rep", "grams"), "rep").groupBy("comp").agg(F.max("size").alias("n"), F.sum(bytes_of).alias("bytes"))
        sized = stored(sized.select("comp", "n", F.greatest(F.ceil(F.col("n") / COUNTED), F.ceil(F.col("bytes") / COUNTED_BYTES)).cast("int").alias("blocks")), "ngram-blocks")
        members = split_join(linked.drop("size"), sized, "comp", "n").join(sets.select("rep", "grams"), "rep").select("comp", "rep", "copies", "blocks", "grams")
        found = _link_counts(members, similarity).withColumnRenamed("rep", "l_rep")
        out = out.join(found, F.col("rep") == F.col("l_rep"), "left").withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
    else:
        out = out.withColumn("n_links", F.lit(None).cast("long"))
    out = stored(out.select("digest", "copies", "class_id", "head", "n_links"), "ngram-found")
    found = split_join(signed.filter("digest IS NOT NULL").select("j_row", "doc_id", "digest"), out, "digest", "copies")
    found = found.select("j_row", "doc_id", "class_id", "n_links", (F.col("j_row") == F.col("head")).alias("stays"))
    alone = signed.filter("digest IS NULL").select("j_row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("stays"))
    return found.unionByName(alone)


def jaccard_classes(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the least doc_id of the
    component it is linked into, itself if it has no links) and n_links (other
    rows at or above the similarity)."""
    return classes_of_rows(numbered(docs.select("doc_id", "text")), **options).select("doc_id", "class_id", "n_links")


def one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that represent their class: of each group of near
    duplicates the one of least doc_id (rows without one last); columns may have any name."""
    return with_own_names(docs, lambda plain: _one_of_each_class(plain, **options))


def _one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    rows = numbered(docs)
    lost = classes_of_rows(rows, counts=False, **options).filter("NOT stays").select("j_row")
    lost = stored(lost, "ngram-lost")
    likely = Likely(stored(lost.select(F.xxhash64("j_row").alias("h")), "ngram-lost-hashes"), "ngram-lost-likely")
    marked = likely.mark(rows, F.xxhash64("j_row"), "j_likely")
    kept = marked.filter("NOT j_likely").unionByName(marked.filter("j_likely").join(lost, "j_row", "left_anti"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
