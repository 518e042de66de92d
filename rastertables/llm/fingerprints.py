"""Document fingerprints: Order MinHash over occurrence-numbered word k-mers.

A text becomes a sequence of tokens (words; a word of more than 12 code points
counts as several tokens, so texts without spaces have tokens too).  Each k-mer
of tokens is hashed together with its occurrence number in the text, which
makes repeated k-mers distinct.  The hash also deals the k-mers over ``m``
slots; in each slot the ``l`` k-mers of least hash are chosen, put back into
their order in the text, and hashed as a tuple.  A slot with fewer takes the
missing ones from the slots that follow it (the last is followed by the first),
so short texts also have ``m`` tuples of ``l`` k-mers whose order counts.  The
``m`` tuple hashes are the signature.  Moving passages changes the order inside
tuples, so the share of equal slots falls with edit distance and not only with
the set of k-mers.

Everything is built from SQL array functions within a row: no Python.  Work per
text is n log n in its tokens.

Defined cases: a null text is the empty text; a text with fewer than k tokens
has one k-mer of what it has, an empty one none and an empty signature; two
empty texts have likeness 1, an empty and another text 0; a text has fewer than
2^31 tokens, as any array of Spark.  Every row has a row in the result: a null
doc_id comes last in the descending order; rows of one doc_id are in the order
of their texts' hashes; rows that repeat doc_id and text are one place in that
order, and have the same result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, stored, text_or_empty

K, L, M = 2, 2, 64
TOKENS = r"[^\x20\x09-\x0D]{1,12}"
#: Bits of a packed long that hold a k-mer's position, and its hash within a slot.
POS, HASH = 31, 25


def add_signature(docs: DataFrame, text: str, out: str, k: int = K, l: int = L, m: int = M) -> DataFrame:  # noqa: E741
    """``docs`` with the signature of column ``text``: an array of ``m`` ints, or
    of none for a text without tokens.

    Each step is a column of its own that later lambdas read, so no step is
    evaluated once per element.
    """
    low, body = F.lit((1 << POS) - 1), F.lit((1 << HASH) - 1)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none("int"))
    c = {n: F.col(f"__{n}") for n in "whsboecrt"}
    get = F.get
    steps = docs.withColumn("__w", F.transform(F.regexp_extract_all(text_or_empty(text), F.lit(TOKENS), F.lit(0)), lambda t: F.xxhash64(t)))
    starts = upto(F.when(F.size(c["w"]) > 0, F.greatest(F.size(c["w"]) - (k - 1), F.lit(1))).otherwise(0))
    steps = steps.withColumn("__h", F.transform(starts, lambda i: F.xxhash64(*[get(c["w"], i + j) for j in range(k)]))).drop("__w")
    # k-mers sorted by (hash, position): runs of equal k-mers in text order.
    packed = F.transform(c["h"], lambda h, i: F.shiftleft(F.shiftright(h, POS), POS).bitwiseOR(i.cast("long")))
    steps = steps.withColumn("__s", F.sort_array(packed)).drop("__h")
    kmer = lambda i: F.shiftright(get(c["s"], i), POS)
    steps = steps.withColumn("__b", F.filter(upto(F.size(c["s"])), lambda i: (i == 0) | (kmer(i) != kmer(i - 1))))
    ends = F.concat(F.slice(c["b"], 2, F.greatest(F.size(c["b"]), F.lit(1))), F.array(F.size(c["s"])))
    runs = F.flatten(F.zip_with(c["b"], ends, lambda a, b: F.sequence(F.lit(0), b - a - 1)))
    steps = steps.withColumn("__o", F.when(F.size(c["b"]) > 0, runs).otherwise(none("int"))).drop("__b")
    # Numbered k-mers sorted by (slot, hash, position); the first l of each slot stay.
    number = F.zip_with(c["s"], c["o"], lambda s, o: F.xxhash64(F.shiftright(s, POS), o))
    entry = lambda x, s: F.shiftleft(F.pmod(x, F.lit(m)), HASH + POS).bitwiseOR(F.shiftleft(F.shiftrightunsigned(x, 64 - HASH), POS)).bitwiseOR(s.bitwiseAND(low))
    steps = steps.withColumn("__e", F.sort_array(F.zip_with(number, c["s"], entry))).drop("__s", "__o")
    slot = lambda e: F.shiftright(e, HASH + POS)
    steps = steps.withColumn("__c", F.filter(c["e"], lambda e, i: (i < l) | (slot(get(c["e"], i - l)) != slot(e)))).drop("__e")
    steps = steps.withColumn("__r", F.filter(upto(F.size(c["c"])), lambda i: (i == 0) | (slot(get(c["c"], i)) != slot(get(c["c"], i - 1)))))
    # A tuple of l k-mers from each slot's first one on, back in text order.
    turned = lambda e: F.shiftleft(e.bitwiseAND(low), HASH).bitwiseOR(F.shiftright(e, POS).bitwiseAND(body))
    chosen = lambda i: F.transform(F.sequence(F.lit(0), F.least(F.lit(l), F.size(c["c"])) - 1), lambda j: turned(get(c["c"], ((i + j) % F.size(c["c"])).cast("int"))))
    steps = steps.withColumn("__t", F.transform(c["r"], lambda i: F.hash(F.transform(F.sort_array(chosen(i)), lambda t: t.bitwiseAND(body)))))
    # The tuple of a slot with k-mers also stands for the empty slots before it.
    place = lambda j: slot(get(c["c"], get(c["r"], j)))
    gap = lambda j: F.when(j == 0, place(j) + 1).otherwise(place(j) - place(j - 1)).cast("int")
    filled = F.flatten(F.transform(c["t"], lambda t, j: F.array_repeat(t, gap(j))))
    rest = F.array_repeat(get(c["t"], F.lit(0)), (F.lit(m - 1) - place(F.size(c["r"]) - 1)).cast("int"))
    return steps.withColumn(out, F.when(F.size(c["t"]) > 0, F.concat(filled, rest)).otherwise(none("int"))).drop("__c", "__r", "__t")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.try_divide(same.cast("double"), F.greatest(F.size(a), F.size(b))))


def as_string(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def next_places(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """key (the doc_id as text, ~ for null), hash (of the text), n_chars, rows (that share
    the place), next_key, next_hash: the next place in the descending order of doc_id (nulls last, then by
    hash), the first after the last.  Places are range-partitioned and stored, so
    that each window sees one range; ranges meet over one row per range."""
    spark = docs.sparkSession
    places = docs.select("doc_id", _key().alias("key"), F.xxhash64(text_or_empty()).alias("hash"), F.char_length(text_or_empty()).cast("long").alias("n_chars"))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash").asc()]
    # Equal places are in one range; the first of them stands for all.
    ranged = stored(places.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "fingerprint-ranges")
    places = ranged.groupBy("part", "doc_id", "key", "hash").agg(F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("rows"))
    head = F.struct("key", "hash").alias("head")
    first = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ends = ranged.select("part", head, first.alias("n")).filter("n = 1")
    after = F.coalesce(F.lead("head").over(Window.orderBy("part")), F.first("head").over(Window.orderBy("part")))
    ends = ends.select(F.col("part").alias("e_part"), after.alias("after"))
    inside = F.lead(F.struct("key", "hash")).over(Window.partitionBy("part").orderBy(*order))
    following = F.coalesce("inside", "after")
    joined = places.withColumn("inside", inside).join(ends, F.col("part") == F.col("e_part"))
    return joined.select("key", "hash", "n_chars", "rows", following["key"].alias("next_key"), following["hash"].alias("next_hash"))


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("~"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last third
    replaced by the start of the next document), with their likeness."""
    order = stored(next_places(docs), "fingerprint-order")
    texts = docs.select(text_or_empty().alias("text"), _key().alias("key")).withColumn("hash", F.xxhash64("text"))
    # A place that more than 1 / HOT_KEYS of all rows share is one row from here to the end: its
    # text comes from each task once.  There are at most HOT_KEYS such places.
    total = order.agg(F.sum("rows")).first()[0] or 0
    shared = order.filter((F.col("rows") > 1) & (F.col("rows") * HOT_KEYS > total)).select("key", "hash", F.col("rows").alias("times"))
    several = not shared.isEmpty()
    if several:
        once = texts.join(F.broadcast(shared), ["key", "hash"], "left_semi").groupBy("key", "hash").agg(F.first("text").alias("text"))
        texts = texts.join(F.broadcast(shared), ["key", "hash"], "left_anti").select("text", "key", "hash").unionByName(once)
    # Both joins below read these three columns only, and so share one shuffle.
    # The start of the next text, as long as the last third of this one.
    cut = F.floor(F.col("n_chars") / 3).cast("int").alias("cut")
    wanted = order.select(F.col("next_key").alias("key"), F.col("next_hash").alias("hash"), F.col("key").alias("for_key"), F.col("hash").alias("for_hash"), cut)
    starts = texts.join(wanted, ["key", "hash"]).select(F.col("for_key").alias("key"), F.col("for_hash").alias("hash"), F.col("key").alias("n_key"), F.col("hash").alias("n_hash"), "cut", F.expr("substring(text, 1, cut)").alias("start"))
    # Places that rows share have one start.
    starts = starts.groupBy("key", "hash").agg(F.first(F.struct("n_key", "n_hash", "cut", "start")).alias("s")).select("key", "hash", "s.*")
    both = texts.join(starts, ["key", "hash"]).withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - cut), start)"))
    signed = add_signature(add_signature(both, "text", "sig"), "edited", "edited_sig")
    edited = F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("edited_sha256")
    signed = signed.select("key", "hash", "n_key", "n_hash", "n_chars", edited, "sig", likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), "edited_sig")
    signed = stored(signed, "fingerprint-rows")
    following = signed.groupBy(F.col("key").alias("n_key"), F.col("hash").alias("n_hash")).agg(F.first("sig").alias("f_sig"))
    doc_id = F.when(F.col("key") != "~", F.col("key").cast(dict(docs.dtypes)["doc_id"]))
    found = signed.join(following, ["n_key", "n_hash"])
    if several:
        found = found.join(F.broadcast(shared), ["key", "hash"], "left").withColumn("time", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)).cast("int"))))
    return found.select(
        doc_id.alias("doc_id"), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), as_string(F.col("sig")).alias("fingerprint"), as_string(F.col("edited_sig")).alias("edited_fingerprint"),
        "near_edited", likeness(F.col("sig"), F.col("f_sig")).alias("near_next"),
    )
