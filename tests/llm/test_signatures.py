"""Order MinHash in plain Python, and pages that only a host's other pages tell apart."""

import random
import re
import struct

from xxhash import xxh64_intdigest

from rastertables.llm import fingerprints as P
from rastertables.llm import html_text as H


def signed(x, bits=64):
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> (bits - 1) else x


def xxh(*values, form="<q"):
    """Spark's xxhash64: the hash of each value is the next one's seed; nulls are skipped."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxh64_intdigest(v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else struct.pack(form, v), seed)
    return signed(seed)


def murmur(values):
    """Spark's hash of an array of longs."""
    turn = lambda x, r: ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF
    h = 42
    for v in values:
        for part in (v & 0xFFFFFFFF, v >> 32 & 0xFFFFFFFF):
            h ^= turn(part * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
            h = (turn(h, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
        h ^= 8
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ h >> shift) * by & 0xFFFFFFFF
        h ^= h >> 16
    return signed(h, 32)


def signature(text, k=P.K, l=P.L, m=P.M):  # noqa: E741
    """Minimal numbered k-mers of each slot, their order in the text kept, hashed as tuples."""
    tokens = [xxh(t) for t in re.findall(P.TOKENS, text or "")]
    kmers = [xxh(*tokens[i : i + k]) >> P.POS for i in range(max(1, len(tokens) - k + 1) if tokens else 0)]
    seen, slots = {}, [[] for _ in range(m)]
    for at, kmer in enumerate(kmers):
        number = xxh(struct.pack("<q", kmer), struct.pack("<i", seen.get(kmer, 0)))
        seen[kmer] = seen.get(kmer, 0) + 1
        slots[number % m].append(((number & (1 << 64) - 1) >> 64 - P.HASH, at))
    least = [sorted(s)[:l] for s in slots]
    flat = [x for s in least for x in s]
    tuples, first = [None] * m, 0
    for slot, own in enumerate(least):
        if own:
            chosen = [flat[(first + j) % len(flat)] for j in range(min(l, len(flat)))]
            tuples[slot] = murmur([body for _, body in sorted((at, body) for body, at in chosen)])
            first += len(own)
    full = [s for s in range(m) if tuples[s] is not None]
    return [tuples[next((t for t in full if t >= s), full[0])] for s in range(m)] if full else []


def test_signatures_against_plain_python(spark):
    rng = random.Random(9)
    texts = [None, "", " \n", "one", "one two", "a " * 500, "x" * 1000, "中文 \U0001f600\U0001f600 café"]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(n)) for n in (3, 10, 40, 200, 3000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.sig for r in P.add_signature(df, "text", "sig").select("doc_id", "sig").collect()}
    assert all(got[i] == signature(t) for i, t in enumerate(texts))
    near = {r.doc_id: r for r in P.fingerprints(df).collect()}
    for i in range(len(texts)):
        a, b = signature(texts[i]), signature(texts[i - 1])  # the next in descending order
        same = sum(x == y for x, y in zip(a, b, strict=False)) / P.M if a and b else float(not a and not b)
        assert abs(near[i].near_next - same) < 1e-12 and near[i].fingerprint == "".join(f"{x & 0xFFFFFFFF:08X}" for x in a)
    order = P.add_signature(spark.createDataFrame([(1, " ".join(map(str, range(300))))], "doc_id long, text string"), "text", "s", 3, 4, 16).first().s
    assert order == signature(" ".join(map(str, range(300))), 3, 4, 16)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def family(rng, kind, fixed, i):
    """A page of divs without names, and its content.  By itself it does not tell which is which."""
    article = [words(rng, rng.randrange(20, 40)) for _ in range(3)]
    body = "".join(f"<p>{p}</p>" for p in article)
    if kind == "notice":  # a fixed notice that is longer than the article
        page = f"<div><p>{fixed[0]}</p><p>{fixed[1]}</p></div><div>{body}</div>"
    elif kind == "inside":  # fixed texts between those of the article
        page = f"<div><p>{article[0]}</p><p>{fixed[2]}</p><p>{article[1]}</p><p>{fixed[3]}</p><p>{article[2]}</p></div>"
    else:  # records that outweigh the article on one page in four
        record = lambda n: f"<section><p>{words(rng, n)}</p><p>{words(rng, n)}</p></section>"
        page = f"<div>{body}</div><div>{record(60) if i % 4 == 0 else ''.join(record(4) for _ in range(6))}</div>"
    return f"<html><body>{page}</body></html>", "\n\n".join(article)


def test_only_the_hosts_other_pages_tell(spark):
    """The same pages, on a host together and each on a host of its own: aligned pages give the
    content, and the rule for single pages does not."""
    rng = random.Random(12)
    rows, want = [], {}
    for kind in ("notice", "inside", "records"):
        fixed = [words(rng, n) for n in (150, 120, 12, 9)]
        for i in range(40):
            source, want[len(rows)] = family(rng, kind, fixed, i)
            rows.append((len(rows), kind, source))
    kinds = {i: k for i, k, _ in rows}
    found = {}
    for alone in (False, True):
        pages = spark.createDataFrame([(i, f"http://{kind}{i if alone else ''}.example/x", source) for i, kind, source in rows], "page_id long, url string, html string")
        got = {r.page_id: r.text for r in H.extract(pages).collect()}
        found[alone] = {k: sum(got[i] == want[i] for i in want if kinds[i] == k) for k in set(kinds.values())}
    assert found[False] == {"notice": 40, "inside": 40, "records": 40}, found
    assert found[True]["notice"] == 0 and found[True]["inside"] == 0 and found[True]["records"] <= 30, found
