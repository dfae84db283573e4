"""Piecewise fingerprints against a version byte by byte, and the likeness of edited texts."""

import hashlib
import random
import statistics
import zlib

from test_llm_operators import documents, prose

from tessera.llm import piecewise as P


def plainly(text):
    """The fingerprint, one byte at a time."""
    raw = text.encode()
    hashes = []
    for i in range(len(raw)):
        h = sum((b + 1) * pow(P._FACTOR, k, 2**32) for k, b in enumerate(reversed(raw[max(0, i - P.WINDOW + 1) : i + 1]))) % 2**32
        hashes.append((h ^ h >> 15) * P._SPREAD % 2**32)
    level = 0
    while sum(h < (2**32 // P.LEAST) >> level for h in hashes) > P.PIECES:
        level += 1

    def signature(bound):
        out, chunk = "", b""
        for b, h in zip(raw, hashes, strict=True):
            chunk += bytes([b])
            if h < bound:
                out, chunk = out + P.SIGNS[zlib.crc32(chunk) >> 26], b""
        return out + (P.SIGNS[zlib.crc32(chunk) >> 26] if chunk else "")

    return f"{P.LEAST << level}:{signature((2**32 // P.LEAST) >> level)}:{signature((2**32 // P.LEAST) >> level + 1)}"


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def like(f, g):
    (m, a, b), (n, c, d) = f.split(":"), g.split(":")
    pairs = {(1, 1): (a, c), (2, 1): (a, d), (1, 2): (b, c)}
    least = min(int(m), int(n))
    x, y = pairs.get((int(m) // least, int(n) // least), ("", "?"))
    return 1 - edits(x, y) / max(len(x), len(y)) if x or y else 1.0


def expected(rows):
    """Rows in order, each against the next."""
    out = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        q = len(text) // 4
        other = text[: len(text) - q] + following[:q]
        f, g, h = plainly(text), plainly(other), plainly(following)
        out.append((doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), f, g, round(like(f, g), 9), round(like(f, h), 9)))
    return out


def test_fingerprint_byte_by_byte():
    r = random.Random(1)
    texts = ["", "a", "aaaa" * 500, "ab" * 300, "\x00" * 90, "日本語のテキスト" * 40, prose(1, 900), *("".join(chr(r.randrange(1, 0x2FFF)) for _ in range(r.randrange(400))) for _ in range(20))]
    for t in texts:
        assert P.fingerprint(t) == plainly(t)
        assert all(len(s) <= P.PIECES + 1 for s in P.fingerprint(t).split(":")[1:])


def test_near_copies(spark):
    docs = documents(spark)
    # Rows of one id come by their hash, which only Spark computes here.
    order = docs.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()
    rows = [(d.doc_id, d.text) for d in sorted(order, key=lambda d: (d.doc_id is None, d.doc_id or 0, d.h, d.text))]
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for n in (1, 7) for r in P.near_copies(docs.repartition(n)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected(rows) * 2))
    assert sorted(map(str, (tuple(r) for r in P.fingerprints(docs).collect()))) == sorted(str((i, plainly(t))) for i, t in rows)


def test_a_single_row_follows_itself(spark):
    for text in (prose(3, 50), "", None):
        docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
        (row,) = P.near_copies(docs).collect()
        assert (row.doc_id, row.n_chars, row.near_next) == (5, len(text or ""), 1.0)
    assert P.near_copies(docs.limit(0)).collect() == []


def test_likeness_tells_edits_from_others(spark):
    """A text whose last quarter is another's is like itself, one after it is not; a passage within is found as well."""
    texts = [prose(i, 40 + 37 * i % 2000) for i in range(120)]
    rows = P.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert min(r.near_edited for r in rows) > max(r.near_next for r in rows)
    assert statistics.mean(r.near_edited for r in rows) > 0.6 and statistics.mean(r.near_next for r in rows) < 0.2
    words = texts[80].split()
    moved = " ".join(words[:200] + ["inserted", "words"] + words[200:])
    assert like(P.fingerprint(texts[80]), P.fingerprint(moved)) > 0.9
