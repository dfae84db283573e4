"""Competing host paths, recall of fingerprints within the radius, and very long pages through Spark."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import decontam, html, warc


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(["river", "stone", "harbour", "letter", "winter", "garden", "silver", "market"]) for _ in range(n)) + "."


def page(first: str, second: str) -> str:
    return f"<html><body><div class='zone-a'><p>{first}</p></div><div class='zone-b'><p>{second}</p></div></body></html>"


def test_a_host_votes_between_two_paths(spark):
    long, short = [sentence(i, 120) for i in range(7)], [sentence(50 + i, 15) for i in range(7)]
    # Of five pages of a host three hold most text in zone-a and two in zone-b; the other host's page has zone-b alone on top.
    rows = [(i, f"https://one.example/{i}", page(long[i], short[i]) if i < 3 else page(short[i], long[i])) for i in range(5)]
    rows.append((5, "https://two.example/5", page(short[5], long[5])))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    # Alone, each page would take its own larger zone.
    assert [html.extract(h, None) for _, _, h in rows] == long[:6]
    paths = {r.host: (r.path.split(">")[-1], r.votes) for r in html.host_paths(df).collect()}
    assert paths == {"one.example": ("div.zone-a", 3), "two.example": ("div.zone-b", 1)}
    got = {r.page_id: r.text for r in html.extracted(df).collect()}
    assert got == {i: (short[i] if i in (3, 4) else long[i]) for i in range(6)}


def test_of_equal_votes_the_larger_text_wins(spark):
    rows = [(0, "https://one.example/0", page(sentence(1, 100), sentence(2, 10))), (1, "https://one.example/1", page(sentence(3, 10), sentence(4, 200)))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    (best,) = html.host_paths(df).collect()
    assert (best.path.split(">")[-1], best.votes) == ("div.zone-b", 1)


def distances(size: int, percent: int, trials: int, rng) -> np.ndarray:
    """Hamming distances of fingerprints of two sets of ``size`` random hashes that just reach ``percent``."""
    common = -(-2 * percent * size // (100 + percent))
    # Of n random hashes a bit is set in a binomial number.
    excess = lambda n: 2 * rng.binomial(n, 0.5, (trials, 64)) - n
    both = excess(common)
    return (((both + excess(size - common)) > 0) != ((both + excess(size - common)) > 0)).sum(axis=1)


@pytest.mark.parametrize("size", [10, 20, 46, 100, 200])
def test_windows_that_just_reach_the_similarity_are_within_the_radius(size):
    found = (distances(size, decontam.PERCENT, 50_000, np.random.default_rng(size)) <= decontam.RADIUS).mean()
    assert found >= 0.9995


def test_fingerprint_is_the_majority_of_each_bit(spark):
    r = random.Random(8)
    lists = [[r.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 2, 7, 40)] + [[-1, 1, 1], [], [5] * 3]
    got = [x.p % 2**64 for x in spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i long, h array<long>").select("i", decontam.simhash(decontam.F.col("h")).alias("p")).orderBy("i").collect()]
    assert got == [sum(1 << b for b in range(64) if sum(1 if v >> b & 1 else -1 for v in x) > 0) for x in lists]


def test_very_long_pages_through_spark(spark):
    body = sentence(9, 20) + " "
    whole = "<html><body><nav><a href='/'>Home</a></nav><article><h1>Title</h1>" + "".join(f"<p>{i} {body}</p>" for i in range(30_000)) + "</article></body></html>"
    pages = spark.createDataFrame([(1, "https://one.example/1", whole), (2, "https://one.example/2", whole), (3, None, "<p>short</p>"), (4, "", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extracted(pages).collect()}
    want = " ".join(["Title", *(f"{i} {body}".strip() for i in range(30_000))])
    assert len(whole) > 4_000_000 and got[1].text == got[2].text == want and got[1].n_chars == len(want) and got[4].text == ""
    back = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(pages).collect()}
    digest = lambda s: hashlib.sha1(s.encode()).hexdigest()
    assert back == {
        1: (len(whole), digest(whole), "revisit", 2), 2: (len(whole), digest(whole), "response", None),
        3: (12, digest("<p>short</p>"), "response", None), 4: (0, digest(""), "response", None),
    }
