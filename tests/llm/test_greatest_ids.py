"""The greatest id beside rows without one."""

import random

from tessera.llm import suffix


def passage(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


def test_the_greatest_id_comes_back_and_before_rows_without_one(spark):
    a, b, top = passage(1, 150), passage(2, 150), 2**63 - 1
    for rows, want in (
        ([(None, "x" + a), (top, a + "y"), (7, b)], {(None, 150), (top, 0), (7, 0)}),
        ([(top, a), (5, a)], {(top, 150), (5, 0)}),
        ([(None, a), (5, a)], {(None, 150), (5, 0)}),
    ):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert {(r.doc_id, r.n_removed) for r in suffix.without_repeats(df).collect()} == want
