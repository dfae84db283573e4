"""Alignment of tokens against one of whole texts by decoded bytes alone."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from test_llm_operators import documents, prose

from tessera.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [*" \n\t\r a b,;{}()'s é日𝒳▁\u3000\u0085\x1c\x00re19", " <|endoftext|> ", "<0x41>", "</s>", "  ", "ing ", "\u0308", ";\r", " \r"]


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b, align.byte_level_bytes(a), align.piece_bytes(b)


def plainly(models, text):
    """Groups of (A ids, B ids) of a whole text, by the decoded bytes."""
    a, b, a_bytes, b_bytes = models
    if not text:
        return []
    ours, theirs, raw = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
    if b"".join(a_bytes[i] for i in ours) != raw or b"".join(b_bytes[i] for i in theirs) != raw:
        return []
    out, left, right, n, m = [], [], [], 0, 0
    ours, theirs = list(ours), list(theirs)
    while ours or theirs:
        if n <= m:
            left.append(ours.pop(0))
            n += len(a_bytes[left[-1]])
        else:
            right.append(theirs.pop(0))
            m += len(b_bytes[right[-1]])
        if n == m:
            out.append((left, right))
            left, right = [], []
    return out


def written(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def test_parts_of_odd_texts(models):
    r, parts = random.Random(7), align.Parts(A, B)
    texts = ["".join(r.choice(ODD) for _ in range(r.randrange(1, 14))) for _ in range(3000)]
    for t, (n_a, n_b, n_groups, groups, links) in zip(texts, parts.of_texts(texts), strict=True):
        want = plainly(models, t)
        assert (n_groups, groups.decode(), len(links)) == (len(want), written(want), 4 * len(want)), repr(t)
        assert (n_a, n_b) == (sum(len(x) for x, _ in want), sum(len(y) for _, y in want))


def test_spans_are_refined(models):
    """Characters of several tokens, and of several byte pieces, end where their bytes do."""
    parts = align.Parts(A, B)
    raw = " x𝒳é日".encode()
    for ids, ends, decoded in ((*parts.a_ends(raw, " x𝒳é日"), parts.a_bytes), (*parts.b_ends(raw, "x𝒳é日"), parts.b_bytes)):
        begins = [0, *ends.tolist()]
        assert [raw[i:j] for i, j in zip(begins, begins[1:], strict=False)] == [decoded[i] for i in ids]
        assert len(set(ends.tolist())) == len(ends)
    # Any two tokens of which one ends with the other can be linked; no others can.
    assert all(x.endswith(y) or y.endswith(x) for k in parts.keys[::997] for x, y in [(parts.a_bytes[k >> 32], parts.b_bytes[k & 0xFFFFFFFF])])


def test_alignment(spark, models):
    r = random.Random(3)
    odd = [(100 + i, "".join(r.choice(ODD) for _ in range(12))) for i in range(40)]
    odd += [(200, "word" * 3000), (201, prose(9, 9000)), (202, "a ▁ b"), (203, " lead"), (204, "trail  "), (205, "\x00")]
    docs = documents(spark).select("doc_id", "text", "n", "kept").unionByName(spark.createDataFrame([(i, t, 1, b"z") for i, t in odd], "doc_id long, text string, n long, kept binary"))
    rows = [(d.doc_id, d.text, plainly(models, d.text)) for d in docs.collect()]
    count = Counter((x[-1], y[-1]) for _, _, groups in rows for x, y in groups)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    want = []
    for doc_id, _, groups in rows:
        links = [(x[-1], y[-1]) for x, y in groups]
        digest = hashlib.sha256(written(groups).encode()).hexdigest() if groups else ""
        want.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), digest, written(groups)))
    got = align.align(docs, A, B)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert align.align(docs, A, B, with_groups=False).columns == got.columns[:-1]
    assert align.align(docs.limit(0), A, B).collect() == []
