"""Each operator against a brute-force version, on rows that hold every odd case."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter
from html import unescape

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import decontam, exact, html, lm, near, packing, quality, suffix, tokens, warc

WORDS = "the of and alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


def documents(spark, empty=False):
    """Nulls, blanks, copies, near copies, a long text, repeated rows, a null id, clashing column names."""
    base = prose(1, 120)
    w = base.split()
    rows = [
        (1, base), (2, base), (3, base.replace(" ", "  \n", 3)), (4, " ".join(w[:60] + ["changed"] + w[61:])), (5, prose(2, 80) + " " + base),
        (6, ""), (7, None), (8, "  \t\n "), (9, "one"), (10, "One"), (11, "two words"), (12, prose(3, 5000)), (13, prose(4, 90)),
        (14, prose(4, 90).upper()), (15, "aaaa" * 80), (16, "été à la plage " * 20), (17, prose(5, 40)), (17, prose(5, 40)), (None, prose(6, 30)), (18, "x" * 99),
    ]
    rows = [] if empty else [(i, t, "a", 1, b"z", 0.5) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, target string, n long, kept binary, score double")


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_empty_tables(spark):
    docs = documents(spark, True)
    none = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = public_tokenizers.path("word_bpe_49k.json")
    frames = [
        decontam.contaminated(docs, none), quality.classified(docs, labels), suffix.without_repeats(docs), html.extracted(pages), exact.exact_dedup(docs), exact.deduplicated(docs),
        tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")), warc.archived(pages), lm.scored(docs, labels, path, 49_408), near.near_duplicates(docs), packing.pack(docs, path),
    ]
    for df in frames:
        assert df.collect() == []


def test_exact(spark):
    docs = documents(spark)
    got = exact.exact_dedup(docs, history_share=0.3).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    assert len(got) == len(rows)
    for r in got:
        texts = {t for i, t in rows if i == r.doc_id}
        text = next(t for t in texts if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [i for i, t in rows if t == text]
        least = min((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (least, len(ids), r.doc_id == least)
    kept = exact.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({t for _, t in rows})


@pytest.mark.parametrize("share", [0.01, 0.5, 0.99])
def test_exact_with_negative_ids(spark, share):
    texts = {-5: "a", 4: "a", -1: "b", 0: "b", 7: "c", -9: "c", -2**63: "d", None: "a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    least = {t: min(i for i, x in texts.items() if x == t and i is not None) for t in texts.values()}
    got = exact.exact_dedup(docs, history_share=share).collect()
    assert {r.doc_id: (r.keep_id, r.kept, r.group_size) for r in got} == {i: (least[t], i == least[t], list(texts.values()).count(t)) for i, t in texts.items()}
    assert collected(exact.deduplicated(docs), "doc_id") == sorted(((i,) for i in least.values()), key=str)


def test_perfect_hash_has_distinct_slots():
    lanes = np.random.default_rng(1).integers(0, 2**63, (5000, 4), dtype=np.uint64)
    seeds = exact.perfect_seeds(lanes)
    slots = exact._slots(lanes, seeds[exact._buckets(lanes, len(lanes))], len(lanes))
    assert sorted(slots.tolist()) == list(range(len(lanes)))


def jaccard_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    part = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and part[a] > part[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                    part[a], changed = part[b], True
    return sets, part


@pytest.mark.parametrize("k", [2, 5])
def test_near(spark, k):
    docs = documents(spark)
    base = prose(50, 60).split()
    copies = []
    for i in range(60):
        r = random.Random(i)
        w = list(base)
        for _ in range(r.randrange(8)):
            w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
        copies.append((100 + i, " ".join(w)))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(copies, "doc_id long, text string"))
    sets, part = jaccard_components([(r.doc_id, r.text) for r in both.collect() if r.doc_id is not None], k, 80)
    got = near.near_duplicates(both, k=k).collect()
    assert len(got) == both.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), part[r.doc_id], part[r.doc_id] == r.doc_id), r
    kept = near.representatives(docs, k=k)
    assert kept.columns == docs.columns


@pytest.mark.parametrize("split", [4096, 2])
def test_near_blocks_compare_all(spark, monkeypatch, split):
    monkeypatch.setattr(near, "BLOCK", 3)
    monkeypatch.setattr(near, "SPLIT", split)
    monkeypatch.setattr(near, "BROADCAST_IDS", split)
    rows = [(i, " ".join(f"w{(i // 4) * 7 + j}" for j in range(30))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, part = jaccard_components(rows, 2, 80)
    assert {r.doc_id: r.component_id for r in near.near_duplicates(docs, k=2, bands=60, rows=1).collect()} == part


def test_decontamination(spark):
    docs = documents(spark)
    item = prose(70, 40)
    w = item.split()
    leaks = [(201, prose(71, 50) + " " + item + " " + prose(72, 50)), (202, item.upper()), (203, prose(73, 60) + " " + " ".join(w[:20])), (204, prose(74, 10) + ", " + item.replace(" ", ", ") + "!"), (205, " ".join(w[:39] + ["other"]))]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(leaks, "doc_id long, text string"))
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (4, prose(4, 90), 0), (5, "two words", 0), (1, item, 0)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(both, bench).collect()}
    assert {p for p in got if p[1] == 1} == {(201, 1), (202, 1), (204, 1), (205, 1)}
    assert got[201, 1] == 1.0 and got[205, 1] == pytest.approx(35 / 37)
    assert {(13, 4), (14, 4), (11, 5)} <= set(got)
    kept = decontam.decontaminated(docs, bench)
    assert kept.columns == docs.columns and {13, 14, 11}.isdisjoint(r.doc_id for r in kept.collect())


def test_decontamination_against_all_windows(spark):
    def bag(w, k):
        return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    r, items, docs = random.Random(9), [], []
    for n, size in enumerate((3, 12, 40, 40, 60, 100)):
        w = prose(500 + n, size).split() if n != 3 else ["so", "so", "so", "it", "is"] * 8
        items.append((n, w))
        half, quarter = size // 2, size // 4
        kinds = [w, w[half:] + w[:half], w[quarter:] + w[:quarter], w[:half] + ["new"] + w[half:], w[:half] + w[half + 1 :], w[1:] + w[:1], w[: size - size // 8], w[size // 8 :], w * 2]
        kinds += [[x if r.random() > 0.02 else "edit" for x in w] for _ in range(3)]
        for x in kinds:
            pre, post = prose(r.randrange(10**6), 30).split(), prose(r.randrange(10**6), 30).split()
            docs += [pre + x + post, x, pre + x, x + post]
    want = {}
    for i, d in enumerate(docs):
        for j, w in items:
            k = min(5, len(w))
            for at in range(max(len(d) - k + 1, 0)):
                a, b = bag(d[at : at + len(w)], k), bag(w, k)
                s = (a & b).total() / (a | b).total()
                if s >= 0.8:
                    best, first, n = want.get((i, j), (0, 0, 0))
                    want[i, j] = (s, at, n + 1) if s > best else (best, first, n + 1)
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = decontam.contaminated(df, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): (round(x.similarity, 9), x.first_word, x.n_windows) for x in got} == {p: (round(s, 9), at, n) for p, (s, at, n) in want.items()}


def test_decontamination_blocks_meet_within_radius(spark):
    r = random.Random(5)
    rows = [(x := r.getrandbits(64), x ^ sum(1 << b for b in r.sample(range(64), 20))) for _ in range(50)]
    rows = [tuple(v - 2**64 if v >= 2**63 else v for v in p) for p in rows]
    df = spark.createDataFrame(rows, "a long, b long")
    F = decontam.F
    both = df.select(F.arrays_overlap(decontam.blocks(F.col("a"), 20), decontam.blocks(F.col("b"), 20)).alias("met"))
    assert all(x.met for x in both.collect())


def test_quality_learns_without_negatives(spark):
    good = [(i, prose(i, 60 + i % 40)) for i in range(600)]
    junk = [(600 + i, " ".join(f"{w}$$$ !!" for w in prose(i, 50).split())) for i in range(150)]
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in good + junk] + [(900, None, 1.0), (901, "", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i < 600), 0) for i in range(0, 750, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classified(docs, labels).collect()}
    assert len(got) == 752 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(i, r) for i, r in got.items() if r.held_out and i < 750]
    assert np.mean([r.predicted == int(i < 600) for i, r in held]) > 0.95
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns


def test_prior_is_estimated():
    rng = np.random.default_rng(2)
    positive = rng.normal(2, 1, 5000)
    unlabelled = np.concatenate([rng.normal(2, 1, 3500), rng.normal(-3, 1, 1500)])
    assert quality.estimated_prior(positive, unlabelled) == pytest.approx(0.7, abs=0.05)


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for j in range(len(b) - length + 1):
            s = b[j : j + length]
            if s in seen:
                m[j : j + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, f in zip(b, m, strict=True) if not f)
        out[i] = (len(b), sum(m), sum(1 for j in range(len(m)) if m[j] and not (j and m[j - 1])), kept)
    return out


def test_suffix(spark):
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    want = brute_repeats(sorted((r.doc_id, r.text) for r in docs.collect()))
    for r in suffix.without_repeats(docs, targets=5).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id][3]).hexdigest()
    assert suffix.without_repeats(documents(spark)).count() == documents(spark).count()


@pytest.mark.parametrize("hot_runs", [1, 10**9])
def test_suffix_of_a_passage_in_many_documents(spark, hot_runs, monkeypatch):
    passage, again = prose(8, 60), prose(9, 25)
    texts = [prose(100 + i, 8) + passage[i % 3 :] + " " + prose(200 + i, 8) + (again + prose(300 + i, 5) if i % 4 == 0 else "") for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_repeats(list(enumerate(texts)))
    for r in suffix.without_repeats(docs, targets=7, hot_runs=hot_runs, sample=1).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]


def test_hot_anchors_have_bounded_groups():
    texts = [(prose(100 + i, 8) + prose(8, 60) + prose(200 + i, 8)).encode() for i in range(300)]
    plain = suffix.Hasher(100, 40).runs(texts)
    most = lambda got: np.unique(np.unique(got[["anchor", "run"]])["anchor"], return_counts=True)[1].max()
    anchors, n = np.unique(np.unique(plain[["anchor", "run"]])["anchor"], return_counts=True)
    cut = suffix.Hasher(100, 40, anchors[n > 100]).runs(texts)
    # All windows are there, each once; the runs at the passage's edges no longer meet in one group.
    starts = lambda got: sorted((r["doc"], r["lo"] + i) for r in got for i in range(int(r["extra"]) + 1))
    assert starts(cut) == starts(plain)
    assert most(plain) > 250 and most(cut) < 100


def test_long_texts_are_cut_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix, "PIECE_BYTES", 150)
    monkeypatch.setattr(suffix, "BATCH_BYTES", 400)
    texts = [prose(1, 100).encode(), b"x" * 99, prose(2, 30).encode(), b"", b"y" * 100]
    got = [(i, lo, t) for where, out in suffix._pieces(texts, 100) for (i, lo), t in zip(where, out, strict=True)]
    windows = [(i, lo + k) for i, lo, t in got for k in range(len(t) - 99)]
    assert sorted(windows) == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 99)]
    assert all(texts[i][lo : lo + len(t)] == t for i, lo, t in got)


def test_merged_transforms_order_all_suffixes():
    rng = np.random.default_rng(4)
    shards = [rng.integers(97, 100, n).astype(np.uint8) for n in (300, 41, 500)]
    orders = [suffix.suffix_array(s, 20) for s in shards]
    shard, block = suffix.merged([suffix.transform(s, o) for s, o in zip(shards, orders, strict=True)], 20)
    at = [0, 0, 0]
    rows = []
    for k in shard:
        s, p = shards[k], orders[k][at[k]]
        at[k] += 1
        rows.append(bytes(np.resize(np.roll(s, -p), 20)))
    assert rows == sorted(rows)
    assert [a == b for a, b in zip(block, block[1:], strict=False)] == [a == b for a, b in zip(rows, rows[1:], strict=False)]


def test_html(spark):
    body = "<nav><a href=x>menu item</a></nav><div class='ad'>buy now</div><article><h1>Head &amp; line</h1><p>First <b>bold</b> text&nbsp;here,<br>and more of it.<p>Second  paragraph\n with words.</p><div class='comments'>nice post</div><aside>see also</aside></article><footer>&copy; us</footer>"
    pages = [(1, "http://a.example/x", f"<html><head><title>t</title><script>var a='<p>';</script></head><body>{body}</body></html>"), (2, "http://a.example/y", body), (3, None, None), (4, "http://b.example/", ""), (5, "x", "plain text only"), (None, "http://a.example/z", "<p>unclosed <b>para"), (1, "http://a.example/x", body)]
    df = spark.createDataFrame([(*p, "host", "path") for p in pages], "page_id long, url string, html string, host string, path string")
    got = html.extracted(df).collect()
    assert len(got) == len(pages)
    text = "Head & line First bold text here, and more of it. Second paragraph with words."
    assert {r.text for r in got if r.page_id in (1, 2)} == {text}
    assert all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[3] == ""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p title=\"it's>quoted text</p><p>second</p></article>", "quoted text second"),
        ("<article><p data-x=\"a>b\">one</p><p alt='c>d'>two</p></article>", "one two"),
        ("<article>AT&am<b>p;T</b> and AT&amp;T&nbsp;x &lt;b&gt;</article>", "AT&amp;T and AT&T x <b>"),
        ("<article><h1>T</h1><div class='related-work'><p>Earlier work.</p></div><section class='search methods'><p>We searched.</p></section><div class='ad-slot'>buy</div><section id=comments><p>nice post</p></section><div class=related><ul><li><a href=1>Other</a></li></ul></div></article>", "T Earlier work. We searched."),
        ("<nav>menu</nav><article><h1>Title</h1><p class=lead>The lead.</p><div class='article-body'>" + "<p>many words here.</p>" * 40 + "</div></article>", "Title The lead. " + " ".join(["many words here."] * 40)),
        ("<p>hello <i>w</i>orld", "hello world"),
        ("only text &amp; more", "only text & more"),
        ("<body><form><h1>Page</h1><div class=content><p>All of it in a form.</p><input value=3><button>Go</button></div></form><form>Name <input></form>", "Page All of it in a form."),
        ("<head><title>x</title><p>body is implied", "body is implied"),
        ("<body><p>super<wbr>cali <x-y>cus</x-y>tom<br>next</p><table><tr><td>a<td>b</table>", "supercali custom next a b"),
        ("<p>before</p><b unclosed at the end", "before"),
        ("<!-- <p>no</p> --><p>a < b and 1 <2</p><!-- open", "a < b and 1 <2"),
        ("<div class=banner><h1>Site</h1></div><article><div class='banner'><h1>Title</h1></div><p>Main text of it.</p><div class='banner'>Buy</div></article>", "Title Main text of it."),
        ("<article><h1>T</h1><div class='section-header'><h2>Methods</h2></div><p>The <label>name</label> counts.</p><div class='header-links'><a href=1>one</a></div></article>", "T Methods The name counts."),
    ],
)
def test_html_of_odd_pages(page, text):
    assert html.extract(page, None) == text
    # A host path without text on the page leaves it to the page's own.
    assert html.extract(page, "html>body>div.elsewhere") == text


def test_html_takes_time_in_proportion():
    for page in ("<a b " * 200_000, '<a b="' * 150_000, "<" * 500_000, "<div>" * 50_000 + "x" + "</q>" * 50_000, "<p>" + "<a href=1>x" * 50_000):
        began = time.process_time()
        html.extract(page, None)
        assert time.process_time() - began < 20


def test_html_against_the_article_of_each_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html.extracted(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        plain = re.sub(r"<[^>]+>", "", re.sub(r"<(?:/?p|br|/?h1)>", " ", inner))
        assert got[r.page_id] == " ".join(unescape(plain).split())


def test_host_path_wins_over_the_page():
    long_notice = "<div class='box'>" + "words of a long notice " * 30 + "</div>"
    page = f"<body>{long_notice}<div class='post-12'><p>short main text</p></div></body>"
    assert html.extract(page, "body>div.post-#") == "short main text"


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    first, inner = tokens.read_ranks(path)

    def greedy(word):
        n = at = 0
        while at < len(word):
            pieces = inner if at else first
            end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
            if end is None:
                return 1
            n, at = n + 1, end
        return n

    docs = documents(spark)
    want = sorted(((r.doc_id, len(w), sum(map(greedy, w))) for r in docs.collect() for w in [(r.text or "").encode().split()]), key=str)
    assert collected(tokens.token_counts(docs, path), "doc_id", "n_words", "n_tokens") == want


def test_token_counts_of_any_script(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}

    def greedy(word):
        n, at, word = 0, 0, b" " + word
        while at < len(word):
            at, n = next(e for e in range(len(word), at, -1) if word[at:e] in pieces), n + 1
        return n

    words = ["собака", "человек", "страна", "россия", "прекрасный", "한국어", "힣", "😀", "👩‍👩‍👧", "日本語" * 50, "с" * 300, "été", "plain", "a.b"]
    words += [chr(c) + x for c in (*range(0xA1, 0x600), *range(0xAC00, 0xD7A4, 61), *range(0x1F300, 0x1F700, 7)) for x in ("", "x")]
    words = [w for w in words if len(w.encode().split()) == 1]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, path).collect()} == {i: greedy(w.encode()) for i, w in enumerate(words)}
    assert greedy("собака".encode()) > 1


def test_token_automaton_small_vocabulary():
    first, inner = {b"a", b"abcdx", b"ab"}, {b"b", b"c", b"cd", b"cdy", b"dz", b"z"}
    c = tokens.Counter(tokens.build(first, inner))
    # ab, ab|c, ab|cd, abcdx, ab|cd|z, ab|cdy; no piece for q; ab|cd|z|b
    assert [c[w] for w in (b"ab", b"abc", b"abcd", b"abcdx", b"abcdz", b"abcdy", b"q", b"aq", b"abcdzb")] == [1, 2, 2, 1, 3, 2, 1, 1, 4]


def test_warc(spark):
    big = "<p>" + "same page " * 200
    pages = [(1, "http://www.a.example/x?q=1", big), (2, "http://b.example/", big), (3, None, None), (4, "", ""), (5, "http://www.a.example/x?q=1", "small"), (6, "http://c.example/ü b", "small"), (7, "http://c.example:8080/", big + "é"), (7, "http://c.example:8080/", big + "é"), (None, "http://n.example", "null id")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, offset int")
    got = warc.archived(df).collect()
    assert len(got) == len(pages)
    by = {i: h for i, _, h in pages}
    for r in got:
        raw = (by[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 2) if r.page_id == 1 else ("response", None))
    assert warc.url_key("http://www.a.example/x?q=1") == "example,a,www)/x?q=1"


def test_lm_by_the_counts_of_all_other_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_DOCS", 3)
    monkeypatch.setattr(lm, "STEP_TOKENS", 150)
    path, vocabulary = public_tokenizers.path("word_bpe_49k.json"), 49_408
    docs, good, words = documents(spark), (1, 13), packing.words_of(path)
    rows = [(r.doc_id, [-1, *map(int, words.ids(r.text))]) for r in docs.collect()]
    pairs = lambda x: list(zip(x, x[1:], strict=False))
    want = []
    for at, (i, x) in enumerate(rows):
        means = []
        for kind in (1, 0):
            counts = Counter(p for j, (k, y) in enumerate(rows) if j != at and (not kind or k in good) for p in pairs(y))
            contexts, unigrams = Counter(), Counter()
            for (a, b), n in counts.items():
                contexts[a] += n
                unigrams[b] += n
            n = unigrams.total()

            def chance(a, b):
                one = unigrams[b] / n
                return 0.45 * one + 0.05 / vocabulary + 0.5 * (counts[a, b] / contexts[a] if contexts[a] else one)

            if at == 0:
                # It is a probability in every context, a frequent one, a rare one and an unseen one.
                for a in (-1, *(c for c, _ in contexts.most_common(2)), 12_345):
                    assert abs(sum(chance(a, b) for b in unigrams) + 0.05 * (vocabulary - len(unigrams)) / vocabulary - 1) < 1e-9
            means.append(float(np.mean([-np.log(chance(*p)) for p in pairs(x)])) if len(x) > 1 else 0.0)
        want.append((str(i), len(x) - 1, *means))
    trusted = spark.createDataFrame([(1,), (13,), (13,), (None,), (999,)], "doc_id long")
    for size in (lm.BUCKET_BYTES, 64):
        monkeypatch.setattr(lm, "BUCKET_BYTES", size)
        got = sorted((str(r.doc_id), r.n_tokens, r.target_loss, r.background_loss) for r in lm.scored(docs, trusted, path, vocabulary).collect())
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
        assert np.allclose([g[2:] for g in got], [w[2:] for w in sorted(want)], atol=1e-9)
    # Without a trusted text the target is uniform.
    none = lm.scored(docs, trusted.where("doc_id = 0"), path, vocabulary).where("n_tokens > 0").select("target_loss").collect()
    assert all(abs(r.target_loss - np.log(vocabulary)) < 1e-9 for r in none)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = [(301, "It's Ångström's ÉTÉ—naïve 12,5% <|endoftext|> x y z \x1c q"), (302, "İstanbul ΣΑΣ ß 𝔘𝔫𝔦 é é 日本語テキスト"), (303, "don't we'll I'm 'S 'RE ((a)) a*b $x ## |")]
    docs = documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    pieces = packing.pack(docs, path, sequence=64).collect()
    ids = [(r.doc_id, [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect()]
    want = sorted((str(i), t) for i, own in ids for t in own)
    got = sorted((str(p.doc_id), int(t)) for p in pieces for t in np.frombuffer(p.ids, "<u4"))
    assert got == want
    whole = {i: np.array(own, "<u4") for i, own in ids}
    for p in pieces:
        assert zlib.crc32(whole[p.doc_id][p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(whole[p.doc_id])
    by = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == by.get(p.sequence_id, 0)
        by[p.sequence_id] = p.offset + p.length
    assert all(n == 64 for s, n in by.items() if s != max(by)) and sum(by.values()) == sum(len(o) for _, o in ids)


def test_hilbert_key_walks_neighbours():
    side = 1 << 3
    grid = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = packing.hilbert_key(grid, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_word_table_equals_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, words, r = Tokenizer.from_file(path), packing.Words(path), random.Random(7)
    pieces = [*"abcXYZéÉÀßÿ×÷ñØ0129.,;\"'- \t\n\r\x0b\x0c\x1c\x85\xa0\xaa\xb5\xb2", "'s", "'S", "'ll", "'re", "don't", "<|endoftext|>", "<|ENDOFTEXT|>", "́", "İ", "漢字", "кот", "🙂"]
    texts = ["", *("".join(r.choice(pieces[: 40 if i % 2 else None]) for _ in range(r.randrange(50))) for i in range(4000))]
    assert [words.ids(t).tolist() for t in texts] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_memo_drops_its_older_half(monkeypatch):
    monkeypatch.setattr(packing, "_PARTS_KEPT", 8)
    words = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    names = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    once = [words.ids(n).tolist() for n in names]
    assert len(words.parts) <= 8 and b"wordz" in words.parts
    assert [words.ids(n).tolist() for n in names] == once
