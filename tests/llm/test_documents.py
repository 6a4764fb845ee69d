"""Operators on documents against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievework.llm import decontam, hmm, mixing, near_dup, quality, substring, token_fst

WORD = re.compile(r"[^\x20\x09-\x0D]+")
words = lambda t: WORD.findall(t or "")


def corpus(seed=1, n=60, vocabulary=400, least=0, most=160):
    r = random.Random(seed)
    v = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    docs = [" ".join(r.choice(v) for _ in range(r.randint(least, most))) for _ in range(n)]
    for _ in range(n // 3):  # near and exact copies, shared passages, repeats
        a, b = r.randrange(n), r.randrange(n)
        w = docs[a].split()
        kind = r.random()
        if kind < 0.3:
            docs[b] = docs[a]
        elif kind < 0.6 and w:
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(v)
            docs[b] = " ".join(w)
        elif kind < 0.8:
            docs[b] += "\n" + " ".join(w[:70])
        else:
            docs[b] = "\n".join([docs[b][:100]] * 3)
    return [(i, t, f"s{i % 4}") for i, t in enumerate(docs)]


ODD = [(None, None, None), (None, "null id", None), (7, "", "s1"), (7, " \t\n", "s1"), (7, "one", "s1"), (8, "two words", "s2"), (8, "two words", "s2"), (9, "a " * 80, "s2"), (9, "a " * 80, "s2"), (10, "\x1c ünï x", None)]


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# 4


def brute_quality(text):
    w = words(text)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(frame, clashing):
    rows = corpus() + ODD + [(50, "# a\n# a\n  \n# a", "s")]
    got = rows_of(quality.quality(frame(rows, **clashing)), "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(got, key=str) == sorted(((t, *brute_quality(t)) for _, t, _ in rows), key=str)
    kept = quality.passing(frame(rows, **clashing))
    assert kept.columns == frame(rows, **clashing).columns
    measured = quality.quality(frame(rows)).where("kept").count()
    assert kept.count() == measured
    assert quality.quality(frame([])).count() == 0 and quality.passing(frame([])).count() == 0


def test_symbols_verdict(frame):
    """The operator's own table: a symbol every third word is junk, one in twenty words is not, one in ten is the bound."""
    r = random.Random(15)
    plain = ["the" if i % 4 == 0 else "".join(r.choice("abcdefgh") for _ in range(6)) for i in range(100)]
    text = lambda every: " ".join(w + "|" * (i % every == 0) for i, w in enumerate(plain))
    rows = [(1, text(3), "s"), (2, text(20), "s"), (3, " ".join(plain), "s"), (4, text(10), "s"), (5, text(9), "s")]
    got = {i: kept for i, kept in rows_of(quality.quality(frame(rows)), "doc_id", "kept")}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: False}


def test_pipeline_rejects_symbol_junk(spark, frame):
    """A symbol every third word is junk, one in twenty words is not."""
    import corpus_pipeline

    r = random.Random(14)
    text = lambda every: " ".join(("the" if i % 4 == 0 else "".join(r.choice("abcdefgh") for _ in range(6))) + " |" * (i % every == 0) for i in range(120))
    rows = [(1, text(3), "s"), (2, text(20), "s"), (3, text(1000), "s")]
    assert [x[0] for x in rows_of(corpus_pipeline.quality_stage(spark, frame(rows), "").orderBy("doc_id"), "doc_id")] == [2, 3]


# 10


MIXED = ("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")


def water(sizes, share=1.5, most=2):
    """The sources in order, and their targets."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, stopped = share * sum(sizes.values()), set()
    while True:
        level = (budget - sum(most * sizes[s] for s in stopped)) / max(1, sum(weight[s] for s in order if s not in stopped))
        more = {s for s in order if s not in stopped and most * sizes[s] < level * weight[s]}
        if not more:
            return order, {s: min(most * sizes[s], level * weight[s]) for s in order}
        stopped |= more


def brute_mix(rows, block=None):
    """Word by word: slots walk round the sources' streams."""
    sizes, stream = collections.Counter(), collections.defaultdict(list)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order, target = water(sizes)
    key = lambda i, t: hashlib.md5(f"{'' if i is None else i}/{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
    for i, t, s in sorted(rows, key=lambda r: key(r[0], r[1])):
        stream[s] += [(key(i, t), len(stream[s]), k) for k in range(len(words(t)))]
    t = {s: min(math.floor(target[s] + 0.5), 2 * sizes[s]) for s in order}
    b = block or min(max(sum(t.values()) // mixing.MANY, 1), mixing.BLOCK_WORDS)
    few = {s: t[s] < b * mixing.FEW for s in order}
    slots = {s: 0 if not t[s] else mixing.FEW if few[s] else (t[s] + b // 2) // b for s in order}
    total, taken, rank = sum(slots.values()), collections.Counter(), collections.Counter()
    edges, upto = [], 0
    for s in order:
        edges.append((upto / total if total else 0, (upto + slots[s]) / total if total else 0, s))
        upto += slots[s]
    for i in range(total):
        u = (i + 1) * mixing.GOLDEN
        u -= math.floor(u)
        s = next(s for lo, hi, s in edges if lo <= u < hi)
        num, den = (t[s], mixing.FEW) if few[s] else (b, 1)
        for x in range(rank[s] * num // den, min((rank[s] + 1) * num // den, 2 * sizes[s])):
            taken[stream[s][x % sizes[s]][0]] += 1
        rank[s] += 1
    return {(key(i, t), s): taken[key(i, t)] for i, t, s in rows}, key


@pytest.mark.parametrize("block", [None, 7, 64])
def test_mixing_follows_the_schedule(frame, clashing, block, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", 40)
    monkeypatch.setattr(mixing, "COPIES", 3)
    rows = corpus(3, 120) + ODD + [(77, "again and again", "s0")] * 8
    first = rows_of(mixing.mix(frame(rows, **clashing), block), *MIXED)
    assert sorted(first, key=str) == sorted(rows_of(mixing.mix(frame(rows).repartition(3), block), *MIXED), key=str)
    assert len(first) == len(rows)
    taken = collections.Counter()
    for doc_id, source, _, _, _, got, slot in first:
        taken[doc_id, source] += got
        assert (slot is None) == (got == 0)
    want, key = brute_mix(rows, block)
    by_id = collections.Counter()
    for (i, t, s) in {(i, t, s) for i, t, s in rows}:
        by_id[i, s] += want[key(i, t), s]
    assert taken == by_id
    spans = mixing.mixture(frame(rows), block).collect()
    assert sum(x.words for x in spans) == sum(taken.values()) and all(x.first >= 0 for x in spans)
    # slots take about equal blocks, in the order of their source's stream
    for s in {x.source for x in spans}:
        own = sorted((x.slot, x.block) for x in spans if x.source == s)
        assert [b for _, b in own] == sorted(b for _, b in own)


def test_mixing_fills_targets(frame, monkeypatch):
    rows = corpus(3, 120) + ODD
    first = rows_of(mixing.mix(frame(rows)), *MIXED)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    order, target = water(sizes)
    taken = collections.Counter()
    for _, s, size, source_size, goal, got, _ in first:
        assert source_size == sizes[s] and 0 <= got <= 2 * size and goal == pytest.approx(target[s])
        taken[s] += got
    for s in order:
        assert abs(taken[s] - target[s]) <= 1 + 0.005 * target[s]
    assert mixing.mix(frame([])).count() == 0 and [r[5] for r in rows_of(mixing.mix(frame([(1, None)])), *MIXED)] == [0]
    # the sequence decides: without it all slots fall to one source
    monkeypatch.setattr(mixing, "GOLDEN", 0.0)
    other = collections.Counter()
    for _, s, _, _, _, got, _ in rows_of(mixing.mix(frame(rows)), *MIXED):
        other[s] += got
    assert [s for s in order if other[s]] == order[:1]


# 5


def brute_removed(texts, size=35):
    seen = collections.Counter(tuple(w[i : i + size]) for w in map(words, texts) for i in range(len(w) - size + 1))
    out = []
    for w in map(words, texts):
        gone = {i + k for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for k in range(size)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest(), [x for i, x in enumerate(w) if i not in gone]))
    return out


def test_difference_cover():
    for a in range(substring.PERIOD):
        for b in range(substring.PERIOD):
            assert any((a + k) % substring.PERIOD in substring.COVER and (b + k) % substring.PERIOD in substring.COVER for k in range(substring.PERIOD))


def test_substrings(frame, clashing):
    rows = corpus(5, 80) + ODD
    shared = " ".join(f"w{i}" for i in range(60))
    rows += [(200 + i, f"{'x ' * i}{shared[: 400 - i]} tail{i}", "s") for i in range(5)] + [(300, "b " * 36, "s"), (301, "c " * 35, "s")]
    out = substring.dedup_substrings(frame(rows, **clashing))
    assert set(clashing) <= set(out.columns)
    got = rows_of(out, "text", "n_words", "n_removed", "kept_sha256", "kept_text")
    want = {t: w for (_, t, _), w in zip(rows, brute_removed([t for _, t, _ in rows]), strict=True)}
    assert len(got) == len(rows)
    for text, n, removed, sha, kept in got:
        assert (n, removed, sha) == want[text][:3]
        assert words(kept) == want[text][3] and (removed or kept == (text or ""))
    assert substring.dedup_substrings(frame([])).count() == 0
    with pytest.raises(ValueError, match="words"):
        substring.dedup_substrings(frame([]), size=5)


def test_anchors_cross_shuffles_in_buckets():
    """A batch sends a row for each bucket, not for each anchor, and no anchor is lost in them."""
    r = random.Random(3)
    texts = [" ".join(str(r.randrange(10**9)) for _ in range(400)) for _ in range(50)]
    batch = pa.record_batch([pa.array(range(50), pa.int64()), pa.array(texts)], ["k", "text"])
    out = pa.Table.from_batches(substring._anchors(substring.SIZE, 64)(iter([batch])))
    got = list(substring._unpacked(out.sort_by("b").combine_chunks().to_batches(), substring._ANCHOR))
    length = substring.SIZE - substring.PERIOD + 1
    places = {(k, p) for k in range(50) for p in range(400 - length + 1) if p % substring.PERIOD in substring.COVER}
    assert out.num_rows == len(got) == 64
    assert {(x["k"], x["p"]) for records in got for x in records} == places and sum(map(len, got)) == len(places)


@pytest.mark.parametrize("most", [1, 1 << 40])
def test_substrings_in_any_number_of_buckets(frame, monkeypatch, most):
    monkeypatch.setattr(substring, "BUCKET", most)
    monkeypatch.setattr(substring, "LEAST_BUCKETS", 1)
    rows = corpus(6, 60) + ODD + [(100, "w " * 300, "s"), (101, "v " + "w " * 300, "s")]
    got = rows_of(substring.dedup_substrings(frame(rows), keep_text=False), "text", "n_words", "n_removed", "kept_sha256")
    want = {t: w[:3] for (_, t, _), w in zip(rows, brute_removed([t for _, t, _ in rows]), strict=True)}
    assert len(got) == len(rows) and all(tuple(x) == want[text] for text, *x in got)


def test_windows_with_equal_first_halves_stay_apart():
    h, g = np.array([5, 5, 5, 2, 5], np.uint64), np.array([1, 2, 1, 1, 3], np.uint64)
    order, start = substring._grouped(h, g)
    assert [sorted(x.tolist()) for x in np.split(order, start[1:])] == [[3], [0, 2], [1], [4]]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_weak_hashes_confuse(frame):
    """Thue-Morse words and their inverse, which collide in polynomials modulo 2**64 for every base, are different words."""
    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    assert one[:1024] != other[:1024]
    filler = " ".join(f"w{i}" for i in range(34))
    rows = [(i, f"{filler} {w}") for i, w in enumerate((one[:1024], other[:1024]))]
    assert [r[1:] for r in sorted(rows_of(substring.dedup_substrings(frame(rows)), "doc_id", "n_words", "n_removed"))] == [(35, 0)] * 2
    assert [r[1:] for r in sorted(rows_of(substring.dedup_substrings(frame([*rows, (2, rows[0][1])])), "doc_id", "n_words", "n_removed"))] == [(35, 35), (35, 0), (35, 35)]
    trained, held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 != 2][:1], [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2][:1]
    got = {r.doc_id: r for r in hmm.score(frame([(trained[0], one), (held[0], other)])).collect()}
    assert got[held[0]].n_known == 1 and got[trained[0]].n_known == 2


# 2


def weights(text):
    w = words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def brute_similarity(x, y):
    total = 0.0
    for i in x:
        if y[i]:
            total += 1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x | y)
    return total


def brute_classes(rows):
    sets, parent = [weights(t) for _, t, *_ in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[i] & sets[j] and brute_similarity(sets[i], sets[j]) >= 0.8 - 1e-12:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def test_similarity_and_estimates():
    r = random.Random(2)
    for _ in range(20):
        x = " ".join(r.choice("abcdefghij") for _ in range(r.randint(1, 60)))
        y = x + " " + " ".join(r.choice("abcdefghij") for _ in range(r.randint(1, 20)))
        exact = near_dup.similarity(near_dup.multiset(x), near_dup.multiset(y))
        assert exact == pytest.approx(brute_similarity(weights(x), weights(y)))
    a, b = near_dup.multiset(x), near_dup.multiset(y)
    row = np.concatenate([np.zeros(a[1].sum(), int), np.ones(b[1].sum(), int)])
    sig = near_dup.signatures(row, np.concatenate([np.repeat(*a), np.repeat(*b)]), 3, 4096)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04 and (sig[:2] > 0).all() and not sig[2].any()


def test_near_duplicates(frame, clashing):
    rows = corpus(7, 90, least=1) + ODD
    base = words(corpus(8, 1, least=150, most=160)[0][1])[:150]
    r = random.Random(9)
    for i in range(60):  # a group of near copies, many of them linked through others only
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(150)] = f"e{r.randrange(999)}"
        rows.append((1000 + i, " ".join(w), "s"))
    out = near_dup.near_duplicates(frame(rows, **clashing))
    want = brute_classes(rows)
    by_class = collections.defaultdict(list)
    for (doc_id, text, _), c in zip(rows, want, strict=True):
        by_class[c if words(text) else ("own", len(by_class))].append((doc_id, text))
    expected = []
    for members in by_class.values():
        least = min((m[0] for m in members if m[0] is not None), default=None)
        expected += [(*m, least if words(m[1]) else m[0], len(members)) for m in members]
    assert sorted(rows_of(out, "doc_id", "text", "class_id", "class_size"), key=str) == sorted(expected, key=str)
    kept = near_dup.keep_one(frame(rows, **clashing))
    assert kept.columns == frame(rows, **clashing).columns and kept.count() == len(by_class)
    smallest = sorted(str(min((m[0] for m in members if m[0] is not None), default=None)) for members in by_class.values())
    assert sorted(str(x[0]) for x in rows_of(kept, "doc_id")) == smallest
    assert near_dup.near_duplicates(frame([])).count() == 0 and near_dup.keep_one(frame([(None, None)])).count() == 1


def templated(n, words=120, changed=4, seed=3):
    """Texts of one template, each with own words in places: they share buckets, and few or none are similar."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"w{x}" for x in range(words)]
        for p in r.sample(range(words), changed):
            w[p] = f"u{r.randrange(10**9)}"
        rows.append((i, " ".join(w), "s"))
    return rows


@pytest.mark.parametrize("exact", [False, True])
def test_large_buckets_are_banded_anew(frame, monkeypatch, exact):
    """All levels and the comparison in parts find the classes that brute force finds."""
    rows = templated(70) + templated(20, changed=2, seed=4)
    rows = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    classes = brute_classes(rows)
    assert len(set(classes)) > 20 and len(set(classes)) < 85
    want = {r[0]: min(r2[0] for r2, c2 in zip(rows, classes, strict=True) if c2 == c) for r, c in zip(rows, classes, strict=True)}
    monkeypatch.setattr(near_dup, "CROSS", 0)
    monkeypatch.setattr(near_dup, "PART", 7)
    monkeypatch.setattr(near_dup, "LEVELS", ((32, 5), (60, 7), (90, 9)))
    stats = []
    assert dict(rows_of(near_dup.near_duplicates(frame(rows), exact=exact, stats=stats), "doc_id", "class_id")) == want
    assert [x[0] for x in stats] == [0, 1, 2] and stats[0][2] == stats[1][2] == 0 < stats[2][2]


def test_rows_compared_follow_members(frame, monkeypatch):
    monkeypatch.setattr(near_dup, "CROSS", 8)
    compared = []
    for n in (150, 600):
        stats = []
        assert near_dup.near_duplicates(frame(templated(n, changed=6)), stats=stats).where("class_size > 1").count() == 0
        compared.append(sum(x[1] + x[2] for x in stats))
        print(n, "texts, rows compared by level:", stats)
    assert compared[1] < 12 * compared[0]


def test_keep_one_of_equal_rows(frame):
    """Of rows with one doc_id and text that with the first other columns stays, in any order of rows."""
    df = frame([(1, "a b c d e f", "z"), (1, "a b c d e f", "b"), (1, "a b c d e f", None), (2, "a b c d e f", "a"), (3, "x", "q")])
    for parts in (1, 3):
        assert sorted(rows_of(near_dup.keep_one(df.repartition(parts)), "doc_id", "source")) == [(1, "b"), (3, "q")]


def test_components(spark):
    r = random.Random(4)
    chain = [(i, i + 1) for i in range(200, 260)]
    edges = chain + [(r.randrange(150), r.randrange(150)) for _ in range(90)] + [(500, i) for i in range(400, 430)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = dict(rows_of(near_dup.components(spark.createDataFrame([(a, b) for a, b in edges if a != b], "a long, b long")), "k", "c"))
    assert got == {k: root(k) for k in parent if root(k) != k}


# 3


def test_tokens(frame, clashing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path)
    r = random.Random(6)
    alphabet = ["'s", "'ll", "'", "a", "B", "é", "ß", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "1", "²", "½", "<|endoftext|>", "<|endo", "漢", "🤗", "́", "!!", "re", "ve", "\r\n", "_", "'S"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(2000)] + ["".join(r.choice("thenadigro ") for _ in range(300)) for _ in range(100)] + ["a" * k for k in range(1, 90)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in ODD]
    got = rows_of(token_fst.count_tokens(frame(rows, **clashing)), "text", "n_bytes", "n_tokens", "over_limit")
    want = [len(x.ids) for x in library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert sorted(got, key=str) == sorted(((t, len((t or "").encode()), n, n > 512) for (_, t), n in zip(rows, want, strict=True)), key=str)
    assert token_fst.count_tokens(frame([])).count() == 0
    counter = token_fst.Counter(path)
    for chunk in (1, 7, 100):
        token_fst.CHUNK, before = chunk, token_fst.CHUNK
        try:
            assert [counter(t or "") for _, t in rows] == want
        finally:
            token_fst.CHUNK = before
    # maps compose associatively, whatever the cuts; a long piece is no other case
    text = "".join(r.choice(alphabet) for _ in range(500))
    cuts = sorted(r.sample(range(500), 6))
    a, b, c, *more = [counter.machine.chunk(text[i:j]) for i, j in zip([0, *cuts], [*cuts, None], strict=True)]
    left, right = a.then(b).then(c), a.then(b.then(c))
    for state in (token_fst.START, a(token_fst.START)[0], c(token_fst.START)[0]):
        assert left(state) == right(state)
    whole = left
    for x in more:
        whole = whole.then(x)
    state, n = whole(token_fst.START)
    plain = "".join(text.split("<|endoftext|>"))
    assert token_fst.Counter.scan(counter, plain) == len(library.encode(plain, add_special_tokens=False).ids)
    assert whole(token_fst.START) == counter.machine.chunk(text)(token_fst.START)
    piece = "".join(r.choice("thenadigro") for _ in range(300_000))
    assert counter(piece) == len(library.encode(piece, add_special_tokens=False).ids)


# 9


def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_leaks(spark, frame, clashing):
    r = random.Random(11)
    items = [(i, " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("xyz") for _ in range(r.randint(1, 40)))) for i in range(25)] + [(90, None), (91, "  "), (5, "Again and again")]
    rows = corpus(12, 40) + ODD
    for i, (_, text) in enumerate(items[:25]):
        w = text.split()
        for _ in range(r.randint(0, max(1, len(w) // 4))):
            at, kind = r.randrange(len(w)), r.random()
            w[at : at + 1] = ["zz"] if kind < 0.4 else [] if kind < 0.7 and len(w) > 1 else [w[at].upper(), "ins"]
        rows.append((500 + i, " ".join(["before"] * r.randint(0, 5) + w + ["after"] * r.randint(0, 5)), "s"))
    table = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.find_leaks(frame(rows, **clashing), table, least=1)
    got = collections.Counter((t, x["item_id"], x["distance"]) for t, xs in rows_of(out, "text", "leaks") for x in xs)
    want = collections.Counter()
    for _, text, _ in rows:
        own = {}
        for item, passage in items:
            p = (passage or "").lower().split()
            d = brute_distance(p, (text or "").lower().split()) if p else 1
            if p and d <= int(0.2 * len(p)):
                own[item, passage] = d
        want.update((text, item, d) for (item, _), d in own.items())
    assert got == want and sum(want.values()) > 10
    clean = decontam.decontaminate(frame(rows, **clashing), table, least=1)
    assert clean.columns == frame(rows, **clashing).columns
    assert clean.count() == sum(not any(t == text for t, *_ in want) for _, text, _ in rows)
    before, decontam.BLOCK_BYTES = decontam.BLOCK_BYTES, 300
    try:
        many = decontam.find_leaks(frame(rows), table, least=1)
        assert collections.Counter((t, x["item_id"], x["distance"]) for t, xs in rows_of(many, "text", "leaks") for x in xs) == want
    finally:
        decontam.BLOCK_BYTES = before
    assert decontam.find_leaks(frame([]), table).count() == 0 and decontam.decontaminate(frame(rows), table.limit(0)).count() == len(rows)


def test_short_items(spark, frame):
    table = spark.createDataFrame([(1, "the"), (2, "of the"), (3, "one two three"), (4, None)], "item_id long, text string")
    rows = [(1, "the cat of the house"), (2, "one two three four")]
    assert [r[0] for r in rows_of(decontam.decontaminate(frame(rows), table), "doc_id")] == [1]
    assert sorted(rows_of(decontam.short_items(table), "item_id")) == [(1,), (2,), (4,)]


# 8


def test_forward_is_exact_and_training_climbs():
    rng = np.random.default_rng(1)
    model = hmm.start(np.full(5, 0.2), 3)
    seqs = [rng.integers(0, 5, n).astype(np.uint16) for n in (6, 1, 4)]
    flat, size = np.concatenate(seqs), np.array([6, 1, 4])
    order = np.argsort(-size, kind="stable")
    got = np.zeros(3)
    got[order] = hmm.forward(flat, (np.cumsum(size) - size)[order], size[order], model)
    pi, trans, emit = model
    for i, s in enumerate(seqs):
        total = 0.0
        for path in np.ndindex(*[3] * len(s)):
            p = pi[path[0]] * emit[path[0], s[0]]
            for t in range(1, len(s)):
                p *= trans[path[t - 1], path[t]] * emit[path[t], s[t]]
            total += p
        assert got[i] == pytest.approx(math.log10(total))
    first, last = hmm.stretches(seqs, 64, 0), -math.inf
    counts = hmm.expect(flat, *first, model)
    assert counts[0].sum() == pytest.approx(3) and counts[1].sum() == pytest.approx(8) and counts[2].sum() == pytest.approx(11)
    for _ in range(6):
        a, b, c, total = hmm.expect(flat, *first, model)
        assert total >= last - 1e-9
        last, model = total, (a / a.sum(), b / b.sum(1, keepdims=True), c / c.sum(1, keepdims=True))
    parts = hmm.stretches([np.zeros(n) for n in (0, 130, 64, 5)], 64, 8)
    assert sorted(zip(*map(list, parts), strict=True)) == [(0, 72, 0, 64, True), (56, 74, 8, 72, False), (120, 10, 8, 10, False), (130, 64, 0, 64, True), (194, 5, 0, 5, True)]
    # stretches with overlap count every token, every transition and every start once, close to the whole texts' counts
    long = [rng.integers(0, 5, n).astype(np.uint16) for n in (700, 333, 90)]
    flat = np.concatenate(long)
    whole, cut = (hmm.expect(flat, *hmm.stretches(long, m, o), model) for m, o in ((1000, 0), (40, 16)))
    for a, b in zip(whole[:3], cut[:3], strict=True):
        assert a.sum() == pytest.approx(b.sum()) and np.abs(a - b).max() < 0.02 * a.sum()


def brute_expect(seqs, model):
    """Baum-Welch counts of whole sequences, by sums over all states, one token at a time."""
    pi, trans, emit = model
    counts = np.zeros(len(pi)), np.zeros_like(trans), np.zeros_like(emit)
    gammas = []
    for s in seqs:
        alpha, beta = np.zeros((len(s), len(pi))), np.ones((len(s), len(pi)))
        for t, x in enumerate(s):
            alpha[t] = (pi if t == 0 else alpha[t - 1] @ trans) * emit[:, x]
            alpha[t] /= alpha[t].sum()
        for t in range(len(s) - 2, -1, -1):
            beta[t] = trans @ (emit[:, s[t + 1]] * beta[t + 1])
            beta[t] /= beta[t].sum()
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        counts[0][:] += gamma[0]
        for t, x in enumerate(s):
            counts[2][:, x] += gamma[t]
            if t:
                xi = alpha[t - 1][:, None] * trans * emit[:, x] * beta[t]
                counts[1][:] += xi / xi.sum()
        gammas.append(gamma)
    return counts, gammas


def test_scores_against_brute_force(frame):
    """The whole model, with frequent, rare and unknown words, built again with dictionaries on a small corpus of short texts."""
    rows = [(i, t, s) for i, t, s in corpus(21, 450, vocabulary=6000, least=1, most=90) if len(words(t)) < hmm.STRETCH] + [(900 + i, f"unseen{i} ab unseen{i}", "s") for i in range(20)]
    own, classes = hmm.OWN, hmm.CLASSES
    got = {r.doc_id: r for r in hmm.score(frame(rows), 3, 4).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    low = {i: words(t) for i, t, _ in rows}
    low = {i: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in ws] for i, ws in low.items()}
    count = collections.Counter(w for i in low if not held(i) for w in low[i])
    ends = sum(not held(i) for i in low)

    def named(w):
        raw = w.encode()
        x = hmm.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return int(hmm.signed(x.hashes(lower=True))[0]), int(hmm._endings(x)[0])

    order = sorted(count, key=lambda w: (-count[w], named(w)[0]))
    cls = {w: 1 + n for n, w in enumerate(order[:own])}
    of = lambda w: cls.get(w, 1 + own + named(w)[1])
    seqs = {i: np.array([of(w) for w in ws] + [0]) for i, ws in low.items()}
    unigram = np.zeros(classes)
    unigram[0] = ends
    for w, n in count.items():
        unigram[of(w)] += n
    distinct = collections.Counter(of(w) for w in count)
    assert sum(distinct[c] for c in range(1 + own, classes)) > 500
    for c in range(1 + own, classes):  # as the sizes of classes of several words: tokens and words
        unigram[c] += distinct[c]
    unigram = (unigram + 1) / (unigram + 1).sum()
    model, train = hmm.start(unigram, 4), [seqs[i] for i in seqs if not held(i)]
    for _ in range(3):
        (a, b, c), _ = brute_expect(train, model)
        model = (a + 1) / (a + 1).sum(), (b + 1) / (b + 1).sum(1, keepdims=True), (c + 50 * unigram) / (c.sum(1, keepdims=True) + 50)
    _, gammas = brute_expect(train, model)
    g, q = collections.defaultdict(lambda: np.zeros(4)), collections.defaultdict(lambda: np.zeros(4))
    for i, gamma in zip([i for i in seqs if not held(i)], gammas, strict=True):
        for w, x in zip(low[i], gamma, strict=False):
            if of(w) > own:
                g[w] += x
                q[of(w)] += x
    size = collections.Counter()
    for w, n in count.items():
        size[of(w)] += n + 1
    for i, ws in low.items():
        a, total = None, 0.0
        for t, c in enumerate(seqs[i]):
            e = model[2][:, c].copy()
            if c > own:
                w = ws[t]
                share = q[c] / q[c].sum() if c in q else np.full(4, 0.25)
                e *= (g[w] / share + 1) / (size[c] + 1) if count[w] else 1 / (size[c] + 1)
            a = (model[0] if a is None else a @ model[1]) * e
            total += math.log10(a.sum())
            a = a / a.sum()
        assert got[i].score == pytest.approx(total, abs=2e-3)


def test_language_model(frame, clashing):
    rows = corpus(13, 80) + [(r[0], r[1]) for r in ODD] + [(700 + i, "unseen" + str(i)) for i in range(9)]
    got = hmm.score(frame(rows, **clashing)).collect()
    low = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)] + [None]
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    counts = collections.Counter(w for i, t, *_ in rows if not held(i) for w in low(t))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(((i, held(i), len(low(t)), sum(counts[w] > 0 for w in low(t)), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in low(t)), 6)) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert hmm.score(frame([])).count() == 0
    alone = [i for i in range(50) if held(i)][:2]
    only = hmm.score(frame([(i, "a b") for i in alone])).collect()
    assert [r.n_known for r in only] == [0, 0] and all(math.isfinite(r.score) for r in only)


@pytest.mark.parametrize("fillers", [2_100, 131_200])
def test_states_tell_words_of_a_class_apart(frame, fillers):
    """Of two texts of equal classes and counts, the one whose rare words go with its frequent ones is likelier;
    the rare words are within the hot table or, with many fillers, beyond it."""
    r = random.Random(15)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    ids = (i for i in range(10**6) if not held(i))
    rows = []
    for a in range(0, fillers, 500):
        for _ in range(3):
            mixed = [f"f{x}xy" for x in range(a, min(a + 500, fillers))] + [f"{'ab'[a // 500 % 2]}{r.randrange(9)}" for _ in range(500)]
            r.shuffle(mixed)
            rows.append((next(ids), " ".join(mixed)))
    for topic in "ab":
        for i in range(300):
            own = [f"{topic}{r.randrange(9)}" for _ in range(60)]
            for k in (10, 30, 50):
                own[k] = f"r{topic}{(3 * i + k // 20) % 450}zz"
            rows.append((next(ids), " ".join(own)))
    assert max(collections.Counter(w for _, t in rows for w in t.split() if w.endswith("zz")).values()) == 2
    first, second = [i for i in range(100) if held(i)][:2]
    text = "a1 a2 a3 r{0}0zz a4 a5 r{0}7zz a6 a7 r{0}9zz a8 a1"
    got = {x.doc_id: x for x in hmm.score(frame([*rows, (first, text.format("a")), (second, text.format("b"))])).where("held_out").collect()}
    assert got[first].base_score == pytest.approx(got[second].base_score)
    assert got[first].score > got[second].score + 0.1


def test_word_probabilities_add_up():
    """Over all words of a class, known and unknown, shares add up to one."""
    import pyarrow as pa

    hot = pa.table({"h": pa.array([1, 2, 3], pa.int64()), "c": pa.array([5, 4, 3], pa.int64()), "e": pa.array([0, 0, 1], pa.int32())})
    before, hmm.OWN = hmm.OWN, 1
    try:
        table = hmm.Lookup(hot, [(0, 12, 3), (1, 3, 1)], 15, 4)
        # class 0 keeps the word with 4 tokens and one outside the hot table with 3
        assert 10 ** table.share[0] * ((4 + 1) + (3 + 1) + 1) == pytest.approx(1)
        assert 10 ** table.share[1] * ((3 + 1) + 1) == pytest.approx(1)
    finally:
        hmm.OWN = before


def test_scores_beat_the_base_on_held_out_texts(spark):
    got = hmm.hmm_query(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
