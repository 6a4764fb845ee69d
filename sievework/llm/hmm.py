"""Operator 8, hidden Markov language model over words.

Hidden states emit word classes, and a class emits its words: P(word | state) = P(class | state) *
P(word | state, class). The OWN most frequent words are classes of their own; other words, known or not,
belong to one of ENDINGS classes by their last two bytes. With g the expected count of a state and word
and q the state's share of the class's tokens, P(word | state, class) = (g / q + 1) / (tokens + words + 1),
so that one share is left for each class's unknown words and all probabilities of a state add up to one.
The end of a text is a token and a class. So the matrices of classes have a fixed size, while the
expected counts of states and words grow with the corpus and stay distributed.

Training is Baum-Welch over all training texts: each partition runs the scaled forward and backward
recursions over stretches of STRETCH tokens, read with OVERLAP tokens more on both sides, and adds up the
stretch's own expected counts (each token and each transition of a text once; the initial state at starts of texts only); the counts are summed over
partitions by an aggregate, and only the summed matrices reach the driver. The rounds begin with words
that are spread over their class alike in all states; after them one more pass counts states and words.
Scoring runs the scaled forward recursion over the whole text, which gives its exact likelihood.

Scale: word counts are pre-aggregated in batches. The HOT most frequent words are looked up on the
executors (a table of fixed size); the others go through an equi-join, a row a text and word. Texts
are read twice and coded once; training and scoring read the codes (two bytes a token, and four more
where the last pass and scoring need the word within its class).

Defined results: null and empty texts are the end token alone; a null doc_id hashes as the empty text
(0, so it is trained on); without training texts all words are unknown and the matrices stay at their
start; repeated rows are scored alike, each once. Extra columns are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LOWER, U64, Words, buffers, materialise, mix, signed, slices, tidy

STATES, ROUNDS, STRETCH, OVERLAP = 6, 5, 192, 12
OWN, ENDINGS, HOT = 2047, 192, 1 << 17
CLASSES = 1 + OWN + ENDINGS
HELD_OUT = (7, 2)
END = np.int64(-1)


def _endings(words: Words) -> np.ndarray:
    """The ending class of each word: a hash of its last two bytes in lower case."""
    last = LOWER[words.raw[words.end - 1]].astype(np.uint64)
    before = np.where(words.end - words.start > 1, LOWER[words.raw[np.maximum(words.end - 2, 0)]], 0).astype(np.uint64)
    return (mix(last << U64(8) | before) % U64(ENDINGS)).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, ending class, n) of a batch of training texts; the end of texts is a word of its own."""
    for batch in batches:
        raw, offs = buffers(batch.column("text"))
        hs, es = [], []
        for i, j in slices(offs):
            words = Words(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            hs.append(signed(words.hashes(lower=True)))
            es.append(_endings(words))
        h, e = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hs, es))
        h, first, n = np.unique(h, return_index=True, return_counts=True)
        h, e, n = np.append(h, END), np.append(e[first], -1), np.append(n, batch.num_rows)
        yield pa.record_batch([pa.array(h, pa.int64()), pa.array(e, pa.int32()), pa.array(n, pa.int64())], ["h", "e", "n"])


class Lookup:
    """What executors need for coding: hot words and the sizes of the ending classes."""

    def __init__(self, hot: pa.Table, sizes: list, total: int, distinct: int):
        h, c = hot["h"].to_numpy(), hot["c"].to_numpy()
        by_count = np.lexsort((h, -c))
        own = np.full(len(h), -1, np.int32)
        own[by_count[:OWN]] = np.arange(min(OWN, len(h)))
        order = np.argsort(h)
        self.h, self.c, self.own = h[order], c[order], own[order]
        self.total, self.distinct = total, distinct
        tokens, words = np.zeros(ENDINGS), np.zeros(ENDINGS)
        for e, t, w in sizes:
            tokens[e], words[e] = t, w
        # words with a class of their own have left their ending's class
        mine = hot["e"].to_numpy()[order][self.own >= 0]
        tokens -= np.bincount(mine, self.c[self.own >= 0], ENDINGS)
        words -= np.bincount(mine, minlength=ENDINGS)
        self.share = -np.log10(tokens + words + 1.0)

    def code(self, words: Words) -> tuple[np.ndarray, ...]:
        """(hash, class, place in the hot table or -1, log10(c + 1) or nan where not hot, log10 of the class's
        share of a token without the nan part)."""
        h, e = signed(words.hashes(lower=True)), _endings(words)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            hot = self.h[at] == h
            own = np.where(hot, self.own[at], -1)
            log = np.where(hot, np.log10(self.c[at] + 1.0), np.nan)
            at = np.where(hot, at, -1)
        else:
            own, at, log = np.full(len(h), -1), np.full(len(h), -1), np.full(len(h), np.nan)
        cls = np.where(own >= 0, own + 1, e + 1 + OWN)
        inside = np.where(own >= 0, 0.0, self.share[e] + np.nan_to_num(log))
        return h, cls.astype(np.uint16), at, log, inside


def _coder(lookup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Lookup = lookup.value
        for batch in batches:
            raw, offs = buffers(batch.column("text"))
            ids, held = batch.column("doc_id"), batch.column("held_out")
            for i, j in slices(offs):
                words = Words(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                h, cls, at, log, inside = table.code(words)
                hot = ~np.isnan(log)
                sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[words.first])  # noqa: E731, B023
                seqs, inner, rare, times = [], [], [], []
                for r in range(j - i):
                    a, b = words.first[r], words.first[r + 1]
                    seqs.append(cls[a:b].tobytes() + b"\0\0")
                    x, place, n = np.unique(h[a:b][~hot[a:b]], return_inverse=True, return_counts=True)
                    code = at[a:b].copy()
                    code[code < 0] = HOT + place
                    inner.append(code[cls[a:b] > OWN].astype(np.uint32).tobytes())
                    rare.append(x)
                    times.append(n)
                lists = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), pa.int32()), pa.array(np.concatenate(parts), kind))
                yield pa.record_batch([
                    ids.slice(i, j - i), held.slice(i, j - i), pa.array(words.counts + 1, pa.int64()), pa.array(np.round(sums(hot)).astype(np.int64)),
                    pa.array(sums(np.where(hot, log, 0.0))), pa.array(sums(inside)), pa.array(seqs, pa.binary()), pa.array(inner, pa.binary()), lists(rare, pa.int64()), lists(times, pa.int32()),
                ], ["doc_id", "held_out", "n_tokens", "known", "base", "inside", "seq", "inner", "rare", "times"])

    return run


def start(unigram: np.ndarray, states: int = STATES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(initial, transition, emission) to begin with: states that tend to stay, each with classes it favours."""
    rng = np.random.default_rng(8)
    emission = unigram * np.exp(rng.normal(0.0, 0.7, (states, len(unigram))))
    emission /= emission.sum(1, keepdims=True)
    stay = 0.9
    return np.full(states, 1 / states), np.full((states, states), (1 - stay) / (states - 1)) + np.eye(states) * (stay - (1 - stay) / (states - 1)), emission


def stretches(seqs: list[np.ndarray], most: int = STRETCH, overlap: int = OVERLAP) -> tuple[np.ndarray, ...]:
    """Cuts sequences: (first token of each stretch in the concatenation, its length, its own part's first and end within it,
    does it begin a sequence), longest first."""
    n = np.array([len(s) for s in seqs], np.int64)
    base = np.cumsum(n) - n
    parts = -(-n // most)
    row = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    lo, hi = np.maximum(k * most - overlap, 0), np.minimum((k + 1) * most + overlap, n[row])
    own, end = k * most - lo, np.minimum((k + 1) * most, n[row]) - lo
    order = np.argsort(lo - hi, kind="stable")
    return (base[row] + lo)[order], (hi - lo)[order], own[order], end[order], (k == 0)[order]


def expect(flat: np.ndarray, first: np.ndarray, size: np.ndarray, own: np.ndarray, end: np.ndarray, heads: np.ndarray, model, states: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of stretches: initial, transition, emission, log10 likelihood. A stretch that begins no
    sequence starts with the states' overall shares. states, one row a token, takes the chances of each token's states."""
    pi, trans, emit = model
    middle = np.linalg.matrix_power(trans, 64).mean(0)
    k, by_class = len(pi), np.ascontiguousarray(emit.T)
    steps = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(steps), "left")
    alpha, scale, seen = [], [], []
    total = 0.0
    for t in range(steps):
        n = alive[t]
        obs = flat[first[:n] + t]
        a = (np.where(heads[:n, None], pi, middle) if t == 0 else alpha[-1][:n] @ trans) * by_class[obs]
        c = a.sum(1, keepdims=True)
        alpha.append(a / c)
        scale.append(c)
        seen.append(obs)
        total += np.log10(c[(own[:n] <= t) & (t < end[:n])]).sum()
    counts_pi, counts_trans, counts_emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, emit.shape[1]))
    beta = np.ones((0, k))
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        if len(beta) < n:  # stretches that end here
            beta = np.concatenate([beta, np.ones((n - len(beta), k))])
        mine = (own[:n] <= t) & (t < end[:n])
        if mine.all():
            mine = slice(None)
        gamma, obs = (alpha[t] * beta)[mine], seen[t][mine]
        if states is not None:
            states[(first[:n] + t)[mine]] = gamma
        for s in range(k):
            counts_emit[s] += np.bincount(obs, gamma[:, s], emit.shape[1])
        if t == 0:
            counts_pi += gamma[heads[:n][mine]].sum(0)
        else:
            ahead = by_class[seen[t]] * beta / scale[t]
            counts_trans += alpha[t - 1][:n][mine].T @ ahead[mine] * trans
            beta = ahead @ trans.T
    return counts_pi, counts_trans, counts_emit, total


def forward(flat: np.ndarray, first: np.ndarray, size: np.ndarray, model, ratio: np.ndarray | None = None) -> np.ndarray:
    """log10 likelihood of each sequence (longest first) by the scaled forward recursion. ratio, one row a
    token, multiplies the emissions of the token's class."""
    pi, trans, emit = model
    by_class = np.ascontiguousarray(emit.T)
    out, a = np.zeros(len(size)), np.broadcast_to(pi, (len(size), len(pi)))
    steps = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(steps), "left")
    for t in range(steps):
        n = alive[t]
        at = first[:n] + t
        a = (a if t == 0 else a[:n] @ trans) * (by_class[flat[at]] if ratio is None else by_class[flat[at]] * ratio[at])
        c = a.sum(1)
        out[:n] += np.log10(c)
        a = a / c[:, None]
    return out


def _sequences(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    seqs = [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column("seq")]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    for i, j in slices(offsets, most // 8):
        yield i, j, seqs[i:j]


def _trainer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pi, trans, emit = model.value
        sums = [np.zeros_like(pi), np.zeros_like(trans), np.zeros_like(emit), 0.0]
        for batch in batches:
            for _, _, seqs in _sequences(batch):
                got = expect(np.concatenate(seqs), *stretches(seqs), (pi, trans, emit))
                sums = [a + b for a, b in zip(sums, got, strict=True)]
        flat = np.concatenate([np.ravel(x) for x in sums])
        yield pa.record_batch([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["i", "v"])

    return run


def _inner(batch: pa.RecordBatch, i: int, j: int, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the tokens of rows i to j in classes of several words: (place in flat, code, place of the row's
    word in the rows' lists of rare words)."""
    code = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column("inner").slice(i, j - i)]).astype(np.int64)
    at = np.flatnonzero(flat > OWN)
    n = batch.column("n_rare").slice(i, j - i).to_numpy()
    return at, code, (np.cumsum(n) - n)[np.repeat(np.arange(j - i), size)[at]] + code - HOT


def _state_words(model, hot):
    """(word, ending class, count, expected counts of the states) of a batch of training texts, for words
    in classes of several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, table = len(model.value[0]), hot.value.h
        for batch in batches:
            for i, j, seqs in _sequences(batch):
                flat = np.concatenate(seqs)
                states = np.zeros((len(flat), k))
                expect(flat, *stretches(seqs), model.value, states)
                at, code, listed = _inner(batch, i, j, flat, np.array([len(s) for s in seqs]))
                rare, h = batch.column("rare").slice(i, j - i).flatten().to_numpy(), np.zeros(len(at), np.int64)
                known = code < HOT
                h[known], h[~known] = table[code[known]], rare[listed[~known]]
                h, head, word, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                # the last state's counts are what is left of n
                sums = [pa.array(np.bincount(word, states[at, x], len(h)), pa.float32()) for x in range(k - 1)]
                yield pa.record_batch([pa.array(h), pa.array(flat[at][head].astype(np.int32) - 1 - OWN), pa.array(n, pa.int64()), *sums], ["h", "e", "n", *(f"g{x}" for x in range(k - 1))])

    return run


def _scorer(model, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.value[0])
        for batch in batches:
            score = np.zeros(batch.num_rows)
            # many texts side by side, as a long one alone takes a step a token
            for i, j, seqs in _sequences(batch, 8 << 20):
                flat, size = np.concatenate(seqs), np.array([len(s) for s in seqs])
                order = np.argsort(-size, kind="stable")
                first = np.cumsum(size) - size
                n, found = batch.column("n_rare").slice(i, j - i).to_numpy(), batch.column("found").slice(i, j - i)
                known, own = found.flatten(), np.ones((n.sum(), k), np.float32)
                if len(known):
                    m = found.value_lengths().fill_null(0).to_numpy()
                    r = known.field("r")
                    ends = np.frombuffer(r.buffers()[1], np.int32)[r.offset : r.offset + len(r) + 1]
                    got = np.frombuffer(r.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(-1, k)
                    own[np.repeat(np.cumsum(n) - n, m) + known.field("pos").to_numpy()] = got
                at, code, listed = _inner(batch, i, j, flat, size)
                frequent = code < HOT
                ratio = np.ones((len(flat), k), np.float32)
                ratio[at[frequent]], ratio[at[~frequent]] = hot.value[code[frequent]], own[listed[~frequent]]
                score[i + order] = forward(flat, first[order], size[order], model.value, ratio)
            yield batch.drop_columns(["seq", "inner", "n_rare", "found"]).append_column("forward", pa.array(score))

    return run


def _packed(k: int):
    """(word, count, its ratios as k floats in one binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.stack([batch.column(f"r{x}").to_numpy() for x in range(k)], 1).astype(np.float32)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * (4 * k)
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(table))])
            yield pa.record_batch([batch.column("h"), batch.column("c"), packed], ["h", "c", "r"])

    return run


def train(codes: DataFrame, unigram: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> tuple:
    """(model, log10 likelihood of the class sequences before each round) over coded training texts."""
    spark, model, history = codes.sparkSession, start(unigram, states), []
    k, c = states, len(unigram)
    for _ in range(rounds):
        sums = codes.select("seq").mapInArrow(tidy(_trainer(spark.sparkContext.broadcast(model))), "i int, v double")
        got = np.zeros(k + k * k + k * c + 1)
        table = sums.groupBy("i").agg(F.sum("v").alias("v")).toArrow()
        got[table["i"].to_numpy()] = table["v"].to_numpy()
        pi, trans, emit = got[:k], got[k : k + k * k].reshape(k, k), got[k + k * k : -1].reshape(k, c)
        history.append(float(got[-1]))
        # the counts plus a little of the start: no probability becomes 0
        pi = (pi + 1.0) / (pi + 1.0).sum()
        trans = (trans + 1.0) / (trans + 1.0).sum(1, keepdims=True)
        emit = (emit + 50.0 * unigram) / (emit.sum(1, keepdims=True) + 50.0)
        model = (pi, trans, emit)
    return model, history


def score(docs: DataFrame, rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """One row a row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = docs.select("doc_id", "text", (crc % HELD_OUT[0] == HELD_OUT[1]).alias("held_out"))
    counts = docs.where("NOT held_out").select("text").mapInArrow(tidy(_count), "h bigint, e int, n bigint")
    counts = materialise(counts.groupBy("h").agg(F.min("e").alias("e"), F.sum("n").alias("c")), "counts")
    total, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("e") < 0, F.col("c"))), F.lit(0))).first()
    words = counts.where("e >= 0")
    hot = words.orderBy(F.desc("c"), "h").limit(HOT).toArrow()
    sizes = [tuple(r) for r in words.groupBy("e").agg(F.sum("c"), F.count("*")).collect()]
    lookup = Lookup(hot, sizes, total, distinct)
    shared = spark.sparkContext.broadcast(lookup)
    codes = docs.mapInArrow(tidy(_coder(shared)), f"doc_id {id_type}, held_out boolean, n_tokens bigint, known bigint, base double, inside double, seq binary, inner binary, rare array<bigint>, times array<int>")
    codes = materialise(codes.withColumn("uid", F.monotonically_increasing_id()), "codes")
    unigram = np.zeros(CLASSES)
    unigram[0] = ends
    unigram[1 + lookup.own[lookup.own >= 0]] = lookup.c[lookup.own >= 0]
    unigram[1 + OWN :] = np.maximum(10**-lookup.share - 1, 0)
    model, _ = train(codes.where("NOT held_out"), (unigram + 1) / (unigram + 1).sum(), rounds, states)
    model = spark.sparkContext.broadcast(model)
    gs = [f"g{x}" for x in range(states)]
    left = F.greatest(F.col("c") - sum((F.col(g) for g in gs[:-1]), F.lit(0.0)), F.lit(0.0))
    states_of = codes.where("NOT held_out").select("seq", "inner", "rare", F.size("rare").alias("n_rare")).mapInArrow(tidy(_state_words(model, shared)), ", ".join(["h bigint, e int, n bigint", *(f"{g} float" for g in gs[:-1])]))
    states_of = materialise(states_of.groupBy("h").agg(F.min("e").alias("e"), F.sum("n").alias("c"), *[F.sum(g).alias(g) for g in gs[:-1]]).withColumn(gs[-1], left), "states")
    # q: the states' shares of each class's tokens
    q = np.ones((ENDINGS, states)) / states
    for e, *g in states_of.groupBy("e").agg(*[F.sum(g) for g in gs]).collect():
        q[e] = np.maximum(g, 1e-9) / np.maximum(g, 1e-9).sum()
    shares = spark.createDataFrame([(e, *map(float, x)) for e, x in enumerate(q)], "e int, " + ", ".join(f"q{x} double" for x in range(states)))
    # P(word | state, class) over P(word | class)
    ratios = states_of.join(F.broadcast(shares), "e").select("h", "c", *[((F.col(f"g{x}") / F.col(f"q{x}") + 1) / (F.col("c") + 1)).cast("float").alias(f"r{x}") for x in range(states)])
    frequent = np.ones((max(len(lookup.h), 1), states), np.float32)
    if len(lookup.h):
        table = ratios.where(F.col("c") >= int(lookup.c.min())).orderBy(F.desc("c"), "h").limit(HOT).toArrow()
        at = np.minimum(np.searchsorted(lookup.h, table["h"].to_numpy()), len(lookup.h) - 1)
        same = lookup.h[at] == table["h"].to_numpy()
        frequent[at[same]] = np.stack([table[f"r{x}"].to_numpy() for x in range(states)], 1)[same]
    rare = codes.select("uid", F.posexplode(F.arrays_zip("rare", "times")).alias("pos", "x")).select("uid", "pos", F.col("x.rare").alias("h"), F.col("x.times").alias("n"))
    found = F.collect_list(F.struct("pos", "r")).alias("found")
    rare = rare.join(ratios.mapInArrow(tidy(_packed(states)), "h bigint, c bigint, r binary"), "h").groupBy("uid").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs"), found)
    both = codes.withColumn("n_rare", F.size("rare")).drop("times", "rare").join(rare, "uid", "left").select("doc_id", "held_out", "n_tokens", "known", "base", "inside", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("logs", F.lit(0.0)).alias("logs"), "seq", "inner", "n_rare", "found")
    out = both.mapInArrow(tidy(_scorer(model, spark.sparkContext.broadcast(frequent))), f"doc_id {id_type}, held_out boolean, n_tokens bigint, known bigint, base double, inside double, more bigint, logs double, forward double")
    end_log, denominator = float(np.log10(ends + 1.0)), float(np.log10(total + distinct + 1.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more") + F.lit(int(ends > 0))).alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("logs") + F.lit(end_log) - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
        (F.col("forward") + F.col("inside") + F.col("logs")).alias("score"),
    )


def hmm_query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
