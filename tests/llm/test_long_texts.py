"""Texts far beyond any chunk, slice or batch."""

import math

from sievework.llm import decontam, hmm, html_blocks, mixing, near_dup, quality, substring, token_fst

N = 200_000


def test_very_long_texts(spark, frame):
    long = " ".join(f"w{i}" for i in range(N))
    docs = frame([(1, long), (2, long + "\ntail"), (3, "short"), (4, "x" * 500_000)])
    by_id = lambda df, *columns: {r[0]: tuple(r)[1:] for r in df.select("doc_id", *columns).collect()}
    assert by_id(quality.quality(docs), "n_words", "n_repeat_words", "n_dup_lines")[2] == (N + 1, 0, 0)
    cut = by_id(substring.dedup_substrings(docs), "n_words", "n_removed", "kept_text")
    assert cut[1] == (N, N, "") and cut[2] == (N + 1, N, "tail") and cut[3] == (1, 0, "short") and cut[4][1] == 0
    assert by_id(near_dup.near_duplicates(docs), "class_id", "class_size") == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1)}
    items = spark.createDataFrame([(7, " ".join(f"W{i}" for i in range(150_000, 150_020)))], "item_id long, text string")
    leaks = by_id(decontam.find_leaks(docs, items), "leaks")
    assert [len(leaks[i][0]) for i in (1, 2, 3, 4)] == [1, 1, 0, 0] and leaks[1][0][0]["last_word"] == 150_019
    scores = {r.doc_id: r for r in hmm.score(docs).collect()}
    assert scores[2].n_tokens == N + 2 and all(math.isfinite(r.score) for r in scores.values())
    mix = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert mix[2].size == N + 1 and abs(sum(r.taken for r in mix.values()) - 1.5 * (2 * N + 3)) <= 0.005 * 3 * N
    page = html_blocks.main_text("<nav>menu</nav><article>" + f"<p>{long}</p>" * 3 + "</article>")
    assert page == "\n\n".join([long] * 3)


def test_long_texts_count_like_the_library(frame):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [" ".join(f"word{i % 977}é" for i in range(60_000)), "x" * 3000, "ab " * 40_000, "\n" * 100_000]
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = {r.doc_id: r.n_tokens for r in token_fst.count_tokens(frame(list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(4)] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
