"""Word splitting and hashing against Python's."""

import random
import re

import numpy as np
import pyarrow as pa

from sievework.llm._text import Words, buffers, slices


def test_words_and_hashes():
    r = random.Random(1)
    texts = ["".join(r.choice("aäB \t\n\x0b\x1c 漢") for _ in range(r.randint(0, 30))) for _ in range(400)] + ["", "x", " "]
    column = pa.chunked_array([pa.array(["skipped", *texts, None])])
    raw, offsets = buffers(column.slice(1))
    seen = {}
    for i, j in slices(offsets, 200):
        words = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        h, low = words.hashes(), words.hashes(lower=True)
        at, three = words.windows(h, 3)
        for row in range(i, j):
            want = re.findall(r"[^\x20\x09-\x0D]+", (texts[row] if row < len(texts) else ""))
            a, b = words.first[row - i], words.first[row - i + 1]
            assert [bytes(words.raw[s:e]).decode() for s, e in zip(words.start[a:b], words.end[a:b], strict=True)] == want
            for k, w in enumerate(want):
                assert seen.setdefault(("w", w), h[a + k]) == h[a + k]
                assert seen.setdefault(("l", re.sub("[A-Z]", lambda m: m[0].lower(), w)), low[a + k]) == low[a + k]
            mine = (at >= a) & (at < b)
            assert list(at[mine] - a) == list(range(max(0, len(want) - 2)))
            for k, x in zip(at[mine] - a, three[mine], strict=True):
                assert seen.setdefault(("3", tuple(want[k : k + 3])), x) == x
    for kind in "wl3":
        values = [v for k, v in seen.items() if k[0] == kind]
        assert len(set(map(int, values))) == len(values)
    assert not len(buffers(pa.array([], pa.string()))[0]) and not len(buffers(pa.array([None, None], pa.string()))[0])
    assert np.array_equal(buffers(pa.array(["a", None, "b"]))[1], [0, 1, 1, 2])
