"""Operator 3, token counts: a byte-level BPE vocabulary compiled into a deterministic transducer.

A state holds what reading a piece so far leaves open: the ways in which its end may still be the
start of a token, each with the token before it and a token count relative to the state. Each
transition (one byte) is annotated with the number of tokens it emits; a state's final emission
settles the rest. As canonical BPE has exactly one tokenization of every prefix, and neighbours decide
alone whether a sequence of tokens is canonical, the subset construction is deterministic and exact.
States and transitions are compiled when first met and kept in a table of bounded size.

Pieces come from the vocabulary's own pattern, which texts of up to CHUNK characters go through as they are. A
longer text is cut into chunks anywhere. The pattern is then a part of the machine: a state is what kind
of piece is being read, the transducer's state within it, and at most two characters that wait for the
next one to say which piece they belong to. A chunk's map takes states to (state, tokens). It is
worked out for the start of a piece first; from another state only until both paths meet. Maps compose
associatively, and a balanced scan joins those of a long text.

Defined results: null and empty texts have no bytes and no tokens; strings of special tokens inside a
text count as that one token, as the library does by default; extra columns pass through, but
`n_bytes`, `n_tokens` and `over_limit` are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._text import extended, keeps

#: Fixed value: the pattern of the byte-level vocabulary, its white space spelled as the Unicode property.
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
          r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")  # fmt: skip
CHUNK = 1 << 15
#: Bounds of what a worker keeps: pieces with their counts, states, and answers about neighbours.
MOST_PIECES, MOST_STATES, MOST_PAIRS = 700_000, 250_000, 500_000


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens as bytes, and the ranks of merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        letters = byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        self.special = [t["content"] for t in made["added_tokens"]]
        special = set(self.special)
        self.ids = {spell(t): i for t, i in made["model"]["vocab"].items() if t not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
        self.merges = {}
        for rank, (a, b) in enumerate(pairs):
            a, b = spell(a), spell(b)
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.words = {i: b for b, i in self.ids.items()}

    def merge(self, piece: bytes) -> list[int]:
        """BPE by its definition: the pair of lowest rank first, leftmost of equals."""
        found = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        while len(found) > 1:
            best = min((self.merges.get((a, b), (1 << 60, 0))[0], i) for i, (a, b) in enumerate(zip(found, found[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            pair = found[best[1]], found[best[1] + 1]
            token, out, i = self.merges[pair][1], [], 0
            while i < len(found):
                if i + 1 < len(found) and (found[i], found[i + 1]) == pair:
                    out.append(token)
                    i += 2
                else:
                    out.append(found[i])
                    i += 1
            found = out
        return found


class Transducer:
    """Counts of the tokens of pieces; compiled as pieces need it."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        # the trie of tokens: node -> byte -> node, and the token that ends at a node
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for word, token in vocabulary.ids.items():
            at = 0
            for b in word:
                if b not in self.child[at]:
                    self.child[at][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                at = self.child[at][b]
            self.token[at] = token
        self.parts = {token: (rank, *pair) for pair, (rank, token) in vocabulary.merges.items()}
        self.alone: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        #: transitions: (state, byte) in one dict a state -> (state, tokens emitted)
        self.states: list[tuple] = [((0, -1, 0),)]
        self.next: list[dict[int, tuple[int, int]]] = [{}]
        self.known = {self.states[0]: 0}

    def canonical(self, token: int) -> bool:
        """Whether the token's own bytes become that token."""
        found = self.alone.get(token)
        if found is None:
            found = self.alone[token] = self.vocabulary.merge(self.vocabulary.words[token]) == [token]
        return found

    def edge(self, token: int, right: bool) -> list[tuple[int, int, int]]:
        """The tokens that stand at one end of `token` while it is merged: (token, made at, merged on at), in ranks."""
        found = self.edges[right].get(token)
        if found is None:
            found, at, until = [], token, 1 << 60
            while True:
                made = self.parts.get(at)
                found.append((at, made[0] if made else -1, until))
                if not made:
                    break
                until, at = made[0], made[2] if right else made[1]
            self.edges[right][token] = found
        return found

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand behind a in a canonical sequence: no merge across their border
        comes up while both its sides stand there. Merges run in the order of ranks, and among equal
        ones from the left, so a tie goes to a merge inside a and against one inside b."""
        found = self.pairs.get((a, b))
        if found is None:
            found, merges = self.canonical(b), self.vocabulary.merges
            if found and a >= 0:
                for x, x_made, x_until in self.edge(a, True):
                    for y, y_made, y_until in self.edge(b, False):
                        rank = merges.get((x, y))
                        if rank and x_made < rank[0] < x_until and y_made < rank[0] <= y_until:
                            found = False
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = found
        return found

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Compiles one transition. A state's last entry is the boundary: all read so far is tokens."""
        open_ways, whole = [], None
        for node, last, n in self.states[state]:
            node = self.child[node].get(byte)
            if node is None:
                continue
            if whole is None and self.token[node] >= 0 and self.follows(last, self.token[node]):
                whole = (0, self.token[node], n + 1)
            if self.child[node]:
                open_ways.append((node, last, n))
        emitted = whole[2]
        ways = tuple((node, last, n - emitted) for node, last, n in (*open_ways, whole))
        to = self.known.get(ways)
        if to is None:
            to = self.known[ways] = len(self.states)
            self.states.append(ways)
            self.next.append({})
        self.next[state][byte] = (to, emitted)
        return to, emitted

    def read(self, state: int, character: bytes) -> tuple[int, int]:
        """(state, tokens emitted) behind the bytes of a character."""
        n, table = 0, self.next
        for b in character:
            found = table[state].get(b)
            state, emitted = found if found is not None else self.step(state, b)
            n += emitted
        return state, n

    def trim(self) -> None:
        """Forgets the states when there are too many; states held elsewhere are void then."""
        if len(self.states) > MOST_STATES:
            self.clear()

    def count(self, piece: bytes) -> int:
        """Tokens of one piece; the final emission is 0 as counts are kept relative to the boundary."""
        self.trim()
        state, n, table = 0, 0, self.next
        for b in piece:
            found = table[state].get(b)
            state, emitted = found if found is not None else self.step(state, b)
            n += emitted
        return n


class _Counts(dict):
    """piece -> tokens, with a bound; a missing piece runs through the transducer."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, piece: str) -> int:
        if len(self) >= MOST_PIECES:
            self.clear()
        n = self[piece] = self.transducer.count(piece.encode())
        return n


#: Kinds of states between characters: at a piece's start, in letters, numbers or other signs, behind an apostrophe that
#: begins a piece, behind such a one and a letter that waits, and in white space whose last character waits.
BEGIN, LETTERS, NUMBERS, OTHER, QUOTE, ENDING, SPACES = range(7)
START = (BEGIN, 0, "")
#: What follows an apostrophe in pieces of their own.
SINGLE, DOUBLE = {"s", "t", "m", "d"}, {"r": "e", "v": "e", "l": "l"}
MEET = 64


class StateMap:
    """A function from states to (state, tokens), worked out for the states that it is asked for."""

    __slots__ = ("known", "work")

    def __init__(self, work):
        self.work, self.known = work, {}

    def __call__(self, state: tuple) -> tuple[tuple, int]:
        if state not in self.known:
            self.known[state] = self.work(state)
        return self.known[state]

    def then(self, other: StateMap) -> StateMap:
        """The map of this map's text followed by the other's."""

        def work(state: tuple) -> tuple[tuple, int]:
            middle, n = self(state)
            end, m = other(middle)
            return end, n + m

        return StateMap(work)


class Machine:
    """The pattern of pieces and the transducer as one machine over characters: (kind, transducer's state, what waits)."""

    def __init__(self, transducer: Transducer):
        self.read, self.kinds = transducer.read, {}
        self.classes = [(k, regex.compile(p)) for k, p in ((SPACES, r"\p{White_Space}"), (LETTERS, r"\p{L}"), (NUMBERS, r"\p{N}"))]

    def kind(self, c: str) -> int:
        found = self.kinds.get(c)
        if found is None:
            found = self.kinds[c] = next((k for k, p in self.classes if p.match(c)), OTHER)
        return found

    def step(self, state: tuple, c: str) -> tuple[tuple, int]:
        """(state, tokens emitted) behind one more character."""
        mode, at, wait = state
        kind, n = self.kind(c), 0
        if mode == SPACES:
            if kind == SPACES:
                at, n = self.read(at, wait.encode())
                return (SPACES, at, c), n
            # a last blank belongs to the piece behind it, another last one is a piece
            front, n = self.read(0, wait.encode())
            if wait == " ":
                at, m = self.read(front, c.encode())
                return (kind, at, ""), n + m
            mode, at = BEGIN, 0
        elif mode == ENDING:
            if c == DOUBLE[wait]:
                return START, self.read(at, (wait + c).encode())[1]
            at, n = self.read(0, wait.encode())
            mode = LETTERS
        elif mode == QUOTE:
            if c in SINGLE:
                return START, self.read(at, c.encode())[1]
            if c in DOUBLE:
                return (ENDING, at, c), 0
            mode = OTHER
        if kind == SPACES:
            return (SPACES, 0, c), n
        if kind != mode:
            at, mode = 0, QUOTE if c == "'" else kind
        at, m = self.read(at, c.encode())
        return (mode, at, ""), n + m

    def rest(self, state: tuple) -> int:
        """Tokens of what waits at the end of a text."""
        mode, at, wait = state
        return self.read(at if mode == SPACES else 0, wait.encode())[1] if wait else 0

    def chunk(self, text: str) -> StateMap:
        """The map of a chunk."""
        # the first path's states and tokens at every MEET characters
        path: list[tuple[tuple, int]] = []

        def work(state: tuple) -> tuple[tuple, int]:
            n, first = 0, not path
            for i in range(0, len(text), MEET):
                if first:
                    path.append((state, n))
                elif path[i // MEET][0] == state:
                    return path[-1][0], n + path[-1][1] - path[i // MEET][1]
                for c in text[i : i + MEET]:
                    state, emitted = self.step(state, c)
                    n += emitted
            if first:
                path.append((state, n))
            return state, n

        made = StateMap(work)
        made(START)
        return made


class Counter:
    """Token counts of texts."""

    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        self.pieces = regex.compile(PIECES)
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.counts = _Counts(Transducer(vocabulary))
        self.machine = Machine(self.counts.transducer)

    def _plain(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.pieces.findall(text)))

    def scan(self, text: str) -> int:
        """Tokens of a text without special strings; that of a long one from the maps of its chunks."""
        if len(text) <= CHUNK:
            return self._plain(text)
        self.counts.transducer.trim()
        maps = [self.machine.chunk(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [maps[i].then(maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        state, n = maps[0](START)
        return n + self.machine.rest(state)

    def __call__(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.scan(text)
        return sum(map(self.scan, self.special.split(text))) + len(self.special.findall(text))


_COUNTERS: dict[str, Counter] = {}


def _counter(name: str) -> Counter:
    """One a worker process: compiled tables serve all its tasks."""
    if name not in _COUNTERS:
        path = name
        if "/" not in name:
            import public_tokenizers

            path = str(public_tokenizers.path(name))
        _COUNTERS[name] = Counter(path)
    return _COUNTERS[name]


@keeps(("text",), ("n_bytes", "n_tokens", "over_limit"))
def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit. vocabulary: a path, or a name among the public tokenizers."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(vocabulary)
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column("text")]
            n = [count(x) for x in texts]
            more = [pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])]
            yield pa.record_batch([batch.column(c) for c in columns] + more, [*columns, "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, extended(docs, n_bytes="bigint", n_tokens="bigint", over_limit="boolean"))


def tokens_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).drop("text")
