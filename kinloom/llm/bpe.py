"""Operator 3: byte-level BPE encoding and decoding by finite-state machines.

Encoding. A sequence of tokens is what the merges make of its bytes if and only if each token is
what the merges make of its own bytes, and each neighbouring pair is what the merges make of the
pair's bytes (Berglund et al., "Constructing a BPE Tokenization DFA", 2024). That is a
non-deterministic transducer: it reads bytes along the trie of tokens and may end a token wherever
the pair with the one before is allowed. It is determinised lazily: a state is the set of open
hypotheses with the tokens they have not yet emitted; the part that all of them share is emitted
when it becomes common, after a lookahead that the longest token bounds. Transitions are kept once
computed, and so are the ids of whole pre-tokens, both up to a fixed number and from one task of a
worker to the next; a table that is full is emptied, also in the middle of a pre-token.

Decoding. Ids are fed one after another; their bytes run through an incremental UTF-8 machine
whose state is the bytes of an unfinished character. Transitions for whole tokens are kept.

Tables are built in the tasks from the rank file, whose path is a parameter.
"""

from __future__ import annotations

import base64
import contextlib
import functools
import gc
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bounds on what a worker keeps between pre-tokens, texts and tasks: some 200 MB.
MAX_STATES = 250_000
MAX_WORDS = 200_000
#: Longer pre-tokens are not kept.
MAX_WORD = 64

# Texts below U+0250 are split by re, whose classes are spelt out; others by regex. Fixed values.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼½¾"
_BLANKS = "\t-\r \x85\xa0"
_BEYOND = re.compile("[^\x00-ɏ]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[bytes]:
    """Byte-pair merging itself, lowest rank first, leftmost first, by ranks under `below`; used to take tokens apart."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class State(dict):
    """A state of the determinised transducer: byte to (next state, ids that leave), filled on demand.

    key: the token emitted last, or -1, and the hypotheses, each a trie node and the tokens not yet emitted.
    """

    __slots__ = ("final", "key", "machine")

    def __init__(self, machine: BytePairTransducer, key: tuple):
        self.machine, self.key, self.final = machine, key, None

    def __missing__(self, byte: int) -> tuple[State, bytes]:
        return self.machine.move(self, byte)


class Words(dict):
    """The ids of pre-tokens, encoded when first asked for."""

    def __init__(self, machine: BytePairTransducer, most: int):
        self.machine, self.most = machine, most

    def __missing__(self, word: str) -> bytes:
        ids = self.machine.encode_piece(word.encode("utf-8", "surrogatepass"))
        if len(word) <= MAX_WORD:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


class BytePairTransducer:
    def __init__(self, ranks: dict[bytes, int], pattern: str, max_states: int = MAX_STATES, max_words: int = MAX_WORDS):
        import regex

        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = dict(map(reversed, ranks.items()))
        self.split_any = regex.compile(pattern).findall
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_BLANKS}{_LETTERS}{_DIGITS}]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_DIGITS}]").replace(r"\s", f"[{_BLANKS}]").replace(r"\S", f"[^{_BLANKS}]")
        self.split_plain = None if "\\p" in plain else re.compile(plain).findall
        # The trie: node * 256 + byte to node; the token that ends at a node.
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        self.inner: list[bool] = [False]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = nxt
            self.token_at[node] = rank
        self.pair: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], list] = {}
        self.words = Words(self, max_words)
        self.states: dict[tuple, State] = {}
        self.start = State(self, (-1, (0,)))

    def _forget(self) -> None:
        """Drop all states; one that is being walked from goes on to states made anew."""
        for state in (self.start, *self.states.values()):  # states point at each other, so they would not go by themselves
            state.clear()
        self.states.clear()

    def clear(self) -> None:
        """Drop all that was kept for speed."""
        self.words.clear()
        self.pair.clear()
        self.edges.clear()
        self._forget()

    def _allowed(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (-1: begin); remembered in `pair`."""
        if len(self.pair) >= 2 * self.max_states:
            self.pair.clear()
            self.edges.clear()
        token = self.bytes_of[b]
        if a < 0:
            ok = merge_bytes(token, self.ranks) == [token]
        else:
            ok = self.pair.get(b)  # after nothing
            ok = (self._allowed(-1, b) if ok is None else ok) and self._pair_stays(self._edge(a, -1), self._edge(b, 0))
        self.pair[(a + 1) << 24 | b] = ok
        return ok

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at the right (-1) or left (0) edge of a token as its merges are undone, last
        first: pairs of bytes and the rank of the merge that ends them."""
        got = self.edges.get((token, side))
        if got is None:
            got, part, ends = [], self.bytes_of[token], 1 << 60
            while True:
                got.append((part, ends))
                if len(part) == 1:
                    break
                ends = self.ranks[part]
                part = merge_bytes(part, self.ranks, ends)[side]
            self.edges[token, side] = got
        return got

    def _pair_stays(self, left: list[tuple[bytes, int]], right: list[tuple[bytes, int]]) -> bool:
        """No two parts that stand at the border at the same time merge before either is merged away
        from it; of equal ranks the leftmost goes first."""
        i, j, rank_of = 0, 0, self.ranks.get
        while True:
            (a, a_ends), (b, b_ends) = left[i], right[j]
            rank = rank_of(a + b, 1 << 60)
            if rank < 1 << 60 and rank < a_ends and rank <= b_ends:
                return False
            # Go back to before the later of the two was made.
            a_made = left[i + 1][1] if i + 1 < len(left) else -1
            b_made = right[j + 1][1] if j + 1 < len(right) else -1
            if a_made < 0 and b_made < 0:
                return True
            if a_made > b_made:
                i += 1
            else:
                j += 1

    def _ids(self, tokens: Iterable[int]) -> bytes:
        return b"".join([t.to_bytes(4, "little") for t in tokens])

    def move(self, state: State, byte: int) -> tuple[State, bytes]:
        """One step of the subset construction."""
        last, *hypotheses = state.key
        child, token_at, inner, pair = self.child, self.token_at, self.inner, self.pair
        after, shared = [], True
        for h in hypotheses:
            node = child.get(h[0] << 8 | byte)
            if node is not None:
                if inner[node]:
                    after.append((node, *h[1:]))
                    shared = shared and len(h) > 1
                token = token_at[node]
                if token >= 0:
                    before = h[-1] if len(h) > 1 else last
                    ok = pair.get((before + 1) << 24 | token)
                    if self._allowed(before, token) if ok is None else ok:
                        after.append((0, *h[1:], token))
        out = b""
        if shared:  # every hypothesis has open tokens: emit what they have in common
            first = min(after, key=len)
            same = len(first)
            for h in after:
                while h[1:same] != first[1:same]:
                    same -= 1
            if same > 1:
                last, out = first[same - 1], self._ids(first[1:same])
                after = [(h[0], *h[same:]) for h in after]
            if all(len(h) > 1 for h in after):
                last = -1  # no longer asked for
        key = (last, *after)
        to = self.states.get(key)
        if to is None:
            if len(self.states) >= self.max_states:
                self._forget()
            to = self.states[key] = State(self, key)
        got = state[byte] = (to, out)
        return got

    def encode_piece(self, piece: bytes) -> bytes:
        """The ids of one pre-token, as little-endian unsigned 32-bit integers."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return whole.to_bytes(4, "little")
        state, out = self.start, []
        for byte in piece:
            state, ids = state[byte]
            if ids:
                out.append(ids)
        if state.final is None:
            state.final = self._ids(next(h[1:] for h in state.key[1:] if not h[0]))
        out.append(state.final)
        return b"".join(out)

    def split(self, text: str) -> list[str]:
        return self.split_plain(text) if self.split_plain and not _BEYOND.search(text) else self.split_any(text)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, self.split(text)))


def utf8_step(pending: bytes, byte: int) -> tuple[str, bytes]:
    """Characters that are final after one more byte, and the bytes that still wait.

    What no character can begin or go on with becomes U+FFFD, one for each maximal part.
    """
    if not pending:
        if byte < 0x80:
            return chr(byte), b""
        return ("", bytes([byte])) if 0xC2 <= byte <= 0xF4 else ("�", b"")
    low, high = 0x80, 0xBF
    if len(pending) == 1:
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(pending[0], low)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(pending[0], high)
    if not low <= byte <= high:
        text, rest = utf8_step(b"", byte)
        return "�" + text, rest
    pending += bytes([byte])
    need = 2 if pending[0] < 0xE0 else 3 if pending[0] < 0xF0 else 4
    return (pending.decode(), b"") if len(pending) == need else ("", pending)


class StreamingDecoder:
    """Ids in, text out; what is not yet a whole character is held back."""

    def __init__(self, ranks: dict[bytes, int]):
        self.token = dict(map(reversed, ranks.items()))
        self.steps: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.pending = b""
        self.text: list[str] | None = None

    def feed(self, ids: Iterable[int]) -> Iterator[str]:
        steps = self.steps
        for i in ids:
            got = steps.get((self.pending, i))
            if got is None:
                if len(steps) >= MAX_STATES:
                    steps.clear()
                text, pending = "", self.pending
                for byte in self.token[i]:
                    more, pending = utf8_step(pending, byte)
                    text += more
                got = steps[self.pending, i] = (text, pending)
            self.pending = got[1]
            yield got[0]

    def finish(self) -> str:
        rest, self.pending = self.pending, b""
        return "�" if rest else ""

    def decode(self, ids: np.ndarray) -> str:
        """Text of all ids. Stretches of tokens that are whole characters leave the machine in its
        first state, so they are joined at once; the others are fed to it."""
        if self.text is None:
            size = max(self.token, default=-1) + 1
            self.text, self.whole = [""] * size, np.zeros(size, bool)
            for i, b in self.token.items():
                try:
                    self.text[i], self.whole[i] = b.decode(), True
                except UnicodeDecodeError:
                    pass
        out, at = [], 0
        for i in [*np.flatnonzero(~self.whole[ids]).tolist(), len(ids)]:
            if i > at:
                if self.pending:
                    out.extend(self.feed([ids[at]]))
                    at += 1
                out.extend(map(self.text.__getitem__, ids[at:i].tolist()))
            if i < len(ids):
                out.extend(self.feed([int(ids[i])]))
            at = i + 1
        return "".join(out) + self.finish()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The bytes of the ids as they are, whether or not they form text."""
        return b"".join(map(self.token.__getitem__, ids))


@contextlib.contextmanager
def _in_use(encoder: BytePairTransducer, keep: bool):
    """Without garbage collection: the machines are large and take their cycles apart themselves, so
    walking them again and again only costs time. Unless they are kept, tables are dropped at the
    end of the task, also if it fails or is not read to its end."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        if not keep:
            encoder.clear()


@functools.lru_cache(maxsize=2)
def _machines(path: str, pattern: str) -> tuple[BytePairTransducer, StreamingDecoder]:
    ranks = read_ranks(path)
    return BytePairTransducer(ranks, pattern), StreamingDecoder(ranks)


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: bool = True) -> DataFrame:
    """doc_id, ids (array<int>), n_tokens for every row; a null text is the empty text. keep: see `round_trip`."""

    def run(batches):
        encoder, _ = _machines(path, pattern)
        with _in_use(encoder, keep):
            for batch in batches:
                ids = [np.frombuffer(encoder.encode(t or ""), "<u4").astype(np.int32) for t in batch.column("text").to_pylist()]
                n = [len(x) for x in ids]
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat, pa.array(n, pa.int64())], ["doc_id", "ids", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")


def round_trip(docs: DataFrame, path: str, pattern: str, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row: encoded, then decoded as a stream.

    A null text is the empty text, which has no tokens. Repeated rows give equal rows; an empty
    table gives an empty result; other columns are not read.

    keep: whether the tables of a worker outlive a task, some 350 MB of memory that save the next task
    a third of its time. For jobs whose workers go on to other steps, False.
    """

    sha = lambda b: hashlib.sha256(b).hexdigest()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        encoder, decoder = _machines(path, pattern)
        with _in_use(encoder, keep):
            for batch in batches:
                n, ids_sha, text_sha = [], [], []
                for t in batch.column("text").to_pylist():
                    ids = encoder.encode(t or "")
                    n.append(len(ids) // 4)
                    ids_sha.append(sha(ids))
                    text_sha.append(sha(decoder.decode(np.frombuffer(ids, "<u4")).encode("utf-8", "surrogatepass")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
