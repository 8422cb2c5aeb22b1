"""Byte-pair encoding and decoding by a deterministic automaton.

The merges are compiled one after the other into an automaton whose arcs carry tokens and whose paths are exactly the
token sequences that merging can give. It starts as one state with a loop for every byte. The gadget of the merge
(u, v) -> w copies the state that u leads to, leaves out the arc v in the copy and sends u there, and adds the arc w
beside every arc u; w leads where v leads. Where u leads depends on u only, so a state is a token and the moment up to
which its copies count, and ``dropped`` and the moments of birth hold all gadgets.

Texts are split into words first. Over bytes, the automaton is made deterministic as it is used: a state is the set of
(state, bytes of the next token read so far), a transition is one look into a table, and every state knows the token
that ends there. Every prefix has exactly one path, so the tokens are read off backwards from the last state. Decoding
puts out the bytes on the arcs.

Null texts are empty: no token and the hash of nothing. Special tokens in a text are cut out first and get their own id.
Repeated rows are encoded one by one; an empty table gives no rows; only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .common import map_texts

_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenAutomaton:
    """The automaton over tokens. ``merges`` are pairs of ids in order, ``made`` the id that each gives."""

    def __init__(self, bytes_of: dict[int, bytes], merges: list[tuple[int, int]], made: list[int]):
        if len(set(made)) != len(made):
            raise ValueError("two merges give the same token")
        self.label = bytes_of
        self.born = {w: k for k, w in enumerate(made)}
        self.parts = dict(zip(made, merges))
        self.dropped: dict[int, dict[int, int]] = {}  # the copy of u's state made at moment k lacks v
        for k, (u, v) in enumerate(merges):
            self.dropped.setdefault(u, {})[v] = k
        # a token with its last part, the last part of that and so on, and the moment up to which copies count there
        self.lasts: dict[int, list] = {}
        self.firsts: dict[int, list] = {}
        for t in bytes_of:
            self.lasts[t], self.firsts[t] = self._spine(t, 1), self._spine(t, 0)
        self.known: dict[int, bool] = {}

    def _spine(self, token: int, side: int) -> list:
        out, upto = [], _NEVER
        while True:
            out.append((token, upto))
            if token not in self.parts:
                return out if side == 0 else [(a, b) for a, b in out if a in self.dropped]
            upto, token = self.born[token], self.parts[token][side]

    def arc(self, x: int, w: int) -> bool:
        """Whether the state that ``x`` leads to has an arc ``w``."""
        key = x << 20 | w
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            found = self.known[key] = self._arc(x, w)
        return found

    def _arc(self, x: int, w: int) -> bool:
        # x's state is a copy of the state of x's last part as it was when x was born, and so on. The arc w was added
        # where w's first part had an arc, that one where its first part had one, and so on.
        firsts = self.firsts[w]
        for a, before in self.lasts[x]:
            lacks = self.dropped[a]
            for b, upto in firsts:
                k = lacks.get(b)
                if k is not None and k < before and k <= upto:
                    return False
        return True


class ByteTable:
    """The automaton over bytes, made deterministic as it is used."""

    def __init__(self, tokens: TokenAutomaton, most_states: int = 250_000, searched: int = 8):
        self.tokens = tokens
        self.most = most_states
        self.searched = searched
        self.child: dict[int, int] = {}  # node << 8 | byte -> node
        self.ends = [-1]  # token that ends at a node
        for token, text in tokens.label.items():
            node = 0
            for b in text:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.ends)
                    self.ends.append(-1)
                node = self.child[key]
            self.ends[node] = token
        self.below: list[list[int]] = [[] for _ in self.ends]  # children of a node
        for key, node in self.child.items():
            self.below[key >> 8].append(node)
        self.many = [0] * len(self.ends)  # tokens below a node; children have higher numbers
        for key, node in sorted(self.child.items(), key=lambda x: -x[1]):
            self.many[key >> 8] += self.many[node] + (self.ends[node] >= 0)
        self.leads: dict[int, bool] = {}
        self._clear()

    def _leads(self, x: int, node: int) -> bool:
        """Whether a longer token below ``node`` can be an arc after ``x``; without one the pair need not be kept.

        It makes fewer states, not other results, so a node with many tokens below is taken as one that leads on.
        """
        if x < 0 or self.many[node] > self.searched or not self.many[node]:
            return self.many[node] > 0
        key = x << 20 | node
        found = self.leads.get(key)
        if found is None:
            todo, found = list(self.below[node]), False
            while todo and not found:
                n = todo.pop()
                found = self.ends[n] >= 0 and self.tokens.arc(x, self.ends[n])
                todo += self.below[n]
            if len(self.leads) > 1_000_000:
                self.leads.clear()
            self.leads[key] = found
        return found

    def _clear(self) -> None:
        self.number: dict[tuple, int] = {((-1, 0),): 0}
        self.open: list[tuple] = [((-1, 0),)]
        self.last = [-1]
        self.next: dict[int, int] = {}

    def _step(self, state: int, byte: int) -> int:
        going, end = [], -1
        for x, node in self.open[state]:
            node = self.child.get(node << 8 | byte, -1)
            if node < 0:
                continue
            token = self.ends[node]
            if token >= 0 and (x < 0 or self.tokens.arc(x, token)):
                end = token
            if self._leads(x, node):
                going.append((x, node))
        going.append((end, 0))
        key = tuple(going)
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.open)
            self.open.append(key)
            self.last.append(end)
        self.next[state << 8 | byte] = to
        return to

    def encode(self, word: bytes) -> list[int]:
        if len(self.open) > self.most:
            self._clear()
        state, go, path = 0, self.next.get, []
        for b in word:
            to = go(state << 8 | b, -1)
            state = to if to >= 0 else self._step(state, b)
            path.append(state)
        out, at, last, label = [], len(word), self.last, self.tokens.label
        while at:
            token = last[path[at - 1]]
            out.append(token)
            at -= len(label[token])
        out.reverse()
        return out


class Codec:
    """Encodes and decodes whole texts; keeps the ids of words it has seen."""

    def __init__(self, path: str, pattern: str, cached: int = 600_000):
        with open(path, encoding="utf-8") as file:  # a vocabulary installed with the library on every machine
            given = json.load(file)
        letters = byte_letters()
        vocab = given["model"]["vocab"]
        as_bytes = {name: bytes(letters[c] for c in name) for name in vocab if all(c in letters for c in name)}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in given["model"]["merges"]]
        special = {t["content"]: t["id"] for t in given["added_tokens"]}
        made = [vocab[a + b] for a, b in pairs]
        reachable = {*made, *(vocab[c] for c in letters)}
        label = {i: as_bytes[name] for name, i in vocab.items() if i in reachable}
        self.tokens = TokenAutomaton(label, [(vocab[a], vocab[b]) for a, b in pairs], made)
        self.table = ByteTable(self.tokens)
        self.labels = label | {i: t.encode() for t, i in special.items()}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.split = regex.compile(pattern)
        self.cached = cached
        self.ids: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        if len(self.ids) >= self.cached:
            self.ids.clear()
        found = self.ids[word] = np.asarray(self.table.encode(word.encode()), dtype="<u4").tobytes()
        return found

    def _plain(self, text: str) -> bytes:
        words, known = self.split.findall(text), self.ids
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            get = known.get
            return b"".join([get(w) or self._word(w) for w in words])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(t in text for t in self.special):
            return self._plain(text)
        return b"".join(
            np.asarray([self.special[p]], dtype="<u4").tobytes() if p in self.special else self._plain(p)
            for p in self.cut.split(text)
        )

    def decode(self, ids: bytes) -> str:
        label = self.labels
        return b"".join([label[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker: the automaton and what it has learnt serve all tasks that the worker runs."""
    return Codec(path, pattern)


def encode_digests(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Per document the number of tokens, and the SHA-256 of its ids and of the text decoded from them."""
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN

    def work():
        c = codec(path, pattern)

        def each(texts: list[str]) -> list:
            ids = [c.encode(t) for t in texts]
            return [
                np.asarray([len(i) // 4 for i in ids], dtype=np.int64),
                [hashlib.sha256(i).hexdigest() for i in ids],
                [hashlib.sha256(c.decode(i).encode()).hexdigest() for i in ids],
            ]

        return each

    return map_texts(df, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)


def encode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None
) -> DataFrame:
    """Per document its token ids."""
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN

    def work():
        c = codec(path, pattern)
        return lambda texts: [[np.frombuffer(c.encode(t), dtype="<u4").astype(np.int64) for t in texts]]

    return map_texts(df, id_col, text_col, "ids array<long>", work)
