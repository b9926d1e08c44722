"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. After a token it is in that token's state, and an arc for the next token exists where the
two can stand side by side in an encoding. It starts with the base symbols, one state each and arcs between all of them, and every merge
(left, right) -> whole adds one gadget, in order of rank:

* ``whole`` becomes a token whose state is a copy of the present state of ``right``;
* a state that has an arc for ``left`` gets one for ``whole``, since left can be followed by right there;
* the arc for ``right`` leaves the state of ``left``: side by side they are ``whole`` now.

So a string has exactly one path, which is its encoding. A state is kept as its origin (the state copied, and when) and the rank
at which it lost an arc, in arrays that grow by one row per merge; arcs are looked up there and kept in a table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgertally.llm import pretokens
from ledgertally.llm.tables import slices

_START = -1
_NONE = -2


class Automaton:
    """States are token ids; `_START` is the state before the first token, which has every arc."""

    def __init__(self, file: pretokens.TokenizerFile):
        size = max(file.vocab.values(), default=-1) + 1
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.made = np.full(size, -1, np.int64)  # the rank of the gadget that made the token; base symbols: -1
        self.cut: dict[tuple[int, int], int] = {}  # (state, token): the rank at which that arc left the state
        self.arcs: dict[int, bool] = {}
        base = [c + s for c in pretokens.byte_letters() for s in {"", file.suffix}]
        self.token_of: dict[str, int] = {c: file.vocab[c] for c in base if c in file.vocab}
        for rank, (left, right) in enumerate(file.merges):
            self._gadget(rank, file.vocab[left], file.vocab[right], file.vocab[left + right], left + right)
        self.letters = _letter_table(self.token_of, file.suffix)
        self.left, self.right, self.made = self.left.tolist(), self.right.tolist(), self.made.tolist()

    def _gadget(self, rank: int, left: int, right: int, whole: int, name: str) -> None:
        if name in self.token_of:
            raise ValueError(f"two merges make {name!r}")
        if self._open(left, right, rank):  # else no path holds the two side by side, and the merge never happens
            self.left[whole], self.right[whole], self.made[whole] = left, right, rank
            self.token_of[name] = whole
        self.cut.setdefault((left, right), rank)

    def _open(self, state: int, token: int, now: int) -> bool:
        """Whether the state has an arc for the token after the gadgets of ranks below `now`."""
        while True:
            # The arc for a merged token came from the arc for its left part, at the rank of its gadget. The state came
            # from the state of its right part. Undo whichever of the two is later; before that, only a cut ends an arc.
            cut = self.cut.get((state, token))
            if cut is not None and cut < now:
                return False
            of_state, of_token = self.made[state], self.made[token]
            if of_state < 0 and of_token < 0:
                return True
            if of_token > of_state:
                if self.left[token] == self.right[token] == state:
                    return False  # a third of three equal neighbours stays alone on the right
                now, token = of_token, self.left[token]
            elif of_state > of_token:
                now, state = of_state, self.right[state]
            else:  # whole after whole: its arc came with the gadget that made the state
                now, state, token = of_state, self.right[state], self.left[token]

    def arc(self, state: int, token: int) -> bool:
        """Whether two tokens can stand side by side; from the start every token can."""
        key = (state << 32) | token
        found = self.arcs.get(key)
        if found is None:
            found = self.arcs[key] = self._open(state, token, 1 << 60)
        return found

    def encode(self, word: str, suffix: str) -> list[int]:
        """Token ids of a word in byte letters, whose last token has the suffix: at each place the one token that ends there on a path from the start.

        Tokens are read off the letter table from each place that a path reaches, the first places first; a place that a longer token has reached is not reached again.
        """
        size, arcs, table, last = len(word), self.arcs, self.letters, 2 if suffix else 1
        states = [_START] + [_NONE] * size  # the state after so many letters
        froms = [0] * (size + 1)
        for begin in range(size):
            state = states[begin]
            if state == _NONE:
                continue
            node, high = table, state << 32
            for end in range(begin + 1, size + 1):
                node = node[0].get(word[end - 1])
                if node is None:
                    break
                token = node[last if end == size else 1]
                if token is not None and states[end] == _NONE:
                    found = not begin or arcs.get(high | token)
                    if found is None:
                        found = self.arc(state, token)
                    if found:
                        states[end], froms[end] = token, begin
            if states[size] != _NONE:
                break
        path, end = [], size
        while end:
            path.append(states[end])
            end = froms[end]
        return path[::-1]


def _letter_table(token_of: dict[str, int], suffix: str) -> tuple:
    """Transitions by letters from the first letter of a token on: a node is its transitions, the token that its letters are within a word, and the one that they are at its end."""
    nodes: dict[str, list] = {"": [{}, None, None]}

    def node_of(letters: str) -> list:
        node = nodes.get(letters)
        if node is None:
            node = nodes[letters] = [{}, None, None]
            node_of(letters[:-1])[0][letters[-1]] = node
        return node

    for name, token in token_of.items():
        if not suffix:
            node_of(name)[1] = token
        elif name.endswith(suffix):
            node_of(name[: -len(suffix)])[2] = token
        else:
            node_of(name)[1] = token
    return tuple(nodes[""])


class Coder:
    """Encodes whole texts; `remembered` pre-tokens keep their path as text of ids and of arc labels."""

    def __init__(self, file: pretokens.TokenizerFile):
        self.file, self.automaton = file, Automaton(file)
        self.letters = pretokens.byte_letters()
        self.known: dict[str | int, tuple[str, str, int]] = {}

    def path(self, piece: str | int) -> tuple[str, str, int]:
        """Ids and labels of a pre-token (or special id), each joined by blanks, and how many there are."""
        if isinstance(piece, int):
            ids = [piece]
        else:
            ids = self.automaton.encode("".join([self.letters[b] for b in piece.encode()]), self.file.suffix)
        found = (" ".join(map(str, ids)), self.decode(ids), len(ids))
        self.known[piece] = found
        return found

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined by blanks, as a file without a decoder of its own asks for."""
        names = self.file.names
        return " ".join([names[i] for i in ids])

    def encode(self, text: str) -> tuple[str, str, int]:
        if len(self.known) > pretokens.REMEMBERED // 2:  # 900 bytes each, and other stages share the executor
            self.known.clear()
        if len(self.automaton.arcs) > 3 * pretokens.REMEMBERED:
            self.automaton.arcs.clear()
        known, path = self.known, self.path
        found = [known.get(piece) or path(piece) for piece in self.file.pieces(text)]
        return " ".join([f[0] for f in found]), " ".join([f[1] for f in found]), sum([f[2] for f in found])


_coder: tuple[str, Coder] | None = None


def encoded(documents: DataFrame, tokenizer_path: str, digests: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, and ids (array) with the decoded text, or the SHA-256 digests of both.

    A null or empty text has no ids and decodes to the empty text. Every input row gives one row, repeated or null doc_ids too;
    other columns are not read. The tokenizer file is read where the plan is built and sent to the tasks (a few MB); each
    worker compiles its automaton once.
    """
    file = documents.sparkSession.sparkContext.broadcast(pretokens.read(tokenizer_path))
    kind = documents.schema["doc_id"].dataType.simpleString()
    outputs = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _coder
        if _coder is None or _coder[0] != tokenizer_path:
            _coder = (tokenizer_path, Coder(file.value))
        for batch in slices(batches):
            ids, labels, counts = [], [], []
            for text in batch.column("text").to_pylist():
                path, decoded, n = _coder[1].encode(text or "")
                counts.append(n)
                if digests:
                    ids.append(hashlib.sha256(path.encode()).hexdigest())
                    labels.append(hashlib.sha256(decoded.encode()).hexdigest())
                else:
                    ids.append([int(i) for i in path.split()])
                    labels.append(decoded)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string() if digests else pa.list_(pa.int32())), pa.array(labels, pa.string())],
                ["doc_id", "n_tokens", *(o.split(" ")[0] for o in outputs.split(", "))],
            )

    return documents.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, n_tokens bigint, {outputs}")
