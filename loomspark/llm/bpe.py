"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

A byte string's encoding is the one row of tokens in which each two neighbours are what BPE makes of their joined bytes.
So an encoder can read bytes from left to right: it keeps the places where the next token may begin, each as the trie node of the bytes
since and the clashes with the token before that these bytes still allow, and knows for each byte the one token that may end there. Such a
set of places is a state; states and their moves are made when first met (``Transducer.step``) and looked up from then on. As clashes are soon
narrowed to none, states hardly depend on the text before, and few are needed. Tokens on which all places agree are emitted every
``LOOKAHEAD`` bytes and at a pretoken's end. Whole pretokens are remembered too, with what their ids decode to: a pretoken begins and
ends at a character's boundary, so the decoded pieces join to the decoded text. The memories are emptied at a given size, so a task's memory is
bounded; what they hold changes the time taken, never the tokens.

Decoding feeds ids one by one into a UTF-8 state machine whose state is the bytes of an unfinished character.

Defined results: null is the empty text, with no tokens; empty texts likewise. Texts of any length are encoded whole.
Other columns are not read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from loomspark.llm.common import RELEASED, map_columns

#: Sizes of the memories where a caller names none.
MOST_STATES, MOST_WORDS = 600_000, 300_000
LOOKAHEAD = 512  # bytes after which decided tokens go out
#: In texts of these characters alone, the pattern below cuts as the tokenizers' one does, and ``re`` is faster than ``regex``.
_PLAIN = re.compile("[\t-\r -~¡-©«-±´¶-¸»¿-ſ‐-‧]*")
_PLAIN_CUT = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ſ]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_PLAIN_FOR = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_FREE = 1 << 60  # later than any rank


class Transducer:
    """Encodes byte strings by the ranks of a byte-level BPE."""

    def __init__(self, ranks: dict[bytes, int], states: int = MOST_STATES) -> None:
        self.ranks, self.most = ranks, states
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size = {v: len(k) for k, v in ranks.items()}
        # trie of the tokens: (node << 8 | byte) to the next node; per node its depth, the token that ends at it, or -1, and whether it goes on
        self.trie: dict[int, int] = {}
        self.depth, self.token_at, self.goes_on = [0], [-1], [True]
        for token, rank in ranks.items():
            node = 0
            for at, byte in enumerate(token, 1):
                nxt = self.trie.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.trie[node << 8 | byte] = len(self.depth)
                    self.depth.append(at)
                    self.token_at.append(-1)
                    self.goes_on.append(False)
                    self.goes_on[node] = True
                node = nxt
            self.token_at[node] = rank
        #: (piece, first byte of the next) to the pieces that join it, with the rank of what they make
        self.joins: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if token[:k] in ranks and token[k:] in ranks:
                    self.joins.setdefault((token[:k], token[k]), []).append((token[k:], rank))
        self.made: dict[int, bool] = {}
        self.split: dict[bytes, tuple[bytes, bytes]] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.clear()

    def clear(self) -> None:
        #: sets of clashes by number: (piece, rank) pairs; a token may not begin with a piece that is still free at that rank.
        self.clashes: list[frozenset[tuple[bytes, int]]] = [frozenset()]
        self.clash_number: dict[frozenset, int] = {self.clashes[0]: 0}
        self.narrowed: dict[tuple[int, int, int], int] = {}
        self.states: list[tuple[tuple[int, int], ...]] = [((0, 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        #: (state << 8 | byte) to the next state << 20 | 1 + the token that ends here, or 0.
        self.moves: dict[int, int] = {}

    def merge(self, word: bytes, stop: int = 1) -> list[int]:
        """BPE by its definition: join the neighbours of the lowest rank until none joins. Used on the vocabulary only."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > stop:
            rank, i = min((self.ranks.get(a + b, _FREE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == _FREE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def spine(self, token: int, left: bool) -> dict[bytes, int]:
        """The pieces that stand at one end of a token while BPE builds it, each with the rank at which it is used up."""
        own = self.spines[left].get(token)
        if own is None:
            piece, used, own = self.bytes_of[token], _FREE, {}
            while True:
                own[piece] = used
                if len(piece) == 1:
                    break
                used, piece = self.ranks[piece], self.halves(piece)[0 if left else 1]
            self.spines[left][token] = own
        return own

    def halves(self, word: bytes) -> tuple[bytes, bytes]:
        """The two pieces that BPE joins last."""
        both = self.split.get(word)
        if both is None:
            ids = self.merge(word, 2)
            both = self.split[word] = (self.bytes_of[ids[0]], self.bytes_of[ids[1]])
        return both

    def narrow(self, clash: int, depth: int, byte: int) -> int:
        """What is left of a set of clashes after the next token's byte at ``depth``.

        A negative number stands for all clashes of the token -1 - clash before: its right-hand piece joins a
        left-hand piece when both are there, before either is used up (at equal ranks the left join comes first).
        """
        known = self.narrowed.get((clash, depth, byte))
        if known is None:
            left: dict[bytes, int] = {}
            if clash < 0:
                for piece, used in self.spine(-1 - clash, False).items():
                    for other, rank in self.joins.get((piece, byte), ()):
                        at = max(rank, self.ranks[piece] if len(piece) > 1 else 0, self.ranks[other] if len(other) > 1 else 0)
                        if at < used:
                            left[other] = min(at, left.get(other, _FREE))
            else:
                left = {p: at for p, at in self.clashes[clash] if len(p) <= depth or p[depth] == byte}
            found = frozenset(left.items())
            known = self.clash_number.get(found)
            if known is None:
                known = self.clash_number[found] = len(self.clashes)
                self.clashes.append(found)
            self.narrowed[clash, depth, byte] = known
        return known

    def follows(self, clash: int, token: int) -> bool:
        """Whether BPE makes ``token`` at all, and keeps it apart from the token before."""
        ok = self.made.get(token)
        if ok is None:
            ok = self.made[token] = self.merge(self.bytes_of[token]) == [token]
        if not ok or not clash:
            return ok
        own = self.spine(token, True)
        return all(own.get(piece, -1) < at for piece, at in self.clashes[clash])

    def step(self, state: int, byte: int) -> int:
        """The move from a state by a byte, as ``moves`` holds it. Made once, then looked up."""
        places, ended, trie, goes_on = [], -1, self.trie, self.goes_on
        for node, clash in self.states[state]:
            nxt = trie.get(node << 8 | byte)
            if nxt is None:
                continue
            if clash:
                clash = self.narrow(clash, self.depth[node], byte)
            if ended < 0:
                token = self.token_at[nxt]
                if token >= 0 and self.follows(clash, token):
                    ended = token
            if goes_on[nxt]:
                places.append((nxt, clash))
        if ended >= 0:
            places.append((0, -1 - ended))
        key = tuple(places)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        move = self.moves[state << 8 | byte] = number << 20 | ended + 1
        return move

    def emit(self, last: list[int], end: int, out: list[int]) -> None:
        """Append to ``out`` the tokens up to place ``end``; ``last`` has for each place 1 + the token that ends there."""
        found = []
        while end:
            token = last[end - 1] - 1
            if token < 0:
                raise ValueError("a byte of the text is not in the vocabulary")
            found.append(token)
            end -= self.size[token]
        out += reversed(found)

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one pretoken."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        if len(self.moves) > self.most:
            self.clear()
        out: list[int] = []
        last: list[int] = []
        state, move_of = 0, self.moves.get
        for began in range(0, len(word), LOOKAHEAD):
            if began:
                # what all open places agree on goes out
                starts = {len(last) - self.depth[node] for node, _ in self.states[state]}
                while len(starts) > 1:
                    late = max(starts)
                    starts = starts - {late} | {late - self.size[last[late - 1] - 1]}
                agreed = starts.pop() if starts else 0
                self.emit(last, agreed, out)
                del last[:agreed]
            for byte in word[began : began + LOOKAHEAD]:
                move = move_of(state << 8 | byte)
                if move is None:
                    move = self.step(state, byte)
                last.append(move & 0xFFFFF)
                state = move >> 20
        self.emit(last, len(last), out)
        return out


class StreamDecoder:
    """Ids to text, one at a time; the state is the bytes of a character that has begun."""

    def __init__(self, bytes_of: dict[int, bytes], states: int = MOST_STATES) -> None:
        self.bytes_of, self.most = bytes_of, states
        self.plain: dict[int, str | None] = {}
        for i, b in bytes_of.items():
            try:
                self.plain[i] = b.decode()
            except UnicodeDecodeError:
                self.plain[i] = None
        self.moves: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    @staticmethod
    def split(data: bytes) -> tuple[str, bytes]:
        """Finished characters and the begun one. Walks the lead bytes: 0, 110, 1110 and 11110 announce the length."""
        at = 0
        while at < len(data):
            lead = data[at]
            need = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            if at + need > len(data):
                break
            at += need
        return data[:at].decode("utf-8", "surrogatepass"), data[at:]

    def text(self, ids: list[int]) -> str:
        plain = self.plain
        try:
            return "".join(map(plain.__getitem__, ids))
        except TypeError:  # a token that ends or begins inside a character
            pass
        out, begun = [], b""
        for i, part in zip(ids, map(plain.__getitem__, ids)):
            if not begun and part is not None:
                out.append(part)
                continue
            move = self.moves.get((begun, i))
            if move is None:
                if len(self.moves) > self.most:
                    self.moves.clear()
                move = self.moves[begun, i] = self.split(begun + self.bytes_of[i])
            out.append(move[0])
            begun = move[1]
        if begun:
            raise ValueError("the ids end inside a character")
        return "".join(out)


class Words(dict):
    """Pretokens that have been met: their ids as decimal numbers joined by commas, and what the decoder makes of the ids."""

    def __init__(self, codec: Codec, older: dict) -> None:
        super().__init__()
        self.codec, self.older = codec, dict(older)

    def __missing__(self, word: str) -> tuple[str, str]:
        known = self.older.get(word)
        if known is None:
            ids = self.codec.fst.encode(word.encode("utf-8", "surrogatepass"))
            back = self.codec.decoder.text(ids)
            known = (",".join(map(str, ids)), word if back == word else back)
        self[word] = known
        return known


class Codec:
    """Cuts texts by the tokenizers' pattern, encodes each match, and decodes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, states: int = MOST_STATES, words: int = MOST_WORDS) -> None:
        self.fst, self.pattern, self.most_words = Transducer(ranks, states), regex.compile(pattern), words
        self.plain_cut = pattern == _PLAIN_FOR
        self.decoder = StreamDecoder(self.fst.bytes_of, states)
        self.words = Words(self, {})

    def cut(self, text: str) -> list[str]:
        if self.plain_cut and _PLAIN.fullmatch(text):
            return _PLAIN_CUT.findall(text)
        return self.pattern.findall(text)

    def trip(self, text: str) -> tuple[str, str]:
        """Ids as decimal numbers joined by commas, and the text that they decode to."""
        if len(self.words) > self.most_words:  # what has not been met since the last change goes
            self.words = Words(self, self.words)
        got = list(map(self.words.__getitem__, self.cut(text)))
        if not got:
            return "", ""
        named, back = zip(*got)
        return ",".join(named), "".join(back)

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids, and the same as decimal numbers joined by commas."""
        named, _ = self.trip(text)
        return [int(i) for i in named.split(",") if i], named

    def decode(self, ids: list[int]) -> bytes:
        return self.decoder.text(ids).encode("utf-8", "surrogatepass")


_USUAL = gc.get_threshold()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, states: int, words: int) -> Codec:
    """One for each worker process; the vocabulary file is read where the worker runs.

    The memories hold millions of long-lived objects without cycles, so the collector is told to look at them rarely.
    """
    gc.set_threshold(500_000, 1_000, 1_000)
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern, states, words)


def _release() -> None:
    """A codec and its words refer to each other, so it takes the collector to free them."""
    if codec.cache_info().currsize:
        codec.cache_clear()
        gc.set_threshold(*_USUAL)
        gc.collect()


RELEASED.append(_release)


def round_trip(docs: DataFrame, path: str, pattern: str, ids: bool = False, states: int = MOST_STATES, words: int = MOST_WORDS) -> DataFrame:
    """Per document: n_tokens, digests of the ids and of the decoded bytes; with ``ids`` the token ids and decoded text also.

    ``states`` and ``words`` bound a worker's memories.
    """
    made = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>", "decoded": "string"} if ids else {})

    def run(texts: list[str | None]) -> list[list]:
        own, out = codec(path, pattern, states, words), [[] for _ in made]
        for t in texts:
            named, back = own.trip(t or "")
            row = [named.count(",") + 1 if named else 0, hashlib.sha256(named.encode()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest()]
            for col, v in zip(out, row + ([[int(i) for i in named.split(",") if i], back] if ids else []), strict=True):
                col.append(v)
        return out

    return map_columns(docs, ["doc_id"], ["text"], made, run)
