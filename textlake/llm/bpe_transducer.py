"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Compilation. Every token is merged from its bytes once; its last merge gives
the only pair of tokens it is made of. Two tokens a, b may follow each other in
an encoding exactly if no merge crosses their boundary while a and b are formed
(``Rules.allowed``), and a sequence of tokens is the encoding of its bytes
exactly if all its neighbours may follow each other.

Transducer. A nondeterministic machine reads bytes down a trie of the tokens
and may emit a token wherever one ends, if it may follow the one before. Each
prefix of a piece has one encoding, so a set of hypotheses holds one entry per
boundary from which the trie still leads on. ``Transducer`` determinises this on
demand: a state is such a set, and what all its entries have in common is
emitted at once. A boundary lives no longer than the longest token, which bounds
the lookahead. States are cached and dropped together when there are too many.

Decoding runs a UTF-8 state machine, stepped by whole tokens; the bytes of an
unfinished character wait for the next token.
"""

from __future__ import annotations

import base64
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import row_blocks

#: Cached states of a transducer, cached pieces and the longest piece that is cached.
STATES, PIECES, PIECE_BYTES = 100_000, 500_000, 64
#: Text bytes encoded (or id bytes decoded) to one output batch, and ids per decoding step.
BLOCK, STEP = 1 << 20, 1 << 16
#: Characters from which the pieces of a text are taken one by one instead of as a list.
LONG_TEXT = 1 << 20
ROOT = 0


def read_ranks(lines) -> dict[bytes, int]:
    """Token bytes -> rank from the lines of a rank file (base64, blank, rank)."""
    return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
    """Parts of ``piece`` after joining the neighbours of lowest rank, leftmost
    first, until none is left, and the last pair joined. Plain and quadratic:
    for single tokens at compile time."""
    parts, last = [piece[i:i + 1] for i in range(len(piece))], None
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
        if rank == 1 << 62:
            break
        last = (parts[i], parts[i + 1])
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


class Rules:
    """The merges of a vocabulary: its trie, and which tokens may follow each other."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary must hold every single byte")
        self.ranks = ranks
        self.split: dict[int, tuple[int, int]] = {}
        #: Tokens that no merges form: only a whole piece of these bytes becomes one.
        self.whole: dict[bytes, int] = {}
        self.trie: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.inner: list[bool] = [False]
        self.depth: list[int] = [0]
        self.longest = max(map(len, ranks))
        for text, rank in ranks.items():
            if len(text) > 1:
                parts, last = merge(text, ranks)
                if len(parts) > 1:
                    self.whole[text] = rank
                    continue
                left, right = ranks[last[0]], ranks[last[1]]
                if any(len(side) > 1 and ranks[side] > rank for side in last):
                    raise ValueError(f"token {rank} is made of tokens of higher rank, so its vocabulary fits no list of merges")
                self.split[rank] = (left, right)
            self._add(text, rank)
        self.text = {rank: text for text, rank in ranks.items()}
        #: Merges by left token and the first byte of the right one, and the ranks of each left token in order.
        self.joins: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.ranks_of: dict[int, list[int]] = {}
        for rank in sorted(self.split):
            x, y = self.split[rank]
            self.joins.setdefault((x, self.text[y][0]), []).append((rank, y))
            self.ranks_of.setdefault(x, []).append(rank)
        self.tails: dict[int, tuple] = {}

    def _add(self, text: bytes, rank: int) -> None:
        node = ROOT
        for b in text:
            key = node << 8 | b
            if key not in self.trie:
                self.trie[key] = len(self.token)
                self.inner[node] = True
                self.token.append(-1)
                self.inner.append(False)
                self.depth.append(self.depth[node] + 1)
            node = self.trie[key]
        self.token[node] = rank

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens that stand at an edge of ``token`` while it is formed, each with the rank that ends it."""
        out, ends = [], 1 << 62
        while True:
            out.append((token, ends))
            if token not in self.split:
                return out
            token, ends = self.split[token][side], token

    def tail(self, token: int) -> tuple:
        """What of ``token`` matters for the token after it: (x, rank) of the
        tokens at its right edge, with the highest rank at which x may still be
        joined with something to its right. Equal tails allow the same tokens."""
        if token not in self.tails:
            cuts = ((x, bisect_left(self.ranks_of.get(x, ()), ends)) for x, ends in self._edge(token, 1))
            self.tails[token] = tuple((x, self.ranks_of[x][n - 1]) for x, n in cuts if n)
        return self.tails[token]

    def limits(self, tail: tuple, byte: int) -> tuple:
        """(y, rank) of the merges that a following token is in danger of: y, beginning
        with ``byte``, at its left edge until ``rank`` or later would be joined with the tail."""
        least: dict[int, int] = {}
        for x, most in tail:
            for rank, y in self.joins.get((x, byte), ()):
                if rank <= most and rank < least.get(y, 1 << 62):
                    least[y] = rank
        return tuple(sorted(least.items()))

    def still(self, limits: tuple, at: int, byte: int) -> tuple:
        """The limits whose y goes on with ``byte`` at its position ``at``, or ended before."""
        return tuple(x for x in limits if len(t := self.text[x[0]]) <= at or t[at] == byte)

    def allowed(self, limits: tuple, token: int) -> bool:
        """Whether no merge across the boundary happens while ``token`` is formed:
        it would rank before the merge that ends the left part (see ``tail``) and not
        after the one that ends the right part (of equal ranks the leftmost is first)."""
        if limits:
            least = dict(limits)
            return all(least.get(y, 1 << 63) > ends for y, ends in self._edge(token, 0))
        return True


class State(dict):
    """One state: its moves, byte -> (next state, token that ends), as far as they were needed."""

    __slots__ = ("entries", "machine")

    def __init__(self, entries: tuple, machine: Transducer):
        super().__init__()
        self.entries, self.machine = entries, machine

    def __missing__(self, byte: int) -> tuple[State, int]:
        move = self[byte] = self.machine.move(self.entries, byte)
        return move


class Transducer:
    """Bytes of a piece in, token ids out; states are made when first reached.

    A state holds the open boundaries, oldest first: the trie node of the bytes
    since, and what the token before forbids of them. Each move names the token
    that ends at the byte read. A boundary's encoding is found by stepping back
    over these tokens, so tokens are emitted up to where the steps of all open
    boundaries meet.
    """

    def __init__(self, rules: Rules):
        self.rules = rules
        self.size = {token: len(text) for text, token in rules.ranks.items()}
        self.states: dict[tuple, State] = {}
        self.start = self._state((((), ROOT),))

    def _state(self, entries: tuple) -> State:
        state = self.states.get(entries)
        if state is None:
            if len(self.states) >= STATES:
                for old in self.states.values():
                    old.clear()
                self.states.clear()
                self.states[self.start.entries] = self.start
            state = self.states[entries] = State(entries, self)
        return state

    def move(self, entries: tuple, byte: int) -> tuple[State, int]:
        """The subset step: entries that the byte leads on, and the new boundary."""
        rules, live, ended = self.rules, [], -1
        for before, node in entries:
            child = rules.trie.get(node << 8 | byte)
            if child is None:
                continue
            limits = rules.limits(before, byte) if node == ROOT else rules.still(before, rules.depth[node], byte) if before else before
            if rules.inner[child]:
                live.append((limits, child))
            token = rules.token[child]
            if token >= 0 and ended < 0 and rules.allowed(limits, token):
                ended = token
        return self._state((*live, (rules.tail(ended), ROOT))), ended

    def _read(self, state: State, data: bytes, ended: list[int]) -> State:
        """Moves over ``data``, adding the token that ends at each byte; the state reached."""
        for byte in data:
            state, token = state[byte]
            ended.append(token)
        return state

    def encode(self, piece: bytes) -> list[int]:
        if piece in self.rules.whole:
            return [self.rules.whole[piece]]
        if len(piece) > self.rules.longest:
            return [token for part in self.stream(piece[i:i + STEP] for i in range(0, len(piece), STEP)) for token in part]
        ended: list[int] = []
        self._read(self.start, piece, ended)
        return self._back(ended, len(ended))

    def stream(self, chunks):
        """Lists of the ids that are certain after each chunk of a piece, and of the rest at its end."""
        state: State = self.start
        ended: list[int] = []
        for data in chunks:
            state = self._read(state, data, ended)
            if len(ended) > 2 * self.rules.longest:
                sure = self._shared(state, ended)
                yield self._back(ended, sure)
                del ended[:sure]
        yield self._back(ended, len(ended))

    def _back(self, ended: list[int], end: int) -> list[int]:
        """The tokens that lead to the boundary ``end``."""
        out = []
        while end > 0:
            out.append(ended[end - 1])
            end -= self.size[out[-1]]
        return out[::-1]

    def _shared(self, state: State, ended: list[int]) -> int:
        """The latest boundary that the encodings of all open boundaries pass."""
        at = [len(ended) - self.rules.depth[node] for _, node in state.entries]
        while min(at) != max(at):
            i = at.index(max(at))
            at[i] -= self.size[ended[at[i] - 1]]
        return at[0]


class Encoder(dict):
    """Texts to packed ids; as a dict it maps the pieces met so far to their packed ids."""

    def __init__(self, rules: Rules, pattern: str):
        import regex

        super().__init__()
        self.machine, self.pattern = Transducer(rules), regex.compile(pattern)
        self.packed = {token: token.to_bytes(4, "little") for token in rules.text}

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        packed = b"".join(map(self.packed.__getitem__, self.machine.encode(data)))
        if len(data) <= PIECE_BYTES:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, little-endian unsigned 32-bit integers."""
        if len(text) < LONG_TEXT:
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        return b"".join(self[m.group()] for m in self.pattern.finditer(text))


# --- UTF-8 state machine: ACCEPT, 1 to 3 bytes missing, four leads whose next byte is limited, BROKEN
ACCEPT, BROKEN = 0, 8


def _byte_moves() -> np.ndarray:
    """Next state for (state, byte)."""
    t = np.full((9, 256), BROKEN, np.uint8)
    t[0, :0x80] = ACCEPT
    t[0, 0xC2:0xE0], t[0, 0xE1:0xF0], t[0, 0xF1:0xF4] = 1, 2, 3
    t[0, 0xE0], t[0, 0xED], t[0, 0xF0], t[0, 0xF4] = 4, 5, 6, 7
    t[1, 0x80:0xC0], t[2, 0x80:0xC0], t[3, 0x80:0xC0] = ACCEPT, 1, 2
    t[4, 0xA0:0xC0], t[5, 0x80:0xA0], t[6, 0x90:0xC0], t[7, 0x80:0x90] = 1, 1, 2, 2
    return t


class Decoder:
    """Ids to text, a few at a time. ``feed`` returns the text that is complete;
    malformed bytes become U+FFFD, one for each longest start of a character."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {rank: text for text, rank in ranks.items()}
        self.moves = _byte_moves()
        top, longest = max(self.bytes_of) + 1, max(map(len, ranks))
        state = np.repeat(np.arange(9, dtype=np.uint8)[:, None], top, axis=1)
        grid, length = np.zeros((longest, top), np.uint8), np.zeros(top, np.int64)
        for rank, text in self.bytes_of.items():
            grid[:len(text), rank], length[rank] = list(text), len(text)
        for at in range(longest):
            on = length > at
            state[:, on] = self.moves[state[:, on], grid[at, on]]
        #: Next state for (state, token), as bytes.
        self.token_moves = [row.tobytes() for row in state]
        self.reset()

    def reset(self) -> None:
        self.state, self.held = ACCEPT, b""

    def feed(self, ids: list[int]) -> str:
        state, moves = self.state, self.token_moves
        for i in ids:
            state = moves[state][i]
        data = self.held + b"".join(map(self.bytes_of.__getitem__, ids))
        if state == BROKEN:  # no state leads out of it
            return self._repair(data)
        cut = len(data)
        if state != ACCEPT:
            cut -= 1
            while data[cut] & 0xC0 == 0x80:
                cut -= 1
        self.state, self.held = state, data[cut:]
        return data[:cut].decode()

    def _repair(self, data: bytes) -> str:
        out, start, state = [], 0, ACCEPT
        for at, byte in enumerate(data):
            after = int(self.moves[state, byte])
            if after == BROKEN:
                out.append("�")
                if state != ACCEPT:
                    after = int(self.moves[ACCEPT, byte])
                    if after == BROKEN:
                        out.append("�")
                start, after = (at, after) if after != BROKEN else (at + 1, ACCEPT)
            if after == ACCEPT:
                out.append(data[start:at + 1].decode())
                start = at + 1
            state = after
        self.state, self.held = state, data[start:]
        return "".join(out)

    def finish(self) -> str:
        """What is left at the end: U+FFFD for an unfinished character."""
        left = "�" if self.held else ""
        self.reset()
        return left

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4")
        out = [self.feed(ids[i:i + STEP].tolist()) for i in range(0, len(ids), STEP)]
        return "".join([*out, self.finish()])


def _mapped(df: DataFrame, input_col: str, outputs: dict[str, str], keep: tuple[str, ...], maker) -> DataFrame:
    """(keep columns, outputs): ``maker()`` of a task's worker applied to
    ``input_col`` row by row gives the values of the outputs (column -> binary or
    string). A batch is put out in pieces of BLOCK input bytes."""
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows, n = df.select(*kept, F.col(input_col).alias("v")), len(keep)
    names = [*(f"k{i}" for i in range(n)), *(f"v{i}" for i in range(len(outputs)))]
    kinds = [{"binary": pa.binary(), "string": pa.string()}[k] for k in outputs.values()]

    def run(batches):
        make = maker()
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(n)), 0).to_numpy(zero_copy_only=False)
            for a, b in row_blocks(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), BLOCK):
                part = batch.slice(a, b - a)
                made = zip(*(make(v.as_py()) for v in part.column(n)))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *(pa.array(v, k) for v, k in zip(made, kinds))], names=names)

    ddl = [*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:n]), *(f"v{i} {k}" for i, k in enumerate(outputs.values()))]
    return rows.mapInArrow(run, ", ".join(ddl)).toDF(*keep, *outputs)


def _worker_copy(sent, name: str, build):
    """One object per Python worker and broadcast, built when first asked for."""
    box = sent.value
    if name not in box:
        box[name] = build(box)
    return box[name]


def broadcast_rules(spark, ranks: dict[bytes, int], pattern: str):
    """The compiled merges for ``encode_texts``; their size is that of the vocabulary."""
    return spark.sparkContext.broadcast({"rules": Rules(ranks), "pattern": pattern})


def broadcast_tokens(spark, ranks: dict[bytes, int]):
    """The token bytes for ``decode_ids``."""
    return spark.sparkContext.broadcast({"ranks": ranks})


def _encoder(rules) -> Encoder:
    return _worker_copy(rules, "encoder", lambda box: Encoder(box["rules"], box["pattern"]))


def _decoder(tokens) -> Decoder:
    return _worker_copy(tokens, "decoder", lambda box: Decoder(box["ranks"]))


def encode_texts(df: DataFrame, rules, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """(keep columns, ids_col): the ids of each whole text as packed little-endian
    unsigned 32-bit integers, a row each. Null and empty texts have no ids. Each
    match of the pattern is encoded apart, without special tokens. Rows are never
    compared, so nulls, ties and repeated rows in the other columns do not matter;
    columns not in ``keep`` are left out.
    """
    def maker():
        encoder = _encoder(rules)
        return lambda text: (encoder.encode(text or ""),)

    return _mapped(df, text_col, {ids_col: "binary"}, keep, maker)


def decode_ids(df: DataFrame, tokens, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), text_col: str = "decoded") -> DataFrame:
    """(keep columns, text_col): the text of each row of packed ids (null: empty),
    decoded as a stream. An id outside the vocabulary raises."""
    def maker():
        decoder = _decoder(tokens)
        return lambda packed: (decoder.decode(packed or b""),)

    return _mapped(df, ids_col, {text_col: "string"}, keep, maker)


def round_trip(df: DataFrame, rules, tokens, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``encode_texts`` and ``decode_ids`` of its ids in one pass: (keep columns, ids_col, decoded_col)."""
    def maker():
        encoder, decoder = _encoder(rules), _decoder(tokens)

        def both(text):
            packed = encoder.encode(text or "")
            return packed, decoder.decode(packed)
        return both

    return _mapped(df, text_col, {ids_col: "binary", decoded_col: "string"}, keep, maker)
