"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

``Transducer`` reads the bytes of one piece of text and emits the tokens that merging by rank would give,
without merging.  It rests on a property of such vocabularies: the encoding of every prefix of a piece ends
in exactly one token whose pair with the token before it is stable, that is, merging the two tokens' bytes
gives the same two tokens again.  After each byte the transducer holds, for every earlier position from
which some longer token could still start, where in the vocabulary's byte trie that token would stand and
the tokens that lead there; what all of these share is emitted, so the lookahead is bounded by the longest
token.  States and transitions are made when text first needs them and kept in tables of bounded size.

Pieces are the matches of the tokenizer's pattern.  As the rank files' own library does, a piece that is a
vocabulary entry as a whole is that entry.  Special tokens are never produced: their strings are text.

Decoding joins the tokens' bytes and passes them through an incremental UTF-8 state machine chunk by
chunk, which keeps an incomplete character between chunks and replaces what is not UTF-8.

Defined results: null and empty texts have no tokens; a text of any length is encoded whole; the decoded
bytes are the text's bytes.  Rows may repeat; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import codecs
import contextlib
import gc
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Pieces of one generation of the cache (two are kept), and states at which the transducer starts again: bounds on a
#: worker's memory.
CACHED_PIECES = 300_000
CACHED_STATES = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.children: list[dict[int, int]] = [{}]  # the byte trie; node 0 is the root
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                after = self.children[node].get(byte)
                if after is None:
                    after = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = after
            self.token_at[node] = rank
        self.stable: dict[tuple[int, int], bool] = {}
        self.last_merge: dict[int, tuple[int, int] | None] = {}
        self.forget()

    def forget(self) -> None:
        start = ((0, -1, ()),)
        self.states = [start]
        self.number = {start: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The tokens of the last merge that makes token (-1, -1 for a single byte); None if merging never makes it."""
        if token not in self.last_merge:
            parts = [self.bytes_of[token][i : i + 1] for i in range(len(self.bytes_of[token]))]
            while len(parts) > 2:
                least, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if least == 1 << 60:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            made = {1: (-1, -1), 2: tuple(self.ranks[p] for p in parts)}
            self.last_merge[token] = made.get(len(parts))
        return self.last_merge[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether merging keeps two adjacent tokens apart.

        Followed backwards: beside the border stand the two tokens, before that the halves of whichever was made last.  A pair
        that stood there would have merged if its rank came before the merge that made the next token on either side;
        of equal ranks the left one is merged first.
        """
        ranks, text = self.ranks, self.bytes_of
        until = 1 << 60
        while True:
            if ranks.get(text[left] + text[right], 1 << 60) < until:
                return False
            inner, outer = self.halves(left)[1], self.halves(right)[0]
            if inner < 0 and outer < 0:
                return True
            if outer < 0 or (inner >= 0 and left > right):
                until, left = left, inner
            else:
                until, right = right + 1, outer

    def follows(self, before: int, token: int) -> bool:
        """Whether token may stand right after before (-1: at a piece's start)."""
        if before < 0:
            return self.halves(token) is not None
        pair = (before, token)
        if (ok := self.stable.get(pair)) is None:
            if len(self.stable) > CACHED_STATES:
                self.stable.clear()
            ok = self.stable[pair] = self.halves(token) is not None and self.apart(before, token)
        return ok

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after a byte, and the tokens that are certain by then; made once, then looked up."""
        live, ends = [], None
        for node, last, chain in self.states[state]:
            after = self.children[node].get(byte)
            if after is None:
                continue
            if self.children[after]:
                live.append((after, last, chain))
            token = self.token_at[after]
            if ends is None and token >= 0 and self.follows(last, token):
                ends = (0, token, (*chain, token))
        if ends is None:
            raise ValueError("the vocabulary does not encode these bytes")
        live.append(ends)
        shared = 0
        while all(len(chain) > shared for _, _, chain in live) and len({chain[shared] for _, _, chain in live}) == 1:
            shared += 1
        made = live[0][2][:shared]
        then = tuple((node, last, chain[shared:]) for node, last, chain in live)
        at = self.number.get(then)
        if at is None:
            at = self.number[then] = len(self.states)
            self.states.append(then)
        self.moves[state << 8 | byte] = (at, made)
        return at, made

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece."""
        if (token := self.ranks.get(piece)) is not None:
            return [token]
        if len(self.states) > CACHED_STATES:
            self.forget()
        state, out, moves = 0, [], self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            state, made = self.step(state, byte) if move is None else move
            if made:
                out += made
            if state > 2 * CACHED_STATES:  # one very long piece
                held = self.states[state]
                self.forget()
                moves, state = self.moves, 1
                self.states.append(held)
                self.number[held] = 1
        out += self.states[state][-1][2]
        return out


class Tokenizer:
    def __init__(self, path: str, pattern: str):
        import regex

        self.machine = Transducer(load_ranks(path))
        self.split = regex.compile(pattern).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.table = [self.machine.bytes_of.get(i, b"") for i in range(max(self.machine.bytes_of) + 1)]

    def encode(self, text: str) -> list[int]:
        if len(self.pieces) > CACHED_PIECES:
            self.pieces, self.older = {}, self.pieces
        ids: list[int] = []
        known, older = self.pieces, self.older
        for piece in self.split(text):
            tokens = known.get(piece)
            if tokens is None:
                tokens = older.get(piece)
                if tokens is None:
                    tokens = tuple(self.machine.encode(piece.encode()))
                if len(piece) <= 64:
                    known[piece] = tokens
            ids += tokens
        return ids

    def chunks(self, ids: list[int], size: int = 4096) -> Iterator[bytes]:
        for i in range(0, len(ids), size):
            yield b"".join(map(self.table.__getitem__, ids[i : i + size]))

    def decode_stream(self, chunks: Iterable[bytes]) -> Iterator[str]:
        """Text as soon as its bytes are complete; the state machine keeps what is not."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for chunk in chunks:
            yield machine.decode(chunk)
        yield machine.decode(b"", True)


_tokenizers: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One for each worker and vocabulary."""
    if (path, pattern) not in _tokenizers:
        _tokenizers[path, pattern] = Tokenizer(path, pattern)
    return _tokenizers[path, pattern]


@contextlib.contextmanager
def without_collection() -> Iterator[None]:
    """While texts of one batch are encoded nothing makes cycles, and the tokenizer's tables are large: the garbage collector rests."""
    ran = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if ran:
            gc.enable()


def encode_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) for each row.  path must name the vocabulary on every executor."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                with without_collection():
                    ids = pa.array([own.encode(t or "") for t in part.column("text").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text for each row of doc_id, ids; unknown ids stand for nothing."""
    small_batches(encoded.sparkSession)

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = ["".join(own.decode_stream(own.chunks(ids or []))) for ids in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(decode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip for each row, in one pass over the texts:
    what encode_documents and decode_documents give, digested where it is made."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, pattern)
        decimals = [str(i) for i in range(len(own.table))]
        for batch in batches:
            out: list[tuple[int, str, str, bool]] = []
            with without_collection():
                for t in batch.column("text"):
                    plain = t.as_py() or ""
                    ids = own.encode(plain)
                    decoded, at, same = hashlib.sha256(), 0, True
                    for chunk in own.decode_stream(own.chunks(ids)):
                        decoded.update(chunk.encode())
                        same = same and plain.startswith(chunk, at)
                        at += len(chunk)
                    joined = hashlib.sha256(",".join(map(decimals.__getitem__, ids)).encode())
                    out.append((len(ids), joined.hexdigest(), decoded.hexdigest(), same and at == len(plain)))
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return rows.mapInArrow(digest, schema)
