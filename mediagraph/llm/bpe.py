"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one last token is part of the prefix's valid encoding. Storing that token for each
prefix makes encoding a left-to-right scan, lets a text grow by exact appends, and lets an edit re-encode only its surroundings.
A neighbouring pair of tokens is valid if merging its joined bytes by rank gives that pair back; a sequence is the encoding of
its bytes if all neighbouring pairs are valid.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from mediagraph.llm.common import as_bytes, kept

#: Words, pieces and pairs of tokens that one Python worker remembers, about 170, 170 and 100 bytes each.
WORDS_REMEMBERED, PIECES_REMEMBERED, PAIRS_REMEMBERED = 250_000, 20_000, 250_000
#: Words and pieces of more characters aren't remembered.
LONGEST_REMEMBERED = 64
#: A blank between two characters that aren't white space always begins a piece: no piece has one further on.
BREAK = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> bytes:
    """The rank file as it is (about 1 MB; its size is that of the vocabulary, whatever the corpus)."""
    with open(path, "rb") as f:
        return f.read()


class Memo(dict):
    """Values made by key. When it holds as many as it may, the older half is forgotten but for what has been asked for since."""

    def __init__(self, most: int, make):
        super().__init__()
        self.half, self.make, self.old = max(1, most // 2), make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Vocabulary:
    """Tokens by rank, merging, and the validity of neighbouring tokens."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines()) if token}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks), default=1)
        self.reach: dict[bytes, int] = {}  # the longest token with the same first five bytes; of up to five bytes, with the same three
        for token in self.ranks:
            if len(token) > 2:
                start = token[: 3 if len(token) <= 5 else 5]
                self.reach[start] = max(self.reach.get(start, 2), len(token))
        self.tree: dict = {}  # by byte; the rank of the token that ends at a node is under -1
        for token, rank in self.ranks.items():
            node = self.tree
            for b in token:
                node = node.setdefault(b, {})
            node[-1] = rank
        self.pairs: dict[int, bool] = {}  # by left << 32 | right; the older half of what is remembered is apart
        self._older_pairs: dict[int, bool] = {}
        self._starts: dict[bytes, tuple] = {}
        self._alone: dict[int, bool] = {}
        self._parts: dict[int, tuple[int, int] | None] = {}

    def starts(self, three: bytes) -> tuple[list[tuple[int, int]], dict | None]:
        """Length and rank of the tokens that three bytes begin with or are, and the node of the tree behind them."""
        if len(self._starts) > 100_000:
            self._starts.clear()
        found, node = [], self.tree
        for n, b in enumerate(three, 1):
            node = node.get(b)
            if node is None:
                break
            if -1 in node:
                found.append((n, node[-1]))
        out = self._starts[three] = found, node if len(three) == 3 else None
        return out

    def merged(self, piece: bytes) -> list[bytes]:
        """The parts left when the neighbours of lowest rank are merged again and again."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def reachable(self, rank: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        known = self._alone.get(rank)
        if known is None:
            known = self._alone[rank] = self.merged(self.tokens[rank]) == [self.tokens[rank]]
        return known

    def parts(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes the token; None for one of one byte or one that merging never reaches."""
        if rank not in self._parts:
            data = self.tokens[rank]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                least, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if least >= rank:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self._parts[rank] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._parts[rank]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether right may follow left; a token that merging never reaches may not."""
        pair = left << 32 | right
        ok = self._older_pairs.get(pair)
        if ok is None:
            ok = self.reachable(left) and self.reachable(right) and self._apart(left, right)
        if len(self.pairs) >= max(1, PAIRS_REMEMBERED // 2):
            self._older_pairs = dict(self.pairs)
            self.pairs.clear()
        self.pairs[pair] = ok
        return ok

    def _apart(self, left: int, right: int) -> bool:
        """Whether no merge goes across the border of the two: taking their merges back, the latest first, the tokens on both sides of
        the border never make a token that would have been merged before the merge just taken back."""
        ranks, tokens, before = self.ranks, self.tokens, 1 << 60
        while True:
            if ranks.get(tokens[left] + tokens[right], 1 << 60) < before:
                return False
            of_left, of_right = self.parts(left), self.parts(right)
            # of equal ranks, merges go from left to right: the right one is the later
            if of_left and (left > right or not of_right):
                before, left = left, of_left[1]
            elif of_right:
                before, right = right + 1, of_right[0]
            else:
                return True


class ShortPiece:
    """The last tokens of the prefixes on the way to a short piece's end: from each prefix, the longest token that may follow its last
    one comes first. As a prefix has one last token only, one from which the end isn't reached is never tried again, and the first way
    that reaches the end is the encoding."""

    #: Bytes of the pieces encoded this way; longer ones get the last tokens of all their prefixes.
    MOST = 64

    def __init__(self, vocabulary: Vocabulary, data: bytes):
        self.v, self.data = vocabulary, data

    def ids(self) -> list[int]:
        v, data = self.v, self.data
        get, pairs, reach, end = v.ranks.get, v.pairs, v.reach, len(data)
        out: list[int] = []
        closed: set[int] = set()
        at, size = 0, min(reach.get(data[:5]) or reach.get(data[:3], 2), end)
        while at < end:
            while size:
                rank = get(data[at : at + size])
                if rank is not None and at + size not in closed:
                    if not out:
                        ok = v.reachable(rank)
                    elif (ok := pairs.get(out[-1] << 32 | rank)) is None:
                        ok = v.neighbours(out[-1], rank)
                    if ok:
                        break
                size -= 1
            if size:
                out.append(rank)
                at += size
                size = min(reach.get(data[at : at + 5]) or reach.get(data[at : at + 3], 2), end - at)
            else:
                closed.add(at)
                size = len(v.tokens[out.pop()])
                at -= size
                size -= 1
        return out


class PieceEncoder:
    """The last token of each prefix of one piece; grows by exact appends."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.data, self.last = vocabulary, b"", [-1]

    def append(self, more: bytes) -> None:
        v, old = self.v, len(self.data)
        data = self.data = self.data + more
        last, n, pairs, starts = self.last, len(data), v.pairs, v._starts
        last.extend([-1] * len(more))
        for start in range(max(0, old - v.longest + 1), n):
            before = last[start]
            if before < 0 and start:
                continue
            three = data[start : start + 3]
            found, node = starts.get(three) or v.starts(three)
            before <<= 32
            for size, rank in found:
                at = start + size
                if last[at] < 0 and at > old:
                    ok = pairs.get(before | rank) if start else v.reachable(rank)
                    if v.neighbours(before >> 32, rank) if ok is None else ok:
                        last[at] = rank
            at = start + 3
            while node is not None and at < n and (node := node.get(data[at])) is not None:
                at += 1
                rank = node.get(-1)
                if rank is None or at <= old or last[at] >= 0:
                    continue
                ok = pairs.get(before | rank) if start else v.reachable(rank)
                if v.neighbours(before >> 32, rank) if ok is None else ok:
                    last[at] = rank

    def ids(self) -> list[int]:
        """A piece that is a token as it stands is that token, even one that merging never reaches."""
        whole = self.v.ranks.get(self.data)
        if whole is not None:
            return [whole]
        out, end = [], len(self.data)
        while end:
            rank = self.last[end]
            out.append(rank)
            end -= len(self.v.tokens[rank])
        return out[::-1]


class TextEncoder:
    """Ids of whole texts: the pattern cuts pieces, each piece is encoded separately. Ids are kept packed, four bytes each."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.v, self.pattern = Vocabulary(rank_file), regex.compile(pattern)
        self._pieces, self._words = Memo(PIECES_REMEMBERED, self._piece), Memo(WORDS_REMEMBERED, self._word)

    def _piece(self, text: str) -> bytes:
        data = as_bytes(text)
        if data in self.v.ranks:
            return array("i", [self.v.ranks[data]]).tobytes()
        if len(data) <= ShortPiece.MOST:
            return array("i", ShortPiece(self.v, data).ids()).tobytes()
        prefix = PieceEncoder(self.v)
        prefix.append(data)
        return array("i", prefix.ids()).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of what follows a BREAK, up to the next one, with its blank."""
        pieces = self.pattern.findall(" " + word)
        return self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self._pieces.__getitem__, pieces))

    def piece(self, text: str) -> tuple[int, ...]:
        return tuple(array("i", self._pieces[text]))

    def packed(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers in the machine's order."""
        first, *words = BREAK.split(text)
        return b"".join(map(self._pieces.__getitem__, self.pattern.findall(first))) + b"".join(map(self._words.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.v.tokens.__getitem__, ids))


class EditableText:
    """A text with its pieces and ids; an append or an edit re-encodes the pieces near it and keeps the others."""

    #: The pattern's longest alternative with fixed characters, and its look-ahead, reach no further than this back.
    REACH = 4

    def __init__(self, encoder: TextEncoder, text: str = ""):
        self.encoder, self.text = encoder, text
        self.pieces: list[tuple[str, tuple[int, ...]]] = [(p, encoder.piece(p)) for p in encoder.pattern.findall(text)]
        self.encoded = len(self.pieces)

    def ids(self) -> list[int]:
        return [i for _, ids in self.pieces for i in ids]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Puts new in place of text[start:end]. encoded counts the pieces that were encoded again."""
        keep, at = 0, 0
        while keep < len(self.pieces) and at + len(self.pieces[keep][0]) <= start - self.REACH:
            at += len(self.pieces[keep][0])
            keep += 1
        ends, old_at = {}, at
        for k in range(keep, len(self.pieces)):
            if old_at >= end:
                ends[old_at - end + start + len(new)] = k
            old_at += len(self.pieces[k][0])
        self.text = self.text[:start] + new + self.text[end:]
        fresh_pieces, rest = [], []
        for m in self.encoder.pattern.finditer(self.text, at):
            if m.start() in ends and m.start() >= start + len(new):
                rest = self.pieces[ends[m.start()] :]
                break
            fresh_pieces.append((m[0], self.encoder.piece(m[0])))
        self.encoded = len(fresh_pieces)
        self.pieces = self.pieces[:keep] + fresh_pieces + rest


def encoder_of(rank_file: bytes, pattern: str) -> TextEncoder:
    """One encoder for each Python worker."""
    return kept((rank_file, pattern), lambda: TextEncoder(rank_file, pattern))


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Adds n_tokens, token_ids, ids_sha256 and decoded_sha256 to each row; given columns of these names give way.

    A null text counts as empty: no ids, and the digests are those of nothing. Repeated rows are encoded each; empty tables give
    empty tables; texts of any length are encoded whole, a text at a time.
    """
    out = ["n_tokens", "token_ids", "ids_sha256", "decoded_sha256"]
    given = docs.drop(*[c for c in out if c != text_col])
    return _encoded(given, rank_path, pattern, text_col, with_ids=True)


def encode_digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of each row, without its ids or text."""
    return _encoded(docs.select(id_col, text_col), rank_path, pattern, text_col, with_ids=False)


def _encoded(docs: DataFrame, rank_path: str, pattern: str, text_col: str, with_ids: bool) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(rank_path))
    names = [f.name for f in docs.schema if f.name != text_col or with_ids]
    place = docs.columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    schema = f"{fields}, n_tokens long" + ", token_ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, packs, hashed, decoded = [], [], [], []
                for cell in part.column(place):
                    pack = encoder.packed(cell.as_py() or "")
                    ids = array("i", pack)
                    counts.append(len(ids))
                    hashed.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                    if with_ids:
                        packs.append(pack)
                given = [part.column(i) for i, name in enumerate(part.schema.names) if i != place or with_ids]
                ends = pa.array(np.cumsum([0, *counts]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packs), np.int32)))] if with_ids else []
                made = [pa.array(counts, pa.int64()), *lists, pa.array(hashed, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(given + made, names=[*names, "n_tokens", *["token_ids"] * with_ids, "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(encode, schema)


def decode_documents(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; null ids give null."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    given = df.drop(out_col)
    place, names = given.columns.index(ids_col), given.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value, pattern)
        for batch in batches:
            made = [None if (ids := cell.as_py()) is None else encoder.decode(ids) for cell in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*names, out_col])

    return given.mapInArrow(decode, f"{fields}, `{out_col}` binary")
