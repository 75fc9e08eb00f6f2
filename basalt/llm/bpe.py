"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece exactly one token can come last in that prefix's encoding. ``Encoder.last`` holds these
tokens: a token that ends at a prefix is the one if it may follow the last token of the prefix before it, that
is, if merging the two tokens' bytes anew gives the same two tokens. The encoding is read backwards from the
whole piece. Appending bytes keeps all entries before them, and an edit keeps those of the bytes before it, so
``Prefixes`` encodes appended and edited texts from where they change.

Results: a null text counts as empty (no ids, the digest of nothing); repeated rows and equal ids are encoded row by
row; null ids pass through; other input columns are ignored; an empty table gives an empty table; texts are read whole.
"""

from __future__ import annotations

import base64
import re
from hashlib import sha256
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .token_count import locate
from .words import Memo, free, slices


#: Rows turned into Python objects at once.
ROWS = 2048


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts = Memo(self.parted, 400_000)
        self.follows = Memo(self.may_follow, 400_000)

    def parted(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one: of all cuts, the one whose sides are whole tokens that may follow each other below this rank."""
        b = self.bytes[token]
        if len(b) == 1:
            return None
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 2:
            best = min((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None)
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def may_follow(self, pair: tuple[int, int]) -> bool:
        """Whether merging both tokens' bytes gives these two tokens again.

        Undo the merges at the seam, the later one first: if ever the two sides at the seam would have merged before the
        merge that is undone (at a lower rank, or an equal one further left), the seam would not have lasted.
        """
        left, right = pair
        limit = None  # the lowest rank that a merge across the seam is too late for
        while True:
            across = self.ranks.get(self.bytes[left] + self.bytes[right])
            if across is not None and (limit is None or across < limit):
                return False
            a, b = self.parts[left], self.parts[right]
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                left, limit = a[1], left  # a merge to the left at the same rank came first
            else:
                right, limit = b[0], right + 1  # across the seam is further left

    def extend(self, last: list[int], piece: bytes) -> list[int]:
        """The last tokens of all prefixes of piece; those in ``last`` are kept."""
        ranks, follows, longest = self.ranks, self.follows, self.longest
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                t = ranks.get(piece[start:end])
                if t is not None and (start == 0 or follows[last[start - 1], t]):
                    last.append(t)
                    break
        return last

    def encode_sorted(self, pieces: list[bytes]):
        """The ids of each of many sorted pieces; a piece keeps the table of the prefix that it shares with the one before."""
        before, last = b"", []
        for piece in pieces:
            if (t := self.ranks.get(piece)) is not None:
                yield (t,)
                continue
            same = 0
            for x, y in zip(before, piece, strict=False):
                if x != y:
                    break
                same += 1
            del last[same:]
            before, last = piece, self.extend(last, piece)
            yield self.ids(last)

    def ids(self, last: list[int]) -> tuple[int, ...]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes[out[-1]])
        return tuple(reversed(out))

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if (t := self.ranks.get(piece)) is not None:
            return (t,)
        return self.ids(self.extend([], piece))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Prefixes:
    """A piece that grows or changes; its table is worked out again from the first changed byte until it runs as before.

    A prefix's last token follows from the bytes and last tokens of at most ``longest`` places before it, so after as many
    places beyond the change that equal the old ones the rest of the table is the old one.
    """

    def __init__(self, encoder: Encoder, piece: bytes = b""):
        self.encoder, self.piece = encoder, piece
        self.last = encoder.extend([], piece)

    def append(self, more: bytes) -> Prefixes:
        return self.edit(len(self.piece), len(self.piece), more)

    def edit(self, start: int, end: int, by: bytes) -> Prefixes:
        old, shift, step = self.last, start + len(by) - end, self.encoder.longest
        self.piece = self.piece[:start] + by + self.piece[end:]
        self.last, at = self.last[:start], start + len(by)
        while len(self.last) < len(self.piece):
            at += step
            self.encoder.extend(self.last, self.piece[:at])
            if at < len(self.piece) and self.last[at - step : at] == old[at - step - shift : at - shift]:
                self.last += old[at - shift :]
        return self

    def ids(self) -> tuple[int, ...]:
        return self.encoder.ids(self.last)


class Splitter:
    """The matches of public_tokenizers.PATTERN as tiktoken finds them.

    tiktoken and Python know other versions of Unicode, and Python's two pattern libraries name other classes. Each
    character's class beyond U+0557, where no class differs (tests/llm), is taken from tiktoken. Texts whose
    characters all mean the same to ``re`` are split by it, others by ``regex``; a character that differs even
    there is replaced by one of its class while the pattern is matched.
    """

    BEYOND = re.compile("[^\\x00-՗]")
    CLASSES = ((r"\p{L}", r"[^\W\d_]", "一"), (r"\p{N}", r"\d", "١"), (r"\s", r"\s", " "))
    SAME = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"

    def __init__(self):
        self.pattern, self.same = regex.compile(public_tokenizers.PATTERN), re.compile(self.SAME)
        one = {bytes([i]): i for i in range(256)}
        self.classes = [(tiktoken.Encoding(f"class {p}", pat_str=p, mergeable_ranks=one, special_tokens={}), regex.compile(p), re.compile(q), s) for p, q, s in self.CLASSES]
        self.stand_in = Memo(self.compared)
        self.other = re.compile("[%s\u3000-\U0010ffff]" % "".join(re.escape(c) for c in map(chr, range(0x3000)) if self.compared(c) or any(bool(p.fullmatch(c)) != bool(q.fullmatch(c)) for _, p, q, _ in self.classes)))

    def compared(self, c: str) -> str | None:
        theirs = next((s for e, _, _, s in self.classes if e.encode_ordinary(c)), "§")
        ours = next((s for _, p, _, s in self.classes if p.fullmatch(c)), "§")
        return None if theirs == ours else theirs

    def split(self, text: str) -> list[str]:
        if text.isascii() or not self.other.search(text):
            return self.same.findall(text)
        odd = {ord(c): s for c in set(self.BEYOND.findall(text)) if (s := self.stand_in[c])}
        if odd:
            return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(odd))]
        return self.pattern.findall(text)


class TextCodec:
    """Whole texts to ids and back; a worker encodes each distinct piece once, as long as its memory of pieces lasts."""

    #: Pieces remembered, and characters of text whose new pieces are encoded together.
    PIECES, TOGETHER = 400_000, 2_000_000

    def __init__(self, vocabulary: str):
        self.encoder, self.splitter, self.pieces = Encoder(read_ranks(locate(vocabulary))), Splitter(), {}

    def encode_many(self, texts: list[str | None]):
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < self.TOGETHER):
                size += len(texts[end] or "")
                end += 1
            split = [self.splitter.split(t) if t else [] for t in texts[at:end]]
            if len(self.pieces) > self.PIECES:
                self.pieces.clear()
            new = sorted(p.encode() for p in set(chain.from_iterable(split)).difference(self.pieces))
            self.pieces.update((p.decode(), ids) for p, ids in zip(new, self.encoder.encode_sorted(new), strict=True))
            for pieces in split:
                yield list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))
            at = end

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_many([text]))

    def decode(self, ids) -> bytes:
        return self.encoder.decode(ids)


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", text_column: str = "text", ids_column: str = "token_ids") -> DataFrame:
    """All columns of docs and the ids of the text; the ids replace a column of their name. One pass, no shuffle."""
    kept, text = [c for c in docs.columns if c != ids_column], free(docs, "whole_text")

    def run(batches):
        codec = TextCodec(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = pa.array(codec.encode_many(part.column(text).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), ids], [*kept, ids_column])

    rows = docs.select(*(docs[f"`{c}`"] for c in kept), docs[f"`{text_column}`"].alias(text))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != ids_column)
    return rows.mapInArrow(run, f"{fields}, `{ids_column}` array<int>")


def decode(rows: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", ids_column: str = "token_ids", bytes_column: str = "decoded") -> DataFrame:
    """All columns and the bytes that the ids stand for (null ids: none)."""
    kept = [c for c in rows.columns if c != bytes_column]

    def run(batches):
        encoder = Encoder(read_ranks(locate(vocabulary)))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                data = pa.array([encoder.decode(x or ()) for x in part.column(ids_column).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), data], [*kept, bytes_column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != bytes_column)
    return rows.select(*(rows[f"`{c}`"] for c in kept)).mapInArrow(run, f"{fields}, `{bytes_column}` binary")


def digests(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Encode, then decode the ids, and keep only digests of both."""

    def run(batches):
        codec, decimal = TextCodec(vocabulary), Memo(str)
        for batch in batches:
            for ids, texts in slices(batch, "doc_id", "text", rows=ROWS):
                rows = []
                for tokens in codec.encode_many(texts):
                    rows.append((len(tokens), sha256(" ".join(map(decimal.__getitem__, tokens)).encode()).hexdigest(), sha256(codec.decode(tokens)).hexdigest()))
                n, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
