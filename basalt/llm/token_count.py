"""Token counts by the whole-token shortcut.

Before any text is read, every vocabulary string with a word end is encoded alone; those that give one
token are the *whole* set. In a text, pre-tokens of that set count one without merging; only the others are
merged, each distinct one once per worker.

Results: a null text counts as empty (0 bytes, 0 tokens); repeated rows and equal ids are counted row by row;
a null id is passed through; other columns of the input are ignored, whatever their names; an empty table gives
an empty table. Long texts are read whole. Special strings inside a text are one token each, the library's default.
"""

from __future__ import annotations

import re
import unicodedata

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .words import Memo, slices

#: How the vocabulary's file splits normalised text, its word end, and its special strings.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for ``re``, where every character of a text means the same to it.
SAME = r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
WORD_END = "</w>"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Up to here the library and Python agree on every character (tests/llm); beyond, each one is compared.
COMPARED = "՗"


class Counter:
    """Tokens of a text, as the library counts them."""

    def __init__(self, vocabulary: str):
        self.library = Tokenizer.from_file(vocabulary)
        self.split = regex.compile(SPLIT)
        self.special = re.compile("|".join(map(re.escape, SPECIAL)))
        self.beyond = re.compile(f"[^\\x00-{COMPARED}]")
        self.same = re.compile(SAME)
        self.other = re.compile("[^%s]" % "".join(re.escape(c) for c in map(chr, range(ord(COMPARED) + 1)) if not self.differs_in_re(c)))
        self.pieces = Memo(self.merged)
        self.differs = Memo(lambda c: self.plain(f"a{c}a") != self.by_library(f"a{c}a"))

    def whole(self) -> list[str]:
        """The vocabulary strings that encode alone as one token."""
        letters = bytes_of_letters()
        found = []
        for s in self.library.get_vocab(with_added_tokens=False):
            if s.endswith(WORD_END) and len(s) > len(WORD_END) and len(self.library.model.tokenize(s.removesuffix(WORD_END))) == 1:
                try:
                    found.append(bytes(letters[c] for c in s.removesuffix(WORD_END)).decode())
                except UnicodeDecodeError:
                    continue  # part of a character is never a pre-token
        return found

    def use(self, whole: list[str]) -> Counter:
        self.pieces.update(dict.fromkeys(whole, 1))
        self.pieces.most += len(whole)
        return self

    def merged(self, piece: str) -> int:
        [(letters, _)] = BYTE_LEVEL.pre_tokenize_str(piece)
        return len(self.library.model.tokenize(letters))

    def differs_in_re(self, c: str) -> bool:
        return self.split.findall(f"a{c}a{c}{c}") != self.same.findall(f"a{c}a{c}{c}")

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        text = text.lower()
        return (self.split if self.other.search(text) else self.same).findall(text)

    def by_library(self, text: str) -> list[str]:
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        n, parts = 0, [text]
        if "<|" in text:
            parts = self.special.split(text)
            n = len(parts) - 1
        for part in parts:
            odd = not part.isascii() and any(self.differs[c] for c in set(self.beyond.findall(part)))
            n += sum(map(self.pieces.__getitem__, (self.by_library if odd else self.plain)(part)))
        return n


def _byte_level():
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel(add_prefix_space=False, use_regex=False)


BYTE_LEVEL = _byte_level()


def bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row; one pass, no shuffle.

    vocabulary: a file name below the tokenizers' folder (found on each worker) or a path that all of them see.
    """
    whole = docs.sparkSession.sparkContext.broadcast(Counter(locate(vocabulary)).whole())  # at most the vocabulary

    def count(batches):
        counter = Counter(locate(vocabulary)).use(whole.value)
        for batch in batches:
            for ids, texts in slices(batch, "doc_id", "text"):
                n = [counter.count(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def locate(vocabulary: str) -> str:
    return vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "word_bpe_49k.json")
