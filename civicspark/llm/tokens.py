"""Token counts by a two-tier lookup on the map side."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import share_package

#: White space around a space: here a byte-level tokenizer may join it, so such texts go to
#: the library whole. Everywhere else it starts a new piece at each space.
JOINED = re.compile(r"  |\s (?:\s|\Z)")

#: Letters and then marks: two pieces of which nothing else needs to be known. The letters are
#: those up to U+00FF whose class no Unicode version disputes; an apostrophe may start a piece.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")

#: A pre-token is frequent if it makes up this share of a task's pre-tokens.
FREQUENT_SHARE = 1 / 4_000
#: Bounds of the broadcast table and of a worker's cache, in pre-tokens.
TABLE_ROWS, CACHE_ROWS = 65_536, 400_000

#: Kept by a Python worker from task to task: path -> encoder.
_workers: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the characters from U+0080 to U+00FF.

    Each UTF-8 byte is a letter: printable ones stand for themselves, the others follow from
    U+0100 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    letter = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)}


BYTE_LETTERS = _byte_letters()
#: The space in front of a pre-token, in that writing.
SPACE_LETTER = "\u0120"


class Encoder:
    """The tokenizer of a file, and the lengths of the pre-tokens it met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))))
        self.cache: dict[str, int] = {}
        self.marks: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def parts(self, text: str) -> list[str]:
        """The text between its special strings."""
        return self.split.split(text) if any(s in text for s in self.specials) else [text]

    def encoded(self, piece: str) -> int:
        """Tokens of a piece without special strings, by the library's own steps."""
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)
        return sum(len(self.tokenizer.model.tokenize(p)) for p, _ in pieces)

    def length(self, after_space: str) -> int:
        """Tokens of a pre-token with the space before it."""
        found = self.cache.get(after_space)
        if found is None:
            if len(self.cache) >= CACHE_ROWS:
                self.cache.clear()
                self.marks.clear()
            found = self.cache[after_space] = self.rare(after_space)
        return found

    def rare(self, after_space: str) -> int:
        plain = PLAIN.fullmatch(after_space)
        if not plain or not after_space:
            return self.encoded(" " + after_space)
        letters, marks = plain.groups()
        tokens = self.tokenizer.model.tokenize
        if not letters:
            return len(tokens(SPACE_LETTER + marks))
        if not after_space.isascii():
            letters = letters.translate(BYTE_LETTERS)
        n = len(tokens(SPACE_LETTER + letters))
        if marks:
            if marks not in self.marks:
                self.marks[marks] = len(tokens(marks))
            n += self.marks[marks]
        return n

    def count(self, text: str, frequent: dict[str, int]) -> int:
        """Tokens of a whole text."""
        parts = self.parts(text)
        total = len(parts) - 1
        for part in parts:
            if JOINED.search(part):
                total += len(self.tokenizer.encode(part, add_special_tokens=False))
                continue
            first, *rest = part.split(" ")
            lengths = list(map(frequent.get, rest))
            if None in lengths:
                known = self.cache.get
                lengths = [n or known(p) or self.length(p) for n, p in zip(lengths, rest, strict=True)]
            total += self.encoded(first) + sum(lengths)
        return total


def _frequent(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        encoder = Encoder.of(path)
        counts: Counter[str] = Counter()
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for part in encoder.parts(text or ""):
                    pieces = part.split(" ")[1:]
                    total += len(pieces)
                    counts.update(pieces)
                if len(counts) > CACHE_ROWS:  # lossy counting: what is dropped was rarer than the share
                    floor = total * FREQUENT_SHARE / 4
                    counts = Counter({p: n for p, n in counts.items() if n > floor})
        found = [(p, n) for p, n in counts.items() if n >= total * FREQUENT_SHARE]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())],
                names=["piece", "n"],
            )

    return run


def _count(path: str, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        encoder, frequent = Encoder.of(path), table.value
        for batch in batches:
            sizes = [encoder.count(text, frequent) if text else 0 for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, counted as the tokenizer file's library does.

    No begin, end or other special tokens are added; special strings inside a text are single
    tokens, as is the library's default. A null or empty text has 0 tokens. Each row is
    counted for itself, so null or repeated ids do no harm, and other columns are ignored.

    A pre-token is what stands between two spaces, with the space before it. A first pass
    names those that make up 1/4,000 of a task's pre-tokens or more, at most 4,000 a task; the
    most frequent get their lengths in a broadcast table of at most ``TABLE_ROWS`` rows. All
    others are encoded where they occur, and each Python worker remembers their lengths. No
    pre-token is shuffled but for those summaries; the table decides speed only.
    """
    spark = df.sparkSession
    share_package(spark)
    encoder = Encoder.of(tokenizer_path)
    texts = df.select(F.col(text_col).alias("text"))
    top = (
        texts.mapInArrow(_frequent(tokenizer_path), "piece string, n long")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece")
        .limit(TABLE_ROWS)
        .collect()
    )
    table = spark.sparkContext.broadcast({r.piece: encoder.encoded(" " + r.piece) for r in top})
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long")).alias("n_bytes"),
    )
    return rows.mapInArrow(_count(tokenizer_path, table), "doc_id long, n_bytes long, n_tokens long")
