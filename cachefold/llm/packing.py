"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

Each task tokenises its own rows and packs them as it reads: no shuffle. A text longer than a sequence first gives
whole sequences; what remains is gathered until ``GATHER`` pieces are there. Those go, by descending length, to the
sequence of lowest estimated cost (linear in its tokens plus quadratic in each piece, as attention is) that still has
room; a piece that fits nowhere is cut over the roomiest ones. The number of sequences is the smallest possible, so at
most one sequence a gathering is short.

Defined cases: a null text counts as empty, and an empty text gives the end id alone. Repeated rows and null ids are
packed like any others. Extra columns are ignored. An empty table gives an empty table. A very long text is tokenised in
parts of about ``PART`` characters, cut where no token can reach across, so what is held of it is the text and its ids;
only a longer run without such a place (letters or white space alone) is one part.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 1024
END = 0  # the id after each document
GATHER = 4096  # pieces packed together
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH  # estimated cost of a token, and of a pair of tokens that attend to each other

PART = 1 << 20
# White space behind a word character always begins a new pre-token.
_CUT = re.compile(r"\w(?=[ \n\r\t])")
# Longer runs of white space are left to ``tokenizers``: the other matcher needs stack in proportion to them.
SPACES = 4096
_LONG_SPACE = re.compile(rf"\s{{{SPACES}}}")

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _bytes_of_vocabulary(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """Byte strings of a byte-level vocabulary, whose files write each byte as a printable character."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items()}


#: Texts on which the two implementations are compared when a file is loaded.
PROBES = ("Don't  stop,\n\n\tit's 2024-01-01!  ", "\u00e9\u00df\u4e2d\u6587\u0645\u0631\u062d\u0628\u0627 \U0001f600\u200d\U0001f525", " \u00a0\u2003 \u3000x\r\n \x0b\x0c\x1c\x85y", "a\u0300\u0301 \u0966\u0967 \u00bd\u2167 'LL 's'S", "<tag attr=\"1\">\x00\x7f</tag>")


class FileTokenizer:
    """Ids of a byte-level BPE ``tokenizers`` file, as little-endian 16-bit or 32-bit arrays.

    The ids are those of ``tokenizers``. Where the file's merges come in the order of their ids, as they do in the public
    files, and nothing else in the file bears on ids, the same merges are run by ``tiktoken`` over the file's own
    vocabulary (five times faster). Texts with the string of a special token and parts with long runs of white space are
    left to ``tokenizers`` itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.inner.get_added_tokens_decoder().items()}
        self.special = list(added)
        self.kind = np.dtype("<u4" if self.inner.get_vocab_size() > 1 << 16 else "<u2")
        self.fast = self._merges_by_id(path, added)
        if self.fast is not None and any(self.fast(t) != self._slow(t) for t in PROBES):
            self.fast = None

    def _slow(self, text: str) -> list[int]:
        return self.inner.encode(text, add_special_tokens=False).ids

    def _merges_by_id(self, path: str, added: dict[str, int]):  # noqa: ANN202
        import tiktoken

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, first = told["model"], told.get("pre_tokenizer") or {}
        vocabulary = {t: i for t, i in self.inner.get_vocab().items() if t not in added}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        ids = [vocabulary.get("".join(m)) for m in pairs]
        plain = told.get("normalizer") is None and first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
        others = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        plain = plain and model.get("type") == "BPE" and not any(model.get(name) for name in others)
        if not plain or not ids or None in ids or ids != sorted(ids) or len(set(ids)) != len(ids):
            return None
        # Fixed value: the pre-token pattern that the ByteLevel pre-tokenizer stands for.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        coded = tiktoken.Encoding("from_file", pat_str=pattern, mergeable_ranks=_bytes_of_vocabulary(vocabulary), special_tokens={})
        return coded.encode_ordinary

    def encode(self, text: str) -> np.ndarray:
        """The same ids as ``tokenizers`` gives for the whole text without its special-token post-processing."""
        if any(s in text for s in self.special):
            return np.array(self._slow(text), dtype=self.kind)
        found = [np.array(self._ids(part), dtype=self.kind) for part in parts(text)]
        return np.concatenate(found) if found else np.zeros(0, dtype=self.kind)

    def _ids(self, part: str) -> list[int]:
        if self.fast is None or len(part) >= SPACES and _LONG_SPACE.search(part):
            return self._slow(part)
        return self.fast(part)


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of ``size`` characters or more, each ending with a word character before white space."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + size) if len(text) - at > size else None
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def balance(lengths: np.ndarray, capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Place pieces (by number) into the fewest sequences: (piece, start in it, length, sequence, offset)."""
    n = -(-int(lengths.sum()) // capacity)
    cost, room, placed = np.zeros(n), np.full(n, capacity, dtype=np.int64), []
    for at in np.argsort(-lengths, kind="stable"):
        left, start = int(lengths[at]), 0
        while left:
            fits = room >= left
            to = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax())
            take = min(left, int(room[to]))
            placed.append((int(at), start, take, to, capacity - int(room[to])))
            room[to] -= take
            cost[to] += LINEAR * take + QUADRATIC * take * take
            start, left = start + take, left - take
    return placed


_tokenizers: dict[str, FileTokenizer] = {}


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row a piece (see ``SCHEMA``) for all rows of ``docs`` (doc_id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if tokenizer_path not in _tokenizers:
            _tokenizers[tokenizer_path] = FileTokenizer(tokenizer_path)
        tokenizer = _tokenizers[tokenizer_path]
        next_id = TaskContext.get().partitionId() << 40
        waiting: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, start, doc_tokens, ids
        rows: list[tuple] = []

        def put(doc: int | None, start: int, ids: np.ndarray, total: int, sequence: int, offset: int) -> None:
            rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))

        def settle() -> None:
            nonlocal next_id
            for at, start, length, to, offset in balance(np.array([len(w[3]) for w in waiting], dtype=np.int64)):
                doc, begin, total, ids = waiting[at]
                put(doc, begin + start, ids[start : start + length], total, next_id + to, offset)
            next_id += -(-sum(len(w[3]) for w in waiting) // LENGTH)
            waiting.clear()

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            rows.clear()
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), map(tokenizer.encode, texts), strict=True):
                    total = len(ids) + 1
                    ids = np.append(ids, np.array([END], dtype=ids.dtype))
                    whole = total - total % LENGTH
                    for start in range(0, whole, LENGTH):
                        put(doc, start, ids[start : start + LENGTH], total, next_id, 0)
                        next_id += 1
                    if whole < total:
                        waiting.append((doc, whole, total, ids[whole:]))
                    if len(waiting) >= GATHER:
                        settle()
                if len(rows) >= 10_000:
                    yield made()
        settle()
        yield made()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
