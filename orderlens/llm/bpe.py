"""Byte-level BPE encoding and decoding; long texts by tree concatenation.

A text up to ``LEAF_CHARS`` code points is encoded whole, word by word: the merges
never cross a word, and most words have been met before.  A longer one is
halved until its pieces are that short; the pieces are dealt over the cluster
and encoded on their own, then joined pairwise up the tree.  Around a join
the words are split anew, in a window that grows until a word boundary of the
window is also one of the right piece.  A word that runs across the join is
not encoded again as a whole: tokens around the join are re-encoded in a
window that grows until its first token is the left piece's and its last
token the right piece's; every neighbouring pair of tokens is then one that
the merges leave as it is, and so is the whole.

Word boundaries depend on what follows a word by one character, a contraction
by two, so those of a piece hold up to just before its end.  A special token
is never cut and never in a window.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import bound_batches, give_back, keep_only, resting, ship_package, text_or_empty

LEAF_CHARS = 32_768
#: Code points handed to the tokenizer at once; bounds a task's memory.
BATCH_CHARS = 200_000
#: Characters before a piece's end whose words may change with what follows.
UNSETTLED = 3


#: Words whose ids a worker remembers, and their longest: longer ones are seldom met again.
REMEMBERED, REMEMBERED_CHARS = 1 << 18, 64
#: Fixed value: the words that the merges of a byte-level tokenizer never cross.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters beyond those of ASCII texts, or white space that not all engines take for such.
UNUSUAL = re.compile(r"[^\t\n\x0b\x0c\r -~]")


@lru_cache(maxsize=1)
def settled() -> np.ndarray:
    """The characters of two bytes that were letters, numbers or neither in
    Unicode 3.2 and are now: all engines agree on them.  White space counts
    only as far as ASCII has it."""
    def kind(category: str) -> str:
        return category[0] if category[0] in "LN" else "?" if category in ("Cn", "Cs", "Co") else "-"

    old = unicodedata.ucd_3_2_0
    return np.array([kind(old.category(c)) == kind(unicodedata.category(c)) != "?" and (not c.isspace() or c in "\t\n\x0b\x0c\r ")
                     and not 0x1c <= ord(c) <= 0x1f for c in map(chr, range(0x10000))])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Bpe:
    """A tokenizer file of the ``tokenizers`` library, and joins of its ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        spec = json.loads(self.tok.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        #: Whether words are those of WORDS and nothing but the merges makes their ids.
        self.plain = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                      and pre.get("use_regex", True) and model["type"] == "BPE" and not model.get("dropout")
                      and not model.get("ignore_merges") and not model.get("unk_token"))
        #: The ids of words, 4 bytes each; lists of numbers would hold several times as much.
        self.known: dict[str, bytes] = {}
        back = {c: b for b, c in self.letters.items()}
        self.specials = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.bytes = [b""] * size
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = token.encode() if i in self.specials else bytes(back[c] for c in token)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of whole texts: word by word where the words are certain, by the library elsewhere."""
        certain = [self.certain(t) for t in texts]
        rest = iter(self.tok.encode_batch_fast([t for t, c in zip(texts, certain) if not c], add_special_tokens=False))
        return [array("I", b"".join(self.by_word(t))).tolist() if c else next(rest).ids for t, c in zip(texts, certain)]

    def certain(self, text: str) -> bool:
        """Whether every Unicode version cuts the text into the same words, and no special token is in it."""
        if not self.plain or any(s in text for s in self.specials.values()):
            return False
        if not UNUSUAL.search(text):
            return True
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return bool(codes.max() < 0x10000 and settled()[codes].all())

    def by_word(self, text: str) -> list[bytes]:
        """The ids of each word of a text, as bytes; a word's are remembered while there is room."""
        words = WORDS.findall(text)
        out = list(map(self.known.get, words))
        for i, ids in enumerate(out) if None in out else ():
            if ids is None:
                out[i] = ids = array("I", self.word(words[i].encode())).tobytes()
                if len(self.known) < REMEMBERED and len(words[i]) <= REMEMBERED_CHARS:
                    self.known[words[i]] = ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids' bytes, special tokens kept, as the library's decode gives it."""
        if len(ids) < 2:  # a getter of one place gives no tuple
            return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")
        return b"".join(itemgetter(*ids)(self.bytes)).decode("utf-8", "replace")

    def word(self, raw: bytes) -> list[int]:
        """The ids of one word, by the merges alone."""
        return [t.id for t in self.tok.model.tokenize("".join(map(self.letters.__getitem__, raw)))]

    def words(self, text: str) -> list[bytes]:
        """The words that the merges never cross."""
        raw = text.encode()
        lengths = (len(mapped) for mapped, _ in self.tok.pre_tokenizer.pre_tokenize_str(text))
        ends = list(accumulate(lengths))
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def piece(self, text: str) -> list[list[int]]:
        """The ids of a piece of text, word by word; a special token is a word."""
        if self.certain(text):
            return [array("I", w).tolist() for w in self.by_word(text)]
        enc = self.tok.encode(text, add_special_tokens=False)
        out: list[list[int]] = []
        last = object()
        for i, word in zip(enc.ids, enc.word_ids):
            special = i in self.specials
            if special or word != last or not out:
                out.append([i])
            else:
                out[-1].append(i)
            last = object() if special else word
        return out

    def text_of(self, words: list[list[int]]) -> str:
        return b"".join(self.bytes[i] for w in words for i in w).decode()

    def joined_word(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of a word of which both parts are encoded."""
        size = 4
        while True:
            a, b = left[-size:], right[:size]
            seam = self.word(b"".join(self.bytes[i] for i in a + b))
            if (size >= len(left) or seam[0] == a[0]) and (size >= len(right) or seam[-1] == b[-1]):
                return left[: len(left) - len(a)] + seam + right[len(b):]
            size *= 2

    def join(self, left: list[list[int]], right: list[list[int]]) -> list[list[int]]:
        """The words of two adjacent pieces as one piece."""
        if not left or not right or left[-1][0] in self.specials or right[0][0] in self.specials:
            return left + right
        start, chars = len(left), 0
        while start and left[start - 1][0] not in self.specials:  # back to a settled boundary
            start -= 1
            chars += len(self.text_of(left[start:start + 1]))
            if chars >= UNSETTLED:
                break
        stop = next((i for i, w in enumerate(right) if w[0] in self.specials), len(right))
        tail = [b"".join(self.bytes[i] for i in w) for w in left[start:]]
        size = 4
        while True:
            used = min(size, stop)
            head = [b"".join(self.bytes[i] for i in w) for w in right[:used]]
            window = self.words((b"".join(tail) + b"".join(head)).decode())
            cut = sum(map(len, tail))
            ends = list(accumulate(map(len, window)))
            agreed = set(accumulate(map(len, head), initial=cut))
            total = ends[-1]
            whole = used == stop
            for k, end in enumerate(ends):
                # a boundary this close to the window's end may move with what follows
                settled = whole or total - end >= 4 * UNSETTLED
                if end >= cut and end in agreed and settled:
                    kept = next(i for i, e in enumerate(accumulate(map(len, head), initial=cut)) if e == end)
                    return left[:start] + self._refit(window[: k + 1], left[start:], right[:kept]) + right[kept:]
            size *= 2

    def _refit(self, window: list[bytes], left: list[list[int]], right: list[list[int]]) -> list[list[int]]:
        """Ids for the words of a window over ``left`` and ``right``."""
        cut = sum(len(self.bytes[i]) for w in left for i in w)
        known: dict[tuple[int, int], list[int]] = {}
        at = 0
        for w in left + right:
            n = sum(len(self.bytes[i]) for i in w)
            known[at, at + n] = w
            at += n
        out, at = [], 0
        for raw in window:
            span = (at, at + len(raw))
            if span in known:
                out.append(known[span])
            elif (at, cut) in known and (cut, span[1]) in known:  # a word across the join
                out.append(self.joined_word(known[at, cut], known[cut, span[1]]))
            else:
                out.append(self.word(raw))
            at = span[1]
        return out

    def tree(self, pieces: list[list[list[int]]]) -> list[int]:
        """The ids of a text from those of its pieces."""
        while len(pieces) > 1:
            pairs = [self.join(a, b) for a, b in zip(pieces[::2], pieces[1::2])]
            pieces = pairs + pieces[len(pairs) * 2:]
        return [i for w in pieces[0] for i in w] if pieces else []

    def cuts(self, text: str, leaf: int) -> list[str]:
        """Halves of halves of a text; no cut falls inside a special token."""
        if len(text) <= leaf:
            return [text]
        middle = len(text) // 2
        for special in self.specials.values():
            near = text.find(special, max(0, middle - len(special) + 1), middle + len(special) - 1)
            if 0 <= near < middle:
                middle = near if near else near + len(special)
        if not 0 < middle < len(text):
            return [text]
        return self.cuts(text[:middle], leaf) + self.cuts(text[middle:], leaf)


@lru_cache(maxsize=2)
def _loaded(path: str) -> Bpe:
    model = Bpe(path)
    give_back()  # what reading the file took besides
    return model


def _forget() -> None:
    _loaded.cache_clear()
    settled.cache_clear()


def bpe(path: str) -> Bpe:
    """The tokenizer of a file, kept until another operator has this worker."""
    keep_only("bpe", _forget)
    return _loaded(path)


def _slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    first = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > BATCH_CHARS:
            yield first, i
            first, held = i, 0
        held += n + 1
    if first < len(lengths):
        yield first, len(lengths)


def digest_ids(ids: list[int] | np.ndarray) -> str:
    return hashlib.sha256(blob(ids)).hexdigest()


def blob(ids: list[int] | np.ndarray) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return (np.frombuffer(array("I", ids), dtype="=u4") if isinstance(ids, list) else ids).astype("<u4", copy=False).tobytes()


def digest_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


#: What becomes of each text's ids: the columns behind ``id``, and their arrays for a list of ids of texts.
Finish = Callable[["Bpe", list[list[int]]], list[pa.Array]]


def _encoded(docs: DataFrame, finish: Finish, columns: str, id_col: str, text_col: str, path: str, leaf_chars: int) -> DataFrame:
    """``id`` and the ``columns`` that ``finish`` makes of the ids of every whole
    text, in the task that has encoded it."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(f"`{text_col}`").alias("text"))
    long = F.length("text") > leaf_chars
    names = ["id", *(c.split()[0] for c in columns.split(", "))]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            texts = batch.column(1)
            for a, b in _slices(pc.utf8_length(texts).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *finish(model, model.encode(texts[a:b].to_pylist()))], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            for row, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                for leaf, part in enumerate(model.cuts(text, leaf_chars)):
                    yield pa.RecordBatch.from_pydict({"row": [row], "id": [doc], "leaf": [leaf], "text": [part]},
                                                     schema=leaves_schema)

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            for row, doc, leaf, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = model.piece(text)
                yield pa.RecordBatch.from_pydict({"row": [row], "id": [doc], "leaf": [leaf], "ids": [blob([i for w in words for i in w])],
                                                  "lengths": [blob([len(w) for w in words])]}, schema=pieces_schema)

    def concatenate(table: pa.Table) -> pa.Table:
        model = bpe(path)
        table = table.sort_by("leaf")
        pieces = []
        for parts in zip(table["ids"].to_pylist(), table["lengths"].to_pylist()):
            ids, lengths = (np.frombuffer(x, "<u4").tolist() for x in parts)
            ends = list(accumulate(lengths))
            pieces.append([ids[a:b] for a, b in zip([0, *ends], ends)])
        return pa.Table.from_arrays([table["id"].slice(0, 1), *finish(model, [model.tree(pieces)])], names)

    leaves_schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("leaf", pa.int32()), ("text", pa.string())])
    pieces_schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("leaf", pa.int32()), ("ids", pa.binary()), ("lengths", pa.binary())])
    short = rows.where(~long).mapInArrow(resting(whole), f"id long, {columns}")
    leaves = (rows.where(long).select(F.monotonically_increasing_id().alias("row"), "id", "text")
              .mapInArrow(resting(cut), "row long, id long, leaf int, text string"))
    # few bytes, much work: a number of tasks that is not coalesced
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = leaves.repartition(tasks, "row", "leaf").mapInArrow(resting(encode_leaves), "row long, id long, leaf int, ids binary, lengths binary")
    joined = pieces.groupBy("row").applyInArrow(concatenate, f"id long, {columns}")
    return short.unionByName(joined)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
           leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``(id, ids)``: the ids of every whole text, as the tokenizer's library
    gives them without added special tokens.  Null text counts as empty and
    has no ids; rows that repeat an id are encoded each; a null id stays null; an
    empty table gives an empty result; other columns of ``docs`` play no part.
    """
    def listed(model: Bpe, ids: list[list[int]]) -> list[pa.Array]:
        return [pa.array(ids, pa.list_(pa.int32()))]

    return _encoded(docs, listed, "ids array<int>", id_col, text_col, tokenizer or default_tokenizer(), leaf_chars)


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``(id, ids, text)``: the text of every row of ids, special tokens kept."""
    ship_package(encoded.sparkSession)
    bound_batches(encoded.sparkSession)
    path = tokenizer or default_tokenizer()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            for i, one in enumerate(ids):
                text = pa.array([model.decode(one or [])], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:i + 1], batch.column(1)[i:i + 1], text],
                                                 ["id", "ids", "text"])

    return encoded.select("id", "ids").mapInArrow(resting(texts), "id long, ids array<int>, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
               leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: the
    digests of the ids (little-endian, 32 bits) and of the decoded text.  Ids are
    decoded and digested in the task that has encoded them; nulls, repeated rows
    and empty tables are as for ``encode``."""
    def digests(model: Bpe, ids: list[list[int]]) -> list[pa.Array]:
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array([digest_ids(x) for x in ids], pa.string()),
                pa.array([digest_text(model.decode(x)) for x in ids], pa.string())]

    return _encoded(docs, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col,
                    tokenizer or default_tokenizer(), leaf_chars).withColumnRenamed("id", "doc_id")
