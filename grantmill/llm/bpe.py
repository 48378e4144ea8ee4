"""Byte-pair merging of words: encoding with a segment tree, counting with a heap, decoding.

A vocabulary is the text of a tokenizer file of the tokenizers library: byte-level
BPE whose words carry an end mark. Its path is the caller's; the text is broadcast
(fixed size, under two megabytes). Words are found as the file says: special strings
first, then NFC, white space to blanks, lower case, then the split pattern.

Both ways of merging look at each different word once per task as long as it is
remembered. The memory is bounded and only saves time.

Null texts are empty texts and give no tokens. Null ids and repeated rows are kept:
one row comes out for each row that goes in. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantmill.llm.common import Remembered, chunks, ship, texts

NONE = np.iinfo(np.int64).max
NO_ID = 0xFFFF
LOW = (1 << 32) - 1
# Words that need wider trees use the tree of one word at a time.
TABLE_WIDTH = 64
# Blocks and words remembered, twice: those seen lately and those before them.
REMEMBERED = 300_000
# Latin letters, their marks and general punctuation: here Python's tables and the
# library's agree. Other scripts go through the library's own normaliser and splitter.
OTHER_SCRIPT = re.compile("[^\u0000-\u036f\u2000-\u206f\u20ac]")
# The Unicode white space characters (fixed values).
BLANK = "\\x09-\\x0d\\x20\\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = re.compile(f"[{BLANK}]+")
# What may part a run without ASCII white space.
PARTS_RUN = re.compile(rf"<\||[{BLANK}]")
# What str.split takes for white space beyond these.
NOT_BLANK = "\x1c\x1d\x1e\x1f"
ROWS_AT_ONCE = 256
RUNS_AT_ONCE = 1 << 18
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_symbols() -> list[str]:
    """The character that byte-level vocabularies write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _class(kind: str) -> str:
    """Characters below U+0370 of a general category, for a pattern's brackets."""
    return "".join(re.escape(chr(c)) for c in range(0x370) if unicodedata.category(chr(c))[0] == kind)


def numbering() -> defaultdict[str, int]:
    """Numbers strings from 0 in the order in which they are first asked for."""
    numbers: defaultdict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


class WordVocabulary:
    """Merges, symbols and word splitting of one tokenizer file."""

    def __init__(self, spec: str):
        self.spec = spec
        content = json.loads(spec)
        model = content["model"]
        self.end = model.get("end_of_word_suffix") or ""
        pattern = content["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if model["type"] != "BPE" or pattern != "|".join([*CONTRACTIONS, r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"]):
            raise ValueError("not a vocabulary of words with end marks")
        ids = model["vocab"]
        if max(ids.values()) >= NO_ID:
            raise ValueError("pairs are kept as two 16-bit ids")
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, number in chain(ids.items(), self.special.items()):
            self.tokens[number] = token
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int64)
        self.last = np.array([ids[s + self.end] for s in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] << 16 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order].astype(np.uint32), order
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        # The bytes' symbols are most pairs that are looked up: their ranks by place in a square.
        self.low = 1 + int(max(self.inner.max(), self.last.max()))
        pairs_of_bytes = (self.keys >> 16 < self.low) & (self.keys & 0xFFFF < self.low)
        self.low_ranks = np.full((self.low + 1, self.low + 1), NONE)
        self.low_ranks[self.keys[pairs_of_bytes] >> 16, self.keys[pairs_of_bytes] & 0xFFFF] = order[pairs_of_bytes]
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        letters, numbers = _class("L"), _class("N")
        self.split = re.compile(
            "|".join([*CONTRACTIONS, f"[{letters}]+", f"[{numbers}]", f"[^{BLANK}{letters}{numbers}]+"])
        )
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.bytes_of = {s: b for b, s in enumerate(symbols)}
        self.ids_of_word: Remembered[bytes] = Remembered(REMEMBERED, __name__)
        self.ids_of_block: Remembered[bytes] = Remembered(REMEMBERED, __name__)
        self.size_of_word: Remembered[int] = Remembered(2 * REMEMBERED, __name__)
        self.size_of_block: Remembered[int] = Remembered(2 * REMEMBERED, __name__)

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.spec)

    @functools.cached_property
    def strings(self) -> pa.Array:
        return pa.array(self.tokens, pa.string())

    def blocks(self, text: str) -> list[str]:
        """Runs without white space, in order, with special strings as blocks of their own.

        No word and no step of normalising reaches across white space, so a block can be
        looked up as it stands and only new ones need to be normalised and split.
        """
        if "<|" not in text or not self.marks.search(text):
            return self._plain_blocks(text)
        found: list[str] = []
        at = 0
        for mark in self.marks.finditer(text):
            found += self._plain_blocks(text[at : mark.start()])
            found.append(mark.group())
            at = mark.end()
        return found + self._plain_blocks(text[at:])

    @staticmethod
    def _plain_blocks(text: str) -> list[str]:
        if any(c in text for c in NOT_BLANK):
            return [b for b in BLANKS.split(text) if b]
        return text.split()

    def words(self, block: str) -> list[str]:
        """The words to merge in a block that is not a special string."""
        if block.isascii():
            normal = block.lower()
        else:
            normal = unicodedata.normalize("NFC", block).lower()
            if OTHER_SCRIPT.search(normal):
                return self._words_by_library(block)
        # Most blocks are a word, or a word and one more character.
        if normal.isalpha():
            return [normal]
        if normal[-1] in ".,|!" and normal[:-1].isalpha():
            return [normal[:-1], normal[-1]]
        return self.split.findall(normal)

    def words_of(self, blocks: list[str]) -> list[str | list[str]]:
        """The words of each of many blocks, as by `words`; a single one as it is.

        No step of normalising reaches across a blank, so all blocks are normalised as one line.
        """
        line = " ".join(blocks)
        normal = line.lower() if line.isascii() else unicodedata.normalize("NFC", line).lower()
        plain = normal.isascii() or not OTHER_SCRIPT.search(normal)
        return [
            self._words_by_library(b)
            if not (plain or n.isascii()) and OTHER_SCRIPT.search(n)
            else n
            if n.isalpha()
            else [n[:-1], n[-1]]
            if n[-1] in ".,|!" and n[:-1].isalpha()
            else self.split.findall(n)
            for b, n in zip(blocks, normal.split(" ") if blocks else [], strict=True)
        ]

    def _words_by_library(self, block: str) -> list[str]:
        normal = self.library.normalizer.normalize_str(block)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(map(self.bytes_of.__getitem__, piece)).decode() for piece, _ in pieces]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left << 16 | right).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def symbols(self, word: str) -> np.ndarray:
        raw = np.frombuffer(word.encode(), np.uint8)
        ids = self.inner[raw]
        ids[-1] = self.last[raw[-1]]
        return ids


@functools.lru_cache(maxsize=2)
def vocabulary(spec: str) -> WordVocabulary:
    return WordVocabulary(spec)


# --- encoding: a segment tree over the ranks of adjacent pairs -----------------------------


def merge_by_tree(vocab: WordVocabulary, word: str) -> list[int]:
    """Ids of one word of any length.

    Leaf i holds (rank, i) of the pair that starts at symbol i. The root is then the
    lowest rank, leftmost. A merge changes at most three leaves and their paths.
    """
    ids = vocab.symbols(word).tolist()
    n = len(ids)
    if n < 2:
        return ids
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    ranks, merged = vocab.rank_of, vocab.merged
    none = (len(merged), 0)
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = ranks.get(ids[i] << 16 | ids[i + 1])
        if rank is not None:
            tree[width + i] = (rank, i)
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(leaf: int, value: tuple[int, int]) -> None:
        i = width + leaf
        tree[i] = value
        while i > 1:
            i >>= 1
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                break
            tree[i] = least

    def pair(left: int) -> tuple[int, int]:
        right = following[left]
        rank = ranks.get(ids[left] << 16 | ids[right]) if right < n else None
        return none if rank is None else (rank, left)

    while tree[1] != none:
        rank, left = tree[1]
        gone = following[left]
        ids[left] = int(merged[rank])
        following[left] = after = following[gone]
        ids[gone] = -1
        if after < n:
            before[after] = left
        if gone < n - 1:
            put(gone, none)
        put(left, pair(left))
        if before[left] >= 0:
            put(before[left], pair(before[left]))
    return [i for i in ids if i >= 0]


def merge_by_trees(vocab: WordVocabulary, words: list[str]) -> list[bytes]:
    """Ids of many words, each little-endian 32 bits, with one tree per word in a table of trees."""
    coded = [w.encode() for w in words]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    out: list[bytes] = [b""] * len(words)
    # A place before and one after the symbols; trees of the same width share a table.
    widths = 1 << np.ceil(np.log2(sizes + 2)).astype(np.int64)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        if width > TABLE_WIDTH:
            for row in rows.tolist():
                out[row] = np.array(merge_by_tree(vocab, words[row]), "<u4").tobytes()
            continue
        for start in range(0, len(rows), 1 << 13):
            part = rows[start : start + (1 << 13)]
            ids, live = _merge_table(vocab, [coded[r] for r in part.tolist()], sizes[part], width)
            flat = ids[live].astype("<u4").tobytes()
            ends = (live.sum(axis=1).cumsum() * 4).tolist()
            begin = 0
            for row, end in zip(part.tolist(), ends, strict=True):
                out[row] = flat[begin:end]
                begin = end
    return out


def _merge_table(
    vocab: WordVocabulary, coded: list[bytes], sizes: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Symbol ids of words (rows) after all merges, and which of them are left.

    Symbols stand at places 1 to n of a row, with an id that pairs with nothing before
    and after them. All arrays are flat; row r begins at r * width, its tree at 2 * r * width.
    """
    n = len(coded)
    inside = (np.arange(width) >= 1) & (np.arange(width) <= sizes[:, None])
    raw = np.zeros((n, width), np.uint8)
    raw[inside] = np.frombuffer(b"".join(coded), np.uint8)
    ids = np.where(inside, vocab.inner[raw], NO_ID)
    every = np.arange(n)
    ids[every, sizes] = vocab.last[raw[every, sizes]]
    shift = width.bit_length()
    place = np.arange(width)
    tree = np.full((n, 2 * width), NONE)
    # The last place of a row holds no symbol, so the pair across its edge is none.
    low = np.minimum(ids, vocab.low)
    ranks = vocab.low_ranks[low[:, :-1], low[:, 1:]]
    tree[:, width:-1] = np.where(ranks == NONE, NONE, (ranks & LOW) << shift | place[:-1])
    for i in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
    ids, tree, live = ids.ravel(), tree.ravel(), inside.ravel()
    following = np.tile(place + 1, n)
    before = np.tile(place - 1, n)
    top = 2 * width * every
    top = top[tree[top + 1] != NONE]
    levels = range(width.bit_length() - 1)
    while len(top):
        base = top >> 1
        root = tree[top + 1]
        left, rank = root & ((1 << shift) - 1), root >> shift
        at = base + left
        gone = following[at]
        after = following[base + gone]
        prior = before[at]
        ids[at] = new = vocab.merged[rank]
        live[base + gone] = False
        following[at] = after
        before[base + after] = left
        # Three leaves change: the pair of the symbol that went, of the new one, and the one before it.
        k = len(top)
        changed = vocab.pair_ranks(
            np.concatenate([new, ids[base + prior]]), np.concatenate([ids[base + after], new])
        )
        where = np.concatenate([left, prior])
        changed = np.where(changed == NONE, NONE, (changed & LOW) << shift | where)
        node = np.concatenate([where, gone]) + width
        tops = np.concatenate([top, top, top])
        tree[tops[2 * k :] + node[2 * k :]] = NONE
        tree[tops[: 2 * k] + node[: 2 * k]] = changed
        for _ in levels:
            node >>= 1
            child = tops + 2 * node
            tree[tops + node] = np.minimum(tree[child], tree[child + 1])
        top = top[tree[top + 1] != NONE]
    return ids.reshape(n, width), live.reshape(n, width)


def encode_blocks(vocab: WordVocabulary, blocks: list[str]) -> list[bytes]:
    """Ids of different runs without ASCII white space, as little-endian 32-bit numbers."""
    known, of_word = vocab.ids_of_block.turn(), vocab.ids_of_word.turn()
    known[""] = b""
    known.update((mark, np.array([i], "<u4").tobytes()) for mark, i in vocab.special.items())
    found = list(map(known.get, blocks))
    new = list(vocab.ids_of_block.recall({b for b, ids in zip(blocks, found, strict=True) if ids is None}))
    # Special strings and other white space inside a run part it further.
    odd = [b for b in new if PARTS_RUN.search(b)] if PARTS_RUN.search("".join(new)) else []
    parted = {b: parts for b in odd if (parts := vocab.blocks(b)) != [b]}
    if parted:
        inner = list(set().union(*parted.values()))
        of_inner = dict(zip(inner, encode_blocks(vocab, inner), strict=True))
        known.update((b, b"".join([of_inner[p] for p in parts])) for b, parts in parted.items())
        new = [b for b in new if b not in known]
    # The words of the new runs by number, so that each word is looked up once.
    numbers = numbering()
    made = [numbers[w] if type(w) is str else [numbers[x] for x in w] for w in vocab.words_of(new)]
    words = list(numbers)
    unseen = list(vocab.ids_of_word.recall({w for w in words if w not in of_word}))
    of_word.update(zip(unseen, merge_by_trees(vocab, unseen), strict=True))
    coded = list(map(of_word.__getitem__, words))
    known.update(
        (block, coded[word] if type(word) is int else b"".join([coded[w] for w in word]))
        for block, word in zip(new, made, strict=True)
    )
    return [known[b] if ids is None else ids for b, ids in zip(blocks, found, strict=True)]


def encode_texts(vocab: WordVocabulary, given: list[str]) -> list[bytes]:
    """Ids of each text, as little-endian 32-bit numbers.

    Each different run without white space is looked up once for all texts; the ids are then
    put in the order of the texts together.
    """
    split = pc.ascii_split_whitespace(pa.array(given, pa.string()))
    runs = split.flatten().dictionary_encode()
    flat, bounds = runs.indices.to_numpy(), split.offsets.to_numpy()
    if not len(flat):
        return [b""] * len(given)
    line = pc.binary_join(pa.ListArray.from_arrays([0, len(runs.dictionary)], runs.dictionary), " ")
    coded = encode_blocks(vocab, line[0].as_py().split(" "))
    ids = np.frombuffer(b"".join(coded), "<u4")
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    starts = sizes.cumsum() - sizes
    ordered = []
    for at in range(0, len(flat), RUNS_AT_ONCE):
        some = flat[at : at + RUNS_AT_ONCE]
        length = sizes[some]
        ends = length.cumsum()
        ordered.append(ids[np.repeat(starts[some] - ends + length, length) + np.arange(ends[-1])].tobytes())
    whole = b"".join(ordered)
    cuts = 4 * np.concatenate([[0], sizes[flat].cumsum()])[bounds - bounds[0]]
    return [whole[begin:end] for begin, end in pairwise(cuts.tolist())]


# --- counting: a heap of pairs over a linked list of symbols -------------------------------


def count_by_heap(vocab: WordVocabulary, word: str) -> int:
    """Tokens of one word: its symbols less the merges. No ids are made.

    The heap gives the lowest rank, leftmost. An entry is stale if its left symbol
    has changed or is no longer followed by the one it was pushed with.
    """
    ids = vocab.symbols(word).tolist()
    n = left_over = len(ids)
    ranks, merged = vocab.rank_of, vocab.merged
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [
        (rank, i)
        for i in range(n - 1)
        if (rank := ranks.get(ids[i] << 16 | ids[i + 1])) is not None
    ]
    heapq.heapify(heap)
    while heap:
        rank, left = heapq.heappop(heap)
        right = following[left]
        if ids[left] < 0 or right >= n or ranks.get(ids[left] << 16 | ids[right]) != rank:
            continue
        ids[left], ids[right] = int(merged[rank]), -1
        left_over -= 1
        following[left] = after = following[right]
        if after < n:
            before[after] = left
            again = ranks.get(ids[left] << 16 | ids[after])
            if again is not None:
                heapq.heappush(heap, (again, left))
        prior = before[left]
        if prior >= 0:
            again = ranks.get(ids[prior] << 16 | ids[left])
            if again is not None:
                heapq.heappush(heap, (again, prior))
    return left_over


def count_texts(vocab: WordVocabulary, given: list[str]) -> list[int]:
    known, of_word = vocab.size_of_block.turn(), vocab.size_of_word.turn()
    known.update(dict.fromkeys(vocab.special, 1))
    sizes = []
    for text in given:
        blocks = vocab.blocks(text)
        found = list(map(known.get, blocks))
        if None in found:
            new = {b for b, size in zip(blocks, found, strict=True) if size is None}
            for block in vocab.size_of_block.recall(new):
                parts = vocab.words(block)
                for word in vocab.size_of_word.recall({w for w in parts if w not in of_word}):
                    of_word[word] = count_by_heap(vocab, word)
                known[block] = sum(map(of_word.__getitem__, parts))
            found = map(known.__getitem__, blocks)
        sizes.append(sum(found))
    return sizes


# --- the same as Spark steps ---------------------------------------------------------------


def load(spark: SparkSession, path: str) -> Broadcast:
    """A tokenizer file's text for the executors. The file is read on the driver only."""
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    vocabulary(spec)  # refuses an unsuitable file here
    return ship(spark).sparkContext.broadcast(spec)


def encode(df: DataFrame, vocab: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_tokens, ids array<int>), one for each row."""
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("n_tokens", T.LongType(), False),
            T.StructField("ids", T.ArrayType(T.IntegerType(), False), False),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(vocab.value)
        for batch in batches:
            for part in chunks(batch, 1, 2 << 20):
                coded = encode_texts(known, texts(part, 1))
                sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
                offsets = pa.array(np.concatenate([[0], sizes.cumsum()]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(coded), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), ids], names=[id_col, "n_tokens", "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(vocab: Broadcast) -> Callable[[Column | str], Column]:
    """A column function from ids to text: the tokens' strings with blanks between, as the
    library joins them for a file without a decoder. Null ids give null, no ids an empty text."""

    def joined(strings: pa.Array, ids: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], lengths.cumsum()]).astype(np.int32))
        lines = pc.binary_join(pa.ListArray.from_arrays(offsets, strings.take(ids.flatten())), " ")
        return pc.if_else(ids.is_null(), None, lines)

    @F.arrow_udf(T.StringType())
    def decoded(ids: pa.Array) -> pa.Array:
        strings = vocabulary(vocab.value).strings
        # A batch may hold millions of ids; their strings are made for a few rows at a time.
        parts = [joined(strings, ids.slice(at, ROWS_AT_ONCE)) for at in range(0, len(ids), ROWS_AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return decoded


def roundtrip(df: DataFrame, vocab: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_tokens, ids_sha256, decoded_sha256), one for each row.

    Texts are encoded and decoded as by `encode` and `decode`, where they are read: ids and
    decoded texts, far larger than their digests, never leave the step. Digests are of the
    decimal ids joined by blanks and of the decoded text in UTF-8, in lower-case hex.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("n_tokens", T.LongType(), False),
            T.StructField("ids_sha256", T.StringType(), False),
            T.StructField("decoded_sha256", T.StringType(), False),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(vocab.value)
        decimals, strings = ([str(i).encode() for i in range(len(known.tokens))], [t.encode() for t in known.tokens])

        def digest(of: list[bytes], ids: list[int]) -> str:
            return hashlib.sha256(b" ".join(map(of.__getitem__, ids))).hexdigest()

        for batch in batches:
            for part in chunks(batch, 1, 1 << 20):
                sizes, coded, decoded = [], [], []
                for ids in encode_texts(known, texts(part, 1)):
                    numbers = np.frombuffer(ids, "<u4").tolist()
                    sizes.append(len(numbers))
                    coded.append(digest(decimals, numbers))
                    decoded.append(digest(strings, numbers))
                columns = [part.column(0), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def count_tokens(df: DataFrame, vocab: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_bytes, n_tokens), one for each row."""
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("n_bytes", T.LongType(), False),
            T.StructField("n_tokens", T.LongType(), False),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(vocab.value)
        for batch in batches:
            for part in chunks(batch, 1, 2 << 20):
                n_bytes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                n_tokens = pa.array(count_texts(known, texts(part, 1)), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), n_bytes, n_tokens], names=[id_col, "n_bytes", "n_tokens"]
                )

    return df.select(id_col, text_col).mapInArrow(run, schema)
