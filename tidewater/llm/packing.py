"""Best-fit packing by sums of squares: fill training sequences of a fixed number of tokens.

Texts become token ids and a closing id, cut into pieces only where they are longer than a sequence.  Pieces are dealt by a hash into
groups of bounded size; within a group they are placed one by one, longest first, where the sum over residual gaps of the squared
number of open sequences with that gap becomes smallest.  Only the counts per gap matter to that choice, so a group's state is one
array of as many numbers as a sequence has tokens, and what a group wastes is a few open sequences.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bytes of texts whose distinct words are encoded together (or one text), words in one call, and texts gathered at a time.
GROUP_TEXT, _JOINED, _GATHERED = 32 << 20, 4_000, 500
_CLOSERS = ".,;:!?"
#: Letters that normal forms and lower case leave one letter each.
_LATIN = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"
_MARKS = (".", ",", ";", ":", "!", "?", ".,", "?!", "...", ";:!")
_PROBES = (
    "a b", "word  Word\n\tWORD", " led ", "it's 'tis don't DON'T we'll 's", "3.14 1,000 v2.0 x1y22", "(a) [b] {c} <d> a-b a_b a/b", "end. End, END; so: yes! no? ... ?! .,;",
    "\u00e9t\u00e9 E\u0301te\u0301 \u00df \u00d1 \u0130 \u03a3\u03a3", "\u6771\u4eac \ud55c\uad6d \u0301x", "a\u00a0b \u3000c", "http://a.b/c?d=e#f me@x.org", "&&& $$$ #* %%", "\U0001f600 a\U0001f600b",
)
GROUP_BYTES, GROUP_ROWS = 96 << 20, 60_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of texts as arrays of packed 32-bit numbers.

    Where a tokenizer's ids don't depend on what stands beyond white space, each distinct word of a group of texts is encoded once, by the
    tokenizer itself, and the texts' ids are gathered from the words'.  Whether that holds is tried on probe texts for every
    tokenizer; if it doesn't, whole texts are encoded.  A word of letters with closing punctuation is encoded as its
    letters and that punctuation, if the probes allow that, too.  Words of one pre-token each can share a call: the tokenizer's
    mark for word ends tells them apart again, and a call with more ends than words is repeated word by word.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.joins = bool(suffix)
        whole = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.by_word = all(whole(text) == [i for w in text.encode().split() for i in whole(w.decode())] for text in _PROBES)
        bare = [w for w in " ".join(_PROBES).split() if re.fullmatch(_LATIN, w)]
        self.trims = all(whole(w + mark) == whole(w) + whole(mark) for w in bare for mark in _MARKS)

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.array([len(x) for x in got], dtype=np.int64)
        return np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum())), sizes

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes = [], []
        for at in range(0, len(words), _JOINED):
            part = words[at : at + _JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            own = np.diff(ends, prepend=0)
            if len(ends) != len(part) or ends[-1] != len(ids):
                ids, own = self._plain(part)
            flat.append(ids)
            sizes.append(own)
        return np.concatenate([*flat, np.zeros(0, np.uint32)]), np.concatenate([*sizes, np.zeros(0, np.int64)])

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, one after another, and where those of each start and how many there are."""
        tails = pa.array([""] * len(words))
        if self.trims:
            stem = pc.ascii_rtrim(words, characters=_CLOSERS)
            bare = pc.match_substring_regex(stem, f"^{_LATIN}$")
            tails = pc.if_else(bare, pc.replace_substring_regex(words, r"^\pL+", ""), "")
            words = pc.if_else(bare, stem, words)
        parts = pc.unique(pa.concat_arrays([words, tails]))
        alone = pc.utf8_is_alpha(parts)
        order = pa.concat_arrays([parts.filter(alone), parts.filter(pc.invert(alone))])
        one = pc.sum(alone).as_py() or 0
        texts = order.to_pylist()
        flat, sizes = (np.concatenate(x) for x in zip((self._joined if self.joins else self._plain)(texts[:one]), self._plain(texts[one:]), strict=True))
        pairs = np.stack([pc.index_in(x, value_set=order).to_numpy() for x in (words, tails)], axis=1).ravel()
        starts = np.cumsum(sizes) - sizes
        return _gathered(flat, starts, sizes, pairs), *_bounds(sizes[pairs].reshape(-1, 2).sum(axis=1))

    def ids(self, texts: pa.Array, close: int) -> Iterator[np.ndarray]:
        """The ids of each text, with a closing one."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            for text in texts.to_pylist():
                yield np.array([*self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, close], dtype="<u4")
            return
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        flat, starts, sizes = self._words(words.dictionary)
        flat = np.concatenate([flat, np.array([close], np.uint32)])
        starts, sizes = np.append(starts, len(flat) - 1), np.append(sizes, 1)
        which, ends = words.indices.to_numpy(), split.offsets.to_numpy()
        for at in range(0, len(texts), _GATHERED):
            cut = ends[at : at + _GATHERED + 1].astype(np.int64)
            own = np.insert(which[cut[0] : cut[-1]], cut[1:] - cut[0], len(sizes) - 1)
            ids = _gathered(flat, starts, sizes, own).astype("<u4", copy=False)
            stops = np.concatenate([[0], np.cumsum(sizes[own])])[cut - cut[0] + np.arange(len(cut))]
            for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
                yield ids[a:b]


def _bounds(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(sizes) - sizes, sizes


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of flat that which names, one after another."""
    size = sizes[which]
    ahead = np.cumsum(size) - size
    return flat[np.repeat(starts[which] - ahead, size) + np.arange(int(size.sum()))]


_encoders: dict[str, Encoder] = {}


def _groups_of(texts: pa.Array, most: int = GROUP_TEXT) -> Iterator[tuple[int, pa.Array]]:
    """Texts in groups of a bounded number of bytes, or of one text, with the place of the first."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def _pieces(path: str, capacity: int, close: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders[path] = _encoders.get(path) or Encoder(path)
        for batch in batches:
            for at, texts in _groups_of(batch.column("text")):
                out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
                for doc_id, ids in zip(batch.column("doc_id").slice(at, len(texts)).to_pylist(), encoder.ids(texts, close), strict=True):
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        for c, v in zip(out, (doc_id, piece, start, len(part), zlib.crc32(part)), strict=True):
                            out[c].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if c == "piece" else pa.int64()) for c, v in out.items()], names=list(out))

    return run


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, longest first; a sequence is opened only where no open one has room.

    Among the gaps that hold the piece it takes the one after which the squared counts of open sequences per gap sum to least, the
    smallest such gap.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    number, offset = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    opened = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        here = counts[size:capacity]
        gap = capacity
        if here.any():
            change = 2 * (counts[: capacity - size] - here) + 2
            if len(change):
                change[0] = 1 - 2 * here[0]  # it closes: gap 0 isn't counted
            change[here == 0] = np.iinfo(np.int64).max
            gap = size + int(np.argmin(change))
        if gap == capacity:
            which, opened = opened, opened + 1
        else:
            which = open_[gap].pop()
            counts[gap] -= 1
        number[i], offset[i] = which, capacity - gap
        if gap > size:
            open_[gap - size].append(which)
            counts[gap - size] += 1
    return number, offset


def _place(capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "length", "ids_crc32"], kind="stable").reset_index(drop=True)
        number, group["offset"] = sum_of_squares(group["length"].to_numpy(), capacity)
        group["sequence_id"] = group.pop("pack_group").astype("int64") * 2**32 + number
        return group

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, close: int = 0) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A null or empty text is the closing id alone, and a text of any length is cut only into pieces of capacity.  Rows of one doc_id are packed each for itself; a null doc_id stays null.  An empty
    table gives no rows.  Other columns are ignored.
    """
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col("text").cast("string")))).first()
    groups = max(1, -(-int(size or 0) // GROUP_BYTES), -(-rows // GROUP_ROWS))
    pieces = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_pieces(tokenizer, capacity, close), _PIECES)
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    return dealt.groupBy("pack_group").applyInPandas(_place(capacity), f"{_PIECES}, sequence_id long, offset long")
