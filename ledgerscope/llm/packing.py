"""Order-preserving packing of tokenised documents into sequences of bounded length.

Documents keep the order of their partition and form one stream of tokens.  Dynamic programming
chooses the cuts between sequences: at document ends (free), at sentence ends (a truncation
penalty) or, where neither comes for ``HARD_GAP`` tokens, at hard cut points (a larger one).
With P the position of a cut and f the least cost of the stream before it,

    f[i] = penalty[i] + (L - P[i]) + min { f[j] + P[j] : P[i] - L <= P[j] < P[i] },

and since the window over j only moves forward, a monotone queue gives every minimum in
amortised constant time.  A task solves its stream in blocks of ``BLOCK`` tokens (or one
document): the cheapest end among the last L tokens is final, the rest opens the next block.  The
last rest of a task (fewer than L tokens) is cut into lengths that are powers of two, which need
no padding.

Tokenising: white space never lies inside a token of the given vocabulary and is dropped, so a
text's ids are those of its white-space-separated pieces, and pieces repeat; texts are encoded in
blocks of some megabytes, each distinct piece once.  Whatever isn't plainly the same that
way goes through the tokenizer itself.  A very long text is tokenised and held whole by its task.

Defined cases: NULL text counts as empty: its only token is the end mark.  NULL ids and repeated
rows are packed like any other row.  An empty table gives no sequence.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.llm.bpe import BatchBpe
from ledgerscope.llm.common import ship_package, tidy
from ledgerscope.llm.words import Words, bytes_of, large_binary, pieces

BLOCK = 262_144
ENCODED_AT_ONCE = 4_000_000      # bytes of text
EMITTED_AT_ONCE = 1_000_000      # ids of an output batch (or one sequence more)
HARD_GAP = 1024
SENTENCE_PENALTY, HARD_PENALTY = 4.0, 256.0
#: Characters outside of which lower case, normal form and classes are left to the tokenizer.
_ODD = re.compile("[^\n!-~\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]")
#: The vocabulary's splitting rule for the other texts, with the line ends between pieces.
_WORDS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_BETWEEN = b"\xff\xff"          # no id: ids stay below 0xff00
#: Pieces of a sequence.
PIECES = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("ids", T.BinaryType())])


class Encoder:
    """Ids of texts for a vocabulary file with byte-level pieces, lower case and word ends.

    A block of texts is split into white-space-separated pieces, numbered by Arrow; its distinct
    pieces are split into words in numpy where they are plain ASCII, and each distinct word is
    encoded once, many together (``BatchBpe``).  Pieces with other characters are split by the
    vocabulary's rule; those outside the plain ranges, special tokens and very long words go through
    the tokenizer itself.  Nothing is kept from one block to the next.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        if max(vocab.values()) >= 0xFF00:
            raise ValueError(f"{path}: ids above 65,279")
        self.bpe = BatchBpe(vocab, model["merges"], suffix)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ends_sentence = np.zeros(65_536, bool)
        self.ends_sentence[[vocab[c + s] for c in ".!?" for s in ("", suffix) if c + s in vocab]] = True
        # kinds of bytes: 0 letter, 1 other mark, from 2 on a digit (each is a word of its own)
        self.kind = np.full(256, 1, np.int8)
        self.kind[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 0
        self.kind[0x30:0x3A] = 2
        self.other = np.ones(256, bool)             # bytes that leave a piece to the rule in words
        self.other[0x21:0x7F] = False
        self.other[[0x27, *{ord(t[0]) for t in self.special}]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def by_word(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        short = [i for i, w in enumerate(words) if len(w) <= BatchBpe.LONGEST]
        out = [b""] * len(words)
        for i, ids in zip(short, self.bpe.encode([words[i] for i in short]), strict=True):
            out[i] = ids
        for i, w in enumerate(words):
            if len(w) > BatchBpe.LONGEST:
                out[i] = self.whole(w.decode())
        return out

    def by_rule(self, raw: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces, split by the vocabulary's rule."""
        whole = b"\n".join(raw)
        texts = whole.decode().split("\n") if raw else []
        special = [s for s in self.special if s.encode() in whole]
        ids = {p: self.whole(p) for p in texts if _ODD.search(p) or special and any(s in p for s in special)}
        plain = [p for p in texts if p not in ids] if ids else texts
        words = _WORDS.findall("\n".join(plain).lower())
        distinct = [w for w in dict.fromkeys(words) if w != "\n"]
        known = dict(zip(distinct, self.by_word([w.encode() for w in distinct]), strict=True))
        known["\n"] = _BETWEEN
        if plain:
            ids.update(zip(plain, b"".join(map(known.__getitem__, words)).split(_BETWEEN), strict=True))
        return [ids[p] for p in texts]

    def of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct pieces, one after another; number of ids of each)."""
        data, off = bytes_of(pieces)
        odd = np.diff(np.concatenate([[0], np.cumsum(self.other[data])])[off]) > 0
        inside = np.repeat(~odd, np.diff(off))
        text = data[inside]
        upper = (text >= 0x41) & (text <= 0x5A)
        text = np.where(upper, text | 0x20, text).astype(np.uint8)
        kind = self.kind[text]
        new = np.ones(len(text), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        ends = np.cumsum(np.diff(off)[~odd])
        new[np.concatenate([[0], ends[:-1]])[:len(ends)]] = True
        starts = np.flatnonzero(new)
        words = large_binary(text, np.append(starts[1:], len(text))[:len(starts)]).dictionary_encode()
        known = self.by_word(words.dictionary.to_pylist()) + self.by_rule(pieces.filter(pa.array(odd)).to_pylist())
        n_plain = len(words.dictionary)
        # the words of each piece; an odd piece is one word
        count = np.ones(len(pieces), np.int64)
        count[~odd] = np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
        codes = np.empty(int(count.sum()), np.int64)
        own = np.repeat(odd, count)
        codes[~own] = words.indices.to_numpy(zero_copy_only=False)
        codes[own] = n_plain + np.arange(int(odd.sum()))
        sizes = np.array([*map(len, known)], np.int64) // 2
        store = np.frombuffer(b"".join(known), "<u2")
        ids, reach = _gathered(store, sizes, codes)
        total = np.concatenate([[0], reach])[np.concatenate([[0], np.cumsum(count)])]
        return ids, np.diff(total)

    def encode(self, texts: pa.Array | list[str], end: int) -> list[np.ndarray]:
        """Ids of each text, followed by ``end``."""
        w = Words(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        store, sizes = self.of_pieces(w.distinct)
        codes = np.insert(w.codes, w.doc_ends, len(sizes))              # the end mark is one more piece
        ids, reach = _gathered(np.append(store, np.uint16(end)).astype("<u2"), np.append(sizes, 1), codes)
        at = reach[w.doc_ends + np.arange(len(w.doc_ends))]
        return [ids[i:j] for i, j in zip(np.concatenate([[0], at[:-1]]).tolist(), at.tolist(), strict=True)]


def _gathered(store: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the stored stretches of ``codes``, one after another; their ends)."""
    n = sizes[codes]
    ends = np.cumsum(n)
    first = (np.cumsum(sizes) - sizes)[codes]
    return store[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - first, n)], ends


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_points(lengths: list[int], inner: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, penalties) of the allowed cuts of a stream of documents, ascending; ``inner``
    holds the sentence ends inside each document."""
    ends = np.cumsum(np.array(lengths, np.int64))
    begins = ends - np.array(lengths, np.int64)
    soft = [i + b for i, b in zip(inner, begins, strict=True)]
    pos = np.unique(np.concatenate([ends, *soft])) if len(ends) else ends
    pen = np.where(np.isin(pos, ends), 0.0, SENTENCE_PENALTY)
    gaps = np.diff(pos, prepend=0)
    wide = np.flatnonzero(gaps > HARD_GAP)
    if len(wide):
        extra = np.concatenate([np.arange(pos[i] - gaps[i] + HARD_GAP, pos[i], HARD_GAP) for i in wide])
        pos = np.concatenate([pos, extra])
        pen = np.concatenate([pen, np.full(len(extra), HARD_PENALTY)])
        order = np.argsort(pos, kind="stable")
        pos, pen = pos[order], pen[order]
    return pos, pen


def best_cuts(pos: list[int], pen: list[float], limit: int) -> tuple[list[float], list[int]]:
    """(least cost, previous cut or -1 for the stream's start) of every cut, by the recurrence
    of the module docstring.  ``pos`` ascends in steps of at most ``limit``."""
    cost, back = [0.0] * len(pos), [0] * len(pos)
    queue: deque[tuple[int, float, int]] = deque([(0, 0.0, -1)])   # ascending f[j] + P[j]
    for i, p in enumerate(pos):
        low = p - limit
        while queue[0][0] < low:
            queue.popleft()
        _, least, j = queue[0]
        c = cost[i] = pen[i] + limit - p + least
        back[i] = j
        value = c + p
        while queue and queue[-1][1] >= value:
            queue.pop()
        queue.append((p, value, i))
    return cost, back


def powers_of_two(n: int) -> list[int]:
    """Lengths that are powers of two, largest first, with sum n."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def windows(pos: np.ndarray, pen: np.ndarray, total: int, limit: int, last: bool) -> list[int]:
    """Ends of the sequences of a block.  Unless ``last``, the rest after the final end opens the
    next block; if ``last``, it is cut into powers of two."""
    ends: list[int] = []
    if total > limit or not last:
        p, q = pos.tolist(), pen.tolist()
        cost, back = best_cuts(p, q, limit)
        near = [i for i in range(len(p)) if p[i] > total - limit]
        i = min(near, key=lambda i: (cost[i], -p[i]))
        while i >= 0:
            ends.append(p[i])
            i = back[i]
        ends.reverse()
    if last:
        at = ends[-1] if ends else 0
        for n in powers_of_two(total - at):
            at += n
            ends.append(at)
    return ends


class Packer:
    """The stream of one task: add documents, take finished pieces."""

    def __init__(self, limit: int, first_id: int, ends_sentence: np.ndarray):
        self.limit, self.next_id, self.ends_sentence = limit, first_id, ends_sentence
        self.docs: list[tuple[object, np.ndarray, int, int]] = []  # key, ids left, start, all ids
        self.size = 0

    def add(self, key: object, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((key, ids, 0, len(ids)))
        self.size += len(ids)
        if self.size >= BLOCK:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        """(key, start, length, doc_tokens, sequence_id, offset, ids) of the finished sequences."""
        if not self.size:
            return
        inner = [np.flatnonzero(self.ends_sentence[d[1][:-1]]) + 1 for d in self.docs]
        pos, pen = cut_points([len(d[1]) for d in self.docs], inner)
        begin, k, used = 0, 0, 0                    # used: ids taken of document k
        for end in windows(pos, pen, self.size, self.limit, last):
            at = begin
            while at < end:
                key, ids, start, n = self.docs[k]
                take = min(len(ids) - used, end - at)
                yield (key, start + used, take, n, self.next_id, at - begin,
                       ids[used:used + take].astype("<u4").tobytes())
                at, used = at + take, used + take
                if used == len(ids):
                    k, used = k + 1, 0
            begin = end
            self.next_id += 1
        self.docs = self.docs[k:]
        if self.docs and used:
            key, ids, start, n = self.docs[0]
            self.docs[0] = (key, ids[used:], start + used, n)
        self.size -= begin


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 4096,
         tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Pieces of all documents in sequences of at most ``limit`` tokens: ``key``, ``start``,
    ``length``, ``doc_tokens``, ``sequence_id``, ``offset`` and ``ids`` (the piece's ids as
    little-endian unsigned 32-bit integers).

    ``sequence_id`` is unique over all tasks: the partition number and a counter.  No shuffle.
    """
    if limit < HARD_GAP:
        raise ValueError(f"limit must be at least {HARD_GAP}")
    ship_package(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    src = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = T.StructType([src.schema[key], *PIECES.fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        packer = Packer(limit, TaskContext.get().partitionId() << 33, enc.ends_sentence)
        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            arrays = [pa.array(cols[0], kind)] + [pa.array(c, pa.int64()) for c in cols[1:6]]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(cols[6], pa.binary())], names)

        kind = pa.int64()
        for b in batches:
            kind = b.schema.field(0).type
            for i, j in pieces(b.column(1), ENCODED_AT_ONCE):
                keys = b.column(0).slice(i, j - i).to_pylist()
                for key, ids in zip(keys, enc.encode(b.column(1).slice(i, j - i), end_id), strict=True):
                    for row in packer.add(key, ids):
                        out.append(row)
                        held += row[2]
                        if held >= EMITTED_AT_ONCE:
                            yield batch()
                            out.clear()
                            held = 0
        out.extend(packer.flush(True))
        if out:
            yield batch()

    return src.mapInArrow(tidy(run), schema)
