"""Language identification by cross-parsing against suffix automata.

For every language a suffix automaton of labelled text is built; a document is parsed greedily
into phrases, each the longest match that occurs in that text.  With c phrases over a document
of n symbols and a training text of N symbols, c * log2(N) / n estimates the cross entropy;
the language needing the fewest (normalised) phrases wins.

A greedy parse only needs the automaton's forward transitions, so each automaton becomes a
dense table in which a missing transition restarts at the root and is marked as the start of a
phrase.  Texts are parsed whole, in segments of ``SEGMENT`` symbols (a phrase ends with its
segment, for every language alike), many segments side by side, which bounds memory however
long a text is.

Training is a bounded sample: per language ``docs_per_lang`` learnable documents of lowest hash
and one passage of at most ``passage_chars`` code points from each.

Defined cases: a NULL text or one without a letter gives ``und`` with score 0.  Only rows with
a non-NULL ``lang`` and text are learned from; without any, every row is ``und``.  A tie goes
to the language first in sorted order.  Repeated rows are judged alike and all kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.llm.common import blocks, ship_package, tidy

SEGMENT = 512            # symbols parsed in one lane
BLOCK = 3_000_000        # code points handled at once
SEP, RARE, FIRST = 0, 1, 2   # symbol classes: any run of non-letters, rare letters, letters
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


class Automaton:
    """Suffix automaton of a symbol sequence; ``next[s]`` maps symbols to states, 0 is the root."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def table(self, width: int) -> tuple[np.ndarray, int]:
        """(flat int32 table, start entry).  Entry = 2 * width * state + (1 if a phrase starts).

        The extra last state stands before every phrase: all of its transitions start one.
        The last column (padding) stays in the state.
        """
        n = len(self.next)
        root = np.full(width, 2 * width * n + 1, np.int32)   # unseen symbol: a phrase of its own
        for c, t in self.next[0].items():
            root[c] = 2 * width * t + 1
        tab = np.tile(root, (n + 1, 1))
        for s, row in enumerate(self.next):
            for c, t in row.items():
                tab[s, c] = 2 * width * t
        tab[:, width - 1] = 2 * width * np.arange(n + 1, dtype=np.int32)
        return tab.ravel(), 2 * width * n


class Model:
    """Automata of all languages over one alphabet, from ``{lang: [passages]}``."""

    def __init__(self, passages: dict[str, list[str]], alphabet_size: int = 60):
        counts = Counter(ch for ts in passages.values() for t in ts for ch in t.lower()
                         if ch.isalpha() and ord(ch) < 0x10000)
        letters = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:alphabet_size]]
        self.width = FIRST + len(letters) + 1              # the last class pads
        self.lut = np.full(0x10000, SEP, np.int32)
        for c in range(0x80, 0x10000):
            if chr(c).isalpha():
                self.lut[c] = RARE
        for c in range(0x80):
            if chr(c).isalpha():
                self.lut[c] = RARE
        for i, ch in enumerate(letters):
            self.lut[ord(ch)] = FIRST + i
        self.langs = sorted(passages)
        self.tables, self.bits = [], []
        for lang in self.langs:
            symbols, _ = self.symbols(["\n".join(passages[lang])])
            tab, start = Automaton(symbols.tolist()).table(self.width)
            self.tables.append((tab, start))
            self.bits.append(math.log2(max(2, len(symbols))))

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all texts in a row, length of each): lower-cased, every run of
        non-letters one separator."""
        whole = "\x00".join(t.lower().replace("\x00", " ") for t in texts) + "\x00"
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        end = code == 0
        sym = self.lut[np.minimum(code, 0xFFFF)]
        sym[code > 0xFFFF] = RARE
        sep = sym == SEP
        keep = np.ones(len(sym), bool)
        keep[1:] = ~(sep[1:] & sep[:-1] & ~end[:-1])
        keep &= ~end
        ends = np.cumsum(keep)[end]
        return sym[keep], np.diff(ends, prepend=0)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases needed [language, text], symbols of each text)."""
        sym, n = self.symbols(texts)
        n_seg = -(-n // SEGMENT)
        doc = np.repeat(np.arange(len(texts)), n_seg)
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        number = np.arange(len(doc)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
        start = first[doc] + number * SEGMENT
        stop = np.minimum(start + SEGMENT, first[doc] + n[doc])
        at = start[None, :] + np.arange(SEGMENT)[:, None]
        grid = np.full(at.shape, self.width - 1, np.int32)
        inside = at < stop[None, :]
        grid[inside] = sym[at[inside]]
        out = np.zeros((len(self.langs), len(texts)))
        for k, (tab, begin) in enumerate(self.tables):
            v = np.full(len(doc), begin, np.int32)
            count = np.zeros(len(doc), np.int32)
            for row in grid:
                v = tab.take((v >> 1) + row, mode="clip")
                count += v & 1
            out[k] = np.bincount(doc, weights=count, minlength=len(texts))
        return out, n

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """(language, score) of each text; the score is second / (best + second) cost."""
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if not known or not self.langs:
            return lang, score
        c, n = self.phrases([texts[i] for i in known])
        cost = c * np.array(self.bits)[:, None] / np.maximum(n, 1)
        order = np.argsort(cost, axis=0, kind="stable")
        cols = np.arange(len(known))
        best = cost[order[0], cols]
        second = cost[order[1], cols] if len(self.langs) > 1 else np.full(len(known), math.inf)
        part = np.where(np.isinf(second), 1.0, second / np.maximum(best + second, 1e-300))
        for j, i in enumerate(known):
            lang[i], score[i] = self.langs[order[0, j]], float(part[j])
        return lang, score


_MODELS: dict[int, Model] = {}


def model_of(passages: dict[str, list[str]]) -> Model:
    """The model of these passages, built once in each Python worker."""
    key = hash(tuple((k, tuple(v)) for k, v in sorted(passages.items())))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(passages)
    return _MODELS[key]


def training_passages(docs: DataFrame, docs_per_lang: int = 96,
                      passage_chars: int = 256) -> dict[str, list[str]]:
    """At most ``docs_per_lang`` passages per language, from the learnable rows (column
    ``learn``).  Each task keeps its own lowest hashes, so a hot language ships few rows."""
    h = F.xxhash64(F.lit(11), "doc_id", "text")
    room = F.greatest(F.length("text") - passage_chars, F.lit(0)) + 1
    rows = (docs.where(F.col("learn") & F.col("lang").isNotNull() & F.col("text").isNotNull())
            .select("lang", h.alias("_h"),
                    F.col("text").substr((F.pmod(h, room) + 1).cast("int"), F.lit(passage_chars))
                    .alias("passage"))
            .where(F.col("passage").rlike(r"\p{L}")))
    w = Window.partitionBy("lang").orderBy("_h", "passage")
    rows = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= docs_per_lang)
    out: dict[str, list[str]] = {}
    for r in rows.orderBy("lang", "_r").collect():  # languages x docs_per_lang short strings
        out.setdefault(r["lang"], []).append(r["passage"])
    return out


def identify(docs: DataFrame, passages: dict[str, list[str]], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every row's whole text."""
    ship_package(docs.sparkSession)
    src = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))

    schema = src.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(passages)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            lang, score = [], []
            for rows in blocks(texts, BLOCK):
                names, parts = model.predict([texts[i] for i in rows])
                lang += names
                score += parts
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema.names)

    return src.mapInArrow(tidy(run), schema)
