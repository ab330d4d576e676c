"""Word and letter frequencies of a whole corpus in a table of fixed size.

The counts, of words, letters and whole tokens beyond ASCII, live in a count-min sketch: two rows of WIDTH slots. It is summed up from all
documents, is the only thing about them that reaches the driver, and is small enough to go to every executor.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 1 << 20
FLUSH_KEYS = 300_000
SHARED_CHARS = 500
UNIT = re.compile(r"[^\W\d_]+|[^\w\s\x00-\x7f]")
WIDE = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uff66-\uff9f]")
WORD_SHARE = 0.9
TOTAL = "\x00total"
LETTER = "\x04"
WHOLE = "\x05"
_TOKEN = re.compile(r"[^ \t\n\r]+")
_EDGES = ".,;:!?()\"'"


def units(text: str) -> list[str]:
    """What is counted of a text: words in lower case, symbols beyond ASCII, and pairs of neighbours where a script writes no spaces."""
    out = []
    for u in UNIT.findall(text.lower()):
        if u[0] > "\u3000" and WIDE.match(u):
            out.extend(u[i : i + 2] for i in range(max(1, len(u) - 1)))
        else:
            out.append(u)
    return out


def whole(token: str) -> str:
    """The key under which a token is counted as it stands, without case and the punctuation around it."""
    return WHOLE + token.strip(_EDGES).lower()


def tokens_beyond_ascii(text: str) -> list[str]:
    return [] if text.isascii() else [t for t in _TOKEN.findall(text) if not t.isascii()]


def counted_units(text: str) -> list[str]:
    """The units of a text and its whole tokens beyond ASCII."""
    return units(text) + [whole(t) for t in tokens_beyond_ascii(text)]


def letters(word: str) -> Iterator[tuple[str, str]]:
    """(context, context and letter) of every letter of a word and of its end."""
    w = f"\x02{word}\x03"
    for i in range(1, len(w)):
        yield w[max(0, i - 2) : i], w[max(0, i - 2) : i + 1]


_hash = xxhash.xxh64_intdigest


def slots(unit: str) -> tuple[int, int]:
    h = xxhash.xxh64_intdigest(unit)
    return h & (WIDTH - 1), (h >> 32) & (WIDTH - 1)


def _counted(words: Counter) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for w, n in words.items():
        total[w] += n
        if w[0] == WHOLE:
            continue
        total[TOTAL] += n
        for context, whole in letters(w):
            total["\x01" + context] += n
            total["\x01" + whole] += n
        for c in w:
            if c > "\x7f":
                total[LETTER + c] += n
    where: Counter = Counter()
    for u, n in total.items():
        a, b = slots(u)
        where[a] += n
        where[WIDTH + b] += n
    keys = list(where)
    for i in range(0, len(keys), 50_000):
        part = keys[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([where[k] for k in part], pa.int64())], names=["slot", "n"])


def count_rows(texts: DataFrame) -> DataFrame:
    """(slot, token, n): over the column ``text`` of all rows, what falls into every slot of the sketch (token null), and how often
    every token beyond ASCII of up to SHARED_CHARS characters stands there as it is (slot null). Null texts count nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        tokens: Counter = Counter()

        def flushed() -> Iterator[pa.RecordBatch]:
            for t, n in tokens.items():
                words[whole(t)] += n
            for b in _counted(words):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.nulls(b.num_rows, pa.string()), b.column(1)], names=["slot", "token", "n"])
            own = [(t, n) for t, n in tokens.items() if len(t) <= SHARED_CHARS]
            for i in range(0, len(own), 10_000):
                part = own[i : i + 10_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int32()), pa.array([t for t, _ in part]), pa.array([n for _, n in part], pa.int64())], names=["slot", "token", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    words.update(units(t))
                    tokens.update(tokens_beyond_ascii(t))
            if len(words) + len(tokens) > FLUSH_KEYS:
                yield from flushed()
                words, tokens = Counter(), Counter()
        if words or tokens:
            yield from flushed()

    return texts.select("text").mapInArrow(run, "slot int, token string, n bigint").groupBy("slot", "token").agg(F.sum("n").alias("n"))


def sketch(counted: DataFrame) -> np.ndarray:
    """The filled sketch, shape (2, WIDTH), out of count_rows."""
    rows = counted.where("slot is not null").select("slot", "n").toArrow()  # at most 2 * WIDTH rows
    table = np.zeros(2 * WIDTH, dtype=np.int64)
    table[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return table.reshape(2, WIDTH)


def count_corpus(texts: DataFrame) -> np.ndarray:
    return sketch(count_rows(texts))


class Lexicon:
    """Looks counts up and turns them into log probabilities.

    A slot counts its unit and what else fell into it; half of the slots hold no more than the median of foreign counts, which is taken
    off, so that in a table filled by a large corpus a unit that never stood there is not taken for a known one. Of a corpus
    of N units, the count is too large by more than 2 N / WIDTH for at most a quarter of the units.
    """

    def __init__(self, table: np.ndarray) -> None:
        self.first, self.second = (np.maximum(row - np.median(row), 0) for row in table)
        self._counts: dict[str, int] = {}
        self.total = max(1, self.count(TOTAL))
        self._known: dict[str, float] = {}

    def count(self, unit: str) -> int:
        n = self._counts.get(unit)
        if n is None:
            if len(self._counts) > 1_000_000:
                self._counts.clear()
            a, b = slots(unit)
            n = self._counts[unit] = int(min(self.first[a], self.second[b]))
        return n

    def counts(self, keys: list[str]) -> np.ndarray:
        """The counts of many units at once."""
        h = np.array([_hash(u) for u in keys], dtype=np.uint64)
        mask = np.uint64(WIDTH - 1)
        return np.minimum(self.first[(h & mask).astype(np.int64)], self.second[((h >> np.uint64(32)) & mask).astype(np.int64)]).astype(np.int64)

    def by_letters(self, word: str) -> float:
        """Log probability of a word by its letters, each after the two before it."""
        return sum(math.log((self.count("\x01" + whole) + 0.02) / (self.count("\x01" + context) + 4.0)) for context, whole in letters(word))

    def log_p(self, unit: str) -> float:
        """Log probability of a unit: corpus frequency mixed with the letters' model, so that unseen words are told apart too."""
        known = self._known.get(unit)
        if known is None:
            if len(self._known) > 500_000:
                self._known.clear()
            n = self.count(unit)
            known = math.log(WORD_SHARE * n / self.total + (1 - WORD_SHARE) * math.exp(max(-200.0, self.by_letters(unit))) + 1e-30)
            self._known[unit] = known
        return known
