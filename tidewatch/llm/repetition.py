"""Quality by repetition: a suffix array over the words of every text.

Suffixes are sorted by prefix doubling, all rows of a block at once; a rank holds the row too, so suffixes of
different texts never compare equal. The levels of the doubling give the longest common prefix of neighbours
in the order, hence for every word the longest repeat that starts there. Maximal repeats of at least
``SPAN_WORDS`` words are the intervals of that array; their spans are united. A text is dropped when the
united spans cover more than ``MOST_COVERED`` of its word characters or one repeat is longer than
``LONGEST`` words, besides the base rule (fewer than ten words, or over a fifth of the words in repeated
five-word windows).

Defined cases: null and empty texts have no words and fail the base rule; ties and repeated rows are judged
each by itself; an empty table gives an empty result; other columns are ignored. A text is one row's own work,
bounded by its length; no rows meet, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.llm.words import Words, text_blocks

BASE_WINDOW = 5
SPAN_WORDS = 10
MOST_COVERED = 0.2
LONGEST = 100
FEWEST_WORDS = 10
REPEAT_PERCENT = 20
BLANK_CHARS = " \t\n\x0b\x0c\r"

IS_SYMBOL = np.zeros(256, dtype=bool)
IS_SYMBOL[np.frombuffer(b"#*$%&|<>", dtype=np.uint8)] = True

COLUMNS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
           ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()),
           ("longest_repeat", T.LongType()), ("covered_chars", T.LongType())]


def longest_repeats(words: Words) -> np.ndarray:
    """For every word, the words of the longest run starting there that starts elsewhere in the same row too."""
    n = len(words)
    reach = np.zeros(n, dtype=np.int64)
    if n == 0:
        return reach
    end = words.first[words.row + 1]
    order = np.lexsort((words.hashes, words.row))
    head = np.ones(n, dtype=bool)
    head[1:] = (words.hashes[order][1:] != words.hashes[order][:-1]) | (words.row[order][1:] != words.row[order][:-1])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, step = [rank], 1
    while True:
        alone = head.copy()
        alone[:-1] &= head[1:]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        at = order[slots]
        beyond = at + step
        follow = np.where(beyond < end[at], rank[np.minimum(beyond, n - 1)] + 1, 0)
        inner = np.lexsort((follow, rank[at]))
        at, follow = at[inner], follow[inner]
        order[slots] = at
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (rank[at][1:] != rank[at][:-1]) | (follow[1:] != follow[:-1])
        head[slots] = fresh
        new = rank.copy()
        new[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank = new
        levels.append(rank)
        step *= 2
    left, right = order[:-1], order[1:]
    same = levels[0][left] == levels[0][right]
    left, right = left[same], right[same]
    common = np.zeros(len(left), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = left + common, right + common
        inside = (a + (1 << level) <= end[left]) & (b + (1 << level) <= end[right])
        ranks = levels[level]
        equal = inside & (ranks[np.minimum(a, n - 1)] == ranks[np.minimum(b, n - 1)])
        common += np.where(equal, 1 << level, 0)
    np.maximum.at(reach, left, common)
    np.maximum.at(reach, right, common)
    return reach


def covered(words: Words, reach: np.ndarray, shortest: int) -> np.ndarray:
    """Which words lie in a repeat of at least ``shortest`` words."""
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(reach >= shortest)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + reach[at], -1)
    return np.cumsum(edges)[:-1] > 0


def repeated_lines(text: str | None) -> int:
    seen: set[str] = set()
    again = 0
    for line in (text or "").split("\n"):
        if line.strip(BLANK_CHARS):
            again += line in seen
            seen.add(line)
    return again


def per_row(flags: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, weights=flags, minlength=rows).astype(np.int64)


def measure(rows: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    words, n = Words(data, bounds), rows.num_rows
    chars_upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    symbols_upto = np.concatenate([[0], np.cumsum(IS_SYMBOL[data])])
    chars = chars_upto[words.ends] - chars_upto[words.starts]
    reach = longest_repeats(words)
    word_chars = per_row(chars, words.row, n)
    repeat_words = per_row(covered(words, reach, BASE_WINDOW), words.row, n)
    spans = covered(words, reach, SPAN_WORDS)
    covered_chars = per_row(np.where(spans, chars, 0), words.row, n)
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, words.row, reach)
    failed = (words.counts < FEWEST_WORDS) | (100 * repeat_words > REPEAT_PERCENT * words.counts)
    kept = ~failed & (covered_chars <= MOST_COVERED * word_chars) & (longest <= LONGEST)
    lines = np.array([repeated_lines(t) for t in rows.column(rows.schema.get_field_index("text")).to_pylist()], dtype=np.int64)
    return [words.counts, word_chars, symbols_upto[bounds[1:]] - symbols_upto[bounds[:-1]], lines, repeat_words, failed, kept, longest, covered_chars]


def repetition_rules(docs: DataFrame) -> DataFrame:
    """doc_id with the base counts, base_failed, kept, longest_repeat (words) and covered_chars."""
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *[T.StructField(n, t) for n, t in COLUMNS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in text_blocks(batch):
                values = measure(part, data, bounds)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, values)], names=["doc_id", *[n for n, _ in COLUMNS]])

    return rows.mapInArrow(run, schema)
