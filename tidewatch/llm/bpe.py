"""Byte-level BPE over Arrow batches with the tokenizers library, from a file of merge ranks.

A rank file lists byte strings by rank and merges any neighbours whose joined bytes are listed, the lowest rank
first. The tokenizers library wants explicit merges, so every split of every token into two listed parts becomes
one, at its token's rank. Bytes stand for characters by the usual table (printable ones for themselves, the rest
moved up), which decoding reverses, so a character whose bytes lie in two tokens comes back whole once the bytes
are joined. Offsets are characters of the text; tokens that share a character share its offset.

Texts come back to the same words, so a text is first split by the pattern and the library encodes each word once while
it is remembered; a text's ids are those of its words, joined. Splits come from the regex package, whose letters and digits
are of a newer Unicode than tiktoken's and the library's: texts with characters that Python's older one does not know,
or that the pattern does not cover, go through the library whole.

Long texts are encoded in pieces cut between a non-blank and a blank, where no match of the pattern can reach
over, so memory is bounded by the piece and the ids are those of the whole text.

Defined cases: null and empty texts have no tokens; special tokens do not exist, their strings are plain text;
repeated rows give equal results; an empty table gives an empty result; other columns are ignored. No rows meet, so
nothing is shuffled.
"""

from __future__ import annotations

import base64
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.tables import whole
from tidewatch.llm.words import text_blocks

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECE_CHARS = 1 << 16
KNOWN_WORDS = 50_000
CUT = re.compile(r"(?<=\S)[ \n]")


def rank_file(name: str = RANKS) -> bytes:
    """A public vocabulary's ranks; the file has a fixed size, whatever the corpus."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@lru_cache(maxsize=1)
def byte_table() -> list[str]:
    """One character for each byte: itself where it prints, else the next free one from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    moved = iter(range(256, 512))
    return [chr(b if b in printable else next(moved)) for b in range(256)]


@lru_cache(maxsize=2)
def tokens_of(ranks: bytes) -> list[bytes]:
    """Token bytes by id."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in ranks.splitlines() if line))
    return [token for _, token in pairs]


@lru_cache(maxsize=2)
def merge_model(ranks: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import models

    letters, tokens = byte_table(), tokens_of(ranks)
    known = {t: i for i, t in enumerate(tokens)}
    spelled = ["".join(letters[b] for b in t) for t in tokens]
    merges = [(spelled[known[t[:cut]]], spelled[known[t[cut:]]]) for t in tokens for cut in range(1, len(t)) if t[:cut] in known and t[cut:] in known]
    return models.BPE(vocab={s: i for i, s in enumerate(spelled)}, merges=merges, ignore_merges=True)


@lru_cache(maxsize=2)
def tokenizer(ranks: bytes, pattern: str):
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    made = Tokenizer(merge_model(ranks))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
                                                  pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
    return made


def newer(word: str) -> bool:
    """The word has a character that Python's Unicode tables do not know."""
    return not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word)


@lru_cache(maxsize=2)
def single_tokens(ranks: bytes) -> dict[str, bytes]:
    """Words that are a token, with its id."""
    tokens = ((i, t.decode("utf-8", "replace")) for i, t in enumerate(tokens_of(ranks)))
    return {t: array("i", [i]).tobytes() for i, t in tokens if "\ufffd" not in t and not newer(t)}


@lru_cache(maxsize=2)
def word_encoder(ranks: bytes, pattern: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids of texts. Each word is encoded once while it is remembered: single tokens, ``KNOWN_WORDS`` others, and those of the last call."""
    import regex

    made, split, tokens, letters = tokenizer(ranks, pattern), regex.compile(pattern), single_tokens(ranks), dict(enumerate(byte_table()))
    merged, known = merge_model(ranks).tokenize, dict(tokens)

    def words_of(text: str) -> list[str] | None:
        words = [] if split.groups else split.findall(text)
        return words if sum(map(len, words)) == len(text) else None

    def run(texts: list[str]) -> list[np.ndarray]:
        if len(known) > len(tokens) + KNOWN_WORDS:
            known.clear()
            known.update(tokens)
        words = [words_of(text) for text in texts]
        new = [w for w in set(chain.from_iterable(ws for ws in words if ws)) if w not in known]
        if odd := {w for w in new if newer(w)}:
            words = [ws if ws is None or odd.isdisjoint(ws) else None for ws in words]
            new = [w for w in new if w not in odd]
        for w in new:
            known[w] = array("i", [t.id for t in merged(w.encode().decode("latin-1").translate(letters))]).tobytes()
        others = iter(made.encode_batch_fast([text for text, ws in zip(texts, words, strict=True) if ws is None], add_special_tokens=False))
        return [np.array(next(others).ids, dtype=np.int32) if ws is None else np.frombuffer(b"".join(map(known.__getitem__, ws)), dtype=np.int32) for ws in words]

    return run


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """(first character, piece) of a text, cut where no match reaches over."""
    start = 0
    while len(text) - start > PIECE_CHARS:
        cut = CUT.search(text, start + PIECE_CHARS)
        if cut is None:
            break
        yield start, text[start: cut.start()]
        start = cut.start()
    yield start, text[start:]


def encode(docs: DataFrame, ranks: bytes, pattern: str, offsets: bool = False) -> DataFrame:
    """doc_id, ids, and with ``offsets`` the first and last-plus-one character of every token."""
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    ints = T.ArrayType(T.IntegerType())
    extra = [T.StructField("starts", ints), T.StructField("ends", ints)] if offsets else []
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("ids", ints), *extra])
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in text_blocks(batch):
                ids: list[np.ndarray] = []
                spans: list[np.ndarray] = []
                counts = np.zeros(part.num_rows, dtype=np.int64)
                texts = part.column(1).to_pylist()
                queue: list[tuple[int, int, str]] = []

                def flush() -> None:
                    strings = [piece for _, _, piece in queue]
                    if offsets:
                        coded = tokenizer(shared.value, pattern).encode_batch(strings, add_special_tokens=False)
                        spans.extend(np.array(got.offsets, dtype=np.int32).reshape(-1, 2) + start for (_, start, _), got in zip(queue, coded, strict=True))
                        found = [np.array(got.ids, dtype=np.int32) for got in coded]
                    else:
                        found = word_encoder(shared.value, pattern)(strings)
                    for (row, _, _), got in zip(queue, found, strict=True):
                        ids.append(got)
                        counts[row] += len(got)
                    queue.clear()

                for row, text in enumerate(texts):
                    for start, piece in pieces(text or ""):
                        queue.append((row, start, piece))
                        if len(queue) == 64:
                            flush()
                flush()
                bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                columns = [np.concatenate(ids)] if ids else [np.zeros(0, dtype=np.int32)]
                if offsets:
                    both = np.concatenate(spans) if spans else np.zeros((0, 2), dtype=np.int32)
                    columns += [np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.ListArray.from_arrays(bounds, pa.array(c)) for c in columns]], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """Add ``bytes``, the joined bytes of ``ids``, to (doc_id, ids)."""
    rows = encoded.select("doc_id", "ids")
    schema = T.StructType([*rows.schema.fields, T.StructField("bytes", T.BinaryType())])
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(tokens_of(shared.value), pa.large_binary())
        for batch in batches:
            ids = batch.column(1)
            # Taken tokens lie one behind the other, so a text is the stretch from its first token to its last.
            bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
            taken = table.take(ids.flatten())
            offsets, data = taken.buffers()[1:]
            starts = np.frombuffer(offsets, dtype=np.int64)[taken.offset: taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, dtype=np.int64)
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(starts[bounds])), data])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, texts.cast(pa.binary())], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def token_report(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    ranks = rank_file()
    coded = decode(encode(docs.select("doc_id", whole(docs["text"]).alias("text")), ranks, public_tokenizers.PATTERN), ranks)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                        F.sha2("bytes", 256).alias("decoded_sha256"))
