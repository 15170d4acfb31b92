"""Byte-level BPE: overlapping chunk encoding, and decoding by concatenation of raw bytes.

A text longer than a chunk is cut into chunks that overlap. Chunks are pre-tokenised in parallel,
each from its own first character, so the pieces at its start may be cut wrongly. Neighbours are
stitched where a boundary that is known to be right in the earlier chunk is also one in the later:
the pattern looks at nothing before a match, so from there on both agree. Where an overlap has no
such place (one very long piece), matching goes on from the last right boundary until it meets one.
Then the pieces are encoded. Texts of one chunk are done where they are read and never shuffled. Of
longer ones copies are combined chunk by chunk before they are shuffled, the chunks of each text are
dealt out to tasks and gathered again by its digest, and the ids are joined back to the rows, so a text
that a third of all rows hold is encoded once and no task gathers its copies.

Cases: a null text counts as empty and has no ids. Repeated rows give a row each. Other columns are
not read. An empty table gives no rows. Memory: a slice of SLICE rows or one long text at a time.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keeps_cache, mapped, staged

CHUNK = 32_768
OVERLAP = 1_024
#: Characters past a match that the pattern may look at (contractions and white space).
LOOKAHEAD = 8
#: Pieces that a worker remembers, rows and bytes that it handles at once.
MEMO, SLICE, FLUSH = 200_000, 256, 4_000_000


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class _Memo(dict):
    """piece -> its ids as little-endian 32-bit integers."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        ids = np.array(self.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, rank_file: bytes, pattern: str):
        ranks = ranks_of(rank_file)
        self.vocabulary = {i: b for b, i in ranks.items()}
        self.match = regex.compile(pattern)
        # merges of one piece by rank; the pattern is applied here, not there
        self.memo = _Memo(tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece)

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern, which must leave no gaps."""
        found = self.match.findall(text)
        if sum(map(len, found)) != len(text):
            raise ValueError("the pattern doesn't cover the whole text")
        return found

    def encode(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.memo.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}
keeps_cache("bpe", _CODECS.clear)


def codec(rank_file: bytes, pattern: str) -> Codec:
    """One for each worker process and vocabulary."""
    key = (hashlib.sha256(rank_file).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def cuts(n: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of each chunk of a text of n characters."""
    return [(a, min(n, a + chunk + overlap)) for a in range(0, max(n, 1), chunk)]


def stitch(match: regex.Pattern, text: str, chunks: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """The piece starts of the whole text, by chunk, from those of chunks (start, end, piece lengths).

    Each chunk gives the starts from the place where it agrees with what comes before.
    """
    n = len(text)
    starts = [a + np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.empty(0, np.int64) for a, _, lengths in chunks]
    owned, k, at = [], 0, 0  # at: a right boundary, and a start in chunk k
    while k < len(chunks):
        a, end, _ = chunks[k]
        mine = starts[k][np.searchsorted(starts[k], at) :]
        if end == n:
            owned.append((k, mine))
            break
        right = mine[(mine == at) | (mine + LOOKAHEAD <= end)]
        shared = right[np.isin(right, starts[k + 1])]
        shared = shared[shared > at] if len(shared) and shared[0] == at and k else shared
        if len(shared):
            owned.append((k, mine[: np.searchsorted(mine, shared[0])]))
            k, at = k + 1, int(shared[0])
            continue
        # no boundary in common: match on from the last right one until another chunk's is met
        run = list(right[:-1])
        for m in match.finditer(text, int(right[-1])):
            p = m.start()
            j = bisect.bisect_right([c[0] for c in chunks], p) - 1
            if j > k and (i := np.searchsorted(starts[j], p)) < len(starts[j]) and starts[j][i] == p:
                k, at = j, p
                break
            run.append(p)
        else:
            k = len(chunks)
        owned.append((k, np.array(run, np.int64)))
    return owned


def pieces_of_chunks(match: regex.Pattern, text: str, chunks: list[tuple[int, int, np.ndarray]]) -> list[str]:
    starts = np.concatenate([s for _, s in stitch(match, text, chunks)]).tolist()
    return [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)])]


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about FLUSH bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if size >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, SLICE).columns))


def bpe_encode(
    docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (their bytes) of every row.

    ``rank_file`` is the content of a tiktoken rank file; it is broadcast, at about a megabyte.
    """
    spark = docs.sparkSession
    shared: Broadcast[bytes] = spark.sparkContext.broadcast(rank_file)
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = read.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)

        def rows():
            for doc_id, text in _rows(batches):
                ids = c.encode(c.pieces(text))
                yield doc_id, len(ids) // 4, ids, c.decode(ids)

        yield from _batches(rows(), to_arrow_schema(out))

    parts = T.StructType([T.StructField(n, t) for n, t in (("key", T.StringType()), ("chunk", T.IntegerType()), ("start", T.LongType()), ("n_chars", T.LongType()), ("part", T.StringType()))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for key, text in _rows(batches):
                for k, (a, b) in enumerate(cuts(len(text), chunk, overlap)):
                    yield key, k, a, len(text), text[a:b]

        yield from _batches(rows(), to_arrow_schema(parts))

    cut = T.StructType([*parts.fields, T.StructField("lengths", T.BinaryType())])

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value, pattern)
        rows = ((*row, np.fromiter(map(len, c.pieces(row[-1])), np.uint32).tobytes()) for row in _rows(batches))
        yield from _batches(rows, to_arrow_schema(cut))

    whole = T.StructType([parts["key"], *out.fields[1:]])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        c = codec(shared.value, pattern)
        pdf = pdf.sort_values("chunk")
        n = int(pdf["n_chars"].iloc[0])
        text = "".join(part[:chunk] for part in pdf["part"])
        chunks = [(int(a), min(n, int(a) + chunk + overlap), np.frombuffer(x, np.uint32).astype(np.int64)) for a, x in zip(pdf["start"], pdf["lengths"])]
        ids = c.encode(pieces_of_chunks(c.match, text, chunks))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "n_tokens": [len(ids) // 4], "ids": [ids], "decoded": [c.decode(ids)]})

    is_long = F.length("text") > chunk
    done = mapped(read.where(~is_long), short, out, "bpe")
    long = read.where(is_long).withColumn("key", F.sha2("text", 256))
    chunks = mapped(long.select("key", "text"), split, parts, "bpe").dropDuplicates(["key", "chunk"])
    chunks = mapped(chunks, pretokenise, cut, "bpe")
    # written, so that the join deals both sides out anew and a text of very many rows can be split
    encoded = staged(chunks.groupBy("key").applyInPandas(gather, whole), "bpe-long")
    return done.unionByName(long.select("doc_id", "key").join(encoded, "key").select(*out.names))
