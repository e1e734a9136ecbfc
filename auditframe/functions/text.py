"""Documents: normalisation, chunking with stable ids, and token-hash vectors."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from auditframe.errors import RefusedError
from auditframe.functions.identity import uuid5
from auditframe.functions.scalars import collapse_spaces
from auditframe.session import ship_with_tasks

ship_with_tasks(__name__)

# The namespace of document ids, the vector width and the ignored words.
DOCUMENT_NAMESPACE = "ba42ea1e-9c5d-4fde-90b3-809bb0119685"
VECTOR_BUCKETS = 2048
STOP_WORDS = ("a", "an", "are", "be", "do", "for", "how", "is", "should", "the", "to", "when", "where")

CHUNK_SIZE = 1200
CHUNK_OVERLAP = 200
_CHUNK_SCHEMA = "document_id string, page_number int, chunk_index int, text string"
_CHUNK_COLUMNS = ["document_id", "page_number", "chunk_index", "text"]
_FLUSH_CHARACTERS = 16_000_000
_WORDS = re.compile(r"\S+")
_TOKENS = re.compile("[a-z0-9]+")
# Words whose bucket a task remembers.
_CACHED_WORDS = 200_000
# Texts whose vectors are held at one time.
STEP_TEXTS = 256


def document_ids(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` plus ``document_id``: a name-based UUID over the sha256 of the text bytes."""
    digest = F.sha2(F.encode(F.col(text), "UTF-8"), 256)
    namespace = F.lit(DOCUMENT_NAMESPACE.replace("-", ""))
    return df.withColumn("document_id", uuid5(namespace, digest))


def pages_from_text(df: DataFrame, text: str = "text") -> DataFrame:
    """One page per text: white space collapsed, empty texts dropped, NUL characters an error.

    The NUL check is part of the text expression. The length filter reads that expression for
    every row, so it cannot be pruned, and the texts are not scanned a second time for it.
    """
    refusal = F.raise_error(F.lit("Text documents containing null bytes are not accepted."))
    checked = F.when(F.col(text).contains("\0"), refusal).otherwise(collapse_spaces(F.col(text)))
    pages = document_ids(df, text).withColumn(text, checked)
    return pages.filter(F.length(text) > 0).withColumn("page_number", F.lit(1))


def chunk_pages(pages: DataFrame, chunk_size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping chunks of (document_id, page_number, text) pages, with stable chunk ids.

    Where a chunk starts depends on where the one before it broke, so each page is walked in
    order; pages are independent and stay in the partition they are read in (no shuffle).
    """
    if chunk_size <= 0:
        raise RefusedError("Chunk size must be greater than zero.")
    if overlap < 0 or overlap >= chunk_size:
        raise RefusedError("Chunk overlap must be non-negative and smaller than chunk size.")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple[str, int, int, str]] = []
            held = 0
            for document_id, page_number, text in batch.itertuples(index=False, name=None):
                pieces = (text[a:b].strip() for a, b in _chunk_bounds(text, chunk_size, overlap))
                rows.extend((document_id, page_number, i, piece) for i, piece in enumerate(filter(None, pieces)))
                held += len(text)
                if held > _FLUSH_CHARACTERS:
                    yield pd.DataFrame(rows, columns=_CHUNK_COLUMNS)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=_CHUNK_COLUMNS)

    source = pages.select("document_id", F.col("page_number").cast("int"), "text")
    chunks = source.mapInPandas(cut, _CHUNK_SCHEMA)
    name = F.concat(
        F.lit("page:"), F.col("page_number").cast("string"), F.lit(":chunk:"), F.col("chunk_index").cast("string"),
        F.lit(":"), F.col("text"),
    )
    return chunks.withColumn("chunk_id", uuid5(F.regexp_replace("document_id", "-", ""), name))


def _chunk_bounds(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Where the chunks of a page lie, looked up in the sorted places of its blanks and words.

    A chunk that does not reach the end is cut at the last blank of its second half, or at its full
    size without one. The next begins ``overlap`` characters before the cut, at the word there or after.
    """
    blanks = [at.start() for at in re.finditer(" ", text)]
    words = [word.span() for word in _WORDS.finditer(text)]
    ends = [end for _, end in words]
    begin = 0
    while begin + size < len(text):
        full = begin + size
        before = bisect_left(blanks, full)
        late_blank = before and blanks[before - 1] >= begin + max(1, size // 2)
        cut = blanks[before - 1] if late_blank else full
        yield begin, cut
        back = max(cut - overlap, begin + 1)
        word = bisect_right(ends, back)
        if word == len(words):
            return
        begin = max(back, words[word][0])
    if begin < len(text):
        yield begin, len(text)


def token_vectors(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Sparse token-hash vectors of unit length: (key, ``buckets``, ``weights``), one row per text.

    A narrow map: a text's words are counted and hashed in its own row, every distinct word of a task
    once. A text without a word, or a null one, has an empty vector.
    """
    kind = df.schema[key].dataType.simpleString()

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of: dict[str, int] = {}
        for batch in (b.slice(at, STEP_TEXTS) for b in batches for at in range(0, b.num_rows, STEP_TEXTS)):
            buckets, weights, ends = [], [], [0]
            for value in batch.column(1):
                counts = Counter(found.group() for found in _TOKENS.finditer(value.as_py() or ""))
                for word in STOP_WORDS:
                    counts.pop(word, None)
                if len(bucket_of) > _CACHED_WORDS:
                    bucket_of.clear()
                sums: dict[int, int] = {}
                for word, n in counts.items():
                    bucket = bucket_of.get(word)
                    if bucket is None:
                        bucket = bucket_of[word] = int(hashlib.sha256(word.encode()).hexdigest()[:8], 16) % VECTOR_BUCKETS
                    sums[bucket] = sums.get(bucket, 0) + n
                norm = math.sqrt(sum(n * n for n in sums.values()))
                own = np.array(sorted(sums), np.int32)
                buckets.append(own)
                weights.append(np.array([sums[b] / norm for b in own.tolist()], np.float64))
                ends.append(ends[-1] + len(own))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x))) for x in (buckets, weights)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], [key, "buckets", "weights"])

    return df.select(key, F.lower(F.col(text)).alias("text")).mapInArrow(over, f"`{key}` {kind}, buckets array<int>, weights array<double>")


def replace_documents(stored: DataFrame, incoming: DataFrame, key: str = "document_id") -> DataFrame:
    """Chunks after re-ingestion: a document's old chunks give way to its new ones."""
    renewed = incoming.select(F.col(key)).distinct()
    return stored.join(renewed, key, "left_anti").unionByName(incoming)
