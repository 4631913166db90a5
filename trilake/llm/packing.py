"""Token sequences of a fixed length, packed so that their estimated costs are near equal."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from trilake.llm.common import map_texts, small_batches
from trilake.llm.tokens import BYTE_BPE, ByteBpe

LENGTH = 2048
END = 1
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n. In a transformer layer of
#: width d, matrices take 24 * d * d operations a token and attention 4 * n * d: n / 6d of that.
LINEAR, QUADRATIC = 1.0, 1 / (6 * 1024)
#: Bytes of text that one cell is meant to hold; a cell is packed on its own.
CELL_BYTES = 2 << 20
IDS = StructType([StructField("ids", BinaryType())])
PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, sequence_cost double"
)


def assign(
    lengths: list[int], room: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC
) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of pieces that hold each token once.

    What fills whole sequences by itself is cut off first. The rests go, longest first, to
    the sequence of lowest cost that has room for them; where none has, the sequence of
    lowest cost that has any room takes what it can, and the remainder waits its turn.
    There are as few sequences as the tokens need, so less than one of them is padding.
    """
    pieces = []
    full = 0
    rests = []
    for item, n in enumerate(lengths):
        for block in range(n // room):
            pieces.append((item, block * room, room, full, 0))
            full += 1
        if n % room:
            rests.append((-(n % room), item, n - n % room))
    count = -(-sum(-n for n, _, _ in rests) // room)
    free = np.full(count, room, np.int64)
    cost = np.zeros(count)
    heapify(rests)
    while rests:
        n, item, start = rests[0]
        n = -n
        fits = free >= n
        if not fits.any():
            fits = free > 0
        at = int(np.where(fits, cost, np.inf).argmin())
        taken = min(n, int(free[at]))
        pieces.append((item, start, taken, full + at, room - int(free[at])))
        free[at] -= taken
        cost[at] += linear * taken + quadratic * taken * taken
        if taken < n:
            heapreplace(rests, (taken - n, item, start + taken))
        else:
            heappop(rests)
    return pieces


def _packed(room: int, linear: float, quadratic: float, most: int):
    def rows_of(cell: int, used: int, docs: list[tuple], schema: pa.Schema) -> tuple[pa.RecordBatch, int]:
        pieces = assign([len(ids) // 4 for _, ids in docs], room, linear, quadratic)
        count = 1 + max(p[3] for p in pieces)
        item, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces))
        sums = np.bincount(sequence, length, count)
        costs = np.bincount(sequence, linear * length + quadratic * length.astype(float) ** 2, count)
        ids = [docs[i][1][4 * s : 4 * (s + n)] for i, s, n in zip(item.tolist(), start.tolist(), length.tolist())]
        columns = [
            [docs[i][0] for i in item.tolist()], start, length, ids, [len(docs[i][1]) // 4 for i in item.tolist()],
            (cell << 32) + used + sequence, offset, sums[sequence].astype(np.int64), costs[sequence],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema), used + count

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4 + [pa.float64()]
        names = [c.split()[0] for c in PIECES.split(", ")]
        schema = pa.schema(list(zip(names, types)))
        cell, used, held, docs = None, 0, 0, []
        for batch in batches:
            for at, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("_cell", "doc_id", "ids"))):
                if docs and (at != cell or held > most):
                    out, used = rows_of(cell, used, docs, schema)
                    yield out
                    held, docs = 0, []
                if at != cell:
                    cell, used = at, 0
                docs.append((doc_id, ids))
                held += len(ids) // 4
        if docs:
            yield rows_of(cell, used, docs, schema)[0]

    return partition


def pack(
    docs: DataFrame,
    tokenizer: str = BYTE_BPE,
    room: int = LENGTH,
    end: int = END,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """Pieces of all documents in sequences of at most `room` tokens, their ids with them.

    A document is its text's ids and the id `end`; `ids` are little-endian 32-bit numbers.
    `start` counts the document's ids before the piece, `offset` those before it in the
    sequence. Documents are dealt to cells by a hash of id and text, each cell of about
    ``CELL_BYTES`` of text; a task reads its cells one after another and packs at most
    twice that many tokens at a time (or one document), however many rows a cell has.
    `sequence_id` holds the cell in its upper 32 bits.

    Bytes that are no UTF-8 become U+FFFD. Null and empty texts are the end id alone. Equal ids are different documents; repeated
    rows are packed as often as they occur. No rows give none; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tie = F.xxhash64("doc_id", "text")
    dealt = docs.select("doc_id", "text", tie.alias("_tie"), F.pmod(tie, F.lit(size // CELL_BYTES + 1)).alias("_cell"))
    last = int(end).to_bytes(4, "little")
    encode = ByteBpe(tokenizer)

    def ids(raw: bytes) -> bytes:
        return encode(raw.decode("utf-8", "replace")).astype("<u4").tobytes() + last

    tokens = map_texts(dealt, "text", lambda texts: [(ids(t),) for t in texts], IDS)
    placed = tokens.repartition("_cell").sortWithinPartitions("_cell", "doc_id", "_tie")
    return placed.mapInArrow(_packed(room, linear, quadratic, 2 * CELL_BYTES), PIECES)
