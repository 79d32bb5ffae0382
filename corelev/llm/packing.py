"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelev.llm.common import table, utf8, written

CAPACITIES = (512, 1024, 2048, 4096, 8192)


def sequence_cost(capacity: int, overhead: int = 64, quadratic: float = 1 / 65536) -> float:
    """Cost of a sequence: its tokens, a fixed part, and attention's square term."""
    return capacity + overhead + quadratic * capacity * capacity


def pack(lengths: np.ndarray, capacities=CAPACITIES, cost=sequence_cost) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bins for pieces of at most the largest capacity: each piece's bin and offset, and the bins' final capacities.

    Pieces go in falling length, each into the open bin that it fills best. Where none fits, the
    size to open is chosen over all permitted sizes together: for each, the pieces still to come are
    laid into the space that is left (longest first, as the best-fit would), and the size with the
    least cost a token wins, ties to the smaller. At last every bin shrinks to the smallest
    permitted size that holds its contents.
    """
    caps = sorted(capacities)
    top = caps[-1]
    price = [cost(c) for c in caps]
    order = np.argsort(-lengths, kind="stable")
    left = np.bincount(lengths, minlength=top + 1).tolist()  # pieces to come, by length
    have = 0  # bit set of the lengths of which some are left
    for n, c in enumerate(left):
        if c and n:
            have |= 1 << n
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit set of the rooms of open bins
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    open_cap: list[int] = []

    def filled(room: int) -> int:
        """Tokens of coming pieces that fit into ``room``, longest first."""
        got, tried = 0, have & ((1 << (room + 1)) - 1)
        while tried:
            n = tried.bit_length() - 1
            k = min(left[n], (room - got) // n)
            got += k * n
            tried &= (1 << min(n, room - got + 1)) - 1
        return got

    for i in order.tolist():
        n = int(lengths[i])
        left[n] -= 1
        if n and not left[n]:
            have &= ~(1 << n)
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            best = min((p / max(1, n + filled(c - n)), c) for c, p in zip(caps, price) if c >= n)
            b, room = len(used), best[1]
            used.append(0)
            open_cap.append(best[1])
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        room -= n
        by_room.setdefault(room, []).append(b)
        rooms |= 1 << room
    return bins, offsets, [next(c for c in caps if c >= u) for u in used]


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): the text's blank-separated words and one end mark."""
    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x.split()) + 1 for x in utf8(b.column(1))], pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(count, f"doc_id {kind}, n_tokens long")


def best_fit(lengths: DataFrame, capacities=CAPACITIES, group_pieces: int = 50_000) -> DataFrame:
    """Pack rows (doc_id, n_tokens) into sequences; one row a piece.

    Documents longer than the largest capacity are cut into pieces of that capacity and a rest; no
    token is lost. Pieces are dealt round-robin into groups of about ``group_pieces``, whatever their
    ids, and each group is packed on its own (``pack``): the share of waste falls with the group's
    size and doesn't depend on the table's. Returns doc_id, piece, start (first token), length,
    bin_id, capacity, bin_offset. Null ids and repeated rows are packed like others; null or
    negative lengths count as 0 and take a place of length 0; an empty table gives no rows. Other
    columns are not read.
    """
    top = max(capacities)
    n = F.greatest(F.coalesce(F.col("n_tokens"), F.lit(0)), F.lit(0))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / top) - 1, F.lit(0)).cast("long")))
    pieces = lengths.select("doc_id", n.alias("_n"), piece.alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * top).alias("start"), F.least(F.col("_n") - F.col("piece") * top, F.lit(top)).alias("length"))
    pieces = written(pieces, "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def packed(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        kept: list = []

        def flush():
            nonlocal kept, seen
            t = pa.Table.from_batches(kept).combine_chunks()
            kept = []
            lens = t.column("length").to_numpy()
            bins, offsets, caps = pack(lens, capacities)
            ids = pa.array((part << 33) + seen + bins)
            seen += len(caps)
            out = t.append_column("bin_id", ids).append_column("capacity", pa.array(np.array(caps, np.int64)[bins])).append_column("bin_offset", pa.array(offsets))
            yield from out.to_batches()

        for b in batches:
            if b.num_rows:
                kept.append(b)
            if sum(x.num_rows for x in kept) >= 2 * group_pieces:
                yield from flush()
        if kept:
            yield from flush()

    kind = dict(pieces.dtypes)["doc_id"]
    return pieces.repartition(groups).mapInArrow(packed, f"doc_id {kind}, piece long, start long, length long, bin_id long, capacity long, bin_offset long")


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 512 to 8192 word tokens."""
    return best_fit(token_lengths(table(spark, sf_dir, "documents")))
