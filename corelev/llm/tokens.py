"""Token-ID shards with a minimal perfect hash index for keyed access."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelev.llm.common import sliced, table, utf8
from corelev.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of key and seed (vectorised)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: levels of bit arrays, a key's slot is its bit's rank.

    At each level the keys left are hashed into about 1.5 times as many bits; a bit that just one
    key hits is that key's. The others go on to the next level. About 3 bits a key.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.cumsum(bits) - bits)
            total += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left, seed = [], np.asarray(keys, np.uint64), 1
        while len(left):
            size = max(8, int(1.5 * len(left)))
            at = (_mix(left, seed) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            levels.append((hits == 1).astype(np.uint8))
            left, seed = left[hits[at] > 1], seed + 1
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the keys, from 0 without gaps; any number, or -1, for keys that weren't built in."""
        keys = np.asarray(keys, np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for seed, (bits, rank) in enumerate(zip(self.levels, self.ranks), 1):
            at = (_mix(keys[open_], seed) % np.uint64(len(bits))).astype(np.int64)
            got = bits[at] == 1
            out[open_[got]] = rank[at[got]]
            open_ = open_[~got]
        return out

    def dump(self) -> list[bytes]:
        return [np.array([len(b)], np.int64).tobytes() + np.packbits(b).tobytes() for b in self.levels]

    @classmethod
    def load(cls, levels: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(x[8:], np.uint8), count=int(np.frombuffer(x[:8], np.int64)[0])) for x in levels])


def key_of(ids: list, repeats: list) -> np.ndarray:
    """64-bit keys of (document id or None, number of the repeat among rows of that id)."""
    a = np.fromiter((0 if i is None else i for i in ids), np.int64, len(ids)).view(np.uint64)
    null = np.fromiter((i is None for i in ids), np.uint64, len(ids))
    return _mix(a, 101) ^ _mix(np.asarray(repeats, np.uint64) * np.uint64(2) + null, 102)


class Pieces:
    """Token ids of texts, by the tokenizers library, each distinct piece encoded once.

    The vocabulary's byte-level pre-tokenizer never lets a token cross from a non-blank into a
    space, and looks ahead only from blanks; so a text may be cut before every space that has
    non-blanks on both sides, and the ids of the pieces, end to end, are the ids of the text.
    Pieces are remembered up to a bound.
    """

    SAFE = re.compile(r"(?<=\S) (?=\S)")
    WHOLE = re.compile(r"'|\s\s")
    UNITS = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+|\s+")

    def __init__(self, tokenizer: str, width: int, most: int = 900_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.tok.encode_special_tokens = True  # cutting needs their strings to be ordinary text
        self.plain = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.kind, self.width, self.most = f"<u{width}", width, most
        self.heads, self.tails = {}, {}  # without and with the space before
        self.line = self.tok.encode("\n", add_special_tokens=False).ids

    def _ids(self, texts: list[str]) -> list[bytes]:
        many = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        return [np.asarray(e.ids, self.kind).tobytes() for e in many(texts, add_special_tokens=False)]

    def _units(self, known: dict, units, before: str):
        """Encode units (no blanks in them) many to a string, a line end after each: that is a token of its own
        there and in no unit, so the ids are cut at it."""
        new = [u for u in units if u not in known]
        if len(self.line) != 1:
            known.update(zip(new, self._ids([before + u for u in new])))
            return
        many = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        for a in range(0, len(new), 16_384):
            part = new[a: a + 16_384]
            got = many(["".join(f"{before}{u}\n" for u in part[i: i + 64]) for i in range(0, len(part), 64)], add_special_tokens=False)
            ids = np.array([x for e in got for x in e.ids], self.kind)
            ends = np.flatnonzero(ids == self.line[0])
            assert len(ends) == len(part)
            data, at = ids.tobytes(), (ends * self.width).tolist()
            known.update((u, data[i:j]) for u, i, j in zip(part, [0, *(e + self.width for e in at)], at))

    def _learn(self, new: set):
        """Ids of pieces after a space. A piece falls into runs of letters and digits, of other marks, and single
        blanks, which the pre-tokenizer parts too (but for apostrophes and runs of blanks, which stay whole)."""
        parts, first, later, whole = {}, set(), set(), []
        for w in new:
            if w.isalnum():
                first.add(w)
                continue
            if self.WHOLE.search(w):
                whole.append(w)
                continue
            u = self.UNITS.findall(w)
            first.add(u[0])
            later.update(u[1:])
            parts[w] = u
        blanks = {u for u in later if u.isspace()}  # few: one character each
        self._units(self.tails, first, " ")
        self._units(self.heads, later - blanks, "")
        odd = [u for u in blanks if u not in self.heads]
        self.heads.update(zip(odd, self._ids(odd)))
        self.tails.update(zip(whole, self._ids([" " + w for w in whole])))
        tails, heads = self.tails, self.heads
        for w, u in parts.items():
            tails[w] = tails[u[0]] + b"".join([heads[x] for x in u[1:]])

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [t.split(" ") for t in texts]
        words: set = set()
        for c in cut:
            words.update(c[1:])
        new = words.difference(self.tails)
        odd = {w for w in new if w.strip() != w or not w}
        first = [c[0] for c in cut]
        redo = [i for i, c in enumerate(cut) if not first[i] or first[i][-1].isspace() or odd and not odd.isdisjoint(c[1:])]
        for i in redo:  # blanks beside a space: cut only where that is safe
            cut[i] = self.SAFE.split(texts[i])
        if redo:
            words = {w for c in cut for w in c[1:]}
            new = words.difference(self.tails)
        if len(self.tails) > self.most:
            self.tails = {w: self.tails[w] for w in words if w in self.tails}
        if len(self.heads) > self.most // 4:
            self.heads.clear()
        self._learn(new)
        heads_new = list({c[0] for c in cut}.difference(self.heads))
        self.heads.update(zip(heads_new, self._ids(heads_new)))
        get = self.tails.__getitem__
        return [self.heads[c[0]] + b"".join(map(get, c[1:])) for c in cut]

    def encode_with_special(self, texts: list[str]) -> list[bytes]:
        """The ids that the unchanged tokenizer gives: its special strings in a text become their ids."""
        odd = {i for i, t in enumerate(texts) if any(x in t for x in self.special)}
        out = self.encode(["" if i in odd else t for i, t in enumerate(texts)])
        for i in odd:  # few: whole
            out[i] = np.asarray(self.plain.encode(texts[i], add_special_tokens=False).ids, self.kind).tobytes()
        return out


_CODERS: dict = {}


def coder(tokenizer: str, width: int) -> Pieces:
    """This process's encoder: what it has learned serves the tasks that follow."""
    if (tokenizer, width) not in _CODERS:
        _CODERS[tokenizer, width] = Pieces(tokenizer, width)
    return _CODERS[tokenizer, width]


FILE = ("shard int, block int, first_id long, last_id long, n_docs long, n_tokens long, payload binary, ids array<long>, repeats binary, "
        "levels array<binary>, prints binary, offsets binary, lengths binary")


def _block(part: int, block: int, width: int, ids: list, repeats: list, docs: list):
    """One file row: raw ids end to end, and the index from keys to fingerprint, offset and length."""
    key = key_of(ids, repeats)
    index = PerfectHash.build(key)
    slot = index.slots(key)
    length = np.fromiter(map(len, docs), np.int64, len(docs)) // width
    prints, offsets, lengths = np.zeros(len(key), np.uint32), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    prints[slot], offsets[slot], lengths[slot] = (_mix(key, 7) >> np.uint64(32)).astype(np.uint32), np.cumsum(length) - length, length
    known = [i for i in ids if i is not None]
    return {"shard": part, "block": block, "first_id": min(known, default=None), "last_id": max(known, default=None), "n_docs": len(ids),
            "n_tokens": int(length.sum()), "payload": b"".join(docs), "ids": ids,
            "repeats": np.asarray(repeats, np.int64).tobytes(), "levels": index.dump(), "prints": prints.tobytes(),
            "offsets": offsets.tobytes(), "lengths": lengths.tobytes()}


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
                 block_tokens: int = 1 << 20) -> int:
    """Write every document's token ids and ``end_id`` to ``path``, in ascending id order; returns the bytes of an id.

    Rows are range-partitioned and sorted by (id, text), nulls first, so shard 0 holds the least ids;
    shards are Parquet files, rows are blocks of about ``block_tokens`` ids: the raw little-endian
    ids (2 bytes for vocabularies up to 65,536, else 4) and the block's index. Null texts are empty
    and hold just the end id. Rows that share an id are told apart by their number among them; ids
    beyond a task's border keep counting, as the sort keeps equal ids in one task. An empty table
    gives an empty file. Other columns are not read.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(public_tokenizers.path(tokenizer)).get_vocab_size() <= 65536 and end_id < 65536 else 4
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    src = (docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t"))
           .repartitionByRange(parts, F.col("i").asc_nulls_first()).sortWithinPartitions(F.col("i").asc_nulls_first(), "t"))

    def encode(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        code, end = coder(tokenizer, width), np.array([end_id], f"<u{width}").tobytes()
        part, block, last, times = TaskContext.get().partitionId(), 0, object(), 0
        ids, repeats, out, n = [], [], [], 0
        for b in sliced(batches, 500, 4 << 20):
            for i, coded in zip(b.column(0).to_pylist(), code.encode_with_special([x.decode() for x in utf8(b.column(1))])):
                times = times + 1 if i == last else 0
                last = i
                ids.append(i)
                repeats.append(times)
                out.append(coded + end)
                n += len(out[-1]) // width
                if n >= block_tokens:
                    yield _batch(_block(part, block, width, ids, repeats, out))
                    block, ids, repeats, out, n = block + 1, [], [], [], 0
        if ids:
            yield _batch(_block(part, block, width, ids, repeats, out))

    src.mapInArrow(encode, FILE).write.option("parquet.page.size", 1 << 20).parquet(path)
    return width


def _batch(row: dict) -> pa.RecordBatch:
    kinds = {"shard": pa.int32(), "block": pa.int32(), "first_id": pa.int64(), "last_id": pa.int64(), "n_docs": pa.int64(), "n_tokens": pa.int64(),
             "ids": pa.list_(pa.int64()), "levels": pa.list_(pa.binary())}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], list(row))


class BlockReader:
    """Constant-time keyed access to a file row."""

    def __init__(self, row: dict, width: int):
        self.hash = PerfectHash.load(row["levels"])
        self.prints, self.offsets = np.frombuffer(row["prints"], np.uint32), np.frombuffer(row["offsets"], np.int64)
        self.lengths, self.payload = np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["payload"], f"<u{width}")

    def locate(self, ids: list, repeats: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which keys the block holds (by fingerprint), and their offsets and lengths."""
        key = key_of(ids, repeats)
        slot = self.hash.slots(key)
        ok = (slot >= 0) & (self.prints[slot] == (_mix(key, 7) >> np.uint64(32)).astype(np.uint32))
        return ok, self.offsets[slot], self.lengths[slot]

    def get(self, doc_id, repeat: int = 0) -> np.ndarray | None:
        """The ids of a document, or None if the block doesn't hold it."""
        ok, at, n = self.locate([doc_id], [repeat])
        return self.payload[at[0]: at[0] + n[0]] if ok[0] else None


def lookup(spark, path: str, width: int, doc_id: int, repeat: int = 0) -> np.ndarray | None:
    """The token ids of one document: only blocks whose id range holds it are read."""
    hit = spark.read.schema(FILE).parquet(path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    for row in hit.toLocalIterator():
        if (got := BlockReader(row.asDict(), width).get(doc_id, repeat)) is not None:
            return got
    return None


def read_tokens(spark, path: str, width: int) -> DataFrame:
    """Per document, through the index of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(FILE).parquet(path)
    sizes = sorted((r["shard"], r["block"], r["n_tokens"]) for r in files.select("shard", "block", "n_tokens").collect())  # one a block of a million ids
    before, total = [], 0
    for s, b, n in sizes:
        before.append((s, b, total))
        total += n
    starts = spark.createDataFrame(before, "shard int, block int, before long")

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                x = BlockReader(row, width)
                ok, at, n = x.locate(row["ids"], np.frombuffer(row["repeats"], np.int64))
                assert ok.all()
                crc = [zlib.crc32(x.payload[a: a + k].astype("<u4").tobytes()) for a, k in zip(at.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(at + row["before"]), pa.array(n), pa.array(crc, pa.int64())],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])

    return (files.join(F.broadcast(starts), ["shard", "block"]).select(*files.columns, "before")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def op7_token_output(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` as token ids in files, read back through their index."""
    path = scratch_path(spark, "token_ids")
    width = write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path, width)
