"""Token files: ids of whole texts in patched frame-of-reference blocks, written and read back.

A block holds up to 1,024 ids. The least one is subtracted, and the rest is packed at the
width that a set percentile of them fits in; those that need more are kept in an exception
list at the end of the block. Blocks are gathered in pages, each with the starts of its blocks and
the lengths of its documents. Pages are rows of Parquet files, so Spark's own writer
commits them and a lost executor leaves nothing half done.

A block, little-endian: least id u4, ids u2, width u1, exceptions u2, the packed bits, places of
exceptions u2 each, their full ids u4 each.
"""

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, product, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillbook.functions.shared import new_folder
from tillbook.llm.shingles import mixed, powers, word_hashes
from tillbook.llm.text import only

BLOCK = 1024
PERCENTILE = 95
PAGE_IDS = 1 << 18
HEAD = struct.Struct("<IHBH")
# Words a Python worker remembers: the first it meets, and so the common ones. Others are encoded where they occur.
MOST_WORDS = 500_000
# A word that no text has, as it is no UTF-8: the end of a text.
END = b"\xff"
PAGES = (
    "part int, first long, doc_ids array<long>, lengths array<long>, "
    "block_starts array<int>, blocks binary"
)


def pack(ids: np.ndarray) -> tuple[bytes, list[int]]:
    """Blocks of the ids, one after the other, and where each starts."""
    out, starts, size = [], [], 0
    for at in range(0, len(ids), BLOCK):
        block = ids[at : at + BLOCK].astype(np.uint32)
        least = int(block.min())
        rest = block - np.uint32(least)
        kth = (len(rest) - 1) * PERCENTILE // 100
        width = int(np.partition(rest, kth)[kth]).bit_length()
        over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, int)
        octets = rest.astype("<u4").view(np.uint8).reshape(-1, 4)
        bits = np.unpackbits(octets, axis=1, count=width, bitorder="little") if width else octets[:0]
        parts = [
            HEAD.pack(least, len(block), width, len(over)),
            np.packbits(bits, bitorder="little").tobytes(),
            over.astype("<u2").tobytes(),
            block[over].astype("<u4").tobytes(),
        ]
        starts.append(size)
        out += parts
        size += sum(map(len, parts))
    return b"".join(out), starts


def unpack(data: bytes, starts: list[int]) -> np.ndarray:
    """The ids of the blocks that start at the given places, in order."""
    out = [np.zeros(0, np.uint32)]
    for at in starts:
        least, count, width, n_over = HEAD.unpack_from(data, at)
        at += HEAD.size
        size = (count * width + 7) // 8
        bits = np.unpackbits(
            np.frombuffer(data, np.uint8, size, at), count=count * width, bitorder="little"
        )
        wide = np.zeros((count, 32), np.uint8)
        wide[:, :width] = bits.reshape(count, width)
        block = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)
        block += np.uint32(least)
        places = np.frombuffer(data, "<u2", n_over, at + size)
        block[places] = np.frombuffer(data, "<u4", n_over, at + size + 2 * n_over)
        out.append(block)
    return np.concatenate(out)


# Blanks that part words, and texts to try them between.
PARTING = (" ", "  ", "\n", "\t ", " \r\n", "\x0b", "\x0c")
PROBES = ("a", "The", "it's", "9", "...", "é", "x1-y", "##", "中文", "\U0001f600")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Places:
    """Numbers of words by a 64-bit hash, in arrays: a table of open addresses, at most half full.

    Among half a million words a further one is taken for one of them with a probability of 3e-14.
    """

    def __init__(self, most: int):
        size = 1 << (2 * most - 1).bit_length()
        self.mask = np.uint64(size - 1)
        self.hashes = np.zeros(size, np.uint64)
        self.numbers = np.full(size, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers, -1 for words not known."""
        found = np.full(len(hashes), -1, np.int64)
        at = (hashes & self.mask).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            here = at[todo]
            number = self.numbers[here]
            hit = (number >= 0) & (self.hashes[here] == hashes[todo])
            found[todo[hit]] = number[hit]
            todo = todo[(number >= 0) & ~hit]
            at[todo] = (at[todo] + 1) & int(self.mask)
        return found

    def add(self, hashes: np.ndarray, first: int) -> None:
        """Numbers distinct new words from ``first`` on."""
        at = (hashes & self.mask).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            here, place = np.unique(at[todo], return_index=True)
            free = self.numbers[here] < 0
            placed = todo[place[free]]
            self.hashes[here[free]], self.numbers[here[free]] = hashes[placed], first + placed
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            taken = self.numbers[at[todo]] >= 0
            at[todo[taken]] = (at[todo[taken]] + 1) & int(self.mask)


class WordIds:
    """Ids of texts, word by word where that is the same.

    A tokenizer that drops blanks and never joins what they part gives a text the ids of its words, so each
    distinct word is encoded once, and in small letters if the tokenizer makes no difference. Whether a vocabulary
    file is of that kind is tried when it is loaded; with any other, whole texts are encoded.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.by_word = self.parts_at_blanks()
        self.by_case = not self.by_word or self.minds_case()
        self.forget()

    def parts_at_blanks(self) -> bool:
        def ids(text: str) -> list[int]:
            return self.tokenizer.encode(text, add_special_tokens=False).ids

        alone = {p: ids(p) for p in PROBES}
        return all(
            ids(a + blank + b) == alone[a] + alone[b]
            for a, blank, b in product(PROBES, PARTING, PROBES)
        ) and all(ids(blank + a + blank) == alone[a] for a, blank in product(PROBES, PARTING))

    def minds_case(self) -> bool:
        """Whether A-Z and a-z may give other ids."""

        def ids(text: str) -> list[int]:
            return self.tokenizer.encode(text, add_special_tokens=False).ids

        texts = [*PROBES, LETTERS, *LETTERS, *(a + b for a, b in product(LETTERS[::5], PROBES))]
        return any(ids(t) != ids(t.encode().lower().decode()) for t in texts)

    def forget(self) -> None:
        self.known, self.count = Places(MOST_WORDS), 1
        self.known.add(self.hashed(END)[2], 0)
        self.ids = np.array([self.end_id], np.uint32)
        self.starts = np.zeros(1, np.int64)
        self.sizes = np.ones(1, np.int32)

    def hashed(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of words; the hash does not mind case unless the tokenizer does."""
        given = np.frombuffer(data, np.uint8)
        starts, ends, hashes = word_hashes(given)
        if self.by_case:
            capital = ((given >= 65) & (given <= 90)).astype(np.uint64)
            up, down = powers(len(given) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(capital * up[: len(given)])])
            hashes = mixed(hashes + mixed((sums[ends] - sums[starts]) * down[starts]))
        return starts, ends, hashes

    def lists(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has."""
        coded = self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        ids = [c.ids for c in coded]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and how many each text has."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.by_word:
            return self.encode_whole(texts)
        whole = b" \xff ".join([t or b"" for t in texts]) + b" \xff"
        begins, ends, hashes = self.hashed(whole)
        at = self.known.find(hashes)
        ids, starts, sizes = self.ids, self.starts, self.sizes
        missed = np.flatnonzero(at < 0)
        if len(missed):
            new, first, number = np.unique(hashes[missed], return_index=True, return_inverse=True)
            at[missed] = self.count + number
            spans = zip(begins[missed[first]].tolist(), ends[missed[first]].tolist())
            more, lengths = self.lists([whole[a:b] for a, b in spans])
            starts = np.concatenate([starts, len(ids) + np.cumsum(lengths) - lengths])
            sizes, ids = np.concatenate([sizes, lengths]), np.concatenate([ids, more])
            if self.count + len(new) <= MOST_WORDS:
                self.known.add(new, self.count)
                self.count += len(new)
                self.ids, self.starts, self.sizes = ids, starts, sizes
        of_word = sizes[at]
        upto = np.cumsum(of_word)
        places = np.repeat(starts[at] - (upto - of_word), of_word) + np.arange(upto[-1])
        stops = upto[at == 0]
        return ids[places], np.diff(stops, prepend=0)

    def encode_whole(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = self.lists([t or b"" for t in texts])
        return np.insert(ids, np.cumsum(sizes), self.end_id).astype(np.uint32), sizes + 1


@lru_cache(maxsize=4)
def word_ids(path: str, end_id: int) -> WordIds:
    """One for each Python worker, which Spark uses again for its next tasks."""
    return WordIds(path, end_id)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> None:
    """Writes the ids of all texts, in ascending order of ``doc_id``, NULL first.

    A NULL text counts as empty and has the end id alone. Rows of one id are ordered by a hash of
    their text, then by the text. Documents are dealt out by ranges of ids and hashes, and a task writes its
    range page by page.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, first = word_ids(tokenizer, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            begin = 0
            while begin < len(texts):
                stop, size = begin, 0
                while stop < len(texts) and (stop == begin or size < PAGE_IDS * 4):
                    size += len(texts[stop] or b"")
                    stop += 1
                ids, lengths = coder.encode(texts[begin:stop])
                blocks, starts = pack(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()),
                        pa.array([first], pa.int64()),
                        pa.array([doc_ids[begin:stop]], pa.list_(pa.int64())),
                        pa.array([lengths.tolist()], pa.list_(pa.int64())),
                        pa.array([starts], pa.list_(pa.int32())),
                        pa.array([blocks], pa.binary()),
                    ],
                    ["part", "first", "doc_ids", "lengths", "block_starts", "blocks"],
                )
                first += len(ids)
                begin = stop

    (
        only(docs, "doc_id", "text")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_hash"))
        .repartitionByRange("doc_id", "_hash")
        .sortWithinPartitions("doc_id", "_hash", "text")
        .drop("_hash")
        .mapInArrow(work, PAGES)
        .write.option("compression", "none")
        .parquet(folder)
    )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` counts the ids of all documents before. A part's own start is the sum over the parts before it;
    there are as many of these as tasks wrote, whatever the size of the files.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.to_pylist():
                ids = unpack(page["blocks"], page["block_starts"]).astype("<u4")
                stops = np.cumsum(page["lengths"])
                begins = stops - page["lengths"]
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, stops)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(page["doc_ids"], pa.int64()),
                        pa.array(begins + page["base"] + page["first"], pa.int64()),
                        pa.array(page["lengths"], pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    pages = spark.read.schema(PAGES).parquet(folder)
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = pages.groupBy("part").agg(F.sum(total).alias("total"))
    before = F.sum("total").over(W.orderBy("part")) - F.col("total")
    bases = parts.select("part", before.alias("base"))
    return pages.join(F.broadcast(bases), "part").mapInArrow(
        work, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Writes token files into the shared folder and returns what ``read`` finds in them."""
    folder = new_folder(docs.sparkSession, "tokens")
    write(docs, folder, tokenizer, end_id)
    return read(docs.sparkSession, folder)
