"""Near duplicates by a chosen-path join.

Documents with the same set of shingles are one class, with one representative. Each
representative has 64 minwise tokens. A tree starts with all of them in one node. A node
chooses two of the 64 places by its own hash, and each of its documents goes on to the two
children named by its tokens at these places: similar documents mostly meet in a child,
others hardly ever. A node with one document ends. A small node is compared exhaustively. A
large node links its documents with its first one, and branches on. What comes out is
confirmed on the full sets of both texts.

Two documents of similarity 0.8 part in one tree with a probability of about 0.06; five
independent trees leave about one pair in a million. A class of many similar documents would
never come apart, and comparing all its pairs is not needed: nodes whose documents
are all linked already are finished. Documents of any others go through twenty late trees
of one path each, over fresh minwise tokens: a leaf is named by four of them. A pair of similarity 0.8 misses all
late leaves with a probability of 0.00003.

A late leaf is compared exhaustively, on full sets and where they are: its documents are dealt over blocks of bounded size,
every two blocks meet in one task, which counts the common shingles of all their pairs as a product of matrices
and gives out no pairs, only the links that join what was not joined before, fewer than there are documents.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.shared import stored
from tillbook.llm.shingles import minimums, mixed, overlap, pair_sets, seeds
from tillbook.llm.text import only

TOKENS = 64
# Late trees: how many, and tokens that name a leaf.
LATE_TREES, LATE_PATH = 20, 4
# A block of a late leaf: about so many documents and shingles. Columns of a matrix at a time.
BLOCK_DOCS, BLOCK_SHINGLES, COLUMNS = 512, 1 << 20, 4096


@dataclass(frozen=True)
class Trees:
    """``differ`` is how many of 64 one-bit tokens two documents may differ in to be compared.

    At a similarity of 0.8 a mean of 6.4 bits differ, with a deviation of 2.4.
    """

    percent: int = 80
    trees: int = 5
    small: int = 8
    levels: int = 5
    differ: int = 18


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and a hash of it."""
    return only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")
    )


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, size and fingerprint of its set, and its minwise tokens."""
    import hashlib

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, shift = seeds(TOKENS)
        for batch in batches:
            sizes, prints, tokens = [], [], []
            for hashes in pair_sets(batch.column("text").to_pylist()):
                sizes.append(len(hashes))
                digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
                prints.append(digest if len(hashes) else None)
                tokens.append(
                    minimums(hashes, scale, shift).view(np.int32) if len(hashes) else None
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.array(tokens, pa.list_(pa.int32())),
                ],
                ["doc_id", "text_key", "n_shingles", "print", "tokens"],
            )

    return keyed(docs).mapInArrow(
        work, "doc_id long, text_key long, n_shingles long, print binary, tokens array<int>"
    )


def representatives(sketched: DataFrame) -> DataFrame:
    """One row per distinct set, numbered ``rep``: a row of it, its size, tokens and one-bit tokens.

    The row is the one with the least id, then the least hash of its text. Numbers hold once the rows are
    stored.
    """
    classes = (
        sketched.filter(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("print")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("r"))
        .select("print", "r.doc_id", "r.text_key")
    )
    bits = F.aggregate(
        "tokens",
        F.lit(0).cast("long"),
        lambda a, t: F.shiftleft(a, 1).bitwiseOR(t.bitwiseAND(1).cast("long")),
    )
    return (
        sketched.join(classes, ["doc_id", "text_key", "print"], "left_semi")
        .dropDuplicates(["print"])
        .select("print", "doc_id", "text_key", "n_shingles", "tokens", bits.alias("bits"))
        .withColumn("rep", F.monotonically_increasing_id())
    )


def of_one_id(sketched: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id but not their set."""
    rows = sketched.select("doc_id", "print").join(reps.select("print", "rep"), "print")
    shared = (
        rows.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_last"))
        .filter(F.col("a") < F.col("_last")).drop("_last")
    )
    return rows.join(shared, "doc_id").filter(F.col("a") < F.col("rep")).select("a", F.col("rep").alias("b"))


def children(node: Column) -> Column:
    """The two nodes a document goes on to, or the one if they are the same."""

    def child(j: int) -> Column:
        place = F.pmod(F.xxhash64(node, F.lit(j)), F.lit(TOKENS)).cast("int")
        return F.xxhash64(node, place, F.col("tokens")[place])

    return F.array_distinct(F.array(child(0), child(1)))


def branched(rows: DataFrame) -> DataFrame:
    return rows.withColumn("node", F.explode(children(F.col("node"))))


def alike(other: str, limits: Trees) -> Column:
    """Whether sizes and one-bit tokens leave it open that a pair is linked; misses hardly any."""
    size, their_size = F.col("n_shingles"), F.col(f"{other}.n_shingles")
    return (
        (100 * F.least(size, their_size) >= limits.percent * F.greatest(size, their_size))
        & (F.bit_count(F.col("bits").bitwiseXOR(F.col(f"{other}.bits"))) <= limits.differ)
    )


def pairs_of(members: DataFrame, limits: Trees) -> DataFrame:
    """Pairs to confirm in nodes of known size: all in a small node, those with the first in a large one."""
    me = F.struct("rep", "n_shingles", "bits")
    small = (
        members.filter(F.col("size") <= limits.small)
        .groupBy("node")
        .agg(F.collect_list(me).alias("others"))
        .select("others", F.explode("others").alias("me"))
        .select(F.col("me.*"), F.explode("others").alias("other"))
    )
    large = members.filter(F.col("size") > limits.small).select(
        "rep", "n_shingles", "bits", F.struct("first.rep", "first.n_shingles", "first.bits").alias("other")
    )
    return (
        small.unionByName(large)
        .filter((F.col("rep") != F.col("other.rep")) & alike("other", limits))
        .select(
            F.least("rep", "other.rep").alias("a"), F.greatest("rep", "other.rep").alias("b")
        )
    )


def with_sizes(rows: DataFrame) -> DataFrame:
    """Rows in nodes with company, with the node's ``size`` and ``first`` document."""
    nodes = (
        rows.groupBy("node")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min(F.struct("print", "rep", "n_shingles", "bits")).alias("first"),
        )
        .filter(F.col("size") > 1)
    )
    return rows.join(nodes, "node")


def texts_of(docs: DataFrame, reps: DataFrame, used: DataFrame) -> DataFrame:
    """``rep`` and ``text`` of the representatives in ``used``."""
    keys = reps.join(used, "rep", "left_semi").select("rep", "doc_id", "text_key")
    return (
        keyed(docs).join(keys, ["doc_id", "text_key"]).dropDuplicates(["rep"]).select("rep", "text")
    )


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` whose texts' full sets are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_a = pair_sets(batch.column("text_a").to_pylist())
            sets_b = pair_sets(batch.column("text_b").to_pylist())
            linked = []
            for x, y in zip(sets_a, sets_b):
                common = overlap(x, y)
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], ["a", "b"]
            ).filter(pa.array(linked, pa.bool_()))

    used = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    texts = stored(texts_of(docs, reps, used))
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``rep`` and ``root``, the least id it is linked with over any number of links.

    Two steps alternate until nothing changes: every document hands its larger neighbours
    over to the least one it knows, then its smaller ones. Each step halves the way
    to the root, and works on links alone.
    """
    links = stored(links.select("a", "b").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    before = None
    while (now := state(links)) != before:
        before = now
        both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        large = (
            both.join(least, "a").filter(F.col("b") > F.col("a"))
            .select(F.col("least").alias("a"), "b").filter("a <> b").distinct()
        )
        down = large.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        small = down.join(least, "a").select(F.col("least").alias("to"), F.col("b").alias("from"))
        small = small.union(least.select(F.col("least").alias("to"), F.col("a").alias("from")))
        links = stored(
            small.filter(F.col("to") != F.col("from"))
            .select(F.col("to").alias("a"), F.col("from").alias("b"))
            .distinct()
        )
    return links.select(F.col("b").alias("rep"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, limits: Trees = Trees()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    ``component_id`` is the least id reachable over links, ``kept`` tells whether it is the
    document's own. A NULL or empty text, or one of blanks, has no shingles and no links. A row
    with a NULL id links with nothing, has a NULL ``component_id`` and is kept. Rows that
    repeat an id are one document, also with different texts: each text is linked by its own set, and
    what is linked with one is reachable from all.
    """
    sketched = stored(sketches(docs))
    reps = stored(representatives(sketched))
    tokens = reps.select("rep", "tokens")
    rows = reps.select("print", "rep", "n_shingles", "bits", "tokens").withColumn(
        "node", F.explode(F.array(*[F.xxhash64(F.lit(t)) for t in range(limits.trees)]))
    )
    rows = branched(branched(rows)).drop("tokens")
    found = []
    for level in range(2, limits.levels + 1):
        sized = stored(with_sizes(rows))
        found.append(pairs_of(sized, limits))
        large = sized.filter(F.col("size") > limits.small).drop("size", "first")
        if level < limits.levels:
            rows = branched(large.join(tokens, "rep")).drop("tokens")
    links = confirmed(stored(reduce(DataFrame.union, found).distinct()), reps, docs, limits.percent)
    links = stored(links.union(of_one_id(sketched, reps)))
    roots = components(links)
    more = apart(large, roots)
    if not more.isEmpty():
        texts = texts_of(docs, reps, more.select("rep").distinct())
        members = stored(late_sets(texts).join(roots, "rep", "left"))
        links = links.union(late_links(late_rows(members), members, limits.percent))
        roots = components(links)
    whole = reps.join(roots, "rep", "left").select(
        "print", "doc_id", F.coalesce("root", "rep").alias("root")
    )
    least = whole.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = whole.join(least, "root").select("print", "component_id")
    known, empty = sketched.filter(F.col("print").isNotNull()), sketched.filter(F.col("print").isNull())
    # A row without shingles may share its id with rows that have some.
    others = (
        known.join(empty.select("doc_id").distinct(), "doc_id", "left_semi")
        .join(classes, "print")
        .groupBy("doc_id")
        .agg(F.min("component_id").alias("component_id"))
    )
    columns = ("doc_id", "n_shingles", "component_id")
    merged = (
        known.join(classes, "print", "left").select(*columns)
        .unionByName(empty.join(others, "doc_id", "left").select(*columns))
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return merged.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of nodes whose documents are not all linked yet."""
    named = stored(rows.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep")))
    open_nodes = (
        named.groupBy("node")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .filter(F.col("low") != F.col("high"))
        .select("node")
    )
    return stored(named.join(open_nodes, "node", "left_semi"))


def late_sets(texts: DataFrame) -> DataFrame:
    """``rep``, its set and the size of it, and its leaf in each late tree."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = LATE_TREES * LATE_PATH
        scale, shift = (x[TOKENS:] for x in seeds(TOKENS + count))
        tree = np.arange(LATE_TREES, dtype=np.uint64)
        for batch in batches:
            sizes, leaves, sets = [], [], []
            for hashes in pair_sets(batch.column("text").to_pylist()):
                tokens = minimums(hashes, scale, shift)
                leaf = mixed(tree)
                for step in range(LATE_PATH):
                    leaf = mixed(leaf + tokens[step * LATE_TREES : (step + 1) * LATE_TREES])
                sizes.append(len(hashes))
                leaves.append(leaf.view(np.int64))
                sets.append(hashes.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rep"),
                    pa.array(sizes, pa.int64()),
                    pa.array(leaves, pa.list_(pa.int64())),
                    pa.array(sets, pa.binary()),
                ],
                ["rep", "n_shingles", "leaves", "hashes"],
            )

    return texts.select("rep", "text").mapInArrow(
        work, "rep long, n_shingles long, leaves array<long>, hashes binary"
    )


def late_rows(members: DataFrame) -> DataFrame:
    """``leaf`` and ``rep`` for each late leaf with several roots, once for each two blocks to compare.

    ``x`` and ``y`` number the blocks; ``here`` is the document's own.
    """
    rows = members.select(
        F.explode("leaves").alias("leaf"), "rep", "n_shingles", F.coalesce("root", "rep").alias("root")
    )
    blocks = F.greatest(
        F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_DOCS)), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))
    )
    open_leaves = (
        rows.groupBy("leaf")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"), blocks.cast("int").alias("blocks"))
        .filter(F.col("low") != F.col("high"))
        .select("leaf", "blocks")
    )
    own = F.pmod(F.xxhash64("leaf", "rep"), F.col("blocks")).cast("int")
    return (
        rows.join(open_leaves, "leaf")
        .withColumn("here", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "leaf", F.least("here", "_other").alias("x"), F.greatest("here", "_other").alias("y"), "here", "rep"
        )
    )


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of some sets have in common."""
    count = len(sets)
    owner = np.repeat(np.arange(count), [len(s) for s in sets])
    values, column, times = np.unique(
        np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True, return_counts=True
    )
    # What only one set has counts for none of the pairs.
    place = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    owner, column = owner[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((count, count), dtype=np.float32)
    # Counts stay far below what a 32-bit float holds exactly in each lot of columns.
    total = np.zeros((count, count), dtype=np.int64)
    for start in range(0, int(times[times > 1].size), COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS])
        matrix = np.zeros((count, COLUMNS), dtype=np.float32)
        matrix[owner[a:b], column[a:b] - start] = 1
        np.matmul(matrix, matrix.T, out=common)
        total += common.astype(np.int64)
    return total


def joining(linked: np.ndarray, roots: np.ndarray) -> list[tuple[int, int]]:
    """Links enough to join all that ``linked`` joins, and none between what is joined already."""
    label, out = roots.copy(), []
    for row in range(len(linked)):
        near = np.flatnonzero(linked[row])
        for new, first in zip(*np.unique(label[near], return_index=True)):
            if new != label[row]:
                out.append((row, int(near[first])))
                label[label == new] = label[row]
    return out


def late_links(rows: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links ``a``, ``b`` between documents of late leaves, confirmed on their full sets."""

    def work(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(h, "<u8") for h in table.column("hashes").to_pylist()]
        names, roots, here = (
            table.column(c).to_numpy().astype(np.int64) for c in ("rep", "root", "here")
        )
        order = np.argsort(names)
        sets, names, roots, here = [sets[i] for i in order], names[order], roots[order], here[order]
        common = common_counts(sets)
        size = np.array([len(s) for s in sets], dtype=np.int64)
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        linked &= roots[:, None] != roots[None, :]
        if len(set(here)) > 1:
            linked &= here[:, None] != here[None, :]
        links = joining(linked, roots)
        return pa.table(
            {
                "a": pa.array([names[i] for i, _ in links], pa.int64()),
                "b": pa.array([names[j] for _, j in links], pa.int64()),
            }
        )

    sets = members.select("rep", F.coalesce("root", "rep").alias("root"), "hashes")
    found = rows.join(sets, "rep").groupBy("leaf", "x", "y").applyInArrow(work, "a long, b long")
    return stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def first_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is kept, with all their columns.

    A row that is repeated in full comes once. Rows that share a kept id but differ all stay, and so do
    rows without id.
    """
    judged = near_duplicates(docs)
    marks = (
        judged.groupBy("doc_id")
        .agg(F.bool_and("kept").alias("kept"), (F.count(F.lit(1)) > 1).alias("again"))
        .filter(F.col("doc_id").isNotNull() & (~F.col("kept") | F.col("again")))
        .select(F.struct("doc_id", "kept").alias("_mark"))
    )
    marked = docs.alias("d").join(
        stored(marks).alias("m"), F.expr("cast(d.doc_id as bigint) = m._mark.doc_id"), "left"
    )
    single = marked.filter("m._mark is null").select("d.*")
    several = marked.filter("m._mark.kept").select("d.*").dropDuplicates()
    return single.unionByName(several)
