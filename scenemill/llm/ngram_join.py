"""N-gram Jaccard join: MinHash banding, shuffled on band hashes, pairs verified on full n-gram sets.

1. Texts with equal n-gram sets form one class; one row, its representative, goes on.
2. Bands and rows are chosen for the target recall at the threshold. Band hashes are shuffled; in
   each bucket pairs whose sketches agree well enough are found, and a forest that connects them is
   emitted, never the pairs. A bucket of over BUCKET_BLOCK rows is dealt out in pairs of blocks.
3. The forests' components are candidate groups. Their full n-gram sets are fetched once, and every
   pair of a group, in pairs of blocks, is compared exactly, so a pair that shared no band is found
   too if the group connects it. Counts of links and a forest of the verified links are emitted.
4. The components of the verified links are the near-duplicate groups.

Where links need not be counted (drop_near_copies), step 3 first compares each member with its group's
least node alone, which costs time in proportion to the members; only groups in which some member isn't
similar to that node are compared pair by pair.

Cases: words are runs without ASCII white space, compared as they are. A text of fewer words than an
n-gram is one n-gram; texts without words (null or empty too) form one class without links. Rows that
repeat an id and a text are copies. Null ids come last among copies. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discarded, fresh, known, mapped, staged
from .exact_dedup import one_of_each, sha256
from .graph import components, local_components
from .shingles import WORDS, MinHash, choose_bands, shingle_sets

THRESHOLD = 0.8
#: Of pairs at the threshold, the share that meets in a band.
RECALL = 0.9999
#: Rows of a block of a bucket; rows and n-grams of a block of a candidate group.
BUCKET_BLOCK, GROUP_BLOCK, GROUP_GRAMS = 512, 512, 400_000
SLICE, PAIRS = 256, 65_536


def complete_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by the first columns, cut where a key ends, with the starts of the keys and the end."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        new = _starts(rest, keys)
        if len(new) > 1:
            yield rest.slice(0, int(new[-1])), new
            rest = rest.slice(int(new[-1]))
    if rest is not None and rest.num_rows:
        yield rest, np.append(_starts(rest, keys), rest.num_rows)


def _starts(t: pa.Table, keys: int) -> np.ndarray:
    if not t.num_rows:
        return np.empty(0, np.int64)
    changed = np.zeros(t.num_rows, bool)
    changed[0] = True
    for k in range(keys):
        c = t.column(k).to_numpy()
        changed[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(changed)


def block_pairs(rows: DataFrame, key: str, blocks: F.Column, node: str = "node") -> DataFrame:
    """Each row once for every pair of blocks that its own belongs to: key, lo, hi, side and the other columns."""
    rows = rows.withColumn("blocks", blocks.cast("int"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64(node), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other"))
    rest = [c for c in rows.columns if c not in (key, "lo", "hi", "side", "other", "blocks")]
    return rows.select(key, "lo", "hi", "side", *rest).repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi", node)


def pairs_of(side: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that a pair of blocks is to compare: within one block, or across two."""
    if lo == hi:
        return np.triu_indices(len(side), 1)
    a, b = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def sign(docs: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """doc_id, the text's sha, digest of the n-gram set, its size, band hashes and sketch; docs: doc_id, text, sha."""
    id_field = docs.schema["doc_id"]
    schema = T.StructType([id_field, docs.schema["sha"], T.StructField("digest", T.BinaryType()), T.StructField("grams", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(bands, rows)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                out = []
                for grams in shingle_sets(part.column(1).to_pylist(), words):
                    least = minhash.minima(grams)
                    keys = minhash.band_hashes(least) if len(grams) else least[:0].astype(np.int64)
                    out.append((hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), len(grams), keys, minhash.sketch(least)))
                digest, n, keys, sketch = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(digest, pa.binary()), pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], schema.names)

    return mapped(docs, signed, schema)


def candidate_edges(reps: DataFrame, least_equal: float) -> DataFrame:
    """a, b: a forest, for every bucket, of the pairs whose sketches have so many equal bytes."""
    keyed = reps.select("node", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    members = keyed.join(shared, "bucket").join(reps.select("node", "sketch"), "node")
    members = block_pairs(members, "bucket", F.ceil(F.col("rows") / BUCKET_BLOCK)).drop("rows")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in complete_groups(batches, 3):
            lo, hi, side, node = (t.column(c).to_numpy() for c in ("lo", "hi", "side", "node"))
            sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            near_a, near_b, left, right, held = [], [], [], [], 0

            def settle() -> None:
                """Of the pairs held, those that are near; so few of all pairs are ever in memory."""
                a, b = np.concatenate(left), np.concatenate(right)
                for i in range(0, len(a), PAIRS):
                    x, y = a[i : i + PAIRS], b[i : i + PAIRS]
                    near = (sketches[x] == sketches[y]).sum(axis=1) >= least_equal
                    near_a.append(x[near])
                    near_b.append(y[near])
                left.clear()
                right.clear()

            for s, e in zip(starts[:-1], starts[1:]):
                x, y = pairs_of(side[s:e], lo[s], hi[s])
                left.append((x + s).astype(np.int32))
                right.append((y + s).astype(np.int32))
                held += len(x)
                if held >= PAIRS:
                    settle()
                    held = 0
            if left:
                settle()
            a, b = np.concatenate(near_a), np.concatenate(near_b)
            # rows of different buckets have no pair, so one labelling serves all
            root = local_components(t.num_rows, a, b)
            kept = np.flatnonzero(root != np.arange(t.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(node[kept]), pa.array(node[root[kept]])], ["a", "b"])

    return mapped(members, found, "a long, b long")


def similar(sets: list[np.ndarray], a_side: np.ndarray, b_side: np.ndarray, threshold: float, width: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (one of a_side, one of b_side) of sets whose Jaccard similarity reaches the threshold."""
    sizes = np.array([len(s) for s in sets])
    grams, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # an n-gram of one set is in no intersection, and one of all sets is in each
    everywhere = int((counts == len(sets)).sum())
    used = (counts > 1) & (counts < len(sets))
    number = np.cumsum(used) - 1
    keep = used[columns]
    owner, columns = owner[keep], number[columns[keep]]
    order = np.argsort(columns, kind="stable")
    owner, columns = owner[order], columns[order]
    common = np.full((len(a_side), len(b_side)), float(everywhere), np.float32)
    for low in range(0, int(used.sum()), width):
        s, e = np.searchsorted(columns, [low, low + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[s:e], columns[s:e] - low] = 1
        common += has[a_side] @ has[b_side].T
    common = common.astype(np.float64)
    union = sizes[a_side][:, None] + sizes[b_side][None, :] - common
    x, y = np.nonzero(common / np.maximum(union, 1) >= threshold)
    return a_side[x], b_side[y]


def gram_sets(docs: DataFrame, groups: DataFrame, words: int) -> DataFrame:
    """node, root, n, total (members and n-grams of the group), and the n-gram set of every member; groups: node, doc_id, sha, grams, root."""
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("grams").alias("total"))
    members = groups.join(sizes, "root").withColumnRenamed("doc_id", "__id").withColumnRenamed("sha", "__sha")
    # dealt out by id and text at every size: the members grow with the input, so they are no side to broadcast,
    # and rows that share an id, or have none, don't meet
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha"))
    texts = docs.hint("merge").join(members, same).select("text", "node", "root", "n", "total")
    schema = "node long, root long, n long, total long, grams binary"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                sets = [s.tobytes() for s in shingle_sets(part.column("text").to_pylist(), words)]
                out = [part.column(c) for c in ("node", "root", "n", "total")] + [pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["node", "root", "n", "total", "grams"])

    return mapped(texts, fetch, schema)


def near_first(sets: DataFrame, threshold: float) -> DataFrame:
    """node, root and whether the member is similar to its group's least node, which goes to every block of the group."""
    blocks = F.greatest(F.ceil(F.col("n") / GROUP_BLOCK), F.ceil(F.col("total") / GROUP_GRAMS)).cast("int")
    rows = sets.withColumn("blocks", blocks).withColumn("first", F.col("node") == F.col("root"))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("block", F.explode(F.when(F.col("first"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)))
    rows = rows.select(F.col("root").alias("group"), "block", (~F.col("first")).alias("later"), "node", "grams").repartition("group", "block").sortWithinPartitions("group", "block", "later", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = key = None
        for batch in batches:
            out = []
            for group, block, later, node, grams in zip(*(batch.column(k) for k in range(5))):
                own = np.frombuffer(grams.as_buffer(), np.uint64)
                if not later.as_py():  # comes before the block's other rows; its repeated rows are equal
                    first, key = own.copy(), (group.as_py(), block.as_py())
                    out.append((node.as_py(), key[0], True))
                    continue
                assert key == (group.as_py(), block.as_py())
                common = np.isin(own, first, assume_unique=True).sum()
                out.append((node.as_py(), key[0], bool(common >= threshold * (len(own) + len(first) - common))))
            node, root, near = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(root, pa.int64()), pa.array(near, pa.bool_())], ["node", "root", "near"])

    return mapped(rows, compare, "node long, root long, near boolean")


def verified(rows: DataFrame, threshold: float) -> DataFrame:
    """node, links, root by pair of blocks; rows: what gram_sets() gives."""
    blocks = F.greatest(F.ceil(F.col("n") / GROUP_BLOCK), F.ceil(F.col("total") / GROUP_GRAMS))
    rows = block_pairs(rows.withColumn("blocks", F.least(blocks, F.col("n"))).withColumnRenamed("root", "group").drop("n", "total"), "group", F.col("blocks"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in complete_groups(batches, 3):
            lo, hi, side, node = (t.column(c).to_numpy() for c in ("lo", "hi", "side", "node"))
            grams = t.column("grams")
            out = []
            for s, e in zip(starts[:-1], starts[1:]):
                at = s + np.flatnonzero(np.concatenate([[True], np.diff(node[s:e]) != 0]))  # repeated rows once
                sets = [np.frombuffer(grams[int(k)].as_py(), np.uint64) for k in at]
                if lo[s] == hi[s]:
                    a, b = similar(sets, np.arange(len(at)), np.arange(len(at)), threshold)
                    a, b = a[a < b], b[a < b]
                else:
                    a, b = similar(sets, np.flatnonzero(side[at] == lo[s]), np.flatnonzero(side[at] == hi[s]), threshold)
                links = np.bincount(a, minlength=len(at)) + np.bincount(b, minlength=len(at))
                out.append((node[at], links, node[at][local_components(len(at), a, b)]))
            columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "links", "root"])

    return mapped(rows, compare, "node long, links long, root long")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and the text's sha, by which rows that share an id, or have none, are told apart."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), sha256(F.coalesce(text, F.lit(""))).alias("sha"))


def near_classes(read: DataFrame, threshold: float, recall: float, words: int, count_links: bool = True) -> tuple[DataFrame, DataFrame]:
    """The signed rows (doc_id, digest, ...), and for every digest its copies, links (null: not counted), class and whether its first row leads the class."""
    bands, rows = choose_bands(threshold, recall)
    spread = 5 * (threshold * (1 - threshold) / (bands * rows)) ** 0.5  # five standard deviations of the estimate
    signed = staged(sign(read, bands, rows, words).withColumn("row_no", F.monotonically_increasing_id()), "signed")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row_no", "sha")).alias("first")
    classes = staged(
        signed.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n_copies"), F.max("grams").alias("grams")).select("digest", F.col("first.doc_id").alias("copy_of"), F.col("first.row_no").alias("node"), F.col("first.sha").alias("sha"), "n_copies", "grams"),
        "classes",
    )
    reps = signed.where("grams > 0").join(classes.select("node"), F.col("row_no") == F.col("node"), "left_semi").withColumnRenamed("row_no", "node")
    reps = staged(reps.select("node", "bands", "sketch"), "representatives")
    near = components(candidate_edges(reps, (threshold - spread) * bands * rows))
    groups = staged(classes.join(near, "node").select("node", F.col("copy_of").alias("doc_id"), "sha", "grams", "root"), "candidates")
    if count_links:
        checked = staged(verified(gram_sets(read, groups, words), threshold), "verified")
    else:
        sets = staged(gram_sets(read, groups, words), "gram-sets")
        star = staged(near_first(sets, threshold), "near-first")
        rest = sets.join(star.where("not near").select("root").distinct(), "root", "left_semi").select(*sets.columns)
        uncounted = F.lit(None).cast("long").alias("links")
        pairs = verified(rest, threshold).select("node", uncounted, "root")
        checked = staged(star.where("near").select("node", uncounted, "root").unionByName(pairs), "verified")
        discarded(sets, star)
    links = checked.groupBy("node").agg(F.sum("links").alias("n_links"))
    linked = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("node", "copy_of").join(linked, "node")
    least = named.groupBy("root").agg(F.min(F.struct(F.isnull("copy_of").alias("none"), "copy_of", "node")).alias("least"))
    named = named.join(least, "root").select("node", F.struct(F.col("least.copy_of").alias("class_id"), F.col("least.node").alias("leader")).alias("in_class"))
    info = classes.join(links, "node", "left").join(named, "node", "left")
    alone = F.col("in_class").isNull()
    return signed, info.select(
        "digest",
        "sha",
        "copy_of",
        "n_copies",
        (F.coalesce("n_links", F.lit(0)) if count_links else F.lit(None).cast("long")).alias("n_links"),
        F.when(alone, F.col("copy_of")).otherwise(F.col("in_class.class_id")).alias("class_id"),
        (alone | (F.col("in_class.leader") == F.col("node"))).alias("leads"),
    )


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, copy_of, n_copies, n_links, class_id.

    ``copy_of`` is the least id with the same n-gram set and ``n_copies`` how many rows have it;
    ``n_links`` counts the other n-gram sets at or above the threshold; ``class_id`` is the least id
    of all texts that links connect.
    """
    signed, info = near_classes(keyed(docs, id_col, text_col), threshold, recall, words)
    return signed.select("doc_id", "digest").join(info.drop("sha", "leads"), "digest").select("doc_id", "copy_of", "n_copies", "n_links", "class_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, words: int = WORDS) -> DataFrame:
    """Of every near-duplicate group the row with the least id, with all its columns; of rows that repeat an id and a text, that whose columns have the largest hash."""
    key, sha = fresh(docs, "key", "sha")
    kept = near_classes(keyed(docs, id_col, text_col), threshold, recall, words, count_links=False)[1].where("leads").select(known(F.col("copy_of")).alias(key), F.col("sha").alias(sha))
    rows = docs.withColumn(key, known(F.col(id_col))).withColumn(sha, sha256(F.coalesce(F.col(text_col), F.lit(""))))
    # one exchange of the texts, after repeated rows are combined where they are read, serves both
    return one_of_each(rows, [key, sha]).join(kept, [key, sha], "left_semi").select(*docs.columns)
