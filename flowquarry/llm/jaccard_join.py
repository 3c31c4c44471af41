"""N-gram Jaccard join: documents whose sets of word shingles are alike, and their components.

Sets are ordered rare-first by one order for all documents: how many documents have a shingle,
counted for all of them, then its hash. Two sets with similarity t or more share a
shingle within their prefixes, the first n - ceil(t n) + 1 shingles. So candidates meet on prefix
shingles. Length, positional and suffix filters discard pairs that cannot reach t, and every pair
left is verified once, on the whole sets of both texts.

Equal sets are one class from the start, so copies cost nothing further. To spare a group of
near copies all its pairs, candidates come in two rounds. First every document of a prefix
shingle's bucket is paired with one pivot, the document that has the shingle earliest; verified
links make components. Then only pairs of one bucket whose components differ are still open; all of
them that the filters leave are verified. Pairs inside a component need no check: they change no
component. No bucket has a cap.

A set of which too many shingles are in no other document is left out, and the part that is alone
tightens the bound on the overlap of a pair.

Sizes: counts are made in slices of the hash range, as many as the input has 4 MB of text, from the
distinct shingles of each batch of texts, and go back to the batches that asked; nothing is
broadcast. Two shingles that agree in their slice and 32 bits count as one, which makes the order
coarser and never loses a pair. Counts are exact up to EXACT and rounded down to steps of 1/256
octave beyond. Postings are rows (shingle, document, position, size). Joins are on shingles or identifiers and can be split
by adaptive execution; the two sides of a pair meet as texts only for candidates.

Defined results: null and empty texts, and texts without words, have size 0 and link with nothing;
rows with a null identifier are counted but link with nothing and have a null component; rows that
share an identifier are one document with several texts, and whatever one of them links with
belongs to its component; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.batches import by_slice, dealt_by_slice, first_of_runs, slice_edges, slices_for, text_batches, unpacked
from flowquarry.llm.common import cluster_partitions, delete_table, written
from flowquarry.llm.components import components
from flowquarry.llm.shingles import shingle_sets
from flowquarry.llm.spec_bpe import pieces

PARTS = 32
EXACT = 1 << 15


def _need(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set that is alike."""
    return -(-n * percent // 100)


def _prefix(n: int, percent: int) -> int:
    return n - _need(n, percent) + 1 if n else 0


def _set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _batch_sets(batch: pa.RecordBatch, row: int, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The shingle sets of a row of texts, and all their shingles one after the other."""
    data, offsets = unpacked(batch, row)
    if offsets[-1] < 1 << 31:
        texts = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
    else:
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
    sets = list(shingle_sets(texts, k))
    return sets, np.concatenate([np.empty(0, np.uint64), *sets])


def _steps(n: np.ndarray) -> np.ndarray:
    """Counts in 16 bits, in the same order: themselves up to EXACT, then steps of their logarithm."""
    far = EXACT + 256 * (np.log2(np.maximum(n, EXACT)) - EXACT.bit_length() + 1)
    return np.where(n < EXACT, n, np.minimum(far, 0xFFFF)).astype(np.uint16)


def _counts(texts: DataFrame, k: int, s: int, n: int) -> DataFrame:
    """For each batch and slice how many documents, of all batches, have each of the batch's distinct shingles."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                own, times = np.unique(_batch_sets(batch, row, k)[1], return_counts=True)
                if not len(own):
                    continue
                used, edges = slice_edges(own, s)
                keys, times = own.astype(np.uint32), times.astype(np.uint16)  # 2000 texts at most
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(used), batch.column("bid")[row].as_py(), np.int64)),
                        pa.array(used, pa.int32()),
                        *(pa.array([x[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()) for x in (keys, times)),
                    ],
                    ["bid", "slice", "keys", "times"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in by_slice(batches):
            keys = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
            order = np.argsort(keys, kind="stable")
            first = first_of_runs(keys[order])
            times = np.concatenate([np.frombuffer(r[3], np.uint16) for r in rows])[order].astype(np.int64)
            out = np.empty(len(keys), np.uint16)
            out[order] = np.repeat(_steps(np.add.reduceat(times, first)), np.diff(np.append(first, len(keys))))
            edges = np.cumsum([0, *(len(r[3]) // 2 for r in rows)]).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([number] * len(rows), pa.int32()), pa.array([out[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())],
                ["bid", "slice", "counts"],
            )

    asked = texts.mapInArrow(distinct, "bid long, slice int, keys binary, times binary")
    return dealt_by_slice(asked, n).mapInArrow(add, "bid long, slice int, counts binary")


def _sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """For each row its identifier, the size and key of its set, how many shingles no other document has, and its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                sets, flat = _batch_sets(batch, row, k)
                _, place = np.unique(flat, return_inverse=True)
                counts = sorted(batch.column("counts")[row].as_py() or [], key=lambda c: c["slice"])
                times = np.frombuffer(b"".join(c["counts"] for c in counts), np.uint16)[place]
                sizes, keys, alone, prefixes, at = [], [], [], [], 0
                for s in sets:
                    own = times[at : at + len(s)]
                    at += len(s)
                    sizes.append(len(s))
                    keys.append(_set_key(s))
                    alone.append(int(np.count_nonzero(own == 1)))
                    prefixes.append(s[np.argsort(own, kind="stable")[: _prefix(len(s), percent)]].view(np.int64))  # s is sorted by hash
                offsets = np.concatenate([[0], np.cumsum(list(map(len, prefixes)))]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.int64), *prefixes])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[row].values,
                        pa.array(sizes, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(alone, pa.int64()),
                        pa.ListArray.from_arrays(offsets, flat),
                    ],
                    ["doc_id", "n", "key", "alone", "prefix"],
                )

    n = cluster_partitions(docs.sparkSession)
    texts = written(text_batches(docs, {"doc_id": "long"}), "shingle-texts")
    counts = written(_counts(texts, k, slices_for(texts, n), n), "shingle-counts")
    of_batch = counts.groupBy("bid").agg(F.collect_list(F.struct("slice", "counts")).alias("counts"))
    out = written(texts.join(of_batch, "bid", "left").mapInArrow(run, "doc_id long, n long, key binary, alone long, prefix array<long>"), "shingle-sets")
    delete_table(texts)
    delete_table(counts)
    return out


def _only_sets(docs: DataFrame, k: int) -> DataFrame:
    """Rows (rep, text, key) whose text has the set named by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            same = [_set_key(s) == key for s, key in zip(shingle_sets(batch.column("text"), k), batch.column("key").to_pylist(), strict=True)]
            yield batch.filter(pa.array(same, pa.bool_())).select(["rep", "text"])

    return docs.mapInArrow(run, "rep long, text string")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) with whether they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                sets: dict[int, np.ndarray] = {}
                spread: dict[int, np.ndarray] = {}
                for ids, col in (("a", "text_a"), ("b", "text_b")):
                    names = part.column(ids).to_numpy(zero_copy_only=False)
                    _, first = np.unique(names, return_index=True)
                    for i, s in zip(names[first].tolist(), shingle_sets(part.column(col).take(pa.array(first)), k), strict=True):
                        sets[i] = s
                        spread[i] = np.bincount((s >> np.uint64(59)).astype(np.int64), minlength=PARTS)
                link = []
                for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
                    x, y = sets[a], sets[b]
                    # least overlap of two sets of these sizes
                    least = -(-percent * (len(x) + len(y)) // (100 + percent))
                    # suffix filter: what differs in the parts of the hash range differs in the sets
                    if int(np.abs(spread[a] - spread[b]).sum()) > len(x) + len(y) - 2 * least:
                        link.append(False)
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    link.append(100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(link, pa.bool_())], ["a", "b", "link"])

    left = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    full = left.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, link boolean")


def _length_ok(x: str, y: str, percent: int):
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def _least(x: str, y: str, percent: int):
    return F.ceil((F.col(x) + F.col(y)) * percent / (100 + percent))


def _can_link(x: str, y: str, percent: int):
    """Whether two sets can be alike by their sizes and by the shingles that neither shares with any document."""
    n = F.col(f"{x}n") + F.col(f"{y}n")
    most = F.least(F.col(f"{x}n") - F.col(f"{x}u"), F.col(f"{y}n") - F.col(f"{y}u"))
    return (most * 100 >= (n - most) * percent) & _length_ok(f"{x}n", f"{y}n", percent)


def class_links(classes: DataFrame, texts_of: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (u, v) between set classes (rep, their number; doc_id of one row; n, key, prefix) that yield their components."""
    # a set of which too much is its own is like no other
    hopeful = classes.filter((F.col("n") - F.col("alone")) * 100 >= F.col("n") * percent)
    postings = hopeful.select("rep", "n", F.col("alone").alias("u"), F.posexplode("prefix").alias("pos", "shingle")).filter("pos >= u")
    # the first round: every document of a bucket with its pivot
    buckets = (
        postings.groupBy("shingle")
        .agg(F.min(F.struct("pos", "rep", "n", "u")).alias("pivot"), F.count(F.lit(1)).alias("docs"))
        .filter("docs > 1")
        .select("shingle", "docs", F.col("pivot.rep").alias("pivot"), F.col("pivot.n").alias("pn"), F.col("pivot.u").alias("pu"), F.col("pivot.pos").alias("pivot_pos"))
    )
    shared = written(postings.join(buckets, "shingle"), "postings")
    room = F.least("pos", "pivot_pos") + F.least(F.col("n") - F.col("pos"), F.col("pn") - F.col("pivot_pos"))
    stars = (
        shared.filter("rep <> pivot")
        .filter(_can_link("", "p", percent) & (room >= _least("n", "pn", percent)))
        .select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
        .distinct()
    )
    wanted = shared.select("rep").distinct().join(classes.select("rep", "doc_id", "key"), "rep")
    found = texts_of.join(wanted, "doc_id")
    texts = written(_only_sets(found, k).dropDuplicates(["rep"]), "candidate-texts")
    tried = written(_verified(stars, texts, k, percent), "tried-pairs")
    links = tried.filter("link").select(F.col("a").alias("u"), F.col("b").alias("v"))
    # the second round: pairs of a bucket whose components still differ
    comp = components(links)
    labelled = shared.join(comp, shared["rep"] == comp["node"], "left").select(
        "shingle", "rep", "n", "u", "pos", "docs", "pivot", F.coalesce("component", "rep").alias("comp")
    )
    of_pivot = F.max(F.when(F.col("rep") == F.col("pivot"), F.col("comp")))
    open_ = labelled.groupBy("shingle").agg(of_pivot.alias("main"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("docs").alias("d"))
    open_ = open_.filter("lo <> hi and d > 2").select("shingle", "main")
    rows = written(labelled.join(open_, "shingle"), "open-postings")
    x = rows.filter("comp <> main").select("shingle", F.col("rep").alias("x"), F.col("n").alias("xn"), F.col("u").alias("xu"), F.col("pos").alias("xp"), F.col("comp").alias("xc"))
    y = rows.select("shingle", F.col("rep").alias("y"), F.col("n").alias("yn"), F.col("u").alias("yu"), F.col("pos").alias("yp"), F.col("comp").alias("yc"), (F.col("comp") == F.col("main")).alias("ym"))
    met = x.join(y, "shingle").filter(
        (F.col("xc") != F.col("yc"))
        & (F.col("ym") | (F.col("x") < F.col("y")))
        & _can_link("x", "y", percent)
        # the first shingle that two such sets share stands this early in both
        & (F.col("xp") + _least("xn", "yn", percent) <= F.col("xn"))
        & (F.col("yp") + _least("xn", "yn", percent) <= F.col("yn"))
    )
    flip = F.col("x") < F.col("y")
    a = F.when(flip, F.struct(F.col("x").alias("d"), F.col("xn").alias("n"), F.col("xp").alias("p"))).otherwise(F.struct(F.col("y").alias("d"), F.col("yn").alias("n"), F.col("yp").alias("p")))
    b = F.when(flip, F.struct(F.col("y").alias("d"), F.col("yn").alias("n"), F.col("yp").alias("p"))).otherwise(F.struct(F.col("x").alias("d"), F.col("xn").alias("n"), F.col("xp").alias("p")))
    # positional filter: all that a pair shares stands behind the first shingle that it shares
    pairs = (
        met.select(a.alias("a"), b.alias("b"))
        .groupBy(F.col("a.d").alias("a"), F.col("b.d").alias("b"), F.col("a.n").alias("an"), F.col("b.n").alias("bn"))
        .agg(F.min("a.p").alias("ap"), F.min("b.p").alias("bp"))
        .filter(F.least(F.col("an") - F.col("ap"), F.col("bn") - F.col("bp")) >= _least("an", "bn", percent))
        .select("a", "b")
        .join(tried.select("a", "b"), ["a", "b"], "left_anti")
    )
    more = written(_verified(pairs, texts, k, percent), "second-pairs").filter("link").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return comp.select(F.col("node").alias("u"), F.col("component").alias("v")).filter("u <> v").union(more)


def linked_documents(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row: documents link at Jaccard similarity percent / 100 or more."""
    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    sets = _sets(slim, k, percent)
    usable = sets.filter("doc_id is not null and n > 0")
    classes = usable.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.min("alone").alias("alone"), F.first("prefix").alias("prefix"))
    # an identifier can be the least of several classes; their numbers are fixed once written
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "set-classes")
    edges = class_links(classes, slim.filter("doc_id is not null"), k, percent)
    members = usable.select("doc_id", "key").join(classes.select("key", "rep"), "key")
    # an identifier with several texts ties their classes together
    several = members.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("doc_id", "lo")
    ties = members.join(several, "doc_id").filter("rep <> lo").select(F.col("rep").alias("u"), F.col("lo").alias("v")).distinct()
    comp = written(components(edges.union(ties)), "components")
    # a component is named by its smallest identifier
    named = classes.select("rep", "doc_id").join(comp, F.col("rep") == F.col("node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    own = named.select("rep", "component").join(least, "component").select(F.col("rep").alias("node"), "least")
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    out = rows.join(classes.select("key", "rep", F.col("doc_id").alias("first")), "key", "left").join(own, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "first", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs but for those whose component has a smaller identifier; rows without an identifier stay."""
    linked = linked_documents(docs, k, percent)
    gone = linked.filter("doc_id <> component_id").select(F.col("doc_id").alias("__fq_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__fq_gone"], "left_anti")
