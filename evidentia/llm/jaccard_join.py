"""N-gram Jaccard join with vertical partitioning.

The global order of n-grams (by hash) is cut into fragments. Every text's set is cut along with it, each fragment learns
alone which n-grams several sets share, and overlaps are counted per fragment and summed per pair. Equal sets
travel as one class. Three exact filters leave few pairs:
* a set links only if at least 80 % of its n-grams are shared with other classes at all;
* of the remaining ones, linked sets share one of their rarest n - ceil(0.8 n) + 1 n-grams;
* sizes must allow the similarity.
Each class is compared with one hub among those that share such a rare n-gram, and linked ones contract to components.
What still lies in different components is compared in blocks, again by fragments of the order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .grams import BITS, mixed, pack48, release, set_id, shingle_sets, unpack48
from .store import keep, partitions

PERCENT = 80
FLUSH = 1 << 20  # n-grams gathered by a task before they are handed out to fragments
PARTS = 8  # fragments in which overlaps are counted
BLOCK = 1024  # classes (and n-grams) of a block in the last comparison
MASS = 1 << 20  # n-grams of a block in the last comparison, on average

_SETS = pa.schema([("doc_id", pa.int64()), ("content", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.int64())])
_SENT = pa.schema([("frag", pa.int32()), ("ids", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("grams", pa.binary())])
_SENT_SQL = "frag int, ids binary, sizes binary, counts binary, grams binary"
_SHARED = _SENT.append(pa.field("held", pa.binary()))
_SHARED_SQL = _SENT_SQL + ", held binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, ids = [], []
        for s in shingle_sets(batch.column(1)):
            sizes.append(len(s))
            ids.append(set_id(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())], schema=_SETS)


def _rows(frags: np.ndarray, owner: np.ndarray, grams: np.ndarray, ids: np.ndarray, sizes: np.ndarray, held: np.ndarray | None = None) -> Iterator[dict]:
    """Rows of _SENT or _SHARED. frags is sorted, and so are owners within a fragment; owner indexes ids and sizes. Without
    n-grams there are no rows."""
    if not len(frags):
        return
    cuts = np.flatnonzero(np.append(True, frags[1:] != frags[:-1]))
    for a, b in zip(cuts, [*cuts[1:], len(frags)], strict=True):
        own = owner[a:b]
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        row = {
            "frag": int(frags[a]), "ids": ids[own[head]].tobytes(), "sizes": sizes[own[head]].astype("<i4").tobytes(),
            "counts": np.diff(np.append(head, b - a)).astype("<i4").tobytes(), "grams": pack48(grams[a:b]),
        }
        yield row if held is None else row | {"held": held[a:b].astype("<i4").tobytes()}


def send(sets: Iterable[tuple[int, np.ndarray]], fragments: int) -> Iterator[pa.RecordBatch]:
    """Rows of _SENT: (id, sorted distinct n-grams) pairs, cut along the global order and packed by fragment."""
    ids: list[int] = []
    held: list[np.ndarray] = []
    waiting = 0

    def out() -> pa.RecordBatch:
        sizes = np.array([len(s) for s in held], np.int32)
        grams, owner = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
        frags = (grams >> np.uint64(BITS - 32)) * np.uint64(fragments) >> np.uint64(32)
        order = np.argsort(frags, kind="stable")
        return pa.RecordBatch.from_pylist(list(_rows(frags[order], owner[order], grams[order], np.array(ids, np.int64), sizes)), schema=_SENT)

    for k, s in sets:
        held.append(s)
        ids.append(k)
        waiting += len(s)
        if waiting >= FLUSH:
            yield out()
            ids, held, waiting = [], [], 0
    if held:
        yield out()
    del held, ids
    release()


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """Set ids with their sets; copies within a task go once (it remembers an id for each of its documents)."""
    seen: set[int] = set()
    for batch in batches:
        for s in shingle_sets(batch.column(0)):
            if len(s) and (k := set_id(s)) not in seen:
                seen.add(k)
                yield k, s


def _unpacked(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """ids, sizes, counts, grams (and held) of all rows, one behind the other."""
    col = lambda c: table.column(c).to_pylist()
    join = lambda c, t: np.frombuffer(b"".join(col(c)), t)
    out = [join("ids", "<i8"), join("sizes", "<i4"), join("counts", "<i4"), unpack48(b"".join(col("grams")))]
    return (*out, join("held", "<i4")) if "held" in table.schema.names else tuple(out)


def _find_shared(table: pa.Table) -> pa.Table:
    """In one fragment: the n-grams that at least two classes hold, with the number of holders."""
    ids, sizes, counts, grams = _unpacked(table)
    _, first = np.unique(ids, return_index=True)  # a class sent by several tasks counts once
    wanted = np.zeros(len(ids), bool)
    wanted[first] = True
    owner = np.repeat(np.arange(len(ids)), counts)
    use = wanted[owner]
    owner, grams = owner[use], grams[use]
    order = np.argsort(grams, kind="stable")
    run = np.append(True, grams[order][1:] != grams[order][:-1])
    starts = np.flatnonzero(run)
    lengths = np.diff(np.append(starts, len(grams)))
    held = np.empty(len(grams), np.int64)
    held[order] = np.repeat(lengths, lengths)
    use = held > 1
    frag = np.full(int(use.sum()), table.column("frag")[0].as_py() if table.num_rows else 0)
    out = pa.Table.from_pylist(list(_rows(frag, owner[use], grams[use], ids, sizes, held[use])), schema=_SHARED)
    del ids, sizes, counts, grams, held, owner, order, run, use
    release()
    return out


_LISTS = pa.schema([("id", pa.int64()), ("size", pa.int32()), ("grams", pa.list_(pa.int64())), ("held", pa.list_(pa.int32()))])
_LISTS_SQL = "id long, size int, grams array<long>, held array<int>"


def _by_class(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A fragment's classes dealt out to buckets of classes, still packed: rows of _SHARED with the bucket in place of frag."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, sizes, counts, grams, held = _unpacked(batch.slice(i, 1))
            bucket = mixed(ids.view(np.uint64)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            starts = np.cumsum(counts) - counts
            at = np.repeat(starts[order], counts[order]) + np.arange(len(grams)) - np.repeat(np.cumsum(counts[order]) - counts[order], counts[order])
            own = np.repeat(order, counts[order])
            yield pa.RecordBatch.from_pylist(list(_rows(bucket[own], own, grams[at], ids, sizes, held[at])), schema=_SHARED)


def _class_lists(table: pa.Table, percent: int) -> pa.Table:
    """Of the classes of a bucket, with what all fragments found: those that share `percent` of their n-grams."""
    ids, sizes, counts, grams, held = _unpacked(table)
    values, inverse = np.unique(ids, return_inverse=True)
    total = np.bincount(inverse, counts, len(values)).astype(np.int64)
    size = np.zeros(len(values), np.int64)
    size[inverse] = sizes
    good = 100 * total >= percent * size
    owner = np.repeat(inverse, counts)
    order = np.argsort(owner, kind="stable")
    order = order[good[owner[order]]]
    at = pa.array(np.append(0, np.cumsum(total[good])).astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (grams[order].astype(np.int64), held[order].astype(np.int32))]
    del ids, sizes, counts, grams, held, owner, order
    release()
    return pa.Table.from_arrays([pa.array(values[good]), pa.array(size[good].astype(np.int32)), *lists], schema=_LISTS)


def shared_grams(docs: DataFrame, sets: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """Rows of _SHARED, written: what each id shares with another one, by fragment."""
    fragments = partitions(docs.sparkSession)
    return keep(docs.mapInArrow(lambda b: send(sets(b), fragments), _SENT_SQL).groupBy("frag").applyInArrow(_find_shared, _SHARED_SQL))


def shared_lists(shared: DataFrame, percent: int = 0) -> DataFrame:
    """(id, size, grams, held) with one row for each id that shares `percent` of its n-grams. Lists stay packed until a task has all
    of an id's, so rows do not grow with the fragments."""
    n = partitions(shared.sparkSession)
    return shared.mapInArrow(lambda b: _by_class(b, n), _SHARED_SQL).groupBy("frag").applyInArrow(lambda t: _class_lists(t, percent), _LISTS_SQL)


def gram_sets(keyed: DataFrame) -> DataFrame:
    """(doc_id, content, n_shingles, set_id) of rows (doc_id, text, content); set_id is null for a text without words."""
    return keyed.select("doc_id", "text", "content").mapInArrow(_sets, "doc_id long, content long, n_shingles long, set_id long")


def similar_classes(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Of the classes that may link at all: (id, size, weight, rarest, grams), written. grams are all their shared n-grams in
    the global order, rarest those of which linked classes have one in common, weight their mean number of holders."""
    lists = shared_lists(shared_grams(docs.select(F.col(text).alias("text")), _classes), percent)
    least = F.ceil(F.col("size").cast("long") * percent / 100).cast("int")  # of a set's n-grams that a linked set has to hold
    found = lists.select("id", "size", F.arrays_zip(F.col("held").alias("held"), F.col("grams").alias("gram")).alias("x"))
    ordered = found.select("id", "size", (F.size("x") - least + 1).alias("n"), F.array_sort("x").alias("x"))
    grams = F.transform("x", lambda e: e["gram"])
    weight = F.aggregate("x", F.lit(0.0), lambda a, e: a + e["held"]) / F.size("x")
    return keep(ordered.select("id", "size", weight.alias("weight"), F.slice(grams, F.lit(1), F.col("n")).alias("rarest"), F.array_sort(grams).alias("grams")))


def linked_pairs(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of pairs (a, size_a, b, size_b) that link: overlaps are counted per fragment and summed per pair."""

    def within(part: int) -> Column:
        return F.filter("grams", lambda g: F.shiftright(g, BITS - PARTS.bit_length() + 1) == part)

    parts = classes.select("id", F.posexplode(F.array(*[within(p) for p in range(PARTS)])).alias("part", "grams")).where(F.size("grams") > 0)
    left = parts.select(F.col("id").alias("a"), "part", F.col("grams").alias("ga"))
    right = parts.select(F.col("id").alias("b"), "part", F.col("grams").alias("gb"))
    both = pairs.join(left, "a").join(right, ["b", "part"])
    overlap = both.groupBy("a", "size_a", "b", "size_b").agg(F.sum(F.size(F.array_intersect("ga", "gb"))).alias("shared"))
    return overlap.where(100 * F.col("shared") >= percent * (F.col("size_a") + F.col("size_b") - F.col("shared")))


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    """Links that connect different components among the classes of one group (of one or two of its blocks)."""
    ids, sizes = table.column("id").to_numpy(), table.column("size").to_numpy().astype(np.int64)
    _, roots, many = np.unique(table.column("root").to_numpy(), return_inverse=True, return_counts=True)
    rows = np.flatnonzero(roots != np.argmax(many))  # the largest component's own pairs are connected already
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not len(rows):
        return none
    lists = table.column("grams").combine_chunks()
    values, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
    order = np.unique(values[np.isin(owner, rows)])  # n-grams that no row holds add to no overlap
    at = np.minimum(np.searchsorted(order, values), max(len(order) - 1, 0))
    use = order[at] == values
    values, owner = at[use], owner[use]
    overlap = np.zeros((len(rows), len(ids)), np.float32)
    for at in range(0, len(order), BLOCK):  # a fragment of the n-gram order at a time
        use = (values >= at) & (values < at + BLOCK)
        part = np.zeros((len(ids), BLOCK), np.float32)
        part[owner[use], values[use] - at] = 1
        overlap += part[rows] @ part.T
    union = sizes[rows][:, None] + sizes[None] - overlap
    linked = (100 * overlap >= percent * union) & (roots[rows][:, None] != roots[None])
    # Of all links only those that join what is apart so far leave, so rows grow with the classes and not with their pairs.
    left, right = [], []
    for k in np.flatnonzero(linked.any(1)):
        js = np.flatnonzero(linked[k])
        own = roots[rows[k]]
        for other, first in zip(*np.unique(roots[js], return_index=True), strict=True):
            if other != own:
                left.append(ids[rows[k]])
                right.append(ids[js[first]])
                roots[roots == other] = own
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def rest_links(apart: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between components among the classes (hub, id, root, n, mass) of each hub, n the number of its classes and mass
    that of their n-grams. They are compared in blocks: a task gets one pair of blocks, whatever the size of the group and
    the length of its texts, and only links come out."""
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("mass") / MASS)).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    spread = apart.select("hub", "id", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    full = spread.join(classes.select("id", "size", "grams"), "id")
    key = [F.col("hub").alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    return full.select(*key, "id", "size", "root", "grams").groupBy("g", "i", "j").applyInArrow(lambda t: _block_links(t, percent), "a long, b long")


def class_links(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links among classes that connect exactly what all links connect.

    Of the classes that hold a rare n-gram, the one whose n-grams are commonest (the likely original of near copies) is
    the hub. Each class is compared with the best hub it meets; then n-grams all of whose classes are connected are done. The
    classes of the others are gathered by the n-grams' hubs (two that share an n-gram share its hub) and compared across
    components, block by block.
    """
    members = classes.select("id", "size", "weight", F.explode("rarest").alias("gram"))
    hubs = keep(members.groupBy(F.col("gram").alias("g")).agg(F.max(F.struct("weight", "id", "size")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    fits = 100 * F.least("size", "hub.size") >= percent * F.greatest("size", "hub.size")
    offers = members.join(hubs, F.col("gram") == F.col("g")).where((F.col("id") != F.col("hub.id")) & fits)
    best = offers.groupBy("id", "size").agg(F.max("hub").alias("hub"))
    pairs = keep(best.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.col("hub.id").alias("b"), F.col("hub.size").alias("size_b")))
    found = keep(linked_pairs(pairs, classes, percent).select("a", "b"))
    roots = keep(components(found, "a", "b"))
    shared = members.join(hubs, F.col("gram") == F.col("g")).select("gram", "id", "size", F.col("hub.id").alias("hub"))
    rooted = keep(shared.join(roots, F.col("id") == F.col("node"), "left").select("gram", "hub", "id", "size", F.coalesce("root", "id").alias("root")))
    mixed = rooted.groupBy(F.col("gram").alias("g")).agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("g")
    apart = keep(rooted.join(keep(mixed), F.col("gram") == F.col("g"), "left_semi").select("hub", "id", "size", "root").distinct())
    sizes = keep(apart.groupBy(F.col("hub").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("long")).alias("mass")))
    apart = apart.join(sizes, F.col("hub") == F.col("h")).select("hub", "id", "root", "n", "mass")
    return found.union(keep(rest_links(apart, classes, percent)))


def _text_components(docs: DataFrame, doc_id: str, text: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, content, n_shingles, set_id; links between sets a, b). content tells texts of one doc_id apart."""
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("content"))
    return keep(gram_sets(keyed)), class_links(similar_classes(docs, text, percent), percent)


def _roots(rows: DataFrame, links: DataFrame, ties: DataFrame | None = None) -> DataFrame:
    """(id, root) of every set of rows, written."""
    roots = keep(components(links if ties is None else links.union(ties), "a", "b"))
    sets = rows.where("set_id IS NOT NULL").select(F.col("set_id").alias("id")).distinct()
    return keep(sets.join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root")))


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, set_id.

    Texts link when percent of their union of distinct 5-word shingles is shared; component_id is the least doc_id that
    links reach. Null, empty and blank texts have no shingles and link with nothing, each its own component; texts of
    one to four words are one shingle; rows that repeat a doc_id or a text fall into one component, and so does all that
    any of a doc_id's texts links with (a row without words stays by itself); an empty table gives no rows. A null doc_id
    has itself (null) as component only where its component has no other id. Other columns are ignored.
    """
    rows, links = _text_components(docs, doc_id, text, percent)
    sets = rows.select("doc_id", "n_shingles", "set_id")
    # A document whose rows have different texts connects them.
    named = sets.where("set_id IS NOT NULL AND doc_id IS NOT NULL")
    several = keep(named.groupBy(F.col("doc_id").alias("d")).agg(F.min("set_id").alias("a"), F.max("set_id").alias("z")).where("a <> z").select("d", "a"))
    ties = keep(named.join(several, F.col("doc_id") == F.col("d")).where("a <> set_id").select("a", F.col("set_id").alias("b")).distinct())
    roots = _roots(sets, links, ties)
    least = keep(named.groupBy(F.col("set_id").alias("s")).agg(F.min("doc_id").alias("least")))
    lowest = keep(roots.join(least, F.col("id") == F.col("s"), "left").groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id")))
    of_class = keep(roots.join(lowest, F.col("root") == F.col("r")).select("id", "component_id"))
    return sets.join(of_class, F.col("set_id") == F.col("id"), "left").select(
        "doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "set_id"
    )


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, content) of the rows that are copies: of texts that links connect, the row with the least doc_id stays (a row
    without id only where none has one; of one doc_id's texts the one with the least content). content is xxhash64 of the text.
    Unlike jaccard_join's components, a doc_id with different texts connects nothing, so no text is lost that links with none
    that stays. Texts without words are no copies."""
    rows, links = _text_components(docs, doc_id, text, percent)
    roots = _roots(rows, links)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")
    first = keep(rows.join(roots, F.col("set_id") == F.col("id")).groupBy("root").agg(F.min(key).alias("first")))
    own = keep(rows.join(roots, F.col("set_id") == F.col("id")).select("doc_id", "content", F.col("root").alias("r")))
    joined = own.join(first, F.col("r") == F.col("root"))
    return joined.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("content") == F.col("first.content")))).select("doc_id", "content").distinct()
