"""Near-duplicates from bottom-k sketches of one hash function.

A document's set holds the hashes of its five-word shingles (words split at space and U+0009-U+000D,
A-Z folded); fewer words make one shingle of the whole sequence, no word an empty set. The k smallest
hashes are its sketch. Equal sets are collapsed to one representative first, so copies cost nothing.

Candidates come from inverted lists of the retained values. Two sets whose similarity reaches the
threshold share at least ``c`` retained values, so, with values ordered from rare to common, they meet
in the list of one of their first ``size - c + 1`` values: passages that many documents share are not
indexed. Short lists give all their pairs; in long lists every member is paired with the list's first
member, and links are found. Long lists with one first member form a crowd; only if members of a crowd then still
lie in different components do those outside its largest component meet the others, block by block, first by
sketches, then by full sets. The sketch of the union estimates each pair; what
stays well below the threshold goes; the exact Jaccard on full sets decides the rest. Components come from
alternating large and small stars.

With k = 64 a linked pair misses a candidate list or the estimate's margin with a probability below 1e-5;
sets of up to 48 shingles are handled exactly.

Edge cases: null, empty or wordless text has n_shingles 0 and stands alone; every row stands for its own text, so different
texts of one doc_id are linked apart (either may have another component_id) and ``keep_first`` drops rows, not ids; a
null doc_id stands alone (component_id null, kept true); further columns are ignored. A very long text takes 11 bytes of
memory a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import kernel, shared

WORDS = 5
SKETCH = 64
PERCENT = 75
SHORT_LIST = 16
#: Members and shingles of a block of a crowd; pairs that meet one first document in one group.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
GROUP = 128


def shingle_sets(piece: kernel.Piece, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of the piece."""
    starts, ends, owner = piece.words()
    hashes = piece.hashes(starts, ends, kernel.LOWER_KEYS)
    shingles, first = kernel.windows(hashes, owner, words)
    cut = np.searchsorted(owner[first] if len(first) else first, np.arange(piece.n + 1))
    at = np.searchsorted(owner, np.arange(piece.n + 1))
    out = []
    for i in range(piece.n):
        if cut[i + 1] > cut[i]:
            out.append(np.unique(shingles[cut[i] : cut[i + 1]]))
        elif at[i + 1] > at[i]:
            few = hashes[at[i] : at[i + 1]]
            out.append(kernel.mix(np.append(few * kernel.WINDOW_KEYS[: len(few)], kernel.WINDOW_KEYS[40 + len(few)]).sum(keepdims=True)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _tagged(documents: DataFrame) -> DataFrame:
    return shared.texts(documents).withColumn("tag", F.xxhash64("text"))


def sketches(documents: DataFrame, k: int = SKETCH) -> DataFrame:
    """doc_id, tag (hash of the text), n (set size), h1 and h2 (a 128-bit digest of the set), sketch (the k smallest hashes, as
    signed longs in unsigned order)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = kernel.WINDOW_KEYS[50]
        for b in batches:
            n, h1, h2, kept = [], [], [], []
            for p in kernel.pieces(b.column("text")):
                for s in shingle_sets(p):
                    n.append(len(s))
                    h1.append(kernel.mix(s ^ salt).sum(dtype=np.uint64))
                    h2.append(kernel.mix(s * salt).sum(dtype=np.uint64))
                    kept.append(s[:k].view(np.int64))
            as_long = lambda x: np.array(x, np.uint64).view(np.int64)
            flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in kept]))).astype(np.int32), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("tag"), pa.array(np.array(n, np.int64)), pa.array(as_long(h1)), pa.array(as_long(h2)), lists], ["doc_id", "tag", "n", "h1", "h2", "sketch"]
            )

    return _tagged(documents).mapInArrow(rows, "doc_id long, tag long, n long, h1 long, h2 long, sketch array<long>")


def _least_shared(n: F.Column, k: int, percent: int) -> F.Column:
    """How many retained values a set shares at least with any set it is linked with."""
    exact = k * percent // 100
    return F.when(n <= exact, F.ceil(n * percent / 100)).otherwise(F.lit(k // 2)).cast("long")


def inverted_lists(reps: DataFrame, k: int, percent: int) -> DataFrame:
    """value, rep, n, central (how many of 1000 retained values others share): the postings of the rarest retained
    values of each representative; values of one document are left out."""
    postings = reps.select("rep", "n", F.size("sketch").cast("long").alias("kept"), F.explode("sketch").alias("value"))
    frequent = shared.written(postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"))
    met = postings.join(frequent.hint("merge"), "value")
    ranked = met.groupBy("rep", "n", "kept").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"))  # at most k values
    room = F.col("kept") - _least_shared(F.col("n"), k, percent) + 1 - (F.col("kept") - F.size("values"))
    head = F.slice("values", F.lit(1), F.least(F.size("values"), room.cast("int")))
    central = (F.size("values") * 1000 / F.col("kept")).cast("int").alias("central")
    return ranked.where(room > 0).select("rep", "n", central, F.explode(head).alias("v")).select("v.value", "rep", "n", "central")


def _pairs(a: str, b: str) -> list[F.Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _meetings(lists: DataFrame) -> DataFrame:
    """The postings with their list's length and first member, the most central one (an original rather than one of its
    altered copies); lists of one member are left out."""
    sizes = shared.written(lists.groupBy("value").agg(F.count("*").alias("members"), F.min(F.struct(-F.col("central"), F.col("rep").alias("rep")))["rep"].alias("first")).where("members > 1"))
    return lists.join(sizes.hint("merge"), "value")


def short_pairs(met: DataFrame, short: int, percent: int) -> DataFrame:
    """All pairs of the lists with at most ``short`` members."""
    whole = met.where(F.col("members") <= short).groupBy("value").agg(F.collect_list(F.struct("rep", "n")).alias("m"))  # at most `short` members
    x, y = whole.select(F.posexplode("m").alias("i", "x"), "m"), F.expr("slice(m, i + 2, greatest(size(m) - i - 1, 0))")
    close = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    return x.select("x", F.explode(y).alias("y")).where((F.col("x.rep") != F.col("y.rep")) & close).select(*_pairs("x.rep", "y.rep"))


def _estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Similarity by the sketch of the union."""
    union = np.union1d(a, b)[:k]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)) / max(len(union), 1)


def likely(pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose estimate is not five standard errors below the threshold."""
    t = percent / 100
    floor = t - 5 * (t * (1 - t) / k) ** 0.5

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("sa", "sb"):
                c = batch.column(name)
                flat, cut = c.flatten().to_numpy().view(np.uint64), c.offsets.to_numpy() - c.offsets[0].as_py()
                sides.append((flat, cut))
            keep = [_estimate(sides[0][0][sides[0][1][i] : sides[0][1][i + 1]], sides[1][0][sides[1][1][i] : sides[1][1][i + 1]], k) >= floor for i in range(batch.num_rows)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    s = reps.select("rep", "n", "sketch")
    with_a = pairs.join(s.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")).hint("merge"), "a")
    both = with_a.join(s.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")).hint("merge"), "b")
    near = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return near.select("a", "b", "sa", "sb").mapInArrow(rows, "a long, b long")


def full_sets(documents: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep, items (the set's hashes as bytes, sorted) of the representatives named in a table of reps, one row each."""
    ids = shared.written(reps.select("rep", "doc_id", "tag").join(wanted.select("rep").hint("merge"), "rep"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for p in kernel.pieces(batch.column("text")) for s in shingle_sets(p)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(found, pa.binary())], ["rep", "items"])

    texts = shared.join_ids(_tagged(documents), ids, ["doc_id", "tag"], "inner").select("rep", "text")
    return texts.mapInArrow(sets, "rep long, items binary").groupBy("rep").agg(F.first("items").alias("items"))  # equal rows give equal sets


def verified(pairs: DataFrame, documents: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold: a, b, shared, total. The sets that meet ``a`` are dealt into groups of bounded
    size, each with one copy of a's own set; a task reads its groups in order and holds one set of an ``a`` at a time."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, at = None, None
        for batch in batches:
            a, b, both, total = [], [], [], []
            for x, part, y, items in zip(batch.column("a").to_pylist(), batch.column("part").to_pylist(), batch.column("b").to_pylist(), batch.column("items"), strict=True):
                s = np.frombuffer(items.as_buffer(), np.uint64)
                if y is None:
                    mine, at = s.copy(), (x, part)
                    continue
                assert at == (x, part)
                n = len(np.intersect1d(mine, s, assume_unique=True))
                if 100 * n >= percent * (len(mine) + len(s) - n):
                    a.append(x)
                    b.append(y)
                    both.append(n)
                    total.append(len(mine) + len(s) - n)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, both, total)], ["a", "b", "shared", "total"])

    full = shared.written(full_sets(documents, reps, pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()))
    sized = pairs.join(reps.select(F.col("rep").alias("b"), "n").hint("merge"), "b")
    loads = sized.groupBy("a").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    loads = shared.written(loads)
    dealt = pairs.join(loads.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    others = dealt.join(full.withColumnRenamed("rep", "b").hint("merge"), "b").select("a", "part", "b", "items")
    copies = loads.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    own = copies.join(full.withColumnRenamed("rep", "a").hint("merge"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "items")
    together = own.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return together.mapInArrow(compare, "a long, b long, shared long, total long")


def _stars(edges: DataFrame) -> bool:
    """Whether every x points to one y, and no y points on: then y is the smallest node of its component."""
    ends = edges.select(F.col("x").alias("k"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("y", F.lit(0), F.lit(1)))
    bad = ends.groupBy("k").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out = 1 and in = 1)")
    return not bad.head(1)


def components(links: DataFrame) -> DataFrame:
    """node, root: every linked node and the smallest node of its component. Large and small stars alternate until
    only stars are left."""
    edges = shared.written(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x <> y").distinct())
    while not _stars(edges):
        both = edges.union(edges.select("y", "x"))
        # written, so that the join below reads two plain shuffles and a node of very many links can be split
        least = shared.written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
        large = both.join(least.hint("merge"), "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low.hint("merge"), "x").select(F.explode(F.array(F.struct("x", "m"), F.struct(F.col("y").alias("x"), "m"))).alias("e")).select(F.col("e.x").alias("x"), F.col("e.m").alias("y")).where("x <> y").distinct()
        before, edges = edges, shared.written(small)
        shared.discard(before, least)
    return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))


def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """Roots after further links: only the components themselves are linked anew."""
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    between = more.join(named("a").hint("merge"), "a", "left").join(named("b").hint("merge"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    up = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(up.hint("merge"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return shared.written(moved.union(up.select(F.col("root").alias("node"), F.col("top").alias("root"))).distinct())


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of all intersections; values that only one set holds are left out, and columns are taken in chunks."""
    sizes = np.array([len(x) for x in (*left, *right)])
    _, column, held = np.unique(np.concatenate((*left, *right)), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    number = np.cumsum(held > 1) - 1
    use = held[column] > 1
    row, column = row[use], number[column[use]]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, chunk):
        here = (column >= at) & (column < at + chunk)
        m = np.zeros((len(sizes), chunk), np.float32)
        m[row[here], column[here] - at] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def across_components(crowds: DataFrame, reps: DataFrame, roots: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Further links inside crowds (all long lists with one first member) whose members lie in different components,
    or None if there is no such crowd. Members outside a crowd's largest component meet all its members, block by block,
    each pair of blocks in a task of its own; of the links found there, those that join components are returned."""
    with_root = crowds.join(roots.select(F.col("node").alias("rep"), "root").hint("merge"), "rep", "left").select("first", "rep", F.coalesce("root", "rep").alias("root"))
    rooted = shared.written(with_root.join(reps.select("rep", "n").hint("merge"), "rep"))
    by_root = rooted.groupBy("first", "root").agg(F.count("*").alias("c"), F.sum("n").alias("shingles"))
    main = F.max(F.struct("c", "root", "shingles"))
    by_crowd = by_root.groupBy("first").agg(F.count("*").alias("roots"), F.sum("c").alias("members"), F.sum("shingles").alias("shingles"), main.alias("main"))
    cut = lambda c, n: F.ceil(F.greatest(c / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    strays = cut(F.col("members") - F.col("main.c"), F.col("shingles") - F.col("main.shingles"))
    mixed = by_crowd.where("roots > 1").select("first", F.col("main.root").alias("main"), cut(F.col("members"), F.col("shingles")).alias("blocks"), strays.alias("stray_blocks"))
    mixed = shared.written(mixed)
    if not mixed.head(1):
        return None
    t = percent / 100
    floor = t - 5 * (t * (1 - t) / k) ** 0.5
    members = shared.written(rooted.join(mixed, "first"))
    sets = full_sets(documents, reps, members.select("rep").distinct())
    full = members.join(reps.select("rep", "sketch").hint("merge"), "rep").join(sets.hint("merge"), "rep")
    spot = F.xxhash64("rep")
    columns = ["first", "rep", "root", "n", "sketch", "items"]
    stray = full.where("root <> main").select(*columns, F.lit(True).alias("stray"), F.pmod(spot, "stray_blocks").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    every = full.select(*columns, F.lit(False).alias("stray"), F.explode(F.sequence(F.lit(0), F.col("stray_blocks") - 1)).alias("i"), F.pmod(spot, "blocks").cast("int").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        rep, root, n, stray = (table.column(c).to_numpy() for c in ("rep", "root", "n", "stray"))
        x, y = np.flatnonzero(stray), np.flatnonzero(~stray)
        a, b = [], []
        if len(x) and len(y):
            sketch = [np.asarray(v, np.int64).view(np.uint64) for v in table.column("sketch").to_pylist()]
            items = [np.frombuffer(v, np.uint64) for v in table.column("items").to_pylist()]
            kept = np.array([len(v) for v in sketch])
            overlap = _overlaps([sketch[i] for i in x], [sketch[i] for i in y])
            union = np.minimum(k, kept[x][:, None] + kept[y] - overlap)
            open_ = (root[x][:, None] != root[y]) & (overlap >= floor * union) & (np.minimum(n[x][:, None], n[y]) * 100 >= np.maximum(n[x][:, None], n[y]) * percent)
            live_x, live_y = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            if len(live_x):
                x, y, open_ = x[live_x], y[live_y], open_[np.ix_(live_x, live_y)]
                inner = np.rint(_overlaps([items[i] for i in x], [items[i] for i in y])).astype(np.int64)
                linked = open_ & (100 * inner >= percent * (n[x][:, None] + n[y] - inner))
                up: dict[int, int] = {}

                def find(v: int) -> int:
                    while up.get(v, v) != v:
                        up[v] = up.get(up[v], up[v])
                        v = up[v]
                    return v

                for p, q in np.argwhere(linked).tolist():
                    one, two = find(int(root[x[p]])), find(int(root[y[q]]))
                    if one != two:
                        up[one] = two
                        a.append(int(rep[x[p]]))
                        b.append(int(rep[y[q]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = stray.unionByName(every).groupBy("first", "i", "j").applyInArrow(compare, "a long, b long")
    return found.select(*_pairs("a", "b")).distinct()


def grouped(documents: DataFrame, k: int = SKETCH, percent: int = PERCENT, short: int = SHORT_LIST) -> DataFrame:
    """doc_id, tag, n of every row, with class_id (smallest doc_id of the same set) and first, the least (doc_id, tag) of its
    component; both null for a row that stands alone by having no words or no doc_id."""
    every = shared.written(sketches(documents, k))
    sets = every.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n")
    classes = sets.agg(F.min(F.struct("doc_id", "tag")).alias("at"), F.first("sketch").alias("sketch"))
    reps = shared.written(classes.select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "n", "at.doc_id", "at.tag", "sketch"))
    lists = shared.written(inverted_lists(reps, k, percent))
    met = _meetings(lists)
    crowds = shared.written(met.where(F.col("members") > short).select("first", "rep").distinct())
    stars = crowds.where("rep <> first").select(*_pairs("first", "rep"))
    likely_pairs = shared.written(likely(short_pairs(met, short, percent).union(stars).distinct(), reps, k, percent))
    links = shared.written(verified(likely_pairs, documents, reps, percent))
    roots = components(links)
    more = across_components(crowds, reps, roots, documents, k, percent)
    if more is not None:
        more = shared.written(more)
        if more.head(1):
            roots = joined(roots, more)
    linked = roots.union(roots.select("root", "root")).distinct()
    spots = shared.written(linked.join(reps.select(F.col("rep").alias("node"), F.struct("doc_id", "tag").alias("at")).hint("merge"), "node"))
    least = shared.written(spots.groupBy("root").agg(F.min("at").alias("first")))  # written, so that a large component can be split
    firsts = spots.join(least.hint("merge"), "root").select(F.col("node").alias("rep"), "first")
    own = F.struct("doc_id", "tag")
    known = reps.join(firsts.hint("merge"), "rep", "left").select("h1", "h2", "n", F.col("doc_id").alias("class_id"), F.coalesce("first", own).alias("first"))
    known = shared.written(known)
    shared.discard(reps, lists, crowds, likely_pairs, links, more, spots)
    slim = every.select("doc_id", "tag", "n", *(F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col(h)).alias(h) for h in ("h1", "h2")))
    return slim.join(known.hint("merge"), ["h1", "h2", "n"], "left").select("doc_id", "tag", "n", "class_id", "first")


def near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id (smallest doc_id with the same set)."""
    root = F.coalesce("first.doc_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept")
    return grouped(documents, **options).select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), kept, F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_first(documents: DataFrame, **options) -> DataFrame:
    """The documents with one row of each group left, that of the smallest doc_id (of several texts of that doc_id the one
    with the smallest hash, of equal texts the one whose columns sort first); all columns."""
    rows = shared.written(grouped(documents, **options).where("first is not null").select("doc_id", "tag", (F.struct("doc_id", "tag") == F.col("first")).alias("kept")))
    dropped = shared.written(rows.where("not kept").distinct().select("doc_id", "tag"))
    again = shared.written(rows.where("kept").groupBy("doc_id", "tag").count().where("count > 1").select("doc_id", "tag"))
    mine = documents.withColumns({"__loom_id": F.col("doc_id").cast("long"), "__loom_tag": F.xxhash64(F.col("text").cast("string"))})
    to = lambda ids: ids.withColumnsRenamed({"doc_id": "__loom_id", "tag": "__loom_tag"})
    left = shared.join_ids(mine, to(dropped), ["__loom_id", "__loom_tag"], "left_anti")
    if not again.head(1):
        return left.select(*documents.columns)
    single = shared.join_ids(left, to(again), ["__loom_id", "__loom_tag"], "left_anti").select(*documents.columns)
    first = shared.join_ids(left, to(again), ["__loom_id", "__loom_tag"], "left_semi").groupBy("__loom_id", "__loom_tag").agg(F.min(F.struct(*documents.columns)).alias("row"))
    return single.unionByName(first.select("row.*"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.read(spark, sf_dir, "documents"))


ORACLE_SQL = None
