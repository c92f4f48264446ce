"""Near-duplicate classes by DartMinHash, banded joining and exact checks.

1. Equal texts are one node, named by the text's MD5. A node's elements are its shingles of
   ``SHINGLE`` words (a shorter text is one shingle), weighted 1 or by their number.
2. A DartMinHash signature of ``BANDS * ROWS`` coordinates gives ``BANDS`` keys; nodes that share a
   key are candidates.
3. No bucket is expanded into all pairs. A bucket's pivot is its most central node, the one that
   meets most others over all its buckets; each member is checked against the pivot, exactly, by
   its shingles. Checked links form components. A pivot's checks are dealt out in shares of about
   ``SHARE`` members, each with a copy of the pivot's shingles.
4. Where a bucket has several components, members that are not in its largest one get further
   checks: against every member of another component in buckets of at most ``SMALL`` nodes, and in
   larger ones against ``SALTS`` more pivots, the most central nodes of as many random shares of the
   bucket. New links merge components.
5. Where a larger bucket still has several components, each member outside its largest one meets
   that whole component, and the other members outside it in the bucket. Both sides are dealt into
   blocks of about ``BLOCK`` shingles and a task checks two blocks; no pair is a row. So every two
   members of a bucket have been compared, or are in one component.
6. A class is a component; its id is its smallest doc_id.

Similarity is the Jaccard index of shingles (of their numbers, if weighted by number); links need
``SIMILARITY`` or more.

Defined cases: null text is empty; texts without words have no shingles and link to nothing but
equal texts; null ids never become class ids unless a class has no other; rows that repeat are in
one class; nodes as central as each other rank by their MD5; an empty table gives no rows; a long text
is read whole, in one task, and its shingles are one row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaudit.llm import dart
from lexaudit.llm.common import arrow_map, by_size, cut, trim

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6
SMALL = 48
SALTS = 12
SHARE = 256
BLOCK = 200_000
FEW = 100_000


def shingles(text: str, n: int = SHINGLE, counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of word shingles, and their weights."""
    words = text.encode().split()  # at ASCII white space, as WORD has it
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    base = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    m = max(1, len(words) - n + 1)
    h = np.zeros(m, np.uint64)
    for i in range(min(n, len(words))):
        h = dart.mix(h * np.uint64(0x100000001B3) + base[i : i + m])
    keys, times = np.unique(h, return_counts=True)
    return keys, times.astype(np.float64) if counted else np.ones(len(keys))


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) int64 keys of a signature's bands."""
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            h = dart.mix(h ^ sig[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def sketches(docs: DataFrame, counted: bool = False) -> DataFrame:
    """Per row: doc_id, node, its number of shingles, and its band keys (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text", 500_000):
                texts = batch.column("text").to_pylist()
                nodes = [hashlib.md5(t.encode()).digest() for t in texts]
                sets = [shingles(t, counted=counted) for t in texts]
                n = np.fromiter((len(s[0]) for s in sets), np.int64, len(sets))
                own = np.repeat(np.arange(len(sets)), n)
                sig = dart.signatures(own, np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), len(sets), BANDS * ROWS)
                keys = band_keys(sig)
                listed = pa.array([k if m else None for k, m in zip(keys, n.tolist(), strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(n), listed], ["doc_id", "node", "n", "keys"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return arrow_map(picked, run, "doc_id long, node binary, n long, keys array<long>")


def _node_shingles(docs: DataFrame, nodes: DataFrame, counted: bool) -> DataFrame:
    """Shingles of the named nodes (``node``): node, hashes, weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text", 250_000):
                sets = [shingles(t, counted=counted) for t in batch.column("text").to_pylist()]
                hashes = pa.array([s[0].tobytes() for s in sets], pa.binary())
                weights = pa.array([s[1].astype(np.float32).tobytes() if counted else b"" for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node"), hashes, weights], ["node", "hashes", "weights"])

    named = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.unhex(F.md5("text")))
    wanted = named.join(nodes.select(F.col("node").alias("w")), F.col("node") == F.col("w"), "left_semi")
    texts = wanted.groupBy("node").agg(F.first("text").alias("text"))
    return arrow_map(texts, run, "node binary, hashes binary, weights binary")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(a[1]) and not len(b[1]):  # unweighted
        both = len(common)
        return both / max(1, len(a[0]) + len(b[0]) - both)
    low = np.minimum(a[1][i], b[1][j]).sum()
    return float(low / max(1e-300, a[1].sum() + b[1].sum() - low))


def few(df: DataFrame, rows: int) -> DataFrame:
    """A table of narrow rows, ``rows`` of them at most, in no more partitions than they need (``FEW`` rows each).

    Each task leaves its figures in the driver, and shuffles of small tables have as many tasks as those of large ones."""
    return df.coalesce(max(1, -(-rows // FEW)))


def _checked(pairs: DataFrame, known: DataFrame, least: float, rows: int, share: int = SHARE) -> DataFrame:
    """Those of the pairs (a, b) that are similar enough. Any ``b`` may be in many pairs: it is copied to shares of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(n).to_pylist() for n in ("ah", "aw", "bh", "bw")}
            keep = []
            for ah, aw, bh, bw in zip(*col.values(), strict=True):
                a = np.frombuffer(ah, np.uint64), np.frombuffer(aw, np.float32).astype(np.float64)
                b = np.frombuffer(bh, np.uint64), np.frombuffer(bw, np.float32).astype(np.float64)
                keep.append(similarity(a, b) >= least - 1e-12)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    pairs = cut(pairs)
    shares = cut(few(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("shares")), rows))
    copies = known.join(shares, F.col("node") == F.col("b")).select(F.col("node").alias("bn"), F.col("hashes").alias("bh"), F.col("weights").alias("bw"), "shares", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("turn"))
    one = known.select(F.col("node").alias("an"), F.col("hashes").alias("ah"), F.col("weights").alias("aw"))
    most = shares.filter("shares > 1").select(F.col("b").alias("many"), "shares")  # one a hub
    dealt = pairs.join(most, F.col("b") == F.col("many"), "left").withColumn("at", F.pmod(F.xxhash64("a"), F.coalesce("shares", F.lit(1))).cast("int")).select("a", "b", "at")
    joined = dealt.join(one, F.col("a") == F.col("an")).join(copies.drop("shares"), (F.col("b") == F.col("bn")) & (F.col("at") == F.col("turn"))).select("a", "b", "ah", "aw", "bh", "bw")
    return arrow_map(joined, run, "a binary, b binary")


def block_links(a: list[tuple], b: list[tuple], least: float) -> list[tuple[bytes, bytes]]:
    """Links between nodes (node, label, hashes, weights) of ``a`` and of ``b`` that join different labels, as far as they join anything new."""
    n = np.fromiter((len(x[2]) for x in b), np.int64, len(b))
    some = np.flatnonzero(n)  # nodes without shingles are in no bucket
    if not len(some):
        return []
    b, n = [b[i] for i in some], n[some]
    starts = np.cumsum(n) - n
    distinct, at = np.unique(np.concatenate([x[2] for x in b]), return_inverse=True)
    counted = bool(len(b[0][3]))
    weight = np.concatenate([x[3] for x in b]) if counted else None
    sums = np.add.reduceat(weight, starts) if counted else n.astype(np.float64)
    of_label: dict[bytes, int] = {}
    bl = np.fromiter((of_label.setdefault(x[1], len(of_label)) for x in b), np.int64, len(b))
    labels = [of_label.setdefault(x[1], len(of_label)) for x in a]
    own = np.arange(len(of_label))  # the group of each label
    mark = np.zeros(len(distinct))
    out = []
    for x, label in zip(a, labels, strict=True):
        total = float(x[3].sum()) if counted else float(len(x[2]))
        apart = own[bl] != own[label]
        apart &= np.minimum(sums, total) >= (least - 1e-9) * np.maximum(sums, total)
        if not apart.any():
            continue
        spot = np.minimum(np.searchsorted(distinct, x[2]), len(distinct) - 1)
        hit = distinct[spot] == x[2]
        mark[spot[hit]] = x[3][hit] if counted else 1.0
        low = np.add.reduceat(np.minimum(mark[at], weight) if counted else mark[at], starts)
        mark[spot] = 0.0
        for i in np.flatnonzero(apart & (low >= (least - 1e-12) * (sums + total - low))):
            if own[bl[i]] != own[label]:
                own[own == own[bl[i]]] = own[label]
                out.append((x[0], b[i][0]))
    return out


def _met(sides: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between members of different labels that meet in a task. ``sides``: task (three columns t, i, j), blk, node, label."""
    ready = sides.join(known.select(F.col("node").alias("kn"), "hashes", "weights"), F.col("node") == F.col("kn")).select("t", "i", "j", "blk", "node", "label", "hashes", "weights")

    def met(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in ("blk", "node", "label", "hashes", "weights")}
        nodes = [(n, lab, np.frombuffer(h, np.uint64), np.frombuffer(w, np.float32).astype(np.float64)) for n, lab, h, w in zip(*list(cols.values())[1:], strict=True)]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        one = [x for x, k in zip(nodes, cols["blk"], strict=True) if k == i]
        two = [x for x, k in zip(nodes, cols["blk"], strict=True) if k == j]
        links = block_links(one, two, least)
        return pa.table({"a": pa.array([x[0] for x in links], pa.binary()), "b": pa.array([x[1] for x in links], pa.binary())})

    def run(table: pa.Table) -> pa.Table:
        links = met(table)
        trim()
        return links

    return ready.groupBy("t", "i", "j").applyInArrow(run, "a binary, b binary")


def _blocked(apart: DataFrame, whole: DataFrame, known: DataFrame, least: float, block: int) -> DataFrame:
    """Links (a, b) between members of different labels in a bucket. ``apart``: key, node, n, label, of buckets of
    several labels; ``whole``: node, n, label, of all nodes that are in a bucket.

    A member outside its bucket's largest label, the main one, meets all nodes of that label, and the bucket's other
    members outside it. Members of the main label don't meet each other."""
    per = apart.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    main = cut(per.groupBy(F.col("key").alias("mk")).agg(F.max_by("label", F.struct("c", "label")).alias("main")))
    outside = cut(apart.join(main, F.col("key") == F.col("mk")).filter(F.col("label") != F.col("main")).select("key", "node", "n", "label", "main"))

    # against the main labels
    asked = outside.select("main", "node", "n", "label").distinct()
    p = asked.groupBy(F.col("main").alias("m")).agg(F.ceil(F.sum("n") / block).cast("int").alias("p"))
    q = whole.join(p, F.col("label") == F.col("m"), "left_semi").groupBy(F.col("label").alias("ql")).agg(F.ceil(F.sum("n") / block).cast("int").alias("q"))
    plan = cut(p.join(q, F.col("m") == F.col("ql")).select("m", "p", "q"))
    # blocks 0 to p - 1 are those that ask, p to p + q - 1 the main label's
    row = F.pmod(F.xxhash64("node", "m"), F.col("p")).cast("int")
    column = (F.col("p") + F.pmod(F.xxhash64("node", "m"), F.col("q"))).cast("int")
    one = asked.join(plan, F.col("main") == F.col("m")).select("m", "node", "label", row.alias("i"), F.explode(F.sequence(F.col("p"), F.col("p") + F.col("q") - 1)).alias("j"))
    two = whole.join(plan, F.col("label") == F.col("m")).select("m", "node", "label", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"), column.alias("j"))
    sides = one.select(F.col("m").alias("t"), "i", "j", F.col("i").alias("blk"), "node", "label").unionByName(two.select(F.col("m").alias("t"), "i", "j", F.col("j").alias("blk"), "node", "label"))
    links = _met(sides, known, least)

    # among themselves, by bucket
    sums = outside.groupBy(F.col("key").alias("sk")).agg(F.ceil(F.sum("n") / block).cast("int").alias("p"), F.count_distinct("label").alias("labels"))
    sums = cut(sums.filter("labels > 1").select("sk", "p"))
    dealt = outside.join(sums, F.col("key") == F.col("sk")).withColumn("blk", F.pmod(F.xxhash64("node", "key"), F.col("p")).cast("int"))
    met = dealt.select(F.col("key").cast("string").cast("binary").alias("t"), "node", "label", "blk", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("o"))
    met = met.select("t", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "node", "label")
    return links.unionByName(_met(met, known, least))


def components(links: DataFrame, rows: int, seeds: DataFrame | None = None) -> DataFrame:
    """Smallest node of each node's component: (node, label), for nodes with links (or in ``seeds``), ``rows`` of them at most.

    Each round takes the least label among neighbours, then the label that this one had, and is cut off
    from its past in the shared folder; it ends when a round changes nothing. Labels only fall, so it ends."""
    ways = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(few(links.filter(F.col("a") != F.col("b")).select(F.explode(ways).alias("way")).select("way.a", "way.b").distinct(), 2 * rows))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    if seeds is not None:
        labels = seeds.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
    labels = cut(few(labels, rows))
    while True:
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("least"))
        near = labels.join(seen, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        up = labels.select(F.col("node").alias("u"), F.col("label").alias("ul"))
        jumped = near.join(up, F.col("label") == F.col("u"), "left").select("node", "old", F.least("label", "ul").alias("label"))
        jumped = cut(few(jumped, rows))
        changed = not jumped.filter(F.col("label") != F.col("old")).isEmpty()
        labels = jumped.select("node", "label")
        if not changed:
            return labels


def near_classes(docs: DataFrame, least: float = SIMILARITY, counted: bool = False, small: int = SMALL, salts: int = SALTS, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, class_id, node, label.

    The label, a component's smallest node, names the class; different classes can share a class_id,
    where ids repeat or are null."""
    rows = cut(sketches(docs, counted))
    n_rows = rows.count()
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    member = nodes.select("node", "n", F.explode("keys").alias("key"))
    n_keys = BANDS * n_rows // 2  # buckets of two or more, at most
    shared = cut(few(member.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), n_keys))
    members = cut(member.join(shared, F.col("key") == F.col("k")).select("key", "node", "n", "size"))
    degree = members.groupBy(F.col("node").alias("d")).agg(F.sum("size").alias("degree"))
    ranked = members.join(degree, F.col("node") == F.col("d")).select("key", "node", "n", "size", F.struct(F.col("degree"), F.col("node")).alias("rank"))
    ranked = cut(ranked)

    def close(a: str, b: str):
        """Sizes alone allow the similarity (unweighted sets only)."""
        return F.lit(True) if counted else F.least(a, b) >= F.lit(least - 1e-9) * F.greatest(a, b)

    # what a bucket's members are joined to is cut off first: then the planner can split a hot bucket
    pivots = cut(few(ranked.groupBy(F.col("key").alias("k")).agg(F.max("rank").alias("p"), F.max_by("n", "rank").alias("pn")), n_keys))
    star = ranked.join(pivots, F.col("key") == F.col("k")).filter((F.col("node") != F.col("p.node")) & close("n", "pn"))
    first = star.select(F.col("node").alias("a"), F.col("p.node").alias("b")).distinct()
    known = cut(_node_shingles(docs, members.select("node").distinct(), counted))
    links = cut(_checked(first, known, least, n_rows))
    labels = components(links, n_rows)

    labelled = ranked.join(labels.select(F.col("node").alias("ln"), "label"), F.col("node") == F.col("ln"), "left").select(
        "key", "node", "n", "size", "rank", F.coalesce("label", "node").alias("label")
    )
    labelled = cut(labelled)
    mixed = cut(few(_mixed(labelled), n_keys))
    apart = cut(labelled.join(mixed, F.col("key") == F.col("mk"), "left_semi"))
    a = apart.select("key", F.col("node").alias("a"), F.col("n").alias("an"), F.col("label").alias("al"), "size")
    b = apart.filter(F.col("size") <= small).select(F.col("key").alias("bk"), F.col("node").alias("b"), F.col("n").alias("bn"), F.col("label").alias("bl"))
    in_small = a.filter(F.col("size") <= small).join(b, (F.col("key") == F.col("bk")) & (F.col("al") != F.col("bl")) & (F.col("a") < F.col("b")) & close("an", "bn"))
    large = apart.filter(F.col("size") > small).withColumn("salt", F.pmod(F.xxhash64("node", "key"), F.lit(salts)))
    per = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    main = cut(few(per.groupBy(F.col("key").alias("mk")).agg(F.max_by("label", F.struct("c", "label")).alias("main")), n_keys))
    more = large.groupBy(F.col("key").alias("bk"), "salt").agg(F.max("rank").alias("p"), F.max_by("n", "rank").alias("bn"), F.max_by("label", "rank").alias("bl"))
    more = cut(more.select("bk", F.col("p.node").alias("b"), "bn", "bl"))
    outside = a.filter(F.col("size") > small).join(main, F.col("key") == F.col("mk")).filter(F.col("al") != F.col("main"))
    in_large = outside.join(more, (F.col("key") == F.col("bk")) & (F.col("al") != F.col("bl")) & close("an", "bn"))
    second = in_small.select("a", "b").union(in_large.select("a", "b")).distinct()
    more_links = cut(_checked(second, known, least, n_rows))
    labels = components(links.union(more_links), n_rows, labels)

    at = large.select("key", "node", "n").join(labels.select(F.col("node").alias("ln"), "label"), F.col("node") == F.col("ln"), "left")
    at = cut(at.select("key", "node", "n", F.coalesce("label", "node").alias("label")))
    mixed = cut(few(_mixed(at), n_keys))
    if not mixed.isEmpty():
        whole = nodes.select("node", "n").join(members.select(F.col("node").alias("w")).distinct(), F.col("node") == F.col("w"), "left_semi")
        whole = whole.join(labels.select(F.col("node").alias("ln"), "label"), F.col("node") == F.col("ln"), "left").select("node", "n", F.coalesce("label", "node").alias("label"))
        rest = cut(_blocked(at.join(mixed, F.col("key") == F.col("mk"), "left_semi"), cut(whole), known, least, block))
        if not rest.isEmpty():
            labels = components(links.union(more_links).union(rest), n_rows, labels)

    placed = nodes.select("node", "doc").join(labels.select(F.col("node").alias("ln"), "label"), F.col("node") == F.col("ln"), "left").select(
        "node", "doc", F.coalesce("label", "node").alias("label")
    )
    placed = cut(few(placed, n_rows))
    firsts = cut(few(placed.groupBy(F.col("label").alias("fl")).agg(F.min("doc").alias("class_id")), n_rows))
    classes = cut(placed.join(firsts, F.col("label") == F.col("fl")).select(F.col("node").alias("cn"), "class_id", "label"))
    return rows.select("doc_id", "node").join(classes, F.col("node") == F.col("cn")).select("doc_id", "class_id", "node", "label")


def _mixed(labelled: DataFrame) -> DataFrame:
    """Buckets of several labels: mk."""
    return labelled.groupBy(F.col("key").alias("mk")).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("mk")
