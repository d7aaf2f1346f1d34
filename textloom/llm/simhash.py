"""SimHash near-dedup with a pigeonring filter.

Fingerprints of 64 bits come from word shingles.  Two fingerprints link at
``max_bits`` (0 to 2) or fewer differing bits.  The fingerprint is a ring of
``SEGMENTS`` segments; by the pigeonring principle a linked pair has a segment
from which every chain of consecutive segments keeps its cumulative difference
within ``chain * max_bits / SEGMENTS``.  The longest chain whose budget is
below one bit must be equal, and is the key under which fingerprints meet; the
longer chains then prune pairs before the full Hamming check.

Only distinct fingerprints are compared.  A key that more than ``HOT`` of them
share is not paired: there each fingerprint visits the points one bit away
outside the equal chain, and two fingerprints within two bits meet at a point,
so the work stays linear and exact.  Components come from links by hooking and
pointer jumping over written tables.

Null and empty texts have fingerprint zero, which links like any other.  Rows
that repeat a doc_id each get a row.  A null doc_id is never a component's id,
unless it holds no other.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C

SEGMENTS, HOT, SEED = 16, 64, 42
WIDTH = 64 // SEGMENTS
LINKS = "a long, b long"
#: Of similar_rows: band keys, and least hashes in each; members, and hubs, that are compared at once; shingles counted at once; hubs of a key in each round.
BANDS, ROWS, FAN, COLUMNS = 20, 4, 512, 4096
HUBS = (16, 256)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Unsigned 64 bits; a bit is set if it is in over half the shingles' hashes."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    data, n = b" ".join(words), max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[-n:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            ids, texts = C.columns(batch, "doc_id", "text")
            fps = np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps)], names=["doc_id", "fp"])

    return C.mapped(C.texts_of(docs), run, "doc_id long, fp long")


def _rotated(x: np.ndarray, segment: int) -> np.ndarray:
    """The ring read from the given segment: it comes lowest."""
    r = np.uint64(segment * WIDTH)
    return (x >> r) | (x << (np.uint64(64) - r)) if segment else x


def _equal_chain(max_bits: int) -> int:
    return max(chain for chain in range(1, SEGMENTS + 1) if chain * max_bits // SEGMENTS == 0)


def _keys(max_bits):
    size = np.uint64(_equal_chain(max_bits) * WIDTH)
    low = np.uint64(C.MASK >> (64 - int(size)))
    turns = 1 if max_bits == 0 else SEGMENTS

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for s in range(turns):
                keys = _rotated(fps, s) & low
                if size < 60:
                    keys |= np.uint64(s) << np.uint64(60)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0)], names=["key", "fp"])

    return run


def _links(a, b):
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    return pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["a", "b"])


def _pairs(max_bits):
    """Links among the few fingerprints of each key: chains first, then the Hamming distance."""
    chains = [(chain, chain * max_bits // SEGMENTS) for chain in range(_equal_chain(max_bits) + 1, SEGMENTS)]

    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        keys, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((fps, keys))
        keys, fps = keys[order], fps[order]
        left = np.arange(len(keys))
        for step in range(1, len(keys)):
            left = left[left + step < len(keys)]
            left = left[keys[left] == keys[left + step]]
            if not len(left):
                break
            a, b = fps[left], fps[left + step]
            x = (a ^ b).view(np.uint64)
            turn = (keys[left].view(np.uint64) >> np.uint64(60)).astype(np.uint64) * np.uint64(WIDTH)
            ring = (x >> turn) | (x << ((np.uint64(64) - turn) % np.uint64(64)))
            ok = np.ones(len(left), bool)
            for chain, budget in chains:
                ok &= np.bitwise_count(ring & np.uint64(C.MASK >> (64 - chain * WIDTH))) <= budget
            ok &= np.bitwise_count(x) <= max_bits
            if ok.any():
                yield _links(a[ok], b[ok])

    return run


def _points(max_bits):
    """Each fingerprint of a hot key at itself and one bit off outside the equal chain."""
    size = _equal_chain(max_bits) * WIDTH

    def run(batches):
        for batch in batches:
            keys, fps = (c.to_numpy().view(np.uint64) for c in batch.columns)
            turn = (keys >> np.uint64(60)) * np.uint64(WIDTH)
            salt = C.mixed(keys)
            for bit in range(size - 1, 64):
                flip = np.zeros(len(fps), np.uint64) if bit < size else np.uint64(1) << ((np.uint64(bit) + turn) % np.uint64(64))
                yield pa.RecordBatch.from_arrays([pa.array((C.mixed(fps ^ flip) ^ salt).view(np.int64)), pa.array(fps.view(np.int64))], names=["key", "fp"])

    return run


def _stars(max_bits):
    """Fingerprints that meet at a point are linked with the least of them."""

    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        points, fps = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((fps, points))
        points, fps = points[order], fps[order]
        new = np.concatenate(([True], points[1:] != points[:-1]))
        centre = fps[np.flatnonzero(new)][np.cumsum(new) - 1]
        ok = (centre != fps) & (np.bitwise_count((centre ^ fps).view(np.uint64)) <= max_bits)
        if ok.any():
            yield _links(centre[ok], fps[ok])

    return run


def linked(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp``, enough to connect all that are within max_bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    n = C.buckets(fps)
    keys = fps.select("fp").mapInArrow(_keys(max_bits), "key long, fp long")
    hot = keys.groupBy("key").count().where(F.col("count") > HOT).select("key")
    cold = keys.join(hot, "key", "left_anti").repartition(n, "key").mapInArrow(_pairs(max_bits), LINKS)
    points = keys.join(hot, "key", "left_semi").mapInArrow(_points(max_bits), "key long, fp long")
    return cold.unionAll(points.repartition(n, "key").mapInArrow(_stars(max_bits), LINKS)).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and its component's least node, for each node of the links; rounds grow as the log of a component's reach."""
    both = C.written(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = C.written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        near = near.unionAll(labels).groupBy("node").agg(F.min("label").alias("label"))
        up = near.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        old = labels.withColumnRenamed("label", "old")
        new = C.written(near.join(up, "label").join(old, "node").select("node", F.least("label", "upper").alias("label"), "old"), "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of docs."""
    prints = C.written(fingerprints(docs, shingle), "fingerprints")
    distinct = C.written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = components(linked(distinct, max_bits)).withColumnRenamed("node", "fp")
    rooted = distinct.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _shingles(h: np.ndarray, shingle: int) -> np.ndarray:
    """The set of a text's shingle hashes, from its word hashes."""
    return np.unique(C.Rolling(h)(min(shingle, len(h)))) if len(h) else h


def _sketched(shingle, print_shingle):
    salts = C.mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))

    def least(sets):
        """Band keys of some sets that are not empty."""
        grams, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
        starts = np.cumsum(sizes) - sizes
        found = np.stack([np.minimum.reduceat((grams ^ s) * np.uint64(C.MULT), starts) for s in salts], 1).reshape(len(sets), BANDS, ROWS)
        h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS)).copy()
        for row in range(ROWS):
            h = C.mixed(h * np.uint64(C.MULT) + found[:, :, row])
        return h.view(np.int64).tolist()

    def run(batches):
        cache = C.WordHashes()
        for batch in batches:
            nodes, keys, waiting, size = [], [], [], 0
            texts = batch.column(1).to_pylist()
            fps = np.array([fingerprint(t, print_shingle) for t in texts], np.uint64).view(np.int64)
            for i, h in enumerate(C.hashed_words((t.lower() if t else t for t in texts), cache)):
                grams = _shingles(h, shingle)
                nodes.append(xxhash.xxh64_intdigest(grams.tobytes()) if len(grams) else 0)
                keys.append([0])
                if len(grams):
                    waiting.append((i, grams))
                    size += len(grams)
                if waiting and (size >= 1 << 16 or i + 1 == batch.num_rows):
                    for (j, _), own in zip(waiting, least([g for _, g in waiting]), strict=True):
                        keys[j] = own
                    waiting, size = [], 0
            if waiting:
                for (j, _), own in zip(waiting, least([g for _, g in waiting]), strict=True):
                    keys[j] = own
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(fps), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "node", "fp", "keys"])

    return run


def _compared(shingle, similarity):
    """Links of each hub, which comes first, with the members behind it that are similar on their whole sets."""

    def run(batches):
        cache, a, hub = C.WordHashes(), None, None
        for batch in batches:
            found = []
            for own, member, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (h,) = C.hashed_words([text.lower() if text else text], cache)
                grams = _shingles(h, shingle)
                if not member:
                    a, hub = own, grams
                elif a == own and min(len(grams), len(hub)) >= similarity * max(len(grams), len(hub)) - 1e-6:
                    both = len(np.intersect1d(grams, hub, assume_unique=True))
                    if both / (len(grams) + len(hub) - both) >= similarity:
                        found.append((a, node))
            if found:
                yield _links(*np.array(found, np.int64).T)

    return run


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) that are similar; texts: node and text.  A hub's members are dealt FAN at a time, each part with the hub's text."""
    n = C.buckets(texts)
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("fan"))
    dealt = pairs.join(size, "a").select("a", F.pmod(F.xxhash64("b"), "fan").alias("part"), "b")
    members = dealt.join(texts, dealt["b"] == texts["node"]).select("a", "part", F.lit(True).alias("member"), "node", "text")
    parts = size.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fan") - 1)).alias("part"))
    hubs = parts.join(texts, parts["a"] == texts["node"]).select("a", "part", F.lit(False).alias("member"), "node", "text")
    placed = hubs.unionAll(members).repartition(n, "a", "part").sortWithinPartitions("a", "part", "member")
    return C.mapped(placed.select("a", "member", "node", "text"), _compared(shingle, similarity), LINKS)


def _alike(hubs: list, members: list, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of each hub and member whose sets are similar: shared shingles of all pairs by products of matrices, some columns at a time."""
    sets = hubs + members
    sizes = np.array([len(s) for s in sets])
    _, which, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(sets)), sizes), often[which] > 1
    which, owner = (np.cumsum(often > 1) - 1)[which[shared]], owner[shared]
    order = np.argsort(which, kind="stable")
    which, owner = which[order], owner[order]
    n, both = int((often > 1).sum()), np.zeros((len(hubs), len(members)))
    for at in range(0, n, COLUMNS):
        a, b = np.searchsorted(which, (at, at + COLUMNS))
        held = np.zeros((len(sets), min(COLUMNS, n - at)), np.float32)
        held[owner[a:b], which[a:b] - at] = 1
        both += held[: len(hubs)] @ held[len(hubs) :].T
    return np.nonzero(both / np.maximum(sizes[: len(hubs), None] + sizes[None, len(hubs) :] - both, 1) >= similarity)


def _blocks(shingle, similarity):
    """A link for each two labels that similar nodes of a block's hubs and members have."""

    def found(rows, cache):
        grams = {}
        for *_, node, _, text in rows:
            if node not in grams:
                (h,) = C.hashed_words([text.lower() if text else text], cache)
                grams[node] = _shingles(h, shingle)
        sides = [[(r[2], r[3]) for r in rows if r[side]] for side in (0, 1)]
        if not all(sides):
            return None
        left, right = _alike(*([grams[node] for node, _ in side] for side in sides), similarity)
        (a, la), (b, lb) = (np.array(side, np.int64)[at].T for side, at in zip(sides, (left, right), strict=True))
        own = np.flatnonzero(la != lb)
        own = own[np.unique(np.stack([la[own], lb[own]]), axis=1, return_index=True)[1]]
        return _links(a[own], b[own]) if len(own) else None

    def run(batches):
        cache, block, rows = C.WordHashes(), None, []
        for batch in batches:
            for *of, hub, member, node, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != block and rows:
                    if (links := found(rows, cache)) is not None:
                        yield links
                    rows = []
                block = of
                rows.append((hub, member, node, label, text))
        if rows and (links := found(rows, cache)) is not None:
            yield links

    return run


def _placed(members: DataFrame, most: int) -> DataFrame:
    """key, i, j, hub, member, node and label: a key's hubs and members dealt FAN at a time, each part of hubs beside each part of members.

    Hubs are all nodes of keys of at most ``most``, about so many of the others, by a hash that is the same in each key.
    """
    hub = (F.col("size") <= most) | (F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / most)) == 0)
    marked = members.withColumns({"hub": hub, "part": F.xxhash64("node", F.lit("part")), "columns": F.ceil(F.col("size") / FAN)})
    marked = marked.join(marked.groupBy("key").agg(F.ceil(F.count_if("hub") / FAN).alias("rows")), "key").where("rows > 0")
    whole = "rows = 1 AND columns = 1"  # one block: a node that is hub and member goes there once
    member = f"transform(sequence(0, rows - 1), i -> struct(i AS i, pmod(part, columns) AS j, hub AND {whole} AS hub, true AS member))"
    other = f"if(hub AND NOT ({whole}), transform(sequence(0, columns - 1), j -> struct(pmod(part, rows) AS i, j AS j, true AS hub, false AS member)), array())"
    return marked.select("key", F.expr(f"explode(concat({member}, {other}))").alias("at"), "node", "label").select("key", "at.*", "node", "label")


def _compared_blocks(members: DataFrame, most: int, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links of hubs and members of a key that are similar; a text goes to a block once, however many it is compared with."""
    placed = _placed(members, most).join(texts, "node").repartition(C.buckets(texts), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return C.mapped(placed.select("key", "i", "j", "hub", "member", "node", "label", "text"), _blocks(shingle, similarity), LINKS).distinct()


def _print_links(sketches: DataFrame, max_bits: int) -> DataFrame:
    """Links among nodes whose fingerprints the pigeonring filter finds within max_bits; each fingerprint stands by its least node."""
    prints = sketches.select("node", "fp").distinct()
    least = C.written(prints.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("nodes")), "distinct")
    same = prints.join(least.where("nodes > 1"), "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    of = lambda side, name: least.select(F.col("fp").alias(side), F.col("least").alias(name))
    near = linked(least, max_bits).join(of("a", "x"), "a").join(of("b", "y"), "b")
    return same.unionAll(near.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, label and the key's number of nodes, of keys whose nodes are not all in one component yet."""
    named = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    sizes = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"))
    return C.written(named.join(sizes.where("lo < hi").select("key", "size"), "key"), "mixed")


def similar_rows(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, print_shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text) and root, equal in rows of one group, for each row of docs.

    First SimHash: fingerprints of ``print_shingle`` words, as in near_duplicates,
    link at max_bits or fewer differing bits, found by the pigeonring filter.
    Pairs at the similarity differ in more bits than an equal chain can index,
    so links by whole sets of ``shingle`` words are added to those.  Rows of equal
    shingle sets are one node.  BANDS keys of ROWS least shingle hashes find
    candidates (a pair at the limit of 0.8 shares one with probability 0.99997);
    whole shingle sets decide each link.  Keys whose nodes the fingerprints have
    made one component are done.  In the others each node is compared with one
    hub of its keys; then only keys whose nodes are not yet one component go on,
    with more hubs a round, until each key is one component or all its nodes
    were hubs.  So large groups of copies cost a comparison or two a node, small
    keys are compared in full, and no task ever holds a group; nodes of a key
    meet in blocks, where each text is read once.  Null and empty texts are one
    node, with fingerprint zero.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_hash"))
    sketches = C.written(C.mapped(texts, _sketched(shingle, print_shingle), "doc_id long, text_hash long, node long, fp long, keys array<long>"), "sketches")
    links = C.written(_print_links(sketches, max_bits), "links")
    labels = components(links)
    keys = sketches.select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("key")
    members = _mixed(C.written(keys.join(shared, "key").distinct(), "members"), labels)
    met = members.select("node").distinct()
    one = sketches.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).join(met, "node").select(F.col("r.doc_id").alias("i"), F.col("r.text_hash").alias("h"), "node")
    same = texts["doc_id"].eqNullSafe(one["i"]) & (texts["text_hash"] == one["h"])
    candidates = C.written(texts.join(one, same).select("node", "text").dropDuplicates(["node"]), "candidates")

    hub = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node"), F.col("node").alias("hub"), F.col("label").alias("own"))).alias("hub"))
    first = members.join(hub, "key").where("hub.own <> label").groupBy("node").agg(F.min("hub").alias("hub")).select(F.col("hub.hub").alias("a"), F.col("node").alias("b"))
    links = C.written(links.unionAll(_verified(C.written(first, "pairs"), candidates, shingle, similarity)), "links")
    members = members.select("key", "node")
    turn = 0
    while True:
        labels = components(links)
        members = _mixed(members, labels)
        if members.isEmpty():
            break
        most = HUBS[turn] if turn < len(HUBS) else HUBS[-1] * 16 ** (turn + 1 - len(HUBS))
        links = C.written(links.unionAll(_compared_blocks(members, most, candidates, shingle, similarity)), "links")
        members, turn = members.where(F.col("size") > max(2, most)).select("key", "node"), turn + 1
    return C.written(sketches.select("doc_id", "text_hash", "node").join(labels, "node", "left").select("doc_id", "text_hash", F.coalesce("label", "node").alias("root")), "groups")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id (least doc_id of its group) of documents that have a near copy; null doc_ids are in no group."""
    rows = similar_rows(docs.where("doc_id IS NOT NULL"), shingle, similarity)
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.max("doc_id").alias("z")).where("component_id < z").select("root", "component_id")
    return rows.join(least, "root").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
