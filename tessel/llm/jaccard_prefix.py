"""Near copies by Jaccard similarity of word shingles: SimHash links first, then an exact completion, all verified on whole sets.

Sets: words as in simhash_pivot, shingles of ``shingle`` words, without repeats, by 64-bit hashes (fewer words: the whole sequence; none: the
empty set).  Equal sets are one node from the start.  Nodes are linked at a similarity of ``NUM / DEN`` or more.

First the pivot tables of simhash_pivot propose pairs by the sets' own SimHash.  No width of SimHash finds every pair of that similarity, so prefix
filtering completes them: two such sets share an element of their prefixes, the first n - ceil(n * NUM / DEN) + 1 elements in one order of all
elements; elements that are frequent in a sample of the rows come last in it, so common lines seldom are in a prefix (the sample decides about
speed only, never about results).  Sets are listed by the elements of their prefixes.  In a first round each is compared with one of the
list for its first ``PLACES`` elements and for one in ``OFTEN`` of those that are frequent; those and SimHash's pairs, verified, give components.  Lists that lie in one component need nothing more.  In
the others, pairs of different components that sizes and positions allow are discarded by the parities of the sets' elements in
classes (sets differ in as many elements as classes at least), first in few classes beside the lists, then in classes that grow with the
sets, and what is left is verified.  So a large group of near copies hands on few of its
pairs, whether they are similar or just too different.  Elements that are frequent in the sample are listed in parts from the start and every list over
``most`` sets is dealt out as pairs of its parts, so no list outgrows a task.  The result is exact up to collisions of the hashes.

Defined results: null and empty texts have the empty set and are copies of each other; doc_id may be null or repeated, with equal or different texts; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .simhash_pivot import pivot_links
from .util import HASH_P, LOWER, files, hold, map_arrow, materialize, min_label_components, mix64, n_parts, prefix_hash, release, slices, span_hash, text_buffer, word_spans

NUM, DEN = 4, 5
SAMPLE = 64
SHORT, LONG = 256, 1024
PLACES, OFTEN = 4, 8
SMALL = 200_000
SET = "doc_id long, mark long, fp long, sim long, n int, wide binary, parity binary, elements binary"


def shingle_sets(buf: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles, increasing and without repeats, and the rows' offsets."""
    buf = LOWER[buf]
    start, end, by_row = word_spans(buf, off)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    w = span_hash(prefix_hash(buf), start, end)
    words = np.diff(by_row)
    m = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(len(m)), m)
    at = by_row[row] + np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
    h = np.zeros(len(row), np.uint64)
    for k in range(shingle):
        h = np.where(at + k < by_row[row + 1], mix64(h * np.uint64(HASH_P) + w[np.minimum(at + k, len(w) - 1)]), h)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
    return h[new], np.searchsorted(row[new], np.arange(len(off)))


def simhashes(h: np.ndarray, row: np.ndarray, n: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """SimHash of each row's set, from the sets' own hashes."""
    ones = np.zeros((len(n), 64), np.int32)
    for i in range(0, len(h), block):
        r = row[i : i + block]
        bits = np.unpackbits(h[i : i + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        ones[r[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def parities(h: np.ndarray, row: np.ndarray, n: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """For each row the parity of its elements in classes, two to eight times as many as elements, and that folded to LONG classes at most."""
    wide = [b""] * len(n)
    at = np.cumsum(n) - n
    for size in sorted({classes(k) for k in n.tolist()}):
        mine = np.flatnonzero([classes(k) == size for k in n.tolist()])
        for i in range(0, len(mine), max(1, (1 << 22) // size)):
            some = mine[i : i + max(1, (1 << 22) // size)]
            own = np.concatenate([h[at[k] : at[k] + n[k]] for k in some.tolist()]) % np.uint64(size)
            odd = np.bincount(np.repeat(np.arange(len(some)), n[some]) * size + own.astype(np.int64), minlength=len(some) * size).astype(np.uint8) & 1
            for k, x in zip(some.tolist(), np.packbits(odd.reshape(len(some), size), axis=1), strict=True):
                wide[k] = x.tobytes()
    return wide, [x if len(x) <= LONG // 8 else fold([x], LONG // 8).tobytes() for x in wide]


def classes(n: int) -> int:
    """How many classes a set of n elements has."""
    size = SHORT
    while size < 2 * n:
        size *= 4
    return size


def fold(parity: list[bytes], size: int) -> np.ndarray:
    """Parities of one length of their own, in ``size`` bytes: class c of many is class c modulo few."""
    x = np.frombuffer(b"".join(parity), np.uint8).reshape(len(parity), -1, size)
    return np.bitwise_xor.reduce(x, axis=1).view(np.uint64)


def folded(parity: list[bytes]) -> np.ndarray:
    """Parities in SHORT classes, as words of 64 bits."""
    out = np.zeros((len(parity), SHORT // 64), np.uint64)
    sizes = np.array([len(p) for p in parity], np.int64)
    for size in set(sizes.tolist()):
        at = np.flatnonzero(sizes == size)
        out[at] = fold([parity[i] for i in at.tolist()], SHORT // 8)
    return out


def differ(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many classes each pair of parities differs, at least: in those of the shorter one."""
    d = np.zeros(len(x), np.int64)
    sizes = np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    for size in {tuple(k) for k in sizes.tolist()}:
        at = np.flatnonzero((sizes == size).all(axis=1))
        for i in range(0, len(at), max(1, (1 << 23) // max(size))):
            some = at[i : i + max(1, (1 << 23) // max(size))].tolist()
            d[some] = np.bitwise_count(fold([x[k] for k in some], min(size)) ^ fold([y[k] for k in some], min(size))).sum(axis=1, dtype=np.int64)
    return d


def rows_of(buf: np.ndarray, off: np.ndarray, shingle: int):
    """For blocks of rows: (first row, hashes, row of each, sizes, fp)."""
    for i, j in slices(off, 1 << 20, 1024):
        h, at = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], shingle)
        n = np.diff(at)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h + np.uint64(HASH_P)))])
        fp = np.where(n > 0, mix64((total[at[1:]] - total[at[:-1]]) ^ mix64(n.astype(np.uint64))), 0).astype(np.uint64)
        yield h, np.repeat(np.arange(len(n)), n), n, fp


def sets_of(docs: DataFrame, shingle: int, frequent: np.ndarray) -> DataFrame:
    """SET of every row of ``docs`` (doc_id, text): ``mark`` a hash of the text, ``fp`` one of the set, ``elements`` the prefix."""

    def run(batches):
        for b in batches:
            buf, off = text_buffer(b.column(2))
            out = [[], [], [], [], [], []]
            for h, row, n, fp in rows_of(buf, off, shingle):
                often = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h if len(frequent) else np.zeros(len(h), bool)
                head = h[np.lexsort((h, often, row))]
                at, take = np.cumsum(n) - n, np.where(n > 0, n + n * NUM // -DEN + 1, 0)
                found = (fp, simhashes(h, row, n), n, *parities(h, row, n), [head[a : a + k].tobytes() for a, k in zip(at.tolist(), take.tolist(), strict=True)])
                for o, x in zip(out, found, strict=True):
                    o.append(x)
            fp, sim, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out[:3])
            binary = [pa.array([y for x in o for y in x], pa.binary()) for o in out[3:]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64)), pa.array(sim.view(np.int64)), pa.array(n.astype(np.int32)), *binary], names=[x.split()[0] for x in SET.split(", ")])

    return map_arrow(marked(docs), run, SET)


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): ``mark`` is a hash of the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark_of("text").alias("mark"), "text")


def mark_of(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def often_in(docs: DataFrame, shingle: int, at_least: int = 4, limit: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
    """Elements that ``at_least`` of a sample of the rows have, increasing, and how many have them; the ``limit`` most frequent."""

    def run(batches):
        for b in batches:
            for h, _, _, _ in rows_of(*text_buffer(b.column(0)), shingle):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["element"])

    few = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)) == 0).select("text")
    got = map_arrow(few, run, "element long").groupBy("element").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= at_least)
    got = got.orderBy(F.col("c").desc(), "element").limit(limit).toArrow()
    e, c = np.asarray(got["element"], np.int64).view(np.uint64), np.asarray(got["c"], np.int64)
    order = np.argsort(e)
    return e[order], c[order]


def shared_lists(nodes: DataFrame, frequent: np.ndarray, counts: np.ndarray, most: int, parts: int) -> DataFrame:
    """(element, fp, n, place, part, low, often): the lists of two sets or more; ``low`` is the part's first set by fp ^ element, so each list has one of its own; ``part`` holds about ``most`` sets at most."""
    salts = np.maximum(1, counts * SAMPLE // most)

    def listed(batches):
        for b in batches:
            sets = b.column(2).to_pylist()
            k = np.array([len(x) // 8 for x in sets], np.int64)
            e = np.frombuffer(b"".join(sets), np.uint64)
            fp, n = np.repeat(np.asarray(b.column(0)), k), np.repeat(np.asarray(b.column(1)), k)
            place = np.arange(len(e)) - np.repeat(np.cumsum(k) - k, k)
            at = np.minimum(np.searchsorted(frequent, e), max(0, len(frequent) - 1))
            many = np.where(frequent[at] == e, salts[at], 0) if len(frequent) else np.zeros(len(e), np.int64)  # 0: not frequent
            salt = (mix64(fp.view(np.uint64)) % np.maximum(many, 1).astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), pa.array(salt), pa.array(many.astype(np.int32)), pa.array(fp ^ e.view(np.int64)), pa.array(n), pa.array(place.astype(np.int32))], names=["element", "salt", "salts", "turn", "n", "place"])

    def shared(batches):
        """Streams sorted rows; of a list only its first row and its length so far are kept."""
        names = ["element", "fp", "n", "place", "part", "low", "often"]
        key, first, seen, held = None, None, 0, None
        for b in batches:
            e, salt, salts_, fp, n, place = (np.asarray(b.column(k)) for k in range(6))
            fp = fp ^ e
            if not len(e):
                continue
            starts = np.flatnonzero(np.concatenate([[True], (e[1:] != e[:-1]) | (salt[1:] != salt[:-1])]))
            ends = np.concatenate([starts[1:], [len(e)]])
            goes_on = key == (e[0], salt[0])
            length = ends - starts
            low, before = fp[starts].copy(), np.zeros(len(starts), np.int64)
            if goes_on:
                low[0], before[0] = first, seen
            keep = (length + before > 1) | (salts_[starts] > 1)
            keep[-1] |= True  # the next batch may go on with it
            held_now = length[-1] + before[-1] == 1 and salts_[starts[-1]] <= 1
            group = np.repeat(np.arange(len(starts)), length)
            number = np.arange(len(e)) - starts[group] + before[group]
            part = salt + np.maximum(salts_, 1) * (number // most).astype(np.int32)
            out = pa.RecordBatch.from_arrays([pa.array(x) for x in (e, fp, n, place, part.astype(np.int32), low[group], salts_ > 0)], names=names)
            if held is not None and goes_on:
                yield held
            mask = keep[group]
            held = None
            if held_now:
                held = out.slice(len(e) - 1, 1)
                mask[-1] = False
            yield out.filter(pa.array(mask))
            key, first, seen = (e[-1], salt[-1]), low[-1], int(length[-1] + before[-1])

    rows = map_arrow(nodes.select("fp", "n", "elements"), listed, "element long, salt int, salts int, turn long, n int, place int")
    return map_arrow(rows.repartition(parts, "element", "salt").sortWithinPartitions("element", "salt", "turn"), shared, "element long, fp long, n int, place int, part int, low long, often boolean")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """Those of ``pairs`` (a, b) of sets that are similar, by whole sets, which are made again from the texts."""

    def whole(batches):
        for b in batches:
            fps, sets = [], []
            for h, _, n, fp in rows_of(*text_buffer(b.column(0)), shingle):
                end = np.cumsum(n)
                fps.append(fp)
                sets += [h[e - k : e].tobytes() for e, k in zip(end.tolist(), n.tolist(), strict=True)]
            fp = np.concatenate(fps) if fps else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(sets, pa.binary())], names=["fp", "elements"])

    def verify(batches):
        for t in batches:
            both = [(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(t.column(2), t.column(3), strict=True)]
            ok = pa.array([len(np.intersect1d(x, y, True)) * (NUM + DEN) >= NUM * (len(x) + len(y)) for x, y in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column(0).filter(ok), t.column(1).filter(ok)], names=["a", "b"])

    wanted = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    where = hold(nodes.join(wanted, "fp", "left_semi").select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")))
    texts = among(marked(docs), where).select("text")
    sets = hold(map_arrow(texts, whole, "fp long, elements binary").dropDuplicates(["fp"]))
    one, two = (sets.select(F.col("fp").alias(k), F.col("elements").alias(f"elements_{k}")) for k in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "elements_a", "elements_b")
    links = materialize(map_arrow(both, verify, "a long, b long").repartition(files(pairs.count())))
    sets.unpersist()
    where.unpersist()
    release(pairs)
    return links


def among(rows: DataFrame, where: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` (doc_id, mark and more) whose id and mark ``where`` (_d, _m) has, or lacks; up to SMALL of those are broadcast, so that no text is shuffled."""
    where = F.broadcast(where) if where.count() <= SMALL else where
    return rows.join(where, rows["doc_id"].eqNullSafe(where["_d"]) & (rows["mark"] == where["_m"]), how)


def first_pairs(nodes: DataFrame, lists: DataFrame, reach: int) -> DataFrame:
    """(a, b) proposed by SimHash and by each list's first set, without those that sizes or parities rule out."""
    sims = hold(nodes.groupBy("sim").agg(F.min("fp").alias("rep"), F.count(F.lit(1)).alias("c")))
    links = pivot_links(sims.select(F.col("sim").alias("fp"), "rep"), sims.count(), reach)
    same = nodes.join(sims.where("c > 1"), "sim").select(F.col("rep").alias("a"), F.col("fp").alias("b"))
    star = lists.where((F.col("place") < PLACES) | F.col("often") & (F.pmod(F.xxhash64("element"), F.lit(OFTEN)) == 0)).select("element", "low", "fp")
    dealt = lists.groupBy("element").agg(F.max("part").alias("p"), F.min("low").alias("least")).where("p > 0").select("element", "least")  # lists in parts have one set for all as well
    across = star.join(dealt, "element").select(F.col("least").alias("a"), F.explode(F.array("low", "fp")).alias("b"))
    pairs = links.union(same).union(star.select(F.col("low").alias("a"), F.col("fp").alias("b"))).union(across).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    out = allowed(pairs, nodes, lists.count())
    links.unpersist()
    sims.unpersist()
    return out


def allowed(pairs: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that sizes and the sets' widest parities allow."""
    one, two = (nodes.select(F.col("fp").alias(k), F.col("n").alias(f"n_{k}"), F.col("wide").alias(f"wide_{k}")) for k in "ab")

    def may(batches):
        for t in batches:
            n = np.asarray(t.column(2)).astype(np.int64) + np.asarray(t.column(3))
            ok = pa.array((NUM + DEN) * differ(t.column(4).to_pylist(), t.column(5).to_pylist()) <= (DEN - NUM) * n)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(ok), t.column(1).filter(ok)], names=["a", "b"])

    met = pairs.join(one, "a").join(two, "b").where(DEN * F.least("n_a", "n_b") >= NUM * F.greatest("n_a", "n_b"))
    return materialize(map_arrow(met.select("a", "b", "n_a", "n_b", "wide_a", "wide_b"), may, "a long, b long").repartition(files(rows)))


def other_pairs(nodes: DataFrame, lists: DataFrame, label: DataFrame, parts: int) -> DataFrame:
    """(a, b) of one list and of different components that sizes, positions and parities allow."""
    told = lists.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    told = hold(told.select("element", "fp", "n", "place", "part", "label"))
    mixed = told.groupBy("element").agg((F.max("part") + 1).alias("r"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("element", "r")
    rows = told.join(mixed, "element").join(nodes.select("fp", "parity"), "fp")
    r, mine = F.col("r").cast("long"), F.col("part").cast("long")
    keys = F.transform(F.sequence(F.lit(0).cast("long"), r - 1), lambda j: F.xxhash64("element", F.least(mine, j), F.greatest(mine, j)))
    dealt = rows.select(F.explode(keys).alias("cell"), "element", "fp", "n", "place", "label", "parity")

    def pair(batches):
        kept, tail = None, []
        for b in batches:
            t, parity = [np.asarray(b.column(k)) for k in range(6)], b.column(6).to_pylist()
            if kept is not None:
                t, parity = [np.concatenate(x) for x in zip(kept, t, strict=True)], tail + parity
            if not len(t[0]):
                continue
            cut = np.flatnonzero(np.concatenate([[True], (t[0][1:] != t[0][:-1]) | (t[1][1:] != t[1][:-1])]))
            kept, tail = [x[cut[-1] :] for x in t], parity[cut[-1] :]
            found = [p for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) for p in pairs_of([x[s:e] for x in t[2:]], parity[s:e])]
            yield from once(found)
        if kept is not None:
            for p in pairs_of(kept[2:], tail):
                yield from once([p])

    out = map_arrow(dealt.repartition(parts, "cell").sortWithinPartitions("cell", "element"), pair, "a long, b long").distinct()
    out = allowed(out, nodes, told.count())
    told.unpersist()
    return out


def once(found: list[np.ndarray]):
    if found:
        p = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])


def pairs_of(t: list[np.ndarray], parity: list[bytes], block: int = 512):
    """Pairs (smaller, greater) of one list that differ in component and that sizes, positions and parities allow.  t: fp, n, place, label."""
    fp, n, place, label = t
    if len(fp) < 2 or label.min() == label.max():
        return
    n, place, short = n.astype(np.int64), place.astype(np.int64), folded(parity)
    for i in range(0, len(fp), block):
        a = slice(i, i + block)
        ok = (label[a, None] != label[None, i:]) & ((NUM + DEN) * np.minimum((n - place)[a, None], (n - place)[None, i:]) >= NUM * (n[a, None] + n[None, i:]))
        ok &= np.arange(i, min(i + block, len(fp)))[:, None] < np.arange(i, len(fp))[None, :]
        x, y = np.nonzero(ok)
        x, y = x + i, y + i
        for s in range(0, len(x), 1 << 18):
            u, v = x[s : s + (1 << 18)], y[s : s + (1 << 18)]
            most = (DEN - NUM) * (n[u] + n[v])
            near = (NUM + DEN) * np.bitwise_count(short[u] ^ short[v]).sum(axis=1, dtype=np.int64) <= most
            u, v, most = u[near], v[near], most[near]
            if len(u):
                near = (NUM + DEN) * differ([parity[k] for k in u.tolist()], [parity[k] for k in v.tolist()]) <= most
                u, v = u[near], v[near]
            if len(u):
                yield np.stack([np.minimum(fp[u], fp[v]), np.maximum(fp[u], fp[v])], axis=1)


def near_duplicates(docs: DataFrame, shingle: int = 5, reach: int = 2, most: int = 2048) -> DataFrame:
    """doc_id, mark (a hash of the text), fp, component_id and stays for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id of the component, null if none has one; ``stays`` marks the rows of the component's first (doc_id, fp, mark), nulls
    last: one text of each component.
    """
    parts = n_parts(docs)
    frequent, counts = often_in(docs, shingle)
    found = hold(sets_of(docs, shingle, frequent))
    nodes = hold(found.groupBy("fp").agg(F.min_by(F.struct("doc_id", "mark", "n", "sim", "wide", "parity", "elements"), F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("s")).select("fp", "s.*"))
    prints = materialize(found.select("doc_id", "mark", "fp").repartition(files(found.count())))
    found.unpersist()
    lists = hold(shared_lists(nodes, frequent, counts, most, parts))
    links = verified(first_pairs(nodes, lists, reach), nodes, docs, shingle)
    label = min_label_components(links)
    more = verified(other_pairs(nodes, lists, label, parts), nodes, docs, shingle)
    if not more.isEmpty():
        label = min_label_components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    told = prints.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    first = told.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "fp", "mark")).alias("first"))
    told = told.join(first, "label")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("fp") == F.col("first.fp")) & (F.col("mark") == F.col("first.mark"))
    out = materialize(told.select("doc_id", "mark", "fp", F.col("first.doc_id").alias("component_id"), stays.alias("stays")).repartition(files(prints.count())))
    for df in (nodes, lists):
        df.unpersist()
    return out


def first_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay by ``groups`` (near_duplicates of them), once each: of rows equal in id and text the least by their other columns.

    Few rows go, so it is those that are looked up; up to SMALL of them no text is shuffled.
    """
    keys = groups.groupBy(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")).agg(F.bool_or("stays").alias("_stays"), (F.count(F.lit(1)) > 1).alias("_often"))
    named = hold(keys.where("not _stays or _often"))
    own_mark = "mark" in docs.columns
    known = (docs.withColumnRenamed("mark", "_own_mark") if own_mark else docs).withColumn("mark", mark_of("text"))
    own = lambda c: F.col("_own_mark" if c == "mark" else c)
    alone = among(known, named.select("_d", "_m"), "left_anti").select(*[own(c).alias(c) for c in docs.columns])
    rest = [c for c in docs.columns if c != "doc_id"]
    least = among(known, named.where("_stays").select("_d", "_m")).groupBy("doc_id", "mark").agg(F.min(F.struct(*[own(c).alias(c) for c in rest])).alias("_row"))
    return alone.union(least.select(*[F.col("doc_id") if c == "doc_id" else F.col("_row")[c].alias(c) for c in docs.columns]))


def brute_force(rows: list[tuple], shingle: int = 5) -> dict:
    """(doc_id, text) to component_id by comparing all pairs, for tests; ids are distinct."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w)} - {()} if len(w) < shingle else {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)})
    label = {d: d for d, _ in rows}
    close = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if DEN * len(sets[i] & sets[j]) >= NUM * len(sets[i] | sets[j])]
    while True:
        old = dict(label)
        for a, b in close:
            label[a] = label[b] = min(label[a], label[b])
        if label == old:
            return label
