"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct word shingles. Sets are hashed into 128
buckets; a bucket keeps the leading-zero count of its least hash and the ten
bits after the leading one (HyperMinHash), 16 bits in all. Four neighbouring
registers make a band; documents that share a band meet.

* Documents with equal sets are one class from the start: only a class's first
  document goes on, however many copies it has.
* Classes that share a band aren't paired with each other. In each band bucket
  one class leads - the one that meets most others over all its bands, which
  in a group of edited copies is the least edited - and the others are paired
  with it. The buckets under one leader are its crowd. In a crowd, the HUBS
  members that meet most others are then compared with all that no chain of
  links joins to them yet. A crowd of up to HUBS + 2 classes is thereby settled.
* What is left of a larger crowd, the pairs of members of which neither is a
  hub and which no chain of links joins yet, is settled block by block: a
  crowd's members are dealt into blocks, and each two blocks meet in one task,
  first by registers, then, where an estimate demands it, by full sets.
* Pairs whose collision-corrected Jaccard estimate lies well below the limit
  are left out; the rest are confirmed on the full sets. A leader's members are
  dealt over many tasks, each of which gets the leader's text once.
* Components come from large-star/small-star passes, whose rows never exceed
  the number of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..staging import fresh, sifted, stage
from .textkit import NONSPACE, buffers, mix, rounds, split_words, window_hashes, windows_within, word_hashes

REGISTERS, BAND, MANTISSA = 128, 4, 10
BANDS = REGISTERS // BAND
#: Expected share of registers that agree by chance though their least hashes differ (Yu and Weber 2017), times 2**MANTISSA.
CHANCE = 0.169919487159739
#: Standard deviations below the limit at which an estimate rules a pair out.
MARGIN = 5.0
#: Members of a leader's crowd, besides the leader, that all others not tied with it are compared with.
HUBS = 8
#: Members of a leader that one task compares, and parts that a crowd's members are dealt into to meet its few hubs.
DEAL, SALT = 256, 32
#: Members of a block of a crowd, and shingles that a block may hold (fewer members then, one at least).
BLOCK, BLOCK_SHINGLES = 512, 4_000_000
_U = np.uint64


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each document): the distinct k-word shingles of each document, ascending."""
    low, ws, we, first = split_words(raw, off, NONSPACE)
    words = word_hashes(low, ws, we)
    at, doc = windows_within(first, k)
    grams = window_hashes(words, k)[at] if len(at) else np.zeros(0, _U)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.array([int(mix(np.array([sum(int(w) * (2 * j + 3) ** 7 for j, w in enumerate(words[first[i] : first[i + 1]])) % (1 << 64) + int(n[i])], dtype=_U))[0]) for i in short], dtype=_U)
        grams, doc = np.concatenate([grams, whole]), np.concatenate([doc, short])
    order = np.argsort(grams, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(off)))


def registers(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of each set: (leading zeros + 1) * 2**MANTISSA + mantissa; 0 where a bucket is empty."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    bucket = (grams >> _U(57)).astype(np.int64)
    cell = doc * REGISTERS + bucket
    new = np.ones(len(grams), dtype=bool)
    new[1:] = cell[1:] != cell[:-1]
    rest = (grams[new] << _U(7)) | _U(1)
    zeros = (64 - np.frexp(rest.astype(np.float64))[1]).clip(0, 56)
    mantissa = (rest << (zeros + 1).astype(_U)) >> _U(64 - MANTISSA)
    out = np.zeros(n * REGISTERS, dtype=np.uint16)
    out[cell[new]] = ((zeros + 1) << MANTISSA) | mantissa.astype(np.int64)
    return out.reshape(n, REGISTERS)


def band_keys(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, document) of the bands that hold any register."""
    four = np.ascontiguousarray(sig).view(_U).reshape(len(sig), BANDS)
    doc, band = np.nonzero(four)
    return mix(four[doc, band] + mix((band + 1).astype(_U))).view(np.int64), doc


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimate, registers it rests on) of rows of registers, less the agreements expected by chance."""
    used = (a | b) != 0
    n = used.sum(axis=1)
    equal = ((a == b) & used).sum(axis=1)
    both = ((a != 0) & (b != 0)).sum(axis=1)
    return (equal - both * CHANCE / 2**MANTISSA) / np.maximum(n, 1), n


def _sketch(k: int):
    names = ["doc_id", "th", "n", "f1", "f2", "sig", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(2))
            for a, b in rounds(off):
                grams, first = shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], k)
                n = np.diff(first)
                total = np.zeros((2, len(grams) + 1), dtype=_U)
                np.cumsum(mix(grams), out=total[0, 1:])
                np.cumsum(mix(grams ^ _U(0xA5A5A5A55A5A5A5A)), out=total[1, 1:])
                f = total[:, first[1:]] - total[:, first[:-1]]
                sig = registers(grams, first)
                keys, doc = band_keys(sig)
                bands = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)), pa.array(keys))
                raw_sig = sig.tobytes()
                size = 2 * REGISTERS
                sigs = pa.array([raw_sig[i * size : (i + 1) * size] for i in range(b - a)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), sigs, bands], names)

    return run


def _estimated(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (2, 3))
            j, n = estimate(a, b)
            keep = np.flatnonzero(j >= least - MARGIN * np.sqrt(least * (1 - least) / np.maximum(n, 1)) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], ["node", "leader"])

    return run


def _confirmed(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in batches:
            raw, off = buffers(batch.column(3))
            leaders, nodes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b in rounds(off):
                grams, first = shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], k)
                found = []
                for i in range(a, b):
                    mine = grams[first[i - a] : first[i - a + 1]]
                    if leaders[i] == nodes[i]:
                        leader, own = leaders[i], mine
                        continue
                    if leader != leaders[i]:
                        raise RuntimeError("a leader's text must come before its members'")
                    both = len(np.intersect1d(own, mine, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(mine) - both):
                        found.append(i)
                if found:
                    yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(found)), batch.column(0).take(pa.array(found))], ["u", "v"])

    return run


def _confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (node, leader) whose full sets are close enough, as links (u, v)."""
    counts = pairs.groupBy("leader").agg(F.count("*").alias("members"))
    deals = counts.select("leader", F.ceil(F.col("members") / DEAL).cast("int").alias("deals"))
    members = pairs.join(deals, "leader").select("leader", F.expr("cast(pmod(xxhash64(node), deals) as int)").alias("deal"), "node")
    heads = deals.select("leader", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.col("leader").alias("node"))
    wanted = members.unionByName(heads)
    texts = _texts(wanted, nodes, docs)
    rows = wanted.join(texts.hint("merge"), "node").select("leader", "deal", "node", "text", (F.col("node") != F.col("leader")).alias("later"))
    dealt = rows.repartition("leader", "deal").sortWithinPartitions("leader", "deal", "later")
    return dealt.drop("later").mapInArrow(_confirmed(k, percent), "u long, v long")


def _block_estimated(least: float, percent: int):
    """Members of two blocks that an estimate can't rule out, each with those partners (of the second block or later in its own) that no link joins to it yet."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        cls, lo, hi = (k.as_py() for k in key[1:4])
        node, root, size, block, own = (rows.column(c).to_numpy() for c in ("node", "root", "size", "block", "own"))
        order = np.lexsort((node, block))
        node, root, size, block, own = node[order], root[order], size[order], block[order], own[order]
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, REGISTERS)[order]
        start = int(np.searchsorted(block, hi)) if lo != hi else 0
        partners: dict[int, np.ndarray] = {}
        for i in range(start if lo != hi else len(node)):
            j = np.arange(max(start, i + 1), len(node))
            # Two sizes share one class or two; the pair counts in the class of the larger.
            j = j[(root[j] != root[i]) & (100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])) & (np.maximum(own[j], own[i]) == cls)]
            if len(j):
                e, n = estimate(sig[j], sig[i])
                j = j[e >= least - MARGIN * np.sqrt(least * (1 - least) / np.maximum(n, 1)) - 1e-9]
            if len(j):
                partners[i] = j
        at = sorted({*partners, *(int(x) for j in partners.values() for x in j)})
        lists = [node[partners[i]].tolist() if i in partners else [] for i in at]
        same = lambda k: pa.array([k.as_py()] * len(at), pa.int64())
        return pa.table([same(key[0]), same(key[1]), same(key[2]), same(key[3]), pa.array(node[at], pa.int64()), pa.array(root[at], pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["leader", "class", "lo", "hi", "node", "root", "partners"])

    return run


def _block_confirmed(k: int, percent: int):
    """Links of the pairs of two blocks whose full sets are close enough, less those whose ends are joined before."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        raw, off = buffers(rows.column("text"))
        parts = [shingle_sets(raw[off[a] : off[b]], off[a : b + 1] - off[a], k) for a, b in rounds(off)]
        sets = [grams[first[i] : first[i + 1]] for grams, first in parts for i in range(len(first) - 1)]
        length = np.array([len(x) for x in sets])
        words, ids = np.unique(np.concatenate(sets), return_inverse=True)
        sets = np.split(ids, np.cumsum(length)[:-1])
        node = rows.column("node").to_pylist()
        place = {x: i for i, x in enumerate(node)}
        label = np.unique(rows.column("root").to_numpy(), return_inverse=True)[1]
        mark, u, v = np.zeros(len(words), dtype=bool), [], []
        for i, others in enumerate(rows.column("partners").to_pylist()):
            j = np.array([place[x] for x in others], dtype=np.int64)
            j = j[label[j] != label[i]]
            if not len(j):
                continue
            mark[sets[i]] = True
            both = np.add.reduceat(mark[np.concatenate([sets[x] for x in j])].astype(np.int64), np.concatenate([[0], np.cumsum(length[j])[:-1]]))
            mark[sets[i]] = False
            for x in j[100 * both >= percent * (length[i] + length[j] - both)]:
                if label[x] != label[i]:
                    label[label == label[x]] = label[i]
                    u.append(node[i])
                    v.append(node[x])
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of each node in ``wanted``."""
    keys = stage(wanted.select("node").distinct().join(nodes.select("node", "doc_id", "th"), "node"), "near-keys")
    on = F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("th") == F.col("h"))
    texts = sifted(docs, F.col("th"), keys, F.col("th")).select(F.col("doc_id").alias("k"), F.col("th").alias("h"), "text").dropDuplicates(["k", "h"])
    return keys.join(texts, on).select("node", "text")


def _salted(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(SALT))


def _to_each(few: DataFrame) -> DataFrame:
    """``few`` rows of a crowd, once for each part of it."""
    return few.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))


def _settle(crowd: DataFrame, hubs: DataFrame, roots: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, class_of) -> DataFrame:
    """(node, root) once more, with the links among members of a crowd that are neither its leader nor its hubs."""
    big = crowd.groupBy("leader", "class").agg(F.count("*").alias("m")).where(F.col("m") > HUBS + 1).select("leader", "class")
    rest = crowd.withColumn("salt", _salted("node")).join(_to_each(big), ["leader", "class", "salt"]).join(hubs.select("leader", "class", F.col("hub").alias("node")), ["leader", "class", "node"], "left_anti")
    rest = stage(rest.select("leader", "class", "node", "size"), "near-rest")
    if rest.isEmpty():
        return roots
    rest = rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = rest.groupBy("leader", "class").agg(F.count("*").alias("m"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("leader", "class", "m")
    # A block is of so few members that its sets fit: those of class c hold less than (100 / percent) ** (c + 1) shingles.
    members = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), BLOCK_SHINGLES / F.pow(F.lit(100.0 / percent), F.col("class") + 1)))
    open_ = open_.withColumn("blocks", F.ceil(F.col("m") / members).cast("int"))
    dealt = rest.withColumn("salt", _salted("node")).join(_to_each(open_), ["leader", "class", "salt"]).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)"))
    dealt = dealt.join(nodes.select("node", "sig"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("leader", "class", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "root", "size", class_of("size").alias("own"), "sig")
    group = ["leader", "class", "lo", "hi"]
    close = dealt.groupBy(*group).applyInArrow(_block_estimated(percent / 100, percent), "leader long, class long, lo long, hi long, node long, root long, partners array<long>")
    close = stage(close, "near-blocks")
    if close.isEmpty():
        return roots
    found = stage(close.join(_texts(close, nodes, docs).hint("merge"), "node").groupBy(*group).applyInArrow(_block_confirmed(k, percent), "u long, v long"), "near-links-rest")
    return _joined(roots, found)


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) once more, with further links (u, v): only roots are joined anew, and a node that had no link is its own."""
    if links.isEmpty():
        return roots
    root_of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    ends = links.join(root_of("u"), "u", "left").join(root_of("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
    joined = stage(components(ends).select(F.col("node").alias("root"), F.col("root").alias("next")), "near-joined")
    moved = roots.join(joined, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return stage(moved.unionByName(joined.select(F.col("root").alias("node"), F.col("next").alias("root"))).distinct(), "near-roots")


def near_duplicates(docs: DataFrame, *, k: int = 4, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least doc_id reachable) and kept.

    Documents are linked where 100 * intersection >= percent * union of their
    sets. Fewer than k words are one shingle; a null or empty text or one of
    white space has an empty set and is linked with nothing. Rows that share a
    doc_id are judged each by its own text. A null doc_id has a component_id
    only by other documents, and isn't kept unless alone, when both are null and
    kept is true. An empty table gives no rows. Other columns are ignored.
    """
    return _judged(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _judged(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row a document: doc_id, th, n, component_id and first_th, the text hash of the row that stands first in its component."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    sets = stage(docs.mapInArrow(_sketch(k), "doc_id long, th long, n long, f1 long, f2 long, sig binary, bands array<long>"), "near-sets")
    node = F.xxhash64("f1", "f2", "n").alias("node")
    full = sets.where("n > 0")
    least = full.groupBy(node).agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th")).alias("x"), F.max("n").alias("n")).select("node", "x.doc_id", "x.th", "n")
    own = least.select(F.col("node").alias("own"), F.col("doc_id").alias("k"), F.col("th").alias("h"))
    same = (F.col("node") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("th") == F.col("h"))
    nodes = stage(full.select(node, "doc_id", "th", "n", "sig", "bands").join(own, same, "left_semi").dropDuplicates(["node"]), "near-nodes")

    rows = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    rows = stage(rows.join(shared, "key"), "near-bands")
    rank = stage(rows.groupBy("node").agg(F.sum("m").alias("rank")), "near-rank")
    # Sets whose sizes allow a link share a size class: each stands in its own and the next.
    class_of = lambda n: F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(100.0 / percent)))
    size = class_of("n")
    rows = rows.join(rank, "node").select("node", F.col("n").alias("size"), "rank", "key", F.explode(F.array(size, size + 1)).alias("class"))
    rows = stage(rows, "near-buckets")
    sig = nodes.select("node", "sig")
    fit = lambda a, b: F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")

    def linked(pairs: DataFrame, tag: str) -> DataFrame:
        signed = pairs.join(sig, "node").withColumnRenamed("sig", "s1").join(sig.select(F.col("node").alias("leader"), F.col("sig").alias("s2")), "leader")
        close = signed.select("node", "leader", "s1", "s2").mapInArrow(_estimated(percent / 100), "node long, leader long")
        return stage(_confirm(stage(close, f"near-pairs-{tag}"), nodes, docs, k, percent), f"near-links-{tag}")

    lead = rows.groupBy("key", "class").agg(F.max(F.struct("rank", "node", "size")).alias("x"), F.count("*").alias("m")).where("m > 1").select("key", "class", F.col("x.node").alias("leader"), F.col("x.size").alias("lead_size"))
    met = rows.join(lead, ["key", "class"]).where("node <> leader")
    crowd = stage(met.groupBy("leader", "class", "node").agg(F.first("size").alias("size"), F.first("rank").alias("rank"), F.first("lead_size").alias("lead_size")), "near-crowds")
    links = linked(crowd.where(fit("size", "lead_size")).select("node", "leader").distinct(), "first")
    roots = stage(components(links), "near-roots")
    crowd = stage(crowd.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-tied")
    top = crowd.withColumn("nth", F.row_number().over(Window.partitionBy("leader", "class").orderBy(F.desc("rank"), F.desc("node")))).where(F.col("nth") <= HUBS)
    top = top.select("leader", "class", F.col("node").alias("hub"), F.col("size").alias("hub_size"), F.col("root").alias("hub_root"))
    # Two sizes share one class or two; the pair counts in the class of the larger.
    once = F.col("class") == F.greatest(class_of("size"), class_of("hub_size"))
    again = crowd.withColumn("salt", _salted("node")).join(_to_each(top), ["leader", "class", "salt"]).where("root <> hub_root").where(fit("size", "hub_size") & once)
    roots = _joined(roots, linked(again.select("node", F.col("hub").alias("leader")).distinct(), "again"))
    roots = _settle(crowd.drop("root"), top, roots, nodes, docs, k, percent, class_of)
    named = roots.join(least.select("node", "doc_id", "th"), "node")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th")
    of = stage(named.join(named.groupBy("root").agg(F.min(order).alias("x")), "root").select("node", F.col("x.doc_id").alias("component_id"), F.col("x.th").alias("component_th")), "near-components")
    own = least.select(F.col("node").alias("own"), F.col("doc_id").alias("class_id"), F.col("th").alias("class_th"))
    joined = sets.select("doc_id", "th", "n", node).join(own, F.col("node") == F.col("own"), "left").drop("own").join(of, "node", "left")
    member = F.col("n") > 0
    found = F.col("component_th").isNotNull()
    component = F.when(~member, F.col("doc_id")).when(found, F.col("component_id")).otherwise(F.col("class_id"))
    first = F.when(~member, F.col("th")).otherwise(F.coalesce("component_th", "class_th"))
    return joined.select("doc_id", "th", "n", component.alias("component_id"), first.alias("first_th"))


def keep_first(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: that of the least doc_id, and of rows that share it, of the least text hash.

    Of rows with equal doc_id and text one stays, whatever their other columns
    hold; those without words included. A null doc_id comes last. An empty table gives no rows. All columns
    are kept.
    """
    key, th, none = fresh(docs, "doc", "th", "none")
    kept = _judged(docs, k, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("first_th")))
    least = F.lit(-(1 << 63)).cast("long")
    kept = kept.select(F.coalesce("doc_id", least).alias(key), F.col("doc_id").isNull().alias(none), F.col("th").alias(th)).distinct()
    named = docs.withColumns({key: F.coalesce("doc_id", least), none: F.col("doc_id").isNull(), th: F.xxhash64("text")})
    return named.join(kept.hint("merge"), [key, none, th], "left_semi").dropDuplicates([key, none, th]).select(*docs.columns)
