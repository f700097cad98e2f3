"""MinHash near-duplicates: chosen-path set similarity join over word shingles."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import U, mix, pack, shingles, unpack, word_hashes
from .common import Batches, batch, joined, kept, pick, prepare, saved, scratch, table, unpacked
from .components import components

#: Minwise values of a document; a tree's root takes DEPTH of them, a branch STEP.
POSITIONS = 64
#: Independent trees, and the branches that a root stands for. Two documents share no root with (1 - J ** DEPTH) ** TREES.
TREES, DEPTH = 20, 3
#: A node is small when this many members or fewer are outside its largest known component.
SMALL = 64
#: Members of a tile when few members are compared with many.
TILE = 512
#: Parts that a set's hashes are counted in: the smaller counts of two sets bound what they share. A count that is full says nothing.
PARTS = 256
#: A pair is confirmed on full sets when its minwise agreement is within 5 standard deviations of the threshold.
DEVIATIONS = 5.0
#: Levels that a large node branches before its nodes are compared, and how often that is done; a node that is large even then
#: is compared in tiles, however large it is.
LEVELS, ROUNDS, STEP = 3, 1, 2
#: Packed sets of so many bytes in all are broadcast to the pairs; beyond it both meet by shuffles.
SETS_BYTES = 16 << 20
_A = np.random.default_rng(977).integers(1, 2**62, (2, POSITIONS), dtype=np.int64).view(U)
_A[0] |= U(1)
_PART = 1 << 15

SIGNED = "doc_id long, text_key long, n long, s1 long, s2 long, sketch array<int>, counts binary"


def sketch(h: np.ndarray) -> np.ndarray:
    """POSITIONS minwise values of a set of hashes."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, U)
    for at in range(0, len(h), _PART):
        low = np.minimum(low, (h[at:at + _PART, None] * _A[0] + _A[1]).min(0))
    return (mix(low) >> U(32)).astype(np.uint32).view(np.int32)


def _digest(h: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that equal sets share."""
    a, b = mix(h + U(1)).sum(dtype=U), mix(h ^ U(0xA5A5A5A55A5A5A5A)).sum(dtype=U)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def part_counts(h: np.ndarray) -> bytes:
    """How many of a set's hashes fall in each of PARTS parts, a byte each; 255 stands for that or more."""
    part = (mix(h ^ U(0x3C6EF372FE94F82B)) >> U(56)).astype(np.int64)
    return np.minimum(np.bincount(part, minlength=PARTS), 255).astype(np.uint8).tobytes()


def _may_link(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with these part counts (a row each) can have 100 * intersection >= percent * union."""
    both = np.minimum(a, b).sum(1, dtype=np.int64)
    union = a.sum(1, dtype=np.int64) + b.sum(1, dtype=np.int64) - both
    return (100 * both >= percent * union) | (a == 255).any(1) | (b == 255).any(1)


def sign(batches: Batches) -> Batches:
    for b in batches:
        for first, h, offs in word_hashes(b.column("text")):
            rows = len(offs) - 1
            sets = [shingles(h[offs[i]:offs[i + 1]]) for i in range(rows)]
            d = [_digest(s) for s in sets]
            flat = np.concatenate([sketch(s) if len(s) else np.zeros(POSITIONS, np.int32) for s in sets])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * POSITIONS), pa.array(flat))
            yield batch(doc_id=b.column("doc_id").slice(first, rows), text_key=b.column("text_key").slice(first, rows), n=pa.array([len(s) for s in sets], pa.int64()),
                        s1=pa.array([x for x, _ in d], pa.int64()), s2=pa.array([y for _, y in d], pa.int64()), sketch=lists,
                        counts=pa.array([part_counts(s) for s in sets], pa.binary()))


def full_sets(batches: Batches) -> Batches:
    """Full sets of (cid, text), packed."""
    for b in batches:
        for first, h, offs in word_hashes(b.column("text")):
            rows = len(offs) - 1
            packed = [pack(np.diff(shingles(h[offs[i]:offs[i + 1]]), prepend=U(0))) for i in range(rows)]
            yield batch(cid=b.column("cid").slice(first, rows), set=pa.array(packed, pa.binary()))


def _forest(node: np.ndarray, i: np.ndarray, j: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Which pairs of rows, taken best first, join two groups of their node's components that weren't one."""
    root: dict[tuple[int, int], tuple[int, int]] = {}

    def find(x: tuple[int, int]) -> tuple[int, int]:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = np.zeros(len(i), bool)
    for k, (n, a, b) in enumerate(zip(node[i].tolist(), comp[i].tolist(), comp[j].tolist(), strict=True)):
        a, b = find((n, a)), find((n, b))
        if a != b:
            root[a] = b
            out[k] = True
    return out


def _close(least: float):
    """Exhaustive comparison inside groups: rows (group, outer, cid, comp, sketch, counts) sorted by group, outer members first.

    Each outer member is compared with all that follow it in its group. All groups of a batch are compared together:
    rows with the rows one place further, then two, and so on, as long as a group is that long. A group that a batch cuts
    is completed from the next one; groups are bounded, so what waits is too.
    """
    low = least - DEVIATIONS * np.sqrt(least * (1 - least) / POSITIONS)
    percent = round(100 * least)

    def compare(t: pa.Table) -> pa.RecordBatch:
        group, cid, comp = (t.column(c).to_numpy() for c in ("group", "cid", "comp"))
        outer = t.column("outer").to_numpy() == 1
        x = t.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(group), POSITIONS)
        parts = np.frombuffer(b"".join(t.column("counts").to_pylist()), np.uint8).reshape(len(group), PARTS)
        at, found, k = np.flatnonzero(outer), [], 0
        while len(at):
            k += 1
            at = at[at + k < len(group)]
            at = at[group[at + k] == group[at]]
            same = (x[at] == x[at + k]).mean(1)
            ok = np.flatnonzero((same >= low) & (comp[at] != comp[at + k]))
            ok = ok[_may_link(parts[at[ok]], parts[at[ok] + k], percent)]
            found.append((at[ok], at[ok] + k, same[ok]))
        i, j, same = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, np.int64) for c in range(3))
        order = np.lexsort((j, i, -same))
        i, j = i[order].astype(np.int64), j[order].astype(np.int64)
        return batch(a=np.minimum(cid[i], cid[j]), b=np.maximum(cid[i], cid[j]), tree=_forest(group, i, j, comp))

    def run(batches: Batches) -> Batches:
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            group = b.column("group").to_numpy()
            if group[0] == group[-1] and held[0].column("group")[0].as_py() == group[0]:
                continue
            t = pa.Table.from_batches(held)
            done = np.flatnonzero(t.column("group").to_numpy() != group[-1])
            cut = int(done[-1]) + 1 if len(done) else 0
            if cut:
                yield compare(t.slice(0, cut))
            held, rows = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
        if held:
            yield compare(pa.Table.from_batches(held))

    return run


def _compared(rows: DataFrame, by: list[str], least: float) -> DataFrame:
    """Candidates (a, b, tree) of the groups that the columns ``by`` name."""
    rows = rows.select(F.xxhash64(*by).alias("group"), "outer", "cid", "comp", "sketch", "counts")
    rows = rows.repartition("group").sortWithinPartitions("group", F.desc("outer"), "cid")
    return rows.mapInArrow(_close(least), "a long, b long, tree boolean")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b, ca, cb) those whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            a, c = b.column("a").to_numpy(), b.column("b").to_numpy()
            ca, cb = b.column("ca").to_numpy(), b.column("cb").to_numpy()
            ok = np.zeros(b.num_rows, bool)
            last, x = None, None
            for i, (p, q) in enumerate(zip(b.column("sa"), b.column("sb"), strict=True)):
                p = p.as_py()
                if p is not last and p != last:
                    last, x = p, np.cumsum(unpack(p, np.uint64), dtype=np.uint64)
                y = np.cumsum(unpack(q.as_py(), np.uint64), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch(a=a[ok], b=c[ok], ca=ca[ok], cb=cb[ok])

    one = sets.select(F.col("cid").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("cid").alias("b"), F.col("set").alias("sb"))
    if (sets.agg(F.sum(F.length("set"))).first()[0] or 0) <= SETS_BYTES:
        pairs, one, two = pairs.repartition("a").sortWithinPartitions("a"), F.broadcast(one), F.broadcast(two)
    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a long, b long, ca long, cb long")


class Join:
    """State of one similarity join over classes of equal sets: the components that confirmed links make so far."""

    def __init__(self, classes: DataFrame, docs: DataFrame, percent: int):
        self.classes, self.docs, self.percent = classes, docs, percent
        self.known: DataFrame | None = None
        self.sets: DataFrame | None = None

    def confirm(self, pairs: DataFrame) -> None:
        """Check candidates (a, b, tree): first the best pairs that would span a node's groups, then those that still
        join two components."""
        pairs = saved(pairs.groupBy("a", "b").agg(F.max("tree").alias("tree")), "pairs")
        if not pairs.limit(1).count():
            return
        need = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
        if self.sets is not None:
            need = need.join(self.sets.select("cid"), "cid", "left_anti")
        need = saved(self.classes.select("cid", "text_key").join(need, "cid"), "needed")
        found = joined(self.docs.select("text_key", "text"), need.select("text_key", "cid"), ["text_key"], "inner")
        sets = saved(found.select("cid", "text").mapInArrow(full_sets, "cid long, set binary").dropDuplicates(["cid"]), "sets")
        self.sets = sets if self.sets is None else self.sets.union(sets)
        for tree in (True, False):
            left = saved(self.unjoined(pairs.filter(F.col("tree") == tree)), "left")
            if not left.limit(1).count():
                continue
            new = saved(_verify(left, self.sets, self.percent), "links")
            if new.limit(1).count():
                self.join(new)

    def join(self, links: DataFrame) -> None:
        """Join the components ca and cb of confirmed links; only components meet, whatever their size."""
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ca").alias("comp")),
                                              F.struct(F.col("b").alias("node"), F.col("cb").alias("comp")))).alias("x")).select("x.*")
        nodes = (ends if self.known is None else self.known.union(ends)).distinct()
        met = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("comp"), "component")
        self.known = saved(nodes.join(met, "comp", "left").select("node", F.coalesce("component", "comp").alias("comp")), "known")

    def unjoined(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, ca, cb) between two components."""
        if self.known is None:
            return pairs.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))
        a = self.known.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        b = self.known.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        out = pairs.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
        return out.filter("ca <> cb")

    def labelled(self, members: DataFrame) -> DataFrame:
        """Members (node, cid) with their component so far."""
        if self.known is None:
            return members.withColumn("comp", F.col("cid"))
        known = self.known.select(F.col("node").alias("cid"), "comp")
        return members.join(known, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))


def _node_sizes(members: DataFrame) -> DataFrame:
    """(node, m, outer, top): members, those outside the largest component, and that component; only unfinished nodes."""
    by = members.groupBy("node", "comp").agg(F.count("*").alias("k"))
    n = by.groupBy("node").agg(F.sum("k").alias("m"), F.max(F.struct("k", "comp")).alias("t"))
    return n.select("node", "m", (F.col("m") - F.col("t.k")).alias("outer_n"), F.col("t.comp").alias("top")).filter("outer_n > 0")


def _tiled(members: DataFrame, least: float) -> DataFrame:
    """Candidates of nodes (node, cid, comp, sketch, m, outer_n, top) in which few members are outside the largest component.

    The outer members go to every tile of the node, the others to one tile each, so that a tile is bounded and the work of
    a node is its outer members times its size.
    """
    tiles = F.greatest(F.lit(1), F.ceil(F.col("m") / TILE)).cast("int")
    outer = F.col("comp") != F.col("top")
    rows = members.withColumn("outer", outer.cast("int")).withColumn("tiles", tiles)
    to = F.when(F.col("outer") == 1, F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(F.pmod(F.xxhash64("cid", "node"), F.col("tiles")).cast("int")))
    rows = rows.select("node", "cid", "comp", "sketch", "counts", "outer", F.explode(to).alias("tile"))
    return _compared(rows, ["node", "tile"], least)


def _blocked(members: DataFrame, least: float) -> DataFrame:
    """Candidates of nodes that stay large: every pair of tiles of a node, each tile in turn as the outer members."""
    rows = members.withColumn("tiles", F.greatest(F.lit(1), F.ceil(F.col("m") / SMALL)).cast("int")).withColumn("own", F.pmod(F.xxhash64("cid", "node"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least("own", t).alias("x"), F.greatest("own", t).alias("y")))))
    rows = rows.select("node", "cid", "comp", "sketch", "counts", (F.col("own") == F.col("pair.x")).cast("int").alias("outer"), F.col("pair.x").alias("x"), F.col("pair.y").alias("y"))
    return _compared(rows, ["node", "x", "y"], least)


def _hubs(members: DataFrame, least: float) -> DataFrame:
    """Candidates of large nodes: the member most like the node's centre, with every member that may be linked to it.

    The centre has at each position the commonest value among about SMALL members outside the largest component, drawn by
    hash. In a group of copies of one text that text is the centre, and all copies link to it.
    """
    low = least - DEVIATIONS * np.sqrt(least * (1 - least) / POSITIONS)
    outer = members.filter("comp <> top")
    draw = F.pmod(F.xxhash64("cid", "node", F.lit("centre")), F.lit(1 << 30)) / float(1 << 30)
    sample = outer.filter(draw < F.lit(2.0 * SMALL) / F.col("outer_n"))

    def centre(group: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(np.stack(group["sketch"].to_numpy()), axis=0)
        best = []
        for c in x.T:
            v, n = np.unique(c, return_counts=True)
            best.append(v[n.argmax()])
        return pd.DataFrame({"node": group["node"].iloc[:1], "centre": [np.array(best, np.int32)]})

    mid = saved(sample.select("node", "sketch").groupBy("node").applyInPandas(centre, "node long, centre array<int>"), "centres")
    agree = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = joined(outer, mid, ["node"], "inner").withColumn("agree", agree("sketch", "centre"))
    hub = saved(near.groupBy("node").agg(F.max_by("cid", F.struct("agree", -F.col("cid"))).alias("hub"), F.max_by("sketch", F.struct("agree", -F.col("cid"))).alias("hub_sketch"),
                                         F.max_by("comp", F.struct("agree", -F.col("cid"))).alias("hub_comp")), "hubs")
    rows = joined(members, hub, ["node"], "inner").filter("comp <> hub_comp").filter(agree("sketch", "hub_sketch") >= low * POSITIONS)
    return rows.select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b"), F.lit(True).alias("tree"))


def _shared(rows: DataFrame) -> DataFrame:
    """Of a written table (node, cid) the rows whose node has another member."""
    many = rows.groupBy("node").agg(F.count("*").alias("k")).filter("k > 1").select("node")
    return saved(rows.join(many, "node"), "members")


def near_classes(classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(cid, comp) for classes that have a link, from a written table (cid, n, s1, s2, text_key, sketch, counts)."""
    join = Join(classes, docs, percent)
    _grow(join, classes.select("cid", "sketch", "counts"), percent / 100)
    if join.known is None:
        return classes.select("cid", F.col("cid").alias("comp")).limit(0)
    return join.known.select(F.col("node").alias("cid"), "comp")


def _open_nodes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of nodes that hold more than one component, with their node's sizes: those of small nodes, those of large ones."""
    rows = saved(members.join(_node_sizes(members), "node"), "open-members")
    return rows.filter(F.col("outer_n") <= SMALL), rows.filter(F.col("outer_n") > SMALL)


def _branched(large: DataFrame, sketches: DataFrame, least: float, level: int) -> DataFrame:
    """Members (node, cid) of the nodes one level further. About 1 / J ** STEP branches: pairs at the threshold then keep their
    number of common paths from level to level."""
    second = F.pmod(F.xxhash64("node", F.lit(level), F.lit("second")), F.lit(1 << 30)) / float(1 << 30) < 1 / least**STEP - 1
    turns = F.explode(F.when(second, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = large.join(sketches, "cid").select("node", "cid", "sketch", turns.alias("turn"))
    # every level has positions of its own, so that none comes twice on a path
    span = POSITIONS // (LEVELS * ROUNDS * STEP)
    at = [(F.pmod(F.xxhash64("node", "turn", F.lit(level), F.lit(k)), F.lit(span)) + (level * STEP + k) * span).cast("int") for k in range(STEP)]
    node = F.xxhash64("node", "turn", *at, *[F.element_at("sketch", p + 1) for p in at])
    return saved(rows.select(node.alias("node"), "cid").distinct(), "branched")


def _grow(join: Join, sketches: DataFrame, least: float) -> None:
    """Compare the nodes of all trees.

    A round compares small nodes exhaustively and the members of large ones with the member at the centre, and confirms what it
    found at once. What still holds several components then branches for some levels, without a look at the pairs, before
    the next round; nodes that get small on the way wait for it. Members are narrow; their minwise values come along only
    where they are looked at.
    """
    roots = [F.xxhash64(F.lit(t), *[F.element_at("sketch", t * DEPTH + d + 1) for d in range(DEPTH)]) for t in range(TREES)]
    members = _shared(saved(sketches.select(F.explode(F.array(*roots)).alias("node"), "cid"), "rooted"))
    few, large = _open_nodes(join.labelled(members))
    small = [few]
    for again in range(ROUNDS + 1):
        found = _tiled(reduce(DataFrame.union, small).join(sketches, "cid"), least)
        over = large.isEmpty()
        if not over:
            wide = saved(large.join(sketches, "cid"), "large-members")
            found = found.union(_hubs(wide, least) if again < ROUNDS else _blocked(wide, least))
        join.confirm(found)
        if over or again == ROUNDS:
            return
        few, large = _open_nodes(join.labelled(large.select("node", "cid")))
        small = [few]
        for level in range(again * LEVELS, (again + 1) * LEVELS):
            if large.isEmpty():
                break
            few, large = _open_nodes(join.labelled(_branched(large.select("node", "cid"), sketches, least, level)))
            small.append(few)


def near_duplicates(docs: DataFrame, percent: int = 85, groups: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, n_copies, text_key.

    With ``groups`` also comp: equal in the rows of a component, null where no other row is in it.

    A text's set: its distinct windows of 5 lower-cased words, or its whole sequence when it is shorter. Texts with
    100 * intersection >= percent * union are linked; component_id is the smallest doc_id reachable. Null, empty and blank
    texts have no set and link with nothing. Equal sets form one class that is compared once. Repeated rows share a class;
    of equal rows all are kept or none. A null doc_id is a component's id only where no other is. Every link
    returned was confirmed on full sets, to which only pairs come that their part counts don't rule out; a pair of which
    some shared node is small is missed with a probability below (1 - J ** DEPTH) ** TREES, 1e-8 at 0.85 and 1e-6 at 0.8.
    The tables written on the way are deleted; the result is a written table.
    """
    with scratch(docs.sparkSession):
        return kept(_near_duplicates(docs, percent, groups), "near-duplicates")


def _near_duplicates(docs: DataFrame, percent: int, groups: bool) -> DataFrame:
    src = keyed(docs)
    signed = saved(src.mapInArrow(sign, SIGNED), "signed")
    keys = ["n", "s1", "s2"]
    cls = signed.filter("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("low"), F.min("text_key").alias("text_key"), F.first("sketch").alias("sketch"),
                                                 F.first("counts").alias("counts"), F.count("*").alias("copies"))
    cls = saved(cls.withColumn("cid", F.monotonically_increasing_id()), "set-classes")
    comp = near_classes(cls, src, percent)
    return _with_components(signed, cls, comp, keys, groups)


def _with_components(signed: DataFrame, cls: DataFrame, comp: DataFrame, keys: list[str], groups: bool = False) -> DataFrame:
    cls = cls.select("cid", *keys, "low", "copies").join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    cls = saved(cls, "set-components")
    lows = cls.groupBy("comp").agg(F.min("low").alias("component_id"), *[F.count("*").alias("classes")] * groups)
    # only classes that say more than their row does come along
    tells = "copies > 1 or not (low <=> component_id)" + " or classes > 1" * groups
    told = saved(cls.join(lows, "comp").filter(tells).select(*keys, "component_id", "copies", *["comp"] * groups), "told")
    out = joined(signed.select("doc_id", "text_key", *keys), told, keys)
    cid = F.when(F.col("copies").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"), F.col("doc_id").eqNullSafe(cid).alias("kept"),
                      F.coalesce("copies", F.lit(1)).alias("n_copies"), "text_key", *["comp"] * groups)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): rows with one key are equal in both."""
    src = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return src.select("doc_id", F.xxhash64("doc_id", "text").alias("text_key"), "text")


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs without near-duplicates: of each component one row with the smallest doc_id stays, of several texts
    under that doc_id the one with the smallest key. Of equal rows (doc_id, text) without words one stays. Rows that share
    no more than a doc_id, or have none, are different documents. Columns as in docs."""
    with scratch(docs.sparkSession):
        return _deduplicated(docs, near_duplicates(docs, percent, groups=True))


def _deduplicated(docs: DataFrame, found: DataFrame) -> DataFrame:
    names, key = docs.columns, ["doc_id", "text_key"]
    first = found.filter("kept")
    stay = first.filter("comp is not null").groupBy("comp").agg(F.min("text_key").alias("stays"), F.max("text_key").alias("most")).filter("stays < most")
    second = joined(first.filter("comp is not null"), saved(stay.select("comp", "stays"), "several-texts"), ["comp"], "inner").filter("text_key > stays")
    gone = found.filter(~F.col("kept")).select(*key).union(second.select(*key)).distinct()
    gone = kept(gone.withColumn("gone", F.lit(True)), "gone")
    again = kept(first.groupBy(*key).agg(F.count("*").alias("k")).filter("k > 1").select(*key, F.lit(True).alias("again")), "again")
    rows = pick(docs, "doc_id", "text", row="_row").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("text_key"), "_row")
    rows = joined(joined(rows, gone, key).filter("gone is null"), again, key)
    once = unpacked(rows.filter("again is not null").dropDuplicates(key), "_row", names)
    return unpacked(rows.filter("again is null"), "_row", names).union(once)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.85."""
    prepare(spark)
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "kept", "n_copies")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
t AS (SELECT doc_id, md5(string_agg(g, chr(1) ORDER BY g)) AS h FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept,
       (CASE WHEN t.h IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY t.h) END)::BIGINT AS n_copies
FROM d JOIN m ON m.a = d.doc_id LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
