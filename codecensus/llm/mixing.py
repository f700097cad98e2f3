"""Mixing sources to target weights: exact block quotas split down a tree of output shards (DataFrame and SQL only)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.running import running_total
from .common import BLANKS, WORD, joined, pick, prepare, saved, table, unpacked

#: Documents of a block, on average; words of an output shard, on average.
BLOCK_DOCS, SHARD_WORDS = 256, 4_000_000
WEIGHTS = (3, 1, 2)
#: A shard count beyond this makes shards larger instead.
MAX_SHARDS = 1 << 17


def n_words(text: Column) -> Column:
    """Number of words: each becomes one letter, blanks go."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), BLANKS, ""))


def row_key(doc_id: Column, text: Column) -> Column:
    """What places a row in its source's permutation; only equal rows share it."""
    return F.xxhash64(doc_id, text)


@dataclass
class Mix:
    """The written tables of a mix.

    sources(source, n_blocks, source_size, target, whole), draws(source, block, pass, shard, part): block ``block`` of the
    source goes to ``shard``; with ``part`` only the rows in ``picked`` (source, key) do.
    """

    sources: DataFrame
    draws: DataFrame
    picked: DataFrame


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add ``target`` to a written table (source, source_size).

    Sources by code point, null last, take the weights 3, 1, 2 in turn and share ``share`` of all words; a target stops at
    ``most`` times its source's size and the excess is reshared by weight until none is above. Each round is one
    aggregate over the source table.
    """
    key = [F.col("source").isNull(), F.col("source")]
    ranked = saved(running_total(sources, [], key, {"pos": F.lit(1)}, lambda d: saved(d, "ranked-sources")), "ranks")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("pos") % len(WEIGHTS) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(most)
    ranked = ranked.withColumn("weight", weight)
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    rate, stopped = 0.0, -1
    while True:  # the rate only rises, so a stopped source stays stopped
        over = cap <= F.col("weight") * F.lit(rate)
        taken, weights, n = ranked.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == stopped or not weights:
            break
        stopped, rate = n, (total - (taken or 0.0)) / weights
    return ranked.withColumn("target", F.least(cap, F.col("weight") * F.lit(rate))).drop("pos", "weight")


def hypergeometric(n: str, q: str, total: str, u: str) -> str:
    """SQL text of one draw: how many of ``n`` taken from ``total`` are among ``q`` marked; ``u`` is a uniform number.

    Inverts the distribution function. Probabilities follow from the ratio of neighbours and are summed within 12 standard
    deviations of the mean, where all that a double can tell apart lies.
    """
    share = "(h.q / h.total)"
    spread = f"(12 * sqrt(h.n * {share} * (1 - {share}) * ((h.total - h.n) / greatest(h.total - 1, 1))) + 3)"
    step = "if(k = r.a, 0D, s.lw + ln((h.q - k + 1D) * (h.n - k + 1D) / (k * (h.total - h.q - h.n + k + 0D))))"
    low = f"greatest(0L, h.n - (h.total - h.q), cast(floor(h.n * {share} - {spread}) as bigint))"
    high = f"least(h.q, h.n, cast(ceil(h.n * {share} + {spread}) as bigint))"
    draw = f"""
        transform(array(named_struct('a', {low}, 'b', {high})), r ->
        transform(array(aggregate(sequence(r.a, r.b), named_struct('lw', 0D, 'top', 0D), (s, k) ->
          transform(array({step}), v -> named_struct('lw', v, 'top', greatest(s.top, v)))[0]).top), top ->
        transform(array(aggregate(sequence(r.a, r.b), named_struct('lw', 0D, 'sum', 0D), (s, k) ->
          transform(array({step}), v -> named_struct('lw', v, 'sum', s.sum + exp(v - top)))[0]).sum), mass ->
        aggregate(sequence(r.a, r.b), named_struct('lw', 0D, 'sum', 0D, 'k', cast(null as bigint)), (s, k) ->
          transform(array({step}), v -> named_struct('lw', v, 'sum', s.sum + exp(v - top),
            'k', coalesce(s.k, if(s.sum + exp(v - top) >= h.u * mass, k, cast(null as bigint)))))[0],
          s -> coalesce(s.k, r.b)))[0])[0])[0]"""
    bound = f"transform(array(named_struct('n', {n}, 'q', {q}, 'total', {total}, 'u', {u})), h -> {draw})[0]"
    return f"if({q} = 0 or {n} = 0, 0L, if({n} >= {total}, {q}, {bound}))"


def split_tree(quotas: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    """Split exact quotas (sid, q) among ``shards`` shards: (shard, sid, q).

    A node holds a range of shards and what is left of each source's quota. Its left half takes a
    multivariate-hypergeometric draw of as many blocks as its shards hold, source after source; the right half takes the
    rest. So every shard gets its size exactly, and every source is spent exactly.
    """
    root = quotas.agg(F.sort_array(F.collect_list(F.struct("sid", "q"))).alias("qs"))
    nodes = root.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "qs")
    cap = lambda x: f"(({x}) * {total}L div {shards}L)"
    u = f"(pmod(xxhash64({seed}L, lo, hi, x.sid), 9007199254740992L) / 9007199254740992D)"
    draw = hypergeometric("s.n", "x.q", "s.rest", u)
    for _ in range(max(1, math.ceil(math.log2(max(shards, 2))))):
        nodes = nodes.withColumn("mid", F.expr("(lo + hi) div 2"))
        left = F.expr(f"""aggregate(qs, named_struct('n', {cap('mid')} - {cap('lo')}, 'rest', {cap('hi')} - {cap('lo')},
            'out', cast(array() as array<struct<sid: bigint, q: bigint>>)), (s, x) -> transform(array({draw}), k -> named_struct(
            'n', s.n - k, 'rest', s.rest - x.q, 'out', array_append(s.out, named_struct('sid', x.sid, 'q', k))))[0], s -> s.out)""")
        nodes = nodes.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, left))
        nodes = nodes.select(F.explode(F.expr("""if(left is null, array(named_struct('lo', lo, 'hi', hi, 'qs', qs)), array(
            named_struct('lo', lo, 'hi', mid, 'qs', left),
            named_struct('lo', mid, 'hi', hi, 'qs', transform(qs, (x, i) -> named_struct('sid', x.sid, 'q', x.q - left[i].q)))))""")).alias("c"))
        nodes = nodes.select("c.lo", "c.hi", "c.qs")
    return nodes.select(F.col("lo").alias("shard"), F.explode("qs").alias("x")).select("shard", "x.sid", "x.q").filter("q > 0")


def plan(sizes: DataFrame, seed: int = 0) -> Mix:
    """Plan the mix of a written table (source, key, size).

    A source's rows fall into blocks by key, and its blocks into a permutation. The target is met by whole passes over
    the blocks, then by blocks in permuted order as long as they fit, then by those rows of the next block that still fit,
    in the order of their keys, then by rows of all later blocks (``_later``): what is missing is less than the smallest
    row with words left out of the source. Equal rows are taken together. The tree decides which shard takes which part
    of the permutation.
    """
    src = saved(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")), "sources")
    src = targets(src)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    src = src.withColumn("whole", whole).withColumn("n_blocks", F.ceil(F.col("n_rows") / BLOCK_DOCS).cast("long")) \
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("sid", F.xxhash64("source"))
    src = saved(src, "targets")
    rows = in_blocks(sizes, src)
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    order = [F.xxhash64(F.lit(seed), F.col("source"), F.col("block")), F.col("block")]
    run = running_total(saved(blocks, "blocks"), ["source"], order, {"pos": F.lit(1), "before": F.col("words")}, lambda d: saved(d, "ordered-blocks"))
    run = joined(run, src.select("source", "sid", "whole", "rest", "n_blocks", "source_size"), ["source"])
    full = F.col("before") + F.col("words") <= F.col("rest")
    part = ~full & (F.col("before") < F.col("rest"))
    # empty blocks of a small source leave gaps in block numbers, not in positions
    run = saved(run.withColumn("full", full).withColumn("part", part), "placed-blocks")

    edge = saved(run.filter("part").select("source", "block", (F.col("rest") - F.col("before")).alias("room"), F.col("pos").alias("edge")), "edge-blocks")
    held = joined(rows, edge.select("source", "block", "room"), ["source", "block"], "inner")
    held = held.groupBy("source", "block", "key").agg(F.sum("size").alias("size"), F.first("room").alias("room"))
    fit = held.groupBy("source", "block").agg(F.first("room").alias("room"), F.sort_array(F.collect_list(F.struct("key", "size"))).alias("docs"))
    fit = fit.select("source", "block", F.explode(F.expr("""aggregate(docs, named_struct('room', room, 'out', cast(array() as array<struct<key: bigint, size: bigint>>)), (s, d) ->
        if(d.size <= s.room, named_struct('room', s.room - d.size, 'out', array_append(s.out, d)), s), s -> s.out)""")).alias("d"))
    picked = saved(fit.select("source", "block", "d.key", "d.size"), "picked")
    taken = picked.groupBy("source").agg(F.sum("size").alias("taken"))
    room = joined(edge.select("source", "room", "edge"), saved(taken, "edge-words"), ["source"])
    room = saved(room.select("source", "edge", (F.col("room") - F.coalesce("taken", F.lit(0))).alias("room")), "room")
    later = _later(rows, run, room, order)
    if later is not None:
        picked = picked.select("source", "block", "key").union(later)
        # later blocks follow the first partial one in the permutation, without gaps
        spots = joined(run.select("source", "block"), later.select("source", "block").distinct(), ["source", "block"], "inner")
        spots = running_total(saved(spots, "later-blocks"), ["source"], order, {"nth": F.lit(1)}, lambda d: saved(d, "ordered-later-blocks"))
        spots = joined(spots, room.select("source", "edge"), ["source"]).select("source", "block", (F.col("edge") + 1 + F.col("nth")).alias("spot"))
        run = joined(run, saved(spots, "later-spots"), ["source", "block"])
        run = saved(run.withColumn("part", F.col("part") | F.col("spot").isNotNull()), "placed-later-blocks")
    else:
        run = run.withColumn("spot", F.lit(None).cast("long"))
    picked = picked.select("source", "key")

    passes = F.expr("""concat(transform(if(whole > 0, sequence(1L, whole), cast(array() as array<bigint>)), p -> named_struct('pass', p - 1, 'part', false)),
        if(full or part, array(named_struct('pass', whole, 'part', part)), cast(array() as array<struct<pass: bigint, part: boolean>>)))""")
    count = run.groupBy("source").agg(F.count("*").alias("filled"))
    draws = joined(run, saved(count, "filled"), ["source"]).withColumn("p", F.explode(passes))
    draws = draws.select("source", "sid", "block", F.col("p.pass").alias("pass"), F.col("p.part").alias("part"),
                         (F.col("p.pass") * F.col("filled") + F.when(F.col("p.part"), F.coalesce("spot", "pos")).otherwise(F.col("pos"))).alias("at"))
    draws = saved(draws, "draws")
    total, words = draws.count(), src.agg(F.sum("target")).first()[0] or 0
    shards = max(1, min(math.ceil(words / SHARD_WORDS), total, MAX_SHARDS))
    quotas = saved(split_tree(draws.groupBy("sid").agg(F.count("*").alias("q")), max(total, 1), shards, seed), "quotas")
    start = F.sum("q").over(Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    spots = quotas.withColumn("start", F.coalesce(start, F.lit(0))).select(
        "sid", "shard", F.explode(F.expr("sequence(start, start + q - 1)")).alias("at"))
    draws = saved(draws.join(spots, ["sid", "at"]).select("source", "block", "pass", "shard", "part"), "shards")
    return Mix(src, draws, picked)


def _later(rows: DataFrame, run: DataFrame, room: DataFrame, order: list[Column]) -> DataFrame | None:
    """Rows (source, block, key) of blocks behind the first that doesn't fit, which fill the written ``room`` of their source.

    Each round takes rows in order as long as they fit, rows of up to half the room first. So two rounds at least halve
    the room, until no row fits: their number grows with the logarithm of the room, and a round sees only rows that fit.
    """
    behind = joined(run.select("source", "block", "pos"), room, ["source"], "inner").filter("pos > edge and room > 0").select("source", "block")
    left = joined(rows, saved(behind, "behind"), ["source", "block"], "inner")
    left = joined(left, room.select("source", "room"), ["source"], "inner").filter("size > 0 and size <= room")
    left = saved(left.groupBy("source", "block", "key").agg(F.sum("size").alias("size"), F.first("room").alias("room")).filter("size <= room"), "left")
    out = None
    while left.limit(1).count():
        big = F.col("size") * 2 > F.col("room")
        done = running_total(left, ["source"], [big, *order, F.col("key")], {"before": F.col("size")}, lambda d: saved(d, "ordered-left"))
        done = saved(done.withColumn("fits", F.col("before") + F.col("size") <= F.col("room")), "filled-rows")
        new = done.filter("fits").select("source", "block", "key")
        out = new if out is None else out.union(new)
        taken = saved(done.groupBy("source").agg(F.sum(F.when(F.col("fits"), F.col("size"))).alias("taken")), "filled-words")
        left = joined(done.filter("not fits").select("source", "block", "key", "size", "room"), taken, ["source"])
        left = left.withColumn("room", F.col("room") - F.coalesce("taken", F.lit(0))).drop("taken").filter("size <= room")
        left = saved(left, "left")
    return out


def in_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Add the block of each row (source, key)."""
    out = joined(rows, sources.select("source", F.col("n_blocks").alias("_n")), ["source"])
    return out.withColumn("block", F.pmod(F.xxhash64("key", F.lit("block")), F.col("_n"))).drop("_n")


def drawn(rows: DataFrame, mix: Mix) -> DataFrame:
    """Add ``shards``: the shards that take each row (source, key), an empty list if none does."""
    blocks = mix.draws.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard", "part"))).alias("_to"))
    out = joined(in_blocks(rows, mix.sources), saved(blocks, "block-draws"), ["source", "block"])
    out = joined(out, mix.picked.withColumn("_in", F.lit(True)), ["source", "key"])
    to = F.filter(F.coalesce("_to", F.array()), lambda d: ~d["part"] | F.coalesce(F.col("_in"), F.lit(False)))
    return out.withColumn("shards", F.transform(to, lambda d: d["shard"])).drop("_to", "_in", "block")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, size) of every row, written once."""
    src = pick(docs, "doc_id", "source", "text")
    return saved(src.select("doc_id", "source", row_key(F.col("doc_id"), F.col("text")).alias("key"), n_words(F.col("text")).cast("long").alias("size")), "sizes")


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of docs as often as the mix takes them, in shards, shuffled within each: one shard per partition or less.

    Columns as in docs, whatever else they are named. Rows that no draw takes are absent. Null texts have size 0; null
    sources are one source, last in order; repeated rows are rows of their own that stay together; an empty table stays
    empty.
    """
    names = docs.columns
    mix = plan(sizes(docs).select("source", "key", "size"), seed)
    rows = pick(docs, "doc_id", "source", "text", row="_row")
    rows = rows.select("source", row_key(F.col("doc_id"), F.col("text")).alias("key"), "_row")
    out = drawn(rows, mix).select("_row", "key", F.explode("shards").alias("shard"))
    out = out.repartition("shard").sortWithinPartitions("shard", F.xxhash64("key", "shard", F.lit(seed)))
    return unpacked(out, "_row", names)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken, shards."""
    prepare(spark)
    rows = sizes(table(spark, sf_dir, "documents"))
    mix = plan(rows.select("source", "key", "size"))
    out = joined(drawn(rows, mix), mix.sources.select("source", "source_size", "target"), ["source"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")
