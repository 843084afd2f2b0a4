"""Tries of conversation prefixes: one node for each distinct beginning, with totals over its subtree.

A node is known by its depth and a 128-bit hash of its turns. Hashes of prefixes are running sums of hashes of
(place, role, text), so they are taken by windows over pieces of a conversation, and a conversation of any length is
dealt out. Totals roll up by bands of ``HEIGHT`` depths: a node gives its value only to its ancestors inside its band;
the bands' roots, with the totals of their bands, are the nodes of the next level, a tree whose depth is ``HEIGHT``
times less, and so on; completed totals then go down again, from each band's root to the band above it. So a node is
exploded at most ``HEIGHT`` times a level, and the rounds grow with the logarithm of the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .folds import joined_digests

#: Depths of a band.
HEIGHT = 8
#: Places (or values of ``turn``) of a conversation that are numbered and summed in one window.
APART = 4096
#: Members that end at a node are joined by blocks of so many ids before they meet.
IDS_APART = 4096
#: Conversations borrow from the first of so many, and at most eight turns of it.
FAMILY, BORROWED = 5, 9

LANES = ["s0", "s1", "s2", "s3"]


def ordered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv_id, piece, at, digest, size`` and pieces ``conv_id, piece, n, before``.

    ``at`` numbers the turns of a piece from 0; ``before`` counts the conversation's turns in earlier pieces.
    """
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", F.floor(F.col("turn") / APART).alias("piece"), "turn", role.alias("role"), text.alias("text"))
    inside = Window.partitionBy("conv_id", "piece").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    turns = rows.select("conv_id", "piece", (F.row_number().over(inside) - 1).cast("long").alias("at"), F.unhex(same).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    turns = written(turns, "trie-turns")
    counts = turns.groupBy("conv_id", "piece").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy(F.col("piece").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return turns, counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``conv_id, pos, digest, size, length`` of the rebuilt conversations, and ``conv_id, length`` of all of them.

    Conversation c begins with the first h turns of c - c % 5 and goes on with its own turns after its first h;
    h is crc32 of c's decimal digits, modulo 9. The first of a family is rebuilt as it is.
    """
    turns, pieces = ordered(conversations)
    pieces = written(pieces, "trie-pieces")
    c = F.col("conv_id")
    first = c - F.pmod(c, F.lit(FAMILY))
    sizes = pieces.groupBy("conv_id").agg(F.sum("n").alias("n_own"))
    bases = sizes.where(F.pmod(c, F.lit(FAMILY)) == 0).select(c.alias("base"), F.col("n_own").alias("n_base"))
    plan = sizes.select("conv_id", "n_own", first.alias("base"), F.when(c == first, 0).otherwise(F.crc32(c.cast("string").cast("binary")) % BORROWED).alias("h"))
    plan = plan.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = written(plan.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))).alias("length")), "trie-plan")
    shifts = pieces.join(plan, "conv_id").select(c.alias("_c"), F.col("piece").alias("_p"), "before", "h", "m", "length")
    placed = turns.join(shifts, F.expr("conv_id = _c AND piece <=> _p")).withColumn("own", F.col("before") + F.col("at"))
    own = placed.where("own >= h").select("conv_id", (F.col("own") - F.col("h") + F.col("m")).alias("pos"), "digest", "size", "length")
    heads = placed.where((c == first) & (F.col("own") < BORROWED - 1)).select(c.alias("base"), F.col("own").alias("pos"), "digest", "size")
    lent = plan.where("m > 0").join(heads, "base").where("pos < m").select("conv_id", "pos", "digest", "size", "length")
    return own.unionByName(lent), plan.select("conv_id", "length")


def lanes_of(pos: Column, digest: Column) -> list[Column]:
    """Four unsigned 32-bit numbers of a turn at its place; prefixes are told apart by their sums."""
    both = F.md5(F.concat(pos.cast("string").cast("binary"), F.lit(b":"), digest))
    return [F.conv(F.substring(both, 8 * i + 1, 8), 16, 10).cast("long").alias(lane) for i, lane in enumerate(LANES)]


def key_of(pos: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", pos.cast("string"), *[s.cast("string") for s in sums]).cast("binary")))


def with_keys(turns: DataFrame) -> DataFrame:
    """``turns`` with ``key``, the 128-bit key of the node of each turn's prefix, and ``parent``, the one of the turn before (null at the first)."""
    piece = F.floor(F.col("pos") / APART)
    rows = written(turns.withColumn("piece", piece).select("conv_id", "piece", "pos", "size", "length", *lanes_of(F.col("pos"), F.col("digest"))), "trie-lanes")
    inside = Window.partitionBy("conv_id", "piece").orderBy("pos")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("conv_id", "piece").agg(*[F.sum(s).alias(s) for s in LANES])
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("conv_id").alias("_c"), F.col("piece").alias("_p"), *[F.sum(s).over(earlier).alias(f"b{s}") for s in LANES])
    starts = written(starts.where("_p > 0"), "trie-starts")
    run = [F.sum(s).over(upto) for s in LANES]
    summed = rows.select("conv_id", "piece", "pos", "size", "length", *LANES, *[r.alias(f"r{s}") for r, s in zip(run, LANES, strict=True)])
    joined = summed.join(starts, F.expr("conv_id = _c AND piece = _p"), "left")
    now = [F.col(f"r{s}") + F.coalesce(F.col(f"b{s}"), F.lit(0)) for s in LANES]
    prior = [n - F.col(s) for n, s in zip(now, LANES, strict=True)]
    parent = F.when(F.col("pos") > 0, key_of(F.col("pos") - 1, prior))
    return joined.select("conv_id", "pos", "size", "length", key_of(F.col("pos"), now).alias("key"), parent.alias("parent"))


def with_ancestors(rows: DataFrame, step: int) -> DataFrame:
    """Of the rows at every ``step``-th place: ``above``, the keys above them inside their band of the level; at a band's
    root (but the first) those of the whole band above it."""
    level = rows.where(F.col("pos") % step == 0).select("conv_id", "pos", "key").withColumn("i", F.expr(f"pos div {step}"))
    piece = F.floor(F.col("i") / APART)
    tail = F.when(F.col("i") % APART >= APART - HEIGHT, F.array(piece, piece + 1)).otherwise(F.array(piece))  # the piece after it sees its last rows
    dealt = level.withColumn("own", piece).withColumn("piece", F.explode(tail))
    last = F.collect_list("key").over(Window.partitionBy("conv_id", "piece").orderBy("pos").rowsBetween(-HEIGHT, -1))
    wanted = F.when(F.col("i") == 0, 0).when(F.col("i") % HEIGHT == 0, HEIGHT).otherwise(F.col("i") % HEIGHT)
    seen = dealt.withColumn("_last", last).where("own = piece")
    return seen.select("conv_id", "pos", "key", F.slice("_last", (F.size("_last") - wanted + 1).cast("int"), wanted.cast("int")).alias("above"))


TOTALS = ["n_leaves", "saved_tokens"]


def rolled(values: DataFrame) -> DataFrame:
    """Sums of ``values`` (key, above, totals) by every key above a row and its own."""
    each = values.select(F.explode(F.array_append("above", F.col("key"))).alias("key"), *TOTALS)
    return each.groupBy("key").agg(*[F.sum(t).alias(t) for t in TOTALS])


def subtree_totals(keyed: DataFrame, own: DataFrame) -> DataFrame:
    """``key, n_leaves, saved_tokens`` over subtrees, from the nodes' own values (key, pos, n_leaves, saved_tokens)."""
    deepest = own.agg(F.max("pos")).first()[0] or 0
    places, sums, weights, step = [], [], own, 1
    while True:
        above = with_ancestors(keyed, step).groupBy("key").agg(F.first("above").alias("above"))
        nodes = written(weights.join(above, "key"), "trie-level")
        places.append(nodes.select("key", "pos", "above"))
        inside = rolled(nodes.withColumn("above", F.when(F.expr(f"pos div {step}") % HEIGHT == 0, F.array().cast("array<binary>")).otherwise(F.col("above"))))
        sums.append(written(nodes.select("key", "pos").join(inside, "key"), "trie-sums"))
        step *= HEIGHT
        weights = sums[-1].where(F.col("pos") % step == 0)
        if step > deepest:
            break
    done = weights
    for place, inside in zip(reversed(places), reversed(sums), strict=True):
        # what a band's root holds in all also counts for the whole band above it
        lifted = done.join(place.where("pos > 0").select("key", "above"), "key").select(F.explode("above").alias("key"), *TOTALS)
        lifted = lifted.groupBy("key").agg(*[F.sum(t).alias(f"up_{t}") for t in TOTALS])
        done = inside.join(lifted, "key", "left").select("key", "pos", *[(F.col(t) + F.coalesce(f"up_{t}", F.lit(0))).alias(t) for t in TOTALS])
        done = written(done, "trie-done")
    return done.select("key", *TOTALS)


def end_digests(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of rows (key, conv_id): the ids in ascending order, joined by commas."""
    blocks = ends.groupBy("key", F.floor(F.col("conv_id") / IDS_APART).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    blocks = written(blocks.select("key", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")), "trie-ends")
    spread = blocks.groupBy("key").agg(F.count("*").alias("n"), F.min("block").alias("lowest"), F.first("ids").alias("ids"))
    one = spread.where("n = 1").select("key", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    many = blocks.join(spread.where("n > 1").select("key", "lowest"), "key")
    value = F.when(F.col("block") == F.col("lowest"), F.col("ids")).otherwise(F.concat(F.lit(","), "ids")).cast("binary")
    folded = joined_digests(many.select(F.hex("key").alias("key"), "block", value.alias("ends")), ["key"], ["block"], ["ends"])
    return one.unionByName(folded.select(F.unhex("key").alias("key"), "ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations: ``conv_id`` (its smallest member), ``depth``,
    ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Turns go by ``turn``, null first; ties by role, then by text; repeated rows stay. A null role or text is an empty
    one; rows without a ``conv_id`` belong to no conversation and are left out. Texts of any length count whole, by a
    hash. Extra columns aren't read. Without conversations there is no node, not even a root. Conversations of any
    length, beginnings that any number share, and nodes with any number of children or ends are dealt out: sums are
    partly taken before a shuffle, ends meet in blocks of ids, and only the digest of one node's ends is one task's reading.
    """
    turns, all_convs = rebuilt(conversations)
    keyed = written(with_keys(turns), "trie-keyed")
    nodes = written(
        keyed.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("pos").alias("pos"), F.first("size").alias("size"), F.first("parent").alias("parent")),
        "trie-nodes",
    )
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    saved = ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")
    totals = subtree_totals(keyed, nodes.select("key", "pos", (F.col("n_children") == 0).cast("long").alias("n_leaves"), saved))
    none = F.sha2(F.lit("").cast("binary"), 256)
    ends = end_digests(keyed.where("pos = length - 1").select("key", "conv_id"))
    whole = written(nodes.join(totals, "key").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)), "trie-whole")
    everyone = all_convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))  # one row
    top = F.col("parent").isNull()
    parents = whole.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    depth = (F.col("pos") + 1).alias("depth")
    plain = ["n_convs", "n_children", *TOTALS, "ends_sha256"]
    deeper = whole.where(~top).join(parents, "parent").select("conv_id", depth, "parent_conv_id", *plain)
    firsts = whole.where(top).join(F.broadcast(everyone.select(F.col("conv_id").alias("parent_conv_id")))).select("conv_id", depth, "parent_conv_id", *plain)
    below = whole.where(top).agg(F.count("*").alias("n_children"), *[F.sum(t).alias(t) for t in TOTALS])
    silent = end_digests(all_convs.where("length = 0").select(F.lit(b"").alias("key"), "conv_id")).select("ends_sha256")
    silent = silent.agg(F.coalesce(F.max("ends_sha256"), none).alias("ends_sha256"))
    root = everyone.where("n_convs > 0").join(below).join(silent)  # one row each
    root = root.select(
        "conv_id",
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"),
        "ends_sha256",
    )
    return root.unionByName(firsts).unionByName(deeper)


def oracle() -> str:
    """The same nodes in SQL: prefixes as lists of turns; crc32 by its table, which its polynomial gives."""
    return """WITH tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
sizes AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
plan AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: ascii(substr(conv_id::VARCHAR, k, 1))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h FROM sizes, tab),
built AS (SELECT p.conv_id, CASE WHEN p.conv_id % 5 = 0 THEN p.own ELSE list_concat(coalesce(b.own, [])[1:p.h], p.own[p.h + 1:]) END AS turns FROM plan p LEFT JOIN plan b ON b.conv_id = p.conv_id - p.conv_id % 5),
pre AS (SELECT conv_id, d AS depth, turns[1:d] AS prefix, d = len(turns) AS at_end FROM built, unnest(range(0, len(turns) + 1)) u(d)),
node AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE at_end), '') AS ends FROM pre GROUP BY 1, 2),
fan AS (SELECT n.*, (SELECT count(*) FROM node c WHERE c.depth = n.depth + 1 AND c.prefix[1:n.depth] = n.prefix) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(prefix[depth].text) END AS saved FROM node n),
total AS (SELECT depth, prefix, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (
  SELECT d AS depth, prefix[1:d] AS prefix, (n_children = 0)::BIGINT AS leaf, saved FROM fan, unnest(range(0, fan.depth + 1)) u(d)) GROUP BY 1, 2)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, t.n_leaves, t.saved_tokens, sha256(f.ends) AS ends_sha256
FROM fan f JOIN total t ON t.depth = f.depth AND t.prefix = f.prefix LEFT JOIN node p ON p.depth = f.depth - 1 AND p.prefix = f.prefix[1:f.depth - 1]"""
