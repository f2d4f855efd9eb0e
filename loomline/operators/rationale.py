"""From cited phrases to criteria and verdict tensors; tensors stay long until a kernel needs them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import normalise_phrase


def explode_phrases(judgments: DataFrame, items: str = "qualities") -> DataFrame:
    """A row per cited quality: ``pair_index, ord, phrase, description, phrase_norm, winner_slot``."""
    e = judgments.select("pair_index", F.posexplode(items).alias("ord", "q"))
    return e.select("pair_index", "ord", F.col("q.phrase").alias("phrase"), F.col("q.description").alias("description"), normalise_phrase(F.col("q.phrase")).alias("phrase_norm"), F.col("q.winner").alias("winner_slot"))


def phrase_table(phrases: DataFrame, least: int = 1) -> DataFrame:
    """Citations per normalised phrase: count, first phrase, most frequent description (ties: seen first), share kept."""
    seen = F.struct("pair_index", "ord")
    per = phrases.groupBy("phrase_norm", "description").agg(F.count("*").alias("n"), F.min(seen).alias("seen"), F.min(F.struct(seen.alias("at"), "phrase")).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), "seen", "description")).alias("best")
    out = per.groupBy("phrase_norm").agg(F.sum("n").alias("n_cited"), F.min("first").alias("first"), best)
    return out.filter(F.col("n_cited") >= least).select("phrase_norm", "n_cited", F.col("first.phrase").alias("phrase"), F.col("best.description").alias("description"))


def place(phrases: DataFrame, members: DataFrame, rule: str = "last", rest: str = "self") -> DataFrame:
    """Criterion of each distinct ``phrase_norm`` by ``members`` (``phrase_norm, criterion, ord``).

    ``rule``: the ``first`` or ``last`` placement wins. ``rest``: phrases without one become their own criterion
    (``self``), go to ``Other`` (``other``) or stay without (``none``).
    """
    pick = F.min_by if rule == "first" else F.max_by
    chosen = members.groupBy("phrase_norm").agg(pick("criterion", "ord").alias("criterion"))
    out = phrases.select("phrase_norm").distinct().join(chosen, "phrase_norm", "left")
    fill = {"self": F.col("phrase_norm"), "other": F.lit("Other"), "none": F.lit(None)}[rest]
    return out.select("phrase_norm", F.coalesce("criterion", fill).alias("criterion"))


def joined_groups(replies: DataFrame) -> DataFrame:
    """Members of a taxonomy and its repairs with the order in which they were placed: ``entry, criterion, reply, ord``.

    ``replies`` has ``reply`` (0 for the taxonomy, 1 and on for repairs), ``grp`` and ``place`` (the group's and the
    member's place in the reply), ``criterion`` and ``entry``. Groups of one name are one group, at the place where the
    name came up first; a repair's members follow those that are there.
    """
    first = replies.groupBy("criterion").agg(F.min(F.struct("reply", "grp")).alias("at"))
    return replies.join(first, "criterion").select("entry", "criterion", "reply", F.struct("at", "reply", "grp", "place").alias("ord"))


def repaired(replies: DataFrame, entries: DataFrame) -> DataFrame:
    """``entry, before, after, change``: where the taxonomy alone and with its repairs puts each of ``entries``.

    The last placement wins (see ``joined_groups``). ``change`` is kept, moved, added or left out (placed by no reply);
    members that are no entry come out as invented, with their criteria.
    """
    members = joined_groups(replies)
    last = lambda rows, name: rows.groupBy("entry").agg(F.max_by("criterion", "ord").alias(name))
    known = entries.select("entry", F.lit(True).alias("known"))
    out = known.join(last(members, "after"), "entry", "full").join(last(members.filter("reply = 0"), "before"), "entry", "left")
    change = F.when(F.col("known").isNull(), "invented").when(F.col("after").isNull(), "left out").when(F.col("before").isNull(), "added").when(F.col("before") == F.col("after"), "kept").otherwise("moved")
    return out.select("entry", "before", "after", change.alias("change"))


def active_criteria(cited: DataFrame, floor: float = 0.05) -> DataFrame:
    """Criteria whose share of comparison-level citations is at least ``floor``: number by share, mentions, share.

    ``cited``: ``pair_index, criterion`` in any multiplicity. Equal shares are ordered by name.
    """
    n = cited.filter("criterion is not null").select("pair_index", "criterion").distinct().groupBy("criterion").agg(F.count("*").alias("mentions"))
    n = n.withColumn("share", F.col("mentions") / F.sum("mentions").over(W.partitionBy()))
    n = n.filter(F.col("share") >= floor)
    return n.withColumn("k", F.row_number().over(W.orderBy(F.desc("share"), "criterion")) - 1)


def verdict_tensor(cited: DataFrame) -> DataFrame:
    """Non-zero entries ``pair_index, criterion, x``: the sign of A citations minus B citations of a pair's criterion."""
    s = F.sum(F.when(F.col("winner_slot") == "A", 1).when(F.col("winner_slot") == "B", -1).otherwise(0))
    return cited.filter("criterion is not null").groupBy("pair_index", "criterion").agg(F.signum(s).cast("int").alias("x")).filter("x <> 0")


def won_and_cited(pairs: DataFrame, tensor: DataFrame) -> DataFrame:
    """How often an item won a comparison that cites a criterion: ``item, criterion, n``."""
    won = pairs.select("pair_index", F.when(F.col("winner_slot") == "A", F.col("first")).otherwise(F.col("other")).alias("item"))
    return tensor.select("pair_index", "criterion").distinct().join(won, "pair_index").groupBy("item", "criterion").agg(F.count("*").alias("n"))


def grouping_faults(members: DataFrame, entries: DataFrame) -> DataFrame:
    """Faults of a grouping of ``entries`` (``entry, judge, name``) into ``members`` (``cluster, entry, judge, name``).

    ``fault, entry`` rows: an entry left out, invented, placed twice, misquoted, or a judge twice in a cluster.
    """
    placed = members.groupBy("entry").agg(F.count("*").alias("n"))
    e, m = entries.alias("e"), members.alias("m")
    out = entries.join(placed, "entry", "left_anti").select(F.lit("left out").alias("fault"), "entry")
    out = out.unionByName(members.join(entries, "entry", "left_anti").select(F.lit("invented").alias("fault"), "entry").distinct())
    out = out.unionByName(placed.filter("n > 1").select(F.lit("placed twice").alias("fault"), "entry"))
    wrong = m.join(e, F.col("m.entry") == F.col("e.entry")).filter(~(F.col("m.judge").eqNullSafe(F.col("e.judge")) & F.col("m.name").eqNullSafe(F.col("e.name"))))
    out = out.unionByName(wrong.select(F.lit("misquoted").alias("fault"), F.col("m.entry").alias("entry")).distinct())
    twice = members.groupBy("cluster", "judge").agg(F.count("*").alias("n"), F.min("entry").alias("entry")).filter("n > 1")
    return out.unionByName(twice.select(F.lit("judge twice").alias("fault"), "entry"))
