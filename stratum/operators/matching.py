"""Entity matching: mentions, near-duplicate names, ranking, sampling within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


# Words that say nothing about what a label means.
STOP_WORDS = ("the", "and", "for", "with", "from", "our", "new", "per", "into", "that", "this")


def label(name: Column) -> Column:
    """Lower case, ASCII letters and digits and everything beyond ASCII kept, all else one space."""
    return F.trim(F.regexp_replace(F.lower(name), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def meaningful(name: Column) -> Column:
    """The different words of a label that have more than two bytes and are no stop words."""
    return F.array_distinct(F.filter(F.split(name, " "), lambda w: (F.octet_length(w) > 2) & ~w.isin(*STOP_WORDS)))


def name_score(a: Column, b: Column) -> Column:
    """Of two labels: 1.0 for equal ones, 0.85 where one of three bytes or more stands in the other as whole words, else the Jaccard similarity of their meaningful words."""
    x, y = meaningful(a), meaningful(b)
    both = F.size(F.array_intersect(x, y))
    jaccard = F.when(both > 0, both / F.size(F.array_union(x, y))).otherwise(0.0)
    spaced = lambda s: F.concat(F.lit(" "), s, F.lit(" "))
    holds = lambda s, t: (F.octet_length(t) >= 3) & spaced(s).contains(spaced(t))
    return F.when(a == b, 1.0).when(holds(a, b) | holds(b, a), 0.85).otherwise(jaccard)


def match_labels(labels: DataFrame, capabilities: DataFrame, *, threshold: float = 0.6, cross: float = 0.8) -> DataFrame:
    """Per (label, family) the best capability (name, family, and where there are any aliases) by its name or an alias; another family's score counts less.

    Under the threshold none: the label becomes a capability of its own.  Any
    score above 0 shares a word, so candidates are joined by words.  Of equal
    scores the own family's wins, then the first name.
    """
    words = lambda c: F.explode(F.array_distinct(F.split(F.col(c), " ")))
    aliases = F.array(F.col("name")) if "aliases" not in capabilities.columns else F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array(F.col("name")))
    own = labels.select("label", F.col("family").alias("label_family")).distinct()
    a = own.withColumn("norm", F.coalesce(F.nullif(label(F.col("label")), F.lit("")), F.lit("unspecified")))
    b = capabilities.select("name", F.col("family").alias("name_family"), F.explode(aliases).alias("alias")).withColumn("alias", label(F.col("alias"))).where("alias <> ''")
    pairs = a.withColumn("word", words("norm")).join(b.withColumn("word", words("alias")), "word").drop("word").distinct()
    mine = F.col("label_family") == F.col("name_family")
    score = name_score(F.col("norm"), F.col("alias")) * F.when(mine, 1.0).otherwise(cross)
    # the largest of (score, own family) by that pair, and of these the first name
    scored = pairs.withColumns({"score": score, "mine": mine}).groupBy("label", "label_family", "score", "mine").agg(F.min("name").alias("name"))
    best = scored.groupBy("label", "label_family").agg(F.max(F.struct("score", "mine", "name")).alias("m")).select("label", "label_family", "m.score", "m.name")
    d = own.join(best, ["label", "label_family"], "left")
    on = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return d.select("label", "label_family", F.when(on, F.col("name")).alias("name"), F.coalesce("score", F.lit(0.0)).alias("score"), (~on).alias("synthesize"))


def near_names(names: DataFrame, *, name: str = "name") -> DataFrame:
    """Pairs of normalized names of three letters or more that are one edit apart; joined by what is left when one letter goes, so no pair is missed."""
    n = names.select(normalized(F.col(name)).alias("n")).where("length(n) >= 3").distinct()
    cuts = F.transform(F.sequence(F.lit(1), F.length("n")), lambda i: F.concat(F.substring("n", 1, 0), F.substr("n", F.lit(1), i - 1), F.substr("n", i + 1)))
    keys = n.select("n", F.explode(F.array_distinct(F.array_append(cuts, F.col("n")))).alias("key"))
    a, b = keys.alias("a"), keys.alias("b")
    return a.join(b, F.expr("a.key = b.key and a.n < b.n")).select(F.col("a.n").alias("one"), F.col("b.n").alias("other")).distinct().where(F.levenshtein("one", "other") <= 1)


#: Aliases that are sent to all tasks at most; beyond, the join shuffles.
BROADCAST_ALIASES = 20_000


def mentions(docs: DataFrame, aliases: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines of each document that mention an alias as whole words, counted per document and entity.

    Words of a line (kept with the line's place, not its text) meet the
    aliases' first words, which are broadcast where they are few; only lines
    that have one are looked at again, for the whole alias.
    """
    al = aliases.select("entity", normalized(F.col("alias")).alias("alias")).where("alias <> ''").withColumn("word", F.split_part("alias", F.lit(" "), F.lit(1))).distinct()
    firsts = al.groupBy("word").agg(F.collect_set(F.struct("entity", "alias")).alias("own"))
    if firsts.count() <= BROADCAST_ALIASES:
        firsts = F.broadcast(firsts)
    line = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    line = line.withColumn("norm", F.concat(F.lit(" "), normalized(F.col("line")), F.lit(" "))).drop("line")
    # a line's words are looked up where it stands; the line goes on only if one of them is a first word
    hit = line.withColumn("word", F.explode(F.array_distinct(F.split(F.trim("norm"), " ")))).join(firsts, "word")
    found = hit.select("doc_id", "line_no", F.explode(F.filter("own", lambda a: F.col("norm").contains(F.concat(F.lit(" "), a["alias"], F.lit(" "))))).alias("a"))
    return found.select("doc_id", "line_no", "a.entity").distinct().groupBy("doc_id", "entity").agg(F.count("*").alias("lines"))


def merged_names(names: DataFrame, *, name: str = "name", count: str = "n") -> DataFrame:
    """Names that are one edit apart fold into one: per normalized name the one that its group keeps, and the group's count.

    Groups are the connected ones; a group keeps its most frequent name, the
    first of equals.
    """
    from .graph import bsp

    own = names.groupBy(normalized(F.col(name)).alias("id")).agg(F.sum(count).alias("n")).where("id <> ''")
    pairs = near_names(own.select(F.col("id").alias("name")))
    edges = pairs.select(F.col("one").alias("src"), F.col("other").alias("dst"))

    def step(active: DataFrame, _: int) -> tuple[DataFrame, DataFrame]:
        least = F.array_min(F.array_append("Inbox", F.col("root")))
        d = active.withColumn("__new", F.when(F.col("root") == "", F.col("id")).otherwise(least))
        d = d.withColumn("__new", F.least("__new", F.coalesce(F.array_min("Inbox"), F.col("__new")))).where("root = '' or __new < root")
        return d.withColumn("root", F.col("__new")), d.select(F.lit("").alias("to"), F.col("id").alias("from"), F.col("__new").alias("body"), F.lit(0.0).alias("rank"))

    near = own.join(edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct(), "id", "left_semi")
    roots = bsp(near.withColumn("root", F.lit("")), edges, step, max_rounds=1000).vertices.select("id", "root")
    d = own.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    kept = d.groupBy("root").agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    first = d.join(kept, "root").where("n = top").groupBy("root").agg(F.min("id").alias("kept"), F.max("total").alias("n"))
    return d.select(F.col("id").alias("name"), "root").join(first, "root").select("name", "kept", "n")


def rank_and_keep(days: DataFrame, *, group: str, name: str, day: str, top: int, min_days: int) -> DataFrame:
    """Per group the names seen on most days (at least min_days), the best `top`, with slugs p01, p02, ..."""
    d = days.groupBy(group, name).agg(F.countDistinct(day).alias("days")).where(F.col("days") >= min_days)
    w = Window.partitionBy(group).orderBy(F.col("days").desc(), name)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).withColumn("slug", F.concat(F.lit("p"), F.lpad(F.col("rank").cast("string"), 2, "0")))


def last_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The n first rows of each group in an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def stride_sample(df: DataFrame, group: str, stride: int, *order: str) -> DataFrame:
    """Every stride-th row of each group, and always its last."""
    up, down = Window.partitionBy(group).orderBy(*order), Window.partitionBy(group)
    d = df.withColumns({"__n": F.row_number().over(up), "__all": F.count("*").over(down)})
    return d.where(((F.col("__n") - 1) % stride == 0) | (F.col("__n") == F.col("__all"))).drop("__n", "__all")


def first_of(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def distinct_labels(df: DataFrame, label: str, function: str, space: str) -> DataFrame:
    """Normalized labels per function: how often, and in which spaces."""
    return df.groupBy(F.col(function).alias("function"), normalized(F.col(label)).alias("label")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(space)).alias("spaces"))


def top_axes(shares: DataFrame, group: str, axis: str, weight: str, *, floor: float = 0.05, keep: int = 4) -> DataFrame:
    """Per group the heaviest axes with a share of floor or more, at most keep, their shares renormalized."""
    total = F.sum(weight).over(Window.partitionBy(group))
    d = shares.withColumn("share", F.col(weight) / total).where(F.col("share") >= floor)
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col("share").desc(), axis))).where(F.col("rank") <= keep)
    return d.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy(group))).select(group, axis, "rank", "share")
