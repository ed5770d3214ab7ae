"""A ledger of findings: questions, keys, lookup tiers, admission, revisions, corroboration, conflicts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

# How long an answer of each volatility stays fresh, in hours (none: for ever).
HORIZON_HOURS = {"static": None, "slow": 30 * 24, "daily": 24, "hourly": 1, "live": 0}

NEAR_THRESHOLD = 0.92
LEAST_THRESHOLD = 0.80


def normalize_text(text: Column) -> Column:
    """Lower case, white space as one space, no closing ` ?.!:;,`."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), r"[ ?.!:;,]+$", "")


def normalize_facets(facets: Column) -> Column:
    """Sorted `key=value` texts, lower case and trimmed; empty keys go."""
    named = F.filter(F.map_entries(facets), lambda e: F.trim(e["key"]) != "")
    pairs = F.transform(named, lambda e: F.concat(F.lower(F.trim(e["key"])), F.lit("="), F.lower(F.trim(e["value"]))))
    return F.coalesce(F.array_sort(pairs), F.array().cast("array<string>"))


def normalize_needs(needs: Column) -> Column:
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform(needs, lambda x: F.lower(F.trim(x))), lambda x: x != ""))), F.array().cast("array<string>"))


def question_key(topic: Column, text: Column, facets: Column) -> Column:
    """Of topic, text and facets; what a question needs is not part of it."""
    return F.sha2(F.concat_ws("\x1f", F.lower(F.trim(topic)), normalize_text(text), F.array_join(normalize_facets(facets), "\x1e")).cast("binary"), 256)


def class_key(topic: Column, facets: Column) -> Column:
    """Of topic and facets; empty where there are no facets."""
    own = normalize_facets(facets)
    return F.when(F.size(own) > 0, F.sha2(F.concat_ws("\x1f", F.lower(F.trim(topic)), F.array_join(own, "\x1e")).cast("binary"), 256)).otherwise("")


def knowledge_hash(topic: Column, answer: Column, fields: Column, covers: Column, no_evidence: Column) -> Column:
    """What a finding says, whenever it was learned."""
    said = F.to_json(F.struct(F.lower(F.trim(topic)).alias("topic"), normalize_text(answer).alias("answer"), F.array_sort(F.map_entries(fields)).alias("fields"), normalize_needs(covers).alias("covers"), F.coalesce(no_evidence, F.lit(False)).alias("no_evidence")))
    return F.sha2(said.cast("binary"), 256)


def horizon_hours(volatility: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, hours in HORIZON_HOURS.items():
        if hours is not None:
            out = F.when(volatility == name, F.lit(float(hours))).otherwise(out)
    return out


def heads(revisions: DataFrame) -> DataFrame:
    """The newest revision of each finding."""
    w = Window.partitionBy("finding_id").orderBy(F.col("rev").desc(), F.col("seq").desc())
    return revisions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def live_heads(revisions: DataFrame) -> DataFrame:
    """Heads that are not retracted."""
    return heads(revisions).where("not coalesce(retracted, false)")


def corroborated(entries: DataFrame) -> DataFrame:
    """Entries that say the same in the same class as one: the first by seq, how often it was learned again, and every question that it answers."""
    return entries.groupBy("knowledge", "class").agg(F.min_by("hash", "seq").alias("hash"), F.min("seq").alias("seq"), (F.count("*") - 1).alias("corroborations"), F.array_sort(F.collect_set("question_key")).alias("aliases"))


@dataclass(frozen=True)
class Policy:
    min_sources: int = 0
    min_confidence: float = 0.0
    grants: tuple[str, ...] = ()
    scope: str = ""


def admissible(policy: Policy, now: Column) -> Column:
    """Reachable, visible, fresh, covering the needs, supported, confident: in this order; the first that fails is the verdict, else admit.

    Over columns requires, scope, learned, volatility, covers, needs, sources,
    corroborations, confidence.
    """
    grants = F.array(*[F.lit(g) for g in policy.grants]).cast("array<string>")
    age = (now.cast("double") - F.col("learned").cast("double")) / 3600
    horizon = horizon_hours(F.col("volatility"))
    empty = F.array().cast("array<string>")
    return (
        F.when(F.size(F.array_except(F.coalesce("requires", empty), grants)) > 0, "unreachable")
        .when((F.coalesce("scope", F.lit("")) != "") & (F.col("scope") != policy.scope), "invisible")
        .when(horizon.isNotNull() & (age > horizon), "stale")
        .when(F.size(F.array_except(F.coalesce("needs", empty), F.coalesce("covers", empty))) > 0, "gap")
        .when(F.size(F.coalesce("sources", empty)) + F.coalesce("corroborations", F.lit(0)) < policy.min_sources, "unsupported")
        .when(F.coalesce("confidence", F.lit(0.0)) < policy.min_confidence, "unsure")
        .otherwise("admit")
    )


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    size = norm(a) * norm(b)
    return F.when(size > 0, dot / size).otherwise(0.0)


def nearest(queries: DataFrame, entries: DataFrame, *, k: int = 3, floor: float = NEAR_THRESHOLD, group: str = "class", id_col: str = "vec_id", vector: str = "embedding", salts: int = 16) -> DataFrame:
    """Per query of the same group its k nearest other vectors with a cosine of floor or more.

    Queries are a stated, smaller side.  Entries are salted, so that a large
    group is met by several tasks; each keeps k per query, and the best of these
    are taken.  The join is on (group, salt).
    """
    e = entries.select(F.col(group).alias("g"), F.col(id_col).alias("neighbor"), F.col(vector).alias("ev")).withColumn("salt", F.pmod(F.xxhash64("neighbor"), F.lit(salts)))
    q = queries.select(F.col(group).alias("g"), F.col(id_col).alias("query"), F.col(vector).alias("qv")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = q.join(e, ["g", "salt"]).where("query <> neighbor").select("query", "neighbor", "salt", cosine(F.col("qv"), F.col("ev")).alias("similarity")).where(F.col("similarity") >= floor)
    top = lambda *by: Window.partitionBy(*by).orderBy(F.col("similarity").desc(), "neighbor")
    local = pairs.withColumn("__n", F.row_number().over(top("query", "salt"))).where(F.col("__n") <= k)
    return local.withColumn("rank", F.row_number().over(top("query"))).where(F.col("rank") <= k).select("query", "neighbor", "similarity", "rank")


def lookup(questions: DataFrame, entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per question the tier that answers it and the entry: exact by its key, else its class (newest entry), else none."""
    own = entries.select("hash", "class", "seq")
    exact = aliases.join(own, "hash").groupBy("question_key").agg(F.max_by("hash", "seq").alias("exact_hash"))
    by_class = own.where("class <> ''").groupBy("class").agg(F.max_by("hash", "seq").alias("class_hash"))
    d = questions.join(exact, "question_key", "left").join(by_class, "class", "left")
    return d.withColumn("hash", F.coalesce("exact_hash", "class_hash")).withColumn("tier", F.when(F.col("exact_hash").isNotNull(), "exact").when(F.col("class_hash").isNotNull(), "class").otherwise("miss")).drop("exact_hash", "class_hash")


def consult(questions: DataFrame, revisions: DataFrame, aliases: DataFrame, policy: Policy, now: Column, *, near: DataFrame | Callable[[DataFrame, DataFrame], DataFrame] | None = None, thresholds: DataFrame | None = None) -> DataFrame:
    """Per question the first tier that has a sufficient entry, and that entry: exact, class, near, else miss.

    questions: question_key, class, needs.  Only current revisions that are not
    retracted serve, and only those that the policy admits and that cover what
    the question needs.  The exact tier goes by the key or an alias, the class
    tier by the class where it has facets; both take the newest.  near:
    (question_key, hash, similarity) candidates and, where a judge has ruled,
    `ok`; they count from the entry's own threshold on, within the class, and
    the most similar is taken.  It may be a function that gives the candidates
    of the questions (question_key, class, needs) that the tiers before it
    leave open, among the entries (hash, class, seq, covers) that serve.

    Admission by the entry alone comes first, before revisions are dealt by
    their finding; of the entries of a key or a class that cover the same only
    the newest is met by questions.
    """
    judged = revisions.withColumn("needs", F.array().cast("array<string>"))
    judged = judged.select("finding_id", "rev", "seq", "hash", "class", "retracted", F.array_sort(F.array_distinct("covers")).alias("covers"), (admissible(policy, now) == "admit").alias("__admitted"))
    live = materialize(live_heads(judged).where("__admitted").select("hash", "class", "seq", "covers"))
    asked = questions.select("question_key", "class", F.coalesce("needs", F.array().cast("array<string>")).alias("needs")).dropDuplicates(["question_key"])
    covered = F.size(F.array_except("needs", "covers")) == 0
    newest = F.max_by("hash", F.struct("seq", "hash"))
    newest_of = lambda d, by: d.groupBy(by, "covers").agg(F.max(F.struct("seq", "hash")).alias("e")).select(by, "covers", "e.seq", "e.hash")
    by_key = newest_of(aliases.select("question_key", "hash").join(live.drop("class"), "hash"), "question_key")
    exact = asked.join(by_key, "question_key").where(covered).groupBy("question_key").agg(newest.alias("exact_hash"))
    of_class = newest_of(live.where("class <> ''"), "class")
    same = asked.join(of_class, "class").where(covered).groupBy("question_key").agg(newest.alias("class_hash"))
    found = exact.join(same, "question_key", "full")
    if near is not None:
        found = materialize(found)
    d = questions.join(found, "question_key", "left")
    if near is None:
        d = d.withColumn("near_hash", F.lit(None).cast("string"))
    else:
        left = asked.join(found, "question_key", "left_anti")
        near = near(left, live) if callable(near) else near
        n = near.join(left.withColumnRenamed("class", "asked_class"), "question_key").join(live, "hash").where((F.col("class") == F.col("asked_class")) & covered)
        own = n.join(thresholds, "hash", "left") if thresholds is not None else n.withColumn("threshold", F.lit(None).cast("double"))
        own = own.where(F.col("similarity") >= F.coalesce("threshold", F.lit(NEAR_THRESHOLD)))
        if "ok" in near.columns:
            own = own.where(F.coalesce("ok", F.lit(False)))
        d = d.join(own.groupBy("question_key").agg(F.max_by("hash", F.struct("similarity", "seq", "hash")).alias("near_hash")), "question_key", "left")
    tier = F.when(F.col("exact_hash").isNotNull(), "exact").when(F.col("class_hash").isNotNull(), "class").when(F.col("near_hash").isNotNull(), "near").otherwise("miss")
    return d.withColumns({"tier": tier, "hash": F.coalesce("exact_hash", "class_hash", "near_hash")}).drop("exact_hash", "class_hash", "near_hash")


def candidates(questions: DataFrame, revisions: DataFrame, aliases: DataFrame, limit: int = 32) -> DataFrame:
    """Per question the newest live entries that are filed under its key or its class, `limit` at most, with their rank.

    Each key and class is cut to its newest before questions meet it.
    """
    live = live_heads(revisions).select("hash", "class", "seq")
    newest = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("seq").desc(), "hash"))
    by_key = aliases.select("question_key", "hash").distinct().join(live.drop("class"), "hash").withColumn("__n", newest("question_key")).where(F.col("__n") <= limit)
    by_class = live.where("class <> ''").withColumn("__n", newest("class")).where(F.col("__n") <= limit)
    asked = questions.select("question_key", "class").distinct()
    found = asked.join(by_key.drop("__n"), "question_key").select("question_key", "hash", "seq").union(asked.join(by_class.drop("__n"), "class").select("question_key", "hash", "seq")).distinct()
    return found.withColumn("rank", newest("question_key")).where(F.col("rank") <= limit)


def coverage_gap(needs: Column, covers: Column) -> Column:
    return F.array_except(F.coalesce(needs, F.array().cast("array<string>")), F.coalesce(covers, F.array().cast("array<string>")))


def best_partial(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """Per question the entry of its class with the smallest gap that is neither empty nor all of its needs."""
    newest = entries.groupBy("class", "covers").agg(F.max(F.struct("seq", "hash")).alias("e")).select("class", "e.hash", "covers", "e.seq")
    d = questions.select("question_key", "class", "needs").join(newest, "class").withColumn("gap", coverage_gap(F.col("needs"), F.col("covers")))
    d = d.where("size(gap) > 0 and size(gap) < size(needs)")
    w = Window.partitionBy("question_key").orderBy(F.size("gap"), F.col("seq").desc())
    return d.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("question_key", "hash", "gap")


def merge_answers(partial: Column, fresh: Column) -> Column:
    """Fields of both; fresh ones win."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(partial), lambda e: ~F.map_contains_key(fresh, e["key"])), F.map_entries(fresh)))


def claims(entries: DataFrame) -> DataFrame:
    """One live claim per class and knowledge: of the current revisions that are not retracted the newest."""
    live = live_heads(entries)
    return live.groupBy("class", "knowledge").agg(F.max(F.struct("seq", "hash", "covers")).alias("e")).select("class", "knowledge", "e.hash", "e.seq", "e.covers")


def conflicts(entries: DataFrame) -> DataFrame:
    """Pairs of claims of one class that say different things about something that both cover; joined by (class, covered name)."""
    each = claims(entries).select("class", "hash", "seq", "knowledge", F.explode("covers").alias("cover"))
    a, b = each.alias("a"), each.alias("b")
    newer = "(a.seq > b.seq or a.seq = b.seq and a.hash > b.hash)"
    return a.join(b, F.expr(f"a.class = b.class and a.cover = b.cover and a.knowledge <> b.knowledge and {newer}")).select(F.col("a.class").alias("class"), F.col("a.hash").alias("one"), F.col("b.hash").alias("other")).distinct()


def conflict_counts(entries: DataFrame) -> DataFrame:
    """How many pairs `conflicts` has per class, from counts of claims that cover the same; no pair of claims is made."""
    kinds = claims(entries).select("class", F.array_sort(F.array_distinct("covers")).alias("covers")).where("size(covers) > 0").groupBy("class", "covers").agg(F.count("*").alias("n"))
    a, b = kinds.alias("a"), kinds.alias("b")
    pairs = a.join(b, F.expr("a.class = b.class and arrays_overlap(a.covers, b.covers) and a.covers <= b.covers"))
    n = F.expr("case when a.covers = b.covers then (a.n * (a.n - 1)) div 2 else a.n * b.n end")
    return pairs.groupBy(F.col("a.class").alias("class")).agg(F.sum(n).alias("pairs")).where("pairs > 0")


def retract(revisions: DataFrame, citations: DataFrame, finding_id: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(revisions with a retracted head for the finding, everyone who was served any of its revisions)."""
    own = revisions.where(F.col("finding_id") == finding_id)
    head = heads(own)
    top = revisions.agg(F.max("seq")).first()[0] or 0
    new = head.withColumns({"rev": F.col("rev") + 1, "seq": F.lit(top + 1).cast("bigint"), "retracted": F.lit(True), "supersedes": F.col("hash"), "hash": F.sha2(F.concat_ws("|", "hash", F.lit("retracted"), F.lit(reason)).cast("binary"), 256)})
    told = citations.join(own.select("hash").distinct(), "hash", "left_semi")
    return revisions.unionByName(new.select(*revisions.columns)), told


def learned_threshold(verdicts: DataFrame, start: float = NEAR_THRESHOLD) -> DataFrame:
    """Per entry its threshold after its verdicts in order.

    An accepted similarity under it lowers it (not under 0.80); a rejected one
    at or over it raises it just above.  Similarities outside (0, 1] teach
    nothing, nor do those on the side that the threshold already decides.
    """
    own = F.array_sort(F.collect_list(F.struct("decided", "similarity", "ok")))

    def step(t: Column, v: Column) -> Column:
        s = v["similarity"]
        down, up = F.greatest(s, F.lit(LEAST_THRESHOLD)), F.least(s + 0.01, F.lit(1.0))
        return F.when((s <= 0) | (s > 1) | (v["ok"] == (s >= t)), t).when(v["ok"], down).otherwise(up)

    return verdicts.groupBy("hash").agg(F.aggregate(own, F.lit(start), step).alias("threshold"))


def judge_worth(entries: DataFrame, judge_cost: float, factor: float = 3.0) -> DataFrame:
    """Topics where a judge pays: the mean cost of an answer is factor times the judge's or more."""
    return entries.groupBy("topic").agg(F.avg("cost_usd").alias("mean_usd")).withColumn("judge", F.col("mean_usd") >= judge_cost * factor)


def coalesce_askers(askers: DataFrame, fetch) -> DataFrame:
    """One fetch per distinct flight key, its answer joined back to every asker; who fetched and who waited."""
    w = Window.partitionBy("flight").orderBy("asker")
    marked = askers.withColumn("origin", F.when(F.row_number().over(w) == 1, "fresh").otherwise("coalesced"))
    return marked.join(fetch(askers.select("flight").distinct()), "flight", "left")


# Names of arguments that hold a tool's question, the likeliest first.
TEXT_ARGS = ("query", "question", "q", "search", "prompt", "text", "input", "url", "uri")


def tool_question(args: Column, topic: str) -> Column:
    """The question of a tool call as a struct of its text and keys: the first argument of a question's name that is not blank, else the only argument that is not; all others are facets.  Null where there is none."""
    filled = F.map_filter(args, lambda _, v: F.trim(v) != "")
    alone = F.when(F.size(filled) == 1, F.element_at(F.map_keys(filled), 1))
    name = F.coalesce(*[F.when(F.map_contains_key(filled, F.lit(n)), n) for n in TEXT_ARGS], alone)
    text = F.element_at(args, name)
    facets = F.map_filter(args, lambda k, _: k != name)
    asked = F.struct(text.alias("text"), question_key(F.lit(topic), text, facets).alias("question_key"), class_key(F.lit(topic), facets).alias("class"))
    return F.when(name.isNotNull(), asked)


def guard(calls: DataFrame, tool: Callable[[Column], Column], revisions: DataFrame, aliases: DataFrame, policy: Policy, now: Column, *, name: str, needs: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(calls with text, origin and finding, new revisions): a tool whose calls are looked up before they are made.

    calls: asker (tells calls apart) and args, a map of texts.  Revisions also
    hold `answer` and `topic`.  A call without a question goes to the tool
    (`direct`).  Of the calls that nothing in the ledger answers, those of one
    class (of one question, where there are no facets) share one fetch, made
    with the arguments of the first asker.  An empty answer is learned too, as
    no evidence.
    """
    wanted = F.array(*[F.lit(n) for n in needs]).cast("array<string>")
    asked = calls.withColumn("__q", tool_question(F.col("args"), name))
    none = F.lit(None).cast("string")
    direct = asked.where("__q is null").select(*calls.columns, tool(F.col("args")).alias("text"), F.lit("direct").alias("origin"), none.alias("finding"))
    own = asked.where("__q is not null").select(*calls.columns, F.col("__q.question_key").alias("question_key"), F.col("__q.class").alias("class"), wanted.alias("needs"))
    got = consult(own, revisions, aliases, policy, now)
    said = revisions.select("hash", F.col("answer").alias("text")).dropDuplicates(["hash"])
    served = got.where("tier <> 'miss'").join(said, "hash").select(*calls.columns, "text", F.col("tier").alias("origin"), F.col("hash").alias("finding"))
    missed = got.where("tier = 'miss'").withColumn("flight", F.when(F.col("class") != "", F.col("class")).otherwise(F.col("question_key")))
    # maps have no order, so the first asker's arguments come by its place
    firsts = missed.groupBy("flight").agg(F.min_by(F.struct("asker", "args", "question_key", "class"), "asker").alias("first"))
    firsts = firsts.withColumn("text", tool(F.col("first.args"))).withColumn("no_evidence", F.coalesce(F.trim("text") == "", F.lit(True)))
    empty = F.create_map().cast("map<string,string>")
    told = firsts.withColumn("hash", knowledge_hash(F.concat_ws("/", F.lit(name), "flight"), F.coalesce("text", F.lit("")), empty, wanted, F.col("no_evidence")))
    told = materialize(told)
    origin = F.when(F.col("asker") == F.col("first.asker"), "fresh").otherwise("coalesced")
    fetched = missed.drop("hash").join(told.select("flight", "first", "text", "hash"), "flight").select(*calls.columns, "text", origin.alias("origin"), F.col("hash").alias("finding"))
    learned = told.select(
        "hash", F.col("flight").alias("finding_id"), F.lit(1).alias("rev"), F.lit(0).cast("bigint").alias("seq"), F.col("first.class").alias("class"), F.col("first.question_key").alias("question_key"),
        F.lit(name).alias("topic"), F.col("text").alias("answer"), "no_evidence", wanted.alias("covers"), F.array(F.lit(name)).alias("sources"), now.alias("learned"),
    )
    return direct.unionByName(served).unionByName(fetched), learned


def topic_stats(entries: DataFrame) -> DataFrame:
    return entries.groupBy("topic").agg(F.count("*").alias("entries"), F.count_if(~F.coalesce("retracted", F.lit(False))).alias("live"), F.count_if(F.coalesce("no_evidence", F.lit(False))).alias("no_evidence"), F.sum("cost_usd").alias("cost_usd"))
