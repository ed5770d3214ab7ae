"""Iterative computation over vertices and messages: BSP, refinement, beam search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import strip
from ..storage import materialize

MESSAGE = "to string, from string, body string, rank double"
RESERVED = ("Inbox", "Senders")


@dataclass
class Round:
    number: int
    active: int = 0
    delivered: int = 0
    quiesced: int = 0
    grown: int = 0
    dropped: int = 0
    truncated: int = 0


@dataclass
class Iterated:
    vertices: DataFrame
    rounds: list[Round] = field(default_factory=list)
    halt: str = ""


def canonical(messages: DataFrame) -> Window:
    """The order of messages to one vertex: rank down, then sender, then body."""
    return Window.partitionBy("to").orderBy(F.col("rank").desc(), F.col("from"), F.col("body"))


def cap(messages: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(the n best messages to each vertex, those dropped); ties in canonical order."""
    ranked = messages.withColumn("__n", F.row_number().over(canonical(messages)))
    return ranked.where(F.col("__n") <= n).drop("__n"), ranked.where(F.col("__n") > n).drop("__n")


def edges_from_field(vertices: DataFrame, name: str, *, id_col: str = "id") -> DataFrame:
    return vertices.select(F.col(id_col).cast("string").alias("src"), F.explode(F.col(name).cast("array<string>")).alias("dst")).where("dst is not null and dst <> ''")


def messages_from_field(rows: DataFrame, name: str, rank: Column | None = None, *, id_col: str = "id") -> DataFrame:
    """Each text of a list field as a message without an address."""
    body = F.explode(F.col(name).cast("array<string>")).alias("body")
    return rows.select(F.lit("").alias("to"), F.col(id_col).cast("string").alias("from"), body, (rank if rank is not None else F.lit(0.0)).cast("double").alias("rank")).where("trim(body) <> ''")


def targets(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Edges as they are, or with their reverses, without repeats."""
    e = edges.select("src", "dst")
    return (e if directed else e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))).distinct()


def route(steps: DataFrame, edges: DataFrame, *, directed: bool = False, max_messages: int = 0) -> DataFrame:
    """Messages that steps emitted: addressed ones go there, the rest along edges; none to its sender."""
    out = steps
    if max_messages:
        w = Window.partitionBy("from").orderBy(F.col("rank").desc(), F.col("to"), F.col("body"))
        out = out.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= max_messages).drop("__n")
    along = out.where("to = ''").drop("to").join(targets(edges, directed), F.col("from") == F.col("src")).select(F.col("dst").alias("to"), "from", "body", "rank")
    return out.where("to <> ''").unionByName(along).where("to <> from")


def check_vertices(vertices: DataFrame, *, id_col: str = "id") -> None:
    """Empty or repeated ids and reserved fields are refused."""
    if bad := [c for c in RESERVED if c in vertices.columns]:
        raise ValueError(f"reserved fields: {bad}")
    empty = vertices.where(f"coalesce({id_col}, '') = ''").limit(1).count()
    if empty:
        raise ValueError("a vertex has no id")
    if not vertices.groupBy(id_col).count().where("count > 1").isEmpty():
        raise ValueError("vertices repeat an id")


def bsp(vertices: DataFrame, edges: DataFrame, step: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]], *, seeds: str = "true", directed: bool = False, max_rounds: int = 10, max_inbox: int = 0, max_frontier: int = 0, max_messages: int = 0, grow: Callable[[DataFrame], DataFrame] | None = None, seen: str | None = None, budget: Callable[[int], bool] | None = None) -> Iterated:
    """Deliver, quiesce, run, route; until quiet, fixpoint, the last round, or the budget.

    vertices: id and state columns.  step(active, round) gets the active
    vertices with Inbox (bodies in canonical order) and Senders, and returns (changed vertices,
    messages).  seen: an expression for a vertex's state; a vertex whose (state,
    inbox) has been run before is not run again.  A message to a vertex that is
    not there grows one, or is dropped and counted.  Messages over an inbox's cap
    and those of vertices over the frontier's count as truncated; a vertex's
    senders stand beside its bodies, one for one.  Loops end lineage each round
    in the shared folder.
    """
    check_vertices(vertices)
    names = vertices.columns
    vertices = materialize(vertices)
    out = Iterated(vertices)
    mail = vertices.where(seeds).select(F.col("id").alias("to"), F.lit("").alias("from"), F.lit("").alias("body"), F.lit(0.0).alias("rank"))
    state = F.expr(seen) if seen else F.to_json(F.struct(*[c for c in names if c != "id"]))
    past: DataFrame | None = None
    number = 0
    while True:
        mail = materialize(mail)
        if mail.isEmpty():
            out.halt = "quiet"
            break
        if number >= max_rounds:
            out.halt = "rounds"
            break
        if budget is not None and budget(number):
            out.halt = "budget"
            break
        r = Round(number)
        lost = mail.join(vertices.select(F.col("id").alias("to")), "to", "left_anti")
        if grow is not None:
            fresh = materialize(grow(lost.groupBy("to").agg(F.array_sort(F.collect_list("body")).alias("bodies"))).select(*names))
            r.grown = fresh.count()
            if r.grown:
                vertices = materialize(vertices.unionByName(fresh))
        else:
            r.dropped = lost.count()
        mail = mail.join(vertices.select(F.col("id").alias("to")), "to", "left_semi")
        if max_inbox:
            kept, over = cap(mail, max_inbox)
            r.truncated += over.count()
            mail = kept
        box = F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), F.col("from"), F.col("body"))))
        inbox = mail.groupBy("to").agg(F.filter(box, lambda m: m["body"] != "").alias("box"), F.max("rank").alias("best"))
        inbox = inbox.select(F.col("to").alias("id"), F.transform("box", lambda m: m["body"]).alias("Inbox"), F.transform("box", lambda m: m["from"]).alias("Senders"), "best")
        r.delivered = mail.where("body <> ''").count()
        if max_frontier:
            inbox = inbox.orderBy(F.col("best").desc(), "id").limit(max_frontier)
            went = inbox.agg(F.coalesce(F.sum(F.size("Inbox")), F.lit(0))).first()[0]
            r.truncated, r.delivered = r.truncated + r.delivered - went, went
        active = vertices.join(inbox.drop("best"), "id").withColumn("__key", F.sha2(F.concat_ws("\x1f", "id", state, F.to_json("Inbox")).cast("binary"), 256))
        active = materialize(active)
        if past is not None:
            before = active.count()
            active = materialize(active.join(past, "__key", "left_anti"))
            r.quiesced = before - active.count()
        r.active = active.count()
        if not r.active:
            out.halt = "fixpoint"
            break
        past = active.select("__key") if past is None else materialize(past.union(active.select("__key")))
        changed, emitted = step(active.drop("__key"), number)
        changed = materialize(changed.select(*names))
        vertices = materialize(vertices.join(changed.select("id"), "id", "left_anti").select(*names).unionByName(changed))
        mail = route(emitted.select("to", "from", "body", "rank"), edges, directed=directed, max_messages=max_messages)
        out.rounds.append(r)
        number += 1
    out.vertices = vertices
    return out


def refine(records: DataFrame, step: Callable[[DataFrame, int], DataFrame], *, accept: str, note: str, max_rounds: int = 5, carry: bool = False) -> Iterated:
    """Each record alone: run, and again with its trimmed note while it is not accepted; an empty note ends it.

    step(active, round) gets the records with Inbox (notes so far: the last one,
    or with carry all of them) and returns them changed.
    """
    check_vertices(records)
    names = records.columns
    open_ = records.withColumn("Inbox", F.array().cast("array<string>"))
    done = []
    out = Iterated(records)
    number = 0
    while True:
        open_ = materialize(open_)
        if open_.isEmpty():
            out.halt = "quiet"
            break
        if number >= max_rounds:
            out.halt = "rounds"
            done.append(open_.select(*names))
            break
        out.rounds.append(Round(number, active=open_.count()))
        got = materialize(step(open_, number))
        more = (~F.coalesce(F.expr(accept), F.lit(False))) & (strip(F.coalesce(F.col(note).cast("string"), F.lit(""))) != "")
        done.append(got.where(~more).select(*names))
        one = F.array(strip(F.col(note).cast("string")))
        open_ = got.where(more).withColumn("Inbox", F.concat("Inbox", one) if carry else one).select(*names, "Inbox")
        number += 1
    whole = done[0] if done else records
    for d in done[1:]:
        whole = whole.unionByName(d)
    out.vertices = whole
    return out


def successor(body: Column) -> Column:
    """The id of a proposed state, from its content alone."""
    return F.concat(F.lit("c"), F.substring(F.sha2(body.cast("binary"), 256), 1, 12))


def expand_from_field(rows: DataFrame, name: str, score: Column | None = None, *, id_col: str = "id") -> DataFrame:
    """Each text of a list field as a proposal with its id and rank."""
    d = rows.select(F.col(id_col).cast("string").alias("from"), F.explode(F.col(name).cast("array<string>")).alias("body"))
    return d.select(successor(F.col("body")).alias("to"), "from", "body", (score if score is not None else F.lit(0.0)).cast("double").alias("rank"))


def best_proposals(proposals: DataFrame, width: int) -> DataFrame:
    """One proposal per destination, its best; of these the `width` best of all, ties by id."""
    w = Window.partitionBy("to").orderBy(F.col("rank").desc(), "from", "body")
    one = proposals.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return one.orderBy(F.col("rank").desc(), "to").limit(width)


def beam(start: DataFrame, expand: Callable[[DataFrame, int], DataFrame], *, width: int, depth: int, terminal: str = "false") -> Iterated:
    """Keeps the `width` best states of each round; terminal ones are kept but not expanded.

    start: id, body, rank.  expand(frontier, round) gives proposals (to, from, body, rank).
    """
    frontier = materialize(start.select("id", "body", F.col("rank").cast("double").alias("rank")).withColumn("round", F.lit(0)))
    seen = frontier
    out = Iterated(seen)
    for number in range(depth):
        live = frontier.where(~F.coalesce(F.expr(terminal), F.lit(False)))
        n = live.count()
        if not n:
            out.halt = "quiet"
            break
        proposals = expand(live, number).join(seen.select(F.col("id").alias("to")), "to", "left_anti")
        frontier = materialize(best_proposals(proposals, width).select(F.col("to").alias("id"), "body", "rank", F.lit(number + 1).alias("round")))
        out.rounds.append(Round(number, active=n, delivered=frontier.count()))
        seen = materialize(seen.unionByName(frontier))
    else:
        out.halt = "rounds"
    out.vertices = seen
    return out
