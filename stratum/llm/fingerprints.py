"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections.

Only DataFrame functions.  A paragraph is a line; its leaves are runs of up to
fifteen words that end after a word whose last letter is a cut letter, so a
word that is put in moves no distant leaf.  A leaf's node is the SHA-256 of its
text, a paragraph's node that of its leaves' nodes.  Paragraphs are grouped to
sections at content-defined cuts as well (a paragraph whose node begins with 0
or 1 ends its section); a section's node hashes its paragraphs' nodes, the root
its sections' nodes.  Equal roots mean equal texts.

Where roots differ, `differing` descends: sections whose node the other tree
has are passed over whole, then paragraphs of the remaining ones by their nodes
against paragraphs of the other's remaining sections.  It names the paragraphs
that were put in and those that were taken out.  Likeness is the Dice
coefficient of two trees' distinct leaf nodes, from 0 to 1; two empty texts are
alike (1.0).  Null texts count as empty.

`with_next` finds each row's successor in a global order without sorting all
rows in one task: ids are cut to cells of 512, rows look ahead within their
cell, and the last row of a cell takes the first row of the next one; cells
find their successors in the same way, level by level.  Repeated ids are
ordered by a hash of their text.  Rows with a null id have no place in the
order: nothing follows them (their next text is empty), and they follow nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of an id that are one cell.
CELL_BITS = 9
#: Rows that one task may order by itself.
TOP = 4096

# Fixed value: the leaves of one line; the cut letters are d and y.
PIECE = "(?:[^ \n]*[^dy \n] ?| ){1,15}(?:[^ \n]*[dy] ?)?|[^ \n]*[dy] ?"
_CUT = "^[01]"


def _successors(cells: DataFrame, low: int, high: int) -> DataFrame:
    """cell -> next cell that exists; the last one's is null."""
    if high - low < TOP:
        return cells.withColumn("next_cell", F.lead("cell").over(Window.orderBy("cell")))
    cells = cells.withColumn("group", F.shiftright("cell", CELL_BITS))
    ahead = cells.withColumn("next_cell", F.lead("cell").over(Window.partitionBy("group").orderBy("cell")))
    firsts = cells.groupBy("group").agg(F.min("cell").alias("first_cell"))
    jump = _successors(firsts.select(F.col("group").alias("cell")), low >> CELL_BITS, high >> CELL_BITS)
    jump = jump.join(firsts.select(F.col("group").alias("next_cell"), "first_cell"), "next_cell").select(F.col("cell").alias("group"), "first_cell")
    return ahead.join(jump, "group", "left").select("cell", F.coalesce("next_cell", "first_cell").alias("next_cell"))


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null: empty) and next_text: the text of the next id, after the last that of the first."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    low, high = own.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return own.withColumn("next_text", F.lit(""))
    # rows without an id are dealt by their text, to cells beyond all others, so that no cell holds them all
    cell = F.coalesce(F.shiftright("doc_id", CELL_BITS), F.lit(1 << 60) + F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    own = own.withColumns({"cell": cell, "t": F.xxhash64("text")})
    ahead = own.withColumn("ahead", F.lead("text").over(Window.partitionBy("cell").orderBy("doc_id", "t")))
    # the first row of each cell, combined before it is shuffled
    heads = own.where("doc_id is not null").groupBy("cell").agg(F.min(F.struct("doc_id", "t", "text")).alias("h")).select("cell", F.col("h.text").alias("head"))
    first_cell = low >> CELL_BITS
    nexts = _successors(own.where("doc_id is not null").select("cell").distinct(), first_cell, high >> CELL_BITS).withColumn("next_cell", F.coalesce("next_cell", F.lit(first_cell)))
    jump = nexts.join(heads.withColumnRenamed("cell", "next_cell"), "next_cell").select("cell", "head")
    some = F.col("doc_id").isNotNull()
    return ahead.join(jump, "cell", "left").select("doc_id", "text", F.when(some, F.coalesce("ahead", "head")).otherwise("").alias("next_text"))


def _sha(level: str, text: Column) -> Column:
    """A node; the level's letter keeps nodes of different levels apart."""
    return F.sha2(F.concat(F.lit(level), text).cast("binary"), 256)


def leaves(line: Column) -> Column:
    """The leaf nodes of a line, in order."""
    return F.transform(F.regexp_extract_all(line, F.lit(PIECE), F.lit(0)), lambda p: _sha("l", p))


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text: their nodes and leaf nodes, in order."""
    pairs = F.transform(F.split(text, "\n"), lambda line: F.struct(leaves(line).alias("leaves")))
    return F.transform(pairs, lambda p: F.struct(_sha("p", F.array_join(p["leaves"], "")).alias("node"), p["leaves"].alias("leaves")))


def sections(paragraphs: Column) -> Column:
    """The sections of a text from its paragraphs: each one's paragraph nodes, in order."""
    marked = F.transform(paragraphs, lambda p: F.when(p["node"].rlike(_CUT), F.concat(p["node"], F.lit(";|"))).otherwise(F.concat(p["node"], F.lit(";"))))
    return F.transform(F.filter(F.split(F.array_join(marked, ""), "\\|"), lambda s: s != ""), lambda s: F.split(F.rtrim(s, F.lit(";")), ";"))


def section_nodes(sections: Column) -> Column:
    return F.transform(sections, lambda s: _sha("s", F.array_join(s, "")))


def root(section_nodes: Column) -> Column:
    return _sha("r", F.array_join(section_nodes, ""))


def likeness(a: Column, b: Column) -> Column:
    """Of two sets of leaf nodes."""
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def trees(df: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    """Adds the tree of a text column, its names with a prefix: root, nodes (of sections), sections (their paragraphs' nodes), leaves (distinct)."""
    df = df.withColumn(f"{prefix}paragraphs", paragraphs(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumns({f"{prefix}sections": sections(F.col(f"{prefix}paragraphs")), f"{prefix}leaves": F.array_distinct(F.flatten(F.transform(f"{prefix}paragraphs", lambda p: p["leaves"])))})
    df = df.drop(f"{prefix}paragraphs").withColumn(f"{prefix}nodes", section_nodes(F.col(f"{prefix}sections")))
    return df.withColumn(f"{prefix}root", root(F.col(f"{prefix}nodes")))


def _remaining(prefix: str, other: str) -> Column:
    """(number, node) of the paragraphs in sections whose node the other tree has not."""
    own = F.arrays_zip(F.col(f"{prefix}nodes").alias("node"), F.col(f"{prefix}sections").alias("nodes"))
    first = F.aggregate(f"{prefix}sections", F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.size(s))))
    numbered = F.zip_with(own, F.slice(first, F.lit(1), F.size(f"{prefix}sections")), lambda s, k: F.struct(s["node"].alias("node"), s["nodes"].alias("nodes"), k.alias("first")))
    left = F.filter(numbered, lambda s: ~F.array_contains(F.col(f"{other}nodes"), s["node"]))
    return F.flatten(F.transform(left, lambda s: F.transform(s["nodes"], lambda h, k: F.struct((s["first"] + k).alias("number"), h.alias("node")))))


def differing(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds put_in, numbers (from 0) of b's paragraphs that a has not, and taken_out, numbers of a's that b has not.

    Texts whose roots are equal are not descended into; where they differ, only
    the sections that differ are.
    """
    names = df.columns
    d = trees(trees(df, a, "__a_"), b, "__b_")
    # paragraphs are looked at where the roots differ
    apart = F.col("__a_root") != F.col("__b_root")
    none = F.array().cast("array<struct<number:int,node:string>>")
    d = d.withColumns({"__a_left": F.when(apart, _remaining("__a_", "__b_")).otherwise(none), "__b_left": F.when(apart, _remaining("__b_", "__a_")).otherwise(none)})
    only = lambda x, y: F.transform(F.filter(x, lambda p: ~F.array_contains(F.transform(y, lambda q: q["node"]), p["node"])), lambda p: p["number"])
    return d.select(*names, only("__b_left", F.col("__a_left")).alias("put_in"), only("__a_left", F.col("__b_left")).alias("taken_out"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Each text, its edited form (the second half gives way to the next text's beginning) and their likeness."""
    n = F.length("text").cast("bigint")
    d = with_next(docs).withColumn("n_chars", n)
    d = d.withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars - n_chars div 2)), substring(next_text, 1, int(n_chars div 2)))"))
    d = trees(trees(trees(d, "text"), "edited", "edited_"), "next_text", "next_")
    return d.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("root").alias("fingerprint"),
        F.col("edited_root").alias("edited_fingerprint"),
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
        F.size("sections").cast("bigint").alias("n_sections"),
    )


def _tree_sql(text: str) -> str:
    """DuckDB SQL of a text's tree: p (per line its leaf nodes), h (paragraph nodes), s (section nodes)."""
    joined = "coalesce(list_aggregate({}, 'string_agg', ''), '')"
    p = f"list_transform(string_split({text}, chr(10)), lambda x: list_transform(regexp_extract_all(x, '{PIECE}'), lambda y: sha256('l' || y)))"
    h = f"list_transform(p, lambda x: sha256('p' || {joined.format('x')}))"
    cuts = joined.format("list_transform(h, lambda x: CASE WHEN x[1] IN ('0', '1') THEN x || '|' ELSE x END)")
    s = f"list_transform(list_filter(string_split({cuts}, '|'), lambda x: x <> ''), lambda x: sha256('s' || x))"
    return f"SELECT doc_id, list_distinct(flatten(p)) AS leaves, s, sha256('r' || {joined.format('s')}) AS root FROM (SELECT *, {s} AS s FROM (SELECT *, {h} AS h FROM (SELECT doc_id, {p} AS p FROM e)))"


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS nxt
  FROM documents WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), e AS (
  SELECT *, concat(substring(text, 1, n - n // 2), substring(nxt, 1, n // 2)) AS edited FROM d
), x AS ({_tree_sql("text")}), y AS ({_tree_sql("edited")}), z AS ({_tree_sql("nxt")})
SELECT e.doc_id, n AS n_chars, sha256(edited) AS edited_sha256, x.root AS fingerprint, y.root AS edited_fingerprint,
  CASE WHEN len(x.leaves) + len(y.leaves) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(x.leaves, y.leaves)) / (len(x.leaves) + len(y.leaves)) END AS near_edited,
  CASE WHEN len(x.leaves) + len(z.leaves) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(x.leaves, z.leaves)) / (len(x.leaves) + len(z.leaves)) END AS near_next,
  len(x.s)::BIGINT AS n_sections
FROM e JOIN x USING (doc_id) JOIN y USING (doc_id) JOIN z USING (doc_id)
"""
