r"""Secret scans with corpus-wide ownership frequency.

Only DataFrame functions.  Base patterns give spans in code points: the text is
split by a pattern, so lengths of gaps and matches add up to places.  Beside
them, long bare tokens with letters and digits are candidates.  Every
candidate's value is hashed, and each hash is counted over the whole corpus by
distinct repositories (documents, unless another column names them) and owners
(sources).  A value that `COPIED_OWNERS` or more owners have is a widely copied
example, as is one that goes from one owner to another over
`COPIED_REPOSITORIES` or more repositories; any other value is specific to its
owners and looks live, in however many of one owner's repositories it stands.
Live bare tokens outside base spans are added as spans of kind `bare`,
private-key headers as `pem`.

Null and empty texts have no spans.  Null owners count as one owner, null
repositories as one repository of their owner.  Equal rows give equal results;
extra columns are ignored by reports and kept, whatever their names, by
`redact_secrets`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import cut

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
BARE = r"[A-Za-z0-9+/_-]{24,}"

#: Owners from which on a value is a copied example.
COPIED_OWNERS = 3
#: Repositories from which on a value that more than one owner has is one too.
COPIED_REPOSITORIES = 20
#: Places that one step of a running sum copies at most.
CHUNK = 128


def _chunk_sums(steps: str) -> Column:
    """Running sums within each chunk of an array column."""
    more = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    starts = F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1)), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.aggregate(F.slice(steps, k, F.lit(CHUNK)), F.array().cast("array<int>"), more))


def _joined_sums(chunks: str) -> Column:
    """Running sums over all chunks: a value is copied within its chunk only, and a chunk's sum among the chunks."""
    before = F.aggregate(chunks, F.array(F.lit(0)), lambda acc, a: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(a, -1))))
    return F.flatten(F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), lambda a, o: F.transform(a, lambda v: v + o)))


def _with_spans(d: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Adds s_<kind>, the places and values of each pattern's matches, from the lengths of gaps and matches."""
    t = F.col(text)
    d = d.withColumns({f"m_{k}": F.regexp_extract_all(t, F.lit(p), F.lit(0)) for k, p in patterns.items()})
    gaps = lambda k, p: F.when(F.size(f"m_{k}") > 0, F.slice(F.transform(F.split(t, p, -1), F.length), F.lit(1), F.size(f"m_{k}"))).otherwise(F.array().cast("array<int>"))
    d = d.withColumns({f"g_{k}": F.zip_with(gaps(k, p), f"m_{k}", lambda g, v: g + F.length(v)) for k, p in patterns.items()})
    d = d.withColumns({f"c_{k}": _chunk_sums(f"g_{k}") for k in patterns})
    d = d.withColumns({f"e_{k}": _joined_sums(f"c_{k}") for k in patterns})
    span = lambda e, v: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value"))
    return d.withColumns({f"s_{k}": F.zip_with(f"e_{k}", f"m_{k}", span) for k in patterns})


def _kind(spans: str, name: str, rank: int, value: Column | None = None) -> Column:
    return F.transform(F.col(spans), lambda s: F.struct(s["start"], F.lit(rank).alias("rank"), s["end"], F.lit(name).alias("kind"), F.sha2(s["value"].cast("binary"), 256).alias("hash")))


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None) -> DataFrame:
    """doc_id, key (a hash of the text), owner, repository, base spans and other candidates of each document, without texts."""
    none = F.lit("")
    own = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(owner_col).cast("string"), none).alias("owner"),
        F.coalesce(F.col(repository_col or id_col).cast("string"), none).alias("repository"),
        F.coalesce(F.col(text_col).cast("string"), none).alias("text"),
    )
    d = _with_spans(own, "text", {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "pem": PEM, "bare": BARE})
    # group 2 of an assignment is what follows its last separator, blank or quote
    value = lambda s: F.regexp_extract(s["value"], ASSIGN, 2)
    d = d.withColumn("s_assign", F.filter(F.transform("s_assign", lambda s: F.struct(s["start"], s["end"], value(s).alias("value"))), lambda s: F.length(s["value"]) >= 8))
    d = d.withColumn("s_access", F.filter("s_access", lambda s: F.length(s["value"]) >= 16))
    base = F.array_sort(F.concat(_kind("s_assign", "assign", 0), _kind("s_access", "access", 1), _kind("s_hex", "hex", 2)))
    d = d.withColumn("base", base)
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    d = d.withColumn("s_bare", F.filter("s_bare", lambda s: mixed(s) & free(s)))
    other = F.array_sort(F.concat(_kind("s_pem", "pem", 3), _kind("s_bare", "bare", 4)))
    return d.select("doc_id", F.xxhash64("text").alias("key"), "owner", "repository", "base", other.alias("other"))


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: distinct repositories and owners, counted over the whole corpus."""
    values = found.select("owner", "repository", F.explode(F.concat("base", "other")).alias("c")).select(F.col("c.hash").alias("hash"), "owner", "repository")
    by_owner = values.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def live(copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> Column:
    """Whether a value with these counts looks live."""
    return (F.col("n_owners") < copied_owners) & ((F.col("n_owners") == 1) | (F.col("n_repositories") < copied_repositories))


def scan_secrets(docs: DataFrame, *, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES, **columns) -> DataFrame:
    """doc_id, key, base spans, and judged: all candidates with n_repositories, n_owners and live, sorted by start and kind."""
    found = cut(candidates(docs, **columns))
    some = found.where(F.size("base") + F.size("other") > 0).dropDuplicates(["doc_id", "key"])
    each = some.select("doc_id", "key", F.explode(F.concat("base", "other")).alias("c")).select("doc_id", "key", "c", F.col("c.hash").alias("hash"))
    known = ownership(found).withColumn("live", live(copied_owners, copied_repositories))
    judged = each.join(known, "hash").groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_list(F.struct("c.start", "c.rank", "c.end", "c.kind", "n_repositories", "n_owners", "live"))).alias("judged")
    )
    f, j = found.alias("f"), judged.alias("j")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,n_repositories:bigint,n_owners:bigint,live:boolean>>")
    return f.join(j, F.expr("f.doc_id <=> j.doc_id and f.key = j.key"), "left").select("f.doc_id", "f.key", "f.base", F.coalesce("j.judged", none).alias("judged"))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: counts of base kinds, digest of base spans, all spans, and how many look live or copied."""
    d = scan_secrets(docs, **options)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    every = F.filter("judged", lambda s: (s["rank"] <= 3) | s["live"])
    return d.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _text(every).alias("spans"),
        F.size(F.filter("judged", lambda s: s["live"])).cast("bigint").alias("n_live"),
        F.size(F.filter("judged", lambda s: ~s["live"])).cast("bigint").alias("n_copied"),
    )


def redact_secrets(docs: DataFrame, *, mark: str = "[secret]", **options) -> DataFrame:
    """The documents with every live-looking span replaced by a mark; copied examples stay.  n_chars is the new length.

    Spans of one text that overlap are replaced together.
    """
    names = docs.columns
    spans = F.filter("judged", lambda s: s["live"])
    found = scan_secrets(docs, **options).select("doc_id", "key", F.transform(spans, lambda s: F.struct(s["start"], s["end"])).alias("spans")).where(F.size("spans") > 0).dropDuplicates(["doc_id", "key"])
    own = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    d = own.alias("d").join(found.alias("l"), F.expr("d.row.doc_id <=> l.doc_id and d.key = l.key"), "left")
    # what lies between the spans, each from the furthest end before it
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("d.row.text")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    new = F.aggregate("l.spans", none, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    hit = F.col("l.spans").isNotNull()
    d = d.select("d.row", hit.alias("hit"), F.when(hit, new).otherwise(text).alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col("hit"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return d.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in names])
