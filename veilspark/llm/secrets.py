"""Operator 1, secret scans: corpus-wide ownership frequency, by DataFrame functions alone.

Each text gives candidates: assignments, access keys, long hex runs, and bare tokens of letters and digits.
The hashes of their values are aggregated by distinct repositories and owners. A value seen under more than
``max_owners`` owners is a widely copied example; the others are specific to an owner and look live. Candidates
of the first three kinds are always reported; a bare token is added where its value is owner-specific and it
overlaps none of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.llm.base import doc_id, keyed, packed, partitions, spread_join, stash, text_hash, unpacked


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
#: Kind, pattern, group of the value, characters of the value at least; in the order in which kinds are listed.
#: A run of hex digits or of an access key's letters is as long as it can be, so a least length may stand in the pattern.
KINDS = (
    ("assign", rf"({_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("bare", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
#: Different owners that a value may have and still count as specific to its owner.
MAX_OWNERS = 2


def _matches(text: Column, order: int) -> Column:
    """The matches of a kind, each with the characters and bytes between it and the match before."""
    kind, pattern, _, _ = KINDS[order]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, gap: F.struct(F.lit(order).alias("ord"), m.alias("match"), F.length(gap).alias("gap"), F.octet_length(gap).alias("bgap")))
    none = F.array().cast("array<struct<ord:int,match:string,gap:int,bgap:int>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), pairs).otherwise(none)


def candidates(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(row, k, h, owner, repo, ord, start, end, bstart, bend, hash) of each candidate, positions in characters and in bytes; a row
    with null ord for a document without any."""
    names = F.concat_ws("\x1f", *(F.coalesce(F.col(f"r{i}"), F.lit("")) for i in range(len(repository))))
    kept = keyed(docs, F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), *(F.col(c).cast("string").alias(f"r{i}") for i, c in enumerate(repository)), text_hash())
    found = kept.withColumn("row", F.monotonically_increasing_id()).select("row", "k", "h", "owner", names.alias("repo"), F.posexplode_outer(F.concat(*(_matches(F.col("text"), i) for i in range(len(KINDS))))).alias("i", "m"))
    inside = W.partitionBy("row", "ord").orderBy("i")
    size, bytes_ = F.length("m.match"), F.octet_length("m.match")
    placed = found.withColumn("ord", F.col("m.ord")).withColumn("end", F.sum(F.col("m.gap") + size).over(inside)).withColumn("bend", F.sum(F.col("m.bgap") + bytes_).over(inside))
    placed = placed.withColumn("start", F.col("end") - size).withColumn("bstart", F.col("bend") - bytes_)
    value, keep = F.lit(None), F.col("ord").isNull()
    for i, (_, pattern, group, least) in enumerate(KINDS):
        text = F.regexp_extract("m.match", pattern, group) if group else F.col("m.match")
        value = F.when(F.col("ord") == i, text).otherwise(value)
        good = F.length(text) >= least
        if i == len(KINDS) - 1:
            good = good & F.regexp_like("m.match", F.lit("[0-9]")) & F.regexp_like("m.match", F.lit("[A-Za-z]"))
        keep = keep | ((F.col("ord") == i) & good)
    # a dropped match leaves a row without a candidate, so that no document is lost
    live = F.when(keep, F.col("ord"))
    where = [F.when(live.isNotNull(), F.col(c)).alias(c) for c in ("start", "end", "bstart", "bend")]
    return placed.select("row", "k", "h", "owner", "repo", live.alias("ord"), *where, F.when(live.isNotNull(), F.sha2(value, 256)).alias("hash"))


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """(hash, n_found, n_repos, n_owners, live) of each candidate value. A hot value shrinks to a row for each
    repository before it meets itself."""
    by_repo = found.where("hash IS NOT NULL").groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_found"), F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners")).withColumn("live", F.col("n_owners") <= max_owners)


def _judged(docs: DataFrame, owner: str, repository: tuple[str, ...], max_owners: int) -> DataFrame:
    """candidates with ``live`` and ``shown``. Rows without a candidate take no part in the join by hash, and values that are
    copied widely are spread over it."""
    found = stash(candidates(docs, owner, repository))
    own = ownership(found, max_owners).select("hash", "live")
    hashed = spread_join(found.where("hash IS NOT NULL"), own, "hash")
    every = hashed.unionByName(found.where("hash IS NULL").withColumn("live", F.lit(None).cast("boolean")))
    base = F.col("ord") < len(KINDS) - 1
    near = W.partitionBy("row").orderBy("start", "ord")
    before = F.max(F.when(base, F.col("end"))).over(near.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(near.rowsBetween(1, W.unboundedFollowing))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return every.withColumn("free", free).withColumn("shown", F.coalesce(base | (F.col("live") & F.col("free")), F.lit(False)))


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS) -> DataFrame:
    """(row, k, h, spans array<struct<start,ord,end,live>>): all spans of each row of docs, by start and kind; empty for a
    null or empty text or one without secrets. Positions are code points, ends exclusive. Rows that repeat a document each get
    its spans; a null owner or repository is the empty name. An empty table gives no rows."""
    span = F.struct("start", "ord", "end", "live")
    return _judged(docs, owner, repository, max_owners).groupBy("row", "k", "h").agg(F.array_sort(F.collect_list(F.when(F.col("shown"), span))).alias("spans"))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"], s["end"])))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of ``scan``: counts and digest of base spans, all spans, and how many look live or copied."""
    base = F.filter("spans", lambda s: s["ord"] < len(KINDS) - 1)
    count = lambda keep: F.size(F.filter("spans", keep)).cast("long")
    of_kind = lambda i: lambda s: s["ord"] == i
    return scanned.select(
        doc_id(),
        *(count(of_kind(i)).alias(f"n_{KINDS[i][0]}") for i in range(len(KINDS) - 1)),
        F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_copied"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", max_owners: int = MAX_OWNERS, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """docs with every span that ``scan`` reports replaced by ``mark``; all columns and rows stay, null texts too. Spans that
    overlap get one mark. Assignments, access keys and hex runs are masked whether they are live or widely copied; ownership
    decides about bare tokens alone. Work is linear in the text and its spans: texts are cut as bytes."""
    shown = _judged(docs, owner, repository, max_owners).where("shown")
    # what no span before reaches begins a new cut
    reach = F.coalesce(F.max("bend").over(W.partitionBy("row").orderBy("start", "ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    cut = F.when(F.col("bstart") >= F.col("reach"), F.struct("bstart", "reach"))
    rows = shown.withColumn("reach", reach).groupBy("row", "k", "h").agg(F.array_sort(F.collect_list(cut)).alias("cuts"), F.max("bend").alias("last"))
    cuts = rows.groupBy("k", "h").agg(F.first(F.struct("cuts", "last")).alias("c"))
    # dealt by key whatever the size of either side, so that the plan of small tables is that of large ones
    dealt = packed(docs).repartition(partitions(docs.sparkSession), "k", "h").join(cuts, ["k", "h"], "left")
    part = lambda raw, low, n: F.substring(raw, (low + 1).cast("int"), n.cast("int")).cast("string")
    whole = lambda raw: F.concat(F.array_join(F.transform("c.cuts", lambda x: F.concat(part(raw, x["reach"], x["bstart"] - x["reach"]), F.lit(mark))), ""), part(raw, F.col("c.last"), F.octet_length("text")))
    text = F.element_at(F.transform(F.array(F.encode("text", "UTF-8")), whole), 1)  # the bytes are made once
    return unpacked(dealt.withColumn("text", F.when(F.col("c").isNotNull(), text).otherwise(F.col("text"))), docs.columns)


def _found_sql(order: int) -> str:
    kind, pattern, group, least = KINDS[order]
    p = "'" + pattern.replace('\\"', '"').replace("'", "''") + "'"
    value = f"regexp_extract(m, {p}, {group})" if group else "m"
    more = " AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')" if order == len(KINDS) - 1 else ""
    return f"""SELECT rid, owner, repo, {order} AS ord, start, start + length(m) AS fin, sha256({value}) AS hash FROM (
      SELECT *, sum(gap + length(m)) OVER (PARTITION BY rid ORDER BY i) - length(m) AS start FROM (
        SELECT rid, owner, repo, unnest(regexp_extract_all(t, {p})) AS m, unnest(list_transform(string_split_regex(t, {p}), lambda x: length(x))) AS gap, unnest(range(length(t) + 1)) AS i
        FROM d WHERE regexp_matches(t, {p})) WHERE m IS NOT NULL) WHERE length({value}) >= {least}{more}"""


def _written_sql(where: str) -> str:
    names = ", ".join(f"'{k[0]}'" for k in KINDS)
    return f"coalesce(string_agg(([{names}])[ord + 1] || ':' || start || ':' || fin, ',' ORDER BY start, ord) FILTER ({where}), '')"


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(source, '') || chr(31) || coalesce(lang, '') AS repo FROM documents),
c AS MATERIALIZED ({" UNION ALL ".join(_found_sql(i) for i in range(len(KINDS)))}),
o AS (SELECT hash, count(DISTINCT owner) <= {MAX_OWNERS} AS live FROM c GROUP BY hash),
j AS (SELECT c.*, live FROM c JOIN o USING (hash)),
s AS (SELECT * FROM j WHERE ord < {len(KINDS) - 1} OR (live AND NOT EXISTS (SELECT 1 FROM c b WHERE b.rid = j.rid AND b.ord < {len(KINDS) - 1} AND b.start < j.fin AND j.start < b.fin)))
SELECT doc_id, {", ".join(f"count(*) FILTER (ord = {i}) AS n_{KINDS[i][0]}" for i in range(len(KINDS) - 1))},
  sha256({_written_sql(f"ord < {len(KINDS) - 1}")}) AS base_sha256, {_written_sql("ord >= 0")} AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied
FROM d LEFT JOIN s USING (rid) GROUP BY rid, doc_id
"""
