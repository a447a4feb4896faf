"""Admission of files, counters, hosts, names of outputs and places, and the commit guard."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.operators.scan import scan
from veilspark.stored import stored


#: Rounds of admission before what is left of a queue is walked in order.
ROUNDS = 30


def _walk(left: DataFrame) -> DataFrame:
    """The ids that are admitted of what ``admit``'s rounds left undecided, each queue in order in one task."""
    def walk(batches):
        now, room = None, 0
        for pdf in batches:
            admitted = []
            for q, i, n, has in zip(pdf["q"], pdf["id"], pdf["n"], pdf["room"], strict=True):
                if q != now:
                    now, room = q, has
                if n <= room:
                    room -= n
                    admitted.append(i)
            yield pd.DataFrame({"id": admitted})

    return left.repartition("q").sortWithinPartitions("q", "at", "id").mapInPandas(walk, "id long")


def admit(files: DataFrame, queue: str, order: str, size: str = "size", max_file: int = fixed.MAX_FILE, max_queue: int = fixed.MAX_QUEUE) -> DataFrame:
    """files with ``reason``: null if admitted, else file-too-large or queue-total-exceeded. Files of no queue are one queue; a
    null or negative size counts as 0.

    Each queue counts as walked in order; rejected files do not add to its total. Whatever the queues' lengths no task walks
    one: a round of prefix sums admits all files up to the first that has no room; as room only shrinks, of the later ones those
    larger than what is left are rejected, and the others meet the next round. Each round admits at least one file of a queue
    and mostly halves its room; what ROUNDS rounds leave of odd queues is walked."""
    key = F.to_json(F.struct(F.col(queue).alias("q")))
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    given = stored(files.select(F.struct(*(F.col(f"`{c}`") for c in files.columns)).alias("row"), key.alias("q"), F.col(order).alias("at"), n.alias("n")).withColumn("id", F.monotonically_increasing_id()))
    left = given.where(F.col("n") <= max_file).select("q", "at", "id", "n", F.lit(max_queue).cast("long").alias("room")).where("n <= room")
    admitted = []
    for _ in range(ROUNDS):
        summed = scan(left.withColumn("total", F.col("n")), ["q"], ["at", "id"], add=("total",))
        admitted.append(stored(summed.where("total <= room").select("id")))
        over = summed.where("total > room")
        used = summed.where("total <= room").groupBy("q").agg(F.max("total").alias("used"))
        left = stored(over.join(used, "q", "left").select("q", "at", "id", "n", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")).where("n <= room"))
        if not left.limit(1).count():
            break
    else:
        admitted.append(_walk(left))
    ids = functools.reduce(DataFrame.unionByName, admitted).withColumn("ok", F.lit(True))
    reason = F.when(F.col("n") > max_file, "file-too-large").when(F.col("ok").isNull(), "queue-total-exceeded")
    return given.join(ids, "id", "left").select(*(F.col("row").getField(c).alias(c) for c in files.columns), reason.alias("reason"))


def stats(events: DataFrame, spans: str = "spans", at: str = "ts") -> DataFrame:
    """(confirms, spans_masked, last_at): each event confirms one mask; negative counts add nothing."""
    return events.agg(F.count("*").alias("confirms"), F.coalesce(F.sum(F.greatest(F.lit(0), F.col(spans))), F.lit(0)).alias("spans_masked"), F.max(at).alias("last_at"))


def host_matches(host: Column, domain: Column) -> Column:
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def site_of(host: Column) -> Column:
    """The site that a host belongs to, or null."""
    out = F.lit(None).cast("string")
    for site, domains in reversed(fixed.SITES.items()):
        hit = F.lit(False)
        for d in domains:
            hit = hit | host_matches(host, F.lit(d))
        out = F.when(hit, site).otherwise(out)
    return out


def clean_domain(text: Column) -> Column:
    """What a user typed as a domain: without blanks around it, a scheme in lower case, and what follows the first slash in its
    line. May be empty."""
    bare = F.regexp_replace(F.regexp_replace(text, f"^{fixed.SPACE}+|{fixed.SPACE}+$", ""), "^https?://", "")
    return F.regexp_replace(bare, r"^([^/]*)/[^\n\r\u2028\u2029]*", "$1")


def domain_list(typed: DataFrame, by: list[str], order: str, text: str = "text") -> DataFrame:
    """(*by, domain, first) of the domains that users added, each once, with the order at which it came first; empty ones are
    no domains."""
    cleaned = typed.select(*by, F.col(order).alias("first"), clean_domain(F.col(text)).alias("domain")).where("domain <> ''")
    return cleaned.groupBy(*by, "domain").agg(F.min("first").alias("first"))


def without_listed(requests: DataFrame, domains: DataFrame, host: str = "host", domain: str = "domain") -> DataFrame:
    """requests whose host no listed domain covers. Each host is cut into its suffixes, so this is an equi-join."""
    labels = F.split("__h", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    covered = requests.select(F.col(host).alias("__h")).distinct().select("__h", F.explode(suffixes).alias("__d"))
    hits = covered.join(domains.select(F.col(domain).alias("__d")).distinct(), "__d", "left_semi").select("__h").distinct()
    return requests.join(hits, requests[host] == hits["__h"], "left_anti")


def file_extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))


def is_supported(name: Column) -> Column:
    return file_extension(name).isin(fixed.EXTENSIONS)


def output_name(name: Column, suffix: str = "_masked") -> Column:
    """The suffix before the extension; formats that cannot be written back become text files."""
    extension = F.regexp_extract(name, r"\.[^.]*$", 0)
    base = F.substring(name, F.lit(1), F.length(name) - F.length(extension))
    return F.concat(base, F.lit(suffix), F.when(F.lower(extension).isin(fixed.AS_TEXT), ".txt").otherwise(extension))


def megabytes(n: Column) -> Column:
    return F.concat(F.format_string("%.0f", n / (1024 * 1024)), F.lit("MB"))


def column_letters(n: Column) -> Column:
    """0 is A, 26 is AA; up to three letters."""
    letter = lambda x: F.char((65 + x).cast("long"))
    two, three = n - 26, n - 702
    return (
        F.when(n < 26, letter(n)).when(n < 702, F.concat(letter(F.floor(two / 26)), letter(F.pmod(two, F.lit(26)))))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(F.pmod(three, F.lit(676)) / 26)), letter(F.pmod(three, F.lit(26)))))
    )


def segment_label(seg: Column, ext: Column) -> Column:
    """Where in its file a segment stands, in words: the first fitting row of the table of labels, else the id itself."""
    def said(pattern: str, template: str) -> Column:
        out = []
        for literal, group, how in re.findall(r"([^{]*)(?:\{(\d)([^}]*)\})?", template):
            part = F.regexp_extract(seg, pattern, int(group)) if group else None
            count = part.cast("long") if group else None
            out += [F.lit(literal)] * bool(literal) + ([(count + 1).cast("string") if how == "+1" else column_letters(count) if how == ":A" else part] if group else [])
        return F.concat(*out)

    label = seg
    for extensions, pattern, template in reversed(fixed.LABELS):
        fits = F.regexp_like(seg, F.lit(pattern)) & (ext.isin(extensions) if extensions else F.lit(True))
        label = F.when(fits, said(pattern, template)).otherwise(label)
    return label


def guard(lines: DataFrame, text: str = "text") -> DataFrame:
    """lines with ``match`` for each match of the guard's patterns that holds no allowed placeholder."""
    found = F.concat(*(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for p in fixed.GUARD_PATTERNS))
    allowed = lambda m: F.exists(F.array(*map(F.lit, fixed.GUARD_ALLOWED)), lambda a: F.instr(m, a) > 0)
    return lines.withColumn("match", F.explode(F.filter(found, lambda m: ~allowed(m))))


def queue_totals(files: DataFrame, queue: str, size: str = "size") -> DataFrame:
    """(queue, n_files, n_bytes): what waits in each queue; a null size counts as none."""
    return files.groupBy(queue).agg(F.count("*").alias("n_files"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n_bytes"))
