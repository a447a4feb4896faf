"""Queries over the given tables, one or more for each operator."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import checksums as C
from veilspark.functions import detect as D
from veilspark.functions import fixed, headers, masking, model, spans, sql
from veilspark.functions.text import nfc, xml_decode, xml_encode
from veilspark.operators import control, decoding, evaluation, intervals, review, segments, settings
from veilspark.plans.corpus import SEEDS
from veilspark.plans.recipes import ANNOTATED, annotated_file, cells, office_files, texts
from veilspark.stored import spread, stored, work_folder
from veilspark.sources.datasource import load_segments, save_masked
from veilspark.sources.files import read_segments
from veilspark.sources.sinks import write_masked

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, for long expressions over them."""
    return spread(table(spark, sf_dir, name))


def _rows(df: DataFrame, found: Column, key: str = "key") -> DataFrame:
    return df.select(key, F.explode(found).alias("s")).select(key, "s.start", "s.end", "s.text", "s.category", F.col("s.confidence").alias("confidence"))


def _on_recipe(name: str, kind: str) -> Query:
    return lambda spark, d: _rows(texts(spark, d, name), D.detect_kind(F.col("text"), kind))


SPAN_QUERIES = {
    "mobile_spans": ("mobile", "mobile"), "mobile_attached_spans": ("mobile_attached", "mobile"), "rrn_spans": ("rrn", "rrn"), "foreigner_spans": ("foreign_registration", "foreign_registration"),
    "business_spans": ("business_number", "business_number"), "landline_spans": ("landline", "landline"), "account_spans": ("account", "account"), "driver_spans": ("driver_license", "driver_license"),
    "passport_spans": ("passport", "passport"), "corporate_spans": ("corporate_registration", "corporate_registration"), "credential_spans": ("credential", "credential"), "date_spans": ("date", "date"),
    "date_korean_spans": ("date_korean", "date"), "postal_spans": ("postal_code", "postal_code"), "bank_account_spans": ("bank_account", "bank_account"), "address_spans": ("address", "address"),
}
QUERIES |= {name: _on_recipe(*args) for name, args in SPAN_QUERIES.items()}


@query
def email_spans(spark, d):
    return _rows(_texts(spark, d, "documents"), D.detect_kind(F.col("text"), "email"), "doc_id")


@query
def card_spans(spark, d):
    return _rows(_texts(spark, d, "documents"), D.detect_kind(F.col("text"), "card"), "doc_id")


@query
def pii_counts_by_lang(spark, d):
    """Flagship: spans of all kinds in documents, by language and category."""
    found = _texts(spark, d, "documents").select("lang", F.explode(D.detect(F.col("text"))).alias("s"))
    return found.groupBy("lang", F.col("s.category").alias("category")).agg(F.count("*").alias("n_spans"), F.sum(F.col("s.end") - F.col("s.start")).cast("long").alias("n_chars"))


@query
def conversation_pii(spark, d):
    """Spans in turns of conversations, by role."""
    t = _texts(spark, d, "conversations").select("role", D.detect(F.col("text")).alias("s"))
    return t.groupBy("role").agg(F.count("*").alias("n_turns"), F.sum(F.size("s")).cast("long").alias("n_spans"))


def _emails(text: Column) -> Column:
    return D.detect_kind(text, "email")


@query
def mask_email_shape(spark, d):
    t = _rows(_texts(spark, d, "documents"), _emails(F.col("text")), "doc_id")
    return t.select("doc_id", "start", masking.apply_mask(F.col("text"), F.col("category"), F.lit("shape")).alias("masked"))


@query
def mask_card_shape(spark, d):
    t = _rows(_texts(spark, d, "documents"), D.detect_kind(F.col("text"), "card"), "doc_id")
    return t.select("doc_id", "start", masking.apply_mask(F.col("text"), F.col("category"), F.lit("shape")).alias("masked"))


def _masked_documents(mode: str) -> Query:
    return lambda spark, d: _texts(spark, d, "documents").select("doc_id", masking.mask_text(F.col("text"), _emails(F.col("text")), default=mode)["text"].alias("masked"))


for _mode in ("tag", "fake", "remove"):
    QUERIES[f"mask_{_mode}"] = _masked_documents(_mode)


@query
def masked_parts(spark, d):
    """Texts cut at e-mail addresses."""
    t = _texts(spark, d, "documents").select("doc_id", F.posexplode(masking.parts(F.col("text"), _emails(F.col("text")))).alias("i", "p"))
    return t.groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.sum(F.length("p.text")).cast("long").alias("n_chars"), F.sum(F.col("p.category").isNotNull().cast("int")).cast("long").alias("n_marked"))


def _valid(name: str, test) -> Query:
    return lambda spark, d: texts(spark, d, name).select("key", test(C.digits(F.col("text"))).alias("valid"))


QUERIES |= {"rrn_valid": _valid("rrn", C.valid_rrn), "foreigner_valid": _valid("foreign_registration", C.valid_foreigner), "business_valid": _valid("business_number", C.valid_business)}


@query
def luhn_valid(spark, d):
    """Order keys and prices as digit strings of 13 to 16 digits."""
    digits = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 7, "4"), F.lpad((F.col("o_custkey") * 7919).cast("string"), 9, "1"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), C.valid_luhn(digits).alias("valid"))


def _names(name: str, kind: str) -> Query:
    return lambda spark, d: _rows(texts(spark, d, name), D.name_kind(F.col("text"), kind))


QUERIES |= {"name_bare": _names("names", "bare"), "name_title": _names("names", "title"), "name_two_letters": _names("context_names", "two"), "name_four_letters": _names("context_names", "four"), "name_roman": _names("roman_names", "roman"), "name_file": _names("file_names", "file")}


@query
def name_context(spark, d):
    return _rows(texts(spark, d, "context_names"), D.contextual_names(F.col("text")))


@query
def name_general(spark, d):
    return _rows(texts(spark, d, "names"), D.general_names(F.col("text")))


@query
def detect_all(spark, d):
    """All detectors and the choice among overlapping spans, over texts with a name, a phone and a label."""
    return _rows(texts(spark, d, "labels"), D.detect(F.col("text")))


def _by_sql(spark: SparkSession, functions: list[str], query: str, **tables: DataFrame) -> DataFrame:
    sql.register(spark, *functions)
    return spark.sql(query, **tables)


@query
def sql_detect(spark, d):
    """pii_detect from SQL, one stage."""
    return _by_sql(spark, ["pii_detect"], "SELECT key, s.start, s.`end`, s.text, s.category, s.confidence FROM (SELECT key, pii_detect(text) AS spans FROM {labels}) LATERAL VIEW explode(spans) x AS s", labels=texts(spark, d, "labels"))


@query
def sql_spans(spark, d):
    """The table function pii_spans with LATERAL."""
    return _by_sql(spark, ["pii_spans"], "SELECT key, s.start, s.`end`, s.span AS text, s.category, s.confidence FROM {labels} AS t, LATERAL pii_spans(t.text) AS s", labels=texts(spark, d, "labels"))


@query
def sql_masked(spark, d):
    """pii_mask from SQL: documents whose e-mail addresses get a tag."""
    return _by_sql(spark, ["pii_mask_spans", "pii_detect_email"], "SELECT doc_id, pii_mask_spans(text, pii_detect_email(text), map('email', 'tag')) AS masked FROM {documents}", documents=_texts(spark, d, "documents"))


@query
def sql_valid(spark, d):
    """Check digits from SQL."""
    return _by_sql(spark, ["pii_valid_rrn"], "SELECT key, pii_valid_rrn(regexp_replace(text, '[^0-9]', '')) AS valid FROM {rrn}", rrn=texts(spark, d, "rrn"))


def _line_spans(spark: SparkSession, d: str, source: str = "regex") -> DataFrame:
    """Spans from the lines of each order: they overlap and tie often."""
    start = (F.col("l_partkey") % 23).cast("int")
    one = spans.span(start, start + (F.col("l_quantity") % 9).cast("int") + 1, F.lit("x"), F.when(F.col("l_linenumber") % 2 == 0, "mobile").otherwise("card"), F.round(F.col("l_discount") * 5 + 0.3, 2), source)
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey", one.alias("s")).alias("x"))
    return t.groupBy("key").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]).alias("spans"))


@query
def dedupe_overlap(spark, d):
    return _rows(_line_spans(spark, d), spans.dedupe(F.col("spans"))).select("key", "start", "end", "category", "confidence")


@query
def merge_iou(spark, d):
    """Lines of even number as pattern spans, odd ones as the model's."""
    side = lambda c: F.filter("spans", lambda s: s["category"] == c)
    return _rows(_line_spans(spark, d), spans.merge(side("mobile"), side("card"))).select("key", "start", "end", "category", "confidence")


@query
def mask_toggles(spark, d):
    """Phones masked by key, by category and not at all."""
    t = texts(spark, d, "mobile").withColumn("spans", D.detect_kind(F.col("text"), "mobile"))
    on = F.create_map(F.lit("mobile"), F.col("key") % 3 != 0)
    keys = F.when(F.col("key") % 2 == 0, F.lit(None).cast("array<string>")).otherwise(F.when(F.col("key") % 5 == 0, F.array().cast("array<string>")).otherwise(F.transform("spans", spans.key)))
    m = masking.mask_text(F.col("text"), F.col("spans"), enabled=on, keys=keys)
    return t.select("key", m["text"].alias("masked"), F.size(m["applied"]).alias("n_applied"), F.size(m["skipped"]).alias("n_skipped"))


@query
def mask_partial_name(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("김민수", "이영", "남궁민수", "박"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), masking.apply_mask(name, F.lit("person_name"), F.lit("partial")).alias("masked"))


@query
def mask_account(spark, d):
    t = _rows(texts(spark, d, "account"), D.detect_kind(F.col("text"), "account"))
    return t.select("key", masking.apply_mask(F.col("text"), F.lit("account"), F.lit("shape")).alias("masked"))


SHAPES = {"mask_mobile": ("mobile", "mobile"), "mask_rrn": ("rrn", "rrn"), "mask_business": ("business_number", "business_number"), "mask_driver": ("driver_license", "driver_license"), "mask_passport": ("passport", "passport"), "mask_corporate": ("corporate_registration", "corporate_registration"), "mask_postal": ("postal_code", "postal_code"), "mask_address": ("address", "address"), "mask_credential": ("credential", "credential"), "mask_landline": ("landline", "landline")}


def _shape(name: str, kind: str) -> Query:
    return lambda spark, d: _rows(texts(spark, d, name), D.detect_kind(F.col("text"), kind)).select("key", masking.apply_mask(F.col("text"), F.col("category"), F.lit("shape")).alias("masked"))


QUERIES |= {name: _shape(*args) for name, args in SHAPES.items()}


@query
def mask_examples(spark, d):
    """A sample of each category under each mode, for the categories that the parts' types hash to."""
    names = [c[0] for c in fixed.CATEGORIES]
    category = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    sample = F.element_at(F.create_map(*(F.lit(x) for kv in fixed.SAMPLES.items() for x in kv)), category)
    shown = lambda mode: F.lit(fixed.REMOVED) if mode == "remove" else masking.apply_mask(sample, category, F.lit(mode))
    return table(spark, d, "part").select(category.alias("category"), *(shown(m).alias(f"m_{m}") for m in fixed.MODES)).groupBy("category", *(f"m_{m}" for m in fixed.MODES)).agg(F.count("*").alias("n"))


@query
def header_row(spark, d):
    return segments.header_columns(cells(spark, d), ["doc"])


@query
def forced_cells(spark, d):
    marked = segments.mark_cells(cells(spark, d), ["doc"])
    return marked.groupBy("col", "is_header", "forced_category", "name_hint_only").agg(F.count("*").alias("n"))


def _marked_cells(spark: SparkSession, d: str) -> DataFrame:
    # stored, so that the long expressions over it are planned once and not again at each adaptive step of the joins
    return spread(stored(segments.mark_cells(cells(spark, d), ["doc"])))


@query
def masked_cells(spark, d):
    """Header words decide what is masked in each column."""
    done = segments.mask_segments(segments.detect_segments(_marked_cells(spark, d)))
    return done.select("doc", "row", "col", "masked", "n_applied")


@query
def masked_cells_as_saved(spark, d):
    """The same in the modes of a new user's settings: names faked, organisations tagged."""
    done = segments.mask_segments(segments.detect_segments(_marked_cells(spark, d)), modes=settings.default_modes())
    return done.select("doc", "row", "col", "masked", "n_applied")


@query
def inline_labels(spark, d):
    t = texts(spark, d, "labels").select("key", F.explode(headers.inline_labels(F.col("text"))).alias("s"))
    return t.select("key", "s.label", "s.value_start", "s.value_end", "s.category")


def _entities() -> tuple[Column, Column]:
    """A text for each customer and what a model may find in it."""
    k, names = F.col("c_custkey"), ("김", "이", "박")
    last = F.element_at(F.array(*map(F.lit, names)), (k % 3 + 1).cast("int"))
    text = F.concat(F.lit("담당 "), last, F.lit("민수님은 한빛재단 a1 "), k.cast("string"))
    e = lambda label, word, a, b, s: F.struct(F.lit(label).alias("label"), word.alias("word"), (F.lit(a) if a is not None else F.lit(None)).cast("int").alias("start"), (F.lit(b) if b is not None else F.lit(None)).cast("int").alias("end"), s.cast("double").alias("score"))
    return text, F.array(e("B-SURNAME", last, 3, 4, F.lit(0.9)), e("I-GIVENNAME", F.lit("민수님은"), 4, 8, F.round(F.lit(0.2) + (k % 8) / 10, 2)), e("B-ORG", F.lit("한빛재단"), 9, 13, F.lit(0.99)), e("PER", F.lit("a1"), None, None, F.round(F.lit(0.1) + (k % 9) / 10, 2)))


@query
def adjacent_names(spark, d):
    """Entities to spans: labels, thresholds, found words, joined names."""
    text, found = _entities()
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), text.alias("t"), found.alias("e"))
    return _rows(t.withColumn("s0", model.merge_adjacent_names(F.col("t"), model.entity_spans(F.col("t"), F.col("e")))), F.col("s0")).withColumn("confidence", F.round("confidence", 6))


@query
def particle_trim(spark, d):
    text, found = _entities()
    t = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), text.alias("t"), found.alias("e"))
    return _rows(t, model.model_spans(F.col("t"), F.col("e"))).select("key", "start", "end", "text")


@query
def ner_filter(spark, d):
    words = ("do", "Kim", "심리학", "김민수", "CEO", "okay")
    word = F.element_at(F.array(*map(F.lit, words)), (F.col("c_custkey") % 6 + 1).cast("int"))
    one = F.array(spans.span(F.lit(0), F.length(word), word, F.when(F.col("c_custkey") % 7 == 0, "address").otherwise("person_name"), F.when(F.col("c_custkey") % 2 == 0, 0.9).otherwise(0.5), "model"))
    return _rows(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), one.alias("s0")), model.filter_false_names(F.col("s0")))


@query
def map_label(spark, d):
    labels = ("B-PER", "I-SURNAME", "ORG", "E-STREET", "DATEOFBIRTH", "S-IDCARD", "USERNAME", "TELEPHONENUM")
    label = F.element_at(F.array(*map(F.lit, labels)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select(label.alias("label"), model.map_label(label).alias("category")).groupBy("label", "category").agg(F.count("*").alias("n"))


def _tag_scores(spark: SparkSession, d: str, tags: list[str]) -> DataFrame:
    row = F.array(*(-F.abs(F.col("l_quantity") * (i + 1) % 7 - F.col("l_discount") * 50) for i in range(len(tags))))
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.struct("l_linenumber", "l_partkey", row.alias("s")).alias("x"))
    return t.groupBy("key").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]).alias("scores"))


def _viterbi(tags: list[str], scheme: str) -> Query:
    def run(spark, d):
        t = _tag_scores(spark, d, tags).select("key", F.explode(decoding.viterbi(F.col("scores"), tags, scheme)).alias("s"))
        return t.select("key", "s.start", "s.end", "s.category", F.round("s.score", 6).alias("score"))

    return run


QUERIES |= {"viterbi_bio": _viterbi(["O", "B-X", "I-X", "B-Y", "I-Y"], "bio"), "viterbi_bioes": _viterbi(["O", "B-X", "I-X", "E-X", "S-X"], "bioes")}


@query
def korean_ratio(spark, d):
    return texts(spark, d, "names").select("key", F.round(model.korean_ratio(F.col("text")), 6).alias("ratio"))


@query
def pick_model(spark, d):
    mode = F.element_at(F.array(*map(F.lit, ("default", "multilingual", "precision_high"))), (F.col("key") % 3 + 1).cast("int"))
    have = F.when(F.col("key") % 2 == 0, F.array(F.lit("tier2-multilingual"))).otherwise(F.array(F.lit("tier2-precision"), F.lit("tier2-multilingual")))
    return texts(spark, d, "names").select("key", model.pick_model(F.col("text"), mode, have).alias("tier"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Phones and names with what they hold, some of it on purpose not what the detectors find."""
    t = texts(spark, d, "labels")
    item = lambda text, category: F.struct(text.alias("text"), F.lit(category).alias("category"))
    name = F.regexp_extract("text", "^성명: ([^\n]*)", 1)
    phone = F.regexp_extract("text", "연락처= ([0-9-]+)", 1)
    return t.select("key", F.filter(D.detect(F.col("text")), lambda s: s["category"].isin("person_name", "mobile")).alias("predicted"), evaluation.expected_spans(F.col("text"), F.array(item(name, "person_name"), item(phone, "mobile"))).alias("expected"))


@query
def eval_prf(spark, d):
    r = evaluation.evaluate(_cases(spark, d))
    return r.select("category", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query
def eval_join(spark, d):
    """eval_prf with expected and found spans as two tables, joined where they overlap."""
    cases = stored(_cases(spark, d))
    r = intervals.evaluate_tables(intervals.as_table(cases, ["key"], "predicted"), intervals.as_table(cases, ["key"], "expected"), ["key"])
    return r.select("category", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query
def span_overlaps(spark, d):
    """Pairs of overlapping spans of the lines of orders, odd lines against even ones."""
    start = F.col("l_partkey") % 23
    one = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("i"), start.alias("start"), (start + F.col("l_quantity") % 9 + 1).cast("long").alias("end"))
    met = intervals.overlapping(one.where("i % 2 = 1"), one.where("i % 2 = 0"), ["key"])
    return met.groupBy("key").agg(F.count("*").alias("n_pairs"), F.sum(F.least("l.end", "r.end") - F.greatest("l.start", "r.start")).cast("long").alias("n_shared"))


@query
def quality_gate(spark, d):
    """The gate over the same cases; texts of documents without Hangul hold no Korean name."""
    negative = _texts(spark, d, "documents").select(F.size(D.general_names(F.col("text"))).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"))
    gate = evaluation.gate(evaluation.evaluate(_cases(spark, d)), 0).select("name_f1").crossJoin(negative)
    return gate.select(F.round("name_f1", 6).alias("name_f1"), F.col("hits").alias("negative_hits"), ((F.col("name_f1") >= fixed.NAME_F1) & (F.col("hits") <= fixed.NEGATIVE_HITS)).alias("passed"))


@query
def file_admission(spark, d):
    files = table(spark, d, "documents").select("doc_id", F.col("lang").alias("queue"), (F.col("n_chars") * 16384).alias("size"))
    return control.admit(files, "queue", "doc_id").select("doc_id", "reason")


@query
def stats_total(spark, d):
    events = table(spark, d, "events").select("ts", (F.col("event_id") % 7 - 1).alias("spans"))
    s = control.stats(events)
    return s.select("confirms", "spans_masked", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"))


@query
def host_match(spark, d):
    """Pages outside the domains that every 25th page is from."""
    pages = table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"))
    listed = pages.where("page_id % 25 = 0").select(F.regexp_extract("host", r"[^.]+\.[^.]+\.[^.]+$", 0).alias("domain")).distinct()
    return control.without_listed(pages, listed).select("page_id", "host")


@query
def site_adapters(spark, d):
    hosts = ("chatgpt.com", "www.claude.ai", "notclaude.ai", "gemini.google.com", "a.b.perplexity.ai", "orangeimpact.kr", "google.com")
    host = F.element_at(F.array(*map(F.lit, hosts)), (F.col("user_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select(host.alias("host"), control.site_of(host).alias("site")).groupBy("host", "site").agg(F.count("*").alias("n"))


@query
def domain_list(spark, d):
    """Addresses of pages as users type them, as each user's list of domains."""
    k = F.col("page_id") % 4
    typed = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("\u3000"), F.col("url"), F.lit(" \t"))).when(k == 2, F.upper("url")).otherwise(F.concat(F.lit(" "), F.parse_url("url", F.lit("HOST"))))
    return control.domain_list(table(spark, d, "pages").select(F.col("page_id").alias("at"), (F.col("page_id") % 7).alias("user"), typed.alias("text")), ["user"], "at")


@query
def clean_domains(spark, d):
    return table(spark, d, "pages").select("page_id", control.clean_domain(F.concat(F.lit(" "), F.col("url"), F.lit(" "))).alias("domain"))


@query
def commit_guard(spark, d):
    return control.guard(texts(spark, d, "mobile")).select("key", "match")


@query
def nfc_text(spark, d):
    split = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("e" + chr(0x301))), F.lit("ü"), F.lit("u" + chr(0x308)))
    return _texts(spark, d, "documents").select("doc_id", F.md5(nfc(split)).alias("md5"))


@query
def xml_entities(spark, d):
    t = table(spark, d, "pages").select("page_id", F.col("html").alias("h"))
    return t.select("page_id", F.md5(xml_encode(F.col("h"))).alias("encoded"), F.md5(xml_decode(F.col("h"))).alias("decoded"), (xml_decode(xml_encode(F.col("h"))) == F.col("h")).alias("same"))


@query
def output_names(spark, d):
    ends = (".docx", ".HWP", ".png", "", ".tar.csv", ".pdf")
    name = F.concat(F.lit("part "), F.col("p_partkey").cast("string"), F.element_at(F.array(*map(F.lit, ends)), (F.col("p_partkey") % 6 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", control.output_name(name).alias("name"), control.is_supported(name).alias("supported"))


@query
def segment_labels(spark, d):
    k = F.col("p_partkey")
    seg = F.element_at(F.array(F.concat(F.lit("r"), k.cast("string"), F.lit("c"), (k % 800).cast("string")), F.concat(F.lit("t"), k.cast("string")), F.concat(F.lit("ppt/slides/slide"), k.cast("string"), F.lit(".xml#4")), F.concat(F.lit("exif::"), F.lit("Artist")), F.concat(F.lit("p"), k.cast("string")), F.concat(F.lit("xlsxcomment::S!A"), k.cast("string"), F.lit("#0::a")), F.concat(F.lit("Contents/section"), k.cast("string"), F.lit(".xml#0"))), (k % 7 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, (".csv", ".docx", ".pptx", ".jpg", ".pdf", ".xlsx", ".hwpx"))), (k % 7 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", control.segment_label(seg, ext).alias("label"))


def _csv_files(spark: SparkSession, d: str) -> DataFrame:
    """The sheets of ``cells`` as CSV files."""
    lines = cells(spark, d).groupBy("doc", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), ",").alias("line"))
    files = lines.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return files.select(F.concat(F.lit("in/"), F.col("doc").cast("string"), F.lit(".csv")).alias("path"), F.encode("body", "UTF-8").alias("content"))


@query
def csv_segments(spark, d):
    s = read_segments(_csv_files(spark, d))
    return s.groupBy("path", "is_header", "forced_category", "name_hint_only").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("n_chars"))


def _masked_and_read_again(files: DataFrame) -> DataFrame:
    done = stored(segments.mask_segments(segments.detect_segments(stored(read_segments(files)))).select("path", "seq", "seg_id", "masked"))
    return read_segments(stored(write_masked(files, done).select("path", "content"))).select("path", "seg_id", "text")


@query
def csv_roundtrip(spark, d):
    """CSV files read, masked, written and read again: the texts that come back."""
    return _masked_and_read_again(stored(_csv_files(spark, d)))


@query
def saved_roundtrip(spark, d):
    """CSV files masked, saved as files with commit, and loaded from there by the source of segments."""
    files, to = stored(_csv_files(spark, d)), work_folder(spark)
    done = segments.mask_segments(segments.detect_segments(read_segments(files))).select("path", "seq", "seg_id", "masked")
    save_masked(files, done, to, below="in")
    return load_segments(spark, to).select(F.concat(F.lit("in/"), F.regexp_extract("path", r"([^/]*)_masked(\.csv)$", 1), F.lit(".csv")).alias("path"), "seg_id", "text")


@query
def office_extras(spark, d):
    """Notes, comments, links, headers, names and properties of files, masked, written and read again, beside plain texts."""
    return _masked_and_read_again(stored(functools.reduce(DataFrame.unionByName, (office_files(spark, d, ext, annotated_file) for ext in ANNOTATED))))


def _office_roundtrip(ext: str) -> Query:
    return lambda spark, d: _masked_and_read_again(stored(office_files(spark, d, ext)))


QUERIES |= {f"{ext[1:]}_roundtrip": _office_roundtrip(ext) for ext in (".docx", ".pptx", ".hwpx", ".xlsx")}


@query
def detect_overlaps(spark, d):
    """Texts in which hits of several kinds lie over one another."""
    return _rows(texts(spark, d, "overlaps"), D.detect(F.col("text")))


@query
def detect_merged(spark, d):
    """Patterns and a model's entities together; for every ninth customer the model gave nothing."""
    _, found = _entities()
    k = F.col("c_custkey")
    last = F.element_at(F.array(*map(F.lit, ("김", "이", "박"))), (k % 3 + 1).cast("int"))
    t = spread(table(spark, d, "customer")).select(k.alias("key"), F.concat(F.lit("담당 "), last, F.lit("민수님은 한빛재단 a1")).alias("t"), F.when(k % 9 != 0, found).alias("e"))
    return _rows(t, D.detect_with_model(F.col("t"), F.col("e"))).withColumn("confidence", F.round("confidence", 6))


@query
def seed_gate(spark, d):
    """Each customer has one of the seed texts; precision and recall of the patterns by gated category."""
    spans_of = lambda t, found: F.array(*(F.struct(F.lit(t.index(x)).alias("start"), F.lit(t.index(x) + len(x)).alias("end"), F.lit(x).alias("text"), F.lit(c).alias("category")) for x, c in found)).cast("array<struct<start:int,end:int,text:string,category:string>>")
    one = F.element_at(F.array(*(F.struct(F.lit(t).alias("text"), spans_of(t, found).alias("expected")) for t, found in SEEDS)), (F.col("c_custkey") % len(SEEDS) + 1).cast("int"))
    cases = spread(table(spark, d, "customer")).select(one.alias("x")).select(D.detect(F.col("x.text")).alias("predicted"), "x.expected")
    r = evaluation.gates(evaluation.evaluate(cases), fixed.SEED_GATES)
    return r.select("category", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "least", "passed")


@query
def json_cases(spark, d):
    """Cases written as JSON and read back, one file for each hundred customers."""
    t = texts(spark, d, "labels")
    item = F.struct(F.concat(F.lit("c"), "key").alias("id"), F.when(F.col("key") % 4 == 3, "negative").otherwise("positive").alias("kind"), "text", F.array(F.struct(F.regexp_extract("text", "연락처= ([0-9-]+)", 1).alias("text"), F.lit("mobile").alias("category"))).alias("expected"))
    files = t.groupBy(F.floor(F.col("key") / 100).alias("file")).agg(evaluation.written_cases(F.collect_list(item)).alias("json"))
    return files.select(F.explode(evaluation.read_cases(F.col("json"))).alias("c")).select("c.id", "c.kind", "c.text", F.size("c.expected").alias("n"), F.col("c.expected")[0]["text"].alias("first"))


@query
def false_hit_sample(spark, d):
    """The first ten spans found in texts that are said to hold nothing."""
    t = texts(spark, d, "mobile").select("key", D.detect_kind(F.col("text"), "mobile").alias("predicted"), F.when(F.col("key") % 2 == 0, F.array()).otherwise(F.array(F.lit("x"))).alias("expected"))
    return evaluation.false_hits(t, ["key"])


@query
def eval_latency(spark, d):
    """Times of events by type."""
    t = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 11 != 0, (F.col("user_id") % 97) / 2).alias("ms"))
    return evaluation.latency(t, "ms", ["event_type"]).withColumn("average", F.round("average", 6))


@query
def queue_totals(spark, d):
    files = table(spark, d, "documents").select(F.col("lang").alias("queue"), (F.col("n_chars") * 16384).alias("size"))
    return control.queue_totals(files, "queue")


@query
def settings_merged(spark, d):
    """Stored settings of several ages over the defaults."""
    k = F.col("c_custkey")
    raw = F.element_at(F.array(*map(F.lit, (None, '{"theme":"dark"}', '{"stats":{"totalConfirmed":7}}', "no json", '{"enabledByCategory":{"url":true},"userMode":"multilingual"}'))), (k % 5 + 1).cast("int"))
    t = table(spark, d, "customer").select(k.alias("key"), settings.settings(settings.stored(settings.settings(raw))).alias("s"))
    return t.select("key", F.col("s.theme").alias("theme"), F.col("s.userMode").alias("user_mode"), F.col("s.stats.totalConfirmed").alias("confirmed"), F.col("s.stats.totalSpansMasked").alias("spans_masked"), F.size(F.filter(F.map_values("s.enabledByCategory"), lambda x: x)).alias("n_enabled"), F.size("s.modeByCategory").alias("n_modes"))


def _review(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines' spans and the keys of those that start at an even place."""
    return _line_spans(spark, d).withColumn("keys", review.keys_of(F.filter("spans", lambda s: s["start"] % 2 == 0)))


@query
def review_counts(spark, d):
    t = _review(spark, d).withColumn("keys", F.when(F.col("key") % 3 != 0, F.col("keys")))
    return review.counts(t, ["key"])


@query
def bulk_toggle(spark, d):
    """Keys after all of one category, then after all, are switched, and those left off."""
    on = F.col("key") % 2 == 0
    said = lambda keys: F.array_join(F.array_sort(keys), ",")
    one = review.toggle(F.col("keys"), F.col("spans"), on, "mobile")
    return _review(spark, d).select("key", said(one).alias("one"), said(review.switched_off(F.col("spans"), one)).alias("off"), F.size(review.toggle(F.col("keys"), F.col("spans"), on)).alias("n_all"))


@query
def visible_categories(spark, d):
    return _line_spans(spark, d).select("key", F.array_join(review.visible_categories(F.col("spans")), ",").alias("shown"))


@query
def auto_apply(spark, d):
    late = F.filter("spans", lambda s: s["start"] >= 12)
    return _line_spans(spark, d).select("key", review.auto_apply(F.size(late), F.col("key") % 5 == 0).alias("skip"))


@query
def review_groups(spark, d):
    """Segments with phones by file, as a review shows them; every fourth segment holds none."""
    k = F.col("key")
    found = texts(spark, d, "mobile").select(F.format_string("f%d.docx", F.floor(k / 4)).alias("path"), F.lit(".docx").alias("ext"), (k % 4).alias("seq"), F.format_string("t%d", k % 4).alias("seg_id"), F.when(k % 7 != 0, D.detect_kind(F.col("text"), "mobile")).alias("spans"))
    return review.groups(found).select("path", "seq", "seg_id", "label", F.size("spans").alias("n"), "flat", "large")
