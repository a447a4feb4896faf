"""DuckDB SQL for the queries of veilspark.plans.queries. Its patterns are of another dialect: \\b is an ASCII word
boundary there, and there is no look-around."""

from __future__ import annotations

from veilspark.functions import fixed
from veilspark.plans.recipes import ANNOTATED, CELLS, LETTERS, NAMES, SHEET, case, texts_sql

ORACLES: dict[str, str] = {}
_q = lambda s: "'" + s.replace("'", "''") + "'"
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
_CARD = r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"
_D = r"regexp_replace(m, '\D', '', 'g')"


def _digit(d: str, i) -> str:
    return f"cast(substring({d}, {i}, 1) as int)"


def _sum(d: str, weights) -> str:
    return "(" + " + ".join(f"{w} * {_digit(d, i)}" for i, w in enumerate(weights, 1)) + ")"


def _luhn(d: str) -> str:
    twice = f"(2 * {_digit(d, 'i')})"
    return f"(length({d}) BETWEEN 13 AND 19 AND {d} <> repeat('0', length({d})) AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 1 THEN {twice} - CASE WHEN {twice} > 9 THEN 9 ELSE 0 END ELSE {_digit(d, 'i')} END)) % 10 = 0)"


def _day(d: str) -> str:
    month = f"cast(substring({d}, 3, 2) as int)"
    return f"({month} BETWEEN 1 AND 12 AND cast(substring({d}, 5, 2) as int) BETWEEN 1 AND ([31,29,31,30,31,30,31,31,30,31,30,31])[{month}])"


def _rrn(d: str, plus: int = 0) -> str:
    return f"(length({d}) = 13 AND {_day(d)} AND ((11 - {_sum(d, fixed.RRN_WEIGHTS)} % 11) % 10 + {plus}) % 10 = {_digit(d, 13)})"


def _biz(d: str) -> str:
    return f"(length({d}) = 10 AND (10 - ({_sum(d, fixed.BUSINESS_WEIGHTS)} + cast(floor({_digit(d, 9)} * 5 / 10) as int)) % 10) % 10 = {_digit(d, 10)})"


#: Fixed values, as in fixed.PATTERNS, in this dialect. kind: patterns, category, confidence, test of the match m
KINDS = {
    "mobile": ([r"\b01[016789][-\s]?\d{3,4}[-\s]?\d{4}\b"], "mobile", 0.95, f"length({_D}) BETWEEN 10 AND 11"),
    "rrn": ([r"\b\d{6}[-\s]?[1-4]\d{6}\b"], "rrn", 0.99, _rrn(_D)),
    "foreign_registration": ([r"\b\d{6}[-\s]?[5-8]\d{6}\b"], "foreign_registration", 0.97, _rrn(_D, 2)),
    "business_number": ([r"\b\d{3}[-\s]?\d{2}[-\s]?\d{5}\b"], "business_number", 0.95, _biz(_D)),
    "landline": ([r"\b(?:02|0(?:3[1-3]|4[1-4]|5[1-5]|6[1-4])|070|050[5-7])[-\s]\d{3,4}[-\s]\d{4}\b"], "landline", 0.85, "true"),
    "account": ([r"\b\d{3}-\d{2}-\d{6}\b", r"\b\d{3}-\d{3}-\d{6}\b", r"\b\d{3}-\d{6}-\d{2}-\d{3}\b", r"\b\d{4}-\d{3}-\d{6}\b", r"\b\d{4}-\d{2}-\d{6}\b", r"\b\d{4}-\d{4}-\d{4}-\d{4}\b"], "account", 0.7, f"NOT (length({_D}) = 16 AND {_luhn(_D)})"),
    "driver_license": ([r"\b(?:1[1-9]|2[0-8])-\d{2}-\d{6}-\d{2}\b"], "driver_license", 0.85, "true"),
    "passport": ([r"\b[MRSO]\d{8}\b"], "passport", 0.85, "true"),
    "corporate_registration": ([r"\b\d{6}-\d{7}\b"], "corporate_registration", 0.8, f"{_D} <> repeat(left({_D}, 1), 13) AND substring({_D}, 7, 1) NOT BETWEEN '1' AND '8'"),
    "credential": ([r"\bsk-[A-Za-z0-9_-]{16,}\b", r"\b(?:xoxb|xoxp|xoxs|xoxa)-[A-Za-z0-9-]{16,}\b", r"\bAKIA[0-9A-Z]{16}\b", r"\bASIA[0-9A-Z]{16}\b", r"\bgh[pousr]_[A-Za-z0-9]{16,}\b", r"(?i)\b(?:postgres|postgresql|mysql|mongodb|redis|amqp)(?:\+[a-z]+)?://[^\s:@]+:[^\s@]+@[^\s/]+"], "credential", 0.95, "true"),
    "date_numeric": ([r"\b(?:19|20)\d{2}[-./](?:0?[1-9]|1[0-2])[-./](?:0?[1-9]|[12]\d|3[01])\b"], "date", 0.7, "cast(regexp_extract(m, '^[0-9]+.[0-9]+.([0-9]+)$', 1) as int) <= ([31,29,31,30,31,30,31,31,30,31,30,31])[cast(regexp_extract(m, '^[0-9]+.([0-9]+).', 1) as int)] AND NOT regexp_matches(substring(t, greatest(1, start - 19)::bigint, least(20, start)::bigint), '(?i)\\b(version|build|release|patch|rev|tag|v)\\s+$')"),
    "date_korean": ([r"\b(?:19|20)\d{2}년\s?(?:0?[1-9]|1[0-2])월\s?(?:0?[1-9]|[12]\d|3[01])일"], "date", 0.85, "cast(regexp_extract(m, '월[^0-9]?([0-9]+)일$', 1) as int) <= ([31,29,31,30,31,30,31,31,30,31,30,31])[cast(regexp_extract(m, '년[^0-9]?([0-9]+)월', 1) as int)]"),
    "bank_account": ([rf"(?:{'|'.join(fixed.BANKS)})\s*\d[\d\s\-]{{6,23}}\d"], "account", 0.85, f"length({_D}) BETWEEN 8 AND 16 AND {_D} <> repeat(left({_D}, 1), length({_D}))"),
    "address": ([rf"(?:{'|'.join(fixed.PROVINCES)})(?:\s+[가-힣]{{1,10}}(?:시|군|구))?\s+[가-힣A-Za-z0-9]{{1,20}}(?:동|로|길|읍|면|리)(?:[ \t,0-9가-힣\-]{{0,40}})?"], "address", 0.75, "true"),
    "email": ([_EMAIL], "email", 0.95, "true"),
    "card": ([_CARD], "card", 0.95, f"length({_D}) = 16 AND {_luhn(_D)}"),
}


def spans(source: str, kind: str, more: str = "") -> str:
    """(key, t, start, m, category, confidence, *more) of the matches in ``source`` (key, t, *more)."""
    patterns, category, confidence, test = KINDS[kind]
    return " UNION ALL ".join(
        f"""SELECT key, t, start, m, {_q(category)} AS category, {confidence}::double AS confidence{more} FROM (
  SELECT *, sum(gap + length(m)) OVER (PARTITION BY key{more} ORDER BY i) - length(m) AS start FROM (
    SELECT key, t{more}, unnest(regexp_extract_all(t, {_q(p)}, 0)) AS m, unnest(list_transform(string_split_regex(t, {_q(p)}), lambda x: length(x))) AS gap, unnest(range(length(t) + 1)) AS i
    FROM ({source}) WHERE regexp_matches(t, {_q(p)})) WHERE m IS NOT NULL) WHERE {test}"""
        for p in patterns
    )


def _shown(inner: str, key: str = "key", m: str = "m") -> str:
    return f'SELECT key AS {key}, start::int AS start, (start + length({m}))::int AS "end", {m} AS text, category, confidence FROM ({inner})'


_DOCS = "SELECT doc_id AS key, coalesce(text, '') AS t FROM documents"
for _name, (_recipe, _kind) in {
    "mobile_spans": ("mobile", "mobile"), "mobile_attached_spans": ("mobile_attached", "mobile"), "rrn_spans": ("rrn", "rrn"), "foreigner_spans": ("foreign_registration", "foreign_registration"),
    "business_spans": ("business_number", "business_number"), "landline_spans": ("landline", "landline"), "account_spans": ("account", "account"), "driver_spans": ("driver_license", "driver_license"),
    "passport_spans": ("passport", "passport"), "corporate_spans": ("corporate_registration", "corporate_registration"), "credential_spans": ("credential", "credential"), "date_spans": ("date", "date_numeric"),
    "date_korean_spans": ("date_korean", "date_korean"), "bank_account_spans": ("bank_account", "bank_account"),
}.items():
    ORACLES[_name] = _shown(spans(texts_sql(_recipe), _kind))
ORACLES["address_spans"] = _shown(spans(texts_sql("address"), "address"), m=r"regexp_replace(m, '[\s,\-]+$', '')")
ORACLES["email_spans"], ORACLES["card_spans"] = _shown(spans(_DOCS, "email"), "doc_id"), _shown(spans(_DOCS, "card"), "doc_id")
# one five-digit number in each text, after a known word
_postal = "regexp_extract(t, '([0-9]{5}) end$', 1)"
ORACLES["postal_spans"] = f"""SELECT key, (length(t) - 9)::int AS start, (length(t) - 4)::int AS "end", {_postal} AS text, 'postal_code' AS category, CASE WHEN t LIKE '우편번호%' THEN 0.9 ELSE 0.55 END::double AS confidence
FROM ({texts_sql("postal_code")}) WHERE {_postal} < '70000' AND (t LIKE '우편번호%' OR t LIKE '서울%')"""
_every = " UNION ALL ".join(f"({spans('SELECT doc_id AS key, lang, coalesce(text, chr(32)) AS t FROM documents', k, ', lang')})" for k in ("rrn", "foreign_registration", "passport", "driver_license", "corporate_registration", "business_number", "card", "account", "mobile", "landline", "email", "credential", "date_numeric"))
ORACLES["pii_counts_by_lang"] = f"SELECT lang, category, count(*) AS n_spans, sum(length(m))::bigint AS n_chars FROM ({_every}) GROUP BY ALL"
_turns = " UNION ALL ".join(f"({spans('SELECT conv_id * 1000 + turn AS key, role, coalesce(text, chr(32)) AS t FROM conversations', k, ', role')})" for k in ("rrn", "business_number", "card", "account", "mobile", "landline", "email", "credential", "date_numeric"))
ORACLES["conversation_pii"] = f"SELECT role, count(*) AS n_turns, coalesce(any_value(n), 0)::bigint AS n_spans FROM conversations LEFT JOIN (SELECT role, count(*) AS n FROM ({_turns}) GROUP BY role) USING (role) GROUP BY role"
_star = "regexp_extract(m, '^([^@])', 1) || repeat('*', greatest(2, length(regexp_extract(m, '^[^@]([^@]*)@', 1)))) || regexp_extract(m, '@.+$', 0)"
ORACLES["mask_email_shape"] = f"SELECT key AS doc_id, start::int AS start, {_star} AS masked FROM ({spans(_DOCS, 'email')})"
ORACLES["mask_card_shape"] = f"SELECT key AS doc_id, start::int AS start, left({_D}, 4) || '-XXXX-XXXX-' || right({_D}, 4) AS masked FROM ({spans(_DOCS, 'card')})"
for _mode, _word in (("tag", fixed.TAGS["email"]), ("fake", fixed.FAKES["email"]), ("remove", "")):
    ORACLES[f"mask_{_mode}"] = f"SELECT doc_id, regexp_replace(text, {_q(_EMAIL)}, {_q(_word)}, 'g') AS masked FROM documents"
ORACLES["masked_parts"] = f"""WITH s AS ({spans(_DOCS, "email")}), n AS (SELECT key, count(*) AS n, count(*) FILTER (start > 0 AND start > coalesce(prev, -1)) AS before, max(start + length(m)) AS last FROM (SELECT *, lag(start + length(m)) OVER (PARTITION BY key ORDER BY start) AS prev FROM s) GROUP BY key)
SELECT doc_id, (coalesce(n + before, 0) + CASE WHEN length(text) > coalesce(last, 0) THEN 1 ELSE 0 END)::bigint AS n_parts, length(text)::bigint AS n_chars, coalesce(n, 0)::bigint AS n_marked FROM documents LEFT JOIN n ON key = doc_id WHERE length(text) > 0"""
_t = r"regexp_replace(t, '\D', '', 'g')"
ORACLES["rrn_valid"] = f"SELECT key, {_rrn(_t)} AS valid FROM ({texts_sql('rrn')})"
ORACLES["foreigner_valid"] = f"SELECT key, {_rrn(_t, 2)} AND substring({_t}, 7, 1) BETWEEN '5' AND '8' AS valid FROM ({texts_sql('foreign_registration')})"
ORACLES["business_valid"] = f"SELECT key, {_biz(_t)} AS valid FROM ({texts_sql('business_number')})"
ORACLES["luhn_valid"] = f"SELECT key, {_luhn('d')} AS valid FROM (SELECT o_orderkey AS key, lpad(o_orderkey::varchar, 7, '4') || lpad((o_custkey * 7919)::varchar, 9, '1') AS d FROM orders)"


def _known(recipe: str, rows: list[tuple[int, str, int, float]], n: int, where: str = "true") -> str:
    """Spans that the recipe puts there: for key modulo n, the text, its start and confidence."""
    values = ", ".join(f"({i}, {_q(text)}, {start}, {confidence})" for i, text, start, confidence in rows)
    return f"""SELECT key, v.start::int AS start, (v.start + length(v.text))::int AS "end", v.text, 'person_name' AS category, v.confidence::double AS confidence
FROM ({texts_sql(recipe)}) JOIN (VALUES {values}) v(i, text, start, confidence) ON key % {n} = v.i WHERE {where}"""


# names are followed by a title, a particle or a blank, in turn; 이메일 is no name
ORACLES["name_bare"] = _known("names", [(0, "김민수", 3, 0.6), (1, "이영희", 3, 0.6), (2, "남궁민수", 3, 0.6)], 4)
ORACLES["name_title"] = _known("names", [(0, "김민수", 3, 0.85), (1, "이영희", 3, 0.85), (2, "남궁민수", 3, 0.85), (3, "이메일", 3, 0.85)], 4, "key % 3 = 0")
ORACLES["name_general"] = f"{ORACLES['name_bare']} AND key % 3 <> 0 UNION ALL {ORACLES['name_title']}"
ORACLES["name_two_letters"] = _known("context_names", [(0, "박영", 3, 0.5)], 5)
ORACLES["name_four_letters"] = _known("context_names", [(2, "김아무개", 3, 0.4)], 5)
ORACLES["name_context"] = _known("context_names", [(0, "박영", 3, 0.5), (2, "김아무개", 3, 0.4)], 5)
ORACLES["name_roman"] = _known("roman_names", [(0, "KimDoeFoo", 5, 0.5), (1, "LeeAB", 5, 0.5), (2, "DoeFooPark", 5, 0.5)], 5)
ORACLES["name_file"] = _known("file_names", [(0, "임꺽정", 0, 0.7), (1, "홍길동", 0, 0.7), (2, "조달청", 0, 0.7)], 4)
# a label's text: a name after it, then a phone
_name4 = case("key", NAMES)
ORACLES["detect_all"] = f"""SELECT key, 4 AS start, (4 + length({_name4}))::int AS "end", {_name4} AS text, 'person_name' AS category, 0.6::double AS confidence FROM ({texts_sql("labels")}) WHERE key % 4 <> 3
UNION ALL {_shown(spans(texts_sql("labels"), "mobile"))}"""

_rank = "CASE category WHEN 'card' THEN 90 ELSE 70 END"
_lines = """SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS i, (l_partkey % 23)::int AS s, (l_partkey % 23 + l_quantity::int % 9 + 1)::int AS e,
 CASE WHEN l_linenumber % 2 = 0 THEN 'mobile' ELSE 'card' END AS category, round(l_discount * 5 + 0.3, 2) AS confidence FROM lineitem"""
_keep = "(list_reduce(list_transform({l}, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {clash})) > 0 THEN acc ELSE acc || x END))"
_fields = "{'s': s, 'e': e, 'category': category, 'confidence': confidence}"
ORACLES["dedupe_overlap"] = f"""WITH g AS (SELECT key, list({_fields} ORDER BY s - e, confidence DESC, {_rank} DESC, i) AS l FROM ({_lines}) GROUP BY key)
SELECT key, x.s AS start, x.e AS "end", x.category, x.confidence FROM (SELECT key, unnest({_keep.format(l="l", clash="k.s < x[1].e AND x[1].s < k.e")}) AS x FROM g)"""
_shared = "greatest(0, least(k.e, x[1].e) - greatest(k.s, x[1].s))"
_near = f"{_shared} > 0 AND {_shared} / ((k.e - k.s) + (x[1].e - x[1].s) - {_shared}) >= 0.5"
_same = "(k.s = x[1].s AND k.e = x[1].e AND k.category = x[1].category)"
# all pattern spans first, each kept whatever lies under it; then the model's by confidence
ORACLES["merge_iou"] = f"""WITH g AS (SELECT key, list({_fields} ORDER BY category DESC, CASE WHEN category = 'card' THEN -confidence END, i) AS l FROM ({_lines}) GROUP BY key)
SELECT key, x.s AS start, x.e AS "end", x.category, x.confidence FROM (SELECT key, unnest({_keep.format(l="l", clash=f"x[1].category = 'card' AND ({_same} OR ({_near}))")}) AS x FROM g)"""

_m = spans(texts_sql("mobile"), "mobile")
_on = "(key % 3 <> 0 AND (key % 2 = 0 OR key % 5 <> 0))"
_x = "regexp_replace(m, '-[0-9]{4}-[0-9]{4}$', '-XXXX-XXXX')"
ORACLES["mask_toggles"] = f"SELECT key, CASE WHEN {_on} THEN replace(t, m, {_x}) ELSE t END AS masked, CASE WHEN {_on} THEN 1 ELSE 0 END AS n_applied, CASE WHEN {_on} THEN 0 ELSE 1 END AS n_skipped FROM ({_m})"
ORACLES["mask_partial_name"] = "SELECT c_custkey AS key, CASE c_custkey % 4 WHEN 0 THEN '김O수' WHEN 1 THEN '이O' WHEN 2 THEN '남OO수' ELSE '박' END AS masked FROM customer"
_hidden = f"list_aggregate(list_transform(range(1, length(m) + 1), lambda i: CASE WHEN substring(m, i, 1) BETWEEN '0' AND '9' AND length(regexp_replace(substring(m, 1, i - 1), '\\D', '', 'g')) >= 3 AND length(regexp_replace(substring(m, i + 1), '\\D', '', 'g')) >= 3 THEN 'X' ELSE substring(m, i, 1) END), 'string_agg', '')"
ORACLES["mask_account"] = f"SELECT key, {_hidden} AS masked FROM ({spans(texts_sql('account'), 'account')})"
for _name, _kind, _as in (
    ("mask_mobile", "mobile", _x), ("mask_rrn", "rrn", "left(m, 6) || '-XXXXXXX'"), ("mask_business", "business_number", "left(m, 6) || '-XXXXX'"), ("mask_driver", "driver_license", "left(m, 5) || '-XXXXXX-XX'"),
    ("mask_passport", "passport", "left(m, 1) || 'XXXXXXXX'"), ("mask_corporate", "corporate_registration", "left(m, 6) || '-XXXXXXX'"), ("mask_credential", "credential", "repeat('●', least(16, length(m)))"),
    ("mask_address", "address", r"repeat('●', length(regexp_replace(m, '[\s,\-]+$', '')))"), ("mask_landline", "landline", "regexp_extract(m, '^[0-9]+') || regexp_replace(regexp_replace(m, '^[0-9]+', ''), '[0-9]', 'X', 'g')"),
):
    ORACLES[_name] = f"SELECT key, {_as} AS masked FROM ({spans(texts_sql(_kind), _kind)})"
ORACLES["mask_postal"] = f"SELECT key, 'XXXXX' AS masked FROM ({ORACLES['postal_spans']})"


def _example(category: str, mode: str) -> str:
    sample = fixed.SAMPLES[category]
    shape = {"rrn": "900101-XXXXXXX", "foreign_registration": "850515-XXXXXXX", "driver_license": "11-25-XXXXXX-XX", "mobile": "010-XXXX-XXXX", "landline": "02-XXXX-XXXX", "account": "110-XXX-XXX890", "card": "4111-XXXX-XXXX-1111", "business_number": "120-86-XXXXX", "corporate_registration": "130111-XXXXXXX", "passport": "MXXXXXXXX", "email": "m****@example.com", "postal_code": "XXXXX", "credential": "●" * 16}.get(category, "●" * len(sample))
    return {"shape": shape, "partial": "홍O동" if category == "person_name" else shape, "tag": fixed.TAGS[category], "fake": fixed.FAKES[category], "remove": fixed.REMOVED}[mode]


_all = ", ".join(f"({i}, {_q(c[0])}, " + ", ".join(_q(_example(c[0], m)) for m in fixed.MODES) + ")" for i, c in enumerate(fixed.CATEGORIES))
_cols = ", ".join(f"m_{m}" for m in fixed.MODES)
ORACLES["mask_examples"] = f"SELECT category, {_cols}, count(*) AS n FROM part JOIN (VALUES {_all}) v(i, category, {_cols}) ON p_partkey % {len(fixed.CATEGORIES)} = i GROUP BY ALL"

_heads = "(VALUES (0, 'person_name', false), (1, 'mobile', false), (2, 'organization', false), (3, NULL, true)) h(col, category, name_hint)"
ORACLES["header_row"] = f"SELECT DISTINCT {SHEET} AS doc, 1 AS header_row, h.col, h.category, h.name_hint FROM customer CROSS JOIN {_heads}"
_cells = f"SELECT c.*, c.row = 1 AS is_header, CASE WHEN c.row <> 1 THEN h.category END AS forced_category, c.row <> 1 AND coalesce(h.name_hint, false) AS name_hint_only FROM ({CELLS}) c LEFT JOIN {_heads} ON h.col = c.col"
ORACLES["forced_cells"] = f"SELECT col, is_header, forced_category, name_hint_only, count(*) AS n FROM ({_cells}) GROUP BY ALL"
ORACLES["masked_cells"] = f"""SELECT doc, row, col, CASE WHEN forced_category IN ('person_name', 'organization') THEN repeat('●', greatest(2, length(text))) WHEN forced_category = 'mobile' THEN left(text, 3) || '-XXXX-XXXX'
  WHEN name_hint_only THEN '●●' || substring(text, 3) ELSE text END AS masked, CASE WHEN forced_category IS NOT NULL OR name_hint_only THEN 1 ELSE 0 END AS n_applied FROM ({_cells})"""
_phone_at = "instr(t, '010-')"
ORACLES["inline_labels"] = f"""SELECT key, '성명' AS label, 4 AS value_start, (4 + length({_name4}))::int AS value_end, 'person_name' AS category FROM ({texts_sql("labels")})
UNION ALL SELECT key, '연락처', ({_phone_at} - 1)::int, ({_phone_at} + 12)::int, 'mobile' FROM ({texts_sql("labels")})"""

# entities: a surname, a given name with a particle, an organisation, a word without a place
_given, _word = "round(0.2 + (c_custkey % 8) / 10, 2)", "round(0.1 + (c_custkey % 9) / 10, 2)"
_last = "([" + "'김','이','박'" + "])[c_custkey % 3 + 1]"
_ents = f"""SELECT c_custkey AS key, 3 AS start, CASE WHEN {_given} >= 0.3 THEN 8 ELSE 4 END AS "end", {_last} || CASE WHEN {_given} >= 0.3 THEN '민수님은' ELSE '' END AS text, CASE WHEN {_given} >= 0.3 THEN (0.9 + {_given}) / 2 ELSE 0.9 END AS confidence FROM customer
UNION ALL SELECT c_custkey, 14, 16, 'a1', {_word} FROM customer WHERE {_word} >= 0.3"""
ORACLES["adjacent_names"] = f'SELECT key, start, "end", text, \'person_name\' AS category, round(confidence::double, 6) AS confidence FROM ({_ents})'
ORACLES["particle_trim"] = f'SELECT key, start, CASE WHEN text LIKE \'%님은\' THEN 6 ELSE "end" END AS "end", regexp_replace(text, \'님은$\', \'\') AS text FROM ({_ents})'
ORACLES["ner_filter"] = """SELECT * FROM (SELECT c_custkey AS key, 0 AS start, length(w)::int AS "end", w AS text, CASE WHEN c_custkey % 7 = 0 THEN 'address' ELSE 'person_name' END AS category, CASE WHEN c_custkey % 2 = 0 THEN 0.9 ELSE 0.5 END::double AS confidence
FROM (SELECT c_custkey, (['do', 'Kim', '심리학', '김민수', 'CEO', 'okay'])[c_custkey % 6 + 1] AS w FROM customer)) WHERE category = 'address' OR NOT (text IN ('do', 'okay', '심리학') OR (text IN ('Kim', 'CEO') AND confidence < 0.85))"""
ORACLES["map_label"] = "SELECT label, category, count(*) AS n FROM part JOIN (VALUES (0, 'B-PER', 'person_name'), (1, 'I-SURNAME', 'person_name'), (2, 'ORG', NULL), (3, 'E-STREET', 'address'), (4, 'DATEOFBIRTH', 'date'), (5, 'S-IDCARD', 'rrn'), (6, 'USERNAME', NULL), (7, 'TELEPHONENUM', 'mobile')) v(i, label, category) ON p_partkey % 8 = i GROUP BY ALL"
_ratio = "round(length(regexp_replace(t, '[^가-힯ᄀ-ᇿ㄰-㆏]', '', 'g')) / length(t), 6)"
ORACLES["korean_ratio"] = f"SELECT key, {_ratio}::double AS ratio FROM ({texts_sql('names')})"
ORACLES["pick_model"] = f"SELECT key, CASE WHEN key % 3 = 2 AND key % 2 = 1 THEN 'tier2-precision' WHEN key % 3 = 1 AND {_ratio} < 0.4 THEN 'tier2-multilingual' ELSE 'tier1-default' END AS tier FROM ({texts_sql('names')})"

# of the labels' texts, every name but 이메일 and every phone is found
_prf = """SELECT category, tp, fp, fn, 1.0::double AS precision, round(tp / (tp + fn), 6)::double AS recall, round(2 * tp / (2 * tp + fn), 6)::double AS f1 FROM (
SELECT 'person_name' AS category, count(*) FILTER (c_custkey % 4 <> 3) AS tp, 0::bigint AS fp, count(*) FILTER (c_custkey % 4 = 3) AS fn FROM customer UNION ALL SELECT 'mobile', count(*), 0, 0 FROM customer)"""
ORACLES["eval_prf"] = _prf
ORACLES["quality_gate"] = f"SELECT f1 AS name_f1, 0::bigint AS negative_hits, f1 >= 0.93 AS passed FROM ({_prf}) WHERE category = 'person_name'"
ORACLES["file_admission"] = """WITH RECURSIVE f AS (SELECT doc_id, lang, n_chars * 16384 AS size, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
w AS (SELECT doc_id, lang, i, CASE WHEN size > 104857600 THEN 'file-too-large' WHEN size > 524288000 THEN 'queue-total-exceeded' END AS reason, CASE WHEN size > 104857600 THEN 0 ELSE size END AS total FROM f WHERE i = 1
UNION ALL SELECT f.doc_id, f.lang, f.i, CASE WHEN f.size > 104857600 THEN 'file-too-large' WHEN w.total + f.size > 524288000 THEN 'queue-total-exceeded' END, CASE WHEN f.size > 104857600 OR w.total + f.size > 524288000 THEN w.total ELSE w.total + f.size END FROM w JOIN f ON f.lang = w.lang AND f.i = w.i + 1)
SELECT doc_id, reason FROM w"""
ORACLES["stats_total"] = "SELECT count(*) AS confirms, sum(greatest(0, event_id % 7 - 1))::bigint AS spans_masked, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events"
_host = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"
ORACLES["host_match"] = f"""WITH p AS (SELECT page_id, {_host} AS host FROM pages), d AS (SELECT DISTINCT regexp_extract(host, '[^.]+\\.[^.]+\\.[^.]+$') AS domain FROM p WHERE page_id % 25 = 0)
SELECT page_id, host FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE host = domain OR ends_with(host, '.' || domain))"""
ORACLES["site_adapters"] = "SELECT host, site, count(*) AS n FROM events JOIN (VALUES (0, 'chatgpt.com', 'chatgpt'), (1, 'www.claude.ai', 'claude'), (2, 'notclaude.ai', NULL), (3, 'gemini.google.com', 'gemini'), (4, 'a.b.perplexity.ai', 'perplexity'), (5, 'orangeimpact.kr', 'orange-impact'), (6, 'google.com', NULL)) v(i, host, site) ON user_id % 7 = i GROUP BY ALL"
ORACLES["clean_domains"] = "SELECT page_id, split_part(regexp_replace(trim(url), '^https?://', ''), '/', 1) AS domain FROM pages"
_allow = "[" + ", ".join(map(_q, fixed.GUARD_ALLOWED)) + "]"
ORACLES["commit_guard"] = f"SELECT key, m AS match FROM (SELECT key, unnest(regexp_extract_all(t, '01[016789]-[0-9]{{4}}-[0-9]{{4}}', 0)) AS m FROM ({texts_sql('mobile')})) WHERE len(list_filter({_allow}, lambda a: contains(m, a))) = 0"
ORACLES["nfc_text"] = "SELECT doc_id, md5(nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ü', 'u' || chr(776)))) AS md5 FROM documents"
_enc = "replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_dec = "replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&apos;', chr(39))"
ORACLES["xml_entities"] = f"SELECT page_id, md5({_enc}) AS encoded, md5({_dec}) AS decoded, {_dec.replace('html', _enc)} = html AS same FROM pages"
ORACLES["output_names"] = "SELECT p_partkey, 'part ' || p_partkey || (['_masked.docx', '_masked.txt', '_masked.txt', '_masked', '.tar_masked.csv', '_masked.txt'])[p_partkey % 6 + 1] AS name, p_partkey % 6 <> 3 AS supported FROM part"
_letters = "CASE WHEN n < 26 THEN chr(65 + n) WHEN n < 702 THEN chr(65 + (n - 26) // 26) || chr(65 + (n - 26) % 26) ELSE chr(65 + (n - 702) // 676) || chr(65 + ((n - 702) % 676) // 26) || chr(65 + (n - 702) % 26) END"
ORACLES["segment_labels"] = f"""SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN (p_partkey + 1) || '행 ' || {_letters} || '열' WHEN 1 THEN '본문 ' || (p_partkey + 1) || '번째 텍스트' WHEN 2 THEN '슬라이드 ' || p_partkey || ' (5번째 텍스트)'
  WHEN 3 THEN '이미지 메타: Artist' WHEN 4 THEN p_partkey || '페이지' WHEN 5 THEN 'S!A' || p_partkey || ' 코멘트 작성자' ELSE '섹션 ' || (p_partkey + 1) || ' (1번째 텍스트)' END AS label FROM (SELECT p_partkey, (p_partkey % 800)::int AS n FROM part)"""
ORACLES["csv_segments"] = f"SELECT 'in/' || doc || '.csv' AS path, is_header, forced_category, name_hint_only, count(*) AS n, sum(length(text))::bigint AS n_chars FROM ({_cells}) GROUP BY ALL"
ORACLES["csv_roundtrip"] = f"SELECT 'in/' || doc || '.csv' AS path, 'r' || row || 'c' || col AS seg_id, masked AS text FROM ({ORACLES['masked_cells']})"
ORACLES["masked_cells_as_saved"] = f"""SELECT doc, row, col, CASE WHEN forced_category = 'person_name' THEN {_q(fixed.FAKES['person_name'])} WHEN forced_category = 'organization' THEN {_q(fixed.TAGS['organization'])} WHEN forced_category = 'mobile' THEN left(text, 3) || '-XXXX-XXXX'
  WHEN name_hint_only THEN {_q(fixed.FAKES['person_name'])} || substring(text, 3) ELSE text END AS masked, CASE WHEN forced_category IS NOT NULL OR name_hint_only THEN 1 ELSE 0 END AS n_applied FROM ({_cells})"""

# office files: lines first, then a table with a header; in workbooks a row for each customer
_letters_of = f"SELECT *, row_number() OVER (PARTITION BY doc ORDER BY key) - 1 AS i, count(*) OVER (PARTITION BY doc) AS n FROM ({LETTERS})"
_hidden_line = r"regexp_replace(line, '-[0-9]{4}-[0-9]{4}', '-XXXX-XXXX')"
for _ext, _id in ((".docx", "'t' || j"), (".pptx", "'ppt/slides/slide1.xml#' || j"), (".hwpx", "'Contents/section0.xml#' || j")):
    ORACLES[f"{_ext[1:]}_roundtrip"] = f"""WITH l AS ({_letters_of}), r AS (SELECT doc, i AS j, {_hidden_line} AS text FROM l
UNION ALL SELECT DISTINCT doc, n, '성명' FROM l UNION ALL SELECT DISTINCT doc, n + 1, '비고' FROM l
UNION ALL SELECT doc, n + 2 + 2 * i, repeat('●', length(name)) FROM l UNION ALL SELECT doc, n + 3 + 2 * i, memo FROM l)
SELECT 'in/' || doc || '{_ext}' AS path, {_id} AS seg_id, text FROM r"""
ORACLES["xlsx_roundtrip"] = f"""WITH l AS ({_letters_of}), r AS (SELECT DISTINCT doc, unnest(['S!A1', 'S!B1', 'S!C1', 'xlsxprops::Author']) AS seg_id, unnest(['성명', '연락', '비고', 'a' || repeat('*', greatest(2, length(doc::varchar))) || '@b.example']) AS text FROM l
UNION ALL SELECT doc, 'S!A' || (i + 2), repeat('●', length(name)) FROM l
UNION ALL SELECT doc, 'S!B' || (i + 2), regexp_extract(line, '^[^0-9]*[0-9]+') || regexp_replace(regexp_replace(line, '^[^0-9]*[0-9]+', ''), '[0-9]', 'X', 'g') FROM l UNION ALL SELECT doc, 'S!C' || (i + 2), memo FROM l)
SELECT 'in/' || doc || '.xlsx' AS path, seg_id, text FROM r"""

_over = " UNION ALL ".join(f"({spans(texts_sql('overlaps'), k)})" for k in ("card", "account", "mobile", "landline", "email", "bank_account", "date_numeric"))
_rank_of = "CASE category " + " ".join(f"WHEN {_q(c[0])} THEN {c[4]}" for c in fixed.CATEGORIES) + " END"
# the greedy choice over all kinds; roman names are whole words here, and only in one of the texts
_roman = f"SELECT key, t, 2 AS start, 'KimLee' AS m, 'person_name' AS category, 0.5::double AS confidence FROM ({texts_sql('overlaps')}) WHERE key % 6 = 4"
ORACLES["detect_overlaps"] = f"""WITH c AS ({_over} UNION ALL {_roman}), g AS (SELECT key, list({{'s': start::int, 'e': (start + length(m))::int, 'm': m, 'category': category, 'confidence': confidence}} ORDER BY length(m) DESC, confidence DESC, {_rank_of} DESC) AS l FROM c GROUP BY key)
SELECT key, x.s AS start, x.e AS "end", x.m AS text, x.category, x.confidence FROM (SELECT key, unnest({_keep.format(l="l", clash="k.s < x[1].e AND x[1].s < k.e")}) AS x FROM g)"""
ORACLES["detect_merged"] = f"""SELECT c_custkey AS key, 3 AS start, 6 AS "end", {_last} || '민수' AS text, 'person_name' AS category, 0.85::double AS confidence FROM customer
UNION ALL SELECT c_custkey, 3, 4, {_last}, 'person_name', 0.9 FROM customer WHERE c_custkey % 9 <> 0 AND {_given} < 0.3
UNION ALL SELECT c_custkey, 14, 16, 'a1', 'person_name', {_word} FROM customer WHERE c_custkey % 9 <> 0 AND {_word} >= 0.3"""
ORACLES["seed_gate"] = f"SELECT category, 1.0::double AS precision, 1.0::double AS recall, least::double AS least, true AS passed FROM (VALUES {', '.join(f'({_q(c)}, {x})' for c, x in fixed.SEED_GATES.items())}) v(category, least) WHERE (SELECT count(*) FROM customer) > 28"
ORACLES["json_cases"] = f"SELECT 'c' || key AS id, CASE WHEN key % 4 = 3 THEN 'negative' ELSE 'positive' END AS kind, t AS text, 1 AS n, regexp_extract(t, '연락처= ([0-9-]+)', 1) AS first FROM ({texts_sql('labels')})"
ORACLES["false_hit_sample"] = f"SELECT key, m AS text, category FROM ({_m}) WHERE key % 2 = 0 ORDER BY key LIMIT 10"
ORACLES["eval_latency"] = "SELECT event_type, count(*) AS n_cases, coalesce(sum(ms), 0)::double AS total, round(avg(ms), 6)::double AS average FROM (SELECT event_type, CASE WHEN event_id % 11 <> 0 THEN (user_id % 97) / 2 END AS ms FROM events) GROUP BY event_type"
ORACLES["queue_totals"] = "SELECT lang AS queue, count(*) AS n_files, coalesce(sum(n_chars * 16384), 0)::bigint AS n_bytes FROM documents GROUP BY lang"
_on_default = sum(c[2] for c in fixed.CATEGORIES)
ORACLES["settings_merged"] = f"""WITH r AS (SELECT c_custkey AS key, ([NULL, '{{"theme":"dark"}}', '{{"stats":{{"totalConfirmed":7}}}}', 'no json', '{{"enabledByCategory":{{"url":true}},"userMode":"multilingual"}}'])[c_custkey % 5 + 1] AS raw FROM customer),
j AS (SELECT key, CASE WHEN json_valid(raw) THEN raw ELSE '{{}}' END AS s FROM r)
SELECT key, coalesce(s ->> '$.theme', 'light') AS theme, coalesce(s ->> '$.userMode', 'default') AS user_mode, coalesce((s ->> '$.stats.totalConfirmed')::bigint, 0) AS confirmed, coalesce((s ->> '$.stats.totalSpansMasked')::bigint, 0) AS spans_masked,
  CASE WHEN json_exists(s, '$.enabledByCategory') THEN len(list_filter(json_extract_string(s, '$.enabledByCategory.*'), lambda x: x = 'true'))::int ELSE {_on_default} END AS n_enabled, {len(fixed.CATEGORIES)} AS n_modes FROM j"""
_keyed = f"SELECT *, s || ':' || e || ':' || category AS k FROM ({_lines})"
ORACLES["review_counts"] = f'SELECT key, category, count(*) AS total, count(*) FILTER (key % 3 = 0 OR s % 2 = 0) AS "on" FROM ({_lines}) GROUP BY ALL'
ORACLES["bulk_toggle"] = f"""WITH g AS (SELECT key, coalesce(list(DISTINCT k), []) AS every, coalesce(list(DISTINCT k) FILTER (s % 2 = 0), []) AS even, coalesce(list(DISTINCT k) FILTER (category = 'mobile'), []) AS mobile FROM ({_keyed}) GROUP BY key),
t AS (SELECT *, CASE WHEN key % 2 = 0 THEN list_distinct(even || mobile) ELSE list_filter(even, lambda x: NOT list_contains(mobile, x)) END AS one FROM g)
SELECT key, array_to_string(list_sort(one), ',') AS one, array_to_string(list_sort(list_filter(every, lambda x: NOT list_contains(one, x))), ',') AS off, CASE WHEN key % 2 = 0 THEN len(every) ELSE 0 END::int AS n_all FROM t"""
ORACLES["visible_categories"] = f"SELECT key, concat_ws(',', CASE WHEN bool_or(category = 'mobile') THEN 'mobile' END, CASE WHEN bool_or(category = 'card') THEN 'card' END) AS shown FROM ({_lines}) GROUP BY key"
ORACLES["auto_apply"] = f"SELECT key, count(*) FILTER (s >= 12) = 0 OR key % 5 = 0 AS skip FROM ({_lines}) GROUP BY key"
ORACLES["review_groups"] = f"""WITH f AS (SELECT * FROM ({_m}) WHERE key % 7 <> 0), t AS (SELECT *, count(*) OVER (PARTITION BY floor(key / 4)) AS total FROM f)
SELECT 'f' || floor(key / 4)::bigint || '.docx' AS path, key % 4 AS seq, 't' || key % 4 AS seg_id, '본문 ' || (key % 4 + 1) || '번째 텍스트' AS label, 1 AS n, total <= {fixed.FLAT} AS flat, total > {fixed.LARGE} AS large FROM t"""
ORACLES |= {"sql_detect": ORACLES["detect_all"], "sql_spans": ORACLES["detect_all"], "sql_masked": ORACLES["mask_tag"], "sql_valid": ORACLES["rrn_valid"]}
ORACLES["saved_roundtrip"] = ORACLES["csv_roundtrip"]
ORACLES["eval_join"] = ORACLES["eval_prf"]
_lines_of = "SELECT l_orderkey AS key, l_linenumber AS i, l_partkey % 23 AS s, l_partkey % 23 + cast(l_quantity AS bigint) % 9 + 1 AS e FROM lineitem"
ORACLES["span_overlaps"] = f"SELECT l.key, count(*) AS n_pairs, sum(least(l.e, r.e) - greatest(l.s, r.s))::bigint AS n_shared FROM ({_lines_of}) l JOIN ({_lines_of}) r ON l.key = r.key AND l.i % 2 = 1 AND r.i % 2 = 0 AND l.s < r.e AND r.s < l.e GROUP BY l.key"
ORACLES["clean_domains"] = "SELECT page_id, regexp_replace(regexp_replace(trim(url), '^https?://', ''), '/.*', '') AS domain FROM pages"
ORACLES["domain_list"] = """WITH t AS (SELECT page_id, CASE page_id % 4 WHEN 2 THEN upper(url) WHEN 3 THEN regexp_extract(url, '://([^/?#]+)', 1) ELSE url END AS x FROM pages),
c AS (SELECT page_id, regexp_replace(regexp_replace(x, '^https?://', ''), '/.*', '') AS domain FROM t)
SELECT page_id % 7 AS user, domain, min(page_id) AS first FROM c WHERE domain <> '' GROUP BY ALL"""
_author = "'a' || repeat('*', greatest(2, length(doc::varchar))) || '@b.example'"
_as_sql = {"plain": "'plain'", "L": "hidden", "A": _author, "mailto:A": f"'mailto:' || {_author}", '"A"': f"'\"' || {_author} || '\"'"}
ORACLES["office_extras"] = f"WITH l AS (SELECT doc, arg_min({_hidden_line}, key) AS hidden FROM ({LETTERS}) GROUP BY doc) " + " UNION ALL ".join(
    f"SELECT 'in/' || doc || '{ext}' AS path, '{seg}' AS seg_id, {_as_sql[text]} AS text FROM l" for ext, (_, segs) in ANNOTATED.items() for seg, text in segs.items()
)


def _best_path(tags: list[str], scheme: str) -> str:
    """The decoder as a recursive query: for each time and tag the best score so far and its path; ties go to the lower tag."""
    split = [(t[0], t[2:]) for t in tags]
    open_end = scheme == "bio"

    def may(p, n):
        if p[0] in "BI":
            return n[1] == p[1] if n[0] in "IE" else open_end
        return n[0] in "OBS"

    never, n = "-1e9::double", len(tags)
    first = ", ".join(f"s[1][{j + 1}]" if may(("O", ""), x) else never for j, x in enumerate(split))
    best, path = [], []
    for j, x in enumerate(split):
        came = [f"CASE WHEN best[{i + 1}] > -1e9 THEN best[{i + 1}] + s[t + 1][{j + 1}] ELSE {never} END" for i, p in enumerate(split) if may(p, x)]
        from_ = [i for i, p in enumerate(split) if may(p, x)]
        most = f"greatest({', '.join(came)}, {never})"
        best.append(most)
        path.append("CASE " + " ".join(f"WHEN ({c}) = ({most}) THEN list_append(path[{i + 1}], {j + 1})" for c, i in zip(came, from_, strict=True)) + f" ELSE list_append(path[1], {j + 1}) END")
    scores = ", ".join(f"-abs((l_quantity * {i + 1}) % 7 - l_discount * 50)" for i in range(n))
    kind, category = ([f"'{x[k]}'" for x in split] for k in (0, 1))
    return f"""WITH RECURSIVE r AS (SELECT l_orderkey AS key, list([{scores}]::double[] ORDER BY l_linenumber, l_partkey, [{scores}]::double[]) AS s FROM lineitem GROUP BY 1),
v AS (SELECT key, s, 1 AS t, [{first}] AS best, [{', '.join(f'[{j + 1}]' for j in range(n))}] AS path FROM r
UNION ALL SELECT key, s, t + 1, [{', '.join(best)}], [{', '.join(path)}] FROM v WHERE t < len(s)),
e AS (SELECT key, s, path[list_position(best, list_max(best))] AS p FROM v WHERE t = len(s)),
k AS (SELECT key, s, p, unnest(generate_series(1, len(p))) AS i FROM e),
m AS (SELECT key, s, p, i, [{', '.join(kind)}][p[i]] AS kind, [{', '.join(category)}][p[i]] AS category FROM k),
w AS (SELECT key, i, kind, category, s[i][p[i]] AS score, sum(CASE WHEN kind IN ('I', 'E') THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY i) AS g FROM m)
SELECT key, (min(i) - 1)::int AS start, max(i)::int AS "end", arg_min(category, i) AS category, round(avg(score), 6) AS score FROM w GROUP BY key, g HAVING arg_min(kind, i) IN ('B', 'S')"""


for _scheme, _tags in (("bio", ["O", "B-X", "I-X", "B-Y", "I-Y"]), ("bioes", ["O", "B-X", "I-X", "E-X", "S-X"])):
    ORACLES[f"viterbi_{_scheme}"] = _best_path(_tags, _scheme)
