"""The expressions of this package as SQL functions of a session, for users who write SQL.

A Column shows itself as SQL, but for operators, which it writes as calls; as quoted names they are functions too. So each
function's body is the text of the same expression that the DataFrame API uses: no second detector, no Python in the plan.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import checksums, fixed, headers, masking, model
from veilspark.functions.detect import ORDER, contextual_names, detect, detect_kind
from veilspark.functions.spans import SPANS, let

_CALLED = re.compile(r"'(?:[^'\\]|\\.)*'|((?<![\w`])(?:and|or|not)|[-+*/%=<>!&|^~]+)(?=\()", re.S)
_NOTED = re.compile(r"^Column<'(.*)'>$", re.S)


def text_of(column: Column) -> str:
    """A column expression as SQL that Spark parses to the same expression."""
    return _CALLED.sub(lambda m: f"`{m[1]}`" if m[1] else m[0], _NOTED.fullmatch(str(column))[1])


def _functions() -> dict[str, tuple[str, str, Callable[[], Column]]]:
    """Name: parameters, type, and what makes the body; long expressions are made when they are asked for."""
    text, category, mode, spans, modes, digits = (F.col(x) for x in ("text", "category", "mode", "spans", "modes", "digits"))
    checks = {"rrn": checksums.valid_rrn, "foreigner": checksums.valid_foreigner, "business": checksums.valid_business, "luhn": checksums.valid_luhn}
    one, some = "text STRING", "modes MAP<STRING, STRING> DEFAULT map('_', 'shape')"
    return {
        "pii_detect": (one, SPANS, lambda: detect(text)),
        "pii_names": (one, SPANS, lambda: contextual_names(text)),
        "pii_mask_value": ("text STRING, category STRING, mode STRING DEFAULT 'shape'", "string", lambda: masking.apply_mask(text, category, mode)),
        "pii_mask_spans": (f"text STRING, spans {SPANS}, {some}", "string", lambda: masking.mask_text(text, spans, modes)["text"]),
        "pii_mask": (f"text STRING, {some}", "string", lambda: let(detect(text), lambda found: masking.mask_text(text, found, modes)["text"])),
        "pii_header": (one, "string", lambda: headers.category_for_header(text)),
        "pii_korean_ratio": (one, "double", lambda: model.korean_ratio(text)),
        "pii_label": (one, "string", lambda: model.map_label(text)),
        **{f"pii_valid_{name}": ("digits STRING", "boolean", functools.partial(f, digits)) for name, f in checks.items()},
        **{f"pii_detect_{kind}": (one, SPANS, functools.partial(detect_kind, text, kind)) for kind in ORDER},
    }


def _tables() -> dict[str, tuple[str, str, str]]:
    """Name: parameters, columns and query."""
    columns = "start INT, `end` INT, span STRING, category STRING, confidence DOUBLE, source STRING"
    rows = "SELECT s.start, s.`end`, s.text, s.category, s.confidence, s.source FROM (SELECT explode(spans) AS s FROM (SELECT pii_detect({0}) AS spans))"
    keys = ", ".join(f"('{c[0]}', '{c[1]}', {str(c[2]).lower()}, '{c[3]}', {c[4]})" for c in fixed.CATEGORIES)
    return {
        "pii_spans": ("body STRING", columns, rows.format("pii_spans.body")),
        "pii_categories": ("", "category STRING, label STRING, enabled BOOLEAN, mode STRING, rank INT", f"SELECT * FROM VALUES {keys}"),
    }


def register(spark: SparkSession, *names: str) -> list[str]:
    """Creates the functions in the session, or those of the names given, anew where they are there; returns their names.

    Scalar: pii_detect(text) and pii_detect_<kind>(text) give spans, pii_mask(text) the text with what pii_detect finds masked,
    in the modes of a map by category if one is given; pii_mask_spans and pii_mask_value mask given spans and values; further
    the check digits, header words, labels. Tables: pii_spans(text) with LATERAL, pii_categories(). Spark joins the rows of a
    table function back by the text; where that is too dear, explode pii_detect(text) of a subquery with LATERAL VIEW, which
    takes one stage. A null text has no spans and stays null when masked."""
    made = []

    def create(name: str, parameters: str, returns: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
        made.append(name)

    needed = {*names, *(["pii_detect"] if "pii_spans" in names else [])}
    scalars, tables = _functions(), _tables()
    if unknown := needed - {*scalars, *tables}:
        raise ValueError(f"no such functions: {', '.join(sorted(unknown))}")
    for name, (parameters, returns, body) in scalars.items():
        if not names or name in needed:
            create(name, parameters, returns, text_of(body()))
    for name, (parameters, columns, rows) in tables.items():
        if not names or name in needed:
            create(name, parameters, f"TABLE({columns})", rows)
    return made
