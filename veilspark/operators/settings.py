"""A user's settings: what a new user has, and stored JSON over it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.functions.spans import let, table

STATS = "struct<totalConfirmed:bigint,totalSpansMasked:bigint,lastConfirmedAt:string>"
SETTINGS = f"struct<enabledByCategory:map<string,boolean>,modeByCategory:map<string,string>,whitelistedDomains:array<string>,userMode:string,stats:{STATS},theme:string,autoApplyMaskWithoutReview:boolean>"


def default_enabled() -> Column:
    return table({c[0]: c[2] for c in fixed.CATEGORIES})


def default_modes() -> Column:
    return table({c[0]: c[3] for c in fixed.CATEGORIES})


def settings(raw: Column) -> Column:
    """SETTINGS of stored JSON. A field that is missing or null has its default; maps and lists replace the default whole, while
    the counters of stats are merged one by one. Null JSON, or what is no JSON object, gives the defaults."""
    def merged(r: Column) -> Column:
        field = lambda name, default: F.coalesce(r[name], default).alias(name)
        stats = F.struct(*(F.coalesce(r["stats"][c], F.lit(0).cast("bigint")).alias(c) for c in ("totalConfirmed", "totalSpansMasked")), r["stats"]["lastConfirmedAt"].alias("lastConfirmedAt"))
        return F.struct(
            field("enabledByCategory", default_enabled()), field("modeByCategory", default_modes()), field("whitelistedDomains", F.array().cast("array<string>")),
            field("userMode", F.lit(fixed.SETTINGS["userMode"])), stats.alias("stats"), field("theme", F.lit(fixed.SETTINGS["theme"])), field("autoApplyMaskWithoutReview", F.lit(fixed.SETTINGS["autoApplyMaskWithoutReview"])),
        )

    return let(F.from_json(raw, SETTINGS), merged)


def stored(value: Column) -> Column:
    """The JSON of settings, as ``settings`` reads it back."""
    return F.to_json(value)
