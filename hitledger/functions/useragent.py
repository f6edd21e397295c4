"""User-agent classification as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.functions import fixed_values as fv


def _first_match(agent: Column, patterns) -> Column:
    """``name/version`` of the first pattern that matches; later patterns are not tried."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(patterns):
        found = F.when(agent.rlike(pattern), F.concat(F.lit(f"{name}/"), F.regexp_extract(agent, pattern, 1))).otherwise(found)
    return F.coalesce(found, F.lit("Unknown/"))


def _bot_name(agent: Column) -> Column:
    name = F.lit("Bot")
    lowered = F.lower(agent)
    for part, label in reversed(fv.BOTS):
        name = F.when(F.contains(lowered, F.lit(part)), label).otherwise(name)
    return name


def _classify(df: DataFrame, column: str) -> DataFrame:
    """Add the five derived columns; all '' for an empty agent.

    Done in steps, so that each pattern runs once per row although name and version both use it.
    """
    agent, is_bot = F.col(column), F.col("_is_bot")

    def pick(for_bot: Column, otherwise: Column) -> Column:
        return F.when(agent == "", "/").when(is_bot, for_bot).otherwise(otherwise)

    found = df.withColumn("_is_bot", agent.rlike(fv.BOT_PATTERN)).withColumns(
        {
            "_browser": pick(F.concat(_bot_name(agent), F.lit("/")), _first_match(agent, fv.BROWSERS)),
            "_os": pick(F.lit("Bot/"), _first_match(agent, fv.SYSTEMS)),
        }
    )
    device = F.when(is_bot, "bot").when(agent.rlike(fv.MOBILE_PATTERN), "mobile").otherwise("desktop")
    columns = {
        "browser": F.substring_index("_browser", "/", 1),
        "browser_version": F.substring_index("_browser", "/", -1),
        "os": F.substring_index("_os", "/", 1),
        "os_version": F.translate(F.substring_index("_os", "/", -1), "_", "."),
        "device_type": F.when(agent == "", "").otherwise(device),
    }
    return found.withColumns(columns).drop("_is_bot", "_browser", "_os")


def parse_user_agent(df: DataFrame, *, column: str = "user_agent", via_distinct: bool = False) -> DataFrame:
    """Add browser, OS and device columns.

    ``via_distinct`` classifies each different agent once and joins the result back. That pays off
    on a stored table, where the extra pass reads one column; when rows come straight from text
    parsing, the extra pass would parse every line twice, so the default works row by row.
    """
    if not via_distinct:
        return _classify(df, column)
    return df.join(_classify(df.select(column).distinct(), column), column, "left")


def windows_release(nt_version: Column) -> Column:
    """Product name of a Windows NT version; unknown versions keep their number."""
    name = F.concat(F.lit("Windows "), nt_version)
    for version, label in fv.WINDOWS_RELEASES.items():
        name = F.when(nt_version == version, label).otherwise(name)
    return name
