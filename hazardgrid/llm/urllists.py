"""URL lists that change over time, joined to captures as of their fetch day.

Dated list events (an entry is added or removed) become validity intervals.  Each
interval is listed under the months it touches and each capture under its month, so
the as-of join is an equi join on (entry, month) that meets few intervals per capture
however long an entry's history is.  Captures are judged once per distinct URL and day.
Only column expressions and joins are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hazardgrid.session import stage

#: The kinds of entries, least specific first: a domain with all below it, one host, one URL without its fragment.
KINDS = ("domain", "host", "url")
_FOREVER = "9999-12-01"


def host_of(url: Column) -> Column:
    """Lower-case host of an http(s) URL without user, port and a final dot; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*[^/?#:.])", 1))


def page_of(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", "")


def domains_of(host: Column) -> Column:
    """The host and every domain above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(events: DataFrame) -> DataFrame:
    """``kind, entry, action, valid_from, valid_to`` (end exclusive, null while it lasts) from dated list events.

    ``events``: kind (of ``KINDS``), entry, action (``block`` or ``allow`` put the entry on a list, ``remove`` takes it
    off), day.  Of several events of an entry on a day the strictest counts (block, then allow, then remove), so
    repeated rows change nothing and an entry has at most one state per day.  Rows with a null or another kind or
    action are ignored.
    """
    rank = F.when(F.col("action") == "block", 3).when(F.col("action") == "allow", 2).when(F.col("action") == "remove", 1)
    daily = (
        events.select("kind", "entry", rank.alias("rank"), F.col("day").cast("date").alias("day")).dropna()
        .filter(F.col("kind").isin(*KINDS)).groupBy("kind", "entry", "day").agg(F.max("rank").alias("rank"))
    )
    own = Window.partitionBy("kind", "entry").orderBy("day")
    return (
        daily.withColumn("valid_to", F.lead("day").over(own)).filter("rank > 1")
        .select("kind", "entry", F.when(F.col("rank") == 3, "block").otherwise("allow").alias("action"),
                F.col("day").alias("valid_from"), "valid_to")
    )


def judge(captures: DataFrame, events: DataFrame, url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """``captures`` with ``verdict`` (block, allow or none), ``matched_kind``, ``matched_entry`` and ``listed_on``.

    An entry counts if it was active on the capture's day.  The most specific entry decides: url before host before the
    longest domain; between two lists' actions on the same entry see :func:`intervals`.  A null or unparsable URL or
    a null day matches nothing and gets ``none``.  Repeated rows each keep their row; columns of ``captures`` with the
    names added here are replaced.
    """
    added = ["verdict", "matched_kind", "matched_entry", "listed_on"]
    captures = captures.drop(*added)
    spans = intervals(events).withColumn("_until", F.coalesce("valid_to", F.lit(_FOREVER).cast("date")))
    # No capture can lie after the last one, so open intervals end there.
    last = captures.agg(F.max(F.col(day_col).cast("date")).alias("last")).first()["last"]
    month = F.sequence(F.trunc("valid_from", "month"), F.least(F.date_sub("_until", 1), F.lit(last).cast("date")), F.expr("interval 1 month"))
    listed = stage(spans.filter(F.col("valid_from") <= F.lit(last).cast("date")).withColumn("month", F.explode(month)), "url-intervals")
    seen = captures.select(F.col(url_col).alias("u"), F.col(day_col).cast("date").alias("d")).dropna().distinct()
    host = host_of(F.col("u"))
    keys = F.concat(
        F.array(F.struct(F.lit("url").alias("kind"), page_of(F.col("u")).alias("entry")), F.struct(F.lit("host").alias("kind"), host.alias("entry"))),
        F.transform(domains_of(host), lambda e: F.struct(F.lit("domain").alias("kind"), e.alias("entry"))))
    asked = seen.select("u", "d", F.trunc("d", "month").alias("month"), F.inline(keys)).filter("entry != ''")
    active = asked.join(listed, ["kind", "entry", "month"]).filter((F.col("valid_from") <= F.col("d")) & (F.col("d") < F.col("_until")))
    order = F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.length("entry"), "entry")
    verdicts = stage(active.groupBy("u", "d").agg(
        F.max_by(F.struct("action", "kind", "entry", "valid_from"), order).alias("hit")), "url-verdicts")
    joined = captures.join(
        verdicts, (F.col(url_col) == F.col("u")) & (F.col(day_col).cast("date") == F.col("d")), "left")
    return joined.select(
        *captures.columns, F.coalesce("hit.action", F.lit("none")).alias("verdict"), F.col("hit.kind").alias("matched_kind"),
        F.col("hit.entry").alias("matched_entry"), F.col("hit.valid_from").alias("listed_on"))
