"""Not-modified revisits of a web archive, resolved to the response they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnchorus.llm.shared import durable

RESPONSE, REVISIT = "response", "revisit"
# Header fields that a not-modified answer may bring for the stored response.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that do not name another page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """One form of a page's addresses.

    Scheme, a leading ``www.``, default port, fragment, tracking parameters, the order of parameters and a
    trailing slash do not matter; the host is lower-cased.
    """
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    asked = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked)))


def _lower_keys(headers: Column) -> Column:
    """Header fields by lower-case name; of equal names the last counts."""
    entries = F.transform(
        F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))
    )
    numbered = F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i")))
    last = F.filter(
        numbered,
        lambda e: ~F.exists(numbered, lambda o: (o["key"] == e["key"]) & (o["i"] > e["i"])),
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def _validator(headers: Column, name: str) -> Column:
    """A validator's value; a weak entity tag compares like a strong one. Empty ones are none."""
    value = F.regexp_replace(F.trim(headers[name]), "^W/", "")
    return F.when(value != "", value)


def resolve_revisits(
    captures: DataFrame,
    capture: str = "capture_id",
    url: str = "url",
    at: str = "captured_at",
    kind: str = "kind",
    headers: str = "headers",
) -> DataFrame:
    """Every not-modified revisit with the full response it repeats.

    General: the project keeps no web archive. ``captures`` has one row per record: key, address, time,
    kind (``response``: a full one, or ``revisit``) and a map of header fields. A revisit is joined, by
    canonical address, to the latest response captured before it (at equal times the one with the
    largest key). Their validators decide the ``outcome``:

    * ``resolved``: the entity tags are equal, or, unless both sides have one, the modification times;
    * ``changed``: they differ, so the stored response is not what the revisit saw;
    * ``unverified``: no validator on both sides;
    * ``missing``: no earlier response.

    Returns one row per revisit: key, ``url_key``, ``response_id``, ``response_at`` (null if missing), ``outcome`` and
    ``merged_headers``: where resolved, the response's fields with those replaced that the revisit brings
    and a not-modified answer may change; otherwise null.

    Rows with a null address are ``missing``; a null time comes before all others; null headers are none; other kinds
    are ignored; repeated rows count each; further columns are ignored.

    Records are range-partitioned by address and time, so that an address with very many records
    spreads over several partitions; each looks back within its partition, and the latest response of every
    earlier partition is carried over (a row per address and partition).
    """
    rows = captures.where(F.col(kind).isin(RESPONSE, REVISIT)).select(
        F.col(capture).alias("id"),
        canonical_url(F.col(url)).alias("url_key"),
        F.col(at).alias("at"),
        (F.col(kind) == RESPONSE).alias("full"),
        _lower_keys(F.col(headers)).alias("fields"),
    )
    # A revisit sees responses of earlier times only: at one time revisits come first.
    spread = rows.repartitionByRange(F.col("url_key"), F.col("at"), F.col("full"), F.col("id"))
    placed = durable(spread.withColumn("part", F.spark_partition_id()))
    response = F.when(F.col("full"), F.struct("id", "at", "fields"))
    back = (
        Window.partitionBy("url_key", "part")
        .orderBy("at", "full", "id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    seen = placed.where("url_key IS NOT NULL").withColumn("near", F.last(response, ignorenulls=True).over(back))
    of_part = (
        placed.where("full AND url_key IS NOT NULL")
        .groupBy("url_key", "part")
        .agg(F.max(F.struct("at", "id")).alias("m"))
        .select("url_key", "part", F.col("m.at").alias("m_at"), F.col("m.id").alias("m_id"))
    )
    latest = of_part.join(
        placed.where("full").select(
            F.col("url_key").alias("k"), F.col("part").alias("p"), "id", "at", "fields"
        ),
        (F.col("url_key") == F.col("k"))
        & (F.col("part") == F.col("p"))
        & F.col("at").eqNullSafe(F.col("m_at"))
        & F.col("id").eqNullSafe(F.col("m_id")),
    ).select("url_key", "part", F.struct("id", "at", "fields").alias("own"))
    latest = latest.groupBy("url_key", "part").agg(F.first("own").alias("own"))
    # Addresses that go over a partition's end: each part learns the latest response before it.
    parts = placed.where("url_key IS NOT NULL").select("url_key", "part").distinct()
    earlier = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        parts.join(latest, ["url_key", "part"], "left")
        .withColumn("before", F.last("own", ignorenulls=True).over(earlier))
        .where("before IS NOT NULL")
        .select("url_key", "part", "before")
    )
    found = (
        seen.where("NOT full")
        .join(carried, ["url_key", "part"], "left")
        .withColumn("from", F.coalesce("near", "before"))
        .select("id", "url_key", "fields", "from")
    )
    lost = placed.where("url_key IS NULL AND NOT full").select(
        "id", "url_key", "fields", F.lit(None).cast(found.schema["from"].dataType).alias("from")
    )
    found = found.unionByName(lost)
    own, stored = F.coalesce("fields", F.create_map().cast("map<string,string>")), F.coalesce(
        "from.fields", F.create_map().cast("map<string,string>")
    )
    same = None
    for name in ("etag", "last-modified"):
        a, b = _validator(own, name), _validator(stored, name)
        rule = F.when(a.isNotNull() & b.isNotNull(), a == b)
        same = rule if same is None else F.coalesce(same, rule)
    found = found.withColumn("same", same)
    outcome = (
        F.when(F.col("from").isNull(), "missing")
        .when(F.col("same").isNull(), "unverified")
        .when(F.col("same"), "resolved")
        .otherwise("changed")
    )
    brought = F.map_filter(own, lambda k, v: k.isin(PERMITTED) & v.isNotNull())
    kept = F.map_filter(stored, lambda k, v: ~F.map_contains_key(brought, k))
    return found.select(
        F.col("id").alias(capture),
        "url_key",
        F.col("from.id").alias("response_id"),
        F.col("from.at").alias("response_at"),
        outcome.alias("outcome"),
        F.when(outcome == "resolved", F.map_concat(kept, brought)).alias("merged_headers"),
    )
