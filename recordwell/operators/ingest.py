"""Mail and calendar intake: participants, proposals, delivery results, versions, occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.recurrence import row_rule_days, rule_until
from ..functions.text import company_from_domain, email_host, is_free_mail, is_group_address, normalize_email, registrable_domain
from . import own_zones

#: Delivery states that suppress an address for good, and the rest that suppress it.
HARD = ("BOUNCE", "COMPLAINT")


def addresses(people: DataFrame) -> DataFrame:
    """(address, person_id): of several people the one who has it as primary address, then the least id."""
    each = people.select("person_id", F.posexplode(F.concat(F.array("primary"), F.coalesce("additional", F.array().cast("array<string>")))).alias("k", "a"))
    rows = each.where("a is not null and trim(a) <> ''").select(normalize_email(F.col("a")).alias("address"), F.struct((F.col("k") > 0).alias("extra"), "person_id").alias("rank"))
    return rows.groupBy("address").agg(F.min("rank").alias("rank")).select("address", F.col("rank.person_id").alias("person_id"))


def participants(messages: DataFrame, people: DataFrame) -> DataFrame:
    """(message_id, address, person_id) of every handle; person_id null for strangers."""
    each = messages.select("message_id", F.explode("handles").alias("h")).select("message_id", normalize_email(F.col("h")).alias("address")).distinct()
    return each.join(addresses(people), "address", "left").select("message_id", "address", "person_id")


def proposals(unmatched: DataFrame, own: list[str], internal_hosts: list[str], blocked: Column) -> DataFrame:
    """(address, n_messages, company, reason): contacts that could be made; reason says why not, or is empty."""
    a = F.col("address")
    counted = unmatched.where("person_id is null").groupBy("address").agg(F.countDistinct("message_id").alias("n_messages"))
    reason = F.when(a.isin(own), "own_address").when(is_free_mail(a), "free_email").when(blocked, "blocklist").when(is_group_address(a), "group_address").when(email_host(a).isin(internal_hosts), "internal").otherwise("")
    company = F.when(~is_free_mail(a), company_from_domain(email_host(a)))
    return counted.select("address", "n_messages", company.alias("company"), registrable_domain(email_host(a)).alias("domain"), reason.alias("reason"))


def delivery_actions(results: DataFrame, stored: DataFrame) -> DataFrame:
    """(address, reason, action): results (email, status) against stored (address, reason, deleted). A hard reason upgrades, nothing downgrades."""
    status = F.upper("status")
    reason = F.when(status.isin("BOUNCED", "BOUNCE", "HARD_BOUNCE"), "BOUNCE").when(status.isin("COMPLAINT", "SPAM"), "COMPLAINT").when(status.isin("UNSUBSCRIBED", "UNSUBSCRIBE"), "UNSUBSCRIBE")
    weight = lambda c: F.when(c.isin(list(HARD)), 2).when(c.isNotNull(), 1).otherwise(0)
    new = results.select(normalize_email(F.col("email")).alias("address"), reason.alias("new")).where("new is not null").groupBy("address").agg(F.max_by("new", F.struct(weight(F.col("new")), "new")).alias("new"))
    old = stored.select("address", F.col("reason").alias("old"), "deleted")
    joined = new.join(old, "address", "left")
    action = F.when(F.col("old").isNull(), "create").when(F.col("deleted"), "restored").when(weight(F.col("new")) > weight(F.col("old")), "upgraded").otherwise("unchanged")
    kept = F.when(action.isin("create", "upgraded", "restored"), F.col("new")).otherwise(F.col("old"))
    return joined.select("address", kept.alias("reason"), action.alias("action"))


def version_actions(newest: DataFrame, stored: DataFrame) -> DataFrame:
    """(uid, action): in_trash, cancellation_unknown_event, create, update, fill or older_version, the first that holds."""
    both = newest.alias("n").join(stored.alias("s"), F.col("n.uid") == F.col("s.uid"), "left")
    rank = lambda t: F.struct(F.col(f"{t}.sequence"), F.coalesce(F.col(f"{t}.modified"), F.lit("1970-01-01").cast("timestamp")))
    action = (
        F.when(F.col("s.deleted"), "in_trash").when(F.col("s.uid").isNull() & F.col("n.cancelled"), "cancellation_unknown_event").when(F.col("s.uid").isNull(), "create")
        .when(F.col("s.sequence").isNull() | (rank("n") > rank("s")), "update").when(rank("n") == rank("s"), "fill").otherwise("older_version")
    )
    return both.select(F.col("n.uid").alias("uid"), action.alias("action"))


def occurrences_between(events: DataFrame, overrides: DataFrame, begin: Column, end: Column, transitions: DataFrame | None = None, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """(uid, starts, ends) of all events that touch a window, recurring ones expanded within the row.

    events: uid, starts and ends (wall clock), zone, rule (may be null), excluded and perhaps added and excluded_utc (arrays); overrides: uid, replaces (wall clock), starts, ends, zone.
    transitions: those of zones that calendars define themselves (own_zones.transitions), by keys, for events with an own_zone; they are met
    before the events are expanded, as a row an event is all that is joined.
    """
    utc = lambda t, z: F.to_utc_timestamp(t.cast("timestamp"), z)
    last = F.to_date(F.date_add(F.to_date(end), 1))
    own = transitions is not None and "own_zone" in events.columns
    if own:
        events = own_zones.met(events, list(keys), "own_zone", transitions, "o_stretches")
    days = F.when(F.col("rule").isNull(), F.array(F.to_date("starts"))).otherwise(row_rule_days(F.col("rule"), F.to_date("starts"), last, 1))
    until, in_utc = rule_until(F.coalesce("rule", F.lit("")))
    day = F.try_to_date(F.nullif(F.regexp_extract(F.upper("rule"), r"UNTIL=(\d{8})", 1), F.lit("")), "yyyyMMdd")
    zone = F.coalesce("zone", F.lit("UTC"))
    # Columns of their own: within a lambda, they would be made anew for every day.
    bound = {"o_days": days, "o_clock": F.date_format("starts", "HH:mm:ss"), "o_until": until, "o_in_utc": in_utc, "o_day": day, "o_zone": zone}
    events = events.withColumns(bound)
    local = F.transform("o_days", lambda d: F.concat(d.cast("string"), F.lit(" "), F.col("o_clock")).cast("timestamp_ntz"))
    end_at, last_day = F.col("o_until"), F.col("o_day")
    in_time = lambda t: F.when(end_at.isNull(), last_day.isNull() | (F.to_date(t) <= last_day)).when(F.col("o_in_utc"), utc(t, F.col("o_zone")) <= end_at.cast("timestamp")).otherwise(t <= end_at)
    local = F.when(F.upper("rule").contains("UNTIL="), F.filter(local, lambda t: (t == F.col("starts")) | in_time(t))).otherwise(local)
    none = F.array().cast("array<timestamp_ntz>")
    more = F.coalesce("added", none) if "added" in events.columns else none
    kept = F.array_except(F.array_union(local, more), F.coalesce("excluded", none))
    length = F.unix_seconds(F.col("ends").cast("timestamp")) - F.unix_seconds(F.col("starts").cast("timestamp"))
    without = F.coalesce("excluded_utc", none) if "excluded_utc" in events.columns else none
    events = events.select("*", kept.alias("o_kept"), without.alias("o_without"), length.alias("o_length"))
    start = lambda t: utc(t, F.col("zone"))
    if own:
        events = events.withColumn("o_near", own_zones.near(F.col("o_stretches"), F.array_min("o_kept"), F.array_max("o_kept")))
        start = lambda t: F.coalesce(own_zones.instant(t, F.col("o_near")).cast("timestamp"), utc(t, F.col("zone")))
    placed = F.transform("o_kept", lambda t: F.struct(t.alias("at"), start(t).alias("starts")))
    each = events.select("uid", "o_length", F.inline(F.filter(placed, lambda x: ~F.array_contains("o_without", x.starts.cast("timestamp_ntz")))))
    each = each.join(overrides.select("uid", F.col("replaces").alias("at")), ["uid", "at"], "left_anti")
    plain = each.select("uid", "starts", F.timestamp_seconds(F.unix_seconds("starts") + F.col("o_length")).alias("ends"))
    moved = overrides.select("uid", utc(F.col("starts"), F.col("zone")).alias("starts"), utc(F.col("ends"), F.col("zone")).alias("ends"))
    return plain.unionByName(moved).where((F.col("starts") < end) & ((F.col("ends") > begin) | ((F.col("ends") == F.col("starts")) & (F.col("starts") >= begin))))


def event_reason(addresses: Column, blocked: Column, internal_hosts: list[str], follow_up: Column, known: Column, confidential: Column, keep_internal: bool = False, keep_private: bool = False) -> Column:
    """Why a calendar event is skipped, the first that holds, or keep: blocklist, internal, private_event.

    addresses: array; blocked: whether one of them is on the blocklist. An exception or cancellation (follow_up) of a known series
    is never internal, as it often lists the organiser only.
    """
    own = F.array(*map(F.lit, internal_hosts)).cast("array<string>")
    inside = (F.size(addresses) > 0) & F.forall(addresses, lambda a: F.array_contains(own, email_host(a)))
    internal = F.lit(bool(internal_hosts) and not keep_internal) & inside & ~(follow_up & known)
    return F.when(blocked, "blocklist").when(internal, "internal").when(F.lit(not keep_private) & confidential, "private_event").otherwise("keep")


def first_messages(messages: DataFrame) -> DataFrame:
    """A row a Message-ID of messages (key, position, handles, ...): the first by position, with the handles of all its copies in order.

    An aggregate, combined before the shuffle; the handles of a message that many boxes hold are distinct before they meet.
    """
    rest = [c for c in messages.columns if c not in ("key", "handles")]
    row = messages.groupBy("key").agg(F.min_by(F.struct(*rest), "position").alias("r"), F.count(F.lit(1)).alias("n_copies"))
    each = messages.select("key", "position", F.posexplode("handles").alias("k", "h")).groupBy("key", F.lower("h").alias("h")).agg(F.min(F.struct("position", "k")).alias("at"))
    handles = each.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x.h).alias("handles"))
    return row.join(handles, "key", "left").select("key", "r.*", F.coalesce("handles", F.array().cast("array<string>")).alias("handles"), "n_copies")
