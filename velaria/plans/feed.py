"""The live feed over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from velaria.operators import feed
from velaria.plans.registry import query, table

# Every event is read as one gateway request.
_AGENTS = ("claude-cli/1.0", "codex_cli_rs/2", "open-webui/0.3", "OpenAI/Python 1.2", "Anthropic/Python 3", "curl/8.1", "Mozilla curl/8")
_PATHS = ("/v1/chat/completions", "/v1/messages", "/v1/messages/count_tokens", "/scan", "/panel/api/try", "/v1/models")
_REASON5 = feed.REASONS[:5]


def clocked(spark, sf):
    """The events with `ts` as an instant (the file has it without a zone: UTC)."""
    events = table(spark, sf, "events")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def requests(spark, sf):
    events = clocked(spark, sf)
    whole = F.floor("value").cast("bigint")

    def pick(options, index):
        return F.element_at(F.array(*map(F.lit, options)), (index + 1).cast("int"))

    hidden = F.create_map(
        F.lit("EMAIL"), (whole % 4).cast("int"), F.lit("PHONE"), (F.floor(whole / 4) % 3).cast("int")
    )
    return events.select(
        "event_id",
        F.col("ts").alias("at"),
        pick(_PATHS, F.col("user_id") % 6).alias("path"),
        F.lit("POST").alias("method"),
        pick(_AGENTS, F.col("event_id") % 7).alias("user_agent"),
        F.when(F.col("event_type") == "error", pick(_REASON5, F.col("event_id") % 5)).alias("blocked_reason"),
        (F.col("event_type") == "purchase").alias("upstream_failed"),
        F.when(F.col("event_type") != "signup", hidden).alias("types"),
    )


def live(spark, sf):
    return feed.live_events(requests(spark, sf))


def _case(options, index):
    return f"([{', '.join(repr(o) for o in options)}])[cast({index} as int) + 1]"


LIVE = f"""
req as (select event_id, ts, user_id % 6 as p, event_type, cast(floor(value) as bigint) % 4 as mails, cast(floor(value) as bigint) // 4 % 3 as phones from events),
live as (
  select event_id, date_trunc('minute', ts) as at, {_case(feed.ORIGINS, 'p')} as origin,
    ['claude_code','codex','open_webui','openai_python','anthropic_python','curl','other'][cast(event_id % 7 as int) + 1] as client,
    case when event_type = 'error' then 'blocked' when event_type = 'purchase' then 'upstream_error' when mails + phones > 0 then 'masked' else 'no_data' end as outcome,
    case when event_type = 'error' then {_case(_REASON5, 'event_id % 5')} else 'none' end as reason,
    case p when 0 then 'openai' when 1 then 'anthropic' when 2 then 'anthropic' else 'none' end as provider,
    case when event_type = 'error' then 0 else mails end as mails, case when event_type = 'error' then 0 else phones end as phones
  from req where p < 5 and event_type <> 'signup')
"""


@query("l01_minute_floor", "select event_id, date_trunc('minute', ts) as minute from events")
def l01_minute_floor(spark, sf):
    return table(spark, sf, "events").select("event_id", feed.minute(F.col("ts")).alias("minute"))


@query("l02_client", f"with {LIVE} select client, count(*) as n from live group by client")
def l02_client(spark, sf):
    return live(spark, sf).groupBy("client").agg(F.count("*").alias("n"))


@query("l03_origin_provider", f"with {LIVE} select origin, provider, count(*) as n from live group by all")
def l03_origin_provider(spark, sf):
    return live(spark, sf).groupBy("origin", "provider").agg(F.count("*").alias("n"))


@query(
    "l04_events",
    f"with {LIVE} select event_id, \"at\", origin, client, outcome, reason, provider, mails::int as mails, phones::int as phones from live",
)
def l04_events(spark, sf):
    def n(name):
        return F.coalesce(F.try_element_at("types", F.lit(name)), F.lit(0)).alias

    return live(spark, sf).select(
        "event_id", "at", "origin", "client", "outcome", "reason", "provider", n("EMAIL")("mails"), n("PHONE")("phones")
    )


@query(
    "l05_invalid_events",
    f"with {LIVE} select event_id, case event_id % 4 when 1 then 'client' when 2 then 'at' else 'types' end as broken from live where event_id % 4 <> 0",
)
def l05_invalid_events(spark, sf):
    # Three events in four are spoilt, each in one way.
    which = F.col("event_id") % 4
    spoilt = live(spark, sf).withColumns(
        {
            "client": F.when(which == 1, "netscape").otherwise(F.col("client")),
            "at": F.when(which == 2, F.col("at") + F.expr("interval 1 second")).otherwise(F.col("at")),
            "types": F.when(which == 3, F.create_map(F.lit("EMAIL"), F.lit(0))).otherwise(F.col("types")),
        }
    )
    return feed.invalid_events(spoilt).select("event_id", "broken")


@query(
    "l06_hidden_totals",
    f"with {LIVE} select 'EMAIL' as type, sum(mails)::bigint as hidden, 11 as ord from live where provider <> 'none' union all "
    "select 'PHONE', sum(phones)::bigint, 13 from live where provider <> 'none'",
)
def l06_hidden_totals(spark, sf):
    return feed.hidden_totals(live(spark, sf))


@query("l07_outcome_totals", f"with {LIVE} select outcome, count(*) as requests from live where provider <> 'none' group by outcome")
def l07_outcome_totals(spark, sf):
    return feed.outcome_totals(live(spark, sf))


@query("l08_block_totals", f"with {LIVE} select reason, count(*) as blocks from live where provider <> 'none' and outcome = 'blocked' group by reason")
def l08_block_totals(spark, sf):
    return feed.block_totals(live(spark, sf))


@query("l09_side_totals", f"with {LIVE} select count(*) filter (origin = 'try') as tries, count(*) filter (origin = 'scan') as scans from live")
def l09_side_totals(spark, sf):
    return feed.side_totals(live(spark, sf))


@query("l10_recent", f"with {LIVE} select event_id, \"at\", origin, outcome from live order by event_id desc limit 20")
def l10_recent(spark, sf):
    return feed.recent(live(spark, sf).select("event_id", "at", "origin", "outcome"))


@query("l11_conservation", "select true as all_counted, true as outcomes_add_up, true as blocks_add_up, true as blocked_hide_nothing")
def l11_conservation(spark, sf):
    return feed.conservation(live(spark, sf))


@query("l06_minute_totals", f"with {LIVE} select \"at\" as minute, origin, outcome, count(*) as requests from live group by all")
def l06_minute_totals(spark, sf):
    return feed.minute_totals(live(spark, sf))


_BURSTS = """
with a as (select event_id, '10.0.0.' || cast(user_id % 20 as varchar) as bucket, epoch_us(ts) // 60 as t from events),
w as (select event_id, bucket, t, count(*) over (partition by bucket order by t range between 59999999 preceding and current row) as failures,
  lag(t, 4) over (partition by bucket order by t, event_id) as fifth from a)
select event_id, bucket, failures, case when fifth > t - 60000000 then greatest(1, ceil((fifth + 60000000 - t) / 1000000.0))::bigint else 0 end as wait_seconds from w
"""


@query("l12_failure_bursts", _BURSTS)
def l12_failure_bursts(spark, sf):
    # The events are sparse: their clock runs sixty times faster here, so that bursts happen.
    address = F.concat(F.lit("::ffff:10.0.0."), (F.col("user_id") % 20).cast("string"))
    attempts = clocked(spark, sf).select(
        "event_id",
        feed.address_bucket(address).alias("bucket"),
        F.timestamp_micros(F.floor(F.unix_micros("ts") / 60).cast("bigint")).alias("at"),
    )
    return feed.failure_bursts(attempts).select("event_id", "bucket", "failures", "wait_seconds")


@query("l13_greedy_limit", None)
def l13_greedy_limit(spark, sf):
    # Greedy acceptance depends on what was accepted before: no plain SQL says it.
    tries = clocked(spark, sf).select(
        "event_id",
        (F.col("user_id") % 3).alias("key"),
        F.timestamp_micros(F.floor(F.unix_micros("ts") / 600).cast("bigint")).alias("at"),
    )
    return feed.greedy_limit(tries, "key").groupBy("key").agg(
        F.count_if("accepted").alias("accepted"),
        F.count_if(~F.col("accepted")).alias("refused"),
        F.max("wait_seconds").alias("longest_wait"),
    )
