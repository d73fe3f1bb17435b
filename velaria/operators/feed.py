"""The live feed as tables: events, running totals, failure bursts and the greedy limiter."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from velaria.functions import tables
from velaria.functions.spans import let
from velaria.operators.resolve import order_of, type_order

# --- Fixed values: the closed sets of the feed ------------------------------------------------
ORIGINS = ("openai_chat", "anthropic_messages", "count_tokens", "scan", "try")
PROXY_ORIGINS = ("openai_chat", "anthropic_messages", "count_tokens")
PROVIDERS = {"openai_chat": "openai", "anthropic_messages": "anthropic", "count_tokens": "anthropic"}
OUTCOMES = ("masked", "no_data", "blocked", "upstream_error")
REASONS = ("attachment", "detector_failed", "egress_guard", "unmaskable_field", "too_deep", "none")
CLIENTS = (
    ("claude-cli/", "claude_code"), ("codex_cli_rs/", "codex"), ("open-webui/", "open_webui"),
    ("OpenAI/Python", "openai_python"), ("Anthropic/Python", "anthropic_python"), ("curl/", "curl"),
)
AGENT_CHARS = 32
ROUTES = (
    ("/v1/chat/completions", "POST", "openai_chat"),
    ("/v1/messages", "POST", "anthropic_messages"),
    ("/v1/messages/count_tokens", "POST", "count_tokens"),
    ("/scan", "POST", "scan"),
    ("/panel/api/try", "POST", "try"),
)
RECENT = 20
WINDOW_MICROS = 60_000_000
MAX_FAILURES = 5
MAX_TRIES = 30


def minute(at: Column) -> Column:
    return F.date_trunc("minute", at)


def client_of(agent: Column) -> Column:
    """The known client a user agent names by its exact prefix; only its first characters are read."""
    head = F.substring(F.coalesce(agent, F.lit("")), 1, AGENT_CHARS)
    out = None
    for prefix, client in CLIENTS:
        test = head.startswith(prefix)
        out = F.when(test, client) if out is None else out.when(test, client)
    return out.otherwise("other")


def provider_of(origin: Column) -> Column:
    out = None
    for name, provider in PROVIDERS.items():
        out = F.when(origin == name, provider) if out is None else out.when(origin == name, provider)
    return out.otherwise("none")


def with_origin(requests: DataFrame) -> DataFrame:
    """Requests of a recorded route, with its origin; five routes, so the list is a map literal."""
    routes = F.create_map(
        *[F.lit(x) for path, method, origin in ROUTES for x in (f"{method} {path}", origin)]
    )
    origin = F.try_element_at(routes, F.concat_ws(" ", "method", "path"))
    return requests.withColumn("origin", origin).filter("origin is not null")


def outcome_of(blocked: Column, failed: Column, types: Column) -> Column:
    """blocked, then upstream_error, then masked or no_data; null types: nothing was decided."""
    return (
        F.when(blocked.isNotNull(), "blocked")
        .when(types.isNull(), F.lit(None).cast("string"))
        .when(failed, "upstream_error")
        .when(F.size(types) > 0, "masked")
        .otherwise("no_data")
    )


def live_events(requests: DataFrame) -> DataFrame:
    """at, origin, client, outcome, reason, provider, types from requests.

    `requests`: at, path, method, user_agent, blocked_reason (null: not blocked), upstream_failed,
    types (map type -> distinct hidden values; null: the request decided nothing, so it is not
    recorded).  A blocked request hides nothing; a failed one keeps what it hid.
    """
    positive = F.map_filter("types", lambda _, n: n > 0)
    routed = with_origin(requests).withColumn("_kept", positive)
    outcome = outcome_of(F.col("blocked_reason"), F.col("upstream_failed"), F.col("_kept"))
    nothing = F.create_map().cast("map<string,int>")
    return routed.withColumn("outcome", outcome).filter("outcome is not null").select(
        *[c for c in requests.columns if c in ("event_id",)],
        minute(F.col("at")).alias("at"),
        "origin",
        client_of(F.col("user_agent")).alias("client"),
        "outcome",
        F.when(F.col("outcome") == "blocked", F.col("blocked_reason")).otherwise("none").alias("reason"),
        provider_of(F.col("origin")).alias("provider"),
        F.when(F.col("outcome") == "blocked", nothing).otherwise(F.coalesce("_kept", nothing)).alias("types"),
    )


def invalid_events(events: DataFrame) -> DataFrame:
    """Events that break a rule, with the first broken one: they go to quarantine."""
    known = {
        "origin": ORIGINS,
        "client": tuple(c for _, c in CLIENTS) + ("other",),
        "outcome": OUTCOMES,
        "reason": REASONS,
        "provider": ("openai", "anthropic", "none"),
    }
    checks = [
        F.when(~F.coalesce(F.col(c).isin(list(v)), F.lit(False)), c) for c, v in known.items()
    ]
    checks.append(
        F.when(~F.coalesce((F.col("at") == minute(F.col("at"))) & (F.unix_micros("at") >= 0), F.lit(False)), "at")
    )
    strange = F.exists(F.map_keys("types"), lambda t: ~t.isin(list(tables.ENTITY_TYPES)))
    few = F.exists(F.map_values("types"), lambda n: n.isNull() | (n < 1))
    checks.append(F.when(F.coalesce(strange | few, F.lit(True)), "types"))
    return events.withColumn("broken", F.coalesce(*checks)).filter("broken is not null")


def _proxied(events: DataFrame) -> DataFrame:
    return events.filter(F.col("origin").isin(list(PROXY_ORIGINS)))


def hidden_totals(events: DataFrame) -> DataFrame:
    """Hidden values per type over the proxied requests, in type order (`ord`)."""
    counted = _proxied(events).select(F.explode_outer("types").alias("type", "n")).filter("type is not null")
    return counted.groupBy("type").agg(F.sum("n").alias("hidden")).withColumn("ord", type_order(F.col("type")))


def outcome_totals(events: DataFrame) -> DataFrame:
    """Requests per outcome; every outcome is listed, at zero too."""
    spark: SparkSession = events.sparkSession
    names = spark.createDataFrame([(o,) for o in OUTCOMES], "outcome string")
    counted = _proxied(events).groupBy("outcome").agg(F.count("*").alias("requests"))
    return names.join(counted, "outcome", "left").na.fill(0, ["requests"])


def block_totals(events: DataFrame) -> DataFrame:
    return _proxied(events).filter("outcome = 'blocked'").groupBy("reason").agg(
        F.count("*").alias("blocks")
    )


def side_totals(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count_if(F.col("origin") == "try").alias("tries"),
        F.count_if(F.col("origin") == "scan").alias("scans"),
    )


def recent(events: DataFrame, arrival: str = "event_id", count: int = RECENT) -> DataFrame:
    """The latest events, newest first: a top-k, each task keeps its own k."""
    return events.orderBy(F.desc(arrival)).limit(count)


def conservation(events: DataFrame) -> DataFrame:
    """One row of booleans: every event is counted once, every block has a reason."""
    proxied = F.col("origin").isin(list(PROXY_ORIGINS))
    blocked = proxied & (F.col("outcome") == "blocked")
    return events.agg(
        F.count("*").alias("_all"),
        F.count_if(proxied).alias("_proxied"),
        F.count_if(F.col("origin") == "try").alias("_tries"),
        F.count_if(F.col("origin") == "scan").alias("_scans"),
        F.count_if(blocked).alias("_blocked"),
        F.count_if(blocked & F.col("reason").isin(list(REASONS))).alias("_reasons"),
        F.count_if(proxied & F.col("outcome").isin(list(OUTCOMES))).alias("_outcomes"),
        F.count_if((F.col("outcome") == "blocked") & (F.size("types") > 0)).alias("_hiding"),
    ).select(
        (F.col("_tries") + F.col("_scans") + F.col("_proxied") == F.col("_all")).alias("all_counted"),
        (F.col("_outcomes") == F.col("_proxied")).alias("outcomes_add_up"),
        (F.col("_reasons") == F.col("_blocked")).alias("blocks_add_up"),
        (F.col("_hiding") == 0).alias("blocked_hide_nothing"),
    )


def minute_totals(events: DataFrame) -> DataFrame:
    """Totals in one-minute windows; works the same on a stream with a watermark on `at`."""
    return events.groupBy(F.window("at", "1 minute").alias("w"), "origin", "outcome").agg(
        F.count("*").alias("requests")
    ).select(F.col("w.start").alias("minute"), "origin", "outcome", "requests")


def address_bucket(address: Column) -> Column:
    """An IPv4 address (mapped ones too), the /64 of an IPv6 one, or the text itself."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    dotted_end = rf"(?<=:){octet}(?:\.{octet}){{3}}$"

    def hexed(text):
        """A dotted end as two groups."""

        def group(numbers, at):
            high, low = (F.get(numbers, F.lit(i)).try_cast("int") for i in (at, at + 1))
            return F.lower(F.hex(high * 256 + low))

        numbers = F.split(F.regexp_extract(text, dotted_end, 0), r"\.")
        end = let(numbers, lambda n: F.concat_ws(":", group(n, 0), group(n, 2)))
        return F.when(F.rlike(text, F.lit(dotted_end)), F.concat(F.regexp_replace(text, dotted_end, ""), end)).otherwise(text)

    def groups(text):
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))

    def filled(halves):
        """Eight groups: "::" stands for as many zeros as are missing."""
        if_two = let(
            F.struct(groups(halves[0]).alias("left"), groups(F.get(halves, F.lit(1))).alias("right")),
            lambda h: let(
                8 - F.size(h["left"]) - F.size(h["right"]),
                lambda n: F.when(n > 0, F.concat(h["left"], F.array_repeat(F.lit("0"), n), h["right"])),
            ),
        )
        return F.when(F.size(halves) == 1, groups(halves[0])).when(F.size(halves) == 2, if_two)

    def written(all_groups):
        valid = (F.size(all_groups) == 8) & F.forall(all_groups, lambda g: F.rlike(g, F.lit("^[0-9a-f]{1,4}$")))
        short = F.transform(all_groups, lambda g: F.regexp_replace(g, "^0+(?=.)", ""))
        return F.when(F.coalesce(valid, F.lit(False)), let(short, named)).otherwise(address)

    def named(short):
        def two(at):
            number = F.conv(F.get(short, F.lit(at)), 16, 10).try_cast("int")
            return let(number, lambda n: F.concat_ws(".", F.floor(n / 256).cast("string"), (n % 256).cast("string")))

        mapped = F.array_join(F.slice(short, 1, 6), ":") == "0:0:0:0:0:ffff"
        head = F.regexp_replace(F.array_join(F.slice(short, 1, 4), ":"), "(?:^|:)0(?::0)*$", "")
        return F.when(mapped, F.concat_ws(".", two(6), two(7))).otherwise(F.concat(head, F.lit("::/64")))

    without_zone = F.regexp_replace(address, r"(?<=:.{0,60})%[^%]+$", "")
    halves = let(without_zone, lambda t: F.split(F.lower(hexed(t)), "::"))
    six = let(let(halves, filled), written)
    # Mapped IPv4 in its usual writing, without the general case's folds.
    usual = rf"^::ffff:({octet}(?:\.{octet}){{3}})$"
    mapped = F.regexp_extract(address, usual, 1)
    return F.when(~F.contains(address, F.lit(":")), address).when(mapped != "", mapped).otherwise(six)


def failure_bursts(attempts: DataFrame, bucket: str = "bucket", at: str = "at") -> DataFrame:
    """Failures with how many came in the 60 seconds up to each one, and the wait from then on.

    With five or more, the next attempt waits until the fifth latest is 60 seconds old: the wait
    is whole seconds, rounded up, at least one.

    Time is cut in bins as long as the window.  A row goes to its own bin and, as one that only counts, to the next: all
    that a row looks back on is in its bin, so an address with most of the rows is spread over as many tasks as
    it has minutes.  Rows without a time count for nothing and keep nulls.
    """
    rows = attempts.withColumn("_t", F.unix_micros(F.col(at)))
    own = F.floor(F.col("_t") / WINDOW_MICROS)
    bins = F.explode(F.array(F.struct(own.alias("bin"), F.lit(True).alias("own")), F.struct((own + 1).alias("bin"), F.lit(False).alias("own"))))
    binned = rows.filter("_t is not null").withColumn("_b", bins)
    order = ["_t", *[c for c in ("event_id",) if c in attempts.columns]]
    by_bin = Window.partitionBy(bucket, "_b.bin")
    trailing = by_bin.orderBy("_t").rangeBetween(-(WINDOW_MICROS - 1), Window.currentRow)
    fifth = F.lag("_t", MAX_FAILURES - 1).over(by_bin.orderBy(*order))
    wait = F.ceil((fifth + WINDOW_MICROS - F.col("_t")) / 1_000_000)
    counted = (
        binned.withColumn("failures", F.count("*").over(trailing))
        .withColumn("wait_seconds", F.when(fifth > F.col("_t") - WINDOW_MICROS, F.greatest(F.lit(1), wait)).otherwise(0).cast("bigint"))
        .filter("_b.own")
        .drop("_t", "_b")
    )
    timeless = rows.filter("_t is null").drop("_t")
    return counted.unionByName(timeless, allowMissingColumns=True)


def greedy_limit(tries: DataFrame, key: str, at: str = "at", limit: int = MAX_TRIES) -> DataFrame:
    """`tries` plus `accepted` and `wait_seconds`: at most `limit` accepted in any 60 seconds per
    key; refused ones do not count.

    A pause of 60 seconds clears the limiter, so each key is cut at its pauses and every run of
    tries is placed on its own: a busy key is many runs.  A run is read in order, batch by batch;
    only its last accepted times are held.
    """
    in_order = Window.partitionBy(key).orderBy("_t")
    pause = F.coalesce(F.col("_t") - F.lag("_t").over(in_order) >= WINDOW_MICROS, F.lit(True))
    runs = (
        tries.withColumn("_t", F.unix_micros(F.col(at)))
        .withColumn("_run", F.sum(pause.cast("int")).over(in_order.rangeBetween(Window.unboundedPreceding, 0)))
    )
    # Tries of the same instant are one run whatever their order.
    tie = [c for c in ("event_id",) if c in tries.columns]
    sorted_runs = runs.repartition(key, "_run").sortWithinPartitions(key, "_run", "_t", *tie)
    names = [f.name for f in sorted_runs.schema.fields]

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, times = None, deque(maxlen=limit)
        for batch in batches:
            accepted, waits = [], []
            for run_key, run, now in zip(batch[key], batch["_run"], batch["_t"]):
                if (run_key, run) != current:
                    current = (run_key, run)
                    times.clear()
                while times and now - times[0] >= WINDOW_MICROS:
                    times.popleft()
                free = len(times) < limit
                accepted.append(free)
                waits.append(
                    0 if free else max(1, math.ceil((times[0] + WINDOW_MICROS - now) / 1_000_000))
                )
                if free:
                    times.append(now)
            yield batch.assign(accepted=accepted, wait_seconds=waits)

    fields = ", ".join(f"`{n}` {sorted_runs.schema[n].dataType.simpleString()}" for n in names)
    return sorted_runs.mapInPandas(take, f"{fields}, accepted boolean, wait_seconds bigint").drop("_t", "_run")


def outcome_order(outcome: Column) -> Column:
    return order_of(outcome, OUTCOMES)
