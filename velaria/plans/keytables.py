"""Key tables made from customers: one virtual key each, calls from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from velaria.functions import builders, keyfmt
from velaria.operators import keytable
from velaria.plans import planted_sql as sql
from velaria.plans.registry import query, spread, table

# Peppers of the test ring: fixed bytes, no secret.
PEPPERS = {1: b"first test pepper of thirty-two b", 2: b"second test pepper with 32 bytes!"}


def bodies(key):
    # Three draws and a filler: 43 characters of the key alphabet.
    return F.concat(
        builders.digits(key, 90, 12), F.lit("AbCdEfGhIj"), builders.digits(key, 91, 12), F.lit("zYxWvUtSr")
    )


def _body_sql(key):
    return f"({sql.digits(key, 90, 12)} || 'AbCdEfGhIj' || {sql.digits(key, 91, 12)} || 'zYxWvUtSr')"


def virtual_keys(spark, sf):
    key = F.col("c_custkey")
    made = keyfmt.key_from_body(bodies(key))
    version = (key % 2 + 1).cast("smallint")
    created = F.timestamp_seconds(F.lit(1704067200) + key * 60)
    scope = F.array(*map(F.lit, keytable.SCOPES))
    return table(spark, sf, "customer").select(
        (key + 1).alias("id"),
        F.col("c_name").alias("name"),
        F.slice(scope, F.lit(1), (key % 4 + 1).cast("int")).alias("scopes"),
        created.alias("created_at"),
        F.when(key % 3 == 0, created + F.expr("interval 30 days")).alias("expires_at"),
        F.when(key % 7 == 0, created + F.expr("interval 1 day")).alias("revoked_at"),
        F.when(version == 1, keyfmt.digest(made, PEPPERS[1])).otherwise(keyfmt.digest(made, PEPPERS[2])).alias("key_hash"),
        version.alias("pepper_version"),
        F.when(key % 5 == 0, F.lit(60)).alias("per_minute_limit"),
        F.lit(None).cast("int").alias("per_day_limit"),
    )


@query(
    "k01_key_shape",
    f"select c_custkey as key, '{keyfmt.PREFIX}' || {_body_sql('c_custkey')} as head, c_custkey % 3 <> 0 as well_formed from customer",
)
def k01_key_shape(spark, sf):
    key = F.col("c_custkey")
    made = keyfmt.key_from_body(bodies(key))
    # One in three has a wrong last character.
    turned = F.concat(
        F.substring(made, F.lit(1), F.length(made) - 1),
        F.when(made.endswith("A"), "B").otherwise("A"),
    )
    shown = F.when(key % 3 == 0, turned).otherwise(made)
    return table(spark, sf, "customer").select(
        key.alias("key"),
        F.substring(shown, 1, 47).alias("head"),
        keyfmt.is_well_formed(shown).alias("well_formed"),
    )


def _hmac_sql(version, text):
    inner, outer = keyfmt._pads(PEPPERS[version])
    return (
        f"sha256(unhex('{outer.hex()}') || unhex(sha256(unhex('{inner.hex()}') || encode({text}))))"
    )


@query(
    "k02_keyed_hash",
    f"select c_custkey as key, {_hmac_sql(1, _body_sql('c_custkey'))} as first, {_hmac_sql(2, _body_sql('c_custkey'))} as second from customer",
)
def k02_keyed_hash(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("key"),
        *[
            F.lower(F.hex(keyfmt.digest(bodies(key), PEPPERS[v]))).alias(name)
            for v, name in ((1, "first"), (2, "second"))
        ],
    )


@query(
    "k03_verdicts",
    "with c as (select o_orderkey, o_custkey as k, to_timestamp(1704067200 + o_custkey * 60) at time zone 'UTC' + interval 1 day * (o_orderkey % 60) as at from orders) "
    "select o_orderkey, case when o_orderkey % 10 = 0 then 'malformed' when o_orderkey % 10 = 1 then 'unknown' when k % 7 = 0 then 'revoked' "
    "when k % 3 = 0 and o_orderkey % 60 >= 30 then 'expired' else 'verified' end as verdict, "
    "case when not (o_orderkey % 10 < 2 or k % 7 = 0 or (k % 3 = 0 and o_orderkey % 60 >= 30)) then k + 1 end as key_id from c",
)
def k03_verdicts(spark, sf):
    return calls_checked(spark, sf).select("o_orderkey", "verdict", "key_id")


def calls_checked(spark, sf):
    key, order = F.col("o_custkey"), F.col("o_orderkey")
    made = keyfmt.key_from_body(bodies(key))
    unknown = keyfmt.key_from_body(F.concat(F.lit("x"), F.substring(bodies(key), 2, 42)))
    shown = F.when(order % 10 == 0, F.concat(made, F.lit("0"))).when(order % 10 == 1, unknown).otherwise(made)
    at = F.timestamp_seconds(F.lit(1704067200) + key * 60 + (order % 60) * 86400)
    paths = F.array(*map(F.lit, keytable.ROUTE_SCOPES))
    calls = spread(table(spark, sf, "orders")).select(
        "o_orderkey",
        shown.alias("presented"),
        at.alias("at"),
        F.element_at(paths, (order % 5 + 1).cast("int")).alias("path"),
    )
    return keytable.verdicts(calls, virtual_keys(spark, sf), PEPPERS)


@query(
    "k04_route_scopes",
    "with v as (select o_orderkey % 5 as route, o_custkey % 4 + 1 as n from orders where not (o_orderkey % 10 < 2 or o_custkey % 7 = 0 or (o_custkey % 3 = 0 and o_orderkey % 60 >= 30))) "
    "select ['/v1/chat/completions','/v1/messages','/v1/messages/count_tokens','/v1/models','/scan'][cast(route as int) + 1] as path, "
    "n >= [1,2,2,3,4][cast(route as int) + 1] as allowed, count(*) as calls from v group by all",
)
def k04_route_scopes(spark, sf):
    verified = calls_checked(spark, sf).filter("verdict = 'verified'")
    allowed = keytable.route_allowed(F.col("path"), F.col("scopes"))
    return verified.groupBy("path", allowed.alias("allowed")).agg(F.count("*").alias("calls"))


@query(
    "k05_record_rules",
    "select c_custkey + 1 as id, ['expires_at','name_invisible','name_blank','scopes','key_hash','per_day_limit'][cast(c_custkey % 11 as int) + 1] as rule from customer where c_custkey % 11 < 6",
)
def k05_record_rules(spark, sf):
    which = (F.col("id") - 1) % 11
    spoilt = virtual_keys(spark, sf).withColumns(
        {
            "expires_at": F.when(which == 0, F.col("created_at")).otherwise(F.col("expires_at")),
            "name": F.when(which == 1, F.concat("name", F.lit("​x")))
            .when(which == 2, F.concat("name", F.lit(" ")))
            .otherwise(F.col("name")),
            "scopes": F.when(which == 3, F.array(F.lit("scan"), F.lit("scan"))).otherwise(F.col("scopes")),
            "key_hash": F.when(which == 4, F.substring("key_hash", 1, 31)).otherwise(F.col("key_hash")),
            "per_day_limit": F.when(which == 5, 0).otherwise(F.col("per_day_limit")),
        }
    )
    return keytable.broken_rules(spoilt)


@query(
    "k06_change_audit",
    "select c_custkey + 1 as id, 'deleted' as change from customer where c_custkey % 13 = 0 union all "
    "select c_custkey + 1, 'frozen_column' from customer where c_custkey % 13 = 1 union all "
    "select c_custkey + 1, 'revocation' from customer where c_custkey % 13 = 2 and c_custkey % 7 = 0",
)
def k06_change_audit(spark, sf):
    before = virtual_keys(spark, sf)
    which = (F.col("id") - 1) % 13
    after = before.filter(which != 0).withColumns(
        {
            "created_at": F.when(which == 1, F.col("created_at") - F.expr("interval 1 hour")).otherwise(F.col("created_at")),
            "revoked_at": F.when(which == 2, F.lit(None).cast("timestamp")).otherwise(F.col("revoked_at")),
        }
    )
    return keytable.change_audit(before, after)


@query(
    "k07_revoke",
    "with k as (select c_custkey, to_timestamp(1704067200 + c_custkey * 60) at time zone 'UTC' as created from customer), "
    "r as (select o_custkey, min(o_orderdate) as at from orders group by all) "
    "select c_custkey + 1 as id, case when c_custkey % 7 = 0 then created + interval 1 day when r.at is not null then greatest(r.at, created) end as revoked_at from k left join r on o_custkey = c_custkey",
)
def k07_revoke(spark, sf):
    asked = table(spark, sf, "orders").select(
        (F.col("o_custkey") + 1).alias("id"), F.col("o_orderdate").cast("timestamp").alias("at")
    )
    return keytable.revoke(virtual_keys(spark, sf), asked).select("id", "revoked_at")


@query(
    "r12_secret_part",
    "select c_custkey as key, case c_custkey % 8 when 5 then 'Api03-' || x else case when c_custkey % 8 = 7 then c_name || x else x end end as secret from (select *, "
    + sql.digits("c_custkey", 92, 12)
    + " || 'QwErTy' as x from customer)",
)
def r12_secret_part(spark, sf):
    key = F.col("c_custkey")
    prefixes = ("sk-", "sk-proj-", "sk-svcacct-", "sk-ant-api03-", "sk-ant-", "sk-ant-x", "sk-admin-", "")
    x = F.concat(builders.digits(key, 92, 12), F.lit("QwErTy"))
    prefix = F.element_at(F.array(*map(F.lit, prefixes)), (key % 8 + 1).cast("int"))
    shown = F.when(key % 8 == 7, F.concat("c_name", x)).when(
        key % 8 == 5, F.concat(F.lit("sk-ant-ant-Api03-"), x)
    ).otherwise(F.concat(prefix, x))
    return table(spark, sf, "customer").select(key.alias("key"), keyfmt.secret_part(shown).alias("secret"))
