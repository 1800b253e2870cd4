"""Rules for polls, spend, pods and their endpoints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipway import constants as C
from slipway.functions.text import strip

# The order in which one poll is judged: a finished job is never lost or overspent.
DONE, LOST, MAX_SPEND = 0, 1, 2


def status_text(raw_status: Column) -> Column:
    return strip(F.coalesce(raw_status, F.lit("")))


def decode_status(text: Column) -> Column:
    """Struct (status, exit_code): ``done:<n>`` gives (done, n), an unreadable n gives 1."""
    done = F.startswith(text, F.lit("done:"))
    number = strip(F.substring(text, 6, 1 << 30))
    code = F.when(number.rlike(r"\A[+-]?[0-9]+(_[0-9]+)*\z"), F.replace(number, F.lit("_"), F.lit("")))
    return F.struct(
        F.when(done, F.lit("done")).otherwise(text).alias("status"),
        F.when(done, F.coalesce(code.try_cast("bigint"), F.lit(1).cast("bigint"))).alias("exit_code"),
    )


def elapsed_seconds(start: Column, now: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, now) / F.lit(1e6)


def accrued_spend(start: Column, now: Column, hourly: Column) -> Column:
    return elapsed_seconds(start, now) / F.lit(3600.0) * hourly


def spend_tripped(spent: Column, hourly: Column, max_spend: Column) -> Column:
    return F.coalesce((hourly > 0) & (max_spend > 0) & (spent >= max_spend), F.lit(False))


def poll_verdict(status: Column, overspent: Column) -> Column:
    """DONE, LOST or MAX_SPEND for a poll that ends its run, else null."""
    return (
        F.when(status == "done", F.lit(DONE))
        .when(status != "running", F.lit(LOST))
        .when(overspent, F.lit(MAX_SPEND))
    )


def outcome_name(verdict: Column, exit_code: Column) -> Column:
    return (
        F.when((verdict == DONE) & (exit_code == 0), F.lit("success"))
        .when(verdict == DONE, F.lit("failed"))
        .when(verdict == LOST, F.lit("lost"))
        .when(verdict == MAX_SPEND, F.lit("max_spend"))
        .otherwise(F.lit("running"))
    )


def pod_kept(outcome: Column, keep_on_success: Column, keep_on_failure: Column) -> Column:
    """Whether the pod outlives its run; null while the run goes on."""
    success = outcome == "success"
    return F.when(outcome == "running", F.lit(None).cast("boolean")).otherwise(
        F.when(success, F.coalesce(keep_on_success, F.lit(False))).otherwise(
            F.coalesce(keep_on_failure, F.lit(False))
        )
    )


def _text_at(document: Column, path: str) -> Column:
    return F.try_variant_get(document, path, "string")


def _strings_at(document: Column, path: str) -> Column:
    """The strings of a JSON array, or a lone string as an array of one."""
    many = F.try_variant_get(document, path, "array<string>")
    one = F.try_variant_get(document, path, "string")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)))


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _port(text: Column) -> Column:
    return strip(text).try_cast("int")


# Fixed value: the shape of a connection text, "[user@]host [-p port]".
CONNECTION = (
    rf"\A{C.BLANK}*(?:[\p{{L}}\p{{N}}_.\-]+@)?([\p{{L}}\p{{N}}_.\-]+)"
    rf"(?:{C.BLANK}+-p{C.BLANK}*([0-9]+))?{C.BLANK}*\z"
)


def _mapped_endpoint(document: Column) -> Column:
    host = strip(F.coalesce(_text_at(document, "$.publicIp"), F.lit("")))
    port = _port(_text_at(document, '$.portMappings["22"]'))
    return F.when(
        (host != "") & port.isNotNull() & (port != 0),
        F.struct(host.alias("host"), port.alias("port")),
    )


def _listed_endpoint(document: Column) -> Column:
    connection = _first(
        F.filter(_strings_at(document, "$.sshConnection"), lambda item: item.rlike(CONNECTION))
    )
    named_port = F.regexp_extract(connection, CONNECTION, 2)
    by_connection = F.when(
        connection.isNotNull(),
        F.struct(
            F.regexp_extract(connection, CONNECTION, 1).alias("host"),
            F.when(named_port == "", F.lit(22)).otherwise(named_port.try_cast("int")).alias("port"),
        ),
    )
    ip = _first(F.filter(_strings_at(document, "$.ip"), lambda item: strip(item) != ""))
    mapping = _first(
        F.filter(
            F.try_variant_get(
                document, "$.primePortMapping", "array<struct<usedBy:string,external:string>>"
            ),
            lambda item: item["usedBy"] == "SSH",
        )
    )
    external = _port(mapping["external"])
    by_ip = F.when(
        ip.isNotNull(),
        F.struct(
            strip(ip).alias("host"),
            F.when(external != 0, external).otherwise(F.lit(22)).alias("port"),
        ),
    )
    return F.coalesce(by_connection, by_ip)


def ssh_endpoint(provider: Column, document: Column) -> Column:
    """Struct (host, port) of the SSH endpoint in a pod's JSON (a VARIANT), null for none."""
    return F.when(provider == C.PROVIDERS[0], _mapped_endpoint(document)).otherwise(
        _listed_endpoint(document)
    )


def pod_state(provider: Column, document: Column, endpoint: Column) -> Column:
    """ready, failed or pending for one snapshot (a VARIANT) of a pod."""
    desired = F.upper(strip(_text_at(document, "$.desiredStatus")))
    status = _text_at(document, "$.status")
    first = (
        F.when((desired == "RUNNING") & endpoint.isNotNull(), F.lit("ready"))
        .when(desired.isin("EXITED", "TERMINATED"), F.lit("failed"))
        .otherwise(F.lit("pending"))
    )
    second = (
        F.when(status.isin("ERROR", "TERMINATED", "DELETING"), F.lit("failed"))
        .when((status == "ACTIVE") & endpoint.isNotNull(), F.lit("ready"))
        .otherwise(F.lit("pending"))
    )
    return F.when(provider == C.PROVIDERS[0], first).otherwise(second)
