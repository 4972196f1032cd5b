"""Audit events derived from the `events` table of the test data.

Each view exists twice: here as DataFrames, and in `oracle.py` as SQL for another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trailspark.functions.once import compute_once
from trailspark.operators.render import message_json
from trailspark.schema import STORED_COLUMNS

#: A payload whose numbers no number type of the engine holds as they are written.
EXACT_NUMBERS = (
    '{"big":12345678901234567890123456789012345678901234567890,"far":1e400,'
    '"fine":0.1234567890123456789012345678901234567890123,"list":[-0,1.50,7],"text":"1.10"}'
)


def _matched(column: Column, cases: dict[str, Column | str], otherwise: Column | str) -> Column:
    chain = F
    for value, result in cases.items():
        chain = chain.when(column == value, result)
    return chain.otherwise(otherwise)


def audit_events(spark: SparkSession, sf_dir: str, minutes: bool = False) -> DataFrame:
    """The stored columns; with `minutes` the time is cut so that many events tie."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    number, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    k = F.col("k")
    status = (F.lit(100) + (k * 7) % 500).cast("string")
    lit, text = F.lit, lambda c: c.cast("string")
    gateway_action = F.when(number % 2 == 0, "GET /admin/audit?limit=50").otherwise("POST /checkout")
    columns = {
        "id": F.concat(lit("00000000-0000-0000-0000-"), F.lpad(text(number), 12, "0")),
        "service": _matched(
            kind, {"error": lit("gateway"), "signup": lit("authn-svc"), "purchase": lit("orders-svc")},
            lit("web-svc"),
        ),
        "actor": F.concat(lit("user-"), text(user % 2)),
        "action": _matched(
            kind,
            {
                "signup": lit("user.create"), "purchase": lit("order.confirm"),
                "view": lit("report.view"), "click": lit("ui.click"),
            },
            gateway_action,
        ),
        "target_type": F.when(kind == "purchase", "order").otherwise("user"),
        "target_id": F.concat(lit("t-"), text(user % 3)),
        "scope_type": F.when(user % 5 == 0, "platform").otherwise("tenant"),
        "scope_id": F.when(user % 5 == 0, "").otherwise(F.concat(lit("tenant-"), text(user % 2))),
        "before_state": F.when(number % 8 == 1, EXACT_NUMBERS),
        "after_state": F.when(
            kind == "purchase",
            F.concat(lit('{"cents":'), text(F.round(F.col("value") * 100).cast("bigint")), lit("}")),
        ),
        "metadata": F.when(k >= 98, None)
        .when(k >= 95, "{}")
        .when(k >= 90, '{"http_status":"n/a"}')
        .when(k >= 80, F.concat(lit('{"http_status":"'), status, lit('"}')))
        .otherwise(F.concat(lit('{"http_status":'), status, lit("}"))),
        "request_id": F.when(number % 4 == 0, "").otherwise(F.concat(lit("req-"), text(number % 1000))),
        "client_ip": F.concat(lit("10.0.0."), text(user % 256)),
        "created_at": F.date_trunc("minute", "ts").cast("timestamp_ntz") if minutes else F.col("ts"),
    }
    return compute_once(raw, k=F.get_json_object("props", "$.k").cast("int")).select(
        *(columns[c].alias(c) for c in STORED_COLUMNS), number
    )


def table_events(spark: SparkSession, sf_dir: str, minutes: bool = False) -> DataFrame:
    """The same with the time as the event table holds it."""
    return audit_events(spark, sf_dir, minutes).withColumn("created_at", F.col("created_at").cast("timestamp"))


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as clients send them: fields missing, blank or broken, times unset.

    `batch_id` puts a third of all events into batch 0 and the others into batches of at most 25.
    """
    number = F.col("event_id")
    unset = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    return audit_events(spark, sf_dir).withColumns(
        {
            "batch_id": F.when(number % 3 == 0, 0).otherwise(F.expr("event_id div 25") + 1),
            "service": F.when(number % 10 != 9, F.col("service")),
            "actor": F.when(number % 307 == 0, "").when(number % 311 == 0, " ").otherwise(F.col("actor")),
            "action": F.when(number % 313 != 0, F.col("action")),
            "target_type": F.when(number % 317 == 0, "").otherwise(F.col("target_type")),
            "target_id": F.when(number % 7 != 3, F.col("target_id")),
            "scope_type": F.when(number % 331 != 0, F.col("scope_type")),
            "metadata": F.when(number % 41 == 0, "")
            .when(number % 59 == 0, '{"http_status":200} x')
            .when(number % 61 == 0, "{'http_status':200}")
            .otherwise(F.col("metadata")),
            "created_at": F.when(number % 53 == 0, None)
            .when(number % 47 == 0, unset)
            .otherwise(F.col("created_at")),
        }
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue deliveries of the audit events: some redelivered, some with broken bodies."""
    number = F.col("event_id")
    return (
        table_events(spark, sf_dir)
        .select(number, message_json().alias("body"))
        .select(
            F.when(number % 31 == 3, F.expr("substring(body, 1, length(body) - 1)"))
            .when(number % 37 == 5, F.concat("body", F.lit(" trailing")))
            .when(number % 41 == 7, '{"actor":5,"action":"x"}')
            .when(number % 43 == 2, "null")
            .when(number % 47 == 4, '{"actor":"u","created_at":"yesterday"}')
            .otherwise(F.col("body"))
            .alias("body"),
            F.when(number % 29 == 0, F.array(F.struct((number % 5).alias("count"))))
            .when(number % 23 == 1, F.array().cast("array<struct<count:bigint>>"))
            .alias("x_death"),
            (number % 7 == 0).alias("redelivered"),
            number,
        )
    )
