"""The append-only event log: scan, envelope decoding, payload parsing, routing.

A raw log has two columns, ``off`` (arrival order, distinct) and ``value`` (the record as JSON text). The same functions
take batch and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywright import schemas
from paywright.functions import scalars


def read_events(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False, **options) -> DataFrame:
    """Scan a log of (off, value) rows in any file format Spark reads with an explicit schema."""
    reader = (spark.readStream if streaming else spark.read).schema(schemas.RAW_LOG).format(fmt).options(**options)
    return reader.load(path)


def read_kafka_events(
    spark: SparkSession, servers: str, topic: str, partitions: int, streaming: bool = False, **options
) -> DataFrame:
    """Scan a Kafka topic from the earliest record, where the Kafka package is on the class path.

    Offsets are per topic partition. ``off`` interleaves them into one distinct number per record, which keeps the order
    within a partition; ``partitions`` is the partition count of the topic, so that the numbers stay dense. Write an
    employee's events with the employee id as record key so that they share a partition.
    """
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    log = (
        reader.option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**options)
        .load()
    )
    return log.select(
        (F.col("offset") * F.lit(partitions) + F.col("partition")).alias("off"),
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
    )


def decode_envelope(raw: DataFrame, body_fallback: bool = False) -> DataFrame:
    """(off, value) -> (off, type, source, data).

    ``data`` may be a JSON string or a JSON object; both come out as the payload's text. Records that are not JSON, or
    whose ``data`` is null, are dropped. With ``body_fallback`` a record without a ``data`` member is its own payload.
    """
    members = F.json_tuple("value", *schemas.ENVELOPE_FIELDS).alias(*schemas.ENVELOPE_FIELDS)
    data = F.col("data")
    if body_fallback:
        names = F.json_object_keys("value")
        data = F.coalesce(data, F.when(~F.array_contains(names, "data"), F.col("value")))
    return raw.select("off", "value", members).select("off", "type", "source", data.alias("data")).filter(data.isNotNull())


def events_of(raw: DataFrame, body_fallback: bool = False) -> DataFrame:
    """Raw log to events (off, data)."""
    return decode_envelope(raw, body_fallback).select("off", "data")


def parse_payloads(events: DataFrame) -> DataFrame:
    """(off, data) with the payload's text parsed once, into a VARIANT; ``unparsed`` keeps what is not JSON.

    A payload that names a member twice is not taken for JSON either.
    """
    parsed = events.select("off", F.try_parse_json("data").alias("_parsed"), "data")
    return parsed.select(
        "off", F.col("_parsed").alias("data"), F.when(F.col("_parsed").isNull(), F.col("data")).alias("unparsed")
    )


def is_parsed(events: DataFrame) -> bool:
    """Whether payloads are VARIANT values, as in a landed log, rather than JSON text."""
    return isinstance(events.schema["data"].dataType, T.VariantType)


def _members(events: DataFrame, columns: dict[str, str]) -> list[Column]:
    """Payload members under new names, as text; domain events stay VARIANT where payloads are.

    ``json_tuple`` reads a text once for all members. As a generator it also keeps Catalyst from copying the parse into
    filters, which would read the same text once per predicate. A VARIANT needs neither: a member is found by its offset.
    Numbers that come out of one are in canonical form (``6.0`` reads ``6``).
    """
    if not is_parsed(events):
        return [F.json_tuple("data", *columns).alias(*columns.values())]
    kind = lambda name: "variant" if name in _DOMAIN else "string"
    return [F.try_variant_get("data", f"$.{name}", kind(name)).alias(alias) for name, alias in columns.items()]


def with_fields(events: DataFrame, *names: str, domain_event: bool = False, either_case: bool = False) -> DataFrame:
    """(off, data) -> (off, event_type, *names), every field as text.

    The event name that counts is the one in the payload's first domain event; a landed log already has it as a column
    that filters push down to. With ``either_case`` the members may also be spelt in camelCase.
    """
    landed = "event_type" in events.columns
    wanted = [*(["DomainEvents"] if domain_event or not landed else []), *names]
    columns = {name: f"_{name}" for name in wanted}
    lowered = {_camel(name): f"_low_{name}" for name in wanted} if either_case else {}
    parsed = events.select("off", *(["event_type"] if landed else []), *_members(events, {**columns, **lowered}))

    def field(name: str) -> Column:
        return F.coalesce(columns[name], lowered[_camel(name)]) if either_case else F.col(columns[name])

    domain = parsed.withColumn("_domain", field("DomainEvents")) if "DomainEvents" in wanted else parsed
    event_type = F.col("event_type") if landed else domain_field(events, "EventType", either_case).alias("event_type")
    return domain.select("off", event_type, *[field(n).alias(n) for n in names], *(["_domain"] if domain_event else []))


def domain_field(events: DataFrame, name: str, either_case: bool = False) -> Column:
    """A field of the payload's first domain event; ``events`` tells what payloads are."""
    read = (lambda p: F.try_variant_get("_domain", p, "string")) if is_parsed(events) else (lambda p: F.get_json_object("_domain", p))
    exact = read(f"$[0].{name}")
    return F.coalesce(exact, read(f"$[0].{_camel(name)}")) if either_case else exact


def _camel(name: str) -> str:
    return name[0].lower() + name[1:]


_DOMAIN = ("DomainEvents", "domainEvents")

# Fixed value: the id of an event that has none.
EMPTY_ID = "00000000-0000-0000-0000-000000000000"


def is_direct(event_id: Column, event_type: Column) -> Column:
    """Whether a payload is an event itself: it carries its own id and type."""
    return ~F.coalesce(event_id, F.lit("")).isin(EMPTY_ID, "") & (F.coalesce(event_type, F.lit("")) != "")


def resolve_identity(events: DataFrame, *names: str) -> DataFrame:
    """(off, employee_id, event_id, event_type, occurred_on, *names) for both payload forms.

    A payload that carries its own EventId and EventType is a projected event; otherwise it is an entity whose first
    domain event tells what happened. Member names are read in PascalCase or camelCase.
    """
    own = ["Id", "EmployeeId", "EventId", "EventType", "OccurredOn"]
    more = [n for n in names if n not in own]
    rows = with_fields(events, *own, *more, domain_event=True, either_case=True)
    nested = lambda name: domain_field(events, name, either_case=True)
    direct = is_direct(F.col("EventId"), F.col("EventType"))
    pick = lambda one, other: F.when(direct, one).otherwise(other)
    return rows.select(
        "off",
        pick(F.col("EmployeeId"), F.col("Id")).alias("employee_id"),
        pick(F.col("EventId"), nested("EventId")).alias("event_id"),
        pick(F.col("EventType"), F.coalesce(nested("EventType"), F.lit(""))).alias("event_type"),
        pick(F.col("OccurredOn"), nested("OccurredOn")).try_cast("timestamp").alias("occurred_on"),
        *names,
    )


def topic_of(event_type: Column) -> Column:
    """'employee.created' -> 'employee-events'."""
    return F.concat(scalars.event_prefix(event_type), F.lit("-events"))


UNKNOWN_TOPIC = "unknown"


def route(events: DataFrame) -> DataFrame:
    """(off, event_type, topic, data ...) of every record, with whatever columns ``events`` has behind ``off``.

    ``event_type`` names the first domain event, as in a log that was not landed. The topic follows the resolved type, so
    a payload that is an event itself goes to its own topic; records without any type go to ``UNKNOWN_TOPIC``.
    """
    members = ["DomainEvents", "EventId", "EventType"]
    parts = ["_exact", "_id", "_type", "_low_domain", "_low_id", "_low_type"]
    rest = [c for c in events.columns if c != "off"]
    named = events.select("off", *rest, *_members(events, dict(zip([*members, *map(_camel, members)], parts, strict=True)))).select(
        "off", *rest, "_exact", F.coalesce("_exact", "_low_domain").alias("_domain"),
        F.coalesce("_id", "_low_id").alias("_id"), F.coalesce("_type", "_low_type").alias("_type"),
    )
    nested = domain_field(events, "EventType", either_case=True)
    resolved = F.when(is_direct(F.col("_id"), F.col("_type")), F.col("_type")).otherwise(nested)
    topic = F.when(F.coalesce(resolved, F.lit("")) == "", UNKNOWN_TOPIC).otherwise(topic_of(resolved))
    exact = F.try_variant_get("_exact", "$[0].EventType", "string") if is_parsed(events) else F.get_json_object("_exact", "$[0].EventType")
    return named.select("off", exact.alias("event_type"), topic.alias("topic"), *rest)


LANDED = "off bigint, event_type string, data variant, unparsed string, topic string"


def land(raw: DataFrame, path: str, mode: str = "append") -> None:
    """Write the log partitioned by topic, with the event name as a column and payloads as VARIANT.

    Every payload is parsed here, once. JSON-path predicates cannot skip Parquet data: readers of a log landed this way
    prune whole topics, filter on ``event_type`` statistics and take members out of the binary payload without parsing.
    """
    route(parse_payloads(events_of(raw))).write.mode(mode).partitionBy("topic").parquet(path)


def read_landed(spark: SparkSession, path: str, topics: list[str] | None = None) -> DataFrame:
    """Events (off, event_type, data, unparsed) of a landed log; ``topics`` prunes partitions."""
    log = spark.read.schema(LANDED).parquet(path)
    if topics:
        log = log.filter(F.col("topic").isin(topics))
    return log.drop("topic")
