"""Payload texts, envelopes and sorted rows for the tests."""

import json


def event(event_type, event_id=None, occurred_on=None, **fields):
    """Payload of one event as text."""
    domain = {"EventType": event_type, "EventId": event_id, "OccurredOn": occurred_on}
    return json.dumps({**fields, "DomainEvents": [{k: v for k, v in domain.items() if v is not None}]})


def envelope(data, **extra):
    return json.dumps({"type": "payroll.event", "source": "test", "data": data, **extra})


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
