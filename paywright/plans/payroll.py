"""From the event log to net pay and search documents in one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from paywright.operators import extract, netpay, pay, people
from paywright.plans.search_documents import search_documents
from paywright.session import materialize
from paywright.sources.event_log import read_landed


@dataclass(frozen=True)
class Payroll:
    """Tables derived from events (off, data), each built on demand.

    ``source`` is called with the entity names a table needs and returns their events. A landed log can prune topics
    there; a source that ignores the names and returns everything is correct too.
    """

    source: Callable[..., DataFrame]

    @classmethod
    def of(cls, events: DataFrame) -> Payroll:
        return cls(lambda *entities: events)

    @classmethod
    def landed(cls, spark: SparkSession, path: str) -> Payroll:
        """Over a log written by ``event_log.land``: every table scans only the topics it is made of."""
        return cls(lambda *entities: read_landed(spark, path, [f"{e}-events" for e in entities]))

    def gross_pay(self) -> DataFrame:
        return pay.gross_pay_by_period(extract.gross_pay_events(self.source("employee", "timeentry")))

    def hours(self) -> DataFrame:
        return pay.hours_by_period(extract.time_entry_events(self.source("timeentry")))

    def employees(self) -> DataFrame:
        return people.employee_info(extract.employee_info_events(self.source("employee")))

    def deactivated(self) -> DataFrame:
        return people.deactivated_employees(self.source("employee"))

    def tax_events(self) -> DataFrame:
        return extract.tax_events(self.source("taxinfo"))

    def deduction_events(self) -> DataFrame:
        return extract.deduction_events(self.source("deduction"))

    def tax_state(self) -> DataFrame:
        return people.tax_state(self.tax_events())

    def deduction_totals(self) -> DataFrame:
        return people.deduction_totals(people.deduction_state(self.deduction_events()))

    def net_pay(self, mode: str = "snapshot", current_period: int | None = None) -> DataFrame:
        """``snapshot``: latest settings everywhere. ``asof``: each period keeps the settings it was computed with."""
        if mode == "asof":
            gross = materialize(self.gross_pay(), "gross-pay")  # three branches read it
            return netpay.net_pay_asof(
                gross, self.tax_events(), self.deduction_events(), current_period, self.deactivated()
            )
        if mode != "snapshot":
            raise ValueError(f"unknown mode {mode!r}")
        return netpay.net_pay(self.gross_pay(), self.tax_state(), self.deduction_totals(), self.deactivated())

    def documents(self, include_inactive: bool = False) -> DataFrame:
        return search_documents(self.employees(), self.net_pay(), include_inactive)
