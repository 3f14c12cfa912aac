"""A small firm: two workers paid by the hour, three by the year, shifts over five pay periods.

The expected values in the tests are derived by hand from what stands here.
"""

from datetime import date, timedelta

from helpers import event

HOURLY, YEARLY = 1, 2
STAFF = {
    "w-ines": {"name": ("Ines", "Moreau"), "kind": YEARLY, "rate": 62_400, "hours": 38, "tax": ("Married", "OR", 10, 0), "off": [(120, False), (4, True)]},
    "w-tomas": {"name": ("Tomas", "Vidal"), "kind": HOURLY, "rate": 22.40, "hours": 40, "tax": ("Single", "MN", 0, 7.5), "off": [(35, False), (60, False)]},
    "w-priya": {"name": ("Priya", "Raman"), "kind": YEARLY, "rate": 118_560, "hours": 36, "tax": ("Single", "FL", 25, 0), "off": [(80, False), (15, False), (7.5, True)]},
    "w-kofi": {"name": ("Kofi", "Asante"), "kind": HOURLY, "rate": 41, "hours": 40, "tax": ("HeadOfHousehold", "GA", 0, 0), "off": []},
    "w-lena": {"name": ("Lena", "Ostrow"), "kind": YEARLY, "rate": 52_000, "hours": 40, "tax": ("Married", "VA", 0, 12), "off": []},
}
#: Every third day from 23 April 2024 on, 22 shifts of 6, 6.75 and 7.5 hours in turn: periods 8 to 12.
SHIFTS = [(date(2024, 4, 23) + timedelta(days=3 * k), 6 + 0.75 * (k % 3)) for k in range(22)]
#: The period in which rates are set by default.
PERIOD = 10


def shift(worker, k, hours=None, kind="timeentry.clockedout"):
    """The event of a worker's shift ``k``; it begins at seven."""
    day, usual = SHIFTS[k]
    hours = usual if hours is None else hours
    end = f"{int(7 + hours):02d}:{int(hours % 1 * 60):02d}"
    return event(kind, Id=f"{worker}-{k}", EmployeeId=worker, ClockIn=f"{day}T07:00:00.000Z", ClockOut=f"{day}T{end}:00.000Z", HoursWorked=hours)


def payloads(rate_day="2024-05-27T00:00:00Z"):
    """All events; rates are set on ``rate_day``."""
    log = [
        event(
            "employee.created", Id=i, FirstName=w["name"][0], LastName=w["name"][1], Email=f"{w['name'][0].lower()}@firm.test", PayType=w["kind"],
            PayRate=w["rate"], PayPeriodHours=w["hours"], HireDate="2022-09-01T00:00:00Z", IsActive=True, UpdatedAt=rate_day,
        )
        for i, w in STAFF.items()
    ]
    log += [shift(i, k) for k in range(len(SHIFTS)) for i, w in STAFF.items() if w["kind"] == HOURLY]
    for i, w in STAFF.items():
        filing, state, federal, local = w["tax"]
        log.append(event("taxinfo.created", Id=f"{i}-tax", EmployeeId=i, FederalFilingStatus=filing, State=state, AdditionalFederalWithholding=federal, AdditionalStateWithholding=local))
        for n, (amount, percent) in enumerate(w["off"]):
            log.append(event("deduction.created", Id=f"{i}-ded-{n}", EmployeeId=i, DeductionType=1, Amount=amount, IsPercentage=percent, IsActive=True))
    return log
