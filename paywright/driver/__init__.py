"""The driver's tables in payroll roles, and the registered queries with their SQL counterparts."""
