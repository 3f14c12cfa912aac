"""Multi-step plans: search documents, filter compilation, and the log-to-net-pay job."""
