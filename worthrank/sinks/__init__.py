"""Writers: rankings, per-document splits, models, run log, reports."""
