"""End-to-end runs: model fitting, scoring and the registered queries."""
