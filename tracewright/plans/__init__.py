"""Whole analyses as lazy plans: accuracy evaluation, two-stage search, validation sweeps, and the registered queries."""
