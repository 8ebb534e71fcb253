"""Registered queries over the driver tables, each with its check in plain SQL where SQL can say it."""

from spindlescope.plans import flagship, learning, reports, sources_and_filters, statistics, timeseries  # noqa: F401
