"""Registered queries: every operator over the derived telemetry, beside an equivalent SQL text."""
