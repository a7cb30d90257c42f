"""Incremental and monotonic subscriptions."""
