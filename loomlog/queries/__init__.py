"""Registered queries; importing this package registers them all."""

from . import archive_queries, block_queries, event_queries, message_queries, plan_queries, status_queries, stream_queries, text_queries  # noqa: F401
