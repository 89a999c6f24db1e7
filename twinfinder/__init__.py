"""Find and resolve duplicate content at scale with Spark."""

from twinfinder.session import checkpointed, configure

__all__ = ["checkpointed", "configure"]
