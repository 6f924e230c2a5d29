"""Jobs of one or more statements, with status, diagnostics, cancellation and timeouts."""

from .service import TaskService

__all__ = ["TaskService"]
