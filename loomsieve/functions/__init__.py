"""Pure Column expressions."""

from loomsieve.functions import dates, text, verdicts

__all__ = ["dates", "text", "verdicts"]
