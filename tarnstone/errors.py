"""Error taxonomy: every failure names its class and the seam it came from."""

from __future__ import annotations

#: Error classes and the HTTP statuses a service in front would answer with, fixed values.
STATUS = {"validation_error": 400, "not_found": 404, "unsupported_type": 415, "upstream_error": 502, "unavailable": 503}
#: Ways in which a parser can refuse a document, fixed values.
PARSE_FAILURES = ("unrecognized", "malformed", "unsupported_variant")


class EngineError(Exception):
    """A failure with an ``error_class`` of STATUS and, where known, the ``seam`` it crossed."""

    def __init__(self, error_class: str, message: str, seam: str | None = None):
        if error_class not in STATUS:
            raise ValueError(f"unknown error class {error_class}")
        super().__init__(message)
        self.error_class, self.seam = error_class, seam

    @property
    def status(self) -> int:
        return STATUS[self.error_class]


class ParseError(Exception):
    """A parser's refusal; it ends up in a row's failure struct, never as a failed job."""

    def __init__(self, category: str, message: str):
        if category not in PARSE_FAILURES:
            raise ValueError(f"unknown category {category}")
        super().__init__(message)
        self.category = category
