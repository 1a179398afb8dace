"""What can go wrong besides wrong arguments."""

from __future__ import annotations


class GridError(RuntimeError):
    """Base of the library's own errors."""


class ConfigurationError(GridError):
    """A setting is missing or malformed."""


class DetectorUnavailableError(GridError):
    """The detector of identifiers can't be loaded."""


class ResponseError(GridError):
    """A response that did not complete; the record of the failed call keeps id and response."""

    def __init__(self, status: str | None, reason: str | None = None, response_id: str | None = None, response: str | None = None):
        self.status, self.reason, self.response_id, self.response = status, reason, response_id, response
        label = f" (response {response_id})" if response_id else ""
        super().__init__(f"LLM response did not complete: status={status!r}; {reason or 'no reason reported'}{label}")
