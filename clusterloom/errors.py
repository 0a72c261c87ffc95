"""What can be wrong with a request, and how a service answers it."""

from __future__ import annotations


class RequestError(Exception):
    """A request that can't be served; ``status`` is the answer's."""

    status = 400


class InvalidInput(RequestError):
    """Nothing to work on, or too much."""


class Unavailable(RequestError):
    """A method whose provider isn't configured."""


class BlockedAddress(RequestError):
    """A URL that a server must not fetch."""


class TooManyRequests(RequestError):
    status = 429

    def __init__(self, retry_after: int) -> None:
        super().__init__(f"too many requests; retry in {retry_after} s")
        self.retry_after = retry_after


def status_of(error: Exception) -> int:
    """400 for a known error, 429 for an exhausted budget, else 500."""
    return error.status if isinstance(error, RequestError) else 500
