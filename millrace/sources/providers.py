"""The provider interface: a picklable object that turns a prompt into a reply.

No network client lives here.  A deployment brings its own ``complete`` and raises the
typed errors below (``functions.http.error_class`` names the class of a status).
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Callable


class ProviderError(Exception):
    """Base of the typed errors."""


class RateLimited(ProviderError):
    """Retried with growing delays, then the next provider."""


class PayloadTooLarge(ProviderError):
    """The text is halved and starts over at the first provider."""


class Unavailable(ProviderError):
    """The next provider at once."""


class TransportError(ProviderError):
    """Retried after a constant delay, then the next provider."""


@dataclass(frozen=True)
class Provider:
    """``complete`` gets the prompt; a provider without its credential is left out."""

    name: str
    complete: Callable[[str], str]
    credential_env: str | None = None

    @property
    def is_configured(self) -> bool:
        return self.credential_env is None or bool(os.environ.get(self.credential_env))
