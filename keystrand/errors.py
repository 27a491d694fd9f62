"""Typed failures."""


class KeystrandError(Exception):
    """Base of all errors of this package."""


class BadKey(KeystrandError, ValueError):
    """A key that is null or longer than the format allows."""


class Corrupt(KeystrandError):
    """Stored data that can't be read as what it should be."""


class NotFound(KeystrandError, LookupError):
    """A table, version or file that doesn't exist."""


class Conflict(KeystrandError):
    """Another writer published this manifest version first, again and again."""


class Stalled(KeystrandError, TimeoutError):
    """Compaction stayed behind the writes for too long."""


class Expired(KeystrandError, LookupError):
    """A past state was asked for whose versions a compaction has dropped."""
