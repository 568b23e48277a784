"""Errors raised by the library."""


class VellumError(Exception):
    """Base class."""


class InvalidRequest(VellumError, ValueError):
    """A blank or malformed argument."""


class FetchError(VellumError):
    """A source file could not be read, or is too large."""


class ExtractionError(VellumError):
    """A file yields no text, or more than allowed."""


class SchemaMismatch(VellumError):
    """A table exists with another vector size or kind."""


class ModeConflict(VellumError):
    """The requested index mode differs from that of the knowledge base."""


class ProviderUnavailable(VellumError):
    """An embedding provider did not answer its health probe."""
