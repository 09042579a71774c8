"""Errors of the dataset facade."""

from __future__ import annotations


class DatasetError(Exception):
    """Base of all errors of this package."""


class ConfigurationError(DatasetError):
    """A dataset is configured in a way that can't work."""


class FlushError(DatasetError):
    """Buffered rows could not be written."""


class EncryptionNotReady(DatasetError):
    """A row is to be encrypted, and the dataset has no key."""


class StoreClosed(DatasetError):
    """The store was closed or halted; the cause is attached."""


class CorruptLog(DatasetError):
    """The log holds fewer rows than its metadata says."""


class ModeError(DatasetError):
    """The access mode forbids the operation."""
