"""Errors of the typed query layer."""


class TabweaveError(Exception):
    """Base of all errors here."""


class InvalidModel(TabweaveError):
    """A model, tag or identifier that breaks a rule."""


class InvalidArgument(TabweaveError):
    """A value that a query or mutation cannot take."""


class UnknownColumn(InvalidArgument):
    """An expression on a column of another model."""


class UnsafeMutation(TabweaveError):
    """An update or delete that would touch every row, without ``allow_all``."""


class NoRows(TabweaveError):
    """A single row was asked for and there is none."""


class Conflict(TabweaveError):
    """The key has been committed before."""
