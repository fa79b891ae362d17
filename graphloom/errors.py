"""Errors with stable types, so that callers can tell a rejected shape from bad data."""


class GraphError(Exception):
    """Base of all errors of this package."""


class GraphQueryError(GraphError):
    """A query shape that the engine rejects, raised while the query is built."""


class EmptyResultError(GraphError):
    """A terminal that needs a row found none."""


class CardinalityError(GraphError):
    """A terminal or selection that needs one row found several."""


class ConstraintError(GraphError):
    """A key, uniqueness, endpoint or property rule would be broken; nothing was changed."""


class CancelledError(GraphError):
    """The caller ended the query while it ran."""
