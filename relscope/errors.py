"""Errors raised while planning; errors of single rows are raised by Spark."""


class RelscopeError(Exception):
    pass


class UnknownFieldError(RelscopeError):
    """A path names no field or association of its entity."""


class NotLoadedError(RelscopeError):
    """get() met associations that only load() may join."""

    def __init__(self, paths):
        super().__init__(f"not loaded: {', '.join(sorted(paths))}")
        self.paths = sorted(paths)


class TranslationError(RelscopeError):
    """A condition has no native form where one is required."""


class MultipleResultsError(RelscopeError):
    """A lookup of one row found several."""


class EmptyError(RelscopeError):
    """An extreme of an empty collection without a fallback."""


class RulesNotFoundError(RelscopeError):
    """A rule set was asked for under a name that nobody registered."""
