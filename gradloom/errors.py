"""What can go wrong, by kind."""


class GradloomError(Exception):
    """Any error that the library raises itself."""


class DimensionMismatch(GradloomError, ValueError):
    """Two things that belong together differ in size."""


class InvalidParameter(GradloomError, ValueError):
    """A parameter is outside its range."""


class EmptyDataset(GradloomError, ValueError):
    """There are no rows or no features."""


class FeatureOutOfBounds(GradloomError, IndexError):
    """A feature index is beyond the last feature."""


class UnknownName(GradloomError, KeyError):
    """An objective, metric or enumerated value of this name doesn't exist."""


class ParseError(GradloomError, ValueError):
    """Text input that can't be read."""


class ModelFormatError(GradloomError, ValueError):
    """A stored model that can't be read, or a model that a format can't hold."""
