"""Error codes of refused records, as they stand in ``_error.code``."""

#: The names that readers of the data rely on.
DECODE = (
    "InputLimit", "DepthLimit", "ItemLimit", "LengthLimit", "SyntaxError", "InvalidUtf8", "UnexpectedType",
    "MissingField", "UnknownField", "DuplicateField", "UnknownVariant", "NumberOutOfRange", "InexactNumber",
    "UnsupportedValue", "CustomRejected",
)
LINE = ("ControlByte", "MissingSeparator", "LineTooLong", "MalformedLine")
EDIT = ("InvalidPointer", "PathNotFound")


class SpecError(ValueError):
    """A declaration that could never be read or written."""
