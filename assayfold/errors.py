"""The one kind of error that the library raises for what a caller can mend."""


class AssayError(ValueError):
    """Arguments, tables or folders that cannot be used, and runs that were given up."""
