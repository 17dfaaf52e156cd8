"""Error types: bad input data, bad configuration, failed evaluation."""


class DataError(ValueError):
    """Input rows or files do not meet the contract."""


class ConfigError(ValueError):
    """A parameter or a combination of parameters is not valid."""


class EvalError(RuntimeError):
    """An evaluation could not be carried out."""
