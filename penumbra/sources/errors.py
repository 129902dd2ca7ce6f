"""What the engine refuses or cannot do."""


class EngineError(Exception):
    """What the engine refuses or cannot do."""


class IngestError(EngineError):
    """A document could not be read."""


class RedactError(EngineError):
    """A document could not be redacted."""


class Unsupported(EngineError):
    """The combination of input and output is not supported."""
