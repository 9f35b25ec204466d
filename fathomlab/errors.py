"""Errors with the codes that users of the library see."""


class LabError(Exception):
    code = "E_LAB"


class ValidationError(LabError):
    code = "E_VALIDATION"


class PluginError(LabError):
    code = "E_PLUGIN"


class DependencyError(LabError):
    code = "E_DEPENDENCY"


class UnknownVariableError(LabError):
    code = "E_UNKNOWN_VARIABLE"


class LookaheadError(LabError):
    code = "E_LOOKAHEAD"


class StorageError(LabError):
    code = "E_STORAGE"


class ConfigError(LabError):
    code = "E_CONFIG"
